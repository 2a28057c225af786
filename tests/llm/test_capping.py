from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from klangsieb.llm.capping import cap_contributors, speaker_key, water_level


def _level(spark, counts, max_count, share):
    return water_level(spark.createDataFrame([(c,) for c in counts], "n bigint"), max_count, share).first()["level"]


@pytest.mark.parametrize("seed", range(6))
def test_level_against_search(spark, seed):
    rng = random.Random(seed)
    counts = [rng.choice([1, 2, 3, 5, 8, 40, 200]) for _ in range(rng.randint(3, 30))]
    share = rng.choice([0.05, 0.2, 0.34, 0.5, 1.0])
    best = [lv for lv in range(1, max(counts) + 1) if min(max(counts), lv) <= share * sum(min(c, lv) for c in counts) + 1e-9]
    assert _level(spark, counts, None, share) == max(best, default=1)


def test_count_limit_and_empty(spark):
    assert _level(spark, [100, 3], 25, 1.0) == 25
    assert _level(spark, [10, 3], None, 1.0) == 10
    assert _level(spark, [], None, 0.5) == 1


def _run(spark, rows, **how):
    df = spark.createDataFrame(rows, "idx string, speaker string, snr double")
    return {r["item"]: (r["rank"], r["kept"]) for r in cap_contributors(df, "idx", "speaker", "snr", **how).collect()}


def test_best_stay_ties_by_item(spark):
    rows = [("a", "s", 1.0), ("b", "s", None), ("c", "s", math.nan), ("d", "s", 5.0), ("e", "s", 1.0), ("f", "t", None), ("g", None, 3.0), ("d", "s", 5.0)]
    got = _run(spark, rows, max_count=2)
    assert got == {"d": (1, True), "a": (2, True), "e": (3, False), "b": (4, False), "c": (5, False), "f": (1, True), "g": (None, True)}


def test_dominant_contributor(spark):
    rows = [(f"h{i:04d}", "hot", float(i % 50)) for i in range(2000)] + [(f"x{i}", f"s{i % 20}", 1.0) for i in range(100)]
    got = _run(spark, rows, max_count=25)
    want = {i for i, _, _ in sorted((r for r in rows if r[1] == "hot"), key=lambda r: (-r[2], r[0]))[:25]}
    assert {i for i, (_, kept) in got.items() if kept and i.startswith("h")} == want
    assert all(kept for i, (_, kept) in got.items() if i.startswith("x"))
    share = _run(spark, rows, max_share=0.2)
    kept = [i for i, (_, k) in share.items() if k]
    assert sum(i.startswith("h") for i in kept) == 25 and len(kept) == 125


def test_null_items_empty_and_clashing_columns(spark):
    assert _run(spark, [], max_count=2) == {}
    df = spark.createDataFrame([(None, "s", 1.0, 3, 4), ("a", "s", 1.0, 3, 4)], "idx string, speaker string, snr double, rank int, level int")
    assert cap_contributors(df, "idx", "speaker", "snr", max_count=1).where("kept").select("item").collect()[0][0] == "a"


def test_speaker_key(spark):
    raw = [" MSP_0012 ", "msp-12", "Msp   012", "msp _- 0", "", "  ", None, "x", "007", "abc-000"]
    rows = spark.createDataFrame([(x,) for x in raw], "s string").select(speaker_key(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["msp-12", "msp-12", "msp-12", "msp-0", None, None, None, "x", "7", "abc-0"]
