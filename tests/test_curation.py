from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from klangsieb.functions import arrays, text
from klangsieb.operators import select, vectors
from klangsieb.sources import codes, remote


def test_admission_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(f"k{i:03d}", i, rng.choice("abcd"), rng.randint(1, 9)) for i in range(200)]
    got = {r["k"] for r in select.admit(spark.createDataFrame(rows, "k string, o int, s string, ms int"), "k", F.col("o"), "s", 5, F.col("ms"), 60).collect()}
    want, total, n = set(), 0, {}
    for k, _, s, ms in rows:
        if total >= 60:
            break
        if n.get(s, 0) < 5:
            n[s] = n.get(s, 0) + 1
            total += ms
            want.add(k)
    assert got == want


def test_labels(spark):
    ids = F.array(*map(F.lit, [1, 7, 7, 8, 1, 7, 8, 7]))
    got = spark.range(1).select(arrays.block_labels(ids, F.lit(7), F.lit(8), F.array(F.lit(True), F.lit(False)))).first()[0]
    assert got == [-100, -101, -101, 8, -100, 7, 8, 7]
    lab, cod = F.array(*map(F.lit, [-100, -101, 7, 8])), F.array(*[F.array(F.lit(5), F.lit(6), F.lit(4))] * 4)
    slots = spark.range(1).select(arrays.slot_labels(lab, cod, F.lit(8), 2051, 3)).first()[0]
    assert slots == [[-100] * 3, [5, -100, -100], [5, 6, 4], [2051, -100, -100]]


def test_texts(spark):
    rows = spark.createDataFrame([("Über 3,5 % €", "de"), ("20,000 is 1.25", "en"), ("7 %", "pt"), (None, "de")], "t string, l string")
    assert [r[0] for r in rows.select(text.eval_form_numbers("t", "l")).collect()] == ["über drei komma fünf prozent euro", "twenty point zero zero zero is one point two five", "7 percent", None]
    p = spark.createDataFrame([("a/x",), ("a/b/x",), ("c",)], "p string").select(text.rewrite_prefix(F.col("p"), [("a/b/", "1/"), ("a/", "2/")])).collect()
    assert [r[0] for r in p] == ["2/x", "1/x", "c"]


def test_dissolved_clusters(spark):
    rows = [("g", 1, 1, 9.0, [1.0, 0.0]), ("g", 2, 2, 9.0, [0.0, 1.0]), ("g", 3, 3, 1.0, [0.9, 0.1]), ("g", 4, 3, 1.0, [-1.0, -1.0]), ("h", 5, 5, 1.0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "g string, i long, c long, w double, v array<double>")
    got = {r["i"]: r["c"] for r in vectors.dissolve_small(df, "g", "i", "c", "w", "v", 5.0, 0.45).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: None, 5: None}


def test_codes(spark, tmp_path):
    df = spark.createDataFrame([(f"c{i}", [[i, j] for j in range(i)]) for i in range(6)], codes.SCHEMA)
    codes.write_codes(df, str(tmp_path / "codes"), 2)
    back = codes.read_codes(spark, str(tmp_path / "codes"))
    assert back.count() == 6 and codes.read_codes(spark, str(tmp_path / "codes"), "c3").first()["codes"] == [[3, 0], [3, 1], [3, 2]]
    assert "PushedFilters: [IsNotNull(idx), EqualTo(idx,c3)]" in codes.read_codes(spark, str(tmp_path / "codes"), "c3")._jdf.queryExecution().toString()
    assert {r["idx"]: (r["off"], r["n"]) for r in codes.code_index(back).collect()} == {"c0": (0, 0), "c1": (0, 1), "c2": (1, 2), "c3": (3, 3), "c4": (6, 4), "c5": (10, 5)}
    assert {(r["book"], r["code"]): r["n"] for r in codes.code_histogram(back).collect()}[0, 5] == 5
    with pytest.raises(Exception, match="ragged codes of x"):
        codes.write_codes(spark.createDataFrame([("x", [[1, 2], [3]])], codes.SCHEMA), str(tmp_path / "bad"))


def test_settings_and_calls(spark, tmp_path):
    (tmp_path / ".env").write_text("# note\nA=1\n B = 'x=y' \n\nbroken\n")
    assert remote.read_settings(str(tmp_path / ".env"), {"A": "2", "C": "3"}) == {"A": "2", "B": "x=y"}

    def call(row):
        if row["chunk"] == "bad":
            return 403, "refused"
        if row["chunk"] == "down":
            raise OSError("no route")
        return 200, row["chunk"].upper()

    df = spark.createDataFrame([("ok",), ("bad",), ("down",)], "chunk string")
    got = {r["chunk"]: (r["status"], r["text"], r["reason"]) for r in remote.enrich(df, "chunk", call, lambda s: None).collect()}
    assert got == {"ok": ("ok", "OK", None), "bad": ("rejected", None, "status 403 refused"), "down": ("rejected", None, "status 0 no route")}


def test_preselection_looks_at_all_clips_of_a_speaker(spark, data):
    from klangsieb.plans import curation, words
    from klangsieb.plans.selection import meta

    seen = {(r["folded"], r["idx"]) for r in words._tokens(spark, data).select("folded", "idx").distinct().collect()}
    rare = {r["word"]: r["clips"] for r in words._rare(words._tokens(spark, data)).collect()}
    speaker = {r["idx"]: r["speaker"] for r in meta(spark, data).where("dur > 0").collect()}
    taken, of, left = [], {}, dict.fromkeys(rare, 6)
    of_clip: dict = {}
    for w, c in seen:
        if w in rare and c in speaker:
            of_clip.setdefault(c, []).append(w)
    order = lambda x: (rare[x[0]], x[0], hashlib.sha1(x[1].encode()).hexdigest(), x[1])
    for w, c in sorted(((w, c) for c, ws in of_clip.items() for w in ws), key=order):
        if left[w] > 0 and c not in taken and of.get(speaker[c], 0) < 10:
            taken.append(c)
            of[speaker[c]] = of.get(speaker[c], 0) + 1
            for x in of_clip[c]:
                left[x] -= 1
    got = curation.preselect_double_demand(spark, data).orderBy("pick").collect()
    assert [r["clip"] for r in got] == taken


def _many_words(spark, data, folder, clips: int = 1050, each: int = 20) -> str:
    """Clips of ``each`` words that occur nowhere else, of a speaker each."""
    word = lambda n: "wort" + "".join(chr(97 + n // 26**k % 26) for k in (3, 2, 1, 0))
    rows = [(f"c{i:05d}", " ".join(word(i * each + k) for k in range(each))) for i in range(clips)]
    own = spark.createDataFrame(rows, "idx string, text string")
    for name, given in (("texts", {"line_no": F.lit(1)}), ("dataset_meta", {"speaker": F.col("idx"), "dur_proc_s": F.lit(1.0), "written_at": F.current_timestamp()})):
        schema = spark.read.parquet(f"{data}/{name}.parquet").schema
        full = own.withColumns(given)
        full.select(*[(F.col(f.name) if f.name in full.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_preselection_asks_for_every_rare_word(spark, data, tmp_path):
    from klangsieb.plans import curation

    got = curation.preselect_double_demand(spark, _many_words(spark, data, tmp_path)).collect()
    assert len({r["clip"] for r in got}) == 1050


def test_cover_asks_for_every_rare_word(spark, data, tmp_path):
    from klangsieb.plans import words

    got = words.greedy_quota_cover(spark, _many_words(spark, data, tmp_path)).collect()
    assert len({r["clip"] for r in got}) == 1050


def test_subword_counts_without_a_tokenizer(spark, data, tmp_path):
    from klangsieb.plans import curation

    with pytest.raises(FileNotFoundError, match="byte_bpe_50k"):
        curation.subword_counts(spark, data, str(tmp_path))
    assert curation.subword_counts(spark, data).count() > 0
