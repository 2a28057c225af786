from __future__ import annotations

import pytest

from klangsieb.llm.mixing import enabled_clips, mix_to_shares

ITEM = "idx string, corpus string, dur_proc_s double"
TARGET = "name string, target_share double, max_repeat int"


def _mix(spark, items, targets, **how):
    mix, report = mix_to_shares(spark.createDataFrame(items, ITEM), spark.createDataFrame(targets, TARGET), **how)
    return {r["item"]: r for r in mix.collect()}, {r["name"]: r for r in report.collect()}


def test_shares_and_caps(spark):
    items = [(f"a{i}", "a", 1.0 + i % 7) for i in range(900)] + [(f"b{i}", "B ", 2.0) for i in range(40)] + [(f"c{i}", "c", 3.0) for i in range(100)]
    mix, report = _mix(spark, items, [("a", 0.5, 2), ("b", 0.2, 3), ("c", 0.3, 4)])
    total = sum(x[2] for x in items)
    assert report["b"]["limited"] and not report["a"]["limited"] and not report["c"]["limited"]
    assert {r["copies"] for i, r in mix.items() if i.startswith("b")} == {3}
    for name, share in (("a", 0.5), ("c", 0.3)):
        assert abs(report[name]["reached_size"] - share * total) <= 8.0
        got = sum(r["copies"] * r["size"] for i, r in mix.items() if i.startswith(name))
        assert got == pytest.approx(report[name]["reached_size"])
    # every item gets the whole number below or above its expectation
    expect = 0.3 * total / 300
    assert {r["copies"] for i, r in mix.items() if i.startswith("c")} <= {int(expect), int(expect) + 1}
    assert sum(r["reached_share"] for r in report.values()) == pytest.approx(1.0)


def test_fitted_total(spark):
    items = [(f"a{i}", "a", 1.0) for i in range(500)] + [(f"b{i}", "b", 1.0) for i in range(50)]
    _, report = _mix(spark, items, [("a", 0.5, 1), ("b", 0.4, 2), ("none", 0.1, 2)], fit=True)
    assert report["b"]["copies"] == 100 and abs(report["a"]["copies"] - 125) <= 1 and not report["b"]["limited"]
    assert report["a"]["reached_share"] / report["b"]["reached_share"] == pytest.approx(1.25, abs=0.02) and report["none"]["limited"]


def test_one_source_with_most_rows(spark):
    items = [(f"h{i:05d}", "hot", 1.0) for i in range(3000)] + [(f"s{i}", "small", 1.0) for i in range(10)]
    mix, report = _mix(spark, items, [("hot", 0.1, 1), ("small", 0.9, 5)])
    assert abs(report["hot"]["copies"] - 301) <= 1 and report["small"]["copies"] == 50
    assert max(r["copies"] for r in mix.values()) == 5


def test_nulls_and_odd_sizes(spark):
    items = [("a", "x", None), ("b", "x", float("nan")), ("c", "x", -3.0), ("d", "x", 4.0), (None, "x", 9.0), ("e", None, 9.0), ("f", "other", 6.0)]
    mix, report = _mix(spark, items, [("x", 0.5, 2), (None, 0.5, 2), ("gone", None, None)])
    assert report["x"]["n_items"] == 4 and report["x"]["available"] == 4.0 and report["x"]["target_size"] == 5.0
    assert "f" not in mix and not report["gone"]["limited"] and report["gone"]["copies"] == 0
    assert set(report) == {"x", "gone"}


def test_empty(spark):
    mix, report = _mix(spark, [], [("x", 1.0, 2)])
    assert mix == {} and report["x"]["reached_size"] == 0.0 and not report["x"]["limited"]
    mix, report = _mix(spark, [("a", "x", 1.0)], [])
    assert mix == {} and report == {}


def test_repeated_targets_and_extra_columns(spark):
    items = spark.createDataFrame([("a", "x", 1.0, 7, "s", 3)], ITEM + ", copies int, source string, size int")
    mix, report = mix_to_shares(items, spark.createDataFrame([("x", 1.0, 1, "y")] * 2, TARGET + ", expect string"))
    assert [(r["item"], r["copies"]) for r in mix.collect()] == [("a", 1)] and report.count() == 1


def test_same_seed_same_mix(spark):
    items = [(f"a{i}", "a", 1.0) for i in range(200)]
    a, _ = _mix(spark, items, [("a", 0.3, 1)])
    b, _ = _mix(spark, items[::-1], [("a", 0.3, 1)])
    c, _ = _mix(spark, items, [("a", 0.3, 1)], seed="other")
    assert a.keys() == b.keys() and len(a) in (60, 61) and a.keys() != c.keys()


def test_holding_rows(spark):
    meta = spark.createDataFrame([("1", "A", 1.0, 1), ("1", "b", 2.0, 2), ("1", "b", 2.0, 2), ("2", None, 5.0, 9), ("3", " B", None, 1), (None, "b", 1.0, 1)], "idx string, corpus string, dur_proc_s double, written_at int")
    reg = spark.createDataFrame([("a", True, 1), ("b", False, 1), ("b", True, 2), ("c", None, 3)], "name string, enabled boolean, registered_at int")
    assert sorted(map(tuple, enabled_clips(meta, reg).select("idx", "corpus", "dur_proc_s").collect())) == [("1", "b", 2.0), ("3", "b", None)]
