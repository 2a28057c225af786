from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from klangsieb.llm.splitting import ALONE, allocate, balanced_splits, components, largest_differencing, split_report, star_contraction

SHARES = {"train": 0.9, "val": 0.05, "test": 0.05}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), min_size=1, max_size=4), min_size=1, max_size=40), st.integers(4, 9))
def test_differencing_keeps_every_weight(groups, bins):
    sums, to = largest_differencing([np.array(g, np.int64) for g in groups], bins)
    own = np.zeros(bins, np.int64)
    for g, t in zip(groups, to):
        assert len(set(t.tolist())) == len(t)  # bins of one partial partition stay apart
        for w, b in zip(g, t):
            own[b] += w
    assert own.tolist() == sums.tolist()


def test_differencing_is_even():
    rng = random.Random(1)
    sums, _ = largest_differencing([np.array([rng.randint(1, 100)]) for _ in range(2000)], 50)
    assert sums.max() - sums.min() <= 2
    assert largest_differencing([], 3)[0].tolist() == [0, 0, 0]


def test_allocation_follows_the_targets():
    out = allocate({b: 10 for b in range(200)}, SHARES)
    assert Counter(out.values()) == {"train": 180, "val": 10, "test": 10}


def _members(spark, rows):
    return spark.createDataFrame(rows, "item string, component string")


def test_whole_components_near_the_targets(spark):
    rng = random.Random(2)
    sizes = [rng.randint(1, 60) for _ in range(900)] + [9000]
    rows = [(f"{c}-{i}", f"c{c}") for c, n in enumerate(sizes) for i in range(n)]
    got = balanced_splits(_members(spark, rows), SHARES, bins=100, chunk=50).collect()  # 19 chunks, two levels of 32
    assert len(got) == 901 and sum(r["weight"] for r in got) == len(rows)
    n = Counter()
    for r in got:
        n[r["split"]] += r["weight"]
    for s, share in SHARES.items():
        assert abs(n[s] / len(rows) - share) < 0.012, n
    assert next(r for r in got if r["component"] == "c900")["split"] == "train"


def test_more_chunks_than_one_task_combines(spark):
    rows = [(str(i), f"c{i}") for i in range(700)]
    got = balanced_splits(_members(spark, rows), SHARES, bins=20, chunk=10).collect()
    n = Counter(r["split"] for r in got)
    assert len({r["component"] for r in got}) == len(got) == 700 and abs(n["val"] - 35) <= 5 and abs(n["test"] - 35) <= 5


def test_no_members(spark):
    assert balanced_splits(_members(spark, []), SHARES).collect() == []


def test_components_one_key(spark):
    df = spark.createDataFrame([("a", "s", 1), ("b", "s", 2), ("c", None, 3), (None, None, 4), ("a", "s", 1)], "idx string, speaker string, component int")
    got = sorted((r["item"] or "", r["component"]) for r in components(df, "idx", ["speaker"]).collect())
    assert got == [("", ALONE), ("a", "s"), ("a", "s"), ("b", "s"), ("c", f"{ALONE}c")]


def test_components_several_keys(spark):
    rng = random.Random(3)
    rows = [(str(i), f"a{rng.randint(0, 60)}" if rng.random() < 0.9 else None, f"b{rng.randint(0, 60)}" if rng.random() < 0.4 else None) for i in range(120)]
    rows += [(f"h{i}", "hot", None) for i in range(60)] + [("lone", None, None)]
    got = {r["item"]: r["component"] for r in components(spark.createDataFrame(rows, "item string, author string, source string"), "item", ["author", "source"]).collect()}
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a, b in rows:
        for v in (("a", a), ("b", b)):
            if v[1]:
                parent[find(v)] = find(("i", i))
    want, have = defaultdict(set), defaultdict(set)
    for i, _, _ in rows:
        want[find(("i", i))].add(i)
        have[got[i]].add(i)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_star_contraction_of_a_chain(spark):
    links = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z1", "z2"), ("z2", "z1")], "a string, b string")
    got = {r["node"]: r["root"] for r in star_contraction(links).collect()}
    assert len(got) == 63 and {v for k, v in got.items() if k[0] == "n"} == {"n000"} and got["z2"] == got["z1"] == "z1"


def test_report_of_present_splits(spark):
    members = _members(spark, [("a", "s"), ("b", "s"), ("c", "t"), ("d", "u")])
    present = spark.createDataFrame([("a", "train"), ("a", "train"), ("b", "val"), ("c", "train"), ("x", "test"), (None, "val")], "item string, split string")
    got = {r["component"]: (r["present"], r["n_present"]) for r in split_report(members, present, balanced_splits(members, SHARES)).collect()}
    assert got == {"s": (["train", "val"], 2), "t": (["train"], 1), "u": (None, 0)}
