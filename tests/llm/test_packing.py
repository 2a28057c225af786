from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from klangsieb.llm.packing import best_fit, crossover, evolve, first_population, from_labels, pack, utilisation

CAP = 100


def _valid(c, sizes):
    assert sorted(i for b in c.bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) == f <= CAP for b, f in zip(c.bins, c.fills))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, CAP), min_size=1, max_size=60), st.integers(0, 1000))
def test_chromosomes_stay_valid(sizes, seed):
    rng = np.random.default_rng(seed)
    people = first_population(sizes, CAP, 3, 0, rng)
    for c in people:
        _valid(c, sizes)
        _valid(from_labels(c.labels(len(sizes)), sizes), sizes)
    _valid(crossover(people[1], people[2], sizes, CAP, rng), sizes)
    before = max(c.fitness(CAP) for c in people)
    people = evolve(people, sizes, CAP, 2, rng)
    for c in people:
        _valid(c, sizes)
    assert people[0].fitness(CAP) >= before


def test_search_beats_its_start():
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in rng.integers(20, 51, 300)]
    start = first_population(sizes, CAP, 3, 0, np.random.default_rng(1))
    bfd = best_fit(sorted(range(300), key=lambda i: -sizes[i]), sizes, CAP, [], [])
    end = evolve(start, sizes, CAP, 20, np.random.default_rng(1))
    assert len(end[0].bins) <= len(bfd.bins) and end[0].fitness(CAP) > bfd.fitness(CAP)


def _check(rows, items, cap):
    fill, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        fill[r["container"]] += r["size"]
        pieces[r["item"], r["divided"]].append((r["start"], r["size"], r["piece"]))
    assert max(fill.values(), default=0) <= cap
    want = defaultdict(int)
    for i, s in {(i, max(s or 0, 0)) for i, s in items}:
        want[i, s > cap] += max(s, 0)
    assert {k: sum(s for _, s, _ in v) for k, v in pieces.items()} == want
    return fill


def test_every_item_once_and_only_large_ones_divided(spark):
    rng = random.Random(4)
    items = [(i, rng.choice([3, 10, 33, 50, 51, 99, 100])) for i in range(900)] + [(9001, 101), (9002, 250), (9003, 300), (9004, 0), (9005, None), (9006, -4)]
    rows = pack(spark.createDataFrame(items, "item long, size long"), "item", "size", capacity=CAP, cell=150).collect()
    fill = _check(rows, items, CAP)
    big = sorted((r["start"], r["size"]) for r in rows if r["item"] == 9002)
    assert big == [(0, 100), (100, 100), (200, 50)] and {r["item"] for r in rows if r["divided"]} == {9001, 9002, 9003}
    total = sum(fill.values())
    assert len(fill) <= 1.03 * -(-total // CAP)


def test_one_size_for_a_third_and_repeats(spark):
    items = [(i, 60) for i in range(400)] + [(1000 + i, 1 + i % 40) for i in range(800)] + [(5, 60)] * 50 + [(7, 20)]
    rows = pack(spark.createDataFrame(items, "doc long, tokens long"), "doc", "tokens", capacity=CAP, cell=200).collect()
    _check(rows, set(items), CAP)
    assert sum(r["item"] == 5 for r in rows) == 1 and sum(r["item"] == 7 for r in rows) == 2


@pytest.mark.parametrize("items", [[], [(1, 0)], [(1, 350)], [(1, 100)]])
def test_smallest_inputs(spark, items):
    df = spark.createDataFrame([(*x, 1, 2) for x in items], "item long, size long, cell int, container int")
    rows = pack(df, "item", "size", capacity=CAP).collect()
    _check(rows, items, CAP)
    assert len(rows) == {0: 0, 1: 1}[len(items)] + (3 if items == [(1, 350)] else 0)
    u = utilisation(pack(df, "item", "size", capacity=CAP), CAP).first()
    assert u["containers"] == len({r["container"] for r in rows})


def test_same_rows_same_result(spark):
    df = spark.createDataFrame([(i, 1 + i * 37 % 90) for i in range(300)], "item long, size long")
    a, b = (sorted(map(tuple, pack(d, "item", "size", capacity=CAP).collect())) for d in (df, df.repartition(7)))
    assert a == b


def test_search_goes_on_until_it_gains_nothing(spark):
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in rng.integers(2048, 4097, 400)]  # two or three to a container: best fit leaves much room
    greedy = len(best_fit(sorted(range(400), key=lambda i: -sizes[i]), sizes, 8192, [], []).bins)
    rows = pack(spark.createDataFrame(list(enumerate(sizes)), "item long, size long"), "item", "size").collect()
    assert {r["item"]: r["size"] for r in rows} == dict(enumerate(sizes))
    assert len({r["container"] for r in rows}) <= 0.97 * greedy


def test_search_fills_all_containers_but_one():
    sizes = [int(x) for x in np.random.default_rng(2).integers(1, 60, 300)]
    start = first_population(sizes, CAP, 3, 1, np.random.default_rng(1))
    end = evolve(start, sizes, CAP, 5, np.random.default_rng(1))[0]
    _valid(end, sizes)
    assert sorted(end.fills)[1:] == [CAP] * (len(end.fills) - 1) and len(end.fills) == -(-sum(sizes) // CAP)
