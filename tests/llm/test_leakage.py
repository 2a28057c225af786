from __future__ import annotations

import random

import numpy as np
import pytest

from klangsieb.functions.plain import plain_words
from klangsieb.llm import leakage
from klangsieb.llm.leakage import MOST_BITS, leaks, table_bits


def _brute(docs, items, run=8):
    def grams(t):
        w = plain_words(t)
        return [tuple(w[i : i + run]) for i in range(len(w) - run + 1)]

    out = {}
    for i, p in items:
        want = set(grams(p))
        for d, t in docs:
            n = sum(g in want for g in grams(t))
            if n and d is not None and i is not None:
                out[d, i] = out.get((d, i), 0) + n
    return out


def _run(spark, docs, items, **how):
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item int")
    p = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc int")
    return {(r["doc"], r["item"]): r["runs"] for r in leaks(d, p, **how).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(leakage, "LANE", 16)
    monkeypatch.setattr(leakage, "SEARCHED", 500)
    rng = random.Random(seed)
    words = ["a", "b", "ü"] if seed == 0 else [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(25)]
    docs = []
    for d in range(80):
        t = rng.choices(words + ["fremd"], k=rng.randint(0, 90))
        if rng.random() < 0.6:
            w = items[rng.randrange(25)][1].split()
            n = rng.choice([7, 8, 9, 20])
            a = rng.randrange(max(1, len(w) - n + 1))
            at = rng.randint(0, len(t))
            t[at:at] = w[a : a + n]
        docs.append((d, " ".join(t)))
    if seed:
        assert any(n >= 1 for n in _brute(docs, items).values())
    got = _run(spark, docs, items)
    assert got.keys() == _brute(docs, items).keys()
    if seed:
        assert got == _brute(docs, items)


def test_forms_nulls_and_repeats(spark):
    p = "Die große Straße führt heute über sieben alte Brücken"
    docs = [(1, "x " + p.upper().replace("SS", "ß") + " y"), (2, None), (3, ""), (4, "die gro&szlig;e stra­sse, führt (heute) über sieben alte"), (5, "die große straße führt heute über sieben"), (None, p), (6, p), (6, p)]
    items = [(10, p), (11, None), (12, "zu kurz"), (None, p), (10, p)]
    assert _run(spark, docs, items) == {(1, 10): 2, (4, 10): 1, (6, 10): 4}


def test_shuffled_patterns_and_long_text(spark):
    rng = random.Random(9)
    items = [(i, " ".join(f"p{i}x{k}" for k in range(12))) for i in range(40)]
    filler = " ".join(rng.choices([f"f{k}" for k in range(500)], k=250_000))
    docs = [(1, filler + " " + items[7][1]), (2, items[3][1] + " " + filler[:100] + " " + items[39][1]), (3, filler)]
    want = _brute(docs, items)
    assert _run(spark, docs, items, sent_bytes=0) == want == _run(spark, docs, items)
    assert want.keys() == {(1, 7), (2, 3), (2, 39)}


def test_empty_tables(spark):
    assert _run(spark, [], [(1, "a b c d e f g h")]) == {} and _run(spark, [(1, "a b c d e f g h")], []) == {}


def test_tables_have_a_bound():
    assert [table_bits(n) for n in (0, 200, 1_000_000, 10**12)] == [12, 12, 24, MOST_BITS]


def test_shifts_skip_and_buckets_tell_apart(spark):
    p = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "b c d e f g h i")], "item long, text string")
    patterns = leakage._patterns(p, 8)
    assert patterns.count() == 3
    t = leakage._tables(patterns, 3, 8)
    assert t.shift.max() == 7 and t.shift.min() == 0 and t.bucket.sum() == 2 and (t.shift < 7).sum() <= 8
    codes = leakage.word_codes("x a b c d e f g h i b c d e f g h".split(), {})
    at, _ = leakage.search(t, codes, np.array([0]), np.array([len(codes)]))
    assert sorted(at.tolist()) == [8, 9]


def test_full_tables_miss_nothing(spark, monkeypatch):
    """With tables far too small for the patterns nearly every window is compared, and the answer is the same."""
    monkeypatch.setattr(leakage, "MOST_BITS", 7)
    monkeypatch.setattr(leakage, "LEAST_BITS", 7)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(100)]
    docs = [(d, " ".join(rng.choices(words, k=50) + items[d % 100][1].split()[5:20])) for d in range(150)]
    assert _run(spark, docs, items) == _brute(docs, items) != {}


@pytest.mark.parametrize("run", [2, 3, 20])
def test_other_lengths_of_a_leak(spark, run):
    docs, items = [(1, " ".join("abcdefghijklmnopqrstuvwxyz")), (2, "q r"), (3, "z")], [(7, " ".join("xbcdefghijklmnopqrstuvwx")), (8, "q r s")]
    assert _run(spark, docs, items, run=run) == _brute(docs, items, run)
