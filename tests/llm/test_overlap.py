from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from klangsieb.functions.edit import edit_distance
from klangsieb.functions.plain import plain_words
from klangsieb.llm.overlap import block_codes, expand, fingerprints, index_spans, meeting_pairs, near_same, probe_spans, sentences, text_name, word_codes


def _table(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
def test_edit_distance(a, b):
    assert edit_distance(a, b) == _table(a, b)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.data())
def test_no_near_pair_is_missed(base, data):
    """Any text within the allowed edits shares a block, inside the windows, and lies in the Hamming radius."""
    query = list(base)
    for _ in range(data.draw(st.integers(0, 13))):
        at, kind = data.draw(st.integers(0, len(query))), data.draw(st.sampled_from("idr"))
        if kind == "i":
            query.insert(at, data.draw(st.integers(0, 5)))
        elif query and kind == "d":
            query.pop(min(at, len(query) - 1))
        elif query:
            query[min(at, len(query) - 1)] = data.draw(st.integers(0, 5))
    k = edit_distance(query, base)
    if not query or 5 * k > max(len(query), len(base)):
        return
    words = [[str(x) for x in t] for t in (query, base)]
    qc, bc = (word_codes(w)[None] for w in words)
    spans = np.array(index_spans(len(base)), np.int64).T, np.array(probe_spans(len(query)), np.int64).T
    assert set(block_codes(qc, spans[1])[0].tolist()) & set(block_codes(bc, spans[0])[0].tolist())
    whole = [{(c, tuple(t[s : s + n])) for c, s, n in f(len(t))} for t, f in ((query, probe_spans), (base, index_spans))]
    assert whole[0] & whole[1]
    a, b = (fingerprints(c)[0].view(np.uint64) for c in (qc, bc))
    radius = 2 * k - abs(len(query) - len(base))
    assert sum(int(x).bit_count() for x in [np.bitwise_xor.reduce(a ^ b)]) <= radius
    if min(len(query), len(base)) > 32:
        assert sum(int(x).bit_count() for x in a ^ b) <= radius


def test_blocks_add_up_to_the_text():
    """A block's code depends on its words alone, and equals that of the same words in another order."""
    c = word_codes(list("xabcyybac"))[None]
    got = block_codes(c, np.array([[7, 7, 7, 8], [1, 6, 0, 1], [3, 3, 3, 3]]))[0]
    assert got[0] == got[1] and len(set(got.tolist())) == 3
    assert (fingerprints(c)[0] == fingerprints(c[:, ::-1].copy())[0]).all()


def test_probes_grow_with_the_text_and_no_faster():
    assert max(len(probe_spans(m)) / m for m in (5, 10, 16, 20, 33, 100, 1000, 3000)) < 10


def _rows(rng, n, words, prefix):
    out = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(1, 14))]
        out.append((f"{prefix}{i}", " ".join(t)))
    return out


def _brute(q, b):
    return {(i, j) for i, x in q for j, y in b if (u := plain_words(x)) and (v := plain_words(y)) and 5 * edit_distance(u, v) <= max(len(u), len(v))}


def _run(spark, q, b, **how):
    qd, bd = (spark.createDataFrame(x, "id string, text string, words int") for x in ([(*r, 1) for r in q], [(*r, 1) for r in b]))
    out = expand(*near_same(sentences(qd, "id", "text"), sentences(bd, "id", "text"), **how), copies=30).collect()
    pairs = [(r["query_id"], r["base_id"]) for r in out]
    return pairs


@pytest.mark.parametrize("hot", [4_000_000, 3])
def test_against_all_pairs(spark, hot):
    rng = random.Random(hot)
    words = [f"w{i}" for i in range(6)]
    base = _rows(rng, 250, words, "b") + [(f"same{i}", "w1 w2 w3 w4 w5 w1") for i in range(80)] + [("nul", None), ("blank", " … "), ("b0", "w9")]
    query = _rows(rng, 60, words, "q") + [("hit", "W1, w2 w3 w4 w5 w1!"), ("none", None), ("hit", "W1, w2 w3 w4 w5 w1!")]
    pairs = _run(spark, query, base, hot=hot)
    assert set(pairs) == _brute(query, base) and len(pairs) == len(set(pairs))
    assert sum(q == "hit" for q, _ in pairs) >= 80


def test_near_variants_and_long_texts(spark):
    rng = random.Random(5)
    words = [f"wort{i}" for i in range(4000)]
    base = [(f"b{i}", " ".join(rng.choices(words, k=n))) for i, n in enumerate([9, 10, 11, 40, 3000])]
    query = []
    for i, t in base:
        w = t.split()
        k = len(w) // 5
        query += [(f"{i}-in", " ".join(w[:-k] + ["x"] * k if k else w)), (f"{i}-out", " ".join(w[: len(w) - k - 1] + ["x"] * (k + 1)))]
        query += [(f"{i}-longer", " ".join(["vorn"] * (len(w) // 4) + w)), (f"{i}-shorter", " ".join(w[k:]))]
    assert set(_run(spark, query, base)) == _brute(query, base)


def test_empty_sides(spark):
    assert _run(spark, [], [("b", "a b")]) == [] and _run(spark, [("q", "a b")], []) == []


def test_of_the_lines_of_one_id_the_first_counts(spark):
    b = spark.createDataFrame([("x", 2, "a b c d e"), ("x", 1, "z y"), ("y", None, "z"), ("y", 9, "A b, c d e"), ("z", 1, None), ("z", 2, "a b c d e"), (None, 1, "a b c d e")], "id string, n int, text string")
    q = spark.createDataFrame([("q", "a b c d e")], "id string, text string")
    near = near_same(sentences(q, "id", "text"), sentences(b.where("id is not null"), "id", "text", first="n"))
    assert [tuple(r) for r in expand(*near).collect()] == [("q", "y", 0)]


def test_long_texts_with_common_sequences(spark):
    """100,000 texts of 40 to 200 words, two thirds of which are taken from 200 common sequences of four."""
    rng = np.random.default_rng(3)
    common = rng.integers(0, 3000, (200, 4))

    def text():
        n = int(rng.integers(40, 201))
        parts = [common[rng.integers(200)] if rng.random() < 0.67 else rng.integers(0, 30000, 4) for _ in range(-(-n // 4))]
        return np.concatenate(parts)[:n]

    base = [text() for _ in range(100_000)]
    queries = []
    for i in range(0, 100_000, 1000):
        t = base[i].copy()
        t[rng.choice(len(t), len(t) // 5, replace=False)] = 99_999
        queries.append(t)
    frame = lambda rows, p: spark.createDataFrame([(f"{p}{i}", " ".join(map(str, t))) for i, t in enumerate(rows)], "id string, text string")
    q, b = sentences(frame(queries, "q"), "id", "text"), sentences(frame(base, "b").repartition(8), "id", "text")
    met = meeting_pairs(q, b)
    assert met.count() < 2000
    pairs = {(r["query_id"], r["base_id"]) for r in expand(*near_same(q, b)).collect()}
    assert {(f"q{i}", f"b{1000 * i}") for i in range(100)} == pairs
    assert len(text_name(["a"])) == 16
