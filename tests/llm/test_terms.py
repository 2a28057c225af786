from __future__ import annotations

from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from klangsieb.functions.plain import plain_words
from klangsieb.llm import terms
from klangsieb.llm.terms import BurstTrie, choose_routes, mark_terms, route, term_counts


def _brute(texts):
    occ, rec = Counter(), Counter()
    for t in texts:
        w = plain_words(t)
        occ.update(w)
        rec.update(set(w))
    return {k: (occ[k], rec[k]) for k in occ}


def _run(spark, texts, **how):
    t, total = term_counts(spark.createDataFrame([(x,) for x in texts], "text string"), **how)
    return {r["term"]: (r["occurrences"], r["records"]) for r in t.collect()}, total.first()["n_records"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abß", max_size=5), st.integers(1, 9)), max_size=80), st.integers(1, 6))
def test_burst_trie_holds_every_count(entries, burst):
    trie, want = BurstTrie(burst), Counter()
    for term, n in entries:
        trie.add(term, n, 1)
        want[term] += n
    got = {p + r: trie.occurrences[k] for p, box in trie.containers() for r, k in box.items()}
    assert got == dict(want) and trie.size == len(want)
    assert [p for p, _ in trie.containers()] == sorted(p for p, _ in trie.containers())


def test_a_record_in_parts_counts_once():
    trie = BurstTrie(2)
    for record, words in [(0, ["a", "b", "a"]), (0, ["a", "cc"]), (1, ["a"]), (1, ["ab", "ac", "ad"])]:
        trie.count(words, record)
    got = {p + r: (trie.occurrences[k], trie.records[k]) for p, box in trie.containers() for r, k in box.items()}
    assert got == {"a": (4, 2), "b": (1, 1), "cc": (1, 1), "ab": (1, 1), "ac": (1, 1), "ad": (1, 1)}


def _boxes(spark, hand_overs):
    rows = [(w[: len(w) // 3], [w[len(w) // 3 :]]) for words in hand_overs for w in words]
    return spark.createDataFrame(rows, "prefix string, rest array<string>")


def test_no_subtree_is_heavier_than_it_may_be(spark):
    """However few terms each of many hand-overs has below a prefix, and however long the prefix."""
    shared = "donaudampfschifffahrtsgesellschaft"
    hand_overs = [[f"x{i}y{k}" for k in range(7)] for i in range(60)] + [[shared + str(100 * i + k) for k in range(3)] for i in range(50)] + [["immer"]] * 30
    splits, parts = choose_routes(_boxes(spark, hand_overs), 40)
    words = [w for h in hand_overs for w in h]
    groups = Counter(w[: route(w, splits)] for w in words)
    for prefix, n in groups.items():
        assert n / parts.get(prefix, 1) <= 40 or words.count(prefix) == n
    assert parts and all(len(p) == terms.DEPTH for p in parts)


def test_long_shared_prefixes_and_many_hand_overs(spark):
    shared = "donaudampfschifffahrtsgesellschaft"
    texts = [f"{shared}{i % 400} kurz{i % 7} {shared}" for i in range(900)]
    got, n = _run(spark, texts, held_terms=5, subtree_terms=50)
    assert got == _brute(texts) and n == 900


def test_counts_against_brute_force(spark):
    texts = ["Der Hund, der Hund!", None, "", "  ", "Gr&ouml;ße GRÖSSE größe", "co­op​era", "ä ä", "x" * 50, "Der Hund, der Hund!"] * 3
    got, n = _run(spark, texts)
    assert got == _brute(texts) and n == len(texts)


def test_small_limits_change_nothing(spark):
    texts = [f"wort{i % 97} wort{i % 13} zahl{i}" for i in range(600)]
    got, n = _run(spark, texts, held_terms=40, subtree_terms=10)
    assert got == _brute(texts) and n == 600


def test_long_text_and_one_term_everywhere(spark):
    texts = ["immer " * 400_000] + ["immer nie"] * 300
    got, _ = _run(spark, texts, long_text=1000)
    assert got == {"immer": (400_300, 301), "nie": (300, 300)}


def test_no_records(spark):
    assert _run(spark, []) == ({}, 0)
    assert _run(spark, [None]) == ({}, 1)


def test_marks(spark):
    texts = ["a b c"] * 4 + ["b"] * 6 + ["c"] + [None] * 29
    t, total = term_counts(spark.createDataFrame([(x, 1) for x in texts], "text string, term int"))
    marks = {r["term"]: r["mark"] for r in mark_terms(t, total).collect()}
    assert marks == {"a": None, "b": "common", "c": "common"}  # 4, 10 and 5 of 40 records
    t, total = term_counts(spark.createDataFrame([(x,) for x in ["a a a", "a", "b"]], "text string"))
    assert {r["term"]: r["mark"] for r in mark_terms(t, total).collect()} == {"a": "rare", "b": "rare"}
