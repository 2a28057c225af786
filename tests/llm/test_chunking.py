from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from klangsieb.llm.chunking import cut_points, cut_texts

PIECES = st.sampled_from(["a", "ß", "🎧", " ", "\n", "\n\n", ". ", "… ", "wort ", "langeswort", "\r\n", "́", "»ja.« "])


def _check(data, cuts, limit, overlap):
    assert b"".join(data[new:end] for _, new, end, _ in cuts) == data
    for k, (start, new, end, _) in enumerate(cuts):
        assert end - start <= limit and 0 <= new - start <= overlap
        data[start:end].decode("utf-8")
        assert k == 0 and start == new == 0 or new == cuts[k - 1][2] and start >= cuts[k - 1][0]


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECES, max_size=200), st.sampled_from([(40, 8), (64, 16), (64, 0), (16, 4)]))
def test_round_trip_and_limits(parts, how):
    data = "".join(parts).encode()
    _check(data, cut_points(data, *how), *how)


def test_balanced_and_at_the_strongest_boundary():
    para = ("Ein Satz mit acht Wörtern steht nun hier. " * 20).strip()
    data = "\n\n".join([para] * 9).encode()
    cuts = cut_points(data)
    _check(data, cuts, 2048, 128)
    assert {k for *_, k in cuts[:-1]} == {"paragraph"}
    sizes = [e - n for _, n, e, _ in cuts]
    assert sorted(e - n for _, n, e, _ in cuts)[0] >= 0.5 * max(sizes)
    one = ("wort " * 3000).encode()
    cuts = cut_points(one)
    assert len(cuts) == -(-(len(one) - 128) // 1920) and {k for *_, k in cuts[:-1]} == {"word"}


def test_no_boundary_and_tight_fit():
    for data in (b"x" * 5000, "ä".encode() * 5000, ("🎧" * 4001).encode(), b"x" * 2049, b"x" * (2048 + 1920), b"x" * (2048 + 1921)):
        cuts = cut_points(data)
        _check(data, cuts, 2048, 128)
        assert len(cuts) <= -(-(len(data) - 128) // 1920) + 1
    assert len(cut_points(b"x" * 2048)) == 1


def test_a_word_end_out_of_reach_is_better_than_none():
    data = (b"a" * 1200 + b" " + b"b" * 500) * 12
    cuts = cut_points(data)
    _check(data, cuts, 2048, 128)
    assert {k for *_, k in cuts[:-1]} == {"word"}


def test_a_huge_text_takes_few_rounds():
    rng = random.Random(1)
    data = " ".join("w" * rng.randint(1, 900) for _ in range(40_000)).encode()
    cuts = cut_points(data)
    _check(data, cuts, 2048, 128)
    assert len(cuts) <= 1.35 * len(data) / 1920


def _run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, piece int, boundary string")
    return cut_texts(df, **how).collect()


def test_operator(spark):
    rng = random.Random(0)
    texts = [" ".join(rng.choices(["Wörter", "und.", "mehr\n", "Absatz\n\n"], k=n)) for n in (0, 5, 400, 401, 5000)] + ["y" * 300_000]
    rows = list(enumerate(texts)) + [(99, None), (None, texts[2]), (2, texts[2])]
    got = _run(spark, rows)
    for d, t in enumerate(texts):
        mine = sorted({tuple(r) for r in got if r["doc"] == d}, key=lambda r: r[1])
        assert b"".join(r[7].encode()[r[4] - r[3] :] for r in mine).decode() == t
        assert {r[2] for r in mine} == {len(mine)} and all(r[5] == len(r[7].encode()) <= 2048 for r in mine)
        assert (len(mine) > 1) == (len(t.encode()) > 2048)
    assert [tuple(r) for r in got if r["doc"] == 99] == [(99, 0, 1, 0, 0, 0, "end", None)]
    assert sum(r["doc"] is None for r in got) > 1 and sum(r["doc"] == 2 for r in got) == 2 * sum(r["doc"] is None for r in got)
    assert _run(spark, []) == []
    with pytest.raises(ValueError):
        cut_texts(spark.createDataFrame([], "doc_id long, text string"), limit=100, overlap=50)
