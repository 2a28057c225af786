from __future__ import annotations

import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from klangsieb.operators.malformed import Structure, accepted, blank, load_lines, parse_lines, rejects


def _fields(line: str) -> list[str] | None:
    """One character after the other: fields of a pipe line, or None where the quoting is broken."""
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            i, text = i + 1, ""
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        text, i = text + '"', i + 2
                        continue
                    break
                text, i = text + line[i], i + 1
            i += 1
            if i < len(line) and line[i] != "|":
                return None
        else:
            end = line.find("|", i)
            end = len(line) if end < 0 else end
            text, i = line[i:end], end
        out.append(text)
        if i >= len(line):
            return out
        i += 1


def _reason(kind: str, line: str | None) -> str | None | bool:
    """The reason by the letter of the rules; False for lines that give no row."""
    line = (line or "").removeprefix("\ufeff").strip(" \r")
    if not line.strip():
        return False
    odd = any(c == "\ufffd" or c < " " and c != "\t" for c in line)
    num = re.compile("[0-9]+([.][0-9]+)?")
    if kind == "listing":
        if "==" not in line:
            return "columns"
        path, text = line.split("==", 1)
        return "value" if odd or blank(text) or not re.fullmatch(r"wavs/\S+\.wav", path) else None
    if kind == "pipe":
        f = _fields(line)
        if f is None:
            return "quoting"
        if len(f) != 5:
            return "columns"
        bad = odd or blank(f[0]) or blank(f[2]) or blank(f[3]) or not num.fullmatch(f[1]) or float(f[1]) <= 0
        return "value" if bad or f[4] and not (num.fullmatch(f[4]) and float(f[4]) <= 1) else None
    f = line.split("\t")
    if len(f) != 5:
        return "columns"
    return "value" if odd or any(map(blank, f[:3])) or not all(re.fullmatch("[0-9]+", x) for x in f[3:]) else None


BITS = st.sampled_from(['"', '""', "|", "a", "1", "0.5", "==", "wavs/a.wav", "\t", " ", "&nbsp;", "\r", "\ufeff", "ß", "\ufffd", "\x07", "\n", " ", "|1|x|y|1", '|"b|c"', "wavs/a.wav|2.5|x|s|"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["listing", "pipe", "tsv"]), st.lists(BITS, max_size=12).map("".join)), max_size=12))
def test_reasons_against_a_plain_parser(rows):
    out = parse_lines(list(range(len(rows))), [k for k, _ in rows], [x for _, x in rows])
    got = dict(zip(out.column(0).to_pylist(), out.column(2).to_pylist()))
    want = {i: r for i, (k, x) in enumerate(rows) if (r := _reason(k, x)) is not False}
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(['"', "|", "a", "ß"]), max_size=14).map("".join), min_size=1, max_size=8))
def test_fields_against_a_plain_parser(lines):
    s = Structure([x.encode() for x in lines], 124, True)
    for i, line in enumerate(lines):
        want = _fields(line)
        assert s.unclosed[i] == (want is None)
        if want is not None:
            assert s.fields[i] == len(want)
            from klangsieb.operators.malformed import _unquote

            assert [_unquote(f) for f in s.row(i)] == want


def _run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "line_id long, file_kind string, line string, reason string, text string")
    return load_lines(df)


def test_rows_and_rejects(spark):
    rows = [
        (1, "listing", "wavs/a/b.wav==Ein Satz"), (2, "pipe", 'a.wav|1.5|"Er sagte ""ja"" | nein"|s1|'), (3, "tsv", "s\tp.mp3\tText\t3\t0"),
        (4, "pipe", 'a.wav|1.5|"offen|s1|1'), (5, "pipe", "a|b"), (6, "tsv", "s\tp\tText\t-1\t0"), (7, "other", "x"), (8, None, "x"), (9, "tsv", None), (10, "pipe", "  \r"), (None, "listing", "wavs/a.wav==x"),
        (1, "listing", "wavs/a/b.wav==Ein Satz"), (11, "tsv", "s\tp\tText\t" + "9" * 5000 + "\t000"),
    ]
    df = _run(spark, rows)
    bad = {r["line_id"]: r["reason"] for r in rejects(df).collect()}
    assert bad == {4: "quoting", 5: "columns", 6: "value", 7: "columns", 8: "columns"}
    good = sorted((r["line_id"] or 0, r["wav_rel"], r["text"], r["duration"], r["levenshtein"], r["up_votes"]) for r in accepted(df).collect())
    assert good[0][:3] == (0, "wavs/a.wav", "x") and good[1] == good[2] == (1, "wavs/a/b.wav", "Ein Satz", None, None, None)
    assert good[3] == (2, "a.wav", 'Er sagte "ja" | nein', 1.5, None, None) and good[4][5] == 3 and good[5][5] == 2**63 - 1


def test_no_lines(spark):
    assert _run(spark, []).collect() == []


@pytest.mark.parametrize("line", ["|" * 300_000, '"a"|' * 100_000, "x" * 3_000_000, '"' * 1_000_001])
def test_very_long_lines(spark, line):
    got = _run(spark, [(1, "pipe", line), (2, "pipe", "a.wav|1|b|c|1")]).select("line_id", "reason").collect()
    assert sorted((r[0], r[1]) for r in got) == [(1, _reason("pipe", line)), (2, None)]


def test_batches_are_bounded_by_bytes(spark):
    from klangsieb.session import bound_batches

    df = spark.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 2_000_000).alias("t"))
    size = bound_batches(df).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n bigint").collect()
    assert sum(r["n"] for r in size) == 64 and max(r["n"] for r in size) <= 20
