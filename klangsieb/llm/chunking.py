"""Cutting oversized texts into balanced pieces at natural boundaries, with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klangsieb.operators.ordered import only
from klangsieb.session import bound_batches

LIMIT = 2048
OVERLAP = 128
#: A cut may move from its target by this part of the limit.
REACH = 0.25

# The kinds of boundaries, the strongest first. A cut comes after the match.
_SPACE = rb"(?:[ \t\r\n\x0b\x0c]|\xc2\xa0|\xe2\x80[\x80-\x8a\xa8\xa9]|\xe3\x80\x80)"
BOUNDARIES = (
    ("paragraph", re.compile(rb"\n[ \t\r]*\n\s*|\xe2\x80\xa9")),
    ("line", re.compile(rb"\r?\n\s*|\xe2\x80\xa8")),
    ("sentence", re.compile(rb"(?:[.!?]|\xe2\x80\xa6|\xe3\x80\x82)(?:[\"'\)\]]|\xc2[\xab\xbb]|\xe2\x80[\x98-\x9f\xb9\xba])*" + _SPACE + rb"+")),
    ("word", re.compile(_SPACE + rb"+")),
)
_WORD_START = re.compile(_SPACE + rb"+")


def on_character(data: bytes, at: int) -> int:
    """The nearest start of a character at or before ``at``."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def snap(data: bytes, target: int, low: int, high: int) -> tuple[int, str]:
    """The strongest boundary in ``[low, high]``, of these the nearest to ``target``; else the character before it."""
    window = data[low : min(high + 64, len(data))]
    for kind, pattern in BOUNDARIES:
        best = -1
        for m in pattern.finditer(window):
            at = low + m.end()
            if at > high:
                break
            if low < at < len(data) and (best < 0 or abs(at - target) < abs(best - target)):
                best = at
        if best >= 0:
            return best, kind
    at = on_character(data, min(max(target, low), high))
    return (at if at > low else on_character(data, high)), "character"


def overlap_start(data: bytes, cut: int, floor: int, overlap: int) -> int:
    """Where the piece after ``cut`` begins: at the first word start at most ``overlap`` bytes before it."""
    low = max(floor, cut - overlap)
    if low == 0 or low >= cut:
        return low
    m = _WORD_START.search(data, low - 1, cut)
    if m and m.end() < cut:
        return m.end()
    while low < cut and data[low] & 0xC0 == 0x80:
        low += 1
    return low


def cut_points(data: bytes, limit: int = LIMIT, overlap: int = OVERLAP, reach: float = REACH) -> list[tuple[int, int, int, str]]:
    """(start, new, end, boundary) of every piece: ``data[start:end]``, of which ``data[start:new]`` repeats the piece before.

    The least number of pieces is taken and equal targets are placed; each is
    snapped to the strongest boundary within reach that keeps the piece under
    the limit, or, where there is none in reach, to one anywhere the piece may
    end. What is left is dealt evenly to the pieces that are left. Where a
    limit fails, pieces are added, in doubling steps and then back by halves
    to the least number that holds.
    """
    n = len(data)
    if n <= limit:
        return [(0, 0, n, "end")]
    fails = max(2, -(-(n - overlap) // (limit - overlap))) - 1
    step, out = 1, None
    while out is None:
        holds = fails + step
        out = _try_cuts(data, holds, limit, overlap, int(limit * reach))
        if out is None:
            if holds > n:
                raise ValueError("no character fits into the limit")
            fails, step = holds, 2 * step
    while holds - fails > 1:
        middle = (holds + fails) // 2
        fewer = _try_cuts(data, middle, limit, overlap, int(limit * reach))
        if fewer is None:
            fails = middle
        else:
            holds, out = middle, fewer
    return out


def _try_cuts(data: bytes, pieces: int, limit: int, overlap: int, radius: int) -> list[tuple[int, int, int, str]] | None:
    """The cuts into so many pieces, or null where one would exceed the limit."""
    n = len(data)
    out: list[tuple[int, int, int, str]] = []
    start = new = 0
    for i in range(1, pieces):
        top = min(start + limit, n - 1)
        target = min(new + (n - new) // (pieces - i + 1), top)
        low, high = max(target - radius, new), min(target + radius, top)
        cut, kind = snap(data, target, low, high) if high > low else (new, "")
        if kind == "character" and (low > new or high < top):
            wide, wide_kind = snap(data, target, new, top)
            if wide_kind != "character":
                cut, kind = wide, wide_kind
        if cut <= new:  # nothing is left to cut: fewer pieces do, if the rest fits
            break
        out.append((start, new, cut, kind))
        start, new = overlap_start(data, cut, start, overlap), cut
    return [*out, (start, new, n, "end")] if n - start <= limit else None


_PIECE = "doc bigint, piece int, pieces int, start bigint, fresh bigint, size int, boundary string, text string"
_PIECE_ARROW = pa.schema([("doc", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("start", pa.int64()), ("fresh", pa.int64()), ("size", pa.int32()), ("boundary", pa.string()), ("text", pa.string())])


def cut_texts(documents: DataFrame, doc: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, reach: float = REACH) -> DataFrame:
    """Pieces in order: (doc, piece, pieces, start, fresh, size, boundary, text).

    Sizes and offsets are in tokens of the byte-level tokenizer, i.e. UTF-8
    bytes. ``text`` begins at ``start``, and what isn't in the piece before at
    ``fresh``; the texts from ``fresh`` on, joined, are the text again. A text
    within the limit is one piece, a null text one null piece of size 0.
    ``boundary`` names what each piece ends at; a character is never cut.
    Pieces start with at most ``overlap`` tokens of the piece before, from a
    word start where there is one. Repeated rows each give their pieces. A map
    without shuffle; a long text is cut in one go, each cut looking only at its
    surroundings. ``limit`` must be at least four times ``overlap``.
    """
    if limit < 16 or overlap < 0 or overlap * 4 > limit:
        raise ValueError("limit must be at least 16 and four times the overlap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t is None:
                    rows.append((d, 0, 1, 0, 0, 0, "end", None))
                    continue
                data = t.encode("utf-8")
                if len(data) <= limit:
                    rows.append((d, 0, 1, 0, 0, len(data), "end", t))
                else:
                    cuts = cut_points(data, limit, overlap, reach)
                    rows += [(d, i, len(cuts), s, f, e - s, kind, data[s:e].decode("utf-8")) for i, (s, f, e, kind) in enumerate(cuts)]
                held += len(data)
                if held > 8 << 20:
                    yield _rows(rows)
                    rows, held = [], 0
            yield _rows(rows)

    return only(bound_batches(documents), doc, text).select(F.col(doc).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(run, _PIECE)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(_PIECE_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PIECE_ARROW.types)], schema=_PIECE_ARROW)
