"""Evaluation texts leaking into a corpus: Wu-Manber search over words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klangsieb.functions.plain import plain_word_parts
from klangsieb.operators.ordered import only
from klangsieb.session import bound_batches, settle

#: Consecutive words that make a leak, words of a block, words of a lane.
RUN = 8
BLOCK = 2
LANE = 512
#: Bits of the tables that every task gets: one byte a slot, sixteen slots a pattern, up to 16 MB each.
LEAST_BITS, MOST_BITS = 12, 24
#: Words of documents searched at a time; words whose codes a task remembers.
SEARCHED = 1 << 20
KNOWN_WORDS = 500_000
#: Bytes of patterns that may be sent to all tasks for the comparison; more are shuffled.
SENT_BYTES = 8 << 20
_PARTS = 64


class Tables(NamedTuple):
    """What a search needs, however many patterns there are.

    ``shift`` says, by the hash of the last ``BLOCK`` words of a window, how
    far the window may move on: to the nearest place at which the block occurs
    in any pattern, or by its whole length if it occurs nowhere. Where that is
    0, ``bucket`` says by the hash of the whole window whether any pattern is
    there to compare with.
    """

    run: int
    bits: int
    shift: np.ndarray
    bucket: np.ndarray


def table_bits(patterns: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (16 * patterns).bit_length()))


def word_codes(words: list[str], known: dict[str, int]) -> np.ndarray:
    out = []
    for w in words:
        code = known.get(w)
        if code is None:
            code = known[w] = xxhash.xxh3_64_intdigest(w)
        out.append(code)
    return np.array(out, np.uint64)


def block_slots(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return (((a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)


def window_hashes(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = (h ^ rows[:, k]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(35)
    return h


def windows_of(codes: np.ndarray, run: int) -> np.ndarray:
    n = max(0, len(codes) - run + 1)
    return codes[np.arange(n)[:, None] + np.arange(run)[None, :]]


def search(tables: Tables, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the last word of every window that may be a pattern and lies within one of the lanes ``[starts, ends)``.

    All lanes move together: one step looks up the shift of the block that
    ends each lane's window and moves the window on.
    """
    live = np.flatnonzero(ends - starts >= tables.run)
    at, last = starts[live] + tables.run - 1, ends[live]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(at):
        move = tables.shift[block_slots(text[at - 1], text[at], tables.bits)]
        stop = at[move == 0]
        if len(stop):
            h = window_hashes(text[stop[:, None] + np.arange(1 - tables.run, 1)])
            there = tables.bucket[(h >> np.uint64(64 - tables.bits)).astype(np.int64)] > 0
            found.append((stop[there], h[there]))
        at = at + np.maximum(move, 1)
        on = at < last
        if not on.all():
            at, last = at[on], last[on]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


_PATTERN = "item bigint, hash bigint, words string"
_PATTERN_ARROW = pa.schema([("item", pa.int64()), ("hash", pa.int64()), ("words", pa.string())])
_ENTRY = "kind int, slot bigint, move int"
_ENTRY_ARROW = pa.schema([("kind", pa.int32()), ("slot", pa.int64()), ("move", pa.int32())])
_HIT_ARROW = pa.schema([("doc", pa.int64()), ("hash", pa.int64()), ("words", pa.string())])


def _patterns(passages: DataFrame, run: int) -> DataFrame:
    """(item, hash, words): all runs of ``run`` words of the test items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tail: list[str] = []
                for part in plain_word_parts(text):
                    words = tail + part
                    tail = words[1 - run :]
                    h = window_hashes(windows_of(word_codes(words, known), run)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(h), pa.int64()), pa.array(h), pa.array([" ".join(words[k : k + run]) for k in range(len(h))], pa.string())], schema=_PATTERN_ARROW)
                if len(known) > KNOWN_WORDS:
                    known.clear()

    return passages.mapInArrow(cut, _PATTERN).distinct()


def _tables(patterns: DataFrame, count: int, run: int) -> Tables:
    """The tables, made where the patterns are; their finished parts, a fixed number of bytes in all, are joined on the driver."""
    bits = table_bits(count)
    most = run - BLOCK + 1

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column(0).to_numpy().view(np.uint64)
            rows = np.concatenate([word_codes(w.split(" "), known) for w in b.column(1).to_pylist()]).reshape(-1, run)
            known.clear()
            slots = [(h >> np.uint64(64 - bits)).astype(np.int64), *(block_slots(rows[:, a], rows[:, a + 1], bits) for a in range(run - BLOCK + 1))]
            moves = [1, *(run - BLOCK - a for a in range(run - BLOCK + 1))]
            kinds = [1] + [0] * (run - BLOCK + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(x, np.int32), len(h))) if i != 1 else pa.array(np.concatenate(slots)) for i, x in enumerate((kinds, slots, moves))], schema=_ENTRY_ARROW)

    least = patterns.select("hash", "words").mapInArrow(entries, _ENTRY).groupBy("kind", "slot").agg(F.min("move").alias("move"))
    width = (1 << bits) // _PARTS

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, number = int(pdf["kind"].iat[0]), int(pdf["part"].iat[0])
        piece = np.full(width, 0 if kind else most, np.uint8)
        piece[pdf["slot"].to_numpy() - number * width] = pdf["move"].to_numpy()
        return pd.DataFrame({"kind": [kind], "part": [number], "piece": [piece.tobytes()]})

    done = least.withColumn("part", F.floor(F.col("slot") / width)).groupBy("kind", "part").applyInPandas(part, "kind int, part bigint, piece binary")
    shift, bucket = np.full(1 << bits, most, np.uint8), np.zeros(1 << bits, np.uint8)
    for r in done.toLocalIterator():
        (bucket if r["kind"] else shift)[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["piece"], np.uint8)
    return Tables(run, bits, shift, bucket)


def _windows(tables: Tables):
    """Candidates (doc, hash, words) of every text."""

    def flush(ids: list[int], texts: list[list[str]], codes: list[np.ndarray]) -> pa.RecordBatch:
        text = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        size = np.array([len(x) for x in codes], np.int64)
        first = np.cumsum(size) - size
        lanes = np.maximum(1, -(-size // LANE))
        doc = np.repeat(np.arange(len(codes)), lanes)
        start = first[doc] + LANE * (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        end = np.minimum(start + LANE + tables.run - 1, (first + size)[doc])
        at, h = search(tables, text, start, end)
        of = np.searchsorted(first + size, at, side="right")
        stop = (at - first[of] + 1).tolist()
        words = [" ".join(texts[d][s - tables.run : s]) for d, s in zip(of.tolist(), stop)]
        return pa.RecordBatch.from_arrays([pa.array([ids[d] for d in of.tolist()], pa.int64()), pa.array(h.view(np.int64)), pa.array(words, pa.string())], schema=_HIT_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        ids: list[int] = []
        texts: list[list[str]] = []
        codes: list[np.ndarray] = []
        held = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tail: list[str] = []
                for part in plain_word_parts(text):
                    words = tail + part
                    tail = words[1 - tables.run :]
                    ids.append(doc)
                    texts.append(words)
                    codes.append(word_codes(words, known))
                    held += len(words)
                    if held > SEARCHED:
                        yield flush(ids, texts, codes)
                        ids, texts, codes, held = [], [], [], 0
            if len(known) > KNOWN_WORDS:
                known.clear()
        yield flush(ids, texts, codes)

    return run


def leaks(documents: DataFrame, passages: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "text", run: int = RUN, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(doc, item, runs): the documents that hold ``run`` consecutive words of a test item, and how many such runs.

    Words are plain words. Items shorter than ``run`` words can't leak; null
    texts hold nothing; several passages or texts of one id count together; null ids
    are left out. The corpus is read once, whole texts however long. What every
    task gets are two tables of one byte a slot, sized by the number of
    patterns up to a fixed number of bytes; beyond that the windows move on by
    less, and more of them are compared. Windows that may be a pattern meet
    the patterns by their hash and are compared word by word; the patterns are
    sent to all tasks if they have at most ``sent_bytes``, else both are shuffled.
    """
    if not BLOCK <= run <= 250:
        raise ValueError("a run has 2 to 250 words")
    documents, passages = only(bound_batches(documents), doc, text), only(passages, item, passage)
    wanted = passages.where(F.col(item).isNotNull() & F.col(passage).isNotNull()).select(F.col(item).cast("bigint").alias("item"), F.col(passage).cast("string").alias("text"))
    docs = documents.where(F.col(doc).isNotNull()).select(F.col(doc).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"))
    patterns = settle(_patterns(wanted, run))
    size = patterns.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("words") + 16), F.lit(0)).alias("bytes")).first()
    windows = docs.mapInArrow(_windows(_tables(patterns, size["n"], run)), "doc bigint, hash bigint, words string")
    side = F.broadcast(patterns) if size["bytes"] <= sent_bytes else patterns.hint("merge")
    return windows.join(side, ["hash", "words"]).groupBy("doc", "item").agg(F.count("*").alias("runs"))
