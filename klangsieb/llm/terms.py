"""Frequency of every distinct term by burst tries that workers fill and merge."""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klangsieb.functions.plain import plain_word_parts
from klangsieb.operators.ordered import only
from klangsieb.session import bound_batches, settle

#: A container bursts beyond this many terms; a worker hands over its trie beyond the second number.
BURST = 512
HELD_TERMS = 200_000
#: Terms that a merged subtree should hold, and the most subtrees there may be.
SUBTREE_TERMS = 20_000
MOST_SUBTREES = 16_384
#: Length of a prefix beyond which a heavy subtree is parted by a hash of its terms.
DEPTH = 24
#: Characters of a text that are taken apart at once.
LONG_TEXT = 1 << 20


class BurstTrie:
    """Counters by term: inner nodes branch by one character, containers hold the rest of the terms.

    A node is a dict. An inner node maps a character (or '' for a term that
    ends here) to a node; a container maps the rest of a term to its slot and
    turns into an inner node when it exceeds ``burst`` terms. The counters of
    a slot lie in arrays of numbers, eight bytes each.
    """

    __slots__ = ("_last", "burst", "inner", "occurrences", "records", "root")

    def __init__(self, burst: int = BURST) -> None:
        self.burst = burst
        self.root: dict = {}
        self.inner: set[int] = set()  # ids of inner nodes, all of which the trie keeps alive
        self.occurrences, self.records, self._last = array("q"), array("q"), array("q")

    @property
    def size(self) -> int:
        return len(self.occurrences)

    def slot(self, term: str) -> int:
        node, depth, inner = self.root, 0, self.inner
        while id(node) in inner:
            char = term[depth : depth + 1]
            child = node.get(char)
            if child is None:
                child = node[char] = {}
            node, depth = child, depth + 1
            if not char:
                break
        rest = term[depth:]
        have = node.get(rest)
        if have is None:
            have = node[rest] = len(self.occurrences)
            for counter in (self.occurrences, self.records):
                counter.append(0)
            self._last.append(-1)
            if len(node) > self.burst:
                self._split(node)
        return have

    def add(self, term: str, occurrences: int, records: int) -> None:
        at = self.slot(term)
        self.occurrences[at] += occurrences
        self.records[at] += records

    def count(self, words: list[str], record: int) -> None:
        """Count words of one record, which may come in several parts."""
        slot, occurrences, records, last = self.slot, self.occurrences, self.records, self._last
        for w in words:
            at = slot(w)
            occurrences[at] += 1
            if last[at] != record:
                last[at] = record
                records[at] += 1

    def _split(self, node: dict) -> None:
        old = list(node.items())
        node.clear()
        self.inner.add(id(node))
        for rest, at in old:
            node.setdefault(rest[:1], {})[rest[1:]] = at
        for child in node.values():
            if len(child) > self.burst:
                self._split(child)

    def containers(self) -> Iterator[tuple[str, dict[str, int]]]:
        """(prefix, container), in the order of the prefixes."""
        todo: list[tuple[str, dict]] = [("", self.root)]
        while todo:
            prefix, node = todo.pop()
            if id(node) in self.inner:
                todo += [(prefix + c, node[c]) for c in sorted(node, reverse=True)]
            elif node:
                yield prefix, node


_PACKED = pa.schema([("kind", pa.string()), ("prefix", pa.string()), ("n", pa.int64()), ("rest", pa.list_(pa.string())), ("occurrences", pa.list_(pa.int64())), ("records", pa.list_(pa.int64()))])
_PACKED_SQL = "kind string, prefix string, n bigint, rest array<string>, occurrences array<bigint>, records array<bigint>"
_MERGED_SQL = "term string, occurrences bigint, records bigint"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: [r[i] for r in rows] for i, name in enumerate(_PACKED.names)}, schema=_PACKED)


def _hand_over(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
    """The containers of a trie as packed rows."""
    rows, held = [], 0
    for prefix, box in trie.containers():
        rest = sorted(box)
        at = [box[r] for r in rest]
        rows.append(("box", prefix, len(rest), rest, [trie.occurrences[k] for k in at], [trie.records[k] for k in at]))
        held += len(rest)
        if held > 50_000:
            yield _batch(rows)
            rows, held = [], 0
    yield _batch(rows)


def _count(held_terms: int, long_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, records = BurstTrie(), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                records += 1
                for words in plain_word_parts(text, long_text):
                    trie.count(words, records)
                if trie.size > held_terms:
                    yield from _hand_over(trie)
                    trie = BurstTrie()
        if trie.size:
            yield from _hand_over(trie)
        yield _batch([("total", "", records, None, None, None)])

    return run


def choose_routes(boxes: DataFrame, most: float) -> tuple[frozenset[str], dict[str, int]]:
    """The prefixes that all workers route by, chosen by the number of entries below them.

    Returns ``(splits, parts)``: a prefix with more than ``most`` entries is
    split by its next character, two lengths at a time for as long as there
    are such prefixes; at most entries / most of them per length reach the
    driver. Where a prefix of ``DEPTH`` characters is still too heavy, its
    terms are dealt by hash into as many ``parts`` as it needs.
    """
    splits, heavy, depth = {""}, [""], 0
    terms = boxes.select(F.explode(F.transform("rest", lambda r: F.concat("prefix", r))).alias("term"))
    weights: dict[str, int] = {}
    while heavy and depth < DEPTH:
        length = F.explode(F.array(F.lit(depth + 1), F.lit(depth + 2))).alias("d")
        above = terms.sparkSession.createDataFrame([(h,) for h in heavy], "above string")
        below = terms.join(F.broadcast(above), F.substring("term", 1, depth) == F.col("above"), "left_semi") if depth else terms
        rows = below.select("term", length).where(F.length("term") >= F.col("d"))
        counted = rows.groupBy(F.expr("substring(term, 1, d)").alias("p")).agg(F.count("*").alias("n")).where(F.col("n") > most).collect()
        weights = {r["p"]: r["n"] for r in counted}
        splits.update(weights)
        depth += 2
        heavy = [p for p in weights if len(p) == depth]
    deep = {p: math.ceil(weights[p] / most) for p in heavy}
    return frozenset(splits - set(deep)), deep


def route(term: str, splits: frozenset[str]) -> int:
    """Length of the prefix that a term is routed by: one character beyond the splits that it follows."""
    depth = 0
    while depth < len(term) and term[:depth] in splits:
        depth += 1
    return depth


def term_counts(records: DataFrame, text: str = "text", held_terms: int = HELD_TERMS, subtree_terms: int = SUBTREE_TERMS, long_text: int = LONG_TEXT) -> tuple[DataFrame, DataFrame]:
    """How often every plain word occurs and in how many records; one input row is one record.

    Returns ``(terms, total)``: ``terms`` with (term, occurrences, records),
    ``total`` with one row ``n_records``. Records with null or blank text count
    as records without terms; no row gives no terms and 0 records.

    Every task counts in a burst trie and hands over its containers, packed.
    From the number of entries below each prefix the common routing prefixes
    are chosen (``choose_routes``), so that a merged subtree has about
    ``subtree_terms`` entries however the terms crowd. Containers are cut along
    those prefixes, shuffled by prefix, and matching subtrees are merged.
    A term that occurs in all records is one entry per trie handed over.
    """
    packed = settle(only(bound_batches(records), text).select(F.col(text).cast("string").alias("text")).mapInArrow(_count(held_terms, long_text), _PACKED_SQL))
    total = packed.where("kind = 'total'").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_records"))
    boxes = packed.where("kind = 'box'")
    entries = boxes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    most = max(subtree_terms, entries / MOST_SUBTREES)
    splits, parts_of = choose_routes(boxes, most)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for prefix, rest, occ, rec in zip(*(b.column(i).to_pylist() for i in range(4))):
                groups: dict[tuple[str, int], tuple[list, list, list]] = {}
                for r, o, k in zip(rest, occ, rec):
                    term = prefix + r
                    d = route(term, splits)
                    p = term[:d]
                    group = groups.setdefault((p, zlib.crc32(term.encode("utf-8", "surrogatepass")) % parts_of.get(p, 1)), ([], [], []))
                    group[0].append(term[d:])
                    group[1].append(o)
                    group[2].append(k)
                out += [("box", p, part, *x) for (p, part), x in groups.items()]
            yield _batch(out)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        subtree, prefix = BurstTrie(), pdf["prefix"].iat[0]
        for rest, occ, rec in zip(pdf["rest"], pdf["occurrences"], pdf["records"]):
            for r, o, k in zip(rest, occ.tolist(), rec.tolist()):
                subtree.add(r, o, k)
        out = [(prefix + p + r, subtree.occurrences[box[r]], subtree.records[box[r]]) for p, box in subtree.containers() for r in sorted(box)]
        return pd.DataFrame(out, columns=["term", "occurrences", "records"])

    routed = boxes.select("prefix", "rest", "occurrences", "records").mapInArrow(cut, _PACKED_SQL)
    terms = routed.select("prefix", F.col("n").alias("part"), "rest", "occurrences", "records").groupBy("prefix", "part").applyInPandas(merge, _MERGED_SQL)
    return terms, total


def mark_terms(terms: DataFrame, total: DataFrame, rare_below: int = 3, common_above: str = "0.1") -> DataFrame:
    """Adds ``mark``: ``rare`` in fewer than ``rare_below`` records, ``common`` in more than that share of all, else null.

    In collections so small that a term is both, it is rare. The share is a
    decimal string, so that the limit is exact.
    """
    common = F.col("records") > F.col("n_records") * F.lit(common_above).cast("decimal(18,9)")
    mark = F.when(F.col("records") < rare_below, "rare").when(common, "common")
    return terms.crossJoin(F.broadcast(total)).withColumn("mark", mark)  # one row
