"""Same or near-same records across splits by segmented similarity fingerprints within a Hamming radius."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from klangsieb.functions.edit import edit_distance
from klangsieb.functions.plain import plain_words
from klangsieb.operators.ordered import holding, only
from klangsieb.session import bound_batches, settle

#: Edits allowed, as a fraction of the words of the longer text: 1 / PART.
PART = 5
#: Words up to which texts are told apart by their exact size; beyond, by classes of a quarter more each.
EXACT = 16
#: Words up to which the folded fingerprint of 64 bits is compared, beyond it the whole one of 256.
NARROW = 32
#: Pairs of one block beyond which it is cut into parts, and the pairs that each part then has.
HOT_BLOCK = 4_000_000
#: Rows that may be sent to all tasks; what is larger is shuffled.
SENT_ROWS = 200_000
#: Copies of a text that one task spreads out.
SPREAD_COPIES = 20_000


def most_edits(n: int, part: int = PART) -> int:
    """Edits allowed between a text of ``n`` words and any text at most a fifth longer or shorter."""
    longest = n * part // (part - 1)  # the longest partner: its extra words are edits themselves
    return longest // part


def segments(n: int, part: int = PART) -> list[tuple[int, int]]:
    """(start, length) of the stretches of a text of ``n`` words: one more than the edits allowed, of even length."""
    count = min(most_edits(n, part) + 1, n)
    cuts = [i * n // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def size_class(n: int) -> int:
    return n if n <= EXACT else EXACT + 1 + int(math.log(n / (EXACT + 1)) / math.log(1.25))


def index_spans(n: int, part: int = PART) -> list[tuple[int, int, int]]:
    """(size class, start, length) of the blocks that a text of ``n`` words is indexed by."""
    return [(size_class(n), s, k) for s, k in segments(n, part)]


def probe_spans(m: int, part: int = PART) -> list[tuple[int, int, int]]:
    """(size class, start, length) of every stretch of a text of ``m`` words that may equal a partner's block.

    If a text of ``n`` words is within ``k`` edits of this one, one of its
    ``k + 1`` blocks occurs here unchanged. The first such block has at most
    as many edits before it as there are blocks before it, and the rest of the
    edits after it, which bounds how far it may have moved where ``n`` is told
    apart exactly. For larger texts every stretch of a block's length is
    probed in the few classes that partners may have, so that the probes grow
    in proportion to the text.
    """
    out: set[tuple[int, int, int]] = set()
    wide: dict[int, set[int]] = {}
    for n in range(max(1, -(-m * (part - 1) // part)), m * part // (part - 1) + 1):
        blocks = segments(n, part)
        k, shift = min(len(blocks) - 1, max(m, n) // part), m - n
        if n > EXACT:
            wide.setdefault(size_class(n), set()).update(length for _, length in blocks)
            continue
        for i, (start, length) in enumerate(blocks):
            first = max(0, start - min(i, k), start + shift - (k - min(i, k)))
            last = min(m - length, start + min(i, k), start + shift + (k - min(i, k)))
            out.update((n, s, length) for s in range(first, last + 1))
    for size, lengths in wide.items():
        out.update((size, s, length) for length in lengths for s in range(m - length + 1))
    return sorted(out)


def word_codes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def fingerprints(codes: np.ndarray) -> np.ndarray:
    """Similarity fingerprints of texts of equal length, 256 bits in four numbers a row: the parity, per bit, of the words whose code picks that bit.

    Order plays no part. One edit changes at most two bits (it takes a word
    out, puts one in, or both), so texts within ``k`` edits that differ by
    ``d`` in length are within a Hamming radius of ``2 * k - d``, always.
    Fingerprints add up: that of a text is the exclusive or of those of its
    stretches, and folding it keeps the radius.
    """
    rows, n = codes.shape
    at = (np.arange(rows)[:, None] * 256 + (codes & np.uint64(255)).astype(np.int64)).ravel()
    odd = np.bincount(at, minlength=rows * 256).reshape(rows, 256) & 1
    wide = np.packbits(odd.astype(np.uint8), axis=1).view(">i8").astype(np.int64)
    if n <= NARROW:
        wide[:, 0] = np.bitwise_xor.reduce(wide, axis=1)
        wide[:, 1:] = 0
    return wide


def block_codes(codes: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Keys of the blocks ``spans`` (class, start, length) of texts of equal length, one row a text.

    A block is the part of the fingerprint that a stretch of words makes up: a
    code with one bit for each word of the language, set where the word occurs
    an odd number of times. Such a code is nearly all zeros, so it is held as
    the exclusive or of its words' digests, which adds up as the codes do;
    class and length are mixed in.
    """
    total = np.concatenate([np.zeros((len(codes), 1), np.uint64), np.bitwise_xor.accumulate(codes, axis=1)], axis=1)
    size, start, length = spans
    mark = (size.astype(np.uint64) << np.uint64(32)) + length.astype(np.uint64) + np.uint64(1)
    out = (total[:, start + length] ^ total[:, start]) + mark * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return (out * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _whole(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType(), False) for n in names]


# No column may be null, so that Spark adds no filters for nulls, which would keep it from reusing shuffles.
_BLOCKS = T.StructType([*_whole("block", "key"), T.StructField("n", T.IntegerType(), False), T.StructField("at", T.IntegerType(), False), *_whole("f0", "f1", "f2", "f3")])
_BLOCKS_ARROW = pa.schema([("block", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), *[(f"f{i}", pa.int64()) for i in range(4)]])
_NAMED = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("mark", T.LongType()), *_whole("key"), T.StructField("name", T.BinaryType(), False)])
_EDITS = "query binary, match binary, edits int"
_EDITS_ARROW = pa.schema([("query", pa.binary()), ("match", pa.binary()), ("edits", pa.int32())])
#: Blocks made at a time.
_HELD_BLOCKS = 400_000


def text_name(words: Sequence[str]) -> bytes:
    """A text's name: a hash of 128 bits of its words, whose first half is its key."""
    return xxhash.xxh3_128_digest(" ".join(words))


def _keys(names: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(names), np.int64)[::2]


def sentences(df: DataFrame, item: str, text: str, first: str | None = None) -> DataFrame:
    """(id, text) of the rows to compare. With ``first``, of the rows of one id that with the least value there is the one that counts."""
    cols = [F.col(item).cast("string").alias("id"), F.col(text).cast("string").alias("text")]
    if first:
        return only(bound_batches(df), item, text, first).select(*cols, F.col(first).cast("bigint").alias("line"))
    return only(bound_batches(df), item, text).select(*cols)


def with_names(texts: DataFrame) -> DataFrame:
    """(id, text, mark, key, name) of ``sentences``; texts without plain words are left out, as they have no sentence to share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [plain_words(t) for t in b.column(1).to_pylist()]
            names = [text_name(w) for w in words if w]
            cols = [c.filter(pa.array([bool(w) for w in words], pa.bool_())) for c in b.columns]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(_keys(names)), pa.array(names, pa.binary())], names=_NAMED.names)

    return texts.select("id", "text", F.xxhash64("text").alias("mark")).mapInArrow(run, _NAMED)


def _blocks(texts: DataFrame, probing: bool, part: int) -> DataFrame:
    """The blocks of every text (or all stretches that may equal one), with its size and fingerprint.

    Equal texts of a batch give their blocks once. Texts of one length are
    worked on together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        spans: dict[int, np.ndarray] = {}
        for b in batches:
            same_size: dict[int, dict[tuple[str, ...], None]] = {}
            for t in b.column(0).to_pylist():
                words = tuple(plain_words(t))
                if words:
                    same_size.setdefault(len(words), {})[words] = None
            if len(known) > 500_000:
                known.clear()
            for n, group in same_size.items():
                if n not in spans:
                    if len(spans) > 500:
                        spans.clear()
                    spans[n] = np.array((probe_spans if probing else index_spans)(n, part), np.int64).T
                rows = list(group)
                step = max(1, _HELD_BLOCKS // max(n, spans[n].shape[1]))
                for a in range(0, len(rows), step):
                    yield _block_rows(rows[a : a + step], n, spans[n], known)

    return texts.select("text").mapInArrow(run, _BLOCKS)


def _block_rows(rows: list[tuple[str, ...]], n: int, spans: np.ndarray, known: dict[str, int]) -> pa.RecordBatch:
    flat: list[int] = []
    for words in rows:
        for w in words:
            code = known.get(w)
            if code is None:
                code = known[w] = xxhash.xxh3_64_intdigest(w)
            flat.append(code)
    codes = np.array(flat, np.uint64).reshape(len(rows), n)
    keys = _keys([text_name(w) for w in rows])
    prints, blocks = fingerprints(codes), block_codes(codes, spans)
    times = spans.shape[1]
    cols = [blocks.ravel(), np.repeat(keys, times), np.full(blocks.size, n, np.int32), np.tile(spans[1].astype(np.int32), len(rows)), *(np.repeat(prints[:, i], times) for i in range(4))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_BLOCKS_ARROW)


def _all(conditions: list[Column]) -> Column:
    return reduce(and_, conditions)


def _within_radius(part: int) -> Column:
    """Sizes, places and fingerprints of the rows ``a`` and ``b`` allow for a near-same pair."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    longest, apart = F.greatest(a("n"), b("n")), F.abs(a("n") - b("n"))
    edits = F.floor(longest / F.lit(part)).cast("int")
    differ = [a(f"f{i}").bitwiseXOR(b(f"f{i}")) for i in range(4)]
    narrow = F.bit_count(reduce(lambda x, y: x.bitwiseXOR(y), differ))
    wide = reduce(lambda x, y: x + y, [F.bit_count(d) for d in differ])
    bits = F.when(F.least(a("n"), b("n")) > NARROW, wide).otherwise(narrow)
    return _all([apart <= edits, F.abs(a("at") - b("at")) <= edits, bits <= 2 * edits - apart])


def meeting_pairs(queries: DataFrame, base: DataFrame, part: int = PART, hot: int = HOT_BLOCK) -> DataFrame:
    """(query, match): keys of the texts of ``sentences`` that share a block and lie in the Hamming radius.

    Both sides are shuffled once, by block, and their rows are counted and
    joined in that partitioning. Blocks with more than ``hot`` pairs are cut
    into parts, however many they are: each row of the side that has more of
    them goes to one part, each of the other to all.
    """
    kept = _BLOCKS.names
    probes, index = (_blocks(t, probing, part).repartition("block").distinct() for t, probing in ((queries, True), (base, False)))
    asked, there = probes.groupBy("block").agg(F.count("*").alias("asked")), index.groupBy("block").agg(F.count("*").alias("there"))
    counts = asked.hint("shuffle_hash").join(there, "block")
    parts = F.ceil(F.col("asked").cast("double") * F.col("there") / hot).cast("int")
    # an exchange of its own, so that Spark counts once and reuses the few rows
    crowded = counts.select("block", parts.alias("parts"), (F.col("asked") > F.col("there")).alias("more_asked")).where("parts > 1").repartition("block", "parts")
    near = _within_radius(part)

    def met(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        joined = a.hint("merge").alias("a").join(b.hint("merge").alias("b"), _all([F.col(f"a.{c}") == F.col(f"b.{c}") for c in on] + [near]))
        return joined.select(F.col("a.key").alias("query"), F.col("b.key").alias("match"))

    def cut(df: DataFrame, larger: Column) -> DataFrame:
        one = F.array(F.pmod(F.xxhash64("key", "at"), F.col("parts")).cast("int"))
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        return df.join(crowded.hint("shuffle_hash"), "block").select(*kept, F.explode(F.when(larger, one).otherwise(every)).alias("cut"))

    plain = [x.join(crowded.select("block").hint("shuffle_hash"), "block", "left_anti") for x in (probes, index)]
    split = [cut(probes, F.col("more_asked")), cut(index, ~F.col("more_asked"))]
    return met(*plain, ["block"]).unionByName(met(*split, ["block", "cut"])).distinct()


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """To all tasks if it has few rows, else shuffled. What Python puts out can't be estimated by Spark, so one of the two is always said."""
    return F.broadcast(df) if rows <= SENT_ROWS else df.hint("merge")


def _verify(pairs: DataFrame, part: int) -> DataFrame:
    """Pairs whose edit distance, in words, is at most the allowed part of the longer text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[bytes, bytes, int]] = []
            for q, m, x, y in zip(*(c.to_pylist() for c in b.columns)):
                x, y = plain_words(x), plain_words(y)
                edits = edit_distance(x, y)
                if edits * part <= max(len(x), len(y)):
                    out.append((q, m, edits))
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(_EDITS_ARROW.names)}, schema=_EDITS_ARROW)

    return pairs.select("query", "match", "x", "y").mapInArrow(run, _EDITS)


def _found(texts: DataFrame, keys: DataFrame, rows: int) -> DataFrame:
    """(id, key, name, text) of the rows that have one of the ``keys`` and count for their id."""
    found = settle(with_names(texts).join(_sent(keys, rows), "key", "left_semi"))
    if "line" not in texts.columns:
        return found
    ids = found.select("id").distinct()
    lines = texts.select("id", "line", F.xxhash64("text").alias("mark")).join(_sent(ids, ids.count()), "id", "left_semi")
    return found.join(holding(lines, "id", first="line", keep=["mark"]).hint("merge"), ["id", "mark"], "left_semi")


def near_same(queries: DataFrame, base: DataFrame, part: int = PART, hot: int = HOT_BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of (query, base) texts that differ in at most ``1 / part`` of the words of the longer one.

    Both inputs come from ``sentences``. Returns ``(pairs, query_members,
    base_members)``: pairs (query, match, edits) between distinct texts, and
    (id, name) for the rows that have each of these texts, so that copies
    aren't paired with each other here. Null and wordless texts pair with
    nothing; an empty side gives no pairs.

    A text's similarity fingerprint is cut into blocks, one more than edits
    are allowed, each made up by a stretch of its words. A near-same query has
    one of these blocks in one of its own stretches (``probe_spans``), so
    joining blocks misses nothing. Pairs that meet in a block must have sizes,
    places and whole fingerprints within the radius that the edits allow,
    tested inside the join; what is left is verified word by word. Texts are
    never shuffled: those that met are picked out of the inputs again.
    """
    met = settle(meeting_pairs(queries, base, part, hot))
    n = met.count()
    q_found, b_found = (_found(t, met.select(F.col(side).alias("key")).distinct(), n) for t, side in ((queries, "query"), (base, "match")))
    x, y = (f.dropDuplicates(["key", "name"]).select(F.col("key").alias(f"{side}_key"), F.col("name").alias(side), F.col("text").alias(c)).hint("merge") for f, side, c in ((q_found, "query", "x"), (b_found, "match", "y")))
    keyed = met.toDF("query_key", "match_key").hint("merge").join(x, "query_key").hint("merge").join(y, "match_key")
    return _verify(keyed, part), *(f.select("id", "name").distinct() for f in (q_found, b_found))


def expand(pairs: DataFrame, query_members: DataFrame, base_members: DataFrame, copies: int = SPREAD_COPIES) -> DataFrame:
    """(query id, base id, edits) of all rows. A text with many copies on either side is spread over as many tasks as it needs for ``copies`` each."""

    def parts(members: DataFrame, side: str) -> DataFrame:
        return members.groupBy(F.col("name").alias(side)).agg(F.ceil(F.count("*") / copies).cast("int").alias(f"{side}_parts"))

    def rows(members: DataFrame, side: str, out: str) -> DataFrame:
        split = members.withColumnRenamed("name", side).join(parts(members, side).hint("merge"), side)
        return split.select(side, F.pmod(F.xxhash64("id"), F.col(f"{side}_parts")).cast("int").alias(f"{side}_part"), F.col("id").alias(out))

    def spread(df: DataFrame, members: DataFrame, side: str) -> DataFrame:
        return df.join(parts(members, side).hint("merge"), side).withColumn(f"{side}_part", F.explode(F.sequence(F.lit(0), F.col(f"{side}_parts") - 1))).drop(f"{side}_parts")

    near = spread(spread(pairs, query_members, "query"), base_members, "match")
    near = near.join(rows(query_members, "query", "query_id").hint("merge"), ["query", "query_part"])
    return near.join(rows(base_members, "match", "base_id").hint("merge"), ["match", "match_part"]).select("query_id", "base_id", "edits")
