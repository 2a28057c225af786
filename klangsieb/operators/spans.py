"""Spans in time: islands, bounded merges, tumbling windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from klangsieb.operators.ordered import STRETCH, position, running_sum, stretches


def islands(df: DataFrame, key: str, order: str, on: Column, least: int = 1) -> DataFrame:
    """Runs of consecutive rows (per key, in ``order``) in which ``on`` holds: (key, first, last, length).

    A row's place among all rows less its place among those that hold is the
    same throughout a run. Both places are prefix sums, so a hot key is shared
    among tasks. ``order`` must be unique within a key; a null ``on`` counts
    as not holding.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.coalesce(on, F.lit(False)).alias("_on"))
    held = running_sum(rows, F.col("_on").cast("bigint"), [F.col("_o")], by=["_k"], out="_m")
    held = position(held, [F.col("_o")], by=["_k"], out="_n").where("_on")
    runs = held.groupBy("_k", (F.col("_n") - F.col("_m")).alias("_island"))
    out = runs.agg(F.min("_o").alias("first"), F.max("_o").alias("last"), F.count("*").alias("length"))
    return out.where(F.col("length") >= least).select(F.col("_k").alias(key), "first", "last", "length")


def merge_spans(spans: Column, gap: float, longest: float) -> Column:
    """``merge_near`` for the short array of spans of one row: spans, in order, joined to the one before if the gap is below ``gap`` and the whole isn't over ``longest``.

    ``spans``: array of (start, end) structs; each joining depends on the
    one before, so this is a fold over the array.
    """
    start = F.array().cast("array<struct<start:double,end:double>>")

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (x["start"] - F.try_element_at(done, F.lit(-1))["end"] < gap) & (x["end"] - F.try_element_at(done, F.lit(-1))["start"] <= longest)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), x["end"].alias("end"))))
        return F.when(joins, joined).otherwise(F.concat(done, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))))

    return F.aggregate(F.array_sort(spans), start, step)


def split_at_gaps(df: DataFrame, key: str, start: str, end: str, gap: float, size: int = STRETCH) -> DataFrame:
    """Adds ``block``: spans of a key that are nearer than ``gap`` to the one before share it.

    Merging never crosses a block. The look back goes over stretches of a
    key, the numbering is a prefix sum; null starts and ends don't occur.
    """
    cut = stretches(df, [key], [F.col(start), F.col(end)], 1, size)
    w = Window.partitionBy(key, "_stretch").orderBy("_place")
    fresh = F.when(F.col(start) - F.lag(end).over(w) < gap, 0).otherwise(1)
    own = cut.withColumn("_f", fresh).where("_own").drop("_own", "_stretch")
    out = running_sum(own, F.col("_f"), [F.col("_place")], by=[key], out="_b")
    return out.withColumn("block", F.col("_b") + F.col("_f")).drop("_f", "_b", "_place")


def merge_near(df: DataFrame, key: str, start: str, end: str, gap: float, longest: float) -> DataFrame:
    """(key, start, end): spans joined to the one before if the gap is below ``gap`` and the whole isn't over ``longest``.

    Each joining depends on the one before, so spans are taken in order; they
    are streamed through the task that has their block, which keeps the open
    span only, however many there are.
    """
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    blocks = split_at_gaps(rows.select(F.col(key).alias("k"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e")), "k", "s", "e", gap)
    ordered = blocks.select("k", "block", "s", "e").repartition("k", "block").sortWithinPartitions("k", "block", "s", "e")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        schema = None
        for b in batches:
            schema = schema or pa.schema([("k", b.schema.field(0).type), ("s", pa.float64()), ("e", pa.float64())])
            done: list[tuple] = []
            for k, block, s, e in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[:2] == (k, block) and s - held[3] < gap and e - held[2] <= longest:
                    held = (k, block, held[2], e)
                    continue
                if held:
                    done.append((held[0], held[2], held[3]))
                held = (k, block, s, e)
            yield _spans(done, schema)
        if held:
            yield _spans([(held[0], held[2], held[3])], schema)

    kind = dict(ordered.dtypes)["k"]
    return ordered.mapInArrow(run, f"k {kind}, s double, e double").select(F.col("k").alias(key), F.col("s").alias(start), F.col("e").alias(end))


def _spans(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(schema.names)}, schema=schema)


def tumbling(df: DataFrame, at: Column, width: float, least: float, total: Column) -> DataFrame:
    """Rows with their window of ``width``; a last window shorter than ``least`` is left out. ``total``: length of the key's recording."""
    n = F.floor(at / width).cast("bigint")
    return df.withColumn("window", n).where(F.least(total - n * width, F.lit(width)) >= least)
