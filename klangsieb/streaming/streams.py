"""Structured streams: unseen keys, lifecycles with terminal states, chunks with tails, bounded caches."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from klangsieb.operators.ordered import STRETCH, stretches
from klangsieb.session import ensure_checkpoint_dir
from klangsieb.sources.sinks import append_once


def stream_of(spark: SparkSession, path: str, files_a_trigger: int = 64) -> DataFrame:
    """A stream over Parquet files, with their schema; files a trigger bound what is in flight."""
    schema = spark.read.parquet(path).schema
    # a single file is streamed by its name within its folder
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger)
    if _is_file(spark, path):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(p)


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and return what it wrote.

    Batches go, exactly once, to a folder beside the checkpoints. In
    ``complete`` mode the last batch holds the whole result, in ``update``
    mode each batch holds the keys that changed.
    """
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    empty = spark.createDataFrame([], df.schema)
    empty.write.parquet(f"{base}/out/batch=-1")
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(append_once(f"{base}/out")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(f"{base}/out")
    if mode == "complete":
        last = out.agg(F.max("batch").alias("last"))
        out = out.crossJoin(F.broadcast(last)).where("batch = last").drop("last")  # one row
    return out.drop("batch") if mode != "update" else out


def unseen(stream: DataFrame, key: str) -> DataFrame:
    """The first row of each key over the life of the stream."""
    return stream.dropDuplicates([key])


def unseen_within(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """First row of each key, with state kept only as long as late copies are waited for."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, at: str, width: str, delay: str, by: list[str], *what: Column) -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), *by).agg(*what)


def lifecycle(stream: DataFrame, key: str, order: str, kind: str, terminal: str) -> DataFrame:
    """Per key the steps taken and whether it is closed: a terminal event closes it, later events are dropped.

    Output in update mode: (key, steps, closed, dropped) as of each batch.
    Events of one batch are taken in ``order``.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, closed, dropped = state.get if state.exists else (0, False, 0)
        pdf = pd.concat(list(batches)).sort_values("o", kind="stable")
        for x in pdf["kind"]:
            if closed:
                dropped += 1
            elif x == terminal:
                closed = True
            else:
                steps += 1
        state.update((steps, closed, dropped))
        yield pd.DataFrame({"key": [k[0]], "steps": [steps], "closed": [closed], "dropped": [dropped]})

    rows = stream.select(F.col(key).cast("bigint").alias("key"), F.col(order).alias("o"), F.col(kind).alias("kind"))
    return rows.groupBy("key").applyInPandasWithState(step, "key bigint, steps bigint, closed boolean, dropped bigint", "steps bigint, closed boolean, dropped bigint", "update", GroupStateTimeout.NoTimeout)


def chunked(stream: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """Full chunks of ``n`` values per key as they fill up, and the tail left after each batch.

    Output in update mode: (key, chunk, values, tail): whole chunks with their
    number and ``tail`` false, and one row with what is left and ``tail`` true.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, held = state.get if state.exists else (0, [])
        pdf = pd.concat(list(batches)).sort_values("o", kind="stable")
        held = [*held, *pdf["v"].tolist()]
        rows = []
        while len(held) >= n:
            rows.append((k[0], done, held[:n], False))
            done, held = done + 1, held[n:]
        state.update((done, held))
        rows.append((k[0], done, held, True))
        yield pd.DataFrame(rows, columns=["key", "chunk", "values", "tail"])

    rows = stream.select(F.col(key).cast("bigint").alias("key"), F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("key").applyInPandasWithState(step, "key bigint, chunk bigint, values array<double>, tail boolean", "done bigint, held array<double>", "update", GroupStateTimeout.NoTimeout)


def bounded_cache(stream: DataFrame, group: Column, key: str, order: str, capacity: int) -> DataFrame:
    """A cache of ``capacity`` keys per group, the least recently used one evicted: (grp, hits, misses, evicted, held)."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hits, misses, evicted, held = state.get if state.exists else (0, 0, 0, [])
        cache = OrderedDict.fromkeys(held)
        pdf = pd.concat(list(batches)).sort_values("o", kind="stable")
        for x in pdf["key"].tolist():
            if x in cache:
                hits += 1
                cache.move_to_end(x)
                continue
            misses += 1
            cache[x] = None
            if len(cache) > capacity:
                cache.popitem(last=False)
                evicted += 1
        state.update((hits, misses, evicted, list(cache)))
        yield pd.DataFrame({"grp": [k[0]], "hits": [hits], "misses": [misses], "evicted": [evicted], "held": [len(cache)]})

    rows = stream.select(group.cast("bigint").alias("grp"), F.col(key).cast("bigint").alias("key"), F.col(order).alias("o"))
    return rows.groupBy("grp").applyInPandasWithState(
        step, "grp bigint, hits bigint, misses bigint, evicted bigint, held bigint", "hits bigint, misses bigint, evicted bigint, held array<bigint>", "update", GroupStateTimeout.NoTimeout
    )


def latest(updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The last state of each key from the batches of an update stream."""
    return updates.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("_s")).select(key, "_s.*")


def shift_buffer(held: Column, new: Column, width: int) -> Column:
    """The last ``width`` values of what is held and what comes."""
    both = F.concat(held, new)
    return F.slice(both, F.greatest(F.size(both) - width + 1, F.lit(1)), width)


def left_context(df: DataFrame, key: str, order: str, value: str, k: int, out: str = "context", size: int = STRETCH) -> DataFrame:
    """Adds the ``k`` values before each row, across chunk borders, fewer at the start of a key; a hot key is cut into stretches."""
    cut = stretches(df, [key], [F.col(order)], k, size)
    w = Window.partitionBy(key, "_stretch").orderBy("_place").rowsBetween(-k, -1)
    return cut.withColumn(out, F.collect_list(value).over(w)).where("_own").drop("_own", "_stretch", "_place")


def process_unseen(spark: SparkSession, done: Callable[[], DataFrame], todo: DataFrame, key: str) -> DataFrame:
    """Batch form of the resumable log: rows whose key isn't done yet."""
    return todo.join(done().select(key).distinct(), key, "left_anti")
