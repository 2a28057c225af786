"""Sinks: line files, manifests, reports, registries, exactly-once appends."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from klangsieb.operators.merge import upsert


def listing_line(wav_rel: Column, text: Column) -> Column:
    return F.concat(wav_rel, F.lit("=="), text)


def write_listing(df: DataFrame, path: str, mode: str = "append") -> None:
    df.select(listing_line(F.col("wav_rel"), F.col("text")).alias("value")).write.mode(mode).text(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_manifest(df: DataFrame, path: str, quoted: str = "text") -> None:
    cols = df.columns
    parts = [
        F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit("'")), F.lit('"')) if c == quoted else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols
    ]
    df.select(F.concat_ws(",", *parts).alias("value")).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    flat = [F.array_join(c, " ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_json_summary(df: DataFrame, path: str) -> None:
    """One object of all columns, nested as they are."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def markdown_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a report table as lines in ``order``, nulls as a dash (a report has few rows)."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("–")) for c in df.columns]
    return df.orderBy(*order).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def rttm_line(tag: Column, start: Column, end: Column, speaker: Column) -> Column:
    return F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", tag, start, end - start, speaker)


def write_rttm(spans: DataFrame, path: str) -> None:
    """Span labels in the order of tag and start."""
    rows = spans.repartitionByRange("tag", "start").sortWithinPartitions("tag", "start")
    rows.select(rttm_line(*[F.col(c) for c in ("tag", "start", "end", "speaker")]).alias("value")).write.mode("overwrite").text(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A metrics log with NaN in place of missing numbers."""
    cols = [F.coalesce(F.col(c), F.lit(float("nan"))).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("append").option("header", True).csv(path)


def append_once(path: str):
    """A ``foreachBatch`` function that writes each batch to its own folder: a batch that is replayed replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return write


def upsert_registry(registry: DataFrame, rows: DataFrame, path: str) -> None:
    """Delete by name, append, and write as a new version next to the old one."""
    upsert(registry, rows, "name").coalesce(1).write.mode("overwrite").json(path)


def set_enabled(registry: DataFrame, names: list[str]) -> DataFrame:
    return registry.withColumn("enabled", F.col("name").isin(names))


def next_version(spark: SparkSession, folder: str, name: str) -> str:
    """A path for a snapshot that isn't taken yet: ``name.v1``, ``name.v2`` and so on, on any file system Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    have = [int(m.group(1)) for f in names if (m := re.fullmatch(re.escape(name) + r"\.v(\d+)", f))]
    return f"{folder}/{name}.v{max(have, default=0) + 1}"


def snapshot(df: DataFrame, folder: str, name: str) -> str:
    """Write a table as its next version and return the path."""
    path = next_version(df.sparkSession, folder, name)
    df.write.parquet(path)
    return path
