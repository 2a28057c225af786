"""Code matrices by clip: Parquet in place of an offset index, appended exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klangsieb.operators.ordered import running_sum

SCHEMA = "idx string, codes array<array<smallint>>"


def write_codes(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Sorted by clip, so that a point read skips row groups; rows with a ragged matrix fail the run."""
    width = F.size(F.element_at("codes", 1))
    even = F.forall("codes", lambda r: F.size(r) == width)
    checked = df.withColumn("codes", F.when(even | (F.size("codes") == 0), F.col("codes")).otherwise(F.raise_error(F.concat(F.lit("ragged codes of "), F.col("idx")))))
    placed = checked.repartitionByRange(partitions, "idx") if partitions else checked.repartitionByRange("idx")
    placed.sortWithinPartitions("idx").write.mode("append").parquet(path)


def read_codes(spark: SparkSession, path: str, idx: str | None = None) -> DataFrame:
    """All matrices, or that of one clip (pushed down to the row groups)."""
    df = spark.read.schema(SCHEMA).parquet(path)
    return df if idx is None else df.where(F.col("idx") == idx)


def code_index(codes: DataFrame) -> DataFrame:
    """(idx, off, n): where each clip's frames would begin in one long stream."""
    return running_sum(codes.select("idx", F.size("codes").alias("n")), F.col("n").cast("bigint"), [F.col("idx")], out="off")


def code_histogram(codes: DataFrame) -> DataFrame:
    """How often each code occurs in each book."""
    books = codes.select(F.explode("codes").alias("frame")).select(F.posexplode("frame").alias("book", "code"))
    return books.groupBy("book", "code").agg(F.count("*").alias("n"))
