"""Readers with explicit schemas for the files of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIPE_SCHEMA = "wav_filename string, duration string, transcript string, client_id string, levenshtein string"
TSV_SCHEMA = "client_id string, path string, sentence string, up_votes string, down_votes string"
META_SCHEMA = "idx string, wav_rel string, corpus string, speaker string, text string, dur_src_s double, dur_proc_s double, frames int, truncated boolean"
SPEAKER_SCHEMA = "idx string, speaker string"
REGISTRY_SCHEMA = "name string, root string, csv string, speakers string, enabled boolean"
STATE_SCHEMA = "chunk string, status string, text string, reason string"


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """``wavs/….wav==text`` lines: (file, line, wav_rel, text); both null where a line is malformed."""
    raw = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    form = r"^(wavs/\S+\.wav)==(.*)$"
    ok = F.col("line").rlike(form)
    return raw.select("file", "line", F.when(ok, F.regexp_extract("line", form, 1)).alias("wav_rel"), F.when(ok, F.regexp_extract("line", form, 2)).alias("text"))


def listing_counts(lines: DataFrame) -> DataFrame:
    """One row: lines, malformed ones, and of the others those with blank text or a file that came before."""
    good = lines.where(F.col("wav_rel").isNotNull())
    repeated = good.groupBy("wav_rel").agg((F.count("*") - 1).alias("r")).agg(F.coalesce(F.sum("r"), F.lit(0)).alias("repeated"))
    counts = lines.agg(
        F.count("*").alias("lines"), F.count_if(F.col("wav_rel").isNull() & (F.trim("line") != "")).alias("malformed"), F.count_if(F.trim("text") == "").alias("without_text")
    )
    return counts.crossJoin(repeated)  # one row each


def read_pipe_csv(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated with header; numbers that don't parse become null, a missing agreement 0."""
    raw = spark.read.option("sep", "|").option("header", True).option("quote", '"').option("escape", '"').schema(PIPE_SCHEMA).csv(path)
    return raw.select("wav_filename", number("duration").alias("duration"), "transcript", "client_id", F.coalesce(number("levenshtein"), F.lit(0.0)).alias("levenshtein"))


def agreed(rows: DataFrame, least: float = 0.95) -> DataFrame:
    """Rows with a duration whose agreement reaches ``least``."""
    return rows.where(F.col("duration").isNotNull() & (F.col("levenshtein") >= least))


def read_votes_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated with header, quotes plain."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").schema(TSV_SCHEMA).csv(path)
    return raw.select("client_id", "path", "sentence", F.col("up_votes").try_cast("int").alias("up_votes"), F.col("down_votes").try_cast("int").alias("down_votes"))


def upvoted(rows: DataFrame, least: int = 2) -> DataFrame:
    return rows.where((F.col("up_votes") >= least) & (F.col("down_votes") == 0))


def read_keyed_tsv(spark: SparkSession, path: str, key: int = 0, value: int = 3) -> DataFrame:
    """Headerless: key and value by place; short lines are dropped, the last line of a key holds."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    rows = lines.where(F.size("f") > max(key, value)).select(F.element_at("f", key + 1).alias("key"), F.element_at("f", value + 1).alias("value"), "at")
    return rows.groupBy("key").agg(F.max_by("value", "at").alias("value"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, blank lines skipped."""
    return spark.read.schema(schema).json(path).where(F.coalesce(*[F.col(c).cast("string") for c in _names(schema)]).isNotNull())


def _names(schema: str) -> list[str]:
    from pyspark.sql.types import _parse_datatype_string

    return [f.name for f in _parse_datatype_string(schema).fields if f.dataType.simpleString() in ("string", "int", "bigint", "double", "boolean", "float")]


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A whole-file JSON array of corpora; ``enabled`` defaults to true."""
    return spark.read.schema(REGISTRY_SCHEMA).option("multiLine", True).json(path).withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line, trimmed, without blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("idx")).where(F.col("idx") != "")


def list_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Files below ``path``: (path, stem, length), without reading their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    name = F.substring_index("path", "/", -1)
    return files.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "length")


def read_with_place(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only some columns of Parquet files, with file and row, for a second scan of the chosen rows."""
    return spark.read.parquet(path).select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def audio_bytes(c: Column) -> Column:
    """Bytes of an audio struct, null where the struct is null or empty."""
    return F.when(F.length(c["bytes"]) > 0, c["bytes"])


def number(c: str) -> Column:
    return F.col(c).try_cast("double")
