"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klangsieb.llm import sql
from klangsieb.llm.capping import cap_contributors, speaker_key
from klangsieb.llm.chunking import cut_texts
from klangsieb.llm.leakage import leaks
from klangsieb.llm.mixing import enabled_clips, mix_to_shares
from klangsieb.llm.overlap import expand, near_same, sentences
from klangsieb.llm.packing import CAPACITY, pack, utilisation
from klangsieb.llm.splitting import ALONE, balanced_splits, components, split_name, split_report
from klangsieb.llm.terms import mark_terms, term_counts
from klangsieb.operators.ordered import holding
from klangsieb.session import settle

SPEAKER_CAP = 25
SHARES = {"train": 0.90, "val": 0.05, "test": 0.05}


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    clips = enabled_clips(_read(spark, folder, "dataset_meta"), _read(spark, folder, "corpora"))
    return mix_to_shares(clips, _read(spark, folder, "mix_targets"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1].where("limited").select("name")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1].select(
        "name", "target_share", "max_repeat", "n_items", F.round("available", 3).alias("available"), F.round("target_size", 3).alias("target_size"),
        "copies", F.round("reached_size", 3).alias("reached_size"), F.round("reached_share", 6).alias("reached_share"), "limited",
    )


def p1_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0].select(F.col("item").alias("idx"), F.col("source").alias("corpus"), F.col("size").alias("dur_proc_s"), "copies")


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    records = holding(_read(spark, folder, "texts"), "idx", first="line_no", keep=["text"])
    return mark_terms(*term_counts(records))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).where(F.col("mark").isNotNull()).select("term", "mark")


def p2_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).select("term", "occurrences", "records", "mark")


def _speakers(spark: SparkSession, folder: str) -> DataFrame:
    held = holding(_read(spark, folder, "speakers"), "idx", latest="line_no", keep=["speaker"])
    return held.select("idx", speaker_key(F.col("speaker")).alias("speaker"))


def _capped(spark: SparkSession, folder: str) -> DataFrame:
    snr = holding(_read(spark, folder, "qualitaet"), "idx", latest="measured_at", keep=["snr"])
    return cap_contributors(_speakers(spark, folder).join(snr, "idx", "left"), "idx", "speaker", "snr", max_count=SPEAKER_CAP)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _capped(spark, folder).where(~F.col("kept")).select(F.col("item").alias("idx"))


def p3_clips(spark: SparkSession, folder: str) -> DataFrame:
    return _capped(spark, folder).select(F.col("item").alias("idx"), F.col("contributor").alias("speaker"), "rank", "kept")


def _assigned(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    members = settle(components(_speakers(spark, folder), "idx", ["speaker"]))  # read for the weights, the report and the result
    present = _read(spark, folder, "splits").select(F.col("idx").alias("item"), split_name(F.col("split")).alias("split")).where(F.col("split").isNotNull())
    assigned = balanced_splits(members, SHARES)
    return members, split_report(members, present, assigned)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    report = _assigned(spark, folder)[1]
    return report.where(F.col("n_present") > 1).where(~F.col("component").startswith(ALONE)).select(F.col("component").alias("speaker"))


def p5_splits(spark: SparkSession, folder: str) -> DataFrame:
    members, report = _assigned(spark, folder)
    return members.join(report.select("component", "split"), "component").select(F.col("item").alias("idx"), "component", "split")


def _overlap(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, base_id, edits) of the evaluation items and the training clips."""
    items, lines = sentences(_read(spark, folder, "testset"), "id", "text"), sentences(_read(spark, folder, "texts").where("idx is not null"), "idx", "text", first="line_no")
    pairs = expand(*near_same(items, lines))
    train = _read(spark, folder, "splits").where(split_name(F.col("split")) == "train").select(F.col("idx").alias("base_id"))
    return pairs.join(train, "base_id", "left_semi")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _overlap(spark, folder).select(F.col("query_id").alias("id"), F.col("base_id").alias("idx")).distinct()


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per corpus of the evaluation item and of the training clip: items, clips and pairs, same and almost the same."""
    clips = holding(_read(spark, folder, "texts"), "idx", first="line_no", keep=["corpus"]).select(F.col("idx").alias("base_id"), F.col("corpus").alias("clip_corpus"))
    items = _read(spark, folder, "testset").groupBy(F.col("id").alias("query_id")).agg(F.min("corpus").alias("item_corpus"))
    pairs = _overlap(spark, folder).groupBy("query_id", "base_id").agg(F.min("edits").alias("edits"))
    return pairs.join(items, "query_id").join(clips, "base_id").groupBy("item_corpus", "clip_corpus").agg(
        F.lit("train").alias("split"), F.countDistinct("query_id").alias("items"), F.countDistinct("base_id").alias("clips"), F.count("*").alias("pairs"), F.count_if(F.col("edits") == 0).alias("same"),
    )


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").where(F.col("doc_id").isNotNull())
    return pack(docs.select("doc_id", F.octet_length("text").cast("bigint").alias("tokens")), "doc_id", "tokens")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).where("divided").select(F.col("item").alias("doc_id")).distinct()


def p7_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).select(F.col("item").alias("doc_id"), "piece", "start", F.col("size").alias("tokens"), F.col("container").alias("sequence"))


def p7_room(spark: SparkSession, folder: str) -> DataFrame:
    return utilisation(_packed(spark, folder), CAPACITY)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(_read(spark, folder, "documents"), _read(spark, folder, "eval_passages")).select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"))


def p8_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every leaking document with the items it holds and its number of runs."""
    hits = leaks(_read(spark, folder, "documents"), _read(spark, folder, "eval_passages"))
    return hits.groupBy(F.col("doc").alias("doc_id")).agg(F.count("*").alias("items"), F.sum("runs").alias("runs"), F.min("item").alias("first_item"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return cut_texts(_read(spark, folder, "documents")).where("pieces > 1 and piece = 0").select(F.col("doc").alias("doc_id")).distinct()


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return cut_texts(_read(spark, folder, "documents")).select(F.col("doc").alias("doc_id"), "piece", "pieces", "start", "fresh", F.col("size").alias("tokens"), "boundary", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_report, p1_mix, p2_found, p2_terms, p3_found, p3_clips, p5_found, p5_splits, p6_found, p6_report,
        p7_found, p7_sequences, p7_room, p8_found, p8_documents, p9_found, p9_pieces,
    )
}
SQL = sql.SQL
