"""Queries of the remaining curation steps."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klangsieb.functions import arrays, text
from klangsieb.operators import select as sel
from klangsieb.operators import vectors
from klangsieb.operators.ordered import position
from klangsieb.plans.catalog import query, table
from klangsieb.plans.selection import META, meta
from klangsieb.plans.words import _TOKENS, _rare, _tokens


@query(
    "online_admission",
    f"""select idx, speaker, ms from (select *, coalesce(sum(ms) over (order by o, idx rows between unbounded preceding and 1 preceding), 0) as before from (
      select idx, speaker, round(dur * 1000)::bigint as ms, sha1('admit:' || idx) as o, row_number() over (partition by speaker order by sha1('admit:' || idx), idx) as r from {META} where dur is not null) where r <= 3) where before < 900000""",
)
def online_admission(spark: SparkSession, folder: str) -> DataFrame:
    """Clips as they come, at most three a speaker, until there is a quarter of an hour."""
    rows = meta(spark, folder, "speaker", "dur").where("dur is not null").select("idx", "speaker", F.round(F.col("dur") * 1000).cast("bigint").alias("ms"))
    return sel.admit(rows, "idx", F.sha1(F.concat(F.lit("admit:"), F.col("idx"))), "speaker", 3, F.col("ms"), 900_000).select("idx", "speaker", "ms")


@query("preselect_double_demand")
def preselect_double_demand(spark: SparkSession, folder: str) -> DataFrame:
    """Clips for twice the demand of each rare word, at most ten clips chosen a speaker."""
    some = meta(spark, folder, "speaker", "dur").where("dur > 0")
    t = _tokens(spark, folder)
    index = t.select(F.col("folded").alias("word"), "idx").distinct().join(_rare(t), "word").join(some, "idx")
    rows = index.select("word", F.col("clips").alias("priority"), F.col("idx").alias("clip"), F.sha1("idx").alias("clip_order"), "speaker", F.col("dur").alias("amount"))
    return sel.quota_cover(rows, 6, 1e12, cap=10)


@query("path_prefix_rewrite", "select distinct target_wav, case when starts_with(target_wav, 'datasets/lesesaal_de/') then '/mnt/a/' || substr(target_wav, 22) when starts_with(target_wav, 'datasets/') then '/mnt/b/' || substr(target_wav, 10) else target_wav end as path from testset")
def path_prefix_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "testset").select("target_wav").distinct()
    return t.withColumn("path", text.rewrite_prefix(F.col("target_wav"), [("datasets/lesesaal_de/", "/mnt/a/"), ("datasets/", "/mnt/b/")]))


@query("duration_tolerance", "select idx, dur_src_s, dur_proc_s from (select distinct idx, dur_src_s, dur_proc_s from dataset_meta) where abs(dur_src_s - dur_proc_s) > 0.75")
def duration_tolerance(spark: SparkSession, folder: str) -> DataFrame:
    """Processings whose durations before and after differ by more than the tolerance."""
    m = table(spark, folder, "dataset_meta").select("idx", "dur_src_s", "dur_proc_s").distinct()
    return m.where(F.abs(F.col("dur_src_s") - F.col("dur_proc_s")) > 0.75)


_CLIPS = f"(select folded, count(distinct idx) as clips from {_TOKENS} group by folded)"


@query("rarest_token", f"select idx, min(clips) as least, arg_min(folded, (clips, folded)) as word from (select distinct idx, folded from {_TOKENS}) join {_CLIPS} using (folded) group by idx")
def rarest_token(spark: SparkSession, folder: str) -> DataFrame:
    """The rarest word of each clip, by the number of clips it occurs in."""
    seen = _tokens(spark, folder).select("idx", "folded").distinct()
    n = seen.groupBy("folded").agg(F.count("*").alias("clips"))
    best = seen.join(n, "folded").groupBy("idx").agg(F.min(F.struct("clips", "folded")).alias("b"))
    return best.select("idx", F.col("b.clips").alias("least"), F.col("b.folded").alias("word"))


@query("priority_sorted_words", f"select idx, list(folded order by clips, folded) as words from (select distinct idx, folded from {_TOKENS}) join {_CLIPS} using (folded) group by idx")
def priority_sorted_words(spark: SparkSession, folder: str) -> DataFrame:
    """The words of each clip in the order of their priority, the rarest first."""
    seen = _tokens(spark, folder).select("idx", "folded").distinct()
    n = seen.groupBy("folded").agg(F.count("*").alias("clips"))
    lists = seen.join(n, "folded").groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("clips", "folded"))).alias("s"))
    return lists.select("idx", F.transform("s", lambda x: x["folded"]).alias("words"))


@query("lexicon_zipf", f"select folded as word, round(log10(n * 1e9::double / total), 2) as zipf from (select folded, count(*) as n, sum(count(*)) over () as total from {_TOKENS} group by folded) where length(folded) >= 5 and log10(n * 1e9::double / total) >= 5.0")
def lexicon_zipf(spark: SparkSession, folder: str) -> DataFrame:
    """Everyday words by their frequency in a thousand million words, from the transcripts themselves."""
    n = _tokens(spark, folder).groupBy("folded").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    zipf = F.log10(F.col("n") * 1e9 / F.col("total"))
    return n.crossJoin(F.broadcast(total)).where((F.length("folded") >= 5) & (zipf >= 5.0)).select(F.col("folded").alias("word"), F.round(zipf, 2).alias("zipf"))  # one row


@query("every_tenth", f"select idx from (select idx, row_number() over (order by idx) as r from {META}) where (r - 1) % 10 = 0")
def every_tenth(spark: SparkSession, folder: str) -> DataFrame:
    """Every tenth clip in the order of names (a sample is the feature)."""
    return position(meta(spark, folder), [F.col("idx")]).where((F.col("rank") - 1) % 10 == 0).select("idx")


@query("nested_distinct_counts", "select p_brand, count(distinct p_type) as kinds, list_sort(list(distinct p_size)) as sizes from part group by 1")
def nested_distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").groupBy("p_brand").agg(F.countDistinct("p_type").alias("kinds"), F.array_sort(F.collect_set("p_size")).alias("sizes"))


_CHARS = f"(select idx, list_filter(string_split(speaker, ''), lambda c: c <> '') as c from {META} where speaker is not null)"


@query(
    "label_grammar",
    f"select idx, list_transform(range(1, len(c) + 1), lambda i: case when c[i] = '-' then 8 when regexp_matches(c[i], '[0-9]') then case when len(list_filter(c[1:i - 1], lambda x: x = '-')) = 1 then -101 else 7 end else -100 end) as labels from {_CHARS}",
)
def label_grammar(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of a sequence: digits as frames (7), hyphens as ends (8); the block after the first hyphen trains the first book only."""
    chars = F.filter(F.split("speaker", ""), lambda c: c != "")
    ids = F.transform(chars, lambda c: F.when(c == "-", 8).when(c.rlike("[0-9]"), 7).otherwise(1))
    flags = F.array(F.lit(False), F.lit(True))
    return meta(spark, folder, "speaker").where("speaker is not null").select("idx", arrays.block_labels(ids, F.lit(7), F.lit(8), flags).alias("labels"))


@query("normalized_numbers")
def normalized_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation texts with signs and numbers in words."""
    return table(spark, folder, "testset").select("id", text.eval_form_numbers("text", "lang").alias("form")).distinct()


@query("cluster_dissolution")
def cluster_dissolution(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters inside each label, the small ones dissolved into the nearest of the others."""
    e = table(spark, folder, "embeddings").select("label", "vec_id", "embedding")
    c = vectors.agglomerate(e, "label", "vec_id", "embedding", cut=0.9)
    return vectors.dissolve_small(c.join(e, ["label", "vec_id"]).withColumn("w", F.lit(1.0)), "label", "vec_id", "cluster", "w", "embedding", 4.0, 0.1)


#: Where the files of public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"


@query("subword_counts")
def subword_counts(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Tokens of a public tokenizer, and characters a token, by kind of document; an error where its file isn't there."""
    path = os.path.join(tokenizers, "byte_bpe_50k.json")
    if not os.path.exists(path):
        raise FileNotFoundError(f"no tokenizer at {path}")
    d = table(spark, folder, "documents").select("doc_kind", "n_chars", F.size(text.subword_tokens(F.col("text"), path)).alias("n")).where("n > 0")
    return d.groupBy("doc_kind").agg(F.sum("n").alias("tokens"), F.round(F.sum("n_chars") / F.sum("n"), 4).alias("characters_a_token"))
