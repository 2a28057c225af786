"""Queries that join: lookups with defaults, semi and anti joins, overrides, fallbacks, dedupes, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klangsieb.functions import text
from klangsieb.operators import merge
from klangsieb.operators.ordered import holding
from klangsieb.plans.catalog import query, table
from klangsieb.plans.selection import META, meta

_SPEAKER = "(select idx, arg_max({'s': speaker}, line_no).s as speaker from speakers where idx is not null group by idx)"


def speaker_map(spark: SparkSession, folder: str) -> DataFrame:
    return holding(table(spark, folder, "speakers"), "idx", latest="line_no", keep=["speaker"])


@query(
    "speaker_lookup_default",
    f"select m.idx, coalesce(s.speaker, case when lower(trim(m.corpus)) like '%_en' then 'reader_en' else 'reader' end) as speaker from {META} m left join {_SPEAKER} s using (idx)",
)
def speaker_lookup_default(spark: SparkSession, folder: str) -> DataFrame:
    default = F.when(F.lower(F.trim("corpus")).endswith("_en"), "reader_en").otherwise("reader")
    rows = meta(spark, folder, "corpus").join(speaker_map(spark, folder), "idx", "left")
    return rows.select("idx", F.coalesce("speaker", default).alias("speaker"))


@query("resume_anti_join", "select distinct idx, wav_rel from texts where idx not in (select idx from dataset_meta where idx is not null)")
def resume_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    """Clips listed but not processed yet."""
    done = table(spark, folder, "dataset_meta").select("idx")
    return table(spark, folder, "texts").select("idx", "wav_rel").distinct().join(done, "idx", "left_anti")


@query("split_semi_join", f"select idx, text from {META} where idx in (select idx from splits where lower(trim(split)) = 'val')")
def split_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    val = table(spark, folder, "splits").where(F.lower(F.trim("split")) == "val").select("idx")
    return meta(spark, folder, "text").join(val, "idx", "left_semi")


@query("override_merge", f"select m.idx, coalesce(case when trim(s.speaker) <> '' then s.speaker end, m.speaker) as speaker from {META} m left join {_SPEAKER} s using (idx)")
def override_merge(spark: SparkSession, folder: str) -> DataFrame:
    return merge.override(meta(spark, folder, "speaker"), speaker_map(spark, folder), "idx", "speaker")


@query(
    "reference_fallback_chain",
    f"""with m as (select idx, speaker from {META}), t as (select id, ref_idx, split_part(id, '-', 2) || '-' || split_part(id, '-', 3) as idx from (select distinct id, ref_idx from testset)),
      pool as (select speaker, min(idx) as least from m where speaker is not null group by speaker)
      select t.id, coalesce(r.idx, pool.least, t.idx) as reference from t left join m r on r.idx = t.ref_idx left join m o on o.idx = t.idx left join pool on pool.speaker = o.speaker and pool.least <> t.idx""",
)
def reference_fallback_chain(spark: SparkSession, folder: str) -> DataFrame:
    """The reference of an item: the one named, if known; else the first clip of its speaker; else itself."""
    m = meta(spark, folder, "speaker")
    t = table(spark, folder, "testset").select("id", "ref_idx").distinct().withColumn("idx", F.concat_ws("-", F.split_part("id", F.lit("-"), F.lit(2)), F.split_part("id", F.lit("-"), F.lit(3))))
    pool = m.where("speaker is not null").groupBy("speaker").agg(F.min("idx").alias("least"))
    named = m.select(F.col("idx").alias("named"))
    own = m.select("idx", F.col("speaker").alias("own"))
    out = t.join(named, F.col("ref_idx") == F.col("named"), "left").join(own, "idx", "left")
    out = out.join(pool, (F.col("own") == F.col("speaker")) & (F.col("least") != F.col("idx")), "left")
    return out.select("id", merge.fallback(F.col("named"), F.col("least"), F.col("idx")).alias("reference"))


@query("dedupe_first_wins", "select idx, text from (select idx, arg_min({'t': text}, line_no).t as text from texts group by idx) where trim(text) <> ''")
def dedupe_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    """First line of each clip, then without blank texts: an empty first line hides a later one."""
    return merge.dedupe_first(table(spark, folder, "texts").select("idx", "line_no", "text"), "idx", "line_no").select("idx", "text").where(F.trim("text") != "")


@query("dedupe_last_wins", f"select idx, speaker from {_SPEAKER}")
def dedupe_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    return merge.dedupe_last(table(spark, folder, "speakers").select("idx", "line_no", "speaker"), "idx", "line_no").select("idx", "speaker")


_REG = "(select name, h.* from (select name, arg_max({'root': root, 'enabled': enabled}, registered_at) as h from corpora group by name))"


@query(
    "registry_upsert",
    f"select name, root, enabled from {_REG} where name not in ('archivton_de', 'neuland_de') union all select 'archivton_de', 'archivton_v2', true union all select 'neuland_de', 'neuland_de', true",
)
def registry_upsert(spark: SparkSession, folder: str) -> DataFrame:
    reg = holding(table(spark, folder, "corpora"), "name", latest="registered_at", keep=["root", "enabled"])
    rows = spark.createDataFrame([("archivton_de", "archivton_v2", True), ("neuland_de", "neuland_de", True)], "name string, root string, enabled boolean")
    return merge.upsert(reg, rows, "name")


@query("registry_flag_rewrite", f"select name, root, name in ('lesesaal_de', 'pageturn_en') as enabled from {_REG}")
def registry_flag_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    reg = holding(table(spark, folder, "corpora"), "name", latest="registered_at", keep=["root"])
    return reg.withColumn("enabled", F.col("name").isin("lesesaal_de", "pageturn_en"))


@query("registry_scan_default", "select distinct name, coalesce(csv, 'texts.csv') as csv, coalesce(speakers, '') as speakers, coalesce(enabled, true) as enabled from corpora")
def registry_scan_default(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "corpora")
    return c.select("name", F.coalesce("csv", F.lit("texts.csv")).alias("csv"), F.coalesce("speakers", F.lit("")).alias("speakers"), F.coalesce("enabled", F.lit(True)).alias("enabled")).distinct()


@query("late_materialize", "select doc_id, source, text from documents where n_chars between 2000 and 2200")
def late_materialize(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of the documents chosen by their size alone."""
    out = merge.late_materialize(spark, f"{folder}/documents.parquet", ["doc_id", "n_chars"], ["source", "text"], lambda d: d.where(F.col("n_chars").between(2000, 2200)))
    return out.select("doc_id", "source", "text")


@query(
    "sibling_pairing",
    f"select t.idx, t.text, m.dur from (select idx, arg_min({{'text': text, 'at': added_at}}, line_no).text as text, arg_min({{'text': text, 'at': added_at}}, line_no).at as at from texts group by idx) t join (select idx, arg_max({{'d': dur_proc_s, 'at': written_at}}, written_at).d as dur, max(written_at) as at from dataset_meta group by idx) m on m.idx = t.idx and t.at < m.at",
)
def sibling_pairing(spark: SparkSession, folder: str) -> DataFrame:
    """Text and audio of a clip, where the text came first."""
    t = holding(table(spark, folder, "texts"), "idx", first="line_no", keep=["text", "added_at"])
    m = table(spark, folder, "dataset_meta").withColumn("at", F.col("written_at"))
    m = holding(m, "idx", latest="written_at", keep=["dur_proc_s", "at"]).withColumnRenamed("dur_proc_s", "dur")
    return merge.ordered_pairs(t, m, "idx", "added_at", "at").select("idx", "text", "dur")


@query(
    "condition_cross_join",
    """select t.id || suffix as job, t.id as item, suffix, cfg from (select distinct id from testset where noisy_ref_wav is not null) t
      cross join (values ('-plain', 1.0::double), ('-clean-cfg1', 1.0::double), ('-clean-cfg3', 3.0::double)) c(suffix, cfg)""",
)
def condition_cross_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every item with a degraded reference under each of three conditions; the item is found again by its suffix."""
    conditions = spark.createDataFrame([("-plain", 1.0), ("-clean-cfg1", 1.0), ("-clean-cfg3", 3.0)], "suffix string, cfg double")
    items = table(spark, folder, "testset").where("noisy_ref_wav is not null").select("id").distinct()
    jobs = items.crossJoin(F.broadcast(conditions)).select(F.concat("id", "suffix").alias("job"), "suffix", "cfg")  # three fixed rows
    return jobs.withColumn("item", F.regexp_replace("job", "-(plain|clean-cfg[13])$", ""))


@query("union_of_corpora", "select 'texts' as origin, count(*) as n, count(distinct idx) as clips from texts union all select 'speakers', count(*), count(distinct idx) from speakers union all select 'splits', count(*), count(distinct idx) from splits")
def union_of_corpora(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, n).select(F.lit(n).alias("origin"), "idx") for n in ("texts", "speakers", "splits")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("origin").agg(F.count("*").alias("n"), F.countDistinct("idx").alias("clips"))


@query(
    "suffix_fallback_join",
    "with t as (select distinct id, target_wav from testset), w as (select distinct wav_rel from texts) select id, wav_rel from t join w on target_wav = wav_rel or ends_with(target_wav, '/' || wav_rel)",
)
def suffix_fallback_join(spark: SparkSession, folder: str) -> DataFrame:
    """Targets found by their exact path, else by the path they end in."""
    t = table(spark, folder, "testset").select("id", F.concat(F.lit("/"), "target_wav").alias("target")).distinct()
    w = table(spark, folder, "texts").select(F.concat(F.lit("/"), "wav_rel").alias("tail"), "wav_rel").distinct()
    return merge.exact_or_suffix(t, w, "target", "tail").select("id", "wav_rel").distinct()


@query("slug_suffix_match", "select idx, min(wav_rel) as wav_rel from (select distinct id, regexp_extract(id, '([a-z]+-[0-9]+)$', 1) as idx from testset) join (select distinct wav_rel from texts) on ends_with(regexp_replace(wav_rel, '[.][^.]*$', ''), idx) group by idx")
def slug_suffix_match(spark: SparkSession, folder: str) -> DataFrame:
    """First file, in the order of paths, whose stem ends in the item's slug."""
    t = table(spark, folder, "testset").select(text.slug(F.regexp_extract("id", "([a-z]+-[0-9]+)$", 1)).alias("idx")).distinct()
    w = table(spark, folder, "texts").select("wav_rel").distinct().withColumn("idx", text.stem(F.col("wav_rel")))
    return w.join(t, "idx").groupBy("idx").agg(F.min("wav_rel").alias("wav_rel"))


@query(
    "explode_nested_join",
    "select l_orderkey as chapter, p_name as part, l_quantity as amount from lineitem join part on p_partkey = l_partkey where l_linenumber <= 3",
)
def explode_nested_join(spark: SparkSession, folder: str) -> DataFrame:
    """Nested lists exploded again and joined to their transcripts."""
    item = F.struct(F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("ref"), F.col("l_quantity").alias("amount"))
    nested = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("chapter")).agg(F.collect_list(item).alias("utts"))
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("part"))
    return nested.select("chapter", F.explode("utts").alias("u")).select("chapter", "u.*").where("no <= 3").join(part, "ref").select("chapter", "part", "amount")


@query("strict_lookup", "select o_orderkey, c_name from orders join customer on c_custkey = o_custkey")
def strict_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Every order must have its customer, else the run fails."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return merge.strict_join(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey").select("o_orderkey", "c_name")


@query("missing_files", "select distinct wav_rel from texts except select wav_rel from dataset_meta")
def missing_files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "texts").select("wav_rel").distinct().join(table(spark, folder, "dataset_meta").select("wav_rel"), "wav_rel", "left_anti")


@query(
    "counter_merge",
    "select corpus, sum(a)::bigint as listed, sum(b)::bigint as done, (sum(a) - sum(b))::bigint as open from (select lower(trim(corpus)) as corpus, count(*) as a, 0 as b from texts group by 1 union all select lower(trim(corpus)), 0, count(*) from dataset_meta where corpus is not null group by 1) group by corpus",
)
def counter_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Two counters added key by key, missing keys as zero."""
    name = F.lower(F.trim("corpus")).alias("corpus")
    a = table(spark, folder, "texts").groupBy(name).agg(F.count("*").alias("listed"))
    b = table(spark, folder, "dataset_meta").where("corpus is not null").groupBy(name).agg(F.count("*").alias("done"))
    out = a.join(b, "corpus", "full").na.fill(0, ["listed", "done"])
    return out.withColumn("open", F.col("listed") - F.col("done"))
