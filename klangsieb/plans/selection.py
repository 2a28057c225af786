"""Queries that choose rows: budgets, splits, samples, caps, hash draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klangsieb.functions import hashing, text
from klangsieb.operators import select as sel
from klangsieb.operators.ordered import holding, position, running_sum
from klangsieb.plans.catalog import query, table

# The ranges of durations, densities and quality that candidates must lie in.
SECONDS = (2.5, 10.2)
CHARS_A_SECOND = (4.0, 30.0)
BUDGET_MS = 600_000
LEAST_SNR, MOST_HUM, LEAST_EDGE = 15.0, 8.0, 9000

META = "(select idx, h.* from (select idx, arg_max({'corpus': corpus, 'speaker': speaker, 'text': text, 'dur': dur_proc_s, 'frames': frames, 'wav_rel': wav_rel}, written_at) as h from dataset_meta group by idx))"
CLEAN = "trim(regexp_replace(regexp_replace(replace(replace(replace(text, '…', '...'), '–', '-'), '—', '-'), '[^A-Za-zÀ-ÿ0-9 .,!?''’\\-:;()\"]+', ' ', 'g'), '\\s+', ' ', 'g'), ' -')"


def meta(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    """Holding clips: idx and what is asked for of (corpus, speaker, text, dur, frames, wav_rel)."""
    m = table(spark, folder, "dataset_meta").withColumnRenamed("dur_proc_s", "dur")
    return holding(m, "idx", latest="written_at", keep=keep)


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    m = meta(spark, folder, "corpus", "text", "dur").where(F.col("dur").between(*SECONDS)).withColumn("clean", text.clean(F.col("text")))
    return m.where(text.density(F.col("clean"), F.col("dur")).between(*CHARS_A_SECOND))


_CAND = f"(select *, {CLEAN} as clean from {META} where dur between 2.5 and 10.2)"
_FIT = f"(select * from {_CAND} where clean <> '' and length(clean) / greatest(dur, 1e-6) between 4.0 and 30.0)"
_ROBIN = f"""
(select *, coalesce(sum(ms) over (order by turn, corpus nulls last, idx rows between unbounded preceding and 1 preceding), 0)::bigint as before
 from (select idx, corpus, round(dur * 1000)::bigint as ms, row_number() over (partition by corpus order by sha1(idx), idx) as turn from {_FIT}))
"""


@query("roundrobin_budget_select", f"select idx, corpus, ms, turn, before from {_ROBIN} where before < {BUDGET_MS}")
def roundrobin_budget_select(spark: SparkSession, folder: str) -> DataFrame:
    rows = _candidates(spark, folder).select("idx", "corpus", F.round(F.col("dur") * 1000).cast("bigint").alias("ms"))
    return sel.round_robin_budget(rows, "corpus", "idx", F.col("ms"), BUDGET_MS).select("idx", "corpus", "ms", "turn", "before")


@query("text_clean_density_filter", f"select idx, clean, round(length(clean) / greatest(dur, 1e-6), 6) as density from {_FIT}")
def text_clean_density_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _candidates(spark, folder).select("idx", "clean", F.round(text.density(F.col("clean"), F.col("dur")), 6).alias("density"))


_QUALITY = "(select idx, h.* from (select idx, arg_max({'snr': snr, 'hum': brumm, 'edge': kante}, measured_at) as h from qualitaet group by idx))"


@query(
    "reject_reason_counts",
    f"""select coalesce(reason, 'kept') as reason, count(*) as n, round(sum(dur::decimal(18,6))::double / 3600, 6) as hours from (
      select dur, case when dur is null then 'decode' when snr is null or isnan(snr) or snr < 15 then 'snr' when hum > 8 then 'hum' when edge < 9000 then 'band' when dur < 2.5 then 'short' when dur > 10.2 then 'long' end as reason
      from {META} left join {_QUALITY} using (idx)) group by 1""",
)
def reject_reason_counts(spark: SparkSession, folder: str) -> DataFrame:
    q = holding(table(spark, folder, "qualitaet"), "idx", latest="measured_at", keep=["snr", "brumm", "kante"])
    snr, dur = F.col("snr"), F.col("dur")
    reason = sel.first_reason(
        [("decode", dur.isNull()), ("snr", snr.isNull() | F.isnan(snr) | (snr < LEAST_SNR)), ("hum", F.col("brumm") > MOST_HUM), ("band", F.col("kante") < LEAST_EDGE), ("short", dur < SECONDS[0]), ("long", dur > SECONDS[1])]
    )
    rows = meta(spark, folder, "dur").join(q, "idx", "left").withColumn("reason", F.coalesce(reason, F.lit("kept")))
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.round(F.sum(dur.cast("decimal(18,6)")).cast("double") / 3600, 6).alias("hours"))


@query(
    "group_hours_summary",
    f"""select lower(trim(corpus)) as corpus, count(*) as clips, count(distinct speaker) as speakers, round(coalesce(sum(dur::decimal(18,6)), 0)::double / 3600, 4) as hours,
      round(100.0::double * count(*) / sum(count(*)) over (), 4) as percent from {META} group by 1""",
)
def group_hours_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = meta(spark, folder, "corpus", "speaker", "dur").groupBy(F.lower(F.trim("corpus")).alias("corpus"))
    out = rows.agg(F.count("*").alias("clips"), F.countDistinct("speaker").alias("speakers"), F.round(F.coalesce(F.sum(F.col("dur").cast("decimal(18,6)")), F.lit(0)).cast("double") / 3600, 4).alias("hours"))
    total = out.agg(F.sum("clips").alias("_t"))
    return out.crossJoin(F.broadcast(total)).withColumn("percent", F.round(100.0 * F.col("clips") / F.col("_t"), 4)).drop("_t")


@query(
    "stratified_split_90_5_5",
    f"""select idx, corpus, case when n < 40 or p < floor(n * 0.9::double) then 'train' when p < floor(n * 0.95::double) then 'val' else 'test' end as split
      from (select idx, lower(trim(corpus)) as corpus, row_number() over (partition by lower(trim(corpus)) order by sha1(idx), idx) - 1 as p, count(*) over (partition by lower(trim(corpus))) as n from {META})""",
)
def stratified_split_90_5_5(spark: SparkSession, folder: str) -> DataFrame:
    rows = meta(spark, folder, "corpus").select("idx", F.lower(F.trim("corpus")).alias("corpus"))
    return sel.stratified_split(rows, "corpus", "idx").select("idx", "corpus", "split")


@query(
    "stratified_strided_sample",
    f"""select idx, corpus from (select *, greatest(1, floor(n / k))::bigint as step from (select *, greatest(1, round_even(96.0::double * n / (select count(*) from {META}), 0))::bigint as k
      from (select idx, lower(trim(corpus)) as corpus, row_number() over (partition by lower(trim(corpus)) order by idx) - 1 as p, count(*) over (partition by lower(trim(corpus))) as n from {META})))
      where p % step = 0 and p / step < k""",
)
def stratified_strided_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = meta(spark, folder, "corpus").select("idx", F.lower(F.trim("corpus")).alias("corpus"))
    return sel.strided_sample(rows, "corpus", "idx", 96).select("idx", "corpus")


@query(
    "capped_topn_per_corpus",
    f"""select idx, corpus, speaker from (select *, row_number() over (partition by corpus order by sha1(idx), idx) as rc from (
      select *, row_number() over (partition by corpus, speaker order by sha1(idx), idx) as rs, count(*) over (partition by corpus, speaker) as n from (select idx, lower(trim(corpus)) as corpus, speaker from {META} where speaker is not null and corpus is not null))
      where rs <= 2 and n > 1) where rc <= 20""",
)
def capped_topn_per_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Per corpus 20 clips in hash order, at most two a speaker, only of speakers with another clip."""
    rows = meta(spark, folder, "corpus", "speaker").where("speaker is not null and corpus is not null").select("idx", F.lower(F.trim("corpus")).alias("corpus"), "speaker")
    many = rows.groupBy("corpus", "speaker").agg(F.count("*").alias("n")).where("n > 1")
    order = [F.sha1("idx"), F.col("idx")]
    two = sel.best_per_group(rows.join(many, ["corpus", "speaker"], "left_semi"), ["corpus", "speaker"], order, 2)
    return sel.best_per_group(two.drop("rank"), ["corpus"], order, 20).select("idx", "corpus", "speaker")


@query("hash_bucket_variant", "select distinct idx, case when (('0x' || substr(sha1(idx), 1, 2))::int / 255.0::double) >= 0.5 then 'instruction' else 'reference' end as variant from texts")
def hash_bucket_variant(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "texts").select("idx").distinct()
    return t.select("idx", F.when(hashing.byte_fraction(F.col("idx")) >= 0.5, "instruction").otherwise("reference").alias("variant"))


@query(
    "hash_bucket_threeway",
    "select idx, case when u < 0.3 then 'degraded' when u < 0.3::double + 0.2::double then 'clean' else 'normal' end as choice from (select distinct idx, ('0x' || substr(sha1('choice:' || idx), 1, 8))::bigint / 4294967295.0::double as u from texts)",
)
def hash_bucket_threeway(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "texts").select("idx").distinct()
    return t.select("idx", hashing.bucket_of(F.concat(F.lit("choice:"), F.col("idx")), [("degraded", 0.3), ("clean", 0.2)], "normal").alias("choice"))


_MOD = "list_reduce(list_prepend(0::bigint, list_transform(string_split(sha1('ref:' || idx), ''), lambda c: ('0x' || c)::bigint)), lambda a, d: (a * 16 + d) % (n - 1))"


@query(
    "hash_mod_pick_ref",
    f"""with t as (select idx, speaker, row_number() over (partition by speaker order by idx) as p, count(*) over (partition by speaker) as n from {META} where speaker is not null),
      j as (select *, case when n > 1 then {_MOD} end as j from t)
      select j.idx, j.speaker, coalesce(o.idx, j.idx) as partner from j left join t o on o.speaker = j.speaker and o.p = j.j + case when j.j + 1 >= j.p then 2 else 1 end""",
)
def hash_mod_pick_ref(spark: SparkSession, folder: str) -> DataFrame:
    rows = meta(spark, folder, "speaker").where("speaker is not null")
    return sel.pick_partner(rows, "speaker", "idx").select("idx", "speaker", "partner")


@query("job_seed", "select distinct id, ('0x' || substr(sha1(id), 1, 8))::bigint % 2147483648 as seed from testset")
def job_seed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "testset").select("id").distinct().select("id", hashing.job_seed(F.col("id")).alias("seed"))


@query("seed_arithmetic_pool", f"select idx, ((frames * 7 + list_sum(list_transform(string_split(idx, ''), lambda c: ascii(c)))::bigint) % 10000 % 12)::bigint as place from {META}")
def seed_arithmetic_pool(spark: SparkSession, folder: str) -> DataFrame:
    return meta(spark, folder, "frames").select("idx", hashing.frame_seed(F.col("frames"), F.col("idx"), F.lit(12)).cast("bigint").alias("place"))


@query("prefix_offsets", f"select idx, frames, coalesce(sum(frames) over (order by idx rows between unbounded preceding and 1 preceding), 0)::bigint as off from {META} where frames is not null")
def prefix_offsets(spark: SparkSession, folder: str) -> DataFrame:
    rows = meta(spark, folder, "frames").where("frames is not null")
    return running_sum(rows, F.col("frames").cast("bigint"), [F.col("idx")], out="off")


@query("dense_ids", f"select idx, format('new-{{:06d}}', 7000 + row_number() over (order by sha1(idx), idx)) as new_id from {META}")
def dense_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = position(meta(spark, folder), [F.sha1("idx"), F.col("idx")])
    return rows.select("idx", F.format_string("new-%06d", F.col("rank") + 7000).alias("new_id"))


@query("resume_next_id", "select split_part(idx, '-', 1) as prefix, max(try_cast(split_part(idx, '-', -1) as bigint)) + 1 as next_id from texts group by 1")
def resume_next_id(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "texts").groupBy(F.substring_index("idx", "-", 1).alias("prefix"))
    return t.agg((F.max(F.substring_index("idx", "-", -1).try_cast("bigint")) + 1).alias("next_id"))


@query(
    "running_until_threshold",
    """select corpus, count(*) as lines, sum(words)::bigint as words, string_agg(text, ' ' order by line_no) as passage from (
      select *, coalesce(sum(words) over (partition by corpus order by line_no rows between unbounded preceding and 1 preceding), 0) as before from (
        select corpus, line_no, text, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) as words, row_number() over (partition by corpus order by line_no) as p from texts where text is not null) where p >= 10)
      where before < 170 group by corpus""",
)
def running_until_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """From the tenth line of each corpus on, lines until there are 170 words, joined to a passage."""
    t = table(spark, folder, "texts").where("text is not null").select("corpus", "line_no", "text")
    words = F.regexp_count("text", F.lit(r"[^ \t\n\r\f\x0b]+"))
    rows = sel.passage_from(t.withColumn("words", words), "corpus", "line_no", F.col("words"), 10, 170)
    return rows.groupBy("corpus").agg(
        F.count("*").alias("lines"), F.sum("words").cast("bigint").alias("words"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("passage"),
    )


@query("source_priority_order", "select doc_id, doc_kind, row_number() over (order by case doc_kind when 'chapter' then 0 else 1 end, sha1(doc_id::varchar), doc_id) as place from documents")
def source_priority_order(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", "doc_kind")
    first = F.when(F.col("doc_kind") == "chapter", 0).otherwise(1)
    return position(d, [first, F.sha1(F.col("doc_id").cast("string")), F.col("doc_id")], out="place")


@query("audit_sample", "select idx, text from (select distinct idx, text from texts where text is not null) order by sha1(idx), idx, text limit 30")
def audit_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A fixed sample of 30 lines to listen to, in hash order."""
    return table(spark, folder, "texts").where("text is not null").select("idx", "text").distinct().orderBy(F.sha1("idx"), "idx", "text").limit(30)


@query(
    "weighted_sample",
    f"""with r as (select idx, w, coalesce(sum(w) over (order by idx rows between unbounded preceding and 1 preceding), 0)::bigint as low from (select idx, frames::bigint as w from {META} where frames > 0)),
      d as (select i as draw, floor(('0x' || substr(sha1('draw:' || i), 1, 8))::bigint::double / 4294967296.0::double * (select sum(w)::double from r))::bigint as u from range(1000) t(i))
      select draw, idx as key from d join r on u >= low and u < low + w""",
)
def weighted_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A thousand draws with replacement, in proportion to the frames."""
    return sel.weighted_draws(meta(spark, folder, "frames"), "idx", F.coalesce("frames", F.lit(0)), 1000, "draw")
