"""Queries over arrays, maps, JSON and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klangsieb.functions import arrays
from klangsieb.operators import requests as rq
from klangsieb.plans.catalog import query, table
from klangsieb.plans.selection import META, meta



def _items(spark: SparkSession, folder: str) -> DataFrame:
    """Each clip with an array of codes, as long as its speaker's name and number."""
    m = meta(spark, folder, "speaker").where("speaker is not null")
    return m.select("idx", F.transform(F.filter(F.split("speaker", ""), lambda c: c != ""), F.ascii).alias("ids"))


_ITEMS = f"(select idx, list_transform(list_filter(string_split(speaker, ''), lambda c: c <> ''), lambda c: ascii(c)) as ids, speaker from {META} where speaker is not null)"


@query(
    "left_pad_batch",
    f"select idx, list_concat(list_resize([]::int[], m - len(ids), 0), ids) as padded, list_concat(list_resize([]::int[], m - len(ids), 0), list_transform(ids, lambda x: 1)) as mask from (select *, max(len(ids)) over (partition by split_part(idx, '-', 1) || substr(idx, -2)) as m from {_ITEMS})",
)
def left_pad_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Arrays padded on the left to the longest of their batch, with the mask of what is real."""
    rows = _items(spark, folder).withColumn("batch", F.concat(F.substring_index("idx", "-", 1), F.col("idx").substr(F.length("idx") - 1, F.lit(2))))
    m = rows.groupBy("batch").agg(F.max(F.size("ids")).alias("m"))
    rows = rows.join(m, "batch")
    return rows.select("idx", arrays.left_pad(F.col("ids"), F.col("m"), F.lit(0)).alias("padded"), arrays.left_pad(F.transform("ids", lambda _: F.lit(1)), F.col("m"), F.lit(0)).alias("mask"))


@query(
    "segment_mask",
    "select distinct id, list_concat(list_resize([]::boolean[], length(speaker)::int, true), list_resize([]::boolean[], length(corpus)::int, false), list_resize([]::boolean[], length(lang)::int, true)) as mask from testset",
)
def segment_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Text, audio, text: one flag per token of each segment."""
    t = table(spark, folder, "testset").select("id", "speaker", "corpus", "lang").distinct()
    lengths = F.array(F.length("speaker"), F.length("corpus"), F.length("lang"))
    return t.select("id", arrays.segment_mask(lengths, F.array(F.lit(True), F.lit(False), F.lit(True))).alias("mask"))


@query("block_run_lengths", f"select idx, list_transform(list_slice(string_split(s, '-'), 1, -2), lambda x: length(x)::int) as runs from (select idx, replace(speaker, '_', '-') as s from {META} where speaker is not null)")
def block_run_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of the runs before each delimiter; what follows the last one is dropped."""
    m = meta(spark, folder, "speaker").where("speaker is not null").select("idx", F.filter(F.split(F.replace("speaker", F.lit("_"), F.lit("-")), ""), lambda c: c != "").alias("chars"))
    return m.select("idx", arrays.block_runs(F.col("chars"), F.lit("-")).alias("runs"))


@query("chunk_with_tail", f"select idx, list_transform(range(0, len(ids)::bigint, 4), lambda i: ids[i + 1 : i + 4]) as chunks from {_ITEMS}")
def chunk_with_tail(spark: SparkSession, folder: str) -> DataFrame:
    return _items(spark, folder).select("idx", arrays.chunks(F.col("ids"), 4).alias("chunks"))


_NAME = "case when has_ref then case when told then 'ref_edit_tata' else 'ref_clone_tata' end when told then 'tts_instruction' else 'tts_plain' end"
_REQ = f"(select *, {_NAME} as template from (select distinct id, text, speaker, case when noisy_ref_wav is not null then lang else '  ' end as instruction, case when target_dur > 6 and ref_text is not null then ref_wav end as ref_wav, case when target_dur > 6 and ref_wav is not null then ref_text end as ref_text, (target_dur > 6 and coalesce(ref_wav, '') <> '' and coalesce(ref_text, '') <> '') as has_ref, noisy_ref_wav is not null as told from testset))"


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "testset")
    long = F.col("target_dur") > 6
    r = t.select(
        "id", "text", "speaker", F.when(F.col("noisy_ref_wav").isNotNull(), F.col("lang")).otherwise("  ").alias("instruction"),
        F.when(long & F.col("ref_text").isNotNull(), F.col("ref_wav")).alias("ref_audio_path"), F.when(long & F.col("ref_wav").isNotNull(), F.col("ref_text")).alias("ref_text"),
    ).distinct()
    return r.withColumn("template", rq.template_name(F.col("ref_audio_path"), F.col("ref_text"), F.col("instruction")))


@query("template_routing", f"select template, count(*) as n from {_REQ} group by 1")
def template_routing(spark: SparkSession, folder: str) -> DataFrame:
    return _requests(spark, folder).groupBy("template").agg(F.count("*").alias("n"))


@query("required_fields", "select id, list_filter([case when coalesce(text, '') = '' then 'text' end, case when coalesce(ref_wav, '') = '' then 'ref_audio_path' end, case when coalesce(ref_text, '') = '' then 'ref_text' end], lambda x: x is not null) as missing from (select distinct id, text, ref_wav, ref_text from testset) where coalesce(text, '') = '' or coalesce(ref_wav, '') = '' or coalesce(ref_text, '') = ''")
def required_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Items that lack a field they would need to be cloned, with its name."""
    t = table(spark, folder, "testset").select("id", "text", F.col("ref_wav").alias("ref_audio_path"), "ref_text").distinct()
    t = t.withColumn("missing", rq.missing_fields(F.lit("ref_clone_tata"), {f: F.col(f) for f in ("text", "ref_audio_path", "ref_text")} | {"instruction": F.lit("-")}))
    return t.where(F.size("missing") > 0).select("id", "missing")


@query(
    "prompt_render",
    f"select id, template, case when has_ref then '[' || speaker || ']' || ref_text || '|' || ref_wav || '|' else '' end || '[' || speaker || ']' || case when told then '<ins_bos>' || instruction || '<ins_eos>' else '' end || text as prompt from {_REQ} where speaker is not null and speaker <> ''",
)
def prompt_render(spark: SparkSession, folder: str) -> DataFrame:
    r = _requests(spark, folder).where("speaker is not null and speaker <> ''")
    s = rq.segments(*[F.col(c) for c in ("template", "text", "instruction", "ref_audio_path", "ref_text", "speaker")])
    return r.select("id", "template", F.array_join(F.transform(s, lambda x: F.coalesce(x["text"], x["audio_path"])), "|").alias("prompt"))


_LOGITS = "(select vec_id, list_transform(embedding[1:16], lambda x: round(x::double, 4)) as l from embeddings)"


def _logits(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return e.select("vec_id", F.transform(F.slice("embedding", 1, 16), lambda x: F.round(x.cast("double"), 4)).alias("l"))


@query(
    "nucleus_topk",
    f"""with p as (select vec_id, i, exp(l / 0.1::double) as e from (select vec_id, unnest(l) as l, generate_subscripts(l, 1) - 1 as i from {_LOGITS})),
      q as (select vec_id, i, e / sum(e) over (partition by vec_id) as p from p),
      r as (select *, row_number() over (partition by vec_id order by p desc, i) as n, coalesce(sum(p) over (partition by vec_id order by p desc, i rows between unbounded preceding and 1 preceding), 0) as before from q)
      select vec_id, list(i::int order by i) as kept from r where n <= 8 and before <= 0.8 group by vec_id""",
)
def nucleus_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _logits(spark, folder).select("vec_id", arrays.nucleus(arrays.softmax(F.col("l"), 0.1), 0.8, 8).alias("kept"))


@query("repetition_penalty", f"select vec_id, list_transform(l, lambda x, i: round(case when i - 1 in (vec_id % 16, 3) then case when x > 0 then x / 1.1::double else x * 1.1::double end else x end, 6)) as l from {_LOGITS}")
def repetition_penalty(spark: SparkSession, folder: str) -> DataFrame:
    history = F.array((F.col("vec_id") % 16).cast("int"), F.lit(3), F.lit(99))
    p = arrays.penalize(F.col("l"), history, 1.1)
    return _logits(spark, folder).select("vec_id", F.transform(p, lambda x: F.round(x, 6)).alias("l"))


@query("guidance_blend", f"select a.vec_id, list_transform(list_zip(b.l, a.l), lambda z: round(z[1] + 3.0::double * (z[2] - z[1]), 6)) as l from {_LOGITS} a join {_LOGITS} b on b.vec_id = a.vec_id // 2")
def guidance_blend(spark: SparkSession, folder: str) -> DataFrame:
    """Each row is blended with the one of half its number, cut towards zero; an array that is missing counts as one without values."""
    l = _logits(spark, folder).withColumn("l", F.coalesce("l", F.array().cast("array<double>")))
    other = l.select(F.col("vec_id").alias("o"), F.col("l").alias("u"))
    return l.join(other, F.expr("vec_id div 2 = o")).select("vec_id", F.transform(arrays.guide(F.col("u"), F.col("l"), 3.0), lambda x: arrays.rounded(x, 6)).alias("l"))


@query("json_profile_validate", "select event_id, list_filter([case when k % 3 <> 0 then 'version' end, case when k % 5 <> 0 then 'text_aligned' end], lambda x: x is not null) as faults from (select event_id, json_extract(props, '$.k')::int as k from events) where k % 3 <> 0 or k % 5 <> 0")
def json_profile_validate(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles made of each event's number, parsed and held against the rules; those with faults."""
    k = F.get_json_object("props", "$.k").cast("int")
    doc = F.format_string(
        '{"schema_version":%d,"name":"p","service":{"concurrency":1,"cfg_scales":[1.0]},"stages":{"text_encoder":{"graphs":[{"batch_size":1,"token_length":%d}]},"backbone_prefill":{"graphs":[{"branch_batch_size":1,"sequence_length":64}]}}}',
        F.when(k % 3 == 0, 1).otherwise(2), F.when(k % 5 == 0, 64).otherwise(65),
    )
    e = table(spark, folder, "events").select("event_id", rq.profile_faults(F.from_json(doc, rq.PROFILE)).alias("faults"))
    return e.where(F.size("faults") > 0)


@query("json_text_fallback", "select event_id, case when event_id % 2 = 0 then json_extract_string(props, '$.k') else event_type end as shown from events")
def json_text_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """A field of a JSON text, or the text itself where it isn't JSON."""
    raw = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.col("event_type"))
    return table(spark, folder, "events").select("event_id", F.coalesce(F.get_json_object(raw, "$.k"), raw).alias("shown"))


@query(
    "bucket_ceiling_lookup",
    "select doc_id, lang, need, (select min(b) from (values (256), (512), (1024), (2048), (8192)) t(b) where b >= need) as bucket from (select doc_id, doc_kind as lang, (ceil(n_chars / 32.0) * 32)::bigint as need from documents where doc_kind is not null)",
)
def bucket_ceiling_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Smallest bucket that fits the length, rounded up to 32."""
    needs = table(spark, folder, "documents").where("doc_kind is not null").select("doc_id", F.col("doc_kind").alias("lang"), arrays.ceil_to(F.col("n_chars"), 32).alias("need"))
    kinds = needs.select("lang").distinct()
    buckets = kinds.select("lang", F.explode(F.array(*[F.lit(b) for b in (256, 512, 1024, 2048, 8192)])).alias("b"))
    return rq.smallest_bucket(needs, buckets, "lang", "need", "b")


@query("map_overlay", "select event_id, case when event_id % 3 = 0 then 2 else 1 end as speed, case when event_id % 3 = 0 then 5 else 0 end as seed from events")
def map_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Defaults overlaid by a row's own settings, then looked up."""
    base = F.create_map(F.lit("speed"), F.lit(1))
    own = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("speed"), F.lit(2), F.lit("seed"), F.lit(5))).otherwise(F.create_map().cast("map<string,int>"))
    m = arrays.overlay(base, own)
    return table(spark, folder, "events").select("event_id", arrays.lookup(m, F.lit("speed"), F.lit(0)).alias("speed"), arrays.lookup(m, F.lit("seed"), F.lit(0)).alias("seed"))


@query("learning_rate_schedule", "select event_id, round(case when event_id < 500 then event_id / 500.0::double else 0.1::double + 0.9::double * 0.5 * (1 + cos(pi() * least(1.0::double, (event_id - 500) / 9500.0::double))) end, 6) as rate from events")
def learning_rate_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.round(arrays.learning_rate(F.col("event_id"), 500, 10_000, 0.1), 6).alias("rate"))


@query("array_transposed", "select vec_id, list_transform(range(1, 9), lambda i: [round(embedding[i]::double, 5), round(embedding[i + 8]::double, 5)]) as m from embeddings")
def array_transposed(spark: SparkSession, folder: str) -> DataFrame:
    two = F.array(*[F.transform(F.slice("embedding", a, 8), lambda x: F.round(x.cast("double"), 5)) for a in (1, 9)])
    return table(spark, folder, "embeddings").select("vec_id", arrays.transpose(two).alias("m"))


@query("quiet_loud_frames", "select vec_id, round(list_avg(s[1:12]), 6) as quiet, round(list_avg(s[33:64]), 6) as loud from (select vec_id, list_sort(list_transform(embedding, lambda x: x::double * x::double)) as s from embeddings)")
def quiet_loud_frames(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", arrays.quiet_and_loud(F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))).alias("q"))
    return e.select("vec_id", F.round("q.quiet", 6).alias("quiet"), F.round("q.loud", 6).alias("loud"))
