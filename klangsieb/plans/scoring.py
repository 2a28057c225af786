"""Queries that score and report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klangsieb.functions import text
from klangsieb.operators import metrics as m
from klangsieb.operators.ordered import holding
from klangsieb.plans.catalog import query, table
from klangsieb.plans.selection import META, meta
from klangsieb.plans.words import HELD, held_texts

_FORM = "trim(regexp_replace(lower(nfc_normalize({0})), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
_PAIR = f"(select listed.idx, lower(trim(m.corpus)) as corpus, {_FORM.format('listed.text')} as r, {_FORM.format('m.text')} as h from {HELD} listed join {META} m using (idx) where listed.text is not null and m.text is not null)"
_WORDED = f"(select idx, corpus, string_split(r, ' ') as rw, string_split(h, ' ') as hw, list_distinct(string_split(r, ' ') || string_split(h, ' ')) as d from {_PAIR})"
_EDITED = f"(select idx, corpus, levenshtein(array_to_string(list_transform(rw, lambda x: chr(32 + list_position(d, x)::int)), ''), array_to_string(list_transform(hw, lambda x: chr(32 + list_position(d, x)::int)), '')) as edits, len(rw) as n from {_WORDED} where len(d) <= 94)"


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Reference (the listed text) and hypothesis (the processed text) of each clip, normalized."""
    h = meta(spark, folder, "corpus", "text").select("idx", F.lower(F.trim("corpus")).alias("corpus"), F.col("text").alias("h"))
    p = held_texts(spark, folder).join(h, "idx").where("text is not null and h is not null")
    return p.select("idx", "corpus", text.eval_form(text.nfc(F.col("text"))).alias("r"), text.eval_form(text.nfc(F.col("h"))).alias("h"))


def _edits(spark: SparkSession, folder: str) -> DataFrame:
    p = _pairs(spark, folder).select("idx", "corpus", F.split("r", " ").alias("rw"), F.split("h", " ").alias("hw"))
    return p.select("idx", "corpus", m.word_edits("rw", "hw").alias("edits"), F.size("rw").alias("n"))


@query("wer_word_level", f"select idx, edits, n, round(edits / greatest(n, 1), 4) as wer from {_EDITED}")
def wer_word_level(spark: SparkSession, folder: str) -> DataFrame:
    e = _edits(spark, folder)
    return e.select("idx", "edits", "n", F.round(m.error_rate(F.col("edits"), F.col("n")), 4).alias("wer"))


_ASCII = "regexp_replace({0}, '[^a-z0-9]', '', 'g')"


@query("cer_char_level", f"select idx, levenshtein({_ASCII.format('r')}, {_ASCII.format('h')}) as edits, round(levenshtein({_ASCII.format('r')}, {_ASCII.format('h')}) / greatest(length({_ASCII.format('r')}), 1), 4) as cer from {_PAIR}")
def cer_char_level(spark: SparkSession, folder: str) -> DataFrame:
    """Character errors over unaccented letters and digits."""
    p = _pairs(spark, folder).select("idx", *[F.regexp_replace(c, "[^a-z0-9]", "").alias(c) for c in ("r", "h")])
    e = m.char_edits(F.col("r"), F.col("h"))
    return p.select("idx", e.alias("edits"), F.round(m.error_rate(e, F.length("r")), 4).alias("cer"))


@query(
    "special_case_rates",
    f"""select idx, case when corpus like '%_en' then 'nan'::double else round(edits / greatest(n, 1), 4) end as wer from {_EDITED}""",
)
def special_case_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Word rates, NaN for a language that is scored by characters only."""
    wer = F.when(F.col("corpus").endswith("_en"), F.lit(float("nan"))).otherwise(F.round(m.error_rate(F.col("edits"), F.col("n")), 4))
    return _edits(spark, folder).select("idx", wer.alias("wer"))


@query("corpus_rate", f"select corpus, count(*) as n, round(sum(edits) / sum(n), 8) as rate from {_EDITED} group by corpus")
def corpus_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Errors over words of whole corpora, not the mean of rates."""
    return _edits(spark, folder).groupBy("corpus").agg(F.count("*").alias("n"), F.round(m.ratio_of_sums(F.col("edits"), F.col("n")), 8).alias("rate"))


_POISSON = "(" + " + ".join(f"(case when u >= {c}::double then 1 else 0 end)" for c in ("0.36787944117144233", "0.7357588823428847", "0.9196986029286058", "0.9810118431238462", "0.9963401531726563", "0.9994058151824183", "0.9999167588507119", "0.9999897508033253")) + ")"


@query(
    "bootstrap_ci",
    f"""with cells as (select l_returnflag as flag, ('0x' || substr(sha1('cell:' || l_orderkey), 1, 8))::bigint % 512 as cell, sum(l_linenumber) as e, sum(l_quantity) as n, count(*) as c from lineitem group by 1, 2),
      drawn as (select flag, b, e, n, ('0x' || substr(sha1(b || ':' || cell), 1, 8))::bigint / 4294967296.0::double as u from cells cross join range(1000) t(b)),
      rates as (select flag, b, sum(e * {_POISSON}) / sum(n * {_POISSON}) as r from drawn group by 1, 2)
      select flag, round(sum(e) / sum(n), 8) as rate, sum(c)::bigint as rows, round(any_value(low), 6) as low, round(any_value(high), 6) as high
      from cells join (select flag, quantile_cont(r, 0.025) as low, quantile_cont(r, 0.975) as high from rates group by flag) using (flag) group by flag""",
)
def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_orderkey", "l_linenumber", "l_quantity")
    out = m.bootstrap(df, ["flag"], "l_orderkey", F.col("l_linenumber"), F.col("l_quantity"))
    return out.select("flag", F.round("rate", 8).alias("rate"), "rows", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_Q = "(select idx, h.* from (select idx, arg_max({'snr': snr, 'brumm': brumm, 'dur': dur}, measured_at) as h from qualitaet group by idx))"


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return holding(table(spark, folder, "qualitaet"), "idx", latest="measured_at", keep=["snr", "brumm", "dur"]).withColumn("corpus", F.substring_index("idx", "-", 1))


@query("nan_safe_mean", f"select split_part(idx, '-', 1) as corpus, round(avg(snr) filter (not isnan(snr)), 6) as snr, count(*) filter (snr is null or isnan(snr)) as without from {_Q} group by 1")
def nan_safe_mean(spark: SparkSession, folder: str) -> DataFrame:
    snr = F.col("snr")
    return _quality(spark, folder).groupBy("corpus").agg(F.round(m.mean_valid(snr), 6).alias("snr"), F.count_if(snr.isNull() | F.isnan(snr)).alias("without"))


@query(
    "batch_macro_mean",
    "select event_type, round(avg(x), 6) as macro, count(*) as batches from (select event_type, b, avg(value) as x from (select event_type, value, floor((row_number() over (partition by event_type order by event_id) - 1) / 64) as b from events) group by 1, 2) group by 1",
)
def batch_macro_mean(spark: SparkSession, folder: str) -> DataFrame:
    out = m.batch_mean(table(spark, folder, "events").select("event_type", "event_id", "value"), ["event_type"], "event_id", "value", 64)
    return out.withColumn("macro", F.round("macro", 6))


@query("batch_micro_mean", "select event_type, round(sum(value * (user_id + 1)) / sum(user_id + 1), 6) as micro from events group by 1")
def batch_micro_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Mean weighted by size."""
    size = F.col("user_id") + 1
    return table(spark, folder, "events").groupBy("event_type").agg(F.round(m.ratio_of_sums(F.col("value") * size, size), 6).alias("micro"))


@query(
    "index_percentiles",
    f"""select corpus, s[1] as least, s[1 + len(s) // 20] as p5, s[1 + len(s) // 2] as median, s[1 + len(s) - ceil(len(s) / 20.0)::int] as p95, s[len(s)] as most
      from (select split_part(idx, '-', 1) as corpus, list_sort(list(dur)) as s from {_Q} where dur is not null and not isnan(dur) group by 1)""",
)
def index_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return m.index_percentiles(_quality(spark, folder).select("idx", "corpus", "dur"), ["corpus"], "dur", "idx")


@query("interp_percentiles", f"select split_part(idx, '-', 1) as corpus, round(quantile_cont(snr, 0.05), 6) as p5, round(quantile_cont(snr, 0.5), 6) as p50, round(quantile_cont(snr, 0.95), 6) as p95 from {_Q} where not isnan(snr) group by 1")
def interp_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    snr = m.valid(F.col("snr"))
    return _quality(spark, folder).groupBy("corpus").agg(*[F.round(F.percentile(snr, F.lit(p)), 6).alias(f"p{round(100 * p)}") for p in (0.05, 0.5, 0.95)])


@query("ranking_report", f"select corpus, round(rate, 6) as rate, row_number() over (order by rate, corpus nulls last) as place from (select corpus, sum(edits) / sum(n) as rate from {_EDITED} group by corpus)")
def ranking_report(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql.window import Window

    rates = _edits(spark, folder).groupBy("corpus").agg(m.ratio_of_sums(F.col("edits"), F.col("n")).alias("rate"))
    return rates.select("corpus", F.round("rate", 6).alias("rate"), F.row_number().over(Window.orderBy("rate", F.asc_nulls_last("corpus"))).alias("place"))  # one row a corpus


@query("markdown_report", f"select corpus, '| ' || coalesce(corpus, '–') || ' | ' || coalesce(printf('%.1f %%', 100.0::double * sum(edits) / sum(n)), '–') || ' | ' || count(*) || ' |' as line from {_EDITED} group by corpus")
def markdown_report(spark: SparkSession, folder: str) -> DataFrame:
    rates = _edits(spark, folder).groupBy("corpus").agg(m.ratio_of_sums(F.col("edits"), F.col("n")).alias("rate"), F.count("*").alias("n"))
    shown = F.coalesce(F.format_string("%.1f %%", F.col("rate") * 100), F.lit("–"))
    return rates.select("corpus", F.concat(F.lit("| "), F.coalesce("corpus", F.lit("–")), F.lit(" | "), shown, F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("line"))


@query(
    "variant_corpus_pivot",
    "select l_linestatus as variant, " + ", ".join(f"round(sum(l_discount) filter (l_returnflag = '{f}') / sum(l_quantity) filter (l_returnflag = '{f}'), 8) as \"{f}\"" for f in "ANR") + " from lineitem group by 1",
)
def variant_corpus_pivot(spark: SparkSession, folder: str) -> DataFrame:
    rate = F.round(m.ratio_of_sums(F.col("l_discount"), F.col("l_quantity")), 8)
    return table(spark, folder, "lineitem").groupBy(F.col("l_linestatus").alias("variant")).pivot("l_returnflag", ["A", "N", "R"]).agg(rate)


@query("global_summary", f"select count(*) as clips, round(sum(dur::decimal(18,6))::double / 3600, 4) as hours, round(avg(dur::decimal(18,6))::double, 6) as mean, max(dur) as longest, count(*) filter (dur is null) as without from {META}")
def global_summary(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("dur").cast("decimal(18,6)")
    return meta(spark, folder, "dur").agg(
        F.count("*").alias("clips"), F.round(F.sum(d).cast("double") / 3600, 4).alias("hours"), F.round(F.sum(d).cast("double") / F.count("dur"), 6).alias("mean"), F.max("dur").alias("longest"), F.count_if(F.col("dur").isNull()).alias("without")
    )


@query(
    "condition_groups",
    "select condition, count(*) as n, round(avg(target_dur), 6) as dur from (select distinct id, target_dur, noisy_kinds from testset) join (values ('clean'), ('hum'), ('reverb'), ('band')) c(condition) on case condition when 'clean' then noisy_kinds is null else list_contains(noisy_kinds, condition) end group by condition",
)
def condition_groups(spark: SparkSession, folder: str) -> DataFrame:
    """A group for each named condition; an item may be in several, empty groups don't show."""
    kinds = F.col("noisy_kinds")
    names = F.array(F.when(kinds.isNull(), "clean"), *[F.when(F.array_contains(kinds, k), k) for k in ("hum", "reverb", "band")])
    t = table(spark, folder, "testset").select("id", "target_dur", "noisy_kinds").distinct()
    return t.select(F.explode(F.array_compact(names)).alias("condition"), "target_dur").groupBy("condition").agg(F.count("*").alias("n"), F.round(F.avg("target_dur"), 6).alias("dur"))


@query("sequence_parity_check", f"select count(*) as compared, count(*) filter (rw <> hw) as different, count(*) filter (rw[1:2] <> hw[1:2]) as other_start from {_WORDED}")
def sequence_parity_check(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict over pairs of sequences: equal as a whole, and in their first two words."""
    p = _pairs(spark, folder).select(F.split("r", " ").alias("a"), F.split("h", " ").alias("b"))
    return p.agg(F.count("*").alias("compared"), F.count_if(F.col("a") != F.col("b")).alias("different"), F.count_if(F.slice("a", 1, 2) != F.slice("b", 1, 2)).alias("other_start"))


@query("error_category_counts", "select split_part(event_type, ' ', 1) as reason, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 6) as percent from events group by 1")
def error_category_counts(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "events").groupBy(F.split_part("event_type", F.lit(" "), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"))
    return m.share_of_total(n, "n", "percent").withColumn("percent", F.round("percent", 6))


@query("value_histogram", "select kind, count(*) as n from (select distinct id, noisy_kinds from testset), unnest(noisy_kinds) t(kind) group by kind")
def value_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """How often each value of an array column occurs."""
    return table(spark, folder, "testset").select("id", "noisy_kinds").distinct().select(F.explode("noisy_kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("argmin_by_priority", "select c_mktsegment, arg_min(c_name, (-c_acctbal, c_name)) as best from customer group by 1")
def argmin_by_priority(spark: SparkSession, folder: str) -> DataFrame:
    best = F.min(F.struct((-F.col("c_acctbal")).alias("a"), "c_name"))
    return table(spark, folder, "customer").groupBy("c_mktsegment").agg(best.alias("b")).select("c_mktsegment", F.col("b.c_name").alias("best"))


@query("prefix_rule_sums", "select case when p_type like 'PROMO%' then 'promo' when p_type like 'STANDARD%' then 'standard' else 'other' end as kind, count(*) as n, round(sum(p_retailprice), 2) as total, count(distinct p_brand) as brands from part group by 1")
def prefix_rule_sums(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("p_type")
    kind = F.when(t.startswith("PROMO"), "promo").when(t.startswith("STANDARD"), "standard").otherwise("other")
    return table(spark, folder, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"), F.countDistinct("p_brand").alias("brands"))
