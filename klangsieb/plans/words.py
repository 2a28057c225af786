"""Queries over words and the form of texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from klangsieb.functions import text
from klangsieb.operators import select as sel
from klangsieb.operators.ordered import holding
from klangsieb.plans.catalog import query, table
from klangsieb.plans.selection import META, meta

# A word is rare up to so many clips; clips of rare words count up to so much more.
RARE, TARGET, MOST = 5, 12.0, 8.0

FOLD = "lower(replace(replace(w, 'ẞ', 'ss'), 'ß', 'ss'))"
HELD = "(select idx, arg_min({'t': text}, line_no).t as text from texts group by idx)"
_TOKENS = f"(select idx, w, {FOLD} as folded from (select idx, unnest(regexp_extract_all(text, '[A-Za-zÄÖÜäöüß]+')) as w from {HELD}))"


def held_texts(spark: SparkSession, folder: str) -> DataFrame:
    return holding(table(spark, folder, "texts"), "idx", first="line_no", keep=["text"])


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    t = held_texts(spark, folder).select("idx", F.explode(text.letter_words(F.col("text"))).alias("w"))
    return t.withColumn("folded", text.fold_case(F.col("w")))


@query("word_frequency", f"select folded as word, count(*) as occurrences, count(distinct idx) as clips from {_TOKENS} group by folded")
def word_frequency(spark: SparkSession, folder: str) -> DataFrame:
    per_clip = _tokens(spark, folder).groupBy("folded", "idx").agg(F.count("*").alias("n"))
    return per_clip.groupBy(F.col("folded").alias("word")).agg(F.sum("n").alias("occurrences"), F.count("*").alias("clips"))


@query("spelling_mode", f"select folded as word, arg_max(w, (n, -rank)) as spelling from (select *, row_number() over (partition by folded order by w) as rank from (select folded, w, count(*) as n from {_TOKENS} group by 1, 2)) group by folded")
def spelling_mode(spark: SparkSession, folder: str) -> DataFrame:
    """Most frequent spelling of each folded word; of equally frequent ones the first in binary order."""
    n = _tokens(spark, folder).groupBy("folded", "w").agg(F.count("*").alias("n"))
    return n.groupBy(F.col("folded").alias("word")).agg(F.min(F.struct((-F.col("n")).alias("m"), "w")).alias("b")).select("word", F.col("b.w").alias("spelling"))




@query(
    "midsentence_caps_table",
    rf"""with t as (select text from {HELD} where len(regexp_extract_all(text, '[A-Za-zÄÖÜäöüß]+')) > 0 and regexp_matches(text, '[A-ZÄÖÜ]')),
      hits as (select unnest(regexp_extract_all(replace(text, ' ', '  '), '[A-Za-zÄÖÜäöüß,][ ]+([A-Za-zÄÖÜäöüß]+)(?:[^-A-Za-zÄÖÜäöüß]|$)', 1)) as w from t)
      select folded as word, w as spelling, n from (select *, row_number() over (partition by folded order by n desc, w) as r from (select {FOLD} as folded, w, count(*) as n from hits group by 1, 2)) where r = 1""",
)
def midsentence_caps_table(spark: SparkSession, folder: str) -> DataFrame:
    """Spelling of words inside sentences: after a letter or comma and blanks, not beside a hyphen; texts in lower case say nothing."""
    t = held_texts(spark, folder).where(~text.all_lower(F.col("text")) & (F.size(text.letter_words(F.col("text"))) > 0))
    wide = F.replace("text", F.lit(" "), F.lit("  "))
    hits = t.select(F.explode(F.regexp_extract_all(wide, F.lit("[A-Za-zÄÖÜäöüß,][ ]+([A-Za-zÄÖÜäöüß]+)(?:[^-A-Za-zÄÖÜäöüß]|$)"), F.lit(1))).alias("w"))
    n = hits.groupBy(text.fold_case(F.col("w")).alias("word"), "w").agg(F.count("*").alias("n"))
    best = n.groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("m"), "w")).alias("b"))
    return best.select("word", F.col("b.w").alias("spelling"), (-F.col("b.m")).alias("n"))


_RARE = f"(select folded as word, count(distinct idx) as clips from {_TOKENS} where length(folded) >= 5 group by folded having count(distinct idx) <= {RARE})"


def _rare(tokens: DataFrame) -> DataFrame:
    seen = tokens.where(F.length("folded") >= 5).select(F.col("folded").alias("word"), "idx").distinct()
    return seen.groupBy("word").agg(F.count("*").alias("clips")).where(F.col("clips") <= RARE)


@query("rarity_filter", f"select word, clips from {_RARE}")
def rarity_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _rare(_tokens(spark, folder))


@query("rare_word_inverted_index", f"select distinct folded as word, idx, clips from {_TOKENS} join {_RARE} on word = folded")
def rare_word_inverted_index(spark: SparkSession, folder: str) -> DataFrame:
    t = _tokens(spark, folder)
    return t.select(F.col("folded").alias("word"), "idx").distinct().join(_rare(t), "word").select("word", "idx", "clips")


_WEIGHTS = f"(select idx, greatest(1.0::double, least({MOST}::double, {TARGET}::double / coalesce(min(clips), {TARGET * 100}))) as weight from {HELD} left join (select distinct folded, idx from {_TOKENS}) t using (idx) left join {_RARE} on word = folded group by idx)"


def _weights(spark: SparkSession, folder: str) -> DataFrame:
    t = _tokens(spark, folder)
    least = t.select(F.col("folded").alias("word"), "idx").distinct().join(_rare(t), "word").groupBy("idx").agg(F.min("clips").alias("least"))
    factor = F.greatest(F.lit(1.0), F.least(F.lit(MOST), F.lit(TARGET) / F.coalesce("least", F.lit(TARGET * 100))))
    return held_texts(spark, folder).select("idx").join(least, "idx", "left").select("idx", factor.alias("weight"))


@query("rare_word_weights", f"select idx, round(weight, 6) as weight from {_WEIGHTS}")
def rare_word_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weight of each clip by its rarest word: the target count over its clips, between 1 and the cap."""
    return _weights(spark, folder).select("idx", F.round("weight", 6).alias("weight"))


@query("expected_draws", f"select weight, count(*) as clips, round(sum(n * weight / s), 4) as draws from (select round(weight, 6) as weight, count(*) over () as n, sum(weight::decimal(18,6)) over ()::double as s from {_WEIGHTS}) group by weight")
def expected_draws(spark: SparkSession, folder: str) -> DataFrame:
    """Expected draws an epoch, by weight."""
    w = _weights(spark, folder).select(F.round("weight", 6).alias("weight")).groupBy("weight").agg(F.count("*").alias("clips"))
    total = w.agg(F.sum("clips").alias("n"), F.sum(F.col("weight").cast("decimal(18,6)") * F.col("clips")).cast("double").alias("s"))
    return w.crossJoin(F.broadcast(total)).select("weight", "clips", F.round(F.col("clips") * F.col("n") * F.col("weight") / F.col("s"), 4).alias("draws"))


@query(
    "coverage_histogram",
    f"select case when n = 0 then '0' when n < 10 then '1-9' when n < 30 then '10-29' when n < 50 then '30-49' else '50+' end as bucket, count(*) as words from (select folded, count(distinct idx) as n from {_TOKENS} group by folded order by n desc, folded limit 300) group by 1",
)
def coverage_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Clips a word, in fixed buckets, of the 300 most frequent words."""
    n = _tokens(spark, folder).select("folded", "idx").distinct().groupBy("folded").agg(F.count("*").alias("n"))
    c = F.col("n")
    bucket = F.when(c == 0, "0").when(c < 10, "1-9").when(c < 30, "10-29").when(c < 50, "30-49").otherwise("50+")
    return n.orderBy(F.desc("n"), "folded").limit(300).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("words"))


_NORM = "trim(regexp_replace(replace(replace(replace(lower(nfc_normalize(text)), '%', case when lang = 'de' then ' prozent ' else ' percent ' end), '€', ' euro '), 'ß', 'ss'), '[^\\p{L}\\p{N}_]+', ' ', 'g'))"


@query("normalized_text_eval", f"select distinct id, {_NORM} as form from testset")
def normalized_text_eval(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "testset").select("id", text.eval_form_signs(text.nfc(F.col("text")), F.col("lang")).alias("form")).distinct()


@query(
    "proportional_text_cut",
    """with s as (select idx, t, w, greatest(4, round_even(len(w) * 0.6::double, 0)::int) as k from (select idx, text as t, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') as w from """ + HELD + """ where text is not null)),
      seg as (select idx, k, len(w) as n, array_to_string(w[1:k], ' ') as g from s)
      select idx, trim(case when regexp_matches(g || ' ', '[.!?;:]\\s') then regexp_extract(g || ' ', '(?s)^(.*)[.!?;:]\\s', 1) when contains(g, ',') and k < n then regexp_extract(g, '(?s)^(.*),', 1) else g end) as cut from seg""",
)
def proportional_text_cut(spark: SparkSession, folder: str) -> DataFrame:
    t = held_texts(spark, folder).where("text is not null")
    return t.select("idx", text.proportional_cut(F.col("text"), F.lit(0.6)).alias("cut"))


@query(
    "regex_class_stats",
    f"""select lower(trim(corpus)) as corpus, count(*) filter (regexp_matches(text, '[0-9]')) as numbers, count(*) filter (regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])[A-Z]{{2,}}([^\\p{{L}}\\p{{N}}_]|$)')) as acronyms, count(*) filter (regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])[A-Za-z]([^\\p{{L}}\\p{{N}}_]|$)')) as letters,
      round(coalesce(sum(dur::decimal(18,6)) filter (regexp_matches(text, '[0-9]')), 0)::double / 3600, 6) as number_hours from {META} group by 1""",
)
def regex_class_stats(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    digits = t.rlike("[0-9]")
    return meta(spark, folder, "corpus", "text", "dur").groupBy(F.lower(F.trim("corpus")).alias("corpus")).agg(
        F.count_if(digits).alias("numbers"), F.count_if(t.rlike(r"(^|[^\p{L}\p{N}_])[A-Z]{2,}([^\p{L}\p{N}_]|$)")).alias("acronyms"), F.count_if(t.rlike(r"(^|[^\p{L}\p{N}_])[A-Za-z]([^\p{L}\p{N}_]|$)")).alias("letters"),
        F.round(F.coalesce(F.sum(F.when(digits, F.col("dur").cast("decimal(18,6)"))), F.lit(0)).cast("double") / 3600, 6).alias("number_hours"),
    )


@query(
    "unicode_mark_audit",
    f"select count(*) as texts, count(*) filter (regexp_matches(text, '[\\x{{300}}-\\x{{36f}}]')) as marks, count(*) filter (nfc_normalize(text) <> text) as not_composed, count(*) filter (contains(lower(text), 'ss')) as double_s from {HELD}",
)
def unicode_mark_audit(spark: SparkSession, folder: str) -> DataFrame:
    t = held_texts(spark, folder).withColumn("composed", text.nfc(F.col("text")))
    return t.agg(F.count("*").alias("texts"), F.count_if(F.col("text").rlike("[\\u0300-\\u036F]")).alias("marks"), F.count_if(F.col("composed") != F.col("text")).alias("not_composed"), F.count_if(F.contains(F.lower("text"), F.lit("ss"))).alias("double_s"))


@query("lowercase_texts", f"select idx from {HELD} where len(regexp_extract_all(text, '[A-Za-zÄÖÜäöüß]+')) > 0 and not regexp_matches(text, '[A-ZÄÖÜ]')")
def lowercase_texts(spark: SparkSession, folder: str) -> DataFrame:
    return held_texts(spark, folder).where(text.all_lower(F.col("text"))).select("idx")


def _restored(spark: SparkSession, folder: str) -> DataFrame:
    """Lower-case texts, with the spellings of their own words joined in and applied."""
    spelling = midsentence_caps_table(spark, folder).select("word", "spelling")
    low = held_texts(spark, folder).where(text.all_lower(F.col("text")))
    words = low.select("idx", F.explode(F.array_distinct(F.transform(text.letter_words(F.col("text")), text.fold_case))).alias("word"))
    known = words.join(spelling, "word").groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("word", "spelling"))).alias("spellings"))

    @F.pandas_udf(T.StringType())
    def restore(t: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([text.restore_case(a, dict(b) if b is not None else {}) for a, b in zip(t, m)], dtype=object)

    return low.join(known, "idx", "left").select("idx", restore("text", "spellings").alias("text"))


@query("capitalization_restore")
def capitalization_restore(spark: SparkSession, folder: str) -> DataFrame:
    return _restored(spark, folder)


@query("number_words")
def number_words(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts with numbers, the numbers in words."""
    lang = F.when(F.lower(F.trim("corpus")).endswith("_en"), "en").when(F.lower(F.trim("corpus")).endswith("_de"), "de").otherwise("pt")
    m = meta(spark, folder, "corpus", "text").where(F.col("text").rlike("[0-9]"))
    return m.select("idx", text.number_words(text.clean(text.nfc(F.col("text"))), lang).alias("text"))


@query("greedy_quota_cover")
def greedy_quota_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Clips for the rare words: rarest words first, three clips each, ten hours in all."""
    t = _tokens(spark, folder)
    index = t.select(F.col("folded").alias("word"), "idx").distinct().join(_rare(t), "word").join(meta(spark, folder, "dur").where("dur > 0"), "idx")
    rows = index.select("word", F.col("clips").alias("priority"), F.col("idx").alias("clip"), F.sha1("idx").alias("clip_order"), F.col("dur").alias("amount"))
    return sel.quota_cover(rows, 3, 36_000.0)


@query("substring_document_counts", "select w as needle, count(*) filter (contains(lower(text), w)) as documents from documents cross join (values ('über'), ('window'), ('não'), ('kapitel')) v(w) group by w")
def substring_document_counts(spark: SparkSession, folder: str) -> DataFrame:
    needles = ["über", "window", "não", "kapitel"]
    low = F.lower("text")
    counts = table(spark, folder, "documents").agg(*[F.count_if(F.contains(low, F.lit(w))).alias(w) for w in needles])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(w).alias("needle"), F.col(f"`{w}`").alias("documents")) for w in needles])).alias("x")).select("x.*")


@query("stress_patterns")
def stress_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Syllables and stressed syllable of every phonetic line of the documents."""
    lines = table(spark, folder, "documents").where(F.contains("text", F.lit("ˈ"))).select(F.explode(F.split("text", r"\r?\n")).alias("ipa")).where(F.contains("ipa", F.lit("ˈ"))).distinct()
    return lines.select("ipa", text.syllables(F.col("ipa")).alias("syllables"), text.stressed_syllable(F.col("ipa")).alias("stressed"))


@query("language_by_name", "select distinct corpus, case when contains(corpus, '_') and split_part(corpus, '_', -1) in ('de', 'en', 'zh') then split_part(corpus, '_', -1) else 'de' end as lang from testset")
def language_by_name(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "testset").select("corpus", text.language_of(F.col("corpus"), sep="_").alias("lang")).distinct()


@query("path_parts", "select distinct wav_rel, regexp_replace(split_part(wav_rel, '/', -1), '[.][^.]*$', '') as stem, nullif(regexp_extract(wav_rel, '^[^/]+/([^/]+)/', 1), '') as folder from texts")
def path_parts(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "texts").select("wav_rel").distinct()
    return t.select("wav_rel", text.stem(F.col("wav_rel")).alias("stem"), text.first_folder(F.col("wav_rel")).alias("folder"))
