"""Queries over spans, windows and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from klangsieb.functions import arrays
from klangsieb.operators import merge, spans, vectors
from klangsieb.plans.catalog import query, table

_EV = "(select event_id, user_id, event_type, value, epoch_us(ts) as us, round(epoch_us(ts) / 1e6::double, 3) as t from events)"
_SPANS = f"(select user_id, event_type, t as start, t + round(least(greatest(value, 1.0::double), 5000.0::double), 2) as \"end\" from {_EV})"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.select("event_id", "user_id", "event_type", "value", "at", F.unix_micros("at").alias("us"), F.round(F.unix_micros("at") / 1e6, 3).alias("t"))


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    """A span for each event, as long as its value."""
    length = F.round(F.least(F.greatest(F.col("value"), F.lit(1.0)), F.lit(5000.0)), 2)
    return _events(spark, folder).select("user_id", "event_type", F.col("t").alias("start"), (F.col("t") + length).alias("end"))


@query(
    "gaps_islands_runs",
    "select user_id, min(event_id) as first, max(event_id) as last, count(*) as length from (select user_id, event_id, n - row_number() over (partition by user_id order by event_id) as island from (select *, row_number() over (partition by user_id order by event_id) as n from events) where value > 20) group by user_id, island having count(*) >= 2",
)
def gaps_islands_runs(spark: SparkSession, folder: str) -> DataFrame:
    return spans.islands(table(spark, folder, "events"), "user_id", "event_id", F.col("value") > 20, 2)


@query(
    "bounded_gap_merge",
    f"""with recursive s as (select user_id, start, "end" as stop, row_number() over (partition by user_id order by start, "end") as n from {_SPANS}),
      f as (select user_id, n, start, stop, 1 as no from s where n = 1
        union all select s.user_id, s.n, case when s.start - f.stop < 3600 and s.stop - f.start <= 20000 then f.start else s.start end, s.stop, case when s.start - f.stop < 3600 and s.stop - f.start <= 20000 then f.no else f.no + 1 end
        from f join s on s.user_id = f.user_id and s.n = f.n + 1)
      select user_id, round(min(start), 3) as start, round(max_by(stop, n), 3) as "end" from f group by user_id, no""",
)
def bounded_gap_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Spans joined over gaps below an hour, to at most 20,000 seconds."""
    out = spans.merge_near(_spans(spark, folder), "user_id", "start", "end", 3600.0, 20000.0)
    return out.select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


_A, _B = f"(select * from {_SPANS} where event_type = 'click')", f"(select * from {_SPANS} where event_type <> 'click')"


@query("interval_intersection", f'select a.user_id, b.event_type as other, round(greatest(a.start, b.start), 3) as start, round(least(a."end", b."end"), 3) as "end" from {_A} a join {_B} b on a.user_id = b.user_id and least(a."end", b."end") - greatest(a.start, b.start) >= 0.4')
def interval_intersection(spark: SparkSession, folder: str) -> DataFrame:
    s = _spans(spark, folder)
    both = merge.overlaps(s.where("event_type = 'click'"), s.where("event_type <> 'click'"), "user_id", 0.4, 600.0)
    return both.select("user_id", F.col("b_event_type").alias("other"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query("interval_overlap_sum", f'select a.user_id, round(a.start, 3) as start, round(sum(least(a."end", b."end") - greatest(a.start, b.start)), 3) as overlap from {_A} a join {_B} b on a.user_id = b.user_id and least(a."end", b."end") - greatest(a.start, b.start) >= 0 group by a.user_id, a.start')
def interval_overlap_sum(spark: SparkSession, folder: str) -> DataFrame:
    s = _spans(spark, folder)
    both = merge.overlaps(s.where("event_type = 'click'"), s.where("event_type <> 'click'"), "user_id", 0.0, 600.0)
    return both.groupBy("user_id", "a_start").agg(F.round(F.sum(F.col("end") - F.col("start")), 3).alias("overlap")).select("user_id", F.round("a_start", 3).alias("start"), "overlap")


_T0 = "(select min(us) as t0, max(us) as t1 from " + _EV + ")"


@query("tumbling_min_tail", f"select event_type, floor((us - t0) / 1e6::double / 36000)::bigint as \"window\", count(*) as n, round(avg(value), 6) as mean from {_EV} cross join {_T0} where least((t1 - t0) / 1e6::double - floor((us - t0) / 1e6::double / 36000) * 36000, 36000) >= 18000 group by 1, 2")
def tumbling_min_tail(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of ten hours; the last one only if it is at least half full."""
    e = _events(spark, folder)
    span = e.agg(F.min("us").alias("t0"), F.max("us").alias("t1"))
    rows = e.crossJoin(F.broadcast(span))  # one row
    rows = spans.tumbling(rows, (F.col("us") - F.col("t0")) / 1e6, 36000.0, 18000.0, (F.col("t1") - F.col("t0")) / 1e6)
    return rows.groupBy("event_type", "window").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    "first_last_windows",
    "select user_id, round(list_avg(v[1:2]), 6) as first, round(list_avg(v[greatest(len(v) - 1, 1):]), 6) as last from (select user_id, list(m order by w) as v from (select user_id, date_trunc('day', ts) as w, round(avg(value), 4) as m from events group by 1, 2) group by user_id)",
)
def first_last_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Means over a user's first two and last two days."""
    days = _events(spark, folder).groupBy("user_id", F.date_trunc("day", "at").alias("w")).agg(F.round(F.avg("value"), 4).alias("m"))
    lists = days.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "m"))), lambda x: x["m"]).alias("v"))
    fl = lists.select("user_id", arrays.first_last_means(F.col("v")).alias("x"))
    return fl.select("user_id", F.round("x.first", 6).alias("first"), F.round("x.last", 6).alias("last"))


@query("session_windows", "select user_id, min(ts) as first, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as fresh from events)) group by user_id, s")
def session_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Beyond the reference: sessions by a gap of 30 minutes."""
    return table(spark, folder, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("first"), F.count("*").alias("n")).select("user_id", "first", "n")


_COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


@query(
    "cosine_pairs_topmatch",
    f"select query, case when cosine >= 0.55 then match else query end as match, case when cosine >= 0.55 then cosine else 1.0::double end as cosine from (select a.vec_id as query, b.vec_id as match, round({_COS}, 6) as cosine, row_number() over (partition by a.vec_id order by round({_COS}, 6) desc, b.vec_id) as r from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 100 = 0) where r = 1",
)
def cosine_pairs_topmatch(spark: SparkSession, folder: str) -> DataFrame:
    """For the query set (ids divisible by 100) the best match in its group; itself, with 1, where none reaches 0.55."""
    e = table(spark, folder, "embeddings")
    best = vectors.best_matches(e, e.where("vec_id % 100 = 0"), "vec_id", "label", "embedding")
    ok = F.col("cosine") >= 0.55
    return best.select("query", F.when(ok, F.col("match")).otherwise(F.col("query")).alias("match"), F.when(ok, F.col("cosine")).otherwise(1.0).alias("cosine"))


_CENT = "(select label, list(m order by pos) as c from (select label, pos, avg(x::double) as m from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings) group by 1, 2) group by label)"


@query("centroids", f"select label, round(c[1] / sqrt(list_sum(list_transform(c, lambda x: x * x))), 5) as first, round(list_sum(c) / sqrt(list_sum(list_transform(c, lambda x: x * x))), 5) as total from {_CENT}")
def centroids(spark: SparkSession, folder: str) -> DataFrame:
    c = vectors.centroids(table(spark, folder, "embeddings"), "label", "embedding")
    return c.select("label", F.round(F.element_at("centroid", 1), 5).alias("first"), F.round(F.aggregate("centroid", F.lit(0.0), lambda a, b: a + b), 5).alias("total"))


@query(
    "nearest_centroid",
    f"select query, match, cosine from (select e.vec_id as query, k.label::bigint as match, round(list_cosine_similarity(e.embedding::double[], k.c), 6) as cosine, row_number() over (partition by e.vec_id order by round(list_cosine_similarity(e.embedding::double[], k.c), 6) desc, k.label) as r from embeddings e, {_CENT} k) where r = 1 and cosine >= 0.1",
)
def nearest_centroid(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector's nearest centroid, where it is near enough. The centroids (one a label) are the streamed side."""
    e = table(spark, folder, "embeddings")
    c = vectors.centroids(e, "label", "embedding")
    near = vectors.nearest_of(e, c, "vec_id", "embedding", "label", "centroid")
    return near.where(F.col("cosine") >= 0.1)


@query(
    "pairwise_mean_similarity",
    "select label, count(*) * 2 as pairs, round(avg(list_dot_product(a.embedding::double[], b.embedding::double[])), 5) as mean_similarity from embeddings a join embeddings b using (label) where a.vec_id < b.vec_id group by label",
)
def pairwise_mean_similarity(spark: SparkSession, folder: str) -> DataFrame:
    s = vectors.mean_pair_similarity(table(spark, folder, "embeddings"), "label", "embedding")
    return s.select("label", (F.col("n") * (F.col("n") - 1)).alias("pairs"), F.round("mean_similarity", 5).alias("mean_similarity"))


@query("agglomerative_clusters")
def agglomerative_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters inside each label, named in the order of their size."""
    c = vectors.agglomerate(table(spark, folder, "embeddings"), "label", "vec_id", "embedding", cut=0.9)
    n = c.groupBy("label", "cluster").agg(F.count("*").alias("n"))
    w = Window.partitionBy("label").orderBy(F.desc("n"), "cluster")
    return n.withColumn("name", F.format_string("SPEAKER_%02d", F.row_number().over(w) - 1)).join(c, ["label", "cluster"]).select("label", "vec_id", "cluster", "name", "n")
