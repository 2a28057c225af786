"""Capping records per dominant contributor by water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from klangsieb.operators.ordered import Down, only, position
from klangsieb.session import settle


def speaker_key(c: Column) -> Column:
    """Trimmed, lower case, runs of blanks, ``-`` and ``_`` as one ``-``, the number without leading zeros; null if blank."""
    s = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s_-]+", "-")
    return F.when(F.length(s) > 0, F.regexp_replace(s, r"(^|[^0-9])0+([0-9]+)$", "$1$2"))


def water_level(counts: DataFrame, max_count: int | None, max_share: float) -> DataFrame:
    """One row: the ``level`` at which every contributor's records are cut off.

    ``counts`` has one ``n`` per contributor. With level L the output has
    ``sum(min(n, L))`` records; the level is the greatest whole number for
    which no contributor exceeds ``max_share`` of that output, and not above
    ``max_count``. It is found on the sorted counts: between two neighbouring
    counts the output is ``below + L * above``, so the greatest L with
    ``L <= max_share * output`` has a closed form in each interval. Where the
    share can't be met at all (fewer than ``1 / max_share`` contributors) the
    level is 1, the flattest output there is. Distinct counts number at most
    the square root of twice the records, so that their sorted list is small.
    """
    hist = counts.groupBy("n").agg(F.count("*").alias("m"))
    up = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = hist.select(
        "n",
        F.sum(F.col("n") * F.col("m")).over(up).alias("below"),
        (F.sum("m").over(everything) - F.sum("m").over(up)).alias("above"),
        F.coalesce(F.lead("n").over(Window.orderBy("n")), F.col("n")).alias("next"),
    )
    free = 1.0 - F.lit(float(max_share)) * F.col("above")
    # in [n, next) the output is below + L * above; the least interval starts at 0
    inside = F.when(free <= 1e-12, F.col("next")).otherwise(F.floor(F.lit(float(max_share)) * F.col("below") / free + 1e-9))
    best = F.when(inside >= F.col("n"), F.least(inside, F.col("next"))).otherwise(0)
    first = counts.agg(F.count("*").alias("k"), F.min("n").alias("lowest"))
    flat = F.when(F.col("k") * float(max_share) >= 1.0 - 1e-12, F.col("lowest")).otherwise(0)
    level = steps.agg(F.max(best).alias("b")).crossJoin(first).select(F.greatest(F.coalesce("b", F.lit(0)), F.coalesce(flat, F.lit(0)), F.lit(1)).cast("bigint").alias("level"))
    return level if max_count is None else level.select(F.least("level", F.lit(int(max_count)).cast("bigint")).alias("level"))


def cap_contributors(
    records: DataFrame, item: str, contributor: str, quality: str, max_count: int | None = None, max_share: float = 1.0, partitions: int | None = None
) -> DataFrame:
    """Every record with ``kept``: the best ``level`` records of each contributor stay.

    Best is the highest ``quality`` (null and NaN last), then the lowest
    ``item``. Output: (item, contributor, quality, rank, level, kept). Records
    without a contributor are no one's and all stay, with null rank; repeated
    rows count once; a null item sorts last. No records give no rows. Ranks
    come from range-partitioned prefix sums: a contributor with a third of
    all records is ranked by many tasks.
    """
    q = F.col(quality).cast("double")
    rows = settle(only(records, *dict.fromkeys([item, contributor, quality])).select(F.col(item).alias("item"), F.col(contributor).alias("contributor"), F.when(~F.isnan(q), q).alias("quality")).distinct())
    owned = rows.where(F.col("contributor").isNotNull())
    counts = owned.groupBy("contributor").agg(F.count("*").alias("n"))
    level = water_level(counts, max_count, max_share)
    ranked = position(owned, [Down(F.col("quality")), F.col("item")], by=["contributor"], partitions=partitions)
    ranked = ranked.crossJoin(F.broadcast(level)).withColumn("kept", F.col("rank") <= F.col("level"))  # one row
    free = rows.where(F.col("contributor").isNull())
    return ranked.unionByName(free.select("*", F.lit(None).cast("bigint").alias("rank"), F.lit(None).cast("bigint").alias("level"), F.lit(True).alias("kept")))
