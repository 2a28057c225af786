"""Joins with rules: overrides, upserts, fallbacks, late materialisation, interval overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klangsieb.operators.ordered import holding


def override(base: DataFrame, later: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` of ``base``, replaced where ``later`` (one row a key) has a value that isn't blank."""
    new = later.select(F.col(key), F.when(F.btrim(column) != "", F.col(column)).alias("_new"))
    return base.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def upsert(registry: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of the registry without those whose key comes in ``rows``, and all of ``rows``."""
    return registry.join(rows.select(key).distinct(), key, "left_anti").select(*registry.columns).unionByName(rows.select(*registry.columns))


def suffix_match(left: DataFrame, right: DataFrame, long: str, short: str) -> DataFrame:
    """Rows whose path ``long`` ends in the path ``short``: an equi-join on the file name, then the test.

    A path that ends in another has the same last part, so nothing is missed
    where ``short`` isn't empty.
    """
    name = "_file"
    a = left.withColumn(name, F.substring_index(long, "/", -1))
    b = right.withColumn(name, F.substring_index(short, "/", -1))
    return a.join(b, name).where(F.endswith(F.col(long), F.col(short))).drop(name)


def exact_or_suffix(left: DataFrame, right: DataFrame, long: str, short: str) -> DataFrame:
    """Exact matches, and for paths without one the suffix matches."""
    exact = left.join(right, F.col(long) == F.col(short))
    rest = left.join(right.select(F.col(short).alias("_k")).distinct(), F.col(long) == F.col("_k"), "left_anti")
    return exact.unionByName(suffix_match(rest, right, long, short).select(*exact.columns))


def late_materialize(spark, path: str, cheap: list[str], wide: list[str], choose) -> DataFrame:
    """Scan cheap columns with their place (file, row), choose rows, then read the wide columns of those only.

    ``choose`` maps the cheap table to a smaller one and must keep ``_file``
    and ``_row``.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    chosen = choose(spark.read.parquet(path).select(*cheap, *place))
    full = spark.read.parquet(path).select(*wide, *place)
    return chosen.join(full, ["_file", "_row"]).drop("_file", "_row")


def ordered_pairs(first: DataFrame, second: DataFrame, key: str, first_at: str, second_at: str) -> DataFrame:
    """Pairs of equal key in which the first part came before the second."""
    return first.join(second, key).where(F.col(first_at) < F.col(second_at))


def strict_join(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Inner join that fails the run where a row has no entry in ``index``."""
    mark = index.withColumn("_there", F.lit(True))
    out = rows.join(mark, key, "left")
    found = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no entry for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.lit(True))
    return out.withColumn("_there", found.cast("boolean")).where("_there").drop("_there")


def overlaps(a: DataFrame, b: DataFrame, key: str, least: float, width: float) -> DataFrame:
    """Intersections of spans (start, end) of equal ``key`` that last at least ``least``.

    Spans are cut into time cells of ``width``; a pair meets in the cells it
    shares and is kept in the first of them, so that the join is an equi-join
    on (key, cell) and yields each pair once.
    """

    def celled(df: DataFrame, p: str) -> DataFrame:
        cells = F.sequence(F.floor(F.col("start") / width).cast("bigint"), F.floor(F.col("end") / width).cast("bigint"))
        return df.where("end >= start").select(F.col(key), *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key], F.explode(cells).alias("_cell"))

    both = celled(a, "a").join(celled(b, "b"), [key, "_cell"])
    start, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    return both.where((F.floor(start / width) == F.col("_cell")) & (end - start >= least)).withColumn("start", start).withColumn("end", end).drop("_cell")


def fallback(*choices: Column) -> Column:
    """The first choice that isn't null."""
    return F.coalesce(*choices)


def dedupe_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row of each key; an empty first row still hides later ones."""
    return holding(df, key, first=order, keep=[c for c in df.columns if c != key])


def dedupe_last(df: DataFrame, key: str, order: str) -> DataFrame:
    return holding(df, key, latest=order, keep=[c for c in df.columns if c != key])
