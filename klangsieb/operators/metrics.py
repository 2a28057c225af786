"""Error rates, intervals, percentiles and means as the reports need them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from klangsieb.functions.edit import edit_distance
from klangsieb.operators.ordered import position


@F.pandas_udf(T.IntegerType())
def word_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits between two arrays of words; null counts as empty."""
    return pd.Series([edit_distance([] if x is None else list(x), [] if y is None else list(y)) for x, y in zip(a, b)], dtype="int32")


def char_edits(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def error_rate(edits: Column, length: Column) -> Column:
    return edits / F.greatest(length, F.lit(1))


def valid(x: Column) -> Column:
    """Null for NaN."""
    return F.when(~F.isnan(x), x)


def mean_valid(x: Column) -> Column:
    """Mean without null and NaN, null if nothing is left."""
    return F.avg(valid(x))


def ratio_of_sums(errors: Column, length: Column) -> Column:
    return F.sum(errors) / F.when(F.sum(length) > 0, F.sum(length))


def bootstrap(df: DataFrame, group: list[str], key: str, errors: Column, length: Column, resamples: int = 1000, cells: int = 512) -> DataFrame:
    """Rate and 95 % interval of ``sum(errors) / sum(length)`` per group, by resampling.

    A resample of n rows with replacement is drawn through its counts: how
    often a cell of rows occurs. Rows are first summed into at most ``cells``
    cells per group by hash, each (cell, resample) pair gets a Poisson(1)
    count from a hash, and the resample's rate is the ratio of its sums. So
    the work per group is ``cells * resamples``, however many rows there are,
    and with fewer rows than cells it is nearly the Poisson bootstrap of the
    rows themselves.
    """
    cell = F.pmod(F.conv(F.substring(F.sha1(F.concat(F.lit("cell:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(cells))
    sums = df.groupBy(*group, cell.alias("cell")).agg(F.sum(errors).alias("e"), F.sum(length).alias("n"), F.count("*").alias("rows"))
    total = sums.groupBy(*group).agg((F.sum("e") / F.sum("n")).alias("rate"), F.sum("rows").alias("rows"))
    drawn = sums.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    u = F.conv(F.substring(F.sha1(F.concat_ws(":", "b", "cell")), 1, 8), 16, 10).cast("double") / 4294967296.0
    times, upto, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(8):
        upto += term
        times = times + F.when(u >= upto, 1).otherwise(0)
        term /= k + 1
    rates = drawn.groupBy(*group, "b").agg((F.sum(F.col("e") * times) / F.when(F.sum(F.col("n") * times) > 0, F.sum(F.col("n") * times))).alias("r"))
    ends = rates.groupBy(*group).agg(F.percentile("r", F.lit(0.025)).alias("low"), F.percentile("r", F.lit(0.975)).alias("high"))
    return total.join(ends, group)


def index_percentiles(df: DataFrame, group: list[str], value: str, key: str) -> DataFrame:
    """Values at fixed places of the sorted list: first, n//20, n//2, n - ceil(n/20), last.

    Places are looked up by rank, so no group's values are gathered in one list.
    """
    ranked = position(df.where(F.col(value).isNotNull() & ~F.isnan(value)), [F.col(value), F.col(key)], by=group, out="_r")
    sizes = ranked.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.count("*").alias("_n"))
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    rows = ranked.join(sizes, on)
    n, at = F.col("_n"), F.col("_r") - 1
    places = {"least": F.lit(0), "p5": F.floor(n / 20), "median": F.floor(n / 2), "p95": n + F.floor(-n / F.lit(20.0)), "most": n - 1}
    return rows.groupBy(*group).agg(*[F.max(F.when(at == p, F.col(value))).alias(name) for name, p in places.items()])


def batch_mean(df: DataFrame, group: list[str], key: str, value: str, size: int) -> DataFrame:
    """Mean of the means of consecutive batches of ``size`` rows; a short last batch weighs as much as the others."""
    placed = position(df, [F.col(key)], by=group, out="_p")
    batches = placed.groupBy(*group, F.floor((F.col("_p") - 1) / size).alias("_b")).agg(F.avg(value).alias("m"))
    return batches.groupBy(*group).agg(F.avg("m").alias("macro"), F.count("*").alias("batches"))


def first_terminal(df: DataFrame, key: str, order: str, terminal: Column) -> DataFrame:
    """Rows before the first terminal row of each key (all rows where there is none)."""
    stop = df.where(terminal).groupBy(F.col(key).alias("_k")).agg(F.min(order).alias("_stop"))
    out = df.join(stop, F.col(key) == F.col("_k"), "left").where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop")))
    return out.drop("_k", "_stop")


def share_of_total(df: DataFrame, value: str, out: str) -> DataFrame:
    return df.withColumn(out, 100.0 * F.col(value) / F.sum(value).over(Window.partitionBy()))
