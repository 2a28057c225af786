"""Prefix sums and ranks that never put a whole group, or the whole table, into one task."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from klangsieb.session import settle, shuffle_width

#: Rows of one group that one task's window goes over.
STRETCH = 50_000


def _null_safe(left: str, right: str, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in names:
        cond = cond & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns. Others may have any name, also one that differs in case only or comes twice (the first counts)."""
    cols = df.columns
    fold = [c.lower() for c in cols]
    at = [cols.index(n) if n in cols else fold.index(n.lower()) for n in names]
    return df.toDF(*[f"_c{i}" for i in range(len(cols))]).select(*[F.col(f"_c{i}").alias(n) for i, n in zip(at, names)])


def running_sum(
    df: DataFrame,
    value: Column,
    order: Sequence[Column | Down],
    by: Sequence[str] = (),
    out: str = "before",
    partitions: int | None = None,
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all earlier rows of the same ``by`` group.

    Two levels: rows are range-partitioned by (``by``, ``order``), so that one
    group may spread over many partitions; each partition sums for itself, and
    the few (group, partition) totals give the offsets. The ranged rows are
    checkpointed, as both levels must see the same partitioning.

    ``order`` should end in a unique column; wholly equal rows may change
    places. Null keys form a group, null values count 0. An empty table gives
    an empty result.
    """
    names = [f"_by{i}" for i in range(len(by))]
    keys = [F.col(c).alias(n) for c, n in zip(by, names)]
    marks = [c.alias(f"_o{i}") for i, c in enumerate(_bare(c) for c in order)]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *keys, *marks, F.coalesce(value, F.lit(0)).alias("_v"))
    sort = [_like(F.col(f"_o{i}"), c) for i, c in enumerate(order)]
    n = partitions or shuffle_width(df.sparkSession)
    ranged = rows.repartitionByRange(n, *names, *sort).withColumn("_part", F.spark_partition_id())
    kept = settle(ranged)
    inside = Window.partitionBy("_part", *names).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    totals = kept.groupBy("_part", *names).agg(F.sum("_v").alias("_sum"))
    earlier = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *names, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_off"))
    local = kept.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    joined = local.alias("l").join(offsets.alias("r"), _null_safe("l", "r", ["_part", *names]))
    return joined.select("l._row.*", (F.col("l._in") + F.col("r._off")).alias(out))


class Down(NamedTuple):
    """Descending order with nulls last, for the ``order`` argument of this module's functions."""

    col: Column


def _bare(c: Column | Down) -> Column:
    return c.col if isinstance(c, Down) else c


def _like(target: Column, c: Column | Down) -> Column:
    return target.desc_nulls_last() if isinstance(c, Down) else target.asc_nulls_last()


def position(df: DataFrame, order: Sequence[Column | Down], by: Sequence[str] = (), out: str = "rank", partitions: int | None = None) -> DataFrame:
    """Adds ``out``: 1 for the first row of each ``by`` group in ``order``, 2 for the next, and so on."""
    ranked = running_sum(df, F.lit(1).cast("bigint"), order, by, out="_before", partitions=partitions)
    return ranked.withColumn(out, F.col("_before") + 1).drop("_before")


def stretches(df: DataFrame, by: Sequence[str], order: Sequence[Column | Down], halo: int, size: int = STRETCH) -> DataFrame:
    """Cut each group, in order, into stretches of ``size`` rows that also hold the last ``halo`` rows of the one before.

    Adds ``_stretch``, ``_place`` and ``_own`` (false for the repeated rows).
    A window over (``by``, ``_stretch``) ordered by ``_place`` that looks back
    at most ``halo`` rows is then right for all own rows, and a hot group is
    the work of many tasks.
    """
    placed = position(df, order, by, out="_place")
    at = F.floor((F.col("_place") - 1) / size)
    late = (F.col("_place") - 1) % size >= size - halo
    both = placed.withColumn("_stretch", F.explode(F.when(late, F.array(at, at + 1)).otherwise(F.array(at))))
    return both.withColumn("_own", F.col("_stretch") == at)


#: Types that an aggregate by hash can hold, and those of them that order rows as whole numbers.
_FIXED = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")
_WHOLE = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "bigint", "date": "date", "timestamp": "timestamp"}


def _rank(order: str, kind: str, keep: Sequence[str], lowest: bool) -> Column:
    """A decimal that orders rows by ``order``, then by a hash of the kept values; rows without ``order`` come last."""
    at = F.col(f"`{order}`")
    number = {"date": F.unix_date, "timestamp": F.unix_micros}.get(_WHOLE[kind], lambda c: c)(at).cast("decimal(20,0)")
    wide = F.lit(str(1 << 63)).cast("decimal(19,0)")
    values = [F.col(f"`{c}`") for c in keep]
    tie = F.xxhash64(*[v.isNull() for v in values], *values).bitwiseAND(F.lit((1 << 63) - 1))
    beyond = F.lit(str(1 << 63 if lowest else -(1 << 63) - 1)).cast("decimal(20,0)")
    return (F.coalesce(number, beyond).cast("decimal(19,0)") * wide + tie.cast("decimal(19,0)")).cast("decimal(38,0)")


def holding(df: DataFrame, key: str, latest: str | None = None, first: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row per non-null ``key``: that with the greatest ``latest`` or the least ``first``.

    Copies of a hot key are folded before the shuffle. Values of fixed width
    are folded by hash, without a sort: name in ``keep`` only what is needed,
    as a single text column makes it a sorted fold of structs. Rows with equal
    ordering values give one of them as a whole, always the same one; a null in
    the ordering column loses against any value.
    """
    by = latest or first
    src = only(df, *dict.fromkeys([key, by, *keep])).where(F.col(key).isNotNull())
    kinds = dict(src.dtypes)
    if not keep:
        return src.select(key).distinct()
    if kinds[by] in _WHOLE and all(kinds[c] in _FIXED for c in keep):
        ranked = src.withColumn("_rank", _rank(by, kinds[by], keep, lowest=not latest))
        pick = F.max_by if latest else F.min_by
        return ranked.groupBy(F.col(key)).agg(*[pick(F.col(f"`{c}`"), "_rank").alias(c) for c in keep])
    cols = [F.col(f"`{c}`") for c in keep]
    if latest:
        one = F.max(F.struct(F.col(by).alias("_o"), *cols))
    else:
        one = F.min(F.struct(F.col(by).isNull().alias("_n"), F.col(by).alias("_o"), *cols))
    return src.groupBy(F.col(key)).agg(one.alias("_h")).select(key, *[F.col(f"_h.`{c}`").alias(c) for c in keep])
