"""Mixing sources to target shares by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klangsieb.operators.ordered import holding, only, running_sum
from klangsieb.session import settle

#: Expected copies are held in units of 2**-24, so that their prefix sums are exact.
UNIT_BITS = 24


def source_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def mix_to_shares(
    items: DataFrame,
    targets: DataFrame,
    item: str = "idx",
    source: str = "corpus",
    size: str = "dur_proc_s",
    seed: str = "mix",
    total: float | None = None,
    fit: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Draw a mix in which each source of ``targets`` has its share of the total size.

    ``items``: one row per item with ``source`` and ``size``; ``targets``:
    (name, target_share, max_repeat), one row per source. Returns ``(mix,
    report)``: ``mix`` has (item, source, size, copies) of every item drawn at
    least once, ``report`` one row per target with what was there, expected and
    reached, and ``limited`` where the repeat cap keeps a source below its
    share.

    Each item of a source expects ``min(max_repeat, target_share * total /
    available)`` copies (``total``: by default the size of all items, also of
    sources without a target). Items are ordered by size (ties by hash and
    id), the expected copies are prefix-summed within the source, one offset
    per source and seed is added, and an item is emitted once per whole number
    that its interval crosses: each item gets the whole number below or above
    its expectation, and the size drawn stays within about one item of the
    expected one. With ``fit`` the total is lowered, if need be, to the
    greatest at which every source that has items reaches its share; without
    it sources that are limited fall short and the others keep their size.

    Null, negative or NaN sizes count 0; items with a null id or source are
    left out; a source that isn't in ``targets`` isn't drawn from, repeated
    target rows count once, a null share or cap counts 0. Without any items
    the report still has all targets. The prefix sums are range-partitioned,
    so a source with most of the rows is spread over all tasks; only the
    per-source totals (one row per target) are joined back.
    """
    size_of = F.when((F.col(size) > 0) & ~F.isnan(size), F.col(size)).otherwise(0.0)
    items, targets = only(items, item, source, size), only(targets, "name", "target_share", "max_repeat")
    src = settle(items.where(F.col(item).isNotNull() & F.col(source).isNotNull()).select(F.col(item).alias("item"), source_key(F.col(source)).alias("source"), size_of.cast("double").alias("size")))  # read for the totals, the sums and the draw
    goal = targets.where(F.col("name").isNotNull()).groupBy("name").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeat", F.lit(0))).alias("max_repeat"))
    goal = goal.withColumn("source", source_key(F.col("name")))

    have = src.groupBy("source").agg(F.count("*").alias("n_items"), F.sum(F.col("size").cast("decimal(18,6)")).alias("d"))
    whole = F.lit(total) if total is not None else F.coalesce(F.col("t"), F.lit(0.0))
    every = have.agg(F.sum("d").cast("double").alias("t"))
    plan = goal.join(have, "source", "left").crossJoin(F.broadcast(every))  # one row
    plan = plan.select(
        "name", "source", "target_share", "max_repeat",
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce(F.col("d").cast("double"), F.lit(0.0)).alias("available"), whole.alias("whole"),
    )
    if fit:
        most = plan.where("available > 0 and target_share > 0").agg(F.min(F.col("max_repeat") * F.col("available") / F.col("target_share")).alias("most"))
        plan = plan.crossJoin(F.broadcast(most)).withColumn("whole", F.least("whole", "most"))  # one row
    plan = plan.withColumn("target_size", F.col("target_share") * F.col("whole")).drop("whole", "most")
    wish = F.when(F.col("available") > 0, F.least(F.col("max_repeat").cast("double"), F.col("target_size") / F.col("available"))).otherwise(F.col("max_repeat").cast("double"))
    plan = plan.withColumn("expect", F.floor(wish * float(1 << UNIT_BITS) + 0.5).cast("bigint"))
    offset = F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(seed), "source")), 1, 6), 16, 10).cast("bigint")
    plan = plan.withColumn("offset", offset)  # below 2**24: a uniform part of one copy

    drawn = src.join(plan.select("source", "expect", "offset"), "source")
    summed = running_sum(drawn, F.col("expect"), [F.col("size"), F.sha1(F.concat_ws(":", F.lit(seed), "item")), F.col("item")], by=["source"])
    low = F.shiftright(F.col("before") + F.col("offset"), UNIT_BITS)
    high = F.shiftright(F.col("before") + F.col("offset") + F.col("expect"), UNIT_BITS)
    mix = summed.withColumn("copies", (high - low).cast("int")).where("copies > 0").select("item", "source", "size", "copies")

    got = mix.groupBy("source").agg(F.sum("copies").alias("copies"), F.min("copies").alias("least"), F.count("*").alias("used"), F.sum(F.col("size").cast("decimal(18,6)") * F.col("copies")).alias("g"))
    reached = plan.join(got, "source", "left")
    full = (F.col("n_items") == 0) | ((F.coalesce("used", F.lit(0)) == F.col("n_items")) & (F.col("least") == F.col("max_repeat"))) | (F.col("max_repeat") == 0)
    reached = reached.select(
        "name", "target_share", "max_repeat", "n_items", "available", "target_size",
        F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce(F.col("g").cast("double"), F.lit(0.0)).alias("reached_size"),
        # every item drawn as often as it may be, and still not enough
        (full & (F.col("max_repeat") * F.col("available") < F.col("target_size"))).alias("limited"),
    )
    all_got = reached.agg(F.sum("reached_size").alias("all_reached"))
    report = reached.crossJoin(F.broadcast(all_got)).withColumn(
        "reached_share", F.when(F.col("all_reached") > 0, F.col("reached_size") / F.col("all_reached")).otherwise(0.0)
    )
    return mix, report.drop("all_reached")


def enabled_clips(meta: DataFrame, corpora: DataFrame) -> DataFrame:
    """Holding clips of the corpora whose holding registration is enabled."""
    clips = holding(meta, "idx", latest="written_at", keep=["corpus", "dur_proc_s"]).withColumn("source", source_key(F.col("corpus")))
    on = holding(corpora, "name", latest="registered_at", keep=["enabled"]).where("enabled").select(source_key(F.col("name")).alias("source")).distinct()
    return clips.join(on, "source", "left_semi").select("idx", F.col("source").alias("corpus"), "dur_proc_s")
