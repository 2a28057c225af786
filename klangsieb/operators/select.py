"""Selection: budgets, caps, strides, stratified splits, weighted draws, quota cover."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from klangsieb.functions.hashing import digest_mod, hash_order
from klangsieb.operators.ordered import position, running_sum
from klangsieb.session import settle


def round_robin_budget(df: DataFrame, group: str, key: str, amount: Column, budget: int) -> DataFrame:
    """One item per group in turn, in the hash order of ``key``, until the amount before an item reaches ``budget``.

    ``amount`` must be a whole number, so that sums don't depend on how they
    are split. Adds ``turn`` and ``before``. Both the turns within a group and
    the running total over all items are range-partitioned sums, so neither a
    dominant group nor the whole table is one task's work. Null groups form a
    group; equal keys are told apart by nothing and may change places.
    """
    turns = position(df.withColumn("_a", amount.cast("bigint")), [hash_order(F.col(key)), F.col(key)], by=[group], out="turn")
    total = running_sum(turns, F.col("_a"), [F.col("turn"), F.col(group), F.col(key)], out="before")
    return total.where(F.col("before") < budget).drop("_a")


def best_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group. The limit is applied before the shuffle as well, so a hot group shrinks where it lies."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(out) <= k)


def stratified_split(df: DataFrame, stratum: str, key: str, small: int = 40, shares: tuple[float, float] = (0.9, 0.95)) -> DataFrame:
    """Per stratum in hash order: the first 90 % train, up to 95 % val, the rest test; strata below ``small`` are all train."""
    placed = position(df, [hash_order(F.col(key)), F.col(key)], by=[stratum], out="_p")
    n = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    out = placed.join(n, F.col(stratum).eqNullSafe(F.col("_s")))
    at = F.col("_p") - 1
    split = F.when((F.col("_n") < small) | (at < F.floor(F.col("_n") * shares[0])), "train").when(at < F.floor(F.col("_n") * shares[1]), "val").otherwise("test")
    return out.withColumn("split", split).drop("_p", "_n", "_s")


def strided_sample(df: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """About ``n`` rows, each stratum in proportion: every step-th row in the order of ``key``, at least one a stratum."""
    placed = position(df, [F.col(key)], by=[stratum], out="_p")
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_t"))
    plan = sizes.crossJoin(F.broadcast(total))  # one row
    plan = plan.withColumn("_k", F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("_n") / F.col("_t"), 0).cast("bigint")))
    plan = plan.withColumn("_step", F.greatest(F.lit(1), F.floor(F.col("_n") / F.col("_k")).cast("bigint"))).select("_s", "_k", "_step")
    out = placed.join(plan, F.col(stratum).eqNullSafe(F.col("_s")))
    at = F.col("_p") - 1
    return out.where((at % F.col("_step") == 0) & (at / F.col("_step") < F.col("_k"))).drop("_p", "_s", "_k", "_step")


def pick_partner(df: DataFrame, group: str, key: str, prefix: str = "ref:") -> DataFrame:
    """Another row of the same group for every row, by the row's digest modulo the number of the others; itself where there is none.

    Rows of a group are numbered by ``key``; the place drawn is looked up by
    an equi-join on (group, number), so a big group costs no more than its
    rows. Adds ``partner``.
    """
    numbered = settle(position(df, [F.col(key)], by=[group], out="_p"))
    sizes = numbered.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    rows = numbered.join(sizes, F.col(group).eqNullSafe(F.col("_g")))
    j = F.when(F.col("_n") > 1, digest_mod(F.concat(F.lit(prefix), F.col(key)), F.col("_n") - 1))
    rows = rows.withColumn("_j", j + F.when(j + 1 >= F.col("_p"), 2).otherwise(1))
    others = numbered.select(F.col(group).alias("_og"), F.col("_p").alias("_op"), F.col(key).alias("partner"))
    out = rows.join(others, F.col(group).eqNullSafe(F.col("_og")) & (F.col("_j") == F.col("_op")), "left")
    return out.withColumn("partner", F.coalesce("partner", F.col(key))).drop("_p", "_g", "_n", "_j", "_og", "_op")


def weighted_draws(df: DataFrame, key: str, weight: Column, draws: int, seed: str, buckets: int = 1024) -> DataFrame:
    """``draws`` draws with replacement in proportion to whole-number weights: (draw, key).

    Draw d takes the row in whose stretch of the running weights its hashed
    uniform falls. Rows and draws meet in buckets of equal width, so that the
    range condition becomes an equi-join. No weight gives no draws.
    """
    summed = running_sum(df.select(F.col(key).alias("key"), weight.cast("bigint").alias("w")).where("w > 0"), F.col("w"), [F.col("key")], out="low")
    total = df.agg(F.coalesce(F.sum(F.when(weight > 0, weight)), F.lit(0)).cast("bigint").alias("t")).first()["t"]
    if not total:
        return summed.select(F.lit(0).cast("bigint").alias("draw"), "key").limit(0)
    width = -(-total // buckets)
    rows = summed.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("low") + F.col("w") - 1) / width))))
    u = F.floor(F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(seed), F.col("id"))), 1, 8), 16, 10).cast("double") / 4294967296.0 * float(total)).cast("bigint")
    d = df.sparkSession.range(draws).withColumn("u", u).withColumn("bucket", F.floor(F.col("u") / width))
    return d.join(rows, "bucket").where("u >= low and u < low + w").select(F.col("id").alias("draw"), "key")


def passage_from(df: DataFrame, group: str, order: str, amount: Column, start: int, least: int) -> DataFrame:
    """Per group the rows from the ``start``-th on, until their amounts reach ``least``, with the row that crosses it."""
    placed = position(df.withColumn("_a", amount.cast("bigint")), [F.col(order)], by=[group], out="_p").where(F.col("_p") >= start)
    return running_sum(placed, F.col("_a"), [F.col(order)], by=[group], out="before").where(F.col("before") < least).drop("_p", "_a")


def quota_cover(index: DataFrame, quota: int, budget: float, cap: int | None = None) -> DataFrame:
    """Greedy cover: words by priority take their clips in order until each has ``quota`` clips.

    ``index``: (word, priority, clip, clip_order, amount), a row per word of a
    clip. A clip taken counts for all its words; a clip is skipped once the
    total amount would exceed ``budget``. With ``cap``, ``index`` has a
    ``speaker`` too: once ``cap`` clips of a speaker are taken, the others are
    skipped, and the word goes on to its next clip. Output: (clip, word,
    pick), word being the one it was taken for.

    The fold is sequential, but a word never reaches beyond its first
    ``quota`` clips: each of those is taken for it or was taken before, and
    then counts. With ``cap`` the same holds for its clips of one speaker, and
    for the first ``cap`` of them: when they are taken the speaker is full. So
    only words x quota rows (a speaker) go to the one task, however many clips
    there are. It sorts them on disk where they don't fit, reads them in
    batches and holds only counters of words and speakers and the names of
    the clips taken. (A budget that runs out only ends the fold.)
    """
    by, most = (["word"], quota) if cap is None else (["word", "speaker"], min(quota, cap))
    ranked = best_per_group(index.withColumn("speaker", F.lit(None).cast("string")) if cap is None else index, by, [F.col("clip_order"), F.col("clip")], most)
    clips = ranked.select("clip").distinct()
    needed = index.join(clips, "clip", "left_semi").groupBy("clip").agg(F.collect_set("word").alias("words"), F.max("amount").alias("amount"))
    rows = ranked.join(needed.withColumnRenamed("amount", "_m"), "clip").select("word", "priority", "clip_order", "clip", "speaker", "words", F.col("_m").alias("amount"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: dict[str, int] = {}
        of: dict[str | None, int] = {}
        seen: set[str] = set()
        spent = 0.0
        for pdf in batches:
            taken: list[tuple[str, str, int]] = []
            for word, clip, speaker, words, amount in zip(pdf["word"], pdf["clip"], pdf["speaker"], pdf["words"], pdf["amount"]):
                if left.get(word, quota) <= 0 or clip in seen or spent + amount > budget or (cap is not None and of.get(speaker, 0) >= cap):
                    continue
                seen.add(clip)
                spent += amount
                of[speaker] = of.get(speaker, 0) + 1
                for w in words:
                    left[w] = left.get(w, quota) - 1
                taken.append((clip, word, len(seen)))
            yield pd.DataFrame(taken, columns=["clip", "word", "pick"])

    return rows.repartition(1).sortWithinPartitions("priority", "word", "clip_order", "clip").drop("priority", "clip_order").mapInPandas(fold, "clip string, word string, pick int")


def admit(df: DataFrame, key: str, order: Column, speaker: str, cap: int, amount: Column, budget: int) -> DataFrame:
    """Rows in ``order`` (a hash, say) as long as their speaker has fewer than ``cap`` and the whole is below ``budget``.

    The same as taking them one by one: a speaker's first ``cap`` rows are
    those that may come in, and of these all whose predecessors' amounts
    (whole numbers) stay below the budget.
    """
    some = best_per_group(df.withColumn("_o", order).withColumn("_a", amount.cast("bigint")), [speaker], [F.col("_o"), F.col(key)], cap).drop("rank")
    return running_sum(some, F.col("_a"), [F.col("_o"), F.col(key)], out="before").where(F.col("before") < budget).drop("_o", "_a")


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails (is true); null where none does. Null checks don't fail."""
    out = F.lit(None).cast("string")
    for name, bad in reversed(checks):
        out = F.when(bad, name).otherwise(out)
    return out

