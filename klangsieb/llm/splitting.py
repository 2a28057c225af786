"""Splits that keep related records together: components, largest differencing, allocation of bins."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klangsieb.operators.ordered import only
from klangsieb.session import settle

#: Many equal bins; components differenced by one task; partial results that one task combines.
BINS = 200
CHUNK = 4096
FAN_IN = 32
#: What the names of components without any value begin with: a character that no key has.
ALONE = "\x01"


def components(records: DataFrame, item: str, keys: Sequence[str]) -> DataFrame:
    """(item, component) such that records sharing a value in any of ``keys`` share the component.

    With one key the component is its value. With several, values that occur
    on one record are linked, and the links are contracted to stars by
    alternating large and small stars over the distinct values, each round
    checkpointed; a hot value is only ever one node. A record without any
    value is a component of its own, its name beginning with ``ALONE``. Other
    components are named by their least (key number, value) pair; a null item
    keeps its row.
    """
    records = only(records, *dict.fromkeys([item, *keys]))
    named = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}:" if len(keys) > 1 else ""), F.col(k).cast("string"))) for i, k in enumerate(keys)]
    alone = F.concat(F.lit(ALONE), F.coalesce(F.col("item").cast("string"), F.lit("")))
    if len(keys) == 1:
        return records.select(F.col(item).alias("item"), named[0].alias("_first")).select("item", F.coalesce("_first", alone).alias("component"))
    rows = records.select(F.col(item).alias("item"), F.array_compact(F.array(*named)).alias("_v"))
    rows = rows.withColumn("_first", F.when(F.size("_v") > 0, F.array_min("_v")))
    links = rows.where(F.size("_v") > 1).select("_first", F.explode("_v").alias("b")).where("_first <> b").select(F.col("_first").alias("a"), "b").distinct()
    root = star_contraction(links)
    return rows.join(root.withColumnRenamed("node", "_first"), "_first", "left").select("item", F.coalesce("root", "_first", alone).alias("component"))


def star_contraction(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of the undirected ``links`` (a, b): root is the least node of its component."""
    edges, before = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), None
    for _ in range(most_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        edges = settle(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct())
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if before == seen:
            break
        before = seen
    else:
        raise RuntimeError(f"links aren't contracted after {most_rounds} rounds")
    stars = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return stars.union(stars.select(F.col("root").alias("node"), "root")).distinct()


def largest_differencing(groups: list[np.ndarray], bins: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Combine partial partitions until one is left, always the two of the greatest spread.

    Each of ``groups`` is a partial partition: the sums of its (at most
    ``bins``) bins. Combining puts the heaviest bin of one onto the lightest
    of the other. Returns the sums and, per group, the final bin of each of
    its bins. Ties go to the lower group number.
    """
    if not groups:
        return np.zeros(bins, np.int64), []
    heap, where = [], []
    nodes: list[np.ndarray] = []  # sums, heaviest first
    for g, sums in enumerate(groups):
        full = np.zeros(bins, np.int64)
        order = np.argsort(-sums, kind="stable")
        full[: len(sums)] = sums[order]
        place = np.empty(len(sums), np.int64)
        place[order] = np.arange(len(sums))
        where.append(place)
        nodes.append(full)
        heap.append((-(int(full[0]) - int(full[-1])), g))
    heapq.heapify(heap)
    maps: dict[int, tuple[int, np.ndarray]] = {}  # node -> (parent, place of each of its bins there)
    while len(heap) > 1:
        _, x = heapq.heappop(heap)
        _, y = heapq.heappop(heap)
        sums = nodes[x] + nodes[y][::-1]
        order = np.argsort(-sums, kind="stable")
        place = np.empty(bins, np.int64)
        place[order] = np.arange(bins)
        z = len(nodes)
        nodes.append(sums[order])
        maps[x], maps[y] = (z, place), (z, place[::-1])
        heapq.heappush(heap, (-(int(nodes[z][0]) - int(nodes[z][-1])), z))
    root = heap[0][1]
    final: dict[int, np.ndarray] = {root: np.arange(bins)}
    for node in range(root - 1, -1, -1):  # parents have the higher numbers
        if node in maps:
            parent, place = maps[node]
            final[node] = final[parent][place]
    return nodes[root], [final[g][where[g]] for g in range(len(groups))]


def _difference(bins: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "component"], ascending=[False, True], kind="stable")
        _, to = largest_differencing([np.array([w], np.int64) for w in pdf["weight"]], bins)
        return pd.DataFrame({"component": pdf["component"], "weight": pdf["weight"], "chunk": pdf["chunk"], "bin": [int(t[0]) for t in to]})

    return run


def _combine(bins: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chunk", "bin"], kind="stable")
        parts = [(c, g) for c, g in pdf.groupby("chunk", sort=True)]
        _, to = largest_differencing([g["weight"].to_numpy(np.int64) for _, g in parts], bins)
        rows = [pd.DataFrame({"chunk": c, "bin": g["bin"], "up": g["up"], "to": t, "weight": g["weight"]}) for (c, g), t in zip(parts, to)]
        return pd.concat(rows)

    return run


def allocate(weights: dict[int, int], shares: dict[str, float]) -> dict[int, str]:
    """Whole bins to splits: the heaviest first, each to the split that lacks the most of its target."""
    total = sum(weights.values())
    left = {s: share * total for s, share in shares.items()}
    out = {}
    for b in sorted(weights, key=lambda b: (-weights[b], b)):
        best = max(left, key=lambda s: left[s])
        out[b] = best
        left[best] -= weights[b]
    return out


def balanced_splits(members: DataFrame, shares: dict[str, float], bins: int = BINS, chunk: int = CHUNK) -> DataFrame:
    """Assign whole components to splits; ``members`` is (item, component), the output (component, weight, bin, split).

    Components are hashed to chunks of about ``chunk``; each chunk is put into
    ``bins`` bins by largest differencing, then the chunks' bins are combined
    ``FAN_IN`` at a time in the same way until one set of equal bins is left,
    and whole bins go to the splits. Components never reach the driver, only
    the final ``bins`` weights do. Without members the result is empty. A
    component larger than a bin makes its bin that large; the split that lacks
    most takes it.
    """
    weights = settle(members.groupBy("component").agg(F.count("*").alias("weight")))
    n = weights.count()
    chunks = max(1, math.ceil(n / chunk))
    placed = settle(
        weights.withColumn("chunk", F.pmod(F.xxhash64("component"), F.lit(chunks)))
        .groupBy("chunk")
        .applyInPandas(_difference(bins), "component string, weight bigint, chunk bigint, bin bigint")
    )
    sums = placed.groupBy("chunk", "bin").agg(F.sum("weight").alias("weight"))
    to = sums.select("chunk", "bin", F.col("chunk").alias("at"), F.col("bin").alias("to"))  # original bin -> present bin
    while chunks > 1:
        chunks = math.ceil(chunks / FAN_IN)
        level = settle(sums.withColumn("up", F.floor(F.col("chunk") / FAN_IN)).groupBy("up").applyInPandas(_combine(bins), "chunk bigint, bin bigint, up bigint, to bigint, weight bigint"))
        move = level.select(F.col("chunk").alias("at"), F.col("bin").alias("to"), F.col("up").alias("at2"), F.col("to").alias("to2"))
        to = to.join(move.hint("merge"), ["at", "to"]).select("chunk", "bin", F.col("at2").alias("at"), F.col("to2").alias("to"))
        sums = level.groupBy(F.col("up").alias("chunk"), F.col("to").alias("bin")).agg(F.sum("weight").alias("weight"))
    final = {r["bin"]: r["weight"] for r in sums.collect()}  # at most `bins` rows
    split_of = allocate(final, shares)
    table = members.sparkSession.createDataFrame([(int(b), s) for b, s in split_of.items()], "to bigint, split string")
    return placed.join(to.hint("merge"), ["chunk", "bin"]).join(F.broadcast(table), "to").select("component", "weight", F.col("to").alias("bin"), "split")


def split_report(members: DataFrame, present: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row per component: its new split, and the present splits of its records with ``n_present``.

    ``present``: (item, split), possibly several rows per item; items without
    a row there, and rows of unknown items, don't count.
    """
    now = members.join(present.select("item", "split").distinct(), "item").groupBy("component").agg(F.array_sort(F.collect_set("split")).alias("present"))
    out = assigned.join(now, "component", "left")
    return out.withColumn("n_present", F.when(F.col("present").isNull(), 0).otherwise(F.size("present")))


def split_name(c):
    """Trimmed lower-case name of a split; null if it isn't train, val or test."""
    s = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(s.isin("train", "val", "test"), s)
