"""Vectors: best matches of a query set in blocks, centroids, mean similarities, clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klangsieb.functions.arrays import cosine

#: Query vectors held by a task at once; members of a group up to which all similarities are held at once.
BLOCK = 4096
CLUSTER_CHUNK = 1500


def _blocks(queries: DataFrame, size: int, kind: type = np.float32) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    ids, groups, rows = [], [], []
    for r in queries.toLocalIterator():
        ids.append(r[0])
        groups.append(r[1])
        rows.append(np.asarray(r[2], kind))
        if len(ids) == size:
            yield np.array(ids), np.array(groups), np.stack(rows)
            ids, groups, rows = [], [], []
    if ids:
        yield np.array(ids), np.array(groups), np.stack(rows)


def best_matches(base: DataFrame, queries: DataFrame, item: str, group: str, vector: str, block: int = BLOCK) -> DataFrame:
    """For every query the most similar other vector of its group: (query, match, cosine).

    The stated query set is streamed in blocks of ``block`` vectors; for each,
    every task compares its rows with the block by one matrix product and
    keeps the best row per query, so no pair is materialized and only one
    candidate per query and batch is shuffled. Equal similarities (to six
    digits) go to the lower id. Null vectors and ids are left out.
    """
    cols = [F.col(item).cast("bigint").alias("item"), F.col(group).cast("bigint").alias("grp"), F.col(vector).cast("array<float>").alias("vec")]
    rows = base.where(F.col(item).isNotNull() & F.col(vector).isNotNull()).select(*cols)
    wanted = queries.where(F.col(item).isNotNull() & F.col(vector).isNotNull()).select(*cols)
    out = None
    for ids, groups, mat in _blocks(wanted, block):
        unit = mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-12)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, groups=groups, unit=unit) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                item_ids, grp = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
                vec = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
                vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12)
                sim = np.round(vec @ unit.astype(np.float64).T, 6)
                sim[(grp[:, None] != groups[None, :]) | (item_ids[:, None] == ids[None, :])] = -np.inf
                order = np.argsort(item_ids, kind="stable")
                best = order[np.argmax(sim[order], axis=0)]
                top = sim[best, np.arange(len(ids))]
                ok = np.isfinite(top)
                yield pa.RecordBatch.from_pydict({"query": ids[ok].astype(np.int64), "match": item_ids[best[ok]].astype(np.int64), "cosine": top[ok]})

        part = rows.mapInArrow(run, "query bigint, match bigint, cosine double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.select(F.col("item").alias("query"), F.col("item").alias("match"), F.lit(0.0).alias("cosine")).limit(0)
    best = out.groupBy("query").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "match")).alias("b"))
    return best.select("query", F.col("b.match").alias("match"), (-F.col("b.c")).alias("cosine"))


def nearest_of(rows: DataFrame, targets: DataFrame, item: str, vector: str, target: str, target_vector: str, block: int = BLOCK) -> DataFrame:
    """For every row the most similar of ``targets``: (query, match, cosine), whole numbers as ids.

    Targets are streamed in blocks; rows stay where they are, and each block
    yields one candidate per row. Ties go to the lower target.
    """
    src = rows.where(F.col(item).isNotNull() & F.col(vector).isNotNull()).select(F.col(item).cast("bigint").alias("item"), F.col(vector).cast("array<double>").alias("vec"))
    wanted = targets.select(F.col(target).cast("bigint"), F.lit(0).alias("g"), F.col(target_vector).cast("array<double>")).orderBy(target)
    out = None
    for ids, _, mat in _blocks(wanted, block, np.float64):
        unit = mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-12)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, unit=unit) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                vec = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                sim = np.round(vec @ unit.T / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12), 6)
                best = np.argmax(sim, axis=1)
                yield pa.RecordBatch.from_pydict({"query": b.column(0), "match": ids[best].astype(np.int64), "cosine": sim[np.arange(len(best)), best]})

        part = src.mapInArrow(run, "query bigint, match bigint, cosine double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return src.select(F.col("item").alias("query"), F.col("item").alias("match"), F.lit(0.0).alias("cosine")).limit(0)
    best = out.groupBy("query").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "match")).alias("b"))
    return best.select("query", F.col("b.match").alias("match"), (-F.col("b.c")).alias("cosine"))


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, pos, mean, n): component-wise means, in partial sums."""
    parts = df.select(F.col(group), F.posexplode(vector).alias("pos", "x"))
    return parts.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("n"))


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, centroid): mean vectors of length one."""
    g = mean_vectors(df, group, vector).groupBy(group).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("c"), F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("len"))
    return g.select(group, "n", F.transform("c", lambda x: x["mean"] / F.col("len")).alias("centroid"))


def mean_pair_similarity(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean dot product over all pairs of a group, without forming a pair: ``(|sum|² - sum of |v|²) / (n (n - 1))``."""
    sums = mean_vectors(df, group, vector).groupBy(group).agg(F.max("n").alias("n"), F.sum((F.col("mean") * F.col("n")) * (F.col("mean") * F.col("n"))).alias("s"))
    square = F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    own = df.groupBy(group).agg(F.sum(square).alias("q"))
    return sums.join(own, group).select(group, "n", F.when(F.col("n") > 1, (F.col("s") - F.col("q")) / (F.col("n") * (F.col("n") - 1))).alias("mean_similarity"))


def linkage_labels(vectors: np.ndarray, sizes: np.ndarray, cut: float) -> np.ndarray:
    """Average-linkage clusters by cosine distance, cut at ``cut``.

    The mean dot product between two clusters of unit vectors is the dot
    product of their means, so clusters are kept as means with sizes; each
    step merges the nearest pair. Ties go to the lower places.
    """
    n = len(vectors)
    label = np.arange(n)
    mean, size = vectors.astype(float).copy(), sizes.astype(float).copy()
    sim = mean @ mean.T
    np.fill_diagonal(sim, -np.inf)
    alive = n
    while alive > 1:
        k = int(np.argmax(sim))
        a, b = sorted(divmod(k, n))
        if 1.0 - sim[a, b] > cut:
            break
        mean[a] = (mean[a] * size[a] + mean[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        label[label == b] = a
        sim[b, :] = sim[:, b] = -np.inf
        row = mean @ mean[a]
        gone = np.isneginf(sim).all(axis=1)
        gone[a] = False
        row[gone] = -np.inf
        row[a] = -np.inf
        sim[a, :] = sim[:, a] = row
        alive -= 1
    return label


def chain_labels(vectors: np.ndarray, sizes: np.ndarray, cut: float) -> np.ndarray:
    """The same clusters as ``linkage_labels``, but for ties, without a matrix of similarities: nearest-neighbour chains.

    A chain goes on to the nearest neighbour until two clusters are each
    other's nearest; these are merged. With average linkage a merged cluster
    is never nearer to a third one than the nearer of its parts, so each such
    merge is one that the step-by-step linkage makes too, and a cluster that
    has nothing within ``cut`` is final. Memory grows with the number of
    vectors, time with its square.
    """
    up, ids = np.arange(len(vectors)), np.arange(len(vectors))
    mean, size, alive = vectors.astype(float).copy(), sizes.astype(float).copy(), np.ones(len(vectors), bool)
    chain: list[int] = []
    links: list[float] = []
    while True:
        if not chain:
            live = np.flatnonzero(alive)
            if len(live) < 2:
                break
            if 2 * len(live) < len(alive):
                ids, mean, size, alive = ids[live], mean[live], size[live], np.ones(len(live), bool)
                live = np.arange(len(ids))
            chain, links = [int(live[0])], [-np.inf]
        a = chain[-1]
        sim = mean @ mean[a]
        sim[~alive] = sim[a] = -np.inf
        b = int(sim.argmax())
        if len(chain) > 1 and (b == chain[-2] or sim[b] <= links[-1]):  # the last digit may differ between the two sides
            low, high = sorted(chain[-2:])
            del chain[-2:], links[-2:]
            mean[low] = (mean[low] * size[low] + mean[high] * size[high]) / (size[low] + size[high])
            size[low] += size[high]
            alive[high] = False
            up[ids[high]] = ids[low]
        elif 1.0 - sim[b] > cut:
            alive[a] = False
            chain, links = [], []
        else:
            chain.append(b)
            links.append(sim[b])
    for i, x in enumerate(up):  # always to a lower place
        up[i] = up[x]
    return up


def agglomerate(df: DataFrame, group: str, item: str, vector: str, cut: float = 0.45, chunk: int = CLUSTER_CHUNK) -> DataFrame:
    """(group, item, cluster): average-linkage clusters inside each group.

    Each group is clustered as a whole by one task: up to ``chunk`` members
    with all similarities at hand, a larger one by nearest-neighbour chains,
    which give the same clusters. Clusters are named by their least item; null
    vectors are left out.
    """
    rows = df.where(F.col(item).isNotNull() & F.col(vector).isNotNull())
    rows = rows.select(F.col(group).alias("grp"), F.col(item).cast("bigint").alias("part"), _unit(F.col(vector).cast("array<double>")).alias("mean"))
    kind = dict(rows.dtypes)["grp"]

    def join_parts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part", kind="stable").reset_index(drop=True)
        parts = pdf["part"].to_numpy()
        label = (linkage_labels if len(pdf) <= chunk else chain_labels)(np.stack(pdf["mean"].to_list()), np.ones(len(pdf)), cut)
        return pd.DataFrame({"grp": pdf["grp"], "item": parts, "cluster": parts[label]})

    out = rows.groupBy("grp").applyInPandas(join_parts, f"grp {kind}, item bigint, cluster bigint")
    return out.select(F.col("grp").alias(group), F.col("item").alias(item), "cluster")


def _unit(v: Column) -> Column:
    length = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda a, b: a + b))
    return F.transform(v, lambda x: x / F.greatest(length, F.lit(1e-12)))


def dissolve_small(members: DataFrame, group: str, item: str, cluster: str, weight: str, vector: str, least: float, similar: float) -> DataFrame:
    """Clusters below ``least`` in weight are dissolved: (group, item, cluster), null where a member fits nowhere.

    Members of the dissolved clusters go to the nearest centroid of the ones
    that stay, if the cosine reaches ``similar``. All small clusters are
    dissolved at once and against the centroids of the original members, so
    the outcome doesn't depend on an order. Centroids are one row a cluster
    and meet their group's members by an equi-join.
    """
    rows = members.select(F.col(group).alias("grp"), F.col(item).alias("item"), F.col(cluster).alias("c"), F.col(weight).cast("double").alias("w"), F.col(vector).cast("array<double>").alias("vec"))
    total = rows.groupBy("grp", "c").agg(F.sum("w").alias("t"))
    large = total.where(F.col("t") >= least).select("grp", "c")
    stay = rows.join(large, ["grp", "c"], "left_semi")
    keyed = stay.withColumn("key", F.struct("grp", "c"))
    heads = centroids(keyed, "key", "vec").select(F.col("key.grp").alias("grp"), F.col("key.c").alias("to"), "centroid")
    gone = rows.join(large, ["grp", "c"], "left_anti")
    sims = gone.join(heads, "grp", "left").withColumn("s", F.round(cosine(F.col("vec"), F.col("centroid")), 9))
    best = sims.groupBy("grp", "item").agg(F.max(F.struct("s", (-F.col("to")).alias("m"))).alias("b"))
    moved = best.select("grp", "item", F.when(F.col("b.s") >= similar, -F.col("b.m")).alias("c"))
    return stay.select("grp", "item", "c").unionByName(moved).select(F.col("grp").alias(group), F.col("item").alias(item), F.col("c").alias(cluster))
