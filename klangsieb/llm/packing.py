"""Filling containers of fixed capacity by a grouping genetic algorithm on islands."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from klangsieb.operators.ordered import only
from klangsieb.session import settle

CAPACITY = 8192
#: Items of one cell (a subproblem that every island of it packs), islands a cell, chromosomes an island.
CELL = 1000
ISLANDS = 3
POPULATION = 12
EPOCHS = 2
#: An epoch of an island ends after this many generations without a better chromosome, or where none better can exist.
PATIENCE = 5
#: Share of its other bins that a crossover dissolves at random.
MUTATION = 0.03
#: Islands of one task: they are seconds of work in few bytes, which would else be joined to one task.
TASK_ISLANDS = 10
#: Bins filled less than this are packed again, with those of other cells, in the next round.
WELL_FILLED = 0.998
ROUNDS = 2


class Chromosome:
    """Bins as lists of item numbers, with their fills."""

    __slots__ = ("bins", "fills")

    def __init__(self, bins: list[list[int]], fills: list[int]) -> None:
        self.bins, self.fills = bins, fills

    def fitness(self, capacity: int) -> float:
        """Mean of the squared fills: rewards full bins over even ones."""
        f = np.array([x for x in self.fills if x] or [0], float) / capacity
        return float((f * f).mean())

    def labels(self, n: int) -> list[int]:
        out = [0] * n
        for b, items in enumerate(self.bins):
            for i in items:
                out[i] = b
        return out


def best_fit(order: list[int], sizes: list[int], capacity: int, bins: list[list[int]], fills: list[int]) -> Chromosome:
    """Put items, in the order given, each where it leaves the least room; open a bin where none has room."""
    room = sorted((capacity - f, b) for b, f in enumerate(fills))
    for i in order:
        s = sizes[i]
        k = bisect.bisect_left(room, (s, -1))
        if k == len(room):
            b, free = len(bins), capacity
            bins.append([])
            fills.append(0)
        else:
            free, b = room.pop(k)
        bins[b].append(i)
        fills[b] += s
        bisect.insort(room, (free - s, b))
    return Chromosome(bins, fills)


def refill(displaced: list[int], sizes: list[int], capacity: int, bins: list[list[int]], fills: list[int]) -> Chromosome:
    """Fill the bins given, the fullest first, then new ones: with the one or two items that leave no room, else with the largest that fits."""
    stock: dict[int, list[int]] = {}
    for i in displaced:
        stock.setdefault(sizes[i], []).append(i)
    empty = stock.pop(0, [])
    order = sorted(stock)

    def take(s: int, b: int) -> None:
        bins[b].append(stock[s].pop())
        fills[b] += s
        if not stock[s]:
            del stock[s]
            order.pop(bisect.bisect_left(order, s))

    todo = sorted((b for b in range(len(bins)) if fills[b] < capacity), key=lambda b: fills[b])
    while order:
        if todo:
            b = todo.pop()
        else:
            b = len(bins)
            bins.append([])
            fills.append(0)
            take(order[-1], b)
        while order and order[0] <= (room := capacity - fills[b]):
            if room in stock:
                take(room, b)
                break
            fitting = bisect.bisect_left(order, room)
            halves = bisect.bisect_right(order, room // 2)
            pair = next((s for s in reversed(order[halves:fitting]) if room - s in stock), 0)
            if not pair and room % 2 == 0 and len(stock.get(room // 2, [])) > 1:
                pair = room // 2
            if pair:
                take(pair, b)
                take(room - pair, b)
                break
            take(order[fitting - 1], b)
    if empty:
        if not bins:
            bins.append([])
            fills.append(0)
        bins[0] += empty
    return Chromosome(bins, fills)


def from_labels(labels: list[int], sizes: list[int]) -> Chromosome:
    n = max(labels, default=-1) + 1
    bins: list[list[int]] = [[] for _ in range(n)]
    fills = [0] * n
    for i, b in enumerate(labels):
        bins[b].append(i)
        fills[b] += sizes[i]
    return Chromosome(bins, fills)


def crossover(a: Chromosome, b: Chromosome, sizes: list[int], capacity: int, rng: np.random.Generator) -> Chromosome:
    """A child of ``a`` that takes over whole well-filled bins of ``b``.

    Bins of ``a`` that hold an injected item are dissolved; of what is left the
    least filled bins and a few others, too; displaced items fill the gaps.
    """
    full = sorted(range(len(b.bins)), key=lambda k: -b.fills[k])[: max(1, len(b.bins) // 2)]
    chosen = [full[k] for k in np.flatnonzero(rng.random(len(full)) < rng.random())] or full[:1]
    bins, fills = [b.bins[k] for k in chosen], [b.fills[k] for k in chosen]
    injected = {i for items in bins for i in items}
    displaced: list[int] = []
    kept = []
    for items, fill in zip(a.bins, a.fills):
        if injected.isdisjoint(items):
            kept.append((fill, items))
        else:
            displaced += [i for i in items if i not in injected]
    kept.sort(key=lambda x: -x[0])
    spared = len(kept) - max(1, len(kept) // 20)
    for k, ((fill, items), x) in enumerate(zip(kept, rng.random(len(kept)))):
        if k < spared and x >= MUTATION:
            bins.append(items)
            fills.append(fill)
        else:
            displaced += items
    return refill(displaced, sizes, capacity, [list(x) for x in bins], fills)


def ideal(sizes: list[int], capacity: int) -> float:
    """No fitness can be above this: all bins full but one."""
    full, rest = divmod(sum(sizes), capacity)
    return (full + (rest / capacity) ** 2) / max(1, full + (rest > 0))


def evolve(population: list[Chromosome], sizes: list[int], capacity: int, patience: int, rng: np.random.Generator) -> list[Chromosome]:
    """Children take the place of the worst, if they are better and unlike the others, until the best stays the same for ``patience`` generations or is ideal."""
    ranked = sorted(((c.fitness(capacity), c) for c in population), key=lambda x: -x[0])
    enough = ideal(sizes, capacity) - 1e-12
    idle = 0
    while len(ranked) > 1 and idle < patience and ranked[0][0] < enough:
        best = ranked[0][0]
        for _ in range(len(ranked)):
            x, y = rng.choice(len(ranked), 2, replace=False)
            child = crossover(ranked[x][1], ranked[y][1], sizes, capacity, rng)
            fitness = child.fitness(capacity)
            if fitness > ranked[-1][0] and all(fitness != f for f, _ in ranked):
                ranked[-1] = (fitness, child)
                ranked.sort(key=lambda x: -x[0])
            if fitness >= enough:
                break
        idle = 0 if ranked[0][0] > best else idle + 1
    return [c for _, c in ranked]


def first_population(sizes: list[int], capacity: int, n: int, island: int, rng: np.random.Generator) -> list[Chromosome]:
    """On island 0 the first is best-fit decreasing; all others are best fit of noisily decreasing sizes."""
    out = []
    for k in range(n):
        noise = 0.0 if island == 0 and k == 0 else 0.05 + 0.25 * rng.random()
        weight = np.asarray(sizes, float) * (1 + noise * (rng.random(len(sizes)) - 0.5))
        out.append(best_fit(np.argsort(-weight, kind="stable").tolist(), sizes, capacity, [], []))
    return out


_STATE = "cell bigint, island int, sizes array<int>, labels array<int>, fitness double, elite boolean"


def _epoch(capacity: int, epoch: int, population: int, patience: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, island = int(pdf["cell"].iat[0]), int(pdf["island"].iat[0])
        sizes = [int(x) for x in pdf["sizes"].dropna().iat[0]]
        rng = np.random.default_rng([seed, cell & 0x7FFFFFFF, island, epoch])
        if epoch == 0:
            people = first_population(sizes, capacity, population, island, rng)
        else:
            rows = sorted(zip(-pdf["fitness"], pdf["elite"], (x.tolist() for x in pdf["labels"])))
            people = [from_labels(labels, sizes) for _, _, labels in rows]
        people = evolve(people, sizes, capacity, patience, rng)[:population]
        return pd.DataFrame(
            {"cell": cell, "island": island, "sizes": [sizes if k == 0 else None for k in range(len(people))], "labels": [p.labels(len(sizes)) for p in people], "fitness": [p.fitness(capacity) for p in people], "elite": [k == 0 for k in range(len(people))]}
        )

    return run


def pack_cells(cells: DataFrame, count: int, capacity: int, islands: int = ISLANDS, population: int = POPULATION, epochs: int = EPOCHS, patience: int = PATIENCE, seed: int = 7) -> DataFrame:
    """The best labels of every cell: (cell, labels) for ``count`` cells (cell, sizes).

    Every (cell, island) is one group of a task. Between epochs the elite of an
    island goes to the next island of its cell, as one row of the shuffle that
    groups the islands again. Only the elite's row carries the sizes.
    """
    state = cells.select("cell", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "sizes", F.lit(None).cast("array<int>").alias("labels"), F.lit(None).cast("double").alias("fitness"), F.lit(False).alias("elite"))
    for epoch in range(epochs):
        if epoch:
            moved = F.when(F.col("elite"), F.array(F.col("island"), ((F.col("island") + 1) % islands).cast("int"))).otherwise(F.array("island"))
            state = state.withColumn("island", F.explode(moved))
        state = state.repartition(max(1, count * islands // TASK_ISLANDS), "cell", "island").groupBy("cell", "island").applyInPandas(_epoch(capacity, epoch, population, patience, seed), _STATE)
    best = state.where("elite").groupBy("cell").agg(F.max_by("labels", F.struct("fitness", -F.col("island"))).alias("labels"))
    return best


def pack(items: DataFrame, item: str, size: str, capacity: int = CAPACITY, cell: int = CELL, rounds: int = ROUNDS, **how: int) -> DataFrame:
    """Give every item its container: rows (item, piece, start, size, container, divided).

    Only an item larger than ``capacity`` is divided: into full pieces, each a
    container of its own, and a rest that is packed like the other items.
    Items are hashed to cells of about ``cell`` items, each cell is packed by
    a grouping genetic algorithm on several islands; then the bins that aren't
    filled well are packed again together with those of other cells, in cells
    of the same size. A cell therefore never grows with the data, and the room
    lost at cell borders goes to the last round's few cells.

    Null and negative sizes count 0 and take no room but still get a
    container. Rows with equal (item, size) count once; one item with several
    sizes gives an item each. Only ids and sizes are shuffled. No items give no
    rows.
    """
    src = only(items, item, size).select(F.col(item).alias("item"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("size")).distinct()
    whole = F.floor(F.col("size") / capacity).cast("int")
    rest = F.col("size") - whole * F.lit(capacity).cast("bigint")
    src = src.withColumn("rest", rest).withColumn("whole", whole)
    full = src.where("whole > 0").select("item", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("piece"), "size")
    full = full.select("item", "piece", (F.col("piece") * F.lit(capacity).cast("bigint")).alias("start"), F.lit(capacity).cast("bigint").alias("part"), F.concat_ws("-", F.lit("w"), "item", F.col("size"), "piece").alias("container"), F.col("size").alias("of"))
    todo = src.where((F.col("rest") > 0) | (F.col("whole") == 0)).select("item", F.col("whole").alias("piece"), (F.col("whole") * F.lit(capacity).cast("bigint")).alias("start"), F.col("rest").cast("int").alias("part"), F.col("size").alias("of"))
    todo = settle(todo)
    parts = [full]
    for r in range(rounds):
        n = todo.count()
        cells = max(1, math.ceil(n / cell))
        row = F.struct(F.xxhash64("item", "of", F.lit(r)).alias("_h"), "item", "piece", "start", "part", "of")
        boxed = settle(todo.withColumn("cell", F.pmod(F.xxhash64("item", "of", F.lit(r)), F.lit(cells))).groupBy("cell").agg(F.array_sort(F.collect_list(row)).alias("rows")))
        best = pack_cells(boxed.select("cell", F.col("rows.part").alias("sizes")), cells, capacity, **how)
        placed = boxed.join(best.hint("merge"), "cell").select("cell", F.explode(F.arrays_zip("rows", "labels")).alias("x")).select("cell", F.col("x.labels").alias("label"), "x.rows.*")
        if r + 1 == rounds:
            last = placed
        else:
            placed = settle(placed.withColumn("fill", F.sum("part").over(Window.partitionBy("cell", "label"))))
            last, todo = placed.where(F.col("fill") >= WELL_FILLED * capacity), placed.where(F.col("fill") < WELL_FILLED * capacity).select("item", "piece", "start", "part", "of")
        name = F.concat_ws("-", F.lit(f"r{r}"), "cell", "label")
        parts.append(last.select("item", "piece", "start", F.col("part").cast("bigint").alias("part"), name.alias("container"), "of"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("item", "piece", "start", F.col("part").alias("size"), "container", (F.col("of") > capacity).alias("divided"))


def utilisation(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the fewest containers possible and the share of room that is unused."""
    bins = packed.groupBy("container").agg(F.sum("size").alias("fill"))
    return bins.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("fill"), F.lit(0)).alias("tokens"),
        F.ceil(F.coalesce(F.sum("fill"), F.lit(0)) / capacity).alias("least"), F.coalesce(F.max("fill"), F.lit(0)).alias("fullest"),
        F.round(1 - F.sum("fill") / (F.count("*") * capacity), 6).alias("unused_share"),
    )
