"""Array, map and numeric functions over one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def left_pad(a: Column, width: Column, fill: Column) -> Column:
    return F.concat(F.array_repeat(fill, (width - F.size(a)).cast("int")), a)


def fit_length(a: Column, n: int, fill: Column) -> Column:
    """Cut or padded at the end to ``n``."""
    return F.slice(F.concat(a, F.array_repeat(fill, n)), 1, n)


def chunks(a: Column, n: int) -> Column:
    """Consecutive slices of ``n``, the last one shorter; none of an empty array."""
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), F.lit(n)), lambda i: F.slice(a, i + 1, n))
    return F.filter(cut, lambda x: F.size(x) > 0)


def first_last_means(a: Column, k: int = 2) -> Column:
    """Means of the first ``k`` and of the last ``k`` values (the same ones where there are fewer)."""

    def mean(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.when(F.size(x) > 0, F.size(x))

    n = F.size(a)
    last = F.slice(a, F.greatest(n - (k - 1), F.lit(1)), k)
    return F.struct(mean(F.slice(a, 1, k)).alias("first"), mean(last).alias("last"))


def block_runs(a: Column, delimiter: Column) -> Column:
    """Lengths of the runs before each delimiter; a run without delimiter at the end is dropped."""
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("run"))
    end = F.aggregate(
        a,
        start,
        lambda s, x: F.when(x == delimiter, F.struct(F.concat(s["done"], F.array(s["run"])).alias("done"), F.lit(0).alias("run"))).otherwise(F.struct(s["done"].alias("done"), (s["run"] + 1).alias("run"))),
    )
    return end["done"]


def block_number(a: Column, delimiter: Column) -> Column:
    """For each place the number of delimiters before it."""
    return F.transform(a, lambda _, i: F.size(F.filter(F.slice(a, 1, i), lambda x: x == delimiter)))


def block_labels(ids: Column, frame: Column, end: Column, first_only: Column, ignore: int = -100, first: int = -101) -> Column:
    """Training labels: frames keep their id, or get ``first`` in blocks whose flag in ``first_only`` is set; ends keep theirs.

    A block ends with ``end``; everything else is ignored.
    """
    block = block_number(ids, end)
    return F.zip_with(
        ids,
        block,
        lambda x, b: F.when(x == end, end).when(x == frame, F.when(F.coalesce(F.get(first_only, b), F.lit(False)), first).otherwise(frame)).otherwise(ignore),
    )


def slot_labels(labels: Column, codes: Column, end: Column, end_class: int, slots: int, ignore: int = -100, first: int = -101) -> Column:
    """Labels of ``slots`` code books per place: the place's codes, only the first of them, the end class, or none.

    ``codes`` holds one array of codes per place (null where it has none).
    """
    rest = F.array_repeat(F.lit(ignore), slots - 1)

    def one(x: Column, c: Column) -> Column:
        head = F.when(x == first, F.get(c, F.lit(0)))
        return F.when(x == end, F.concat(F.array(F.lit(end_class)), rest)).when(x == first, F.concat(F.array(head), rest)).when(x == ignore, F.array_repeat(F.lit(ignore), slots)).otherwise(c)

    return F.zip_with(labels, codes, one)


def segment_mask(lengths: Column, is_text: Column) -> Column:
    """One flag per token, from segments given as lengths and flags."""
    return F.flatten(F.zip_with(lengths, is_text, lambda n, t: F.array_repeat(t, n.cast("int"))))


def positions_of_mask(mask: Column) -> Column:
    """Running position among the set places, 1 where the mask isn't set."""
    ones = F.transform(mask, lambda m: m.cast("int"))
    return F.transform(ones, lambda m, i: F.when(m == 1, F.aggregate(F.slice(ones, 1, i + 1), F.lit(0), lambda s, x: s + x) - 1).otherwise(1))


def transpose(m: Column) -> Column:
    width = F.size(F.element_at(m, 1))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.transform(m, lambda r: F.get(r, i)))


def drop_last(a: Column) -> Column:
    """Without the last element; fails where at most one is there."""
    return F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(F.raise_error(F.lit("nothing is left without the last element")))


def quiet_and_loud(a: Column) -> Column:
    """Mean of the quietest fifth and of the loudest half (each at least one value)."""
    s, n = F.array_sort(a), F.size(a)
    low, high = F.greatest(F.floor(n / 5).cast("int"), F.lit(1)), F.greatest(F.floor(n / 2).cast("int"), F.lit(1))

    def mean(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda t, v: t + v) / F.size(x)

    return F.when(n > 0, F.struct(mean(F.slice(s, 1, low)).alias("quiet"), mean(F.slice(s, n - high + 1, high)).alias("loud")))


def overlay(base: Column, later: Column) -> Column:
    """Map union in which the later value wins, as ``map_concat`` fails on equal keys."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(later, k)), later)


def lookup(m: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key), default)


def softmax(a: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def nucleus(p: Column, top_p: float, top_k: int) -> Column:
    """Places kept by top-k and nucleus: the most probable until their sum exceeds ``top_p``, with the crossing one.

    Ties go to the lower place.
    """
    order = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("m"), i.alias("i"))))
    best = F.slice(order, 1, top_k)
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(0.0).alias("sum"))
    end = F.aggregate(
        best,
        start,
        lambda s, x: F.struct(
            F.when(s["sum"] <= top_p, F.concat(s["kept"], F.array(x["i"]))).otherwise(s["kept"]).alias("kept"),
            (s["sum"] - x["m"]).alias("sum"),
        ),
    )
    return F.array_sort(end["kept"])


def penalize(logits: Column, history: Column, penalty: float) -> Column:
    """Logits of tokens in the history: positive ones divided, others multiplied; ids outside are ignored."""
    return F.transform(logits, lambda x, i: F.when(F.array_contains(history, i), F.when(x > 0, x / penalty).otherwise(x * penalty)).otherwise(x))


def guide(unconditional: Column, conditional: Column, scale: float) -> Column:
    return F.zip_with(unconditional, conditional, lambda u, c: u + F.lit(scale) * (c - u))


def rounded(x: Column, digits: int) -> Column:
    """Rounded as DuckDB does it: scaled, half away from zero, scaled back; a negative number that comes to zero is -0.0, which Spark's ``round`` loses."""
    places = F.round(x * F.lit(10.0**digits))
    return F.when(places == 0, x * F.lit(0.0)).when(F.abs(places) < F.lit(float("inf")), places / F.lit(10.0**digits)).otherwise(x)


def mask_range(a: Column, low: int, high: int) -> Column:
    """Minus infinity at places ``low`` to ``high``."""
    return F.transform(a, lambda x, i: F.when(i.between(low, high), F.lit(float("-inf"))).otherwise(x))


def peak_normalize(a: Column, low: float = 0.30, high: float = 0.99, to: float = 0.95) -> Column:
    """Scaled to a peak of ``to`` if the peak is below ``low`` or above ``high``; clipped to one."""
    peak = F.array_max(F.transform(a, lambda x: F.abs(x)))
    factor = F.when((peak > 0) & ((peak < low) | (peak > high)), to / peak).otherwise(1.0)
    return F.transform(a, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * factor)))


def mix_at_snr(signal: Column, noise: Column, snr_db: float) -> Column:
    """Noise added such that the powers have the given ratio."""
    power = lambda a: F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    gain = F.sqrt(power(signal) / F.greatest(power(noise), F.lit(1e-12)) / F.lit(10.0 ** (snr_db / 10)))
    return F.zip_with(signal, noise, lambda s, n: s + gain * n)


def decibel(ratio: Column) -> Column:
    return 10 * F.log10(ratio + F.lit(1e-12))


def ceil_to(x: Column, step: int) -> Column:
    return F.ceil(x / step) * step


def learning_rate(step: Column, warmup: int, total: int, floor: float = 0.0) -> Column:
    """Linear warm-up, then half a cosine down to ``floor``."""
    done = F.least(F.lit(1.0), (step - warmup) / float(max(1, total - warmup)))
    return F.when(step < warmup, step / float(max(1, warmup))).otherwise(floor + (1 - floor) * 0.5 * (1 + F.cos(F.pi() * done)))


def same_sequence(a: Column, b: Column) -> Column:
    """Equal length and values; two nulls are the same."""
    return a.eqNullSafe(b)
