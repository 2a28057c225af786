"""Edit distance over any symbols, bit-parallel on Python's long integers."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


def edit_distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Fewest insertions, deletions and replacements that turn ``a`` into ``b``.

    One column of the table is held as the bits of two integers (vertical
    steps of +1 and of -1), so a row costs a few integer operations however
    long ``a`` is.
    """
    if len(a) < len(b):
        a, b = b, a
    n = len(a)
    if not b:
        return n
    where: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    mask, last = (1 << n) - 1, 1 << (n - 1)
    up, down, score = mask, 0, n
    for y in b:
        eq = where.get(y, 0)
        diag = ((((eq & up) + up) ^ up) | eq | down) & mask
        right_up = (down | ~(diag | up)) & mask
        right_down = up & diag
        if right_up & last:
            score += 1
        elif right_down & last:
            score -= 1
        right_up = ((right_up << 1) | 1) & mask
        right_down = (right_down << 1) & mask
        up = (right_down | ~(diag | right_up)) & mask
        down = right_up & diag
    return score
