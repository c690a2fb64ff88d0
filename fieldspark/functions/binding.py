"""Let-bindings inside one expression, so that long formulas are not copied."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(values: list[Column], fn: Callable[..., tuple[Column, ...]], n_out: int = 2) -> tuple[Column, ...]:
    """fn(*values) with each value computed once, however often fn uses it."""
    names = [f"v{i}" for i in range(len(values))]
    one = F.array(F.struct(*[c.alias(n) for c, n in zip(values, names)]))
    out = F.transform(one, lambda s: F.struct(*[c.alias(f"o{i}") for i, c in enumerate(fn(*[s[n] for n in names]))]))
    return tuple(out[0][f"o{i}"] for i in range(n_out))


def iterate(start: Column, step: Callable[[Column], Column], times: int) -> Column:
    """Fixed number of steps of an iteration inside one expression."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), start, lambda p, _: step(p))
