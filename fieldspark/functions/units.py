"""Unit factors with a dimension check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_DAYS = 365.25

# Unit -> (dimension, size in the dimension's base unit).
UNITS = {
    "kg": ("mass", 1.0),
    "Gt": ("mass", 1e12),
    "mm_sle": ("mass", 361.8e12),
    "s": ("time", 1.0),
    "day": ("time", 86400.0),
    "yr": ("time", YEAR_DAYS * 86400.0),
    "m": ("length", 1.0),
    "km": ("length", 1000.0),
}


def _parse(unit: str) -> tuple[tuple[str, ...], float]:
    num, _, den = unit.replace(" ", "").partition("/")
    try:
        top, bottom = UNITS[num], UNITS[den] if den else None
    except KeyError as exc:
        raise ValueError(f"unknown unit {unit!r}; known: {sorted(UNITS)}") from exc
    dims = (top[0], bottom[0]) if bottom else (top[0],)
    return dims, top[1] / (bottom[1] if bottom else 1.0)


def factor(source: str, target: str) -> float:
    """Multiplier from ``source`` to ``target``; different dimensions raise."""
    (da, a), (db, b) = _parse(source), _parse(target)
    if da != db:
        raise ValueError(f"cannot convert {source!r} ({da}) to {target!r} ({db})")
    return a / b


def convert(value: Column, source: str, target: str) -> Column:
    return value * F.lit(factor(source, target))


def convert_by_column(value: Column, unit: Column, target: str) -> Column:
    """Row-wise source units; a unit that does not fit the target raises at run time."""
    dims, size = _parse(target)
    out = None
    for name in [*UNITS, *[f"{a}/{b}" for a in UNITS for b in ("s", "day", "yr")]]:
        d, s = _parse(name)
        if d == dims:
            out = (F.when if out is None else out.when)(unit == name, value * F.lit(s / size))
    return out.otherwise(F.raise_error(F.concat(F.lit(f"cannot convert to {target}: "), unit)))
