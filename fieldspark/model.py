"""Shared conventions: missing values, keys, size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL_KEYS = ("iy", "ix")

CUBE_META = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("variable", T.StringType()),
    T.StructField("dims", T.ArrayType(T.StringType())),
    T.StructField("dtype", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
])


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NaN -> NULL for floating columns, so that aggregates skip missing values."""
    wanted = set(columns) if columns is not None else None
    fixed = {
        f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and (wanted is None or f.name in wanted)
    }
    return df.withColumns(fixed) if fixed else df


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Raise with the available columns when a name is unknown."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise KeyError(f"unknown variables {unknown}; available: {df.columns}")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Raise when the frame has no rows (reads at most one row)."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def lookup_table(spark, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A fixed lookup list as a broadcast frame; its size is that of the Python literal."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def when_chain(pairs: Iterable[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """First matching condition wins."""
    out = None
    for cond, value in pairs:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise) if otherwise is not None else out


def rename_checked(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename, refusing source names that do not exist."""
    require_columns(df, mapping)
    return df.withColumnsRenamed(dict(mapping))
