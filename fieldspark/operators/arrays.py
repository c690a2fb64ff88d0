"""User functions over array columns and groups, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def core_function(fn: Callable[..., np.ndarray], returns: str):
    """Column function of one or more array columns from a numpy function of (rows, core) arrays of equal core length.

    Rows in which any input is NULL give NULL; the function gets the others alone.
    """

    @F.pandas_udf(returns)
    def each(inputs: pd.DataFrame) -> pd.Series:
        whole = inputs.notna().all(axis=1).to_numpy()
        out = pd.Series([None] * len(inputs), dtype=object)
        if whole.any():
            out[whole] = list(fn(*[np.stack(inputs.loc[whole, c].to_numpy()) for c in inputs.columns]))
        return out

    def run(*columns):
        return each(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(columns)]))

    return run


def grouped_function(df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], returns: str, salt: int = 1) -> DataFrame:
    """Apply a pandas function per group and salt; the caller merges the ``salt`` partial results of a key.

    A function that cannot be merged needs ``salt=1`` and groups of bounded size.
    """
    types = dict(df.dtypes)
    ks = list(keys)
    d = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salt)))

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf.drop(columns="__salt"))
        for i, k in enumerate(ks):
            out.insert(i, k, key[i])
        return out

    schema = ", ".join([*[f"`{k}` {types[k]}" for k in ks], returns])
    return d.groupBy(*ks, "__salt").applyInPandas(run, schema)


def batch_function(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], returns: str) -> DataFrame:
    """Apply a pandas function to every Arrow batch, which holds rows of many keys; the caller merges the partial results of a key.

    For functions that can be merged: no exchange comes before them, and no call is made per key.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, returns)
