"""Repeatable uniforms from hashes: the same on every executor, retry and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_uniform(*parts: Column) -> Column:
    """Uniform in [0, 1) from the first 32 bits of an md5 over the parts."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
