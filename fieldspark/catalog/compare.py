"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    """DuckDB connection with the test tables as views."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _text(v) -> str:
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, float):
        return repr(float(v))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return str([_text(x) for x in v])
    if isinstance(v, dict):
        return str({k: _text(x) for k, x in sorted(v.items())})
    return str(v).removesuffix(" 00:00:00")


def canonical(df: pd.DataFrame) -> list[tuple[str, ...]]:
    """Rows as sorted text tuples, columns in name order; floats must agree in every digit."""
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(_text(v) for v in row) for row in df.itertuples(index=False, name=None))


def duck_frame(con, sql: str) -> tuple[pd.DataFrame, dict[str, str]]:
    rel = con.execute(sql)
    types = {d[0]: str(d[1]) for d in rel.description}
    return pd.DataFrame(rel.fetchall(), columns=list(types), dtype=object), types
