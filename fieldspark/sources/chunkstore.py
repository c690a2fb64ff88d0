"""Chunked array stores (zlib-compressed, C order) as a Spark data source: one task per chunk."""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CRS_KEYS = ("crs_wkt", "spatial_ref")  # fixed values: attributes that may hold a CRS


def _folder(path: str, *parts: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder, local or by URI scheme."""
    full = "/".join([path.rstrip("/"), *parts])
    return pafs.FileSystem.from_uri(full) if "://" in full else (pafs.LocalFileSystem(), full.removeprefix("file:"))


def _read(where: tuple[pafs.FileSystem, str], name: str) -> bytes | None:
    store, folder = where
    if store.get_file_info(f"{folder}/{name}").type != pafs.FileType.File:
        return None
    with store.open_input_stream(f"{folder}/{name}") as fh:
        return fh.read()


def _write(where: tuple[pafs.FileSystem, str], name: str, content: bytes) -> None:
    """Write under a passing name and move, so that a lost task leaves no half file."""
    store, folder = where
    store.create_dir(folder, recursive=True)
    passing = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(passing) as fh:
        fh.write(content)
    store.move(passing, f"{folder}/{name}")


class ChunkPartition(InputPartition):
    def __init__(self, key: tuple[int, ...]):
        self.key = key


class ChunkReader(DataSourceReader):
    def __init__(self, path: str, variable: str):
        self.path, self.variable = path, variable
        self.meta = json.loads(_read(_folder(path, variable), ".zarray"))

    def partitions(self):
        grid = [range(-(-n // c)) for n, c in zip(self.meta["shape"], self.meta["chunks"])]
        return [ChunkPartition((t, y, x)) for t in grid[0] for y in grid[1] for x in grid[2]]

    def read(self, partition):
        shape, chunks = self.meta["shape"], self.meta["chunks"]
        raw = _read(_folder(self.path, self.variable), ".".join(map(str, partition.key)))
        if raw is None:  # a missing chunk holds only fill values
            block = np.full(chunks, np.nan)
        else:
            block = np.frombuffer(zlib.decompress(raw), dtype=self.meta["dtype"]).reshape(chunks)
        start = [k * c for k, c in zip(partition.key, chunks)]
        size = [min(c, n - s) for c, n, s in zip(chunks, shape, start)]
        block = block[: size[0], : size[1], : size[2]].astype("float64")
        fill = self.meta.get("fill_value")
        valid = ~np.isnan(block) if fill in (None, "NaN") else ~np.isnan(block) & (block != float(fill))
        t, y, x = np.indices(block.shape)
        for i in range(size[0]):  # one Arrow batch per time step bounds memory
            v = block[i].ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array((t[i] + start[0]).ravel(), pa.int64()), pa.array((y[i] + start[1]).ravel(), pa.int64()),
                 pa.array((x[i] + start[2]).ravel(), pa.int64()), pa.array(v, pa.float64(), mask=~valid[i].ravel())],
                names=["t", "iy", "ix", "value"])


class ChunkStore(DataSource):
    """``spark.read.format("chunkstore").option("path", …).option("variable", …)``."""

    @classmethod
    def name(cls):
        return "chunkstore"

    def schema(self):
        return "t bigint, iy bigint, ix bigint, value double"

    def reader(self, schema):
        return ChunkReader(self.options["path"], self.options["variable"])


def open_store(spark: SparkSession, path: str, variable: str) -> DataFrame:
    spark.dataSource.register(ChunkStore)
    return spark.read.format("chunkstore").option("path", path).option("variable", variable).load()


def store_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(variable, attribute, text) of the attribute files: a few entries per variable, read on the driver."""
    store, base = _folder(path)
    rows = []
    for info in sorted(store.get_file_info(pafs.FileSelector(base)), key=lambda f: f.base_name):
        text = _read(_folder(path, info.base_name), ".zattrs") if info.type == pafs.FileType.Directory else None
        rows += [(info.base_name, k, str(x)) for k, x in json.loads(text).items()] if text else []
    return spark.createDataFrame(rows, "variable string, attribute string, text string")


def recover_crs(metadata: DataFrame) -> DataFrame:
    """One-row CRS: the variable a grid_mapping points to first, then any variable with a CRS attribute, else an error."""
    pointed = metadata.where("attribute = 'grid_mapping'").select(F.col("text").alias("variable")).distinct().withColumn("p", F.lit(1))
    found = metadata.where(F.col("attribute").isin(*CRS_KEYS)).join(pointed, "variable", "left")
    rank = F.struct(F.coalesce(-F.col("p"), F.lit(0)), F.array_position(F.array(*map(F.lit, CRS_KEYS)), F.col("attribute")), F.col("variable"))
    best = found.agg(F.min_by("text", rank).alias("crs"))
    return best.select(F.coalesce("crs", F.raise_error(F.lit("the store has no CRS"))).alias("crs"))


def write_attributes(path: str, variable: str, attrs: dict[str, str]) -> None:
    _write(_folder(path, variable), ".zattrs", json.dumps(attrs).encode())


def write_store(df: DataFrame, path: str, variable: str, shape: tuple[int, int, int], chunks: tuple[int, int, int], attrs: dict[str, str]) -> int:
    """Write (t, iy, ix, value) as a chunk store, one task per chunk; returns the number of chunks."""
    write_attributes(path, variable, attrs)
    meta = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": "<f8", "compressor": {"id": "zlib", "level": 1},
            "fill_value": "NaN", "order": "C", "filters": None}
    _write(_folder(path, variable), ".zarray", json.dumps(meta).encode())

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        key = tuple(int(pdf[k].iloc[0]) for k in ("ct", "cy", "cx"))
        block = np.full(chunks, np.nan)
        idx = [pdf[k].to_numpy() - c * n for k, c, n in zip(("t", "iy", "ix"), key, chunks)]
        block[tuple(idx)] = pdf["value"].to_numpy()
        _write(_folder(path, variable), ".".join(map(str, key)), zlib.compress(block.tobytes(), 1))
        return pd.DataFrame({"n": [1]})

    keyed = df.select("t", "iy", "ix", "value", *[F.floor(F.col(k) / n).alias(c) for k, n, c in zip(("t", "iy", "ix"), chunks, ("ct", "cy", "cx"))])
    return keyed.groupBy("ct", "cy", "cx").applyInPandas(write, "n bigint").count()
