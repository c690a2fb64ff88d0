"""Listings, file names and alias-tolerant scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions import text as fx

# The layout of group file names.
GROUP_NAME = r"([^/=]+?)_target_([^/]+?)_RGI_id"


def scan_ensemble(spark: SparkSession, paths: Sequence[str], gcm: str = r"_gcm_(.+?)_exp_", exp: str = r"id_(.+?)_") -> DataFrame:
    """All member files as one frame with ids from the file names; missing variables become NULL.

    Empty files add no rows, so they need no special case.
    """
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    return df.select("*", *fx.member_ids_from_name(F.col("_metadata.file_path"), exp, gcm))


def scan_point_grid(spark: SparkSession, path: str) -> DataFrame:
    """``;``-separated points; the misspelt longitude header is accepted by position, gaps stay NULL."""
    schema = "longitude double, latitude double, flux double"
    return spark.read.csv(path, sep=";", header=True, schema=schema, enforceSchema=True, nanValue="NaN").select(
        *[F.nanvl(c, F.lit(None)).alias(c) for c in ("longitude", "latitude", "flux")]).orderBy("latitude", "longitude")


def scan_id_lists(spark: SparkSession, path: str) -> DataFrame:
    """Id lists with group (file prefix or stem) and two-digit region code."""
    df = spark.read.csv(path, header=True, schema="rgi_id string").select("rgi_id", F.col("_metadata.file_path").alias("f"))
    g, r = F.regexp_extract("f", GROUP_NAME, 1), F.regexp_extract("f", GROUP_NAME, 2)
    stem = F.regexp_extract("f", r"([^/]+?)(?:\.[^./]*)?$", 1)
    code = F.regexp_extract("rgi_id", r"-G-(\d{2})-", 1)
    return df.select("rgi_id", F.when(g != "", F.concat_ws("_", g, r)).otherwise(stem).alias("grp"), F.when(code != "", code).alias("region"))


def scan_links(frames: Sequence[DataFrame], left: Sequence[str], right: Sequence[str]) -> tuple[DataFrame | None, list[int]]:
    """Union of link tables whose key columns go by any of the given names; positions of unknown layouts come second."""
    out, skipped = None, []
    for i, df in enumerate(frames):
        a, b = [c for c in left if c in df.columns], [c for c in right if c in df.columns]
        if not a or not b:
            skipped.append(i)
            continue
        part = df.select(F.col(a[0]).cast("string").alias("rgi6"), F.col(b[0]).cast("string").alias("rgi7")).dropna()
        out = part if out is None else out.unionByName(part)
    return out, skipped


def empty_links(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "rgi6 string, rgi7 string")


def parse_rasters(listing: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(parsed, rejected) rasters: variable, unit, month start; bad names or months are rejected, not fatal."""
    parts = F.split(path, "/")
    folder, name = F.try_element_at(parts, F.lit(-2)), F.element_at(parts, -1)
    tokens = F.split(F.regexp_replace(name, r"\.tif$", ""), "_")
    last = lambda k: F.try_element_at(tokens, F.lit(-k))
    # variable first, month and year last, at least one word in between; the unit is the last plain word with one before and one behind it
    inner = F.slice(tokens, 3, F.greatest(F.size(tokens) - 5, F.lit(0)))
    unit = F.try_element_at(F.filter(inner, lambda w: w.rlike("^[A-Za-z]+$")), F.lit(-1))
    words = F.forall(tokens, lambda w: w.rlike("^[A-Za-z0-9]*$"))
    good = name.endswith(".tif") & (tokens[0] == folder) & folder.rlike("^[a-zA-Z0-9]+$") & words & last(2).rlike(r"^\d{2}$") & last(1).rlike(r"^\d{4}$") & unit.isNotNull()
    time = F.try_to_timestamp(F.concat(last(1), F.lit("-"), last(2), F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")
    d = listing.select(path, F.when(good, folder).otherwise("").alias("variable"), F.when(good, unit).otherwise("").alias("units"), F.when(good, time).alias("time"))
    return d.where("time is not null"), d.where("time is null").select(path)


def page_links(pages: DataFrame, html: str, keep: Sequence[str] = (), suffix: str | None = None) -> DataFrame:
    """Relative links of index pages: no query, absolute, parent or directory links; optional suffix."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r'href="([^"]+)"'), 1)
    good = F.filter(hrefs, lambda h: ~h.startswith("?") & ~h.startswith("/") & ~h.endswith("/") & ~F.contains(h, F.lit(".."))
                    & (h.endswith(suffix) if suffix else F.lit(True)))
    return pages.select(*keep, F.posexplode(good).alias("pos", "href"))


def sync_plan(remote: DataFrame, local: DataFrame, delete_extra: bool = False, excluded: Column | None = None) -> DataFrame:
    """Action per key from two listings ``(key, size, etag | md5)``.

    Transfer when absent, when sizes differ, or when a single-part digest
    differs; a multi-part tag (with a dash) of equal size is unchanged.
    """
    r = remote.select("key", F.col("size").alias("__rs"), F.col("etag").alias("__tag"))
    if excluded is not None:
        r = r.where(~excluded)
    j = r.join(local.select("key", F.col("size").alias("__ls"), F.col("md5").alias("__md5")), "key", "full_outer")
    act = (F.when(F.col("__rs").isNull(), F.lit("delete" if delete_extra else "keep"))
           .when(F.col("__ls").isNull() | (F.col("__ls") != F.col("__rs")), "transfer")
           .when(F.contains("__tag", F.lit("-")) | (F.col("__tag") == F.col("__md5")), "unchanged").otherwise("transfer"))
    return j.select("key", act.alias("action"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Listing of real files with size and MD5."""
    return spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("key"), F.col("length").alias("size"), F.md5("content").alias("md5"))


def split_variables(df: DataFrame, snapshot: Sequence[str], flux: Sequence[str], time: str, bounds: tuple[str, str], scale: float = 86400.0) -> DataFrame:
    """Long form per variable: time in days, fluxes at the middle of their bounds, values as float32."""
    ids = ["t", "b0", "b1"]
    d = df.withColumns({"t": F.col(time) / scale, "b0": F.col(bounds[0]) / scale, "b1": F.col(bounds[1]) / scale})
    long = d.select(*ids, *snapshot, *flux).unpivot(ids, [*snapshot, *flux], "variable", "value")
    is_flux = F.col("variable").isin(list(flux))
    return long.select("variable", F.when(is_flux, (F.col("b0") + F.col("b1")) / 2).otherwise(F.col("t")).cast("float").alias("time"),
                       F.col("value").cast("float").alias("value"), F.when(is_flux, "kg s-1").alias("units"))
