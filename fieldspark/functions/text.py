"""Names, ids, options, calendars and maps as column expressions."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.rules import when_chain

# 365-day calendar, set letters, metadata suffixes of config keys.
NOLEAP_STARTS = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)
SET_LETTERS = {"CORE": "C", "ESM": "E", "PPE": "P"}
META_SUFFIXES = ("_doc", "_type", "_units", "_option", "_choices")
FRONT_FILE_KEY = "geometry.front_retreat.prescribed.file"


def extract_or_raise(text: Column, pattern: str, group: int = 1, what: str = "id") -> Column:
    """First match of a pattern; a missing match is an error at run time."""
    hit = F.regexp_extract(text, pattern, group)
    return F.when(hit != "", hit).otherwise(F.raise_error(F.concat(F.lit(f"no {what} in "), text)))


def member_ids_from_name(name: Column, exp: str = r"id_(.+?)_", gcm: str = r"_gcm_(.+?)_exp_") -> list[Column]:
    """Experiment (required) and model (optional) ids of a file name."""
    model = F.regexp_extract(name, gcm, 1)
    return [extract_or_raise(name, exp, what="experiment id").alias("exp_id"), F.when(model != "", model).alias("gcm_id")]


def config_json(config: Column, defaults: dict[str, str] | None = None) -> Column:
    """Drop metadata keys, add defaults that are absent, sort keys, encode as JSON text."""
    keep = F.map_filter(config, lambda k, _: ~k.rlike("(" + "|".join(META_SUFFIXES) + ")$"))
    pairs = [x for kv in (defaults or {FRONT_FILE_KEY: "false"}).items() for x in map(F.lit, kv)]
    merged = F.map_concat(F.create_map(*pairs), keep)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged))))


def config_value(config: Column, key: str, default) -> Column:
    """Value of a config map with a default for an absent map or key."""
    return F.coalesce(F.try_element_at(config, F.lit(key)), F.lit(default))


def option_names(lines: DataFrame, column: str, prefix: str) -> DataFrame:
    """Option names declared as ``<prefix>:<name> =``, metadata entries left out."""
    name = F.regexp_extract(F.regexp_replace(column, ";", ""), rf"{prefix}:(\S+)\s*=", 1)
    return lines.select(name.alias("option")).where(
        (F.col("option") != "") & ~F.col("option").rlike("(" + "|".join(META_SUFFIXES) + ")$")).distinct()


def set_counter(set_id: Column, sample: Column) -> list[Column]:
    """Set counter, ice member and forcing member of a 0-based sample."""
    key, n = F.upper(set_id), F.format_string("%03d", sample + 1)
    letter = when_chain([(key == k, F.lit(x)) for k, x in SET_LETTERS.items()],
                        F.raise_error(F.concat(F.lit("set must be one of CORE, ESM, PPE, got "), set_id)))
    fixed = F.lit("001")
    return [F.concat(letter, n).alias("set_counter"), F.concat(F.lit("m"), F.when(key == "PPE", n).otherwise(fixed)).alias("ism_member"),
            F.concat(F.lit("f"), F.when(key == "ESM", n).otherwise(fixed)).alias("forcing_member")]


def submission_stem(*parts: str) -> Column:
    """domain, source, model, member, esm, forcing member, experiment, counter, time range."""
    return F.concat_ws("_", *parts)


def join_path(*parts: Column) -> Column:
    """Join the non-empty parts, each without outer slashes."""
    trimmed = F.array(*[F.regexp_replace(p, "^/+|/+$", "") for p in parts])
    return F.array_join(F.filter(trimmed, lambda p: p.isNotNull() & (p != "")), "/")


def forcing_name(var: Column, sheet: Column, gcm: Column, pathway: Column, short_hand: Column, version: Column, year: Column) -> Column:
    """File name; the short-hand segment is left out when it is ``none``."""
    seg = F.when(short_hand != "none", short_hand)
    return F.concat(F.concat_ws("_", var, sheet, gcm, pathway, seg, version, year.cast("string")), F.lit(".nc"))


def basin_name(path: Column, directory: Column) -> Column:
    """Output path for per-basin tables: ``spatial_`` becomes ``basin_``."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.concat(F.regexp_replace(directory, "/+$", ""), F.lit("/basin_"), F.regexp_replace(name, "^spatial_", ""))


def region_directory(rgi_id: Column) -> Column:
    """Directory of the 4th dash token; regions 13 to 15 share one."""
    parts = F.split(rgi_id, "-")
    n = F.try_element_at(parts, F.lit(4)).try_cast("int")
    return F.when(F.size(parts) < 4, F.raise_error(F.concat(F.lit("no region in "), rgi_id))).otherwise(
        F.when(n.between(13, 15), F.lit("RGI-13-15")).otherwise(F.concat(F.lit("RGI-"), n.cast("string"))))


def with_region_labels(df: DataFrame, candidates: Sequence[str] = ("region", "glacier_id", "basin"), default: str = "total") -> DataFrame:
    """One ``region`` label column whatever the layout: index plus ``<dim>_name``, labels, or none."""
    for c in candidates:
        if f"{c}_name" in df.columns:
            return df.drop(c).withColumnRenamed(f"{c}_name", "region")
        if c in df.columns:
            return df.withColumn("region", F.col(c).cast("string")) if c == "region" else df.withColumnRenamed(c, "region")
    return df.withColumn("region", F.lit(default))


def effective_years(start: Column, end: Column) -> list[Column]:
    """Covered years; an end on 1 January does not count its year."""
    last = F.year(end) - F.when((F.month(end) == 1) & (F.day(end) == 1), 1).otherwise(0)
    years = F.when(last >= F.year(start), F.sequence(F.year(start), last))
    return [years.alias("years"), F.concat_ws("-", F.year(start).cast("string"), last.cast("string")).alias("span")]


def noleap_day_number(year: Column, month: Column, day: Column) -> Column:
    """Days since 0001-01-01 in the 365-day calendar."""
    start = F.element_at(F.array(*[F.lit(s) for s in NOLEAP_STARTS]), month.cast("int"))
    return (year - 1) * 365 + start + day - 1


def noleap_date(number: Column) -> list[Column]:
    """(year, month, day) of a day number in the 365-day calendar."""
    doy = number % 365
    starts = F.array(*[F.lit(s) for s in NOLEAP_STARTS])
    month = F.size(F.filter(starts, lambda s: s <= doy))
    return [(F.floor(number / 365) + 1).cast("int").alias("year"), month.cast("int").alias("month"),
            (doy - F.element_at(starts, month) + 1).cast("int").alias("day")]


def resolution_metres(text: Column) -> Column:
    """``900 m`` or ``1.2km`` in metres; NULL for anything else."""
    t = F.regexp_replace(text, r"\s", "")
    ok = t.rlike(r"^\d+(\.\d+)?(m|km)$")
    size = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(ok, size * F.when(t.endswith("km"), 1000.0).otherwise(1.0))


def grid_config_errors(resolution: Column, registration: Column, walltime: Column) -> Column:
    """Violated format rules of a grid and job row."""
    return F.array_compact(F.array(
        F.when(resolution_metres(resolution).isNull(), F.lit("resolution")),
        F.when(~registration.isin("center", "corner"), F.lit("registration")),
        F.when(~walltime.rlike(r"^\d{1,2}:\d{2}:\d{2}$"), F.lit("walltime"))))


def row_to_map(columns: Sequence[str]) -> Column:
    """Map of the non-NULL columns, as text."""
    pairs = [x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, x: x.isNotNull())


def merge_maps(*maps: Column) -> Column:
    """Later non-NULL values win (needs the LAST_WIN map policy)."""
    clean = [F.map_filter(m, lambda _, x: x.isNotNull()) for m in maps]
    return F.map_concat(*clean)


def render_options(options: Column) -> Column:
    """``-key value`` list in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(F.lit("-"), e["key"], F.lit(" "), e["value"])), " ")


def mask_levels(levels: Column, inside: Column) -> Column:
    """A vertical array is missing as a whole outside the mask."""
    return F.when(inside, levels)


def _text_of(value) -> str | None:
    """A JSON value as text: strings as they are, anything else in JSON, null as nothing."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _leaves(text: str | None) -> Iterator[tuple[str, str | None, str | None, str]]:
    """(dotted name, distribution, derived_from, table) of the leaves of one document, with a stack of open tables."""
    root = json.loads(text) if text is not None else None
    stack = [("", root)] if isinstance(root, dict) else []
    while stack:
        name, table = stack.pop()
        for key, value in table.items():
            if not isinstance(value, dict):
                continue
            path = f"{name}.{key}" if name else key
            kind, base = _text_of(value.get("distribution")), _text_of(value.get("derived_from"))
            if kind is None and base is None:
                stack.append((path, value))
            else:
                yield path, kind, base, _text_of(value)


def flatten_specs(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Leaves of nested parameter tables of any depth as dotted names, with rule violations.

    A leaf is a table with ``distribution`` or ``derived_from``; having both is an error.  Other tables are
    walked through, other values are ignored.  Every text is parsed once, in one pass without an exchange; a
    missing text has no leaves, one that is no JSON fails.
    """
    names = ["name", "distribution", "derived_from", "spec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *leaf) for k, t in enumerate(batch.column(1).to_pylist()) for leaf in _leaves(t)]
            docs = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([docs, *[pa.array([r[k] for r in rows], pa.string()) for k in range(1, 5)]], ["doc", *names])

    kind = df.schema[doc_id].dataType.simpleString()
    leaves = df.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).mapInArrow(run, f"doc {kind}, " + ", ".join(f"{n} string" for n in names))
    both = F.col("distribution").isNotNull() & F.col("derived_from").isNotNull()
    return leaves.withColumn("error", F.when(both, "both"))
