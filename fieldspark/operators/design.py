"""Experiment design: samples, lookups, run matrices, legs, scopes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions.hashing import hashed_uniform
from fieldspark.model import lookup_table
from fieldspark.operators import scan

# Core experiments (code, experiment, pathway, model, end year, product leg).
CORE_EXPERIMENTS = (
    ("C001", "historical", "ssp585", "CESM2-WACCM", 2100, "historical"),
    ("C002", "historical", "ssp585", "MRI-ESM2-0", 2100, "historical"),
    ("C003", "ssp370", "ssp370", "CESM2-WACCM", 2100, "projection"),
    ("C004", "ssp370", "ssp370", "MRI-ESM2-0", 2100, "projection"),
    ("C005", "ssp126", "ssp126", "CESM2-WACCM", 2300, "projection"),
    ("C006", "ssp126", "ssp126", "MRI-ESM2-0", 2300, "projection"),
    ("C007", "ssp585", "ssp585", "CESM2-WACCM", 2300, "projection"),
    ("C008", "ssp585", "ssp585", "MRI-ESM2-0", 2300, "projection"),
)


def latin_hypercube(members: DataFrame, names: Sequence[str], seed: int = 0, member: str = "sample", blocks: int = 256) -> DataFrame:
    """One draw per stratum and parameter: ``(sample, name, u)``.

    Ranks of hashed uniforms give independent permutations.  The hash is spread
    evenly, so ranking by its blocks keeps every task small.
    """
    d = members.select(member, F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    d = d.withColumn("__h", hashed_uniform(F.lit(seed), F.col("name"), F.col(member)))
    d = scan.dense_index(d, ["name"], ["__h", member], F.floor(F.col("__h") * blocks), "__k")
    n = members.agg(F.count(F.lit(1))).scalar()
    jitter = hashed_uniform(F.lit(f"{seed}j"), F.col("name"), F.col(member))
    return d.select(member, "name", ((F.col("__k") + 1 - jitter) / n).alias("u"))


def levels(n: int, kind: str = "edge") -> list[float]:
    """Quantile levels of a factorial design."""
    if n < 1:
        raise ValueError(f"need at least one level, got {n}")
    if kind == "edge":
        return [k / n for k in range(1, n + 1)]
    if kind == "midpoint":
        return [(k + 0.5) / n for k in range(n)]
    if kind == "endpoint":
        return [k / (n - 1) if n > 1 else 0.0 for k in range(n)]
    raise ValueError(f"unknown kind {kind!r}: edge, midpoint or endpoint")


def full_factorial(spark: SparkSession, names: Sequence[str], n_levels: int, kind: str = "edge") -> DataFrame:
    """All level combinations, last parameter fastest; row numbers in mixed radix, no join."""
    levels(min(n_levels, 1), kind)
    d = spark.range(n_levels ** len(names)).withColumnRenamed("id", "sample")
    cols = {}
    for i, name in enumerate(reversed(names)):
        k = F.floor(F.col("sample") / n_levels**i) % n_levels
        u = {"edge": (k + 1) / n_levels, "midpoint": (k + 0.5) / n_levels, "endpoint": k / max(n_levels - 1, 1)}[kind]
        cols[name] = u.cast("double")
    return d.withColumns({n: cols[n] for n in names})


def sample_design(spark: SparkSession, method: str, names: Sequence[str], n: int, seed: int = 0, kind: str = "edge") -> DataFrame:
    """Design in wide quantile form by method name."""
    m = method.strip().lower()
    if m.startswith("lhs"):
        long = latin_hypercube(spark.range(n).withColumnRenamed("id", "sample"), names, seed)
        return long.groupBy("sample").pivot("name", list(names)).agg(F.first("u"))
    if m.startswith("factorial"):
        return full_factorial(spark, names, n, kind)
    raise ValueError(f"unknown sampling method {method!r}: lhs or factorial")


def derived_order(derived: Mapping[str, Mapping[str, Any]], known: Sequence[str]) -> list[str]:
    """Bases before followers; unknown bases and cycles raise."""
    order: list[str] = []
    todo = dict(derived)
    missing = sorted({d["derived_from"] for d in todo.values()} - set(known) - set(todo))
    if missing:
        raise KeyError(f"unknown base parameters {missing}; available: {sorted(known)}")
    while todo:
        ready = [n for n, d in todo.items() if d["derived_from"] not in todo]
        if not ready:
            raise ValueError(f"derived parameters form a cycle: {sorted(todo)}")
        order += ready
        for n in ready:
            todo.pop(n)
    return order


def apply_derived(df: DataFrame, derived: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """base * scale + offset; integers when scale, offset and all base values are whole."""
    order = derived_order(derived, df.columns)
    roots = {}
    for n in order:
        base = derived[n]["derived_from"]
        roots[n] = roots.get(base, base)
    bases = sorted(set(roots.values()))
    whole = df.agg(*[F.coalesce(F.bool_and(F.col(f"`{b}`") == F.round(F.col(f"`{b}`"))), F.lit(True)).alias(b) for b in bases]).first() if bases else {}
    is_whole = {b: bool(whole[b]) for b in bases}
    for n in order:
        d = derived[n]
        scale, offset, base = float(d.get("scale", 1.0)), float(d.get("offset", 0.0)), d["derived_from"]
        value = F.col(f"`{base}`").cast("double") * scale + offset
        is_whole[n] = is_whole[base] and scale.is_integer() and offset.is_integer()
        df = df.withColumn(n, F.round(value).cast("bigint") if is_whole[n] else value)
    return df


def posterior_merge(design: DataFrame, posterior: DataFrame, seed: int = 42, order: str = "row", skip: Sequence[str] = ("exp_id",)) -> DataFrame:
    """One posterior row drawn with replacement per sample; posterior columns beat design columns."""
    values = [c for c in posterior.columns if c not in (order, *skip)]
    p = scan.dense_index(posterior, [], [order], None, "__k").select("__k", *values)
    n = posterior.agg(F.count(F.lit(1))).scalar()
    pick = F.floor(hashed_uniform(F.lit(seed), F.col("sample")) * n)
    return design.drop(*[c for c in values if c != "sample"]).withColumn("__k", pick).join(p, "__k").drop("__k")


def cross_files(files: DataFrame, design: DataFrame, file_sample: str = "sample_df", design_sample: str = "sample_uq") -> DataFrame:
    """Every file row with every sample, id ``<file>_uq_<n>``.

    The product is the result itself, so it is a cross join: rows come out one by
    one and neither the product nor copies of a side are exchanged or broadcast.
    The design is dealt over the shuffle partitions first.
    """
    parts = int(design.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = F.concat_ws("_uq_", F.col(file_sample).cast("string"), F.col(design_sample).cast("string"))
    out = design.repartition(parts, design_sample).crossJoin(files)
    return out.withColumn("sample", name).drop(file_sample, design_sample)


def choice_lookup(design: DataFrame, choices: DataFrame, flags: Mapping[str, str], order: str) -> DataFrame:
    """Integer code -> value at that row of ``choices``; a code out of range raises with the row's sample."""
    out = design
    for flag, column in flags.items():
        if flag not in design.columns:
            continue
        if column not in choices.columns:
            raise KeyError(f"mapping for {flag!r} points to missing column {column!r}")
        c = scan.dense_index(choices.select(order, F.col(column).alias("__v")), [], [order], None, "__k").drop(order)
        found = out.withColumn("__k", F.col(flag).cast("bigint")).join(c.withColumn("__hit", F.lit(1)), "__k", "left")
        bad = F.raise_error(F.concat(F.lit(f"choice of {flag} out of range at sample "), F.col("sample").cast("string")))
        out = found.withColumn(flag, F.when(F.col("__hit").isNull(), bad).otherwise(F.col("__v"))).drop("__k", "__v", "__hit")
    return out


def scope_ids(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """Complexes and glaciers in scope: wanted ids, parents of wanted glaciers, children of all those parents.

    ``links`` has ``g_id, c_id``; the result has ``id, kind``.
    """
    w = wanted.select(F.col("id").alias("g_id")).distinct()
    parents = links.join(w, "g_id", "left_semi").select("c_id").union(
        links.join(w.withColumnRenamed("g_id", "c_id"), "c_id", "left_semi").select("c_id")).where("c_id is not null").distinct()
    g = links.join(parents, "c_id", "left_semi").select("g_id").union(links.join(w, "g_id", "left_semi").select("g_id")).distinct()
    return parents.select(F.col("c_id").alias("id"), F.lit("C").alias("kind")).union(g.select(F.col("g_id").alias("id"), F.lit("G").alias("kind")))


def mark_overrides(overrides: DataFrame, allowed: DataFrame) -> DataFrame:
    """The overrides with their ``state``, kept or skipped, by ``(member, key)``: one join for both."""
    keys = ["member", "key"]
    a = allowed.select(*keys).distinct().withColumn("__in", F.lit(True))
    return overrides.join(a, keys, "left").withColumn("state", F.when(F.col("__in"), "kept").otherwise("skipped")).drop("__in")


def filter_overrides(overrides: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped) overrides by ``(member, key)``."""
    keys = ["member", "key"]
    a = allowed.select(*keys).distinct()
    return overrides.join(a, keys, "left_semi"), overrides.join(a, keys, "left_anti")


def invalid_options(run_keys: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Run keys that the option catalogue does not know."""
    return run_keys.join(catalogue.select(F.col("option").alias("key")).distinct(), "key", "left_anti")


def resolve_experiments(df: DataFrame, code: str, spark: SparkSession, end: Column | None = None) -> DataFrame:
    """Expand experiment codes (trimmed, any case); unknown codes raise, and no code needs an end date."""
    names = ", ".join(r[0] for r in CORE_EXPERIMENTS)
    t = lookup_table(spark, CORE_EXPERIMENTS, "__c string, experiment string, pathway string, esm_id string, end_year int, product_leg string")
    d = df.withColumn("__c", F.upper(F.trim(code))).join(t, "__c", "left")
    bad = F.col("__c").isNotNull() & F.col("experiment").isNull()
    d = d.withColumn("experiment", F.when(bad, F.raise_error(F.concat(F.lit("unknown experiment code "), F.col(code), F.lit(f"; supported: {names}")))).otherwise(F.col("experiment")))
    default_end = F.make_date(F.col("end_year") + 1, F.lit(1), F.lit(1))
    needed = F.coalesce(end, default_end) if end is not None else default_end
    return d.withColumn("end_date", F.when(F.col("__c").isNull() & needed.isNull(), F.raise_error(F.lit("an end date is needed without a code"))).otherwise(needed)).drop("__c")


def forcing_pairs(gcms: DataFrame, climatology: str, version: str, constants: Mapping[str, str]) -> DataFrame:
    """File index: the climatology row and one row per (model, future, present) pair, with constant inputs.

    ``gcms`` has ``gcm, pairs ARRAY<STRUCT<future, present>>``.
    """
    tag = F.concat_ws("_", F.lit("gcm"), F.col("gcm"), F.lit("exp"), F.col("future"), F.col("present"))
    file = F.concat(F.concat_ws("_", F.lit(climatology), F.col("gcm"), F.lit("anomalies"), F.col("future"), F.col("present"), F.lit(version)), F.lit(".nc"))
    pairs = gcms.select("gcm", F.inline("pairs")).select(tag.alias("sample"), file.alias("climate_file"))
    base = gcms.sparkSession.createDataFrame([(climatology, f"{climatology}_{version}.nc")], "sample string, climate_file string")
    return base.unionByName(pairs).withColumns({k: F.lit(x) for k, x in constants.items()})


def file_index(climate: DataFrame, members: DataFrame, path: str = "path") -> DataFrame:
    """One row per climate file of a member, tagged by ``snap_YYYY_YYYY`` or position; members without files keep a row."""
    tag = F.regexp_extract(path, r"(snap_\d{4}_\d{4})", 1)
    d = scan.dense_index(climate, ["member"], [path], None, "__i")
    d = d.withColumn("sample", F.when(tag != "", tag).otherwise(F.col("__i").cast("string"))).drop("__i")
    return members.join(d, "member", "left")


def epoch_columns(files: DataFrame, member: str, kind: str, epoch: str, path: str, kinds: Sequence[str], epochs: Sequence[str]) -> DataFrame:
    """Wide index with one ``<kind>_<epoch>_file`` column per combination, by conditional aggregation."""
    cols = [F.max(F.when((F.col(kind) == k) & (F.col(epoch) == e), F.col(path))).alias(f"{k}_{e}_file") for k in kinds for e in epochs]
    return files.groupBy(member).agg(*cols)


def aggregate_groups(members: DataFrame, group: str, area: str, crs: str, min_members: int = 1) -> DataFrame:
    """One synthetic row per non-empty group: member count, area, most common CRS (smallest on ties)."""
    m = members.where(F.col(group).isNotNull())
    n = m.groupBy(group, crs).agg(F.count(F.lit(1)).alias("__n"), F.sum(area).alias("__a"))
    return n.groupBy(group).agg(
        F.sum("__n").alias("n_members"), F.sum("__a").alias("area_km2"), F.min_by(crs, F.struct(-F.col("__n"), F.col(crs))).alias("crs"),
    ).where(F.col("n_members") >= min_members)


def built_or_fallback(wanted: DataFrame, catalogue: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Path of the pre-built product where one exists, else ``compute``; the first path wins."""
    first = catalogue.groupBy(*keys).agg(F.min("path").alias("path"))
    d = wanted.join(first, list(keys), "left")
    return d.withColumn("action", F.when(F.col("path").isNull(), "compute").otherwise("use"))


def run_matrix(merged: DataFrame, member: str, columns: Sequence[str], allowed: DataFrame | None = None) -> DataFrame:
    """Wide members -> long ``(member, key, value)`` without missing values, limited to allowed keys."""
    wide = merged.select(F.col(member).alias("member"), *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    long = wide.unpivot(["member"], [f"`{c}`" if "." in c else c for c in columns], "key", "value").where("value is not null")
    return filter_overrides(long, allowed)[0] if allowed is not None else long


def expand_legs(members: DataFrame, split: str = "2015-01-01") -> DataFrame:
    """Ordered legs per member: optional init, historical up to the split, projection after it.

    ``members`` has ``member, start, end, has_init, has_code, product_leg``.
    Without a code one historical leg covers the whole span.  A later leg starts
    from the previous leg's state and drops the bootstrap keys; codes whose
    product is historical have no projection leg.
    """
    leg = lambda n, name, a, b: F.struct(F.lit(n).alias("leg_no"), F.lit(name).alias("leg"), a.alias("t0"), b.alias("t1"))
    cut, start, end = F.lit(split).cast("date"), F.col("start"), F.col("end")
    coded = F.col("has_code")
    legs = F.array_compact(F.array(
        F.when(F.col("has_init"), leg(0, "init", F.add_months(start, -12), start)),
        leg(1, "historical", start, F.when(coded, cut).otherwise(end)),
        F.when(coded & (F.col("product_leg") == "projection"), leg(2, "projection", cut, end))))
    d = members.select("member", "product_leg", "has_code", F.posexplode(legs).alias("i", "l"), legs.alias("__all"))
    state = lambda m, x: F.concat(F.lit("state_"), m, F.lit("_"), x["leg"], F.lit(".nc"))
    prev = F.when(F.col("i") > 0, state(F.col("member").cast("string"), F.get("__all", F.col("i") - 1)))
    return d.select("member", "l.leg_no", "l.leg", "l.t0", "l.t1", prev.alias("input_file"), prev.isNull().alias("bootstrap"),
                    (F.col("has_code") & (F.col("l.leg") == F.col("product_leg"))).alias("is_product"))


def multi_model(runs: DataFrame, single: DataFrame) -> DataFrame:
    """Per experiment: does it use a model outside the single-model set?"""
    j = runs.select("exp_id", "gcm_id").distinct().join(single.select("gcm_id").distinct().withColumn("__s", F.lit(1)), "gcm_id", "left")
    return j.groupBy("exp_id").agg(F.bool_or(F.col("__s").isNull()).alias("is_multi"))


def select_names(include: Sequence[str] | None, available: Sequence[str]) -> list[str]:
    """Requested names in the order of the list; unknown names raise."""
    unknown = sorted(set(include or ()) - set(available))
    if unknown:
        raise ValueError(f"unknown names {unknown}; available: {list(available)}")
    return [n for n in available if include is None or n in set(include)]


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], k: int, salt: int = 32) -> DataFrame:
    """First k rows per key; salted partial top-k first, so a hot key is not sorted in one task."""
    from pyspark.sql import Window

    by = [F.asc(c) if up else F.desc(c) for c, up in order]
    d = df.withColumn("__s", F.pmod(F.xxhash64(*[c for c, _ in order]), F.lit(salt)))
    part = Window.partitionBy(*keys, "__s").orderBy(*by)
    d = d.withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= k)
    full = Window.partitionBy(*keys).orderBy(*by)
    return d.withColumn("__r", F.row_number().over(full)).where(F.col("__r") <= k).drop("__r", "__s")


def first_match(listing: DataFrame, keys: Sequence[str], text: str, pattern: str, value: str, position: str) -> DataFrame:
    """First listing entry per job whose text contains the pattern."""
    return listing.where(F.contains(F.col(text), F.lit(pattern))).groupBy(*keys).agg(F.min_by(value, position).alias(value))
