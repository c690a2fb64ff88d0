"""Design of experiments, scopes and run matrices: R1-R3, R7-R10, J7, J8, J26-J31, V3."""

from __future__ import annotations


from pyspark.sql import functions as F

from fieldspark.catalog import views as v
from fieldspark.catalog.registry import query
from fieldspark.functions import distributions as dist
from fieldspark.functions.hashing import hashed_uniform
from fieldspark.operators import design as d
from fieldspark.operators import outlines, quality

C, L = F.col, F.lit
U = "('0x' || substr(md5(%s), 1, 8))::BIGINT / 4294967296.0::DOUBLE"

LHS = f"""(SELECT p_partkey AS sample, name, (row_number() OVER (PARTITION BY name ORDER BY {U % "'7|' || name || '|' || p_partkey"}, p_partkey) - {U % "'7j|' || name || '|' || p_partkey"}) / (SELECT count(*) FROM part) AS u
    FROM part, (VALUES ('a'), ('b.c'), ('d')) n(name))"""


def _members(spark, sf):
    return v.table(spark, sf, "part").select(C("p_partkey").alias("sample"))


@query("R1_latin_hypercube", f"SELECT sample, name, round(u, 10) AS u FROM {LHS}")
def _(spark, sf):
    return v.rounded(d.latin_hypercube(_members(spark, sf), ["a", "b.c", "d"], 7), ["u"], 10)


@query("R2_full_factorial", "SELECT row_number() OVER (ORDER BY a.s_suppkey, b.s_suppkey) - 1 AS sample, round((a.s_suppkey + 1) / n::DOUBLE, 10) AS a, round((b.s_suppkey + 1) / n::DOUBLE, 10) AS b, a.s_acctbal AS low, b.s_acctbal AS high FROM supplier a, supplier b, (SELECT count(*) AS n FROM supplier)")
def _(spark, sf):
    levels = v.table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")  # the values that the levels stand for
    n = levels.count()
    out = d.full_factorial(spark, ["a", "b"], n)
    # the levels go to the combinations, their square, which are never shuffled, whatever the session's threshold
    for name, value in (("a", "low"), ("b", "high")):
        out = out.withColumn("s_suppkey", F.round(C(name) * n).cast("bigint") - 1).join(F.broadcast(levels.withColumnRenamed("s_acctbal", value)), "s_suppkey").drop("s_suppkey")
    return v.rounded(out, ["a", "b"], 10)


def _poly(cs, x):
    out = repr(cs[-1])
    for c in reversed(cs[:-1]):
        out = f"({out} * {x} + {c!r})"
    return out


def _ratio(pair, x):
    return f"({_poly([float(c) for c in pair[0]], x)} / {_poly([float(c) for c in pair[1]], x)})"


def sql_inverse_normal(u: str) -> str:
    t = f"sqrt(-ln(least({u}, 1 - {u})))"
    return (f"(CASE WHEN abs({u} - 0.5) <= 0.425 THEN ({u} - 0.5) * {_ratio(dist.CENTRE, f'(0.180625 - ({u} - 0.5) * ({u} - 0.5))')} "
            f"ELSE sign({u} - 0.5) * CASE WHEN {t} <= 5 THEN {_ratio(dist.NEAR, f'({t} - 1.6)')} ELSE {_ratio(dist.FAR, f'({t} - 5)')} END END)")


SPECS = {
    "uni": {"distribution": "uniform", "loc": 300000.0, "scale": 450000.0},
    "int": {"distribution": "randint", "low": 2, "high": 9},
    "norm": {"distribution": "norm", "loc": 5.0, "scale": 2.0},
    "trunc": {"distribution": "truncnorm", "loc": 0.0, "scale": 2.0, "lower": -1.0, "upper": 3.0},
    "logn": {"distribution": "lognorm", "s": 0.5, "loc": 0.0, "scale": 3.0},
    "exp": {"distribution": "expon", "loc": 1.0, "scale": 2.0},
    "pick": {"distribution": "choices", "choices": ["ssa", "sia", "blatter"], "weights": [2.0, 0.0, 1.0]},
}
PA, PB = dist.normal_cdf(-0.5), dist.normal_cdf(1.5)


def _quantile_sql() -> str:
    u = {n: U % f"'1|{n}|' || c_custkey" for n in SPECS}
    k = {n: f"least(greatest({x}, 2.220446049250313e-16::DOUBLE), 1 - 2.220446049250313e-16::DOUBLE)" for n, x in u.items()}
    inner = ", ".join(f'{x} AS "{n}"' for n, x in k.items())
    return f"""SELECT c_custkey AS sample, round(uni * 450000 + 300000, 6) AS uni, CAST(greatest(least(ceil("int" * 7) - 1 + 2, 8), 2) AS BIGINT) AS "int",
        round({sql_inverse_normal('norm')} * 2 + 5, 8) AS norm, round({sql_inverse_normal('tu')} * 2, 8) AS trunc, round(exp({sql_inverse_normal('logn')} * 0.5) * 3, 8) AS logn,
        round(-ln(1 - "exp") * 2 + 1, 8) AS "exp", CASE WHEN pick <= 2.0 / 3 THEN 'ssa' ELSE 'blatter' END AS pick FROM (SELECT *, trunc * ({PB!r} - {PA!r}) + {PA!r} AS tu FROM (SELECT c_custkey, {inner} FROM customer))"""


@query("R3_inverse_cdf", _quantile_sql())
def _(spark, sf):
    c = v.table(spark, sf, "customer").select(C("c_custkey").alias("sample"))
    long = c.select("sample", F.explode(F.array(*[L(n) for n in SPECS])).alias("name"))
    long = long.withColumn("u", hashed_uniform(L(1), C("name"), C("sample")))
    out = dist.transform_quantiles(long, SPECS)
    return v.rounded(v.rounded(out, ["uni"], 6), ["norm", "trunc", "logn", "exp"], 8)


@query("R3_loggamma", f"SELECT c_custkey AS sample, round(ln(-ln(1 - {U % 'CAST(c_custkey AS VARCHAR)'})), 6) AS x FROM customer")
def _(spark, sf):
    u = hashed_uniform(C("c_custkey"))
    spec = {"distribution": "loggamma", "c": 1.0, "loc": 0.0, "scale": 1.0}
    return v.table(spark, sf, "customer").select(C("c_custkey").alias("sample"), F.round(dist.quantile(u, spec), 6).alias("x"))


DERIVED = {"z_max": {"derived_from": "z_min", "offset": 1050.0}, "z_top": {"derived_from": "z_max", "scale": 2.0}, "half": {"derived_from": "price", "scale": 0.5, "offset": 1.0}}


@query("R7_derived_parameters", "SELECT p_partkey AS sample, p_size AS z_min, CAST(p_size + 1050 AS BIGINT) AS z_max, CAST((p_size + 1050) * 2 AS BIGINT) AS z_top, p_retailprice AS price, round(p_retailprice / 2 + 1, 6) AS half FROM part")
def _(spark, sf):
    p = v.table(spark, sf, "part").select(C("p_partkey").alias("sample"), C("p_size").alias("z_min"), C("p_retailprice").alias("price"))
    return v.rounded(d.apply_derived(p, DERIVED), ["half"], 6)


@query("R8_posterior_merge", f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer)
    SELECT o_orderkey AS sample, o_custkey AS other, p.c_acctbal AS price FROM orders JOIN p ON p.k = CAST(floor({U % "'42|' || o_orderkey"} * (SELECT count(*) FROM customer)) AS BIGINT)""")
def _(spark, sf):
    des = v.table(spark, sf, "orders").select(C("o_orderkey").alias("sample"), C("o_totalprice").alias("price"), C("o_custkey").alias("other"))
    post = v.table(spark, sf, "customer").select(C("c_custkey").alias("row"), C("c_acctbal").alias("price"))
    return d.posterior_merge(des, post)


@query("J7_design_cross_files", "SELECT 'f' || s_suppkey || '_uq_' || p_partkey AS sample, s_suppkey * 2 AS climate, p_size AS size FROM supplier, part")
def _(spark, sf):
    files = v.table(spark, sf, "supplier").select(F.concat(L("f"), C("s_suppkey").cast("string")).alias("sample_df"), (C("s_suppkey") * 2).alias("climate"))
    return d.cross_files(files, v.table(spark, sf, "part").select(C("p_partkey").alias("sample_uq"), C("p_size").alias("size")))


@query("J8_positional_choice", "SELECT o_orderkey AS sample, r_name AS flag FROM orders JOIN region ON r_regionkey = o_custkey % 5")
def _(spark, sf):
    des = v.table(spark, sf, "orders").select(C("o_orderkey").alias("sample"), (C("o_custkey") % 5).alias("flag"))
    return d.choice_lookup(des, v.table(spark, sf, "region"), {"flag": "r_name", "absent": "r_name"}, "r_regionkey")


@query("J26_scope_by_ids", """WITH w AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 9000), l AS (SELECT c_custkey AS g, 1000000 + c_custkey // 6 AS c FROM customer),
    p AS (SELECT DISTINCT c FROM l JOIN w ON w.id = l.g) SELECT c AS id, 'C' AS kind FROM p UNION ALL SELECT g, 'G' FROM l WHERE c IN (SELECT c FROM p) OR g IN (SELECT id FROM w)""")
def _(spark, sf):
    c = v.table(spark, sf, "customer")
    links = c.select(C("c_custkey").alias("g_id"), (F.floor(C("c_custkey") / 6) + 1000000).alias("c_id"))
    return d.scope_ids(links, c.where("c_acctbal > 9000").select(C("c_custkey").alias("id")))


@query("J27_override_filter", """SELECT user_id AS member, 'k' || event_id % 40 AS key, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = user_id AND 'k' || o_orderkey % 40 = 'k' || event_id % 40) THEN 'kept' ELSE 'skipped' END AS state, count(*) AS n FROM events GROUP BY ALL""")
def _(spark, sf):
    key = lambda c: F.concat(L("k"), (C(c) % 40).cast("string")).alias("key")
    over = v.table(spark, sf, "events").select(C("user_id").alias("member"), key("event_id"))
    allowed = v.table(spark, sf, "orders").select(C("o_custkey").alias("member"), key("o_orderkey"))
    counted = over.groupBy("member", "key").agg(F.count(L(1)).alias("n"))  # equal overrides have one state
    return d.mark_overrides(counted, allowed).select("member", "key", "state", "n")


CODES = ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in d.CORE_EXPERIMENTS)


@query("J28_experiment_lookup", f"""SELECT o_orderkey, t.experiment, t.pathway, t.esm_id, CASE WHEN t.c IS NULL THEN DATE '2050-01-01' ELSE make_date(t.end_year + 1, 1, 1) END AS end_date FROM orders
    LEFT JOIN (VALUES {CODES}) t(c, experiment, pathway, esm_id, end_year, product_leg) ON t.c = CASE WHEN o_custkey % 9 > 0 THEN 'C00' || o_custkey % 9 END""")
def _(spark, sf):
    k = C("o_custkey") % 9
    o = v.table(spark, sf, "orders").select("o_orderkey", F.when(k > 0, F.concat(L(" c00"), k.cast("string"), L(" "))).alias("code"))
    out = d.resolve_experiments(o, "code", spark, F.when(C("code").isNull(), F.to_date(L("2050-01-01"))))
    return out.select("o_orderkey", "experiment", "pathway", "esm_id", "end_date")


@query("J29_forcing_pairs", """SELECT 'gcm_S' || s_suppkey || '_exp_ssp585_hist' AS sample, 'clim_S' || s_suppkey || '_anomalies_ssp585_hist_v1.nc' AS climate_file, 'grid.nc' AS grid_file FROM supplier
    UNION ALL SELECT 'gcm_S' || s_suppkey || '_exp_ssp126_hist', 'clim_S' || s_suppkey || '_anomalies_ssp126_hist_v1.nc', 'grid.nc' FROM supplier UNION ALL SELECT 'clim', 'clim_v1.nc', 'grid.nc'""")
def _(spark, sf):
    pair = lambda f: F.struct(L(f).alias("future"), L("hist").alias("present"))
    g = v.table(spark, sf, "supplier").select(F.concat(L("S"), C("s_suppkey").cast("string")).alias("gcm"), F.array(pair("ssp585"), pair("ssp126")).alias("pairs"))
    return d.forcing_pairs(g, "clim", "v1", {"grid_file": "grid.nc"})


@query("J29_file_index", """SELECT c_custkey AS member, path, CASE WHEN path IS NULL THEN NULL WHEN path LIKE 'snap%' THEN path[1:14] ELSE CAST(i AS VARCHAR) END AS sample FROM customer LEFT JOIN
    (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY path) - 1 AS i FROM (SELECT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'snap_1980_2009_' ELSE 'era_' END || o_orderkey AS path FROM orders)) f ON o_custkey = c_custkey""")
def _(spark, sf):
    name = F.concat(F.when(C("o_orderkey") % 2 == 0, "snap_1980_2009_").otherwise("era_"), C("o_orderkey").cast("string"))
    files = v.table(spark, sf, "orders").select(C("o_custkey").alias("member"), name.alias("path"))
    return d.file_index(files, v.table(spark, sf, "customer").select(C("c_custkey").alias("member")))


@query("J29_epoch_columns", """SELECT o_custkey AS member, max(CASE WHEN o_orderstatus = 'F' AND year(o_orderdate) < 1998 THEN CAST(o_orderkey AS VARCHAR) END) AS "F_hist_file", max(CASE WHEN o_orderstatus = 'F' AND year(o_orderdate) >= 1998 THEN CAST(o_orderkey AS VARCHAR) END) AS "F_proj_file",
    max(CASE WHEN o_orderstatus = 'O' AND year(o_orderdate) < 1998 THEN CAST(o_orderkey AS VARCHAR) END) AS "O_hist_file", max(CASE WHEN o_orderstatus = 'O' AND year(o_orderdate) >= 1998 THEN CAST(o_orderkey AS VARCHAR) END) AS "O_proj_file" FROM orders GROUP BY 1""")
def _(spark, sf):
    o = v.table(spark, sf, "orders").select(C("o_custkey").alias("member"), C("o_orderstatus").alias("kind"), C("o_orderkey").cast("string").alias("path"),
                                            F.when(F.year("o_orderdate") < 1998, "hist").otherwise("proj").alias("epoch"))
    return d.epoch_columns(o, "member", "kind", "epoch", "path", ["F", "O"], ["hist", "proj"])


@query("J30_aggregate_groups", """SELECT n_regionkey AS grp, CAST(count(*) AS BIGINT) AS n_members, round(sum(c_acctbal), 2) AS area_km2, (SELECT min_by(s, (-n, s)) FROM (SELECT c2.c_mktsegment AS s, count(*) AS n FROM customer c2 JOIN nation n2 ON c2.c_nationkey = n2.n_nationkey WHERE n2.n_regionkey = n.n_regionkey GROUP BY 1)) AS crs
    FROM customer JOIN nation n ON c_nationkey = n_nationkey GROUP BY n_regionkey""")
def _(spark, sf):
    m = v.table(spark, sf, "customer").join(v.table(spark, sf, "nation"), C("c_nationkey") == C("n_nationkey"))
    out = d.aggregate_groups(m.select(C("n_regionkey").alias("grp"), "c_acctbal", "c_mktsegment"), "grp", "c_acctbal", "c_mktsegment")
    return v.rounded(out, ["area_km2"], 2)


@query("J30_member_tags", """SELECT 'R' || s_suppkey AS region, concat_ws(';', CASE WHEN s_suppkey % 3 = 0 THEN 'old' END, CASE WHEN s_nationkey % 2 = 0 THEN 'even' END, CASE WHEN s_nationkey < 10 THEN 'low' END) AS tags FROM supplier""")
def _(spark, sf):
    s = v.table(spark, sf, "supplier").withColumn("region", F.concat(L("R"), C("s_suppkey").cast("string")))
    groups = s.select("region", F.explode(F.array_compact(F.array(F.when(C("s_nationkey") % 2 == 0, "even"), F.when(C("s_nationkey") < 10, "low")))).alias("grp"))
    members = s.select("region", F.when(C("s_suppkey") % 3 == 0, "old").otherwise("").alias("tags"))
    return outlines.merge_group_tags(members, groups)


@query("J31_built_or_fallback", """SELECT c_custkey AS id, min(CAST(o_orderkey AS VARCHAR)) AS path, CASE WHEN min(o_orderkey) IS NULL THEN 'compute' ELSE 'use' END AS action FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey GROUP BY 1""")
def _(spark, sf):
    cat = v.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(C("o_custkey").alias("id"), C("o_orderkey").cast("string").alias("path"))
    return d.built_or_fallback(v.table(spark, sf, "customer").select(C("c_custkey").alias("id")), cat, ["id"])


@query("R9_run_matrix", """SELECT o_orderkey AS member, key, value FROM (SELECT o_orderkey, unnest(['a.status', 'b.cust']) AS key, unnest([o_orderstatus, CASE WHEN o_custkey % 4 <> 0 THEN CAST(o_custkey AS VARCHAR) END]) AS value FROM orders)
    WHERE value IS NOT NULL AND (key = 'b.cust' OR o_orderkey % 2 = 0)""")
def _(spark, sf):
    o = v.table(spark, sf, "orders").select(C("o_orderkey").alias("run"), C("o_orderstatus").alias("a.status"), F.when(C("o_custkey") % 4 != 0, C("o_custkey")).alias("b.cust"))
    keys = F.array_compact(F.array(L("b.cust"), F.when(C("run") % 2 == 0, "a.status")))
    return d.run_matrix(o, "run", ["a.status", "b.cust"], o.select(C("run").alias("member"), F.explode(keys).alias("key")))


@query("R10_leg_expansion", """WITH m AS (SELECT o_orderkey AS member, CAST(o_orderdate AS DATE) AS s, DATE '2100-01-01' AS e, o_custkey % 2 = 0 AS init, o_custkey % 3 <> 0 AS code, CASE WHEN o_custkey % 5 < 2 THEN 'historical' ELSE 'projection' END AS prod FROM orders)
    SELECT member, CAST(0 AS INT) AS leg_no, 'init' AS leg, CAST(s - INTERVAL 12 MONTH AS DATE) AS t0, s AS t1, NULL AS input_file, TRUE AS bootstrap, FALSE AS is_product FROM m WHERE init
    UNION ALL SELECT member, 1, 'historical', s, CASE WHEN code THEN DATE '2015-01-01' ELSE e END, CASE WHEN init THEN 'state_' || member || '_init.nc' END, NOT init, code AND prod = 'historical' FROM m
    UNION ALL SELECT member, 2, 'projection', DATE '2015-01-01', e, 'state_' || member || '_historical.nc', FALSE, TRUE FROM m WHERE code AND prod = 'projection'""")
def _(spark, sf):
    k = C("o_custkey")
    m = v.table(spark, sf, "orders").select(C("o_orderkey").alias("member"), F.to_date("o_orderdate").alias("start"), F.to_date(L("2100-01-01")).alias("end"), (k % 2 == 0).alias("has_init"),
                                            (k % 3 != 0).alias("has_code"), F.when(k % 5 < 2, "historical").otherwise("projection").alias("product_leg"))
    return d.expand_legs(m)


@query("V3_spec_checks", """SELECT CAST(p_partkey AS VARCHAR) AS name, CASE p_size % 4 WHEN 0 THEN 'uniform' WHEN 1 THEN 'truncnorm' WHEN 2 THEN 'choices' ELSE 'bogus' END AS distribution,
    concat_ws(';', CASE WHEN p_size % 4 = 3 THEN 'unknown distribution' END, CASE WHEN p_size % 4 = 2 AND p_size > 25 THEN 'weights length' END, CASE WHEN p_size % 4 = 2 AND p_size <= 25 AND p_size % 3 = 0 THEN 'weights value' END,
      CASE WHEN p_size % 4 = 2 AND p_size % 3 = 0 AND p_size <= 25 THEN 'weights sum' END, CASE WHEN p_size % 4 = 0 AND p_size > 40 THEN 'loc and scale' END, CASE WHEN p_size % 4 IN (0, 1) AND p_size % 5 = 0 THEN 'scale' END) AS errors FROM part""")
def _(spark, sf):
    s = C("p_size")
    kind = F.when(s % 4 == 0, " Uniform").when(s % 4 == 1, "truncnorm").when(s % 4 == 2, "choices").otherwise("bogus")
    par = F.map_filter(F.create_map(L("loc"), F.when(s <= 40, "1"), L("scale"), F.when(s % 5 == 0, "0").otherwise("2"), L("lower"), L("0"), L("upper"), L("1")), lambda _, x: x.isNotNull())
    w = F.when(s > 25, F.array(L(1.0))).otherwise(F.array(F.when(s % 3 == 0, -1.0).otherwise(1.0), L(1.0)))
    specs = v.table(spark, sf, "part").select(C("p_partkey").cast("string").alias("name"), kind.alias("distribution"), par.alias("params"), F.array(L("x"), L("y")).alias("choices"), w.alias("weights"))
    out = quality.check_specs(specs)
    return out.withColumn("errors", F.array_join("errors", ";"))
