"""Ensemble scoring and reports: A13-A18, A21, A22, A25-A30, A33, J25, R4, R5, W14."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fieldspark.catalog import views as v
from fieldspark.catalog.registry import query
from fieldspark.operators import calibrate as c
from fieldspark.operators import scan
from fieldspark.operators import zonal as z
from fieldspark.session import shared_dir

U = "('0x' || substr(md5(%s), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
BLOCKS = """(SELECT exp_id, iy // 4 AS "by", ix // 4 AS bx, sum((sim - obs) ** 2) AS s, count(*) AS c FROM
    (SELECT *, count(sim - obs) OVER (PARTITION BY iy, ix) AS n FROM {simobs}) WHERE n = (SELECT count(DISTINCT exp_id) FROM {simobs})
    AND (iy // 4 + 1) * 4 <= (SELECT max(iy) + 1 FROM {simobs}) AND (ix // 4 + 1) * 4 <= 60 GROUP BY ALL)"""
M32 = 4294967296


def _mix(x: str, source: str, keep: str = "*") -> str:
    """SQL: ``source`` with the mixed 32-bit number of its expression ``x`` as column h."""
    a = f"(SELECT {keep}, ({x})::UBIGINT AS h0 FROM {source})"
    b = f"(SELECT * EXCLUDE h0, xor(h0, h0 >> 16) * 2246822507 % {M32} AS h1 FROM {a})"
    c = f"(SELECT * EXCLUDE h1, xor(h1, h1 >> 13) * 3266489909 % {M32} AS h2 FROM {b})"
    return f"(SELECT * EXCLUDE h2, xor(h2, h2 >> 16) AS h FROM {c})"


def _start(source: str, node: str) -> str:
    """SQL: ``source`` (boot, ...) with the start number of a node of the draw tree as column a."""
    return _mix(f"(h + {node}) % {M32}", _mix("boot", source), "* EXCLUDE h")


def _drawn(source: str, i: str) -> str:
    """SQL: ``source`` (start a, draw i) with the draw's number as column h."""
    return _mix("xor(a, h)", _mix(i, source), "* EXCLUDE h")


def _boot(n_boot: int) -> str:
    """SQL: RMSE per member and resample, by the same draws."""
    return f"""(WITH b AS MATERIALIZED (SELECT * FROM {BLOCKS}), k AS MATERIALIZED (SELECT "by", bx, row_number() OVER (ORDER BY "by", bx) - 1 AS k FROM (SELECT DISTINCT "by", bx FROM b)),
    n AS (SELECT count(*)::UBIGINT AS n FROM k), e AS (SELECT * RENAME (h AS a) FROM {_start(f"(SELECT boot FROM range({n_boot}) r(boot))", "0")}),
    m AS (SELECT boot, ((h * n) >> 32) // {c.CHUNK} AS chunk, count(*) AS m FROM {_drawn("(SELECT * FROM e, k)", "k")}, n GROUP BY ALL),
    f AS (SELECT * RENAME (h AS a) FROM {_start("m", "chunk + 1")}),
    w AS (SELECT boot, (chunk * {c.CHUNK} + ((h * least({c.CHUNK}, n - chunk * {c.CHUNK})) >> 32))::BIGINT AS k, count(*) AS w FROM {_drawn("(SELECT * FROM f, unnest(range(m)) u(i))", "i")}, n GROUP BY ALL)
    SELECT exp_id, CAST(boot AS INT) AS boot, sqrt(sum(w * s) / greatest(sum(w * c), 1)) AS rmse FROM w JOIN k USING (k) JOIN b ON b."by" = k."by" AND b.bx = k.bx GROUP BY exp_id, boot)"""


def _blocks(spark, sf):
    li = v.table(spark, sf, "lineitem")
    known = li.agg(F.struct((F.max("l_suppkey") + 1).alias("ny"), F.count_distinct("l_linenumber").alias("members"))).scalar()
    return c.squared_error_blocks(v.simobs(spark, sf), 4, shape=(known["ny"], F.lit(v.NX)), members=known["members"])


@query("A13_squared_error_blocks", f'SELECT exp_id, "by", bx, round(s, 3) AS s, c FROM {BLOCKS}')
def _(spark, sf):
    return v.rounded(_blocks(spark, sf), ["s"], 3)


@query("A14_block_bootstrap_rmse", f"SELECT exp_id, boot, round(rmse, 6) AS rmse FROM {_boot(500)}")
def _(spark, sf):
    return v.rounded(c.bootstrap_rmse(_blocks(spark, sf)), ["rmse"], 6)


RANK = f"""(WITH r AS (SELECT exp_id, avg(rmse) AS rmse_mean, quantile_cont(rmse, 0.05) AS rmse_lo, quantile_cont(rmse, 0.95) AS rmse_hi FROM {_boot(200)} GROUP BY exp_id)
    SELECT *, rmse_lo <= (SELECT min_by(rmse_hi, (rmse_mean, exp_id)) FROM r) AS tied_with_best FROM r)"""
RANKS = ["rmse_mean", "rmse_lo", "rmse_hi"]


def _rank(spark, sf):
    return c.rank_members(c.bootstrap_rmse(_blocks(spark, sf), n_boot=200))


@query("A22_best_and_ties", f"SELECT exp_id, round(rmse_mean, 6) AS rmse_mean, round(rmse_lo, 6) AS rmse_lo, round(rmse_hi, 6) AS rmse_hi, tied_with_best FROM {RANK}")
def _(spark, sf):
    return v.rounded(_rank(spark, sf), RANKS, 6)


@query("J25_parameter_join", f"""SELECT r.exp_id, round(rmse_mean, 6) AS rmse_mean, p.k AS "surface.k" FROM {RANK} r
    LEFT JOIN (SELECT CAST(user_id AS INT) AS exp_id, CAST(max_by(json_extract_string(props, '$.k'), event_id) AS DOUBLE) AS k FROM events GROUP BY user_id) p ON p.exp_id = r.exp_id""")
def _(spark, sf):
    last = v.table(spark, sf, "events").groupBy(F.col("user_id").cast("int").alias("exp_id")).agg(F.max_by("props", "event_id").alias("p"))
    members = last.select("exp_id", F.to_json(F.create_map(F.lit("surface.k"), F.get_json_object("p", "$.k"))).alias("config"))
    out = c.join_parameters(_rank(spark, sf).select("exp_id", "rmse_mean"), members, "config", ["surface.k"])
    return v.rounded(out, ["rmse_mean"], 6).orderBy("rmse_mean")


# direct sums over the lags up to twelve cells, behind the crossing of all fields; tests compare with the transform
@query("A15_decorrelation_length", """WITH f AS (SELECT field, iy, ix, q + 20 * sin(iy / 5.0::DOUBLE) + 15 * cos(ix / 3.0::DOUBLE) AS v FROM (SELECT l_returnflag AS field, l_suppkey AS iy, l_partkey % 60 AS ix, avg(l_quantity) AS q FROM lineitem GROUP BY ALL)),
    k AS (SELECT count(*) AS n FROM supplier), a AS (SELECT field, iy % n AS iy, ix, v - avg(v) OVER (PARTITION BY field) AS a FROM f, k),
    z AS (SELECT field, sum(a * a) AS v0 FROM a GROUP BY field),
    l AS (SELECT dy, dx, CAST(floor(sqrt(dy * dy + dx * dx)) AS INT) AS r FROM range(-13, 14) y(dy), range(-13, 14) x(dx), k WHERE sqrt(dy * dy + dx * dx) < 13 AND dy >= -(n // 2) AND dy < n - n // 2),
    c AS (SELECT r, count(*) AS lags FROM l GROUP BY r),
    h AS (SELECT field, a, r, (iy + dy + n) % n AS iy, (ix + dx + 60) % 60 AS ix FROM a, l, k), s AS (SELECT h.field, r, sum(h.a * q.a) AS s FROM h JOIN a q ON q.field = h.field AND q.iy = h.iy AND q.ix = h.ix GROUP BY ALL)
    SELECT field, CAST(coalesce(min(CASE WHEN s / lags / v0 < exp(-1) THEN r END), min(least(n // 2, 30))) AS DOUBLE) AS length FROM s JOIN c USING (r) JOIN z USING (field) CROSS JOIN k GROUP BY field""")
def _(spark, sf):
    shared_dir(spark)
    ny = v.table(spark, sf, "supplier").count()
    f = v.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("field"), F.col("l_suppkey").alias("iy"), (F.col("l_partkey") % v.NX).alias("ix")).agg(F.avg("l_quantity").alias("q"))
    f = f.withColumn("v", F.col("q") + 20 * F.sin(F.col("iy") / 5.0) + 15 * F.cos(F.col("ix") / 3.0))
    return c.decorrelation_length(f, "v", ny, v.NX, ["field"])


STD = "(0.1 * obs)"


@query("A16_log_normal", f"""SELECT exp_id, round(avg(CASE WHEN l <> 0 THEN l END), 6) AS log_likelihood FROM
    (SELECT exp_id, -0.5 * ((sim - obs) / {STD}) ** 2 - 0.5 * ln(2 * pi() * {STD} ** 2) AS l FROM {{simobs}}) GROUP BY exp_id""")
def _(spark, sf):
    terms = c.log_normal(F.col("sim"), F.col("obs"), F.col("obs") * 0.1)
    return v.rounded(c.mean_log_likelihood(v.simobs(spark, sf), ["exp_id"], terms), ["log_likelihood"], 6)


@query("A17_log_pseudo_huber", f"""SELECT exp_id, round(avg(CASE WHEN l <> 0 THEN l END), 6) AS log_likelihood FROM
    (SELECT exp_id, -4 * (sqrt(1 + ((sim - obs) / (3 * {STD}) / 2) ** 2) - 1) - 1 AS l FROM {{simobs}}) GROUP BY exp_id""")
def _(spark, sf):
    terms = c.log_pseudo_huber(F.col("sim"), F.col("obs"), F.col("obs") * 0.1, fudge=3.0)
    return v.rounded(c.mean_log_likelihood(v.simobs(spark, sf), ["exp_id"], terms), ["log_likelihood"], 6)


@query("A18_log_jaccard", """SELECT exp_id, round(-count(*) FILTER (a > 0 AND b > 0) / greatest(count(*) FILTER (a > 0 OR b > 0), 1)::DOUBLE, 8) + 0.0 AS log_likelihood FROM
    (SELECT exp_id, sim - 1500 AS a, obs - 1450 AS b FROM {simobs}) GROUP BY exp_id""")
def _(spark, sf):
    d = v.simobs(spark, sf).select("exp_id", (F.col("sim") - 1500).alias("a"), (F.col("obs") - 1450).alias("b"))
    return v.rounded(c.log_jaccard(d, ["exp_id"], "a", "b"), ["log_likelihood"], 8)


@query("A21_ensemble_quantiles", "SELECT month, gcm_id, " + ", ".join(f"round(quantile_cont(value, {p}), 4) AS q{i}" for i, p in enumerate((0.05, 0.16, 0.5, 0.84, 0.95))) + " FROM {series} GROUP BY ALL")
def _(spark, sf):
    q = c.ensemble_quantiles(v.series(spark, sf), ["month", "gcm_id"], "value", [0.05, 0.16, 0.5, 0.84, 0.95])
    return q.select("month", "gcm_id", *[F.round(F.col("q")[i], 4).alias(f"q{i}") for i in range(5)])


@query("A21_quantiles_propagating", "SELECT iy, CASE WHEN count(*) = count(v) THEN round(quantile_cont(v, 0.5), 6) END AS median FROM {holed} GROUP BY iy")
def _(spark, sf):
    q = c.ensemble_quantiles(v.holed(spark, sf), ["iy"], "v", [0.5], skipna=False)
    return q.select("iy", F.round(F.col("q")[0], 6).alias("median"))


@query("A21_field_quantiles", "SELECT t, round(quantile_cont(thk, 0.02), 6) AS lo, round(quantile_cont(thk, 0.98), 6) AS hi FROM {cells} GROUP BY t")
def _(spark, sf):
    q = scan.exact_quantiles(v.cells(spark, sf), ["t"], "thk", [0.02, 0.98])
    return q.select("t", F.round("q0", 6).alias("lo"), F.round("q1", 6).alias("hi"))


@query("A25_group_shares", """SELECT r_name, round(total, 2) AS total, round(part, 2) AS part, round(part * 100 / total, 8) AS done_pct, round(total * 100 / sum(total) OVER (), 8) AS share_pct FROM
    (SELECT n_regionkey AS r_name, sum(c_acctbal) AS total, coalesce(sum(CASE WHEN o_custkey IS NOT NULL THEN c_acctbal END), 0) AS part FROM customer JOIN nation ON c_nationkey = n_nationkey
     LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey GROUP BY 1)""")
def _(spark, sf):
    cust = v.table(spark, sf, "customer").join(v.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("r_name"), "c_acctbal", "c_custkey")
    done = v.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return v.rounded(v.rounded(z.group_shares(cust, "r_name", "c_acctbal", done, "c_custkey"), ["total", "part"], 2), ["done_pct", "share_pct"], 8)


LOG_EDGES = [float(e) for e in np.logspace(-1, 4, 6)]


@query("A26_log_histogram", """SELECT region, b AS bin, count(*) AS n FROM (SELECT event_type AS region, CASE WHEN value > 0.1 AND value <= 10000 THEN CAST(
      (value > 1)::INT + (value > 10)::INT + (value > 100)::INT + (value > 1000)::INT AS INT) END AS b FROM events) WHERE b IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    e = v.table(spark, sf, "events").select(F.col("event_type").alias("region"), z.log_bin(F.col("value"), LOG_EDGES).alias("bin"))
    return e.where("bin is not null").groupBy("region", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("A26_weighted_histogram", """WITH p AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY p_brand)
    SELECT part.p_brand AS brand, CAST(least(floor((p_retailprice - lo) * 15 / (hi - lo)), 14) AS BIGINT) AS bin, CAST(sum(p_size) AS BIGINT) AS weight FROM part JOIN p USING (p_brand) GROUP BY ALL""")
def _(spark, sf):
    p = v.table(spark, sf, "part")
    lim = p.groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    b = z.equal_bin(F.col("p_retailprice"), F.col("lo"), F.col("hi"), 15)
    return p.join(lim, "p_brand").groupBy(F.col("p_brand").alias("brand"), b.alias("bin")).agg(F.sum("p_size").alias("weight"))


@query("A27_fingerprint_agreement", """SELECT t, t % 3 <> 1 OR abs(sum(ice_mass) - sum(thk * 1500)) <= 1e-6 * sum(thk * 1500) AS agrees, round(sum(ice_mass), 2) AS total FROM {cells} GROUP BY t""")
def _(spark, sf):
    cells = v.cells(spark, sf)
    whole = cells.groupBy("t").agg(F.sum("ice_mass").alias("s"))
    slabs = cells.groupBy("t", "iy").agg(F.sum("ice_mass").alias("s")).groupBy("t").agg(F.sum("s").alias("s"))
    # every third step is compared with another quantity, so that some fingerprints differ
    other = cells.groupBy("t").agg(F.sum(F.col("thk") * 1500).alias("o"))
    right = whole.join(other, "t").select("t", F.when(F.col("t") % 3 == 1, F.col("o")).otherwise(F.col("s")).alias("s"))
    return z.agree(slabs, right, ["t"], "s").join(whole.select("t", F.round("s", 2).alias("total")), "t")


WEIGHTED = f"(SELECT exp_id, ll, exp(ll - max(ll) OVER ()) / sum(exp(ll - m)) OVER () AS weight FROM (SELECT *, max(ll) OVER () AS m FROM (SELECT exp_id, -avg(((value - 150000) / 80000) ** 2) / 10 AS ll FROM {{series}} GROUP BY exp_id)))"


def _weights(spark, sf):
    ll = v.series(spark, sf).groupBy("exp_id").agg((-F.avg(((F.col("value") - 150000) / 80000) ** 2) / 10).alias("log_likelihood"))
    return c.normalised_weights(ll)


@query("W14_normalised_weights", f"SELECT exp_id, round(ll, 8) AS log_likelihood, round(weight, 8) AS weight FROM {WEIGHTED}")
def _(spark, sf):
    return v.rounded(_weights(spark, sf), ["log_likelihood", "weight"], 8)


DRAWS = f"""(WITH w AS (SELECT exp_id, sum(weight) OVER (ORDER BY exp_id) - weight AS lo, CASE WHEN exp_id = max(exp_id) OVER () THEN 1.0 ELSE sum(weight) OVER (ORDER BY exp_id) END AS hi FROM {WEIGHTED})
    SELECT CAST(draw AS INT) AS draw, exp_id FROM range(%d) r(draw) JOIN w ON {U % "'3|' || draw"} >= lo AND {U % "'3|' || draw"} < hi)"""


@query("R4_weighted_resampling", f"SELECT * FROM {DRAWS % 2000}")
def _(spark, sf):
    return c.resample(_weights(spark, sf), "exp_id", "weight", 2000, seed=3)


@query("A28_resample_counts", f"SELECT exp_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, exp_id) = 1 AS most_drawn FROM {DRAWS % 5000} GROUP BY exp_id")
def _(spark, sf):
    return c.draw_counts(c.resample(_weights(spark, sf), "exp_id", "weight", 5000, seed=3), "exp_id")


IS = """WITH m AS (SELECT user_id % 12 AS exp_id, CAST(ts AS DATE) AS time, avg(value) AS sim FROM events GROUP BY ALL),
    o AS (SELECT CAST(ts AS DATE) AS time, avg(value) AS obs, 20.0 AS std FROM events WHERE event_type = 'view' GROUP BY ALL),
    s AS (SELECT m.exp_id, avg(-0.5 * ((sim - obs) / 60) ** 2 - 0.5 * ln(2 * pi() * 3600)) AS ll FROM m JOIN o USING (time) GROUP BY exp_id)"""


@query("R5_importance_sampling_weights", IS + """ SELECT exp_id, round(ll, 6) AS log_likelihood, round(exp(ll - max(ll) OVER ()) / (SELECT sum(exp(ll - (SELECT max(ll) FROM s))) FROM s), 8) AS weight FROM s""")
def _(spark, sf):
    e = v.table(spark, sf, "events").withColumn("time", F.to_date("ts"))
    sim = e.groupBy((F.col("user_id") % 12).alias("exp_id"), "time").agg(F.avg("value").alias("sim"))
    obs = e.where("event_type = 'view'").groupBy("time").agg(F.avg("value").alias("obs")).withColumn("std", F.lit(20.0))
    scores, _ = c.importance_sampling(sim, obs, "exp_id", "time", scan.time_block("time", 31), interpolate=False)
    return v.rounded(v.rounded(scores, ["log_likelihood"], 6), ["weight"], 8)


@query("R5_importance_sampling_draws", IS.replace("m AS (", "m0 AS (").replace("s AS (SELECT m.exp_id", """m AS (SELECT exp_id, o.time, CASE WHEN t0 = o.time THEN v0 ELSE v0 + (v1 - v0) * (o.time - t0) / (t1 - t0)::DOUBLE END AS sim FROM (
      SELECT e.exp_id, o.time, max(m0.time) FILTER (m0.time <= o.time) AS t0, min(m0.time) FILTER (m0.time >= o.time) AS t1, arg_max(sim, m0.time) FILTER (m0.time <= o.time) AS v0, arg_min(sim, m0.time) FILTER (m0.time >= o.time) AS v1
      FROM o, (SELECT DISTINCT exp_id FROM m0) e JOIN m0 ON m0.exp_id = e.exp_id GROUP BY ALL) o), s AS (SELECT m.exp_id""") + f""", w AS (SELECT exp_id, exp(ll - (SELECT max(ll) FROM s)) / (SELECT sum(exp(ll - (SELECT max(ll) FROM s))) FROM s) AS weight FROM s),
    c AS (SELECT exp_id, sum(weight) OVER (ORDER BY exp_id) - weight AS lo, CASE WHEN exp_id = max(exp_id) OVER () THEN 1.0 ELSE sum(weight) OVER (ORDER BY exp_id) END AS hi FROM w)
    SELECT CAST(draw AS INT) AS draw, exp_id FROM range(100) r(draw) JOIN c ON {U % "'0|' || draw"} >= lo AND {U % "'0|' || draw"} < hi""")
def _(spark, sf):
    e = v.table(spark, sf, "events").withColumn("time", F.to_date("ts"))
    sim = e.groupBy((F.col("user_id") % 12).alias("exp_id"), "time").agg(F.avg("value").alias("sim"))
    obs = e.where("event_type = 'view'").groupBy("time").agg(F.avg("value").alias("obs")).withColumn("std", F.lit(20.0))
    return c.importance_sampling(sim, obs, "exp_id", "time", scan.time_block("time", 31))[1]


@query("A29_weighted_misfit", """SELECT l_linenumber AS member, round(sqrt(sum(l_quantity * (l_discount - l_tax) ** 2) / sum(l_quantity)), 8) AS misfit, round(any_value(n), 8) AS norm FROM lineitem
    JOIN (SELECT l_linenumber AS ln, sqrt(max_by(l_extendedprice, (l_shipdate, l_orderkey, l_partkey, l_suppkey, l_extendedprice))) AS n FROM lineitem GROUP BY ALL) ON ln = l_linenumber GROUP BY l_linenumber""")
def _(spark, sf):
    li = v.table(spark, sf, "lineitem").withColumns({"member": F.col("l_linenumber"), "r": F.col("l_discount") - F.col("l_tax"),
                                                     "it": F.struct("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")})
    out = c.weighted_misfit(li, "member", "l_quantity", "r").join(c.last_iteration_norm(li, "member", "l_extendedprice", "it"), "member")
    return v.rounded(out, ["misfit", "norm"], 8)


@query("A30_status_counts", """SELECT o_orderpriority AS job, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1""")
def _(spark, sf):
    return v.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("job")).agg(
        *[F.count_if(F.col("o_orderstatus") == x).alias(f"n_{x.lower()}") for x in "FOP"])


@query("A33_distinct_and_mode", """SELECT k.user_id, k.n_types, m.event_type AS mode_type FROM (SELECT user_id, count(DISTINCT event_type) AS n_types FROM events GROUP BY 1) k JOIN
    (SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1) m USING (user_id)""")
def _(spark, sf):
    n = v.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    first = F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type")))
    return n.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_types"), first.alias("mode_type"))
