"""Fields: resampling, remaps, mosaics, fills, alignment and climatologies."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.catalog import views as v
from fieldspark.catalog.registry import query
from fieldspark.operators import align, climatology, distance, regrid
from fieldspark.operators import series as s
from fieldspark.operators.outlines import Grid

COARSE = Grid(x0=-0.4, y0=0.7, dx=2.5, dy=3.25)


def _targets(spark, sf):
    return v.grid(spark, sf).select(F.col("iy").alias("ty"), F.col("ix").alias("tx"),
                                    (F.col("ix") * 0.9 + 0.31).alias("sx"), (F.col("iy") * 0.97 + 0.173).alias("sy"))


BILINEAR = """WITH t AS (SELECT iy AS ty, ix AS tx, ix * 0.9::DOUBLE + 0.31::DOUBLE - 0.5 AS u, iy * 0.97::DOUBLE + 0.173::DOUBLE - 0.5 AS w FROM {grid}),
    n AS (SELECT ty, tx, CAST(floor(w) AS BIGINT) + dj AS iy, CAST(floor(u) AS BIGINT) + di AS ix,
      (CASE WHEN di = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN dj = 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END) AS k
      FROM t, range(2) a(di), range(2) b(dj))"""


@query("J18_bilinear", BILINEAR + """ SELECT ty, tx, round(sum(k * v) / sum(CASE WHEN v IS NOT NULL THEN k END), 6) + 0.0 AS v
    FROM n LEFT JOIN {holed} h USING (iy, ix) GROUP BY ALL""")
def _(spark, sf):
    return v.rounded(regrid.bilinear(_targets(spark, sf), v.holed(spark, sf), ["v"]), ["v"], 6)


@query("M6_profile_sampling", BILINEAR + """ SELECT ty, tx, CASE WHEN count(v) = 4 THEN round(sum(k * v), 6) + 0.0 END AS v
    FROM n LEFT JOIN {holed} h USING (iy, ix) GROUP BY ALL""")
def _(spark, sf):
    return v.rounded(regrid.bilinear(_targets(spark, sf), v.holed(spark, sf), ["v"], renormalise=False), ["v"], 6)


CONSERVATIVE = """(SELECT ty, tx, sum(w * v) / sum(CASE WHEN v IS NOT NULL THEN w END) AS v FROM (SELECT h.v, ty, tx,
      (least(h.iy + 1, 0.7::DOUBLE + (ty + 1) * 3.25) - greatest(h.iy, 0.7::DOUBLE + ty * 3.25)) * (least(h.ix + 1, -0.4::DOUBLE + (tx + 1) * 2.5) - greatest(h.ix, -0.4::DOUBLE + tx * 2.5)) AS w
    FROM {holed} h JOIN (SELECT unnest(range(-1, (SELECT max(s_suppkey) // 3 + 2 FROM supplier))) AS ty) a ON h.iy < 0.7::DOUBLE + (ty + 1) * 3.25 AND h.iy + 1 > 0.7::DOUBLE + ty * 3.25
      JOIN (SELECT unnest(range(-1, 40)) AS tx) b ON h.ix < -0.4::DOUBLE + (tx + 1) * 2.5 AND h.ix + 1 > -0.4::DOUBLE + tx * 2.5) WHERE w > 1e-12 GROUP BY ALL)"""


@query("J20_conservative_remap", f"SELECT CAST(ty AS BIGINT) AS ty, CAST(tx AS BIGINT) AS tx, round(v, 6) + 0.0 AS v FROM {CONSERVATIVE}")
def _(spark, sf):
    return v.rounded(regrid.conservative(v.holed(spark, sf), ["v"], Grid(), COARSE), ["v"], 6)


@query("J20_supersampled_remap", """SELECT ty, tx, round(avg(v), 6) + 0.0 AS v FROM
    (SELECT iy AS ty, ix AS tx, CAST(floor((iy + 0.5) * 0.97::DOUBLE + (b + 0.5) / 3 - 0.5) AS BIGINT) AS py, CAST(floor((ix + 0.5) * 0.9::DOUBLE + (a + 0.5) / 3 - 0.5) AS BIGINT) AS px
     FROM {grid}, range(3) x(a), range(3) y(b)) p JOIN {holed} h ON h.iy = py AND h.ix = px GROUP BY ALL""")
def _(spark, sf):
    t = v.grid(spark, sf).select(F.col("iy").alias("ty"), F.col("ix").alias("tx"),
                                 ((F.col("ix") + 0.5) * 0.9).alias("cx"), ((F.col("iy") + 0.5) * 0.97).alias("cy"))
    out = regrid.nearest_mean(regrid.supersample(t, 3), v.holed(spark, sf), ["v"], Grid(), ["ty", "tx"])
    return v.rounded(out, ["v"], 6)


@query("J21_majority_remap", """SELECT ty, tx, min_by(cls, (-n, cls)) AS cls FROM (SELECT CAST(floor((iy + 0.5 - 0.7::DOUBLE) / 3.25) AS BIGINT) AS ty,
      CAST(floor((ix + 0.5 + 0.4::DOUBLE) / 2.5) AS BIGINT) AS tx, cls, count(*) AS n FROM {flat} GROUP BY ALL) GROUP BY ALL""")
def _(spark, sf):
    return regrid.majority(v.flat(spark, sf), "cls", Grid(), COARSE)


GAPS = """WITH p AS (SELECT g.iy, g.ix, h.v, (g.iy - h.iy) ** 2 + (g.ix - h.ix) ** 2 AS d2, row_number() OVER (PARTITION BY g.iy, g.ix ORDER BY (g.iy - h.iy) ** 2 + (g.ix - h.ix) ** 2, h.iy, h.ix) AS rk
    FROM (SELECT * FROM {holed} WHERE v IS NULL) g, (SELECT * FROM {holed} WHERE v IS NOT NULL) h),
    f AS (SELECT iy, ix, sum(v / sqrt(d2)) / sum(1 / sqrt(d2)) AS f FROM p WHERE rk <= %d GROUP BY ALL)
    SELECT h.iy, h.ix, round(coalesce(h.v, f), 6) AS v FROM {holed} h LEFT JOIN f USING (iy, ix)"""


@query("J22_nearest_fill", GAPS % 1)
def _(spark, sf):
    return v.rounded(distance.fill_gaps(v.holed(spark, sf), "v"), ["v"], 6)


@query("J22_distance_weighted_fill", GAPS % 4)
def _(spark, sf):
    return v.rounded(distance.fill_gaps(v.holed(spark, sf), "v", neighbours=4), ["v"], 6)


def _tiles(spark, sf):
    return v.table(spark, sf, "lineitem").groupBy(
        F.col("l_linenumber").alias("tile"), F.col("l_suppkey").alias("iy"), (F.col("l_partkey") % v.NX).alias("ix")).agg(
        F.sum(F.col("l_quantity") - 20).alias("h"))


TILES = "(SELECT l_linenumber AS tile, l_suppkey AS iy, l_partkey % 60 AS ix, sum(l_quantity - 20) AS h FROM lineitem GROUP BY ALL)"


@query("J23_mosaic_max", f"SELECT iy, ix, max(CASE WHEN h <> 0 THEN h END) AS h FROM {TILES} GROUP BY ALL")
def _(spark, sf):
    return regrid.mosaic(_tiles(spark, sf), "h", "max")


@query("J23_mosaic_first", f"SELECT iy, ix, min_by(h, tile) AS h FROM {TILES} GROUP BY ALL")
def _(spark, sf):
    return regrid.mosaic(_tiles(spark, sf), "h", "first", "tile")


@query("J23_mosaic_sum", f"SELECT iy, ix, sum(h) AS h FROM {TILES} GROUP BY ALL")
def _(spark, sf):
    return regrid.mosaic(_tiles(spark, sf), "h", "sum")


@query("J24_two_phase_mosaic", f"""WITH one AS (SELECT m.region, iy, ix, max(CASE WHEN h <> 0 THEN h END) AS h FROM {TILES} t JOIN {{region_cells}} m USING (iy, ix) GROUP BY ALL)
    SELECT * FROM one UNION ALL SELECT 'C' || g, iy, ix, max(h) FROM
    (SELECT *, CAST(substr(region, 2) AS BIGINT) % 10 AS g FROM one UNION ALL SELECT *, 10 + CAST(substr(region, 2) AS BIGINT) % 7 FROM one) GROUP BY ALL""")
def _(spark, sf):
    k = F.substring("region", 2, 20).cast("bigint")
    listed = v.rings(spark, sf).select("region").distinct().withColumn(
        "rgi_id_c_aggregate", F.concat_ws(";", F.concat(F.lit("C"), (k % 10).cast("string")), F.concat(F.lit("C"), (10 + k % 7).cast("string"))))
    members = listed.select("region", F.explode(F.split("rgi_id_c_aggregate", ";")).alias("aggregate"))
    return regrid.two_phase_mosaic(_tiles(spark, sf), "h", v.region_cells(spark, sf), members)


# ------------------------------------------------------------ alignment

BASE = """(SELECT month, iy, ix, avg(tas) AS tas, avg(pr) AS pr FROM {monthly} WHERE scenario = 'A' GROUP BY ALL)"""
ANOM = """(SELECT scenario, month, iy, ix, avg(tas) / 10 AS tas, avg(pr) / 10 AS pr FROM {monthly} WHERE scenario <> 'A' GROUP BY ALL)"""


def _mean(spark, sf, *keys):
    return v.monthly(spark, sf).groupBy(*keys, "month", "iy", "ix").agg(F.avg("tas").alias("tas"), F.avg("pr").alias("pr"))


@query("J9_baseline_plus_anomaly", f"SELECT scenario, month, iy, ix, round(b.tas + a.tas, 8) + 0.0 AS tas, round(b.pr + a.pr, 8) + 0.0 AS pr FROM {BASE} b JOIN {ANOM} a USING (month, iy, ix)")
def _(spark, sf):
    m = _mean(spark, sf, "scenario")
    anomaly = m.where("scenario <> 'A'").withColumns({"tas": F.col("tas") / 10, "pr": F.col("pr") / 10})
    base = m.where("scenario = 'A'").drop("scenario")
    return v.rounded(align.add_anomaly(base, anomaly, ["month", "iy", "ix"], ["tas", "pr"]), ["tas", "pr"], 8)


@query("J10_future_minus_present", """WITH m AS (SELECT scenario, month, iy, ix, avg(tas) AS tas, greatest(avg(pr), 0) * 86400 AS pr FROM {monthly} GROUP BY ALL),
    st AS (SELECT DISTINCT scenario, month FROM m), n AS (SELECT s_suppkey AS ty, tx, s_suppkey AS iy, tx + d AS ix, CASE WHEN d = 1 THEN 0.25 ELSE 0.75 END AS w FROM supplier, range(6) a(tx), range(2) b(d)),
    r AS (SELECT st.scenario, st.month, ty, tx, sum(w * tas) / sum(CASE WHEN tas IS NOT NULL THEN w END) AS tas, sum(w * pr) / sum(CASE WHEN pr IS NOT NULL THEN w END) AS pr
      FROM n CROSS JOIN st LEFT JOIN m ON m.scenario = st.scenario AND m.month = st.month AND m.iy = n.iy AND m.ix = n.ix GROUP BY ALL),
    g AS (SELECT x.scenario, x.month, x.ty, x.tx, min_by({'tas': o.tas, 'pr': o.pr}, ((x.ty - o.ty) ** 2 + (x.tx - o.tx) ** 2, o.ty, o.tx)) AS near FROM r x JOIN r o USING (scenario, month)
      WHERE x.tas IS NULL AND o.tas IS NOT NULL GROUP BY ALL),
    f AS (SELECT scenario, month, ty, tx, coalesce(r.tas, near.tas) AS tas, coalesce(r.pr, near.pr) AS pr FROM r LEFT JOIN g USING (scenario, month, ty, tx))
    SELECT model, f.month, f.ty AS iy, f.tx AS ix, round(f.tas - p.tas, 5) + 0.0 AS tas, round((f.pr - p.pr) / 86400, 9) + 0.0 AS pr FROM (VALUES ('m1', 'R', 'A'), ('m2', 'N', 'A')) q(model, future, present)
    JOIN f ON f.scenario = future JOIN f p ON p.scenario = present AND p.month = f.month AND p.ty = f.ty AND p.tx = f.tx""")
def _(spark, sf):
    pairs = F.broadcast(spark.createDataFrame([("m1", "R", "A"), ("m2", "N", "A")], "model string, future string, present string"))
    t = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ty"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("tx"))
    t = t.withColumns({"sx": F.col("tx") + 0.75, "sy": F.col("ty") + 0.5})
    mean = _mean(spark, sf, "scenario").withColumn("pr", F.greatest("pr", F.lit(0.0)) * 86400)
    cells = align.on_target_cells(mean, t, ["scenario", "month"], ["tas", "pr"])
    out = align.pair_difference(cells, pairs, "scenario", ["month", "iy", "ix"], {"tas": F.col("tas"), "pr": F.col("pr")})
    # compared per second: amounts a day lie on halves of a last digit
    return v.rounded(v.rounded(out, ["tas"], 5).withColumn("pr", F.col("pr") / 86400), ["pr"], 9)


@query("J11_experiment_minus_baseline", """SELECT s.exp_id, s.gcm_id, s.month, round(s.value - b.value, 2) + 0.0 AS value FROM {series} s
    JOIN {series} b ON b.exp_id = 0 AND b.gcm_id = s.gcm_id AND b.month = s.month WHERE s.exp_id <> 0""")
def _(spark, sf):
    x = v.series(spark, sf)
    out = align.subtract_baseline(x.where("exp_id <> 0"), x.where("exp_id = 0").drop("exp_id"), ["gcm_id", "month"], ["value"])
    return v.rounded(out, ["value"], 2)


LAYERS = range(1, 8)


@query("J12_layer_merge", f"""SELECT l_suppkey AS iy, l_partkey % 60 AS ix, min(l_partkey % 60 + l_suppkey) AS v,
    {', '.join(f'CAST(nullif(count(*) FILTER (l_linenumber = {k}), 0) AS DOUBLE) AS n_{k}' for k in LAYERS)} FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    li = v.table(spark, sf, "lineitem").groupBy("l_linenumber", F.col("l_suppkey").alias("iy"), (F.col("l_partkey") % v.NX).alias("ix")).agg(
        F.min(F.col("l_partkey") % v.NX + F.col("l_suppkey")).alias("v"), F.count(F.lit(1)).cast("double").alias("n"))
    layers = [li.where(F.col("l_linenumber") == k).select("iy", "ix", "v", F.col("n").alias(f"n_{k}")) for k in LAYERS]
    return align.merge_many(layers, ["iy", "ix"], ["v"])


@query("J13_secondary_fill", """SELECT h.iy, h.ix, round(coalesce(h.v, f.v), 6) AS v FROM {holed} h LEFT JOIN
    (SELECT iy // 2 AS cy, ix // 2 AS cx, avg(v) AS v FROM {flat} GROUP BY ALL) f ON f.cy = h.iy // 2 AND f.cx = h.ix // 2""")
def _(spark, sf):
    half = {"cy": F.floor(F.col("iy") / 2), "cx": F.floor(F.col("ix") / 2)}
    coarse = v.flat(spark, sf).withColumns(half).groupBy("cy", "cx").agg(F.avg("v").alias("v"))
    out = align.fill_from(v.holed(spark, sf).withColumns(half), coarse, ["cy", "cx"], ["v"])
    return v.rounded(out.select("iy", "ix", "v"), ["v"], 6)


@query("J13_antimeridian_split", """WITH b AS (SELECT c_custkey AS id, (c_custkey * 37 % 360 - 180)::DOUBLE AS xmin, ((c_custkey * 37 + 20) % 360 - 180)::DOUBLE AS xmax FROM customer)
    SELECT id, xmin, xmax FROM b WHERE xmin <= xmax UNION ALL SELECT id, xmin, 180 FROM b WHERE xmin > xmax UNION ALL SELECT id, -180, xmax FROM b WHERE xmin > xmax""")
def _(spark, sf):
    k = F.col("c_custkey") * 37
    b = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (k % 360 - 180).cast("double").alias("xmin"),
                                              ((k + 20) % 360 - 180).cast("double").alias("xmax"))
    return align.split_antimeridian(b)


@query("J14_nearest_year", """WITH src AS (SELECT year, month, iy, ix, avg(tas) AS tas FROM {monthly} WHERE year NOT IN (1994, 1997) GROUP BY ALL),
    pick AS (SELECT CAST(ty AS INT) AS target_year, min_by(sy, (abs(sy - ty), sy)) AS sy FROM range(1992, 2004) t(ty), (SELECT DISTINCT year AS sy FROM src) GROUP BY ty)
    SELECT target_year, make_date(target_year, month, 1) AS lo, CAST(make_date(target_year, month, 1) + INTERVAL 1 MONTH AS DATE) AS hi, iy, ix, round(tas, 6) AS tas FROM pick JOIN src ON src.year = sy""")
def _(spark, sf):
    src = v.monthly(spark, sf).where("year not in (1994, 1997)").groupBy("year", "month", "iy", "ix").agg(F.avg("tas").alias("tas"))
    years = align.nearest_year_owner(src, "year", 1992, 2003)
    out = years.join(src, F.col("source_year") == F.col("year")).withColumn("time", F.make_date("target_year", "month", F.lit(1)))
    out = s.month_bounds(out, "time")
    return v.rounded(out.select("target_year", F.col("bounds.start").alias("lo"), F.col("bounds.end").alias("hi"), "iy", "ix", "tas"), ["tas"], 6)


@query("J17_nearest_cell", """WITH b AS (SELECT region, min(x0) xmin, max(x0) xmax, min(y0) ymin, max(y0) ymax FROM {edges} GROUP BY region),
    ax AS (SELECT DISTINCT ix AS i, ix * 1.0::DOUBLE + 0.25 AS c FROM {grid} WHERE ix % 5 = 0), ay AS (SELECT DISTINCT iy AS i, iy * 1.0::DOUBLE + 0.25 AS c FROM {grid} WHERE iy % 5 = 0)
    SELECT region, (SELECT min_by(i, (abs(c - xmin), i)) FROM ax) AS ix0, (SELECT min_by(i, (abs(c - xmax), i)) FROM ax) AS ix1,
      (SELECT min_by(i, (abs(c - ymin), i)) FROM ay) AS iy0, (SELECT min_by(i, (abs(c - ymax), i)) FROM ay) AS iy1 FROM b""")
def _(spark, sf):
    from fieldspark.operators import outlines

    g = v.grid(spark, sf)
    boxes = outlines.bounding_boxes(v.edges(spark, sf))
    ax = g.where("ix % 5 = 0").select(F.col("ix").alias("i")).distinct().withColumn("c", F.col("i") + 0.25)
    ay = g.where("iy % 5 = 0").select(F.col("iy").alias("i")).distinct().withColumn("c", F.col("i") + 0.25)
    out = boxes
    for name, axis, coord in (("ix0", ax, "xmin"), ("ix1", ax, "xmax"), ("iy0", ay, "ymin"), ("iy1", ay, "ymax")):
        out = align.nearest_on_axis(out, coord, axis, "c", "i", name, 16.0)
    return out.select("region", "ix0", "ix1", "iy0", "iy1")


# -------------------------------------------------------- climatologies


@query("A6_monthly_climatology", "SELECT month, iy, ix, round(avg(tas), 8) AS tas, round(avg(pr), 8) + 0.0 AS pr FROM {monthly} WHERE year BETWEEN 1996 AND 2000 GROUP BY ALL")
def _(spark, sf):
    out = climatology.monthly_climatology(v.monthly(spark, sf), ["tas", "pr"], range(1996, 2001), dtype="double")
    return v.rounded(out, ["tas", "pr"], 8)


@query("A7_period_climatology", """SELECT period, month, iy, ix, round(avg(tas), 8) AS tas, round(stddev_pop(tas), 8) + 0.0 AS tas_sd, round(avg(pr) / any_value(d), 10) + 0.0 AS pr_rate
    FROM {monthly} JOIN (VALUES ('early', 1995, 1997), ('mid', 1997, 1999), ('late', 1999, 2001)) p(period, a, b) ON year BETWEEN a AND b
    JOIN (SELECT unnest(range(1, 13)) AS month, unnest([31,28,31,30,31,30,31,31,30,31,30,31]) AS d) USING (month) GROUP BY ALL""")
def _(spark, sf):
    out = climatology.period_climatology(v.monthly(spark, sf), {"early": (1995, 1997), "mid": (1997, 1999), "late": (1999, 2001)},
                                         ["iy", "ix"], ["tas"], ["tas"], ["pr"])
    return v.rounded(v.rounded(out, ["tas", "tas_sd"], 8), ["pr_rate"], 10)


@query("A8_daily_to_monthly", """SELECT month, cell_y, cell_x, round(d.v, 6) AS value, round(d.sd, 6) + 0.0 AS value_sd, m.n FROM
    (SELECT CAST(date_trunc('month', day) AS DATE) AS month, cell_y, cell_x, avg(value) AS v, stddev_pop(value) AS sd FROM {daily} GROUP BY ALL) d JOIN
    (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, event_type AS cell_y, user_id AS cell_x, count(*) AS n FROM events GROUP BY ALL) m USING (month, cell_y, cell_x)""")
def _(spark, sf):
    m = v.table(spark, sf, "events").groupBy(F.trunc("ts", "month").alias("month"), F.col("event_type").alias("cell_y"), F.col("user_id").alias("cell_x")).agg(
        F.count(F.lit(1)).alias("n"))
    out = climatology.daily_to_monthly(v.daily(spark, sf), "day", ["cell_y", "cell_x"], ["value"], m)
    return v.rounded(out, ["value", "value_sd"], 6)


@query("A9_multi_year_monthly_mean", """WITH c AS (SELECT month, iy, ix, avg(tas) AS v FROM {monthly} GROUP BY ALL),
    r AS (SELECT month, iy // 2 AS ty, ix // 2 AS tx, sum(v) / count(v) AS tas FROM c GROUP BY ALL)
    SELECT r.month, ty, tx, round(tas, 6) AS tas, e - d AS start_day, e AS end_day FROM r JOIN
    (SELECT unnest(range(1, 13)) AS month, unnest([31.0::DOUBLE,28,31,30,31,30,31,31,30,31,30,31]) AS d, unnest([31.0::DOUBLE,59,90,120,151,181,212,243,273,304,334,365]) AS e) USING (month)""")
def _(spark, sf):
    c = climatology.monthly_climatology(v.monthly(spark, sf), ["tas"], range(1995, 2002), dtype="double")
    r = regrid.conservative(c, ["tas"], Grid(), Grid(dx=2.0, dy=2.0), ["month"])
    return v.rounded(s.periodic_month_axis(r).drop("mid_day"), ["tas"], 6)


@query("A12_time_mean", """SELECT exp_id, gcm_id, round(avg(value), 7) AS value, round(avg(epoch(month) / 86400), 6) AS mean_day, min(month) AS start, CAST(max(month) + INTERVAL 1 MONTH AS DATE) AS "end" FROM {series} GROUP BY ALL""")
def _(spark, sf):
    out = climatology.time_mean(v.series(spark, sf), "month", ["exp_id", "gcm_id"], ["value"])
    return v.rounded(v.rounded(out, ["value"], 7), ["mean_day"], 6)


@query("A24_integrated_totals", """SELECT scenario, round(sum(m) * 1200.0::DOUBLE * 1200 * 365.25 / 1e12, 8) + 0.0 AS total FROM (SELECT scenario, iy, ix, avg(tas) AS m FROM {monthly} GROUP BY ALL) GROUP BY scenario""")
def _(spark, sf):
    from fieldspark.functions import units

    factor = units.factor("kg/day", "Gt/yr")
    out = climatology.integrated_total(v.monthly(spark, sf), "tas", ["scenario"], ["iy", "ix"], 1200.0 * 1200.0, factor)
    return v.rounded(out, ["total"], 8)


@query("A32_season_anomalies", """WITH c AS (SELECT scenario, month, iy, ix, avg(tas) AS tas FROM {monthly} GROUP BY ALL),
    m AS (SELECT scenario, season, iy, ix, avg(tas) AS tas FROM c JOIN (SELECT 'annual' AS season, unnest(range(1, 13)) AS month UNION ALL SELECT 'DJF', unnest([1, 2, 12]) UNION ALL SELECT 'JJA', unnest([6, 7, 8])) USING (month) GROUP BY ALL)
    SELECT m.scenario, m.season, m.iy, m.ix, round(m.tas - r.tas, 6) + 0.0 AS tas FROM m JOIN m r ON r.scenario = 'A' AND r.season = m.season AND r.iy = m.iy AND r.ix = m.ix WHERE m.scenario <> 'A'""")
def _(spark, sf):
    m = _mean(spark, sf, "scenario").drop("pr")
    return v.rounded(climatology.season_means(m, ["iy", "ix"], "tas", "scenario", "A"), ["tas"], 6)
