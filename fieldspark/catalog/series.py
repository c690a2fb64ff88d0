"""Time series and paths: W1-W14, J15, J16, A10, A11, A23, A31, M6 inputs, M7."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.catalog import views as v
from fieldspark.catalog.registry import query
from fieldspark.operators import align
from fieldspark.operators import scan
from fieldspark.operators import series as s



def _block():
    return scan.time_block("ts", 3)


ORDER = ["ts", "event_id"]
MICROS = "(epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 86400000000.0::DOUBLE"


def _integral(spark, sf, **kw):
    df = s.integrate_rate(v.rate(spark, sf), "rate", ["member"], ORDER, _block(), **kw)
    return v.rounded(df.select("member", "event_id", "cumulative_rate"), ["cumulative_rate"], 5)


@query("W1_cumulative_left", f"""SELECT member, event_id, round(coalesce(sum(inc) OVER (PARTITION BY member ORDER BY ts, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 5) + 0.0 AS cumulative_rate FROM
    (SELECT *, rate * {MICROS} AS inc FROM {{rate}} WINDOW w AS (PARTITION BY member ORDER BY ts, event_id))""")
def _(spark, sf):
    return _integral(spark, sf)


@query("W1_cumulative_left_propagating", f"""SELECT member, event_id, CASE WHEN max(bad) OVER p = 1 THEN NULL
      ELSE round(coalesce(sum(inc) OVER p, 0), 5) + 0.0 END AS cumulative_rate FROM
    (SELECT *, CASE WHEN inc IS NULL THEN 1 ELSE 0 END AS bad FROM (SELECT * EXCLUDE (rate), CASE WHEN event_id % 101 <> 7 THEN rate END * {MICROS} AS inc
       FROM {{rate}} WINDOW w AS (PARTITION BY member ORDER BY ts, event_id)))
    WINDOW p AS (PARTITION BY member ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    gaps = v.rate(spark, sf).withColumn("rate", F.when(F.col("event_id") % 101 != 7, F.col("rate")))
    df = s.integrate_rate(gaps, "rate", ["member"], ORDER, _block(), skipna=False)
    return v.rounded(df.select("member", "event_id", "cumulative_rate"), ["cumulative_rate"], 5)


@query("W2_cumulative_trapezoid", """SELECT member, event_id, round(coalesce(sum(inc) OVER (PARTITION BY member ORDER BY ts, event_id), 0), 5) + 0.0 AS cumulative_rate FROM
    (SELECT *, (rate + lag(rate) OVER w) / 2 * (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 86400000000.0::DOUBLE AS inc
     FROM {rate} WINDOW w AS (PARTITION BY member ORDER BY ts, event_id))""")
def _(spark, sf):
    return _integral(spark, sf, method="trapezoid")


@query("W3_cumulative_month_widths", """SELECT exp_id, gcm_id, month, round(sum(value / 365.25::DOUBLE * day(last_day(month))) OVER (PARTITION BY exp_id, gcm_id ORDER BY month), 3) AS cumulative_value FROM {series}""")
def _(spark, sf):
    df = s.integrate_rate(v.series(spark, sf), "value", ["exp_id", "gcm_id"], ["month"], scan.time_block("month", 366),
                          width=s.month_days(F.col("month")), per_days=s.DAYS_PER_YEAR)
    return v.rounded(df.drop("value"), ["cumulative_value"], 3)


@query("W4_periodic_month_axis", """WITH m AS (SELECT exp_id, month(month) AS mm, avg(value) AS value FROM {series} GROUP BY ALL)
    SELECT exp_id, CAST(mm AS INT) AS month, round(value, 7) AS value, sum(d) OVER w - d AS start_day, sum(d) OVER w AS end_day, sum(d) OVER w - d / 2 AS mid_day
    FROM m JOIN (SELECT unnest(range(1, 13)) AS mm, unnest([31.0::DOUBLE,28,31,30,31,30,31,31,30,31,30,31]) AS d) USING (mm)
    WINDOW w AS (PARTITION BY exp_id ORDER BY mm)""")
def _(spark, sf):
    m = v.series(spark, sf).groupBy("exp_id", F.month("month").alias("month")).agg(F.round(F.avg("value"), 7).alias("value"))
    return s.periodic_month_axis(m, keys=["exp_id"])


@query("W5_time_bounds", """SELECT member, event_id, ts AS lo, hi FROM
    (SELECT *, lead(ts) OVER (PARTITION BY member ORDER BY ts, event_id) AS hi FROM {rate}) WHERE hi IS NOT NULL""")
def _(spark, sf):
    df = s.time_bounds(v.rate(spark, sf), ["member"], ORDER, _block())
    return df.select("member", "event_id", F.col("bounds.start").alias("lo"), F.col("bounds.end").alias("hi"))


@query("W5_month_bounds", """SELECT exp_id, gcm_id, month AS lo, CAST(month + INTERVAL 1 MONTH AS DATE) AS hi FROM {series}""")
def _(spark, sf):
    df = s.month_bounds(v.series(spark, sf), "month")
    return df.select("exp_id", "gcm_id", F.col("bounds.start").alias("lo"), F.col("bounds.end").alias("hi"))


@query("W6_restamp_years", """SELECT exp_id, CAST(dense_rank() OVER (ORDER BY y) AS INT) AS year, round(value, 2) AS value FROM
    (SELECT exp_id, year(month) AS y, sum(value) AS value FROM {series} WHERE year(month) > 1996 GROUP BY ALL)""")
def _(spark, sf):
    a = v.series(spark, sf).groupBy("exp_id", F.year("month").alias("year")).agg(F.round(F.sum("value"), 2).alias("value"))
    return s.restamp_years(a.where("year > 1996"), "year")


@query("W7_change_since_first", """SELECT exp_id, gcm_id, month, round((value - first_value(value) OVER (PARTITION BY exp_id, gcm_id ORDER BY month)) * (-1 / 361.8::DOUBLE), 6) + 0.0 AS value FROM {series}""")
def _(spark, sf):
    df = s.change_since_first(v.series(spark, sf), "value", "month", ["exp_id", "gcm_id"], -1 / s.GT_PER_MM_SEA_LEVEL)
    return v.rounded(df, ["value"], 6)


@query("J15_nearest_time_reference", """SELECT s.exp_id, s.gcm_id, s.month, round(s.value - r.v, 2) + 0.0 AS value FROM {series} s JOIN
    (SELECT exp_id, gcm_id, min_by(value, (abs(date_diff('day', month, DATE '1998-03-10')), month)) AS v FROM {series} GROUP BY ALL) r USING (exp_id, gcm_id)""")
def _(spark, sf):
    df = s.subtract_reference(v.series(spark, sf), ["value"], "month", F.lit("1998-03-10").cast("date"), ["exp_id", "gcm_id"])
    return v.rounded(df, ["value"], 2)


@query("J16_interpolated_asof", """WITH o AS (SELECT event_id, user_id AS member, ts FROM events WHERE event_type = 'error'),
    q AS (SELECT event_id, user_id AS member, ts, value FROM events WHERE event_type = 'click'),
    b AS (SELECT o.member, o.event_id, o.ts, max(q.ts) FILTER (q.ts <= o.ts) AS t0, min(q.ts) FILTER (q.ts >= o.ts) AS t1,
      arg_max(q.value, q.ts) FILTER (q.ts <= o.ts) AS v0, arg_min(q.value, q.ts) FILTER (q.ts >= o.ts) AS v1
      FROM o LEFT JOIN q ON o.member = q.member GROUP BY ALL)
    SELECT member, event_id, round(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0))::DOUBLE END, 5) + 0.0 AS sim FROM b""")
def _(spark, sf):
    e = v.table(spark, sf, "events").withColumnRenamed("user_id", "member")
    obs = e.where("event_type = 'error'").select("member", "ts", "event_id")
    sim = e.where("event_type = 'click'").select("member", "ts", F.col("value").alias("sim"))
    out = align.interpolate_onto(sim, obs, ["member"], "ts", ["sim"], scan.time_block("ts", 3))
    return v.rounded(out.select("member", "event_id", "sim"), ["sim"], 5)


ANNUAL = """SELECT exp_id, gcm_id, CAST(dense_rank() OVER (ORDER BY y) AS INT) AS year, value FROM
    (SELECT exp_id, gcm_id, year(month) AS y, avg(value) AS value FROM {series} WHERE year(month) > 1996 AND year(month) <= 2000 GROUP BY ALL)"""


@query("A10_annual_resampling", f"SELECT exp_id, gcm_id, year, round(value, 7) AS value FROM ({ANNUAL})")
def _(spark, sf):
    df = v.series(spark, sf).withColumn("year", F.year("month"))
    return v.rounded(s.trim_and_resample(df, ["value"], ["exp_id", "gcm_id"], 1996, 2000), ["value"], 7)


@query("A11_adjusted_series", f"""SELECT a.exp_id, a.gcm_id, a.year, round(a.value - r.value, 7) + 0.0 AS value FROM ({ANNUAL}) a
    LEFT JOIN ({ANNUAL}) r ON r.exp_id = a.exp_id AND r.gcm_id = a.gcm_id AND r.year = 1""")
def _(spark, sf):
    df = v.series(spark, sf).withColumn("year", F.year("month"))
    return v.rounded(s.adjusted_series(df, ["value"], ["value"], ["exp_id", "gcm_id"], 1996, 2000), ["value"], 7)


@query("A31_window_means", """SELECT exp_id, CAST(e AS INT) AS window_end, round(avg(value), 7) AS value FROM {series}, (VALUES (1997), (1999), (2001)) w(e)
    WHERE year(month) BETWEEN e - 2 AND e GROUP BY ALL""")
def _(spark, sf):
    df = v.series(spark, sf).withColumn("year", F.year("month"))
    return v.rounded(s.window_means(df, "year", "value", ["exp_id"], [1997, 1999, 2001], span=2), ["value"], 7)


PATH = """(SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
    CAST(embedding[3] AS DOUBLE) AS vx, CAST(embedding[4] AS DOUBLE) AS vy FROM embeddings)"""


def _pblock():
    return scan.number_block("vec_id", 50)


def _path(spark, sf):
    e = v.table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("x", "y", "vx", "vy"))])


NORMALS = f"""(SELECT *, CASE WHEN l > 0 THEN ty0 / l ELSE 0 END AS nx, CASE WHEN l > 0 THEN -tx0 / l ELSE 0 END AS ny,
    CASE WHEN l > 0 THEN tx0 / l ELSE 0 END AS tx, CASE WHEN l > 0 THEN ty0 / l ELSE 0 END AS ty FROM (SELECT *, sqrt(tx0 * tx0 + ty0 * ty0) AS l FROM
    (SELECT *, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS tx0, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS ty0
     FROM {PATH} WINDOW w AS (PARTITION BY label ORDER BY vec_id))))"""


@query("W8_path_normals", f"""SELECT vec_id, label, round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny, round(tx, 6) + 0.0 AS tx, round(ty, 6) + 0.0 AS ty FROM {NORMALS}""")
def _(spark, sf):
    df = s.path_vectors(_path(spark, sf), ["label"], ["vec_id"], _pblock())
    return v.rounded(df.select("vec_id", "label", "nx", "ny", "tx", "ty"), ["nx", "ny", "tx", "ty"], 6)


AXIS = f"(SELECT *, sum(sqrt(x * x + y * y)) OVER w - first_value(sqrt(x * x + y * y)) OVER w AS axis FROM {PATH} WINDOW w AS (PARTITION BY label ORDER BY vec_id))"


@query("W9_path_integral", f"""SELECT label, round(sum((vx + pv) / 2 * (axis - pa)), 6) + 0.0 AS vx_flux FROM
    (SELECT *, lag(vx) OVER w AS pv, lag(axis) OVER w AS pa FROM {AXIS} WINDOW w AS (PARTITION BY label ORDER BY vec_id)) GROUP BY label""")
def _(spark, sf):
    df = s.path_coordinate(_path(spark, sf), ["label"], ["vec_id"], _pblock())
    return v.rounded(s.path_integral(df, ["label"], ["vec_id"], _pblock(), "axis", ["vx"]), ["vx_flux"], 6)


@query("W10_profile_coordinate", f"SELECT vec_id, label, round(axis, 6) + 0.0 AS axis FROM {AXIS}")
def _(spark, sf):
    df = s.path_coordinate(_path(spark, sf), ["label"], ["vec_id"], _pblock())
    return v.rounded(df.select("vec_id", "label", "axis"), ["axis"], 6)


@query("W10_chord_length", f"""SELECT vec_id, label, round(coalesce(sum(d) OVER (PARTITION BY label ORDER BY vec_id), 0), 6) + 0.0 AS axis FROM
    (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM {PATH} WINDOW w AS (PARTITION BY label ORDER BY vec_id))""")
def _(spark, sf):
    df = s.path_coordinate(_path(spark, sf), ["label"], ["vec_id"], _pblock(), chord=True)
    return v.rounded(df.select("vec_id", "label", "axis"), ["axis"], 6)


@query("A23_profile_statistics", f"""SELECT label, round(sqrt(avg((vy - vx) ** 2)), 6) AS rmsd, round(corr(vx, vy), 6) AS pearson_r,
    round(sum((vx + pvx) / 2 * (axis - pa)), 6) + 0.0 AS vx_flux, round(sum((vy + pvy) / 2 * (axis - pa)), 6) + 0.0 AS vy_flux FROM
    (SELECT *, lag(vx) OVER w AS pvx, lag(vy) OVER w AS pvy, lag(axis) OVER w AS pa FROM {AXIS} WINDOW w AS (PARTITION BY label ORDER BY vec_id)) GROUP BY label""")
def _(spark, sf):
    df = s.path_coordinate(_path(spark, sf), ["label"], ["vec_id"], _pblock())
    out = s.profile_statistics(df, ["label"], ["vec_id"], _pblock(), "axis", "vx", "vy")
    return v.rounded(out, ["rmsd", "pearson_r", "vx_flux", "vy_flux"], 6)


@query("M7_normal_component", f"SELECT vec_id, label, round(vx * nx + vy * ny, 6) + 0.0 AS v_normal FROM {NORMALS}")
def _(spark, sf):
    df = s.path_vectors(_path(spark, sf), ["label"], ["vec_id"], _pblock())
    return v.rounded(df.select("vec_id", "label", s.normal_component("vx", "vy").alias("v_normal")), ["v_normal"], 6)


@query("W11_lcurve_corner", """WITH p AS (SELECT p_brand AS brand, p_size AS penalty, log10(avg(p_retailprice) + p_size) AS x, log10(1e6 / (p_size + 1.0::DOUBLE) + avg(p_retailprice)) AS y FROM part GROUP BY p_brand, p_size),
    t AS (SELECT *, lag(x) OVER w x0, lag(y) OVER w y0, lead(x) OVER w x2, lead(y) OVER w y2 FROM p WINDOW w AS (PARTITION BY brand ORDER BY penalty)),
    k AS (SELECT *, 2 * abs((x - x0) * (y2 - y0) - (y - y0) * (x2 - x0)) / (sqrt((x-x0)**2 + (y-y0)**2) * sqrt((x2-x)**2 + (y2-y)**2) * sqrt((x2-x0)**2 + (y2-y0)**2)) AS c FROM t WHERE x0 IS NOT NULL AND x2 IS NOT NULL)
    SELECT brand, arg_max(penalty, (c, -penalty)) AS penalty, round(max(c), 4) AS curvature FROM k GROUP BY brand""")
def _(spark, sf):
    p = v.table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_size").alias("penalty")).agg(
        (F.avg("p_retailprice") + F.col("p_size")).alias("norm"), (1e6 / (F.col("p_size") + 1.0) + F.avg("p_retailprice")).alias("misfit"))
    out = s.curvature_corner(p, ["brand"], "penalty", "misfit", "norm", scan.number_block("penalty", 16))
    return v.rounded(out, ["curvature"])


@query("W12_keep_first", """SELECT user_id, min_by(event_id, (ts, event_id)) AS event_id, min_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id""")
def _(spark, sf):
    e = v.table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return s.first_per_key(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("W13_label_index", """SELECT CAST(i AS INT) AS gcm_id, gcm_id AS gcm_id_name, exp_id, month FROM {series} JOIN
    (SELECT gcm_id, row_number() OVER (ORDER BY o, gcm_id) - 1 AS i FROM (SELECT o_orderpriority AS gcm_id, min(o_orderkey) AS o FROM orders GROUP BY 1)) USING (gcm_id)""")
def _(spark, sf):
    o = v.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("gcm_id"), "o_orderkey",
                                            F.floor(F.col("o_custkey") / 100).alias("exp_id"), F.trunc("o_orderdate", "month").alias("month"))
    return s.label_index(o, "gcm_id", "o_orderkey").select("gcm_id", "gcm_id_name", "exp_id", "month").distinct()
