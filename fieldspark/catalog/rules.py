"""Row rules: P1-P3, P8-P28, M8."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.catalog import views as v
from fieldspark.catalog.registry import query
from fieldspark.catalog.zonal import TOUCHED
from fieldspark.functions import rules as r
from fieldspark.operators import outlines
from fieldspark.model import rename_checked

KEYS = ["t", "iy", "ix"]
C = F.col


def _cells(spark, sf, **cols):
    return v.cells(spark, sf).select(*KEYS, *[c.alias(n) for n, c in cols.items()])


@query("P1_select_variables", "SELECT t, iy, ix, round(thk, 6) AS thk, mask FROM {cells}")
def _(spark, sf):
    return v.rounded(r.select_variables(v.cells(spark, sf), ["thk", "mask"], KEYS), ["thk"], 6)


@query("P2_split_by_dimensionality", """SELECT s.t, round(s.thk, 6) AS thk, e.n_orders FROM (SELECT t, avg(thk) AS thk FROM {cells} GROUP BY t) s
    JOIN (SELECT CAST(year(o_orderdate) AS INT) AS t, count(*) AS n_orders FROM orders GROUP BY 1) e USING (t)""")
def _(spark, sf):
    dims = {"thk": ("time", "y", "x"), "n_orders": ("time",), "time_bnds": ("time", "nv")}
    spatial, flat = r.split_by_dims(dims, "or", aux=["time_bnds"])
    extra = v.table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("t")).agg(F.count(F.lit(1)).alias("n_orders"))
    s = v.cells(spark, sf).groupBy("t").agg(*[F.round(F.avg(x), 6).alias(x) for x in spatial])
    return s.join(extra.select("t", *flat), "t")


@query("P3_rename_variables", "SELECT t, iy, ix, round(thk, 6) AS thickness FROM {cells}")
def _(spark, sf):
    return rename_checked(v.rounded(v.cells(spark, sf).select(*KEYS, "thk"), ["thk"], 6), {"thk": "thickness"})


@query("P8_area_threshold_zone_crs", """SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'EPSG:3413' ELSE 'EPSG:' || (CASE WHEN c_custkey % 180 >= 90 THEN 32600 ELSE 32700 END + c_custkey % 60 + 1) END AS crs
    FROM customer WHERE c_acctbal / 1000 > 1.0""")
def _(spark, sf):
    d = v.table(spark, sf, "customer").select("c_custkey", (C("c_acctbal") / 1000).alias("area_km2"), (C("c_custkey") % 60 + 1).alias("zone"),
                                              (C("c_custkey") % 180 - 90).alias("lat"), F.when(C("c_nationkey") == 3, "EPSG:3413").alias("override"))
    return r.large_outlines(d).select("c_custkey", r.utm_crs(C("zone"), C("lat"), C("override")).alias("crs"))


RGI = "'RGI2000-v7.0-' || CASE WHEN c_custkey % 5 = 0 THEN 'C' ELSE 'G' END || '-' || lpad(CAST(c_nationkey % 19 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey AS VARCHAR), 5, '0')"


def _rgi(spark, sf):
    return v.table(spark, sf, "customer").withColumn("rgi_id", F.format_string(
        "RGI2000-v7.0-%s-%02d-%05d", F.when(C("c_custkey") % 5 == 0, "C").otherwise("G"), C("c_nationkey") % 19 + 1, C("c_custkey")))


@query("P9_id_lookup", f"SELECT c_custkey, rgi_id FROM (SELECT *, {RGI} AS rgi_id FROM customer) WHERE rgi_id = (SELECT max({RGI}) FROM customer)")
def _(spark, sf):
    d = _rgi(spark, sf)
    return d.where(C("rgi_id") == d.agg(F.max("rgi_id")).scalar()).select("c_custkey", "rgi_id")


@query("P10_complex_membership", "SELECT c_custkey FROM customer WHERE c_nationkey = 7 OR c_custkey % 11 = 7 OR c_custkey % 13 = 7")
def _(spark, sf):
    d = v.table(spark, sf, "customer").select("c_custkey", C("c_nationkey").cast("string").alias("c"), F.when(
        C("c_custkey") % 3 != 5, F.concat_ws(";", (C("c_custkey") % 11).cast("string"), (C("c_custkey") % 13).cast("string"))).alias("agg"))
    return d.where(r.in_complex(C("c"), C("agg"), F.lit("7"))).select("c_custkey")


@query("P11_id_patterns", f"SELECT c_custkey, contains(rgi_id, '-C-') AS is_complex, contains(rgi_id, '-G-04-') AS in_region FROM (SELECT c_custkey, {RGI} AS rgi_id FROM customer)")
def _(spark, sf):
    return _rgi(spark, sf).select("c_custkey", r.is_outline_type(C("rgi_id"), "C").alias("is_complex"), r.in_id_region(C("rgi_id"), "04").alias("in_region"))


@query("P12_time_window", "SELECT exp_id, gcm_id, month FROM {series} WHERE month BETWEEN DATE '1996-02-01' AND DATE '1999-06-01' AND year(month) IN (1996, 1998, 1999)")
def _(spark, sf):
    w = r.time_window(v.series(spark, sf), "month", "1996-02-01", "1999-06-01")
    return w.where(F.year("month").isin(1996, 1998, 1999)).select("exp_id", "gcm_id", "month")


@query("P13_spatial_preclip", "SELECT t, iy, ix FROM {cells} WHERE x BETWEEN 10.2 AND 30.7 AND y BETWEEN 5.5 AND 44.4")
def _(spark, sf):
    return r.clip_box(v.cells(spark, sf), (10.2, 30.7), (44.4, 5.5)).select(*KEYS)


@query("P14_perimeter_band", """SELECT g.iy, g.ix, (ix + 0.5 < 3.0 OR ix + 0.5 > 57.0 OR iy + 0.5 < 3.0 OR iy + 0.5 > ny - 3.0) AS by_width, (iy < 2 OR iy >= ny - 2 OR ix < 2 OR ix >= 58) AS by_count
    FROM {grid} g, (SELECT max(s_suppkey) + 1 AS ny FROM supplier)""")
def _(spark, sf):
    ny = v.table(spark, sf, "supplier").agg(F.max("s_suppkey") + 1).scalar()
    box = {"xmin": F.lit(0.0), "xmax": F.lit(float(v.NX)), "ymin": F.lit(0.0), "ymax": ny.cast("double")}
    return v.grid(spark, sf).select("iy", "ix", r.perimeter_by_width(C("ix") + 0.5, C("iy") + 0.5, box, 3.0).alias("by_width"),
                                    r.perimeter_by_count(C("iy"), C("ix"), ny, F.lit(v.NX), 2.5, 1.0).alias("by_count"))


@query("P15_ocean_moat", """SELECT t, iy, ix, CASE WHEN m THEN 0 ELSE round(thk * 10, 6) END AS surface, CASE WHEN m THEN 0 ELSE round(thk, 6) END AS thickness, CASE WHEN m THEN -2000 ELSE round(thk * 9, 6) END AS bed
    FROM (SELECT *, (iy < 4 OR iy >= ny - 4 OR ix < 4 OR ix >= 56) AS m FROM {cells}, (SELECT max(s_suppkey) + 1 AS ny FROM supplier))""")
def _(spark, sf):
    ny = v.table(spark, sf, "supplier").agg(F.max("s_suppkey") + 1).scalar()
    d = _cells(spark, sf, surface=C("thk") * 10, thickness=C("thk"), bed=C("thk") * 9)
    d = r.ocean_moat(d, r.perimeter_by_count(C("iy"), C("ix"), ny, F.lit(v.NX), 4000, 1000))
    return v.rounded(d, ["surface", "thickness", "bed"], 6)


@query("P16_region_masks", """SELECT g.iy, g.ix, CASE WHEN m.iy IS NULL THEN 0 ELSE 1 END AS land_ice_area_fraction_retreat, CASE WHEN m.iy IS NULL THEN 1 ELSE 0 END AS ftt_mask
    FROM {grid} g LEFT JOIN (SELECT DISTINCT iy, ix FROM {region_cells}) m USING (iy, ix)""")
def _(spark, sf):
    return r.region_masks(v.grid(spark, sf), v.region_cells(spark, sf))


@query("P17_piecewise_ramp", "SELECT t, iy, ix, round(CASE WHEN s IS NULL THEN 0 WHEN s < 100 THEN 0 WHEN s > 250 THEN 2 ELSE 1 + (s - 100) / 150 END, 6) AS tillwat FROM (SELECT *, CASE WHEN mask < 4 THEN thk * 7 END AS s FROM {cells})")
def _(spark, sf):
    return _cells(spark, sf, tillwat=F.round(r.till_water(F.when(C("mask") < 4, C("thk") * 7)), 6))


@query("P18_albedo", "SELECT t, iy, ix, CASE WHEN d > 0 THEN round(1 - thk / d, 8) END AS albedo FROM (SELECT *, (thk - 20) * 3 AS d FROM {cells})")
def _(spark, sf):
    return _cells(spark, sf, albedo=F.round(r.albedo(C("thk"), (C("thk") - 20) * 3), 8))


@query("P19_unit_conversions", """SELECT t, iy, ix, round(thk * 1000, 4) AS we, round(thk / 9.80665, 8) AS height, round(thk + 273.15, 6) AS kelvin, round(thk - 273.15, 6) AS celsius,
    round(thk * 1000 + mask, 4) AS precipitation, round(thk * 86400, 2) AS daily, round(greatest(glf / 1000, 0), 8) AS watts FROM {cells}""")
def _(spark, sf):
    d = _cells(spark, sf, we=r.water_equivalent(C("thk")), height=r.geopotential_height(C("thk")), kelvin=r.to_kelvin(C("thk")), celsius=r.to_celsius(C("thk")),
               precipitation=r.snow_and_rain(C("thk"), C("mask")), daily=r.per_day(C("thk")), watts=r.heat_flux_watts(C("glf")))
    for cols, n in ((["we", "precipitation"], 4), (["height", "watts"], 8), (["kelvin", "celsius"], 6), (["daily"], 2)):
        d = v.rounded(d, cols, n)
    return d


@query("P20_fill_values", "SELECT iy, ix, round(coalesce(v, 260), 6) AS air_temp, round(coalesce(v, 0), 6) AS precipitation, round(coalesce(v, 0), 6) AS humidity FROM {holed}")
def _(spark, sf):
    d = v.holed(spark, sf).select("iy", "ix", *[C("v").alias(n) for n in ("air_temp", "precipitation", "humidity")])
    return v.rounded(r.fill_missing(d, ["air_temp", "precipitation", "humidity"]), ["air_temp", "precipitation", "humidity"], 6)


@query("P21_range_rules", """SELECT iy, ix, round(CASE WHEN w IS NULL OR w BETWEEN -1 AND 1 THEN 260 ELSE w END, 6) AS temperature, round(CASE WHEN w NOT BETWEEN -1 AND 1 THEN w END, 6) + 0.0 AS salinity,
    round(CASE WHEN h IS NULL OR h BETWEEN -1e40 AND -1e10 THEN 0 ELSE h END, 6) AS other FROM (SELECT iy, ix, v - 25 AS w, CASE WHEN v > 30 THEN -1e20 ELSE v END AS h FROM {holed})""")
def _(spark, sf):
    w, h = C("v") - 25, F.when(C("v") > 30, -1e20).otherwise(C("v"))
    d = v.holed(spark, sf).select("iy", "ix", r.ocean_rules("temperature", w).alias("temperature"), r.ocean_rules("salinity", w).alias("salinity"), r.ocean_rules("other", h).alias("other"))
    return v.rounded(d, ["temperature", "salinity", "other"], 6)


@query("P22_nonfinite_cleanup", "SELECT t, iy, ix, CASE WHEN mask <= 2 THEN 0 ELSE round(thk, 6) END AS v FROM {cells}")
def _(spark, sf):
    raw = F.when(C("mask") == 1, F.lit(float("nan"))).when(C("mask") == 2, F.lit(float("-inf"))).otherwise(C("thk"))
    return _cells(spark, sf, v=F.round(r.finite_or_zero(raw), 6))


@query("P23_clip_negatives", "SELECT t, iy, ix, round(greatest(glf, 0), 4) AS pr FROM {cells}")
def _(spark, sf):
    return _cells(spark, sf, pr=F.round(r.floor_zero(C("glf")), 4))


@query("P24_thickness_and_bed", """SELECT t, iy, ix, round(CASE WHEN o IS NOT NULL AND greatest(s - o, 0) <= 0 THEN 0 ELSE s END, 6) + 0.0 AS surface,
    round(CASE WHEN o IS NOT NULL THEN o WHEN s <= 0 THEN coalesce(b, s - greatest(h, 0)) ELSE s - greatest(h, 0) END, 6) + 0.0 AS bed, round(CASE WHEN o IS NOT NULL THEN greatest(s - o, 0) ELSE greatest(h, 0) END, 6) + 0.0 AS thickness
    FROM (SELECT t, iy, ix, thk - 25 AS s, thk - 30 AS h, CASE WHEN mask > 1 THEN -thk END AS b, CASE WHEN ix < 10 THEN thk / 2 - 10 END AS o FROM {cells})""")
def _(spark, sf):
    d = _cells(spark, sf, surface=C("thk") - 25, thickness=C("thk") - 30, bathymetry=F.when(C("mask") > 1, -C("thk")), bed_override=F.when(C("ix") < 10, C("thk") / 2 - 10))
    return v.rounded(r.thickness_and_bed(d).select(*KEYS, "surface", "bed", "thickness"), ["surface", "bed", "thickness"], 6)


@query("P25_flotation_grounding", """WITH a AS (SELECT t, iy, ix, greatest((thk - 15) * 20, 0) AS s, (20 - thk) * 25 AS bed, mask - 1 AS cls, ix % 9 <> 0 AS b, thk / 50 AS f FROM {cells}),
    h AS (SELECT *, CASE WHEN s > 0 AND cls IN (0, 3) AND b THEN least(s / (1 - 910 / 1028.0::DOUBLE), greatest(-bed * 1028 / 910, 0)) WHEN s > 0 AND cls = 2 THEN s - bed ELSE 0 END AS h0 FROM a),
    k AS (SELECT *, CASE WHEN h0 > 10 AND b THEN h0 ELSE 0 END AS h FROM h),
    g AS (SELECT *, bed + h >= (1 - 910 / 1028.0::DOUBLE) * h AND h > 0.01 AND f > 0.5 AS grounded FROM k)
    SELECT t, iy, ix, round(h, 6) AS thickness, CAST(grounded AS INT) AS vel_misfit_weight, CAST(NOT grounded AS INT) AS zeta_fixed_mask, 1.4e5::DOUBLE AS tauc_prior FROM g""")
def _(spark, sf):
    d = _cells(spark, sf, bed=(20 - C("thk")) * 25, f=C("thk") / 50, thickness=r.flotation_thickness((C("thk") - 15) * 20, (20 - C("thk")) * 25, C("mask") - 1, C("ix") % 9 != 0))
    d = r.inversion_masks(d, r.is_grounded(C("bed"), C("thickness"), C("f")))
    return v.rounded(d.drop("bed", "f"), ["thickness"], 6)


@query("P25_deep_ocean_polygon", f"""WITH d AS (SELECT DISTINCT iy, ix FROM {TOUCHED} WHERE CAST(substr(region, 2) AS BIGINT) % 3 = 0)
    SELECT t, iy, ix, CASE WHEN d.iy IS NULL THEN round(thk * 10, 6) ELSE 0 END AS surface, CASE WHEN d.iy IS NULL THEN round(thk, 6) ELSE 0 END AS thickness, CASE WHEN d.iy IS NULL THEN round(thk * 9, 6) ELSE -2000 END AS bed
    FROM {{cells}} LEFT JOIN d USING (iy, ix)""")
def _(spark, sf):
    polygons = v.edges(spark, sf).where(F.substring("region", 2, 20).cast("bigint") % 3 == 0)
    d = r.deep_ocean(_cells(spark, sf, surface=C("thk") * 10, thickness=C("thk"), bed=C("thk") * 9), outlines.touched_cells(polygons))
    return v.rounded(d.select("t", "iy", "ix", "surface", "thickness", "bed"), ["surface", "thickness", "bed"], 6)


@query("P26_observation_masks", """SELECT t, iy, ix, round(sqrt(vx * vx + vy * vy), 6) AS v, round(coalesce(vx, 0), 6) + 0.0 AS u_observed, round(coalesce(vy, 0), 6) + 0.0 AS v_observed, CAST(ok AS INT) AS vel_misfit_weight, CAST(NOT ok AS INT) AS zeta_fixed_mask
    FROM (SELECT t, iy, ix, mask <> 3 AS ok, CASE WHEN mask % 2 = 1 THEN CASE WHEN mask <> 5 THEN thk - 25 END ELSE 0 END AS vx, CASE WHEN mask % 2 = 1 THEN thk * 2 ELSE 0 END AS vy FROM {cells})""")
def _(spark, sf):
    d = _cells(spark, sf, vx=F.when(C("mask") != 5, C("thk") - 25), vy=C("thk") * 2, v=F.when(C("mask") != 3, C("thk")), landice=C("mask") % 2)
    d = r.observed_velocity(d).select(*KEYS, "v", "u_observed", "v_observed", "vel_misfit_weight", "zeta_fixed_mask")
    return v.rounded(d, ["v", "u_observed", "v_observed"], 6)


@query("P27_latitude_ramp", "SELECT t, iy, ix, round(CASE WHEN mask NOT IN (1, 4) THEN 0 ELSE least(greatest((60 + thk / 2 - 69) * (10 - 228) / 11.0::DOUBLE + 228, 10), 228) * 910 END, 4) AS melt FROM {cells}")
def _(spark, sf):
    return _cells(spark, sf, melt=F.round(r.latitude_ramp(60 + C("thk") / 2, land=~(C("mask") - 1).isin(0, 3)), 4))


@query("P28_scalar_offsets", """SELECT user_id, e.* FROM (SELECT user_id, avg(value) AS d FROM events GROUP BY 1), LATERAL (SELECT 86400.0 * 5 AS time, 0.0 AS start, 86400.0 * 10 AS "end", 0.0 AS "delta_T", 1.0 AS "frac_P"
      UNION ALL SELECT 86400.0 * 187.5, 86400.0 * 10, 86400.0 * 365, round(d, 6), 1.1) e""".replace("86400.0", "86400.0::DOUBLE").replace("0.0 AS", "0.0::DOUBLE AS").replace("1.0 AS", "1.0::DOUBLE AS"))
def _(spark, sf):
    m = v.table(spark, sf, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("d")).withColumn("p", F.lit(1.1))
    return r.offset_series(m, "d", "p", step_day=10.0)


@query("M8_relative_fields", "SELECT t, iy, ix, CASE WHEN thk <> 20 THEN round((glf - (thk - 20)) / (thk - 20), 9) END AS rel FROM {cells}")
def _(spark, sf):
    good = C("thk") - 20
    return _cells(spark, sf, rel=F.round(F.try_divide(C("glf") - good, good), 9))
