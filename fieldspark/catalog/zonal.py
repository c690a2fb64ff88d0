"""Regions, masks and zonal reductions: J1-J6, A1-A5, A19, A20, P4-P7, S7, S12, U4."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.catalog import views as v
from fieldspark.catalog.registry import query
from fieldspark.operators import outlines as o
from fieldspark.operators import zonal as z
from fieldspark.sources import sinks


def _glacierised():
    return F.when(F.col("thk") > 10.0, F.col("ice_mass"))


def _negative_flux():
    return F.when(F.col("glf") < 0, F.col("glf"))


ZONAL = """SELECT m.region, c.t, coalesce(sum(c.ice_mass), 0) AS ice_mass,
    coalesce(sum(CASE WHEN c.thk > 10 THEN c.ice_mass END), 0) AS ice_mass_glacierized,
    coalesce(sum(CASE WHEN c.glf < 0 THEN c.glf END), 0) AS glf_nonneg,
    CAST(coalesce(round(sum(c.mask)), 0) AS BIGINT) AS mask
    FROM {region_cells} m JOIN {cells} c ON m.iy = c.iy AND m.ix = c.ix GROUP BY ALL"""


def _zonal(spark, sf, regions=None):
    return z.zonal_sum(
        v.cells(spark, sf), v.region_cells(spark, sf),
        {"ice_mass": F.col("ice_mass"), "ice_mass_glacierized": _glacierised(), "glf_nonneg": _negative_flux()},
        {"mask": F.col("mask")}, regions=regions)


VALUES = ["ice_mass", "ice_mass_glacierized", "glf_nonneg"]


@query("J1_centre_cells", "SELECT * FROM {region_cells}")
def _(spark, sf):
    return v.region_cells(spark, sf)


@query("A1_zonal_sum", f"""WITH z AS ({ZONAL})
    SELECT region, t, round(coalesce(ice_mass, 0), 2) + 0.0 AS ice_mass,
    round(coalesce(ice_mass_glacierized, 0), 2) + 0.0 AS ice_mass_glacierized,
    round(coalesce(glf_nonneg, 0), 4) + 0.0 AS glf_nonneg, coalesce(mask, 0) AS mask FROM
    (SELECT 'R' || s_suppkey AS region, t FROM supplier, (SELECT DISTINCT t FROM {{cells}})) LEFT JOIN z USING (region, t)""")
def _(spark, sf):
    names = v.rings(spark, sf).select("region")
    out = v.rounded(_zonal(spark, sf, regions=names), VALUES[:2], 2)
    return v.rounded(out, VALUES[2:], 4)


@query("A3_grand_total", f"""WITH z AS ({ZONAL}) SELECT region, t, round(ice_mass, 2) + 0.0 AS ice_mass, round(ice_mass_glacierized, 2) + 0.0 AS ice_mass_glacierized FROM
    (SELECT region, t, ice_mass, ice_mass_glacierized FROM z
     UNION ALL SELECT 'total', t, sum(ice_mass), sum(ice_mass_glacierized) FROM z GROUP BY t)""")
def _(spark, sf):
    table = _zonal(spark, sf).select("region", "t", *VALUES[:2])
    return v.rounded(z.with_grand_total(table, VALUES[:2]), VALUES[:2], 2)


@query("A4_union_total", """SELECT c.t, round(sum(c.ice_mass), 2) AS ice_mass, count(*) AS n FROM {cells} c
    JOIN (SELECT DISTINCT iy, ix FROM {region_cells}) m USING (iy, ix) GROUP BY c.t""")
def _(spark, sf):
    mask = z.union_mask(v.region_cells(spark, sf), "all")
    out = z.zonal_sum(v.cells(spark, sf), mask, {"ice_mass": F.col("ice_mass")}, {"n": F.lit(1)})
    return v.rounded(out.drop("region"), ["ice_mass"], 2)


@query("A2_zonal_sum_two_outline_types", """SELECT kind, m.RGIid, c.t, round(sum(c.ice_mass), 2) AS ice_mass FROM
    (SELECT 'G' AS kind, region AS RGIid, iy, ix FROM {region_cells}
     UNION ALL SELECT DISTINCT 'C', 'C' || (CAST(substr(region, 2) AS BIGINT) % 7), iy, ix FROM {region_cells}) m
    JOIN {cells} c USING (iy, ix) GROUP BY ALL""")
def _(spark, sf):
    g = v.region_cells(spark, sf)
    complexes = g.withColumn("region", F.concat(F.lit("C"), (F.substring("region", 2, 20).cast("bigint") % 7).cast("string"))).distinct()
    both = g.select(F.concat(F.lit("G:"), "region").alias("region"), "iy", "ix").unionByName(
        complexes.select(F.concat(F.lit("C:"), "region").alias("region"), "iy", "ix"))
    out = z.zonal_sum(v.cells(spark, sf), both, {"ice_mass": F.col("ice_mass")})
    return v.rounded(out, ["ice_mass"], 2).select(
        F.split("region", ":")[0].alias("kind"), F.split("region", ":")[1].alias("RGIid"), "t", "ice_mass")


@query("A5_polygon_area", """SELECT region, round(sum(CASE WHEN is_hole THEN -a ELSE a END), 6) AS area,
    round(sum(CASE WHEN is_hole THEN -a ELSE a END) / 1e6, 12) AS area_km2 FROM
    (SELECT region, ring, is_hole, abs(sum(x0 * y1 - x1 * y0)) / 2 AS a FROM {edges} GROUP BY ALL) GROUP BY region""")
def _(spark, sf):
    out = o.polygon_area(v.edges(spark, sf))
    return out.select("region", F.round("area", 6).alias("area"), F.round(F.col("area") / 1e6, 12).alias("area_km2"))


TOUCHED = """(SELECT DISTINCT e.region, g.iy, g.ix FROM {edges} e JOIN
    (SELECT 'R' || s.s_suppkey AS region, gy.s_suppkey AS iy, s.s_suppkey * 7 % 50 + dx AS ix
     FROM supplier s JOIN supplier gy ON gy.s_suppkey BETWEEN s.s_suppkey AND s.s_suppkey + 5, range(8) d(dx)) g
    ON e.region = g.region AND g.iy BETWEEN floor(least(y0, y1)) AND floor(greatest(y0, y1))
    WHERE CASE WHEN y0 = y1 THEN g.ix BETWEEN floor(least(x0, x1)) AND floor(greatest(x0, x1)) ELSE
      g.ix BETWEEN floor(least(x0 + (greatest(g.iy, least(y0, y1)) - y0) * (x1 - x0) / (y1 - y0), x0 + (least(g.iy + 1, greatest(y0, y1)) - y0) * (x1 - x0) / (y1 - y0)))
        AND floor(greatest(x0 + (greatest(g.iy, least(y0, y1)) - y0) * (x1 - x0) / (y1 - y0), x0 + (least(g.iy + 1, greatest(y0, y1)) - y0) * (x1 - x0) / (y1 - y0))) END
    UNION SELECT * FROM {region_cells})"""


@query("J2_touched_cell_labels", f"""SELECT g.iy, g.ix, coalesce(l.label, 0) AS label FROM {{grid}} g LEFT JOIN
    (SELECT iy, ix, max(CAST(substr(region, 2) AS BIGINT)) + 1 AS label FROM {TOUCHED} GROUP BY ALL) l USING (iy, ix)""")
def _(spark, sf):
    touched = o.touched_cells(v.edges(spark, sf)).withColumn("label", F.substring("region", 2, 20).cast("bigint") + 1)
    return o.label_grid(v.grid(spark, sf), o.label_cells(touched, "label", "label"), "label")


@query("J3_clip_by_outline", """SELECT m.region, c.t, c.iy, c.ix, round(c.thk, 6) AS thk FROM {region_cells} m JOIN {cells} c USING (iy, ix)""")
def _(spark, sf):
    out = z.extract_regions(v.cells(spark, sf), v.region_cells(spark, sf), ["thk"], [], crop=False)
    return v.rounded(out, ["thk"], 6)


def _glaciers(spark, sf):
    """One small square per customer, given from its own origin (x, y), in the region its nation belongs to."""
    x, y = (F.col("c_custkey") * 37 % 560) / 10, F.col("c_custkey") / 15
    sq = ((0.03, 0.0), (0.23, 0.0), (0.23, 0.2), (0.03, 0.2))
    return (v.table(spark, sf, "customer").join(v.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("c_custkey").alias("region"), F.lit(0).alias("ring"), F.col("n_regionkey").alias("zone"), x.alias("x"), y.alias("y"),
                    F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in sq]).alias("points")))


@query("J4_point_in_polygon", """WITH p AS (SELECT c_custkey AS pid, n_regionkey AS zone, (c_custkey * 37 % 560) / 10.0::DOUBLE + 0.13 AS px,
      c_custkey / 15.0::DOUBLE + 0.1 AS py FROM customer JOIN nation ON c_nationkey = n_nationkey),
    e AS (SELECT e.*, n_regionkey AS zone, s_suppkey FROM {edges} e JOIN supplier ON e.region = 'R' || s_suppkey JOIN nation ON s_nationkey = n_nationkey),
    hit AS (SELECT p.pid, e.s_suppkey FROM p JOIN e ON p.zone = e.zone AND (e.y0 <= py) <> (e.y1 <= py)
       AND px < x0 + (py - y0) * (x1 - x0) / (y1 - y0) GROUP BY ALL HAVING count(*) % 2 = 1)
    SELECT p.pid, 'R' || min(hit.s_suppkey) AS complex FROM p LEFT JOIN hit USING (pid) GROUP BY ALL""")
def _(spark, sf):
    g = _glaciers(spark, sf)
    # the points are found from the origin: between corners far from zero the middle is rounded across a nearby edge
    reps = o.representative_points(o.edges_from_rings(g)).withColumnRenamed("region", "pid")
    points = reps.join(g.select(F.col("region").alias("pid"), "zone", "x", "y"), "pid").select(
        "pid", "zone", (F.col("x") + F.col("px")).alias("px"), (F.col("y") + F.col("py")).alias("py"))
    zones = v.table(spark, sf, "supplier").join(v.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("R"), F.col("s_suppkey").cast("string")).alias("region"), F.col("n_regionkey").alias("zone"))
    hits = o.points_in_polygons(points, v.edges(spark, sf).join(zones, "region"), group="zone")
    first = hits.groupBy("pid").agg(F.min_by("region", F.substring("region", 2, 20).cast("bigint")).alias("complex"))
    return points.select("pid").join(first, "pid", "left")


FOOT = """(SELECT c_custkey AS lid, (c_custkey * 37 % 560) / 10.0::DOUBLE AS xmin, c_custkey / 15.0::DOUBLE AS ymin,
    (c_custkey * 37 % 560) / 10.0::DOUBLE + 1.5 AS xmax, c_custkey / 15.0::DOUBLE + 1 AS ymax FROM customer)"""


def _footprints(spark, sf):
    x, y = F.col("c_custkey") * 37 % 560 / 10, F.col("c_custkey") / 15
    return v.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("lid"), x.alias("xmin"), y.alias("ymin"), (x + 1.5).alias("xmax"), (y + 1).alias("ymax"))


@query("J5_footprint_overlap", f"""SELECT f.lid, b.region AS rid FROM {FOOT} f JOIN
    (SELECT region, min(x0) xmin, max(x0) xmax, min(y0) ymin, max(y0) ymax FROM {{edges}} GROUP BY region) b
    ON f.xmin <= b.xmax AND b.xmin <= f.xmax AND f.ymin <= b.ymax AND b.ymin <= f.ymax""")
def _(spark, sf):
    boxes = o.bounding_boxes(v.edges(spark, sf)).withColumnRenamed("region", "rid")
    return o.overlapping_boxes(_footprints(spark, sf), boxes)


@query("J6_containing_code", f"""SELECT f.lid, min_by(b.region, b.k) AS code FROM {FOOT} f LEFT JOIN
    (SELECT region, CAST(substr(region, 2) AS BIGINT) k, min(x0) xmin, max(x0) xmax, min(y0) ymin, max(y0) ymax FROM {{edges}} GROUP BY ALL) b
    ON b.xmin <= f.xmin AND b.xmax >= f.xmax AND b.ymin <= f.ymin AND b.ymax >= f.ymax GROUP BY f.lid""")
def _(spark, sf):
    foot = o.bounding_boxes(v.edges(spark, sf)).withColumnRenamed("region", "code").withColumn(
        "order", F.substring("code", 2, 20).cast("bigint"))
    return o.containing_code(_footprints(spark, sf), foot)


@query("P4_mask_extraction", """SELECT f.region, c.t, c.iy, c.ix, CASE WHEN m.region IS NOT NULL THEN round(c.thk, 6) END AS thk, c.mask FROM
    (SELECT region, min(iy) iy0, max(iy) iy1, min(ix) ix0, max(ix) ix1 FROM {region_cells} GROUP BY region) f
    JOIN {cells} c ON c.iy BETWEEN iy0 AND iy1 AND c.ix BETWEEN ix0 AND ix1
    LEFT JOIN {region_cells} m ON m.region = f.region AND m.iy = c.iy AND m.ix = c.ix""")
def _(spark, sf):
    out = z.extract_regions(v.cells(spark, sf), v.region_cells(spark, sf), ["thk"], ["mask"])
    return v.rounded(out, ["thk"], 6)


@query("P5_mask_bounding_box", "SELECT region, min(iy) iy0, max(iy) iy1, min(ix) ix0, max(ix) ix1 FROM {region_cells} GROUP BY region")
def _(spark, sf):
    return z.mask_boxes(v.region_cells(spark, sf))


@query("P6_glacierised_mass", "SELECT t, iy, ix, CASE WHEN thk > 10 THEN round(ice_mass, 2) END AS ice_mass_glacierized FROM {cells}")
def _(spark, sf):
    return v.cells(spark, sf).select("t", "iy", "ix", F.round(_glacierised(), 2).alias("ice_mass_glacierized"))


@query("P7_signed_flux", "SELECT t, iy, ix, CASE WHEN glf < 0 THEN round(glf, 4) END AS glf_nonneg FROM {cells}")
def _(spark, sf):
    return v.cells(spark, sf).select("t", "iy", "ix", F.round(_negative_flux(), 4).alias("glf_nonneg"))


@query("A19_dissolve", "SELECT DISTINCT CAST(substr(region, 2) AS BIGINT) % 25 AS grp, iy, ix FROM {region_cells}")
def _(spark, sf):
    names = v.rings(spark, sf).select("region").distinct().withColumn("grp", F.substring("region", 2, 20).cast("bigint") % 25)
    return o.dissolve(v.region_cells(spark, sf), names, "grp")


RETREAT_MONTH = "CAST(DATE '2001-01-01' + to_months(CAST(CAST(substr(region, 2) AS BIGINT) % 18 AS INT)) AS DATE)"


@query("A20_retreat_mask", f"""WITH fr AS (SELECT iy + dy AS iy, ix + dx AS ix, {RETREAT_MONTH} AS month FROM {{region_cells}},
      (VALUES (0,0),(0,1),(0,-1),(1,0),(-1,0)) d(dy, dx)),
    seen AS (SELECT iy, ix, min(month) AS seen FROM fr GROUP BY ALL),
    months AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2001-02-01', (SELECT max(month) FROM fr), INTERVAL 1 MONTH)) AS DATE) AS time)
    SELECT m.time, g.iy, g.ix, CASE WHEN seen IS NULL OR seen > m.time THEN 1 ELSE 0 END AS retreat
    FROM {{grid}} g LEFT JOIN seen USING (iy, ix), months m""")
def _(spark, sf):
    k = F.substring("region", 2, 20).cast("int") % 18
    fronts = v.region_cells(spark, sf).select(F.add_months(F.lit("2001-01-01").cast("date"), k).alias("month"), "iy", "ix")
    return o.retreat_mask(v.grid(spark, sf), fronts, buffer=1.0)


@query("U4_cell_difference", """SELECT iy, ix FROM {grid} EXCEPT SELECT iy, ix FROM {region_cells}""")
def _(spark, sf):
    return o.cell_difference(v.grid(spark, sf), v.region_cells(spark, sf))


@query("S7_outline_scan", "SELECT region, ring, seq, round(x0, 6) x0, round(y0, 6) y0, round(x1, 6) x1, round(y1, 6) y1 FROM {edges}")
def _(spark, sf):
    text = lambda p: F.array_join(F.transform(p, lambda q: F.format_string("%.1f %.1f", q["x"], q["y"])), ", ")
    r = v.rings(spark, sf).groupBy("region").agg(
        F.array_sort(F.collect_list(F.struct("ring", F.concat(F.lit("("), text(F.col("points")), F.lit(")")).alias("s")))).alias("r"))
    wkt = r.select("region", F.concat(F.lit("POLYGON ("), F.array_join(F.col("r.s"), ", "), F.lit(")")).alias("wkt"))
    return v.rounded(o.edges_from_wkt(wkt), ["x0", "y0", "x1", "y1"], 6)


@query("S12_region_field_sink", """SELECT m.region, count(*) AS n, round(sum(c.ice_mass), 2) AS ice_mass
    FROM {region_cells} m JOIN {cells} c USING (iy, ix) GROUP BY m.region""")
def _(spark, sf):
    mask = v.region_cells(spark, sf)
    fields = z.extract_regions(v.cells(spark, sf), mask, ["ice_mass"], [], crop=False)
    back = sinks.write_and_read(spark, fields, "fields", ["region"], packed=True)
    return back.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ice_mass"), 2).alias("ice_mass"))
