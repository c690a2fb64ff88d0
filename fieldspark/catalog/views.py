"""Gridded, series and ensemble views over the test tables, for both engines.

Every view grows with its tables: the grid has one row of 60 cells per
supplier, outlines are one per supplier, series come from all orders or events.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.operators import outlines

NX = 60  # grid columns; rows grow with the suppliers


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cube from lineitem: year x supplier row x part column."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.year("l_shipdate").alias("t"), F.col("l_suppkey").alias("iy"), (F.col("l_partkey") % NX).alias("ix"))
        .agg(F.avg("l_quantity").alias("thk"), F.sum("l_extendedprice").alias("ice_mass"),
             F.min("l_linenumber").alias("mask"),
             F.sum(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("glf"))
        .withColumns({"y": F.col("iy") + 0.5, "x": F.col("ix") + 0.5})
    )


def flat(spark: SparkSession, sf: str) -> DataFrame:
    """Static field on the grid (all years together), with gaps where no row exists."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("iy"), (F.col("l_partkey") % NX).alias("ix"))
        .agg(F.avg("l_quantity").alias("v"), F.min("l_linenumber").alias("cls"))
    )


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """All cells of the grid."""
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("iy"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(NX - 1).cast("bigint"))).alias("ix"))


# Ring vertices relative to the outline's origin: an L shape with a slanted base, and a hole.
SHELL = ((0.0, 0.0), (7.3, 1.7), (7.3, 3.2), (5.2, 3.2), (5.2, 5.3), (0.0, 5.3))
HOLE = ((1.2, 2.2), (3.2, 2.2), (3.2, 3.7), (1.2, 3.7))


def rings(spark: SparkSession, sf: str) -> DataFrame:
    """Two rings per supplier; neighbours overlap on purpose."""
    ox, oy = (F.col("s_suppkey") * 7 % 50).cast("double"), F.col("s_suppkey").cast("double")
    pts = lambda ring: F.array(*[F.struct((ox + a).alias("x"), (oy + b).alias("y")) for a, b in ring])
    both = F.array(F.struct(F.lit(0).alias("ring"), F.lit(False).alias("is_hole"), pts(SHELL).alias("points")),
                   F.struct(F.lit(1).alias("ring"), F.lit(True).alias("is_hole"), pts(HOLE).alias("points")))
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("R"), F.col("s_suppkey").cast("string")).alias("region"), F.inline(both))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return outlines.edges_from_rings(rings(spark, sf), ("region", "ring", "is_hole"))


def region_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Centre-rule cells of all outlines, limited to the grid."""
    return outlines.centre_cells(edges(spark, sf)).join(
        table(spark, sf, "supplier").select(F.col("s_suppkey").alias("iy")), "iy", "left_semi"
    ).select("region", "iy", "ix")


def rate(spark: SparkSession, sf: str) -> DataFrame:
    """Irregular series per member."""
    return table(spark, sf, "events").select(F.col("user_id").alias("member"), "ts", F.col("value").alias("rate"), "event_id")


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly series per experiment and model; experiments grow with the customers."""
    return (
        table(spark, sf, "orders")
        .groupBy(F.floor(F.col("o_custkey") / 100).alias("exp_id"), F.col("o_orderpriority").alias("gcm_id"),
                 F.trunc("o_orderdate", "month").alias("month"))
        .agg(F.sum("o_totalprice").alias("value"))
    )


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily field over (event type, user) cells."""
    return table(spark, sf, "events").select(
        F.to_date("ts").alias("day"), F.col("event_type").alias("cell_y"), F.col("user_id").alias("cell_x"), "value")


def simobs(spark: SparkSession, sf: str) -> DataFrame:
    """Simulated and observed values per member and cell."""
    return (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_linenumber").alias("exp_id"), F.col("l_suppkey").alias("iy"), (F.col("l_partkey") % NX).alias("ix"))
        .agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("sim"), F.avg("p_retailprice").alias("obs"))
    )


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly climate fields per scenario on a narrow grid."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("scenario"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
                 F.col("l_suppkey").alias("iy"), (F.col("l_partkey") % 4).alias("ix"))
        .agg(F.avg("l_quantity").alias("tas"), F.sum(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("pr"))
    )


def holed(spark: SparkSession, sf: str) -> DataFrame:
    """Full grid with explicit gaps: rectangular holes and low values are missing."""
    hole = (F.col("iy") % 25).between(5, 12) & F.col("ix").between(20, 30)
    return grid(spark, sf).join(flat(spark, sf), ["iy", "ix"], "left").select(
        "iy", "ix", F.when(~hole & (F.col("v") >= 20), F.col("v")).alias("v"))


SQL_VIEWS = {
    "monthly": """(SELECT l_returnflag AS scenario, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
        l_suppkey AS iy, l_partkey % 4 AS ix, avg(l_quantity) AS tas, sum(l_extendedprice * (l_discount - l_tax)) AS pr FROM lineitem GROUP BY ALL)""",
    "holed": """(SELECT iy, ix, CASE WHEN NOT (iy % 25 BETWEEN 5 AND 12 AND ix BETWEEN 20 AND 30) AND v >= 20 THEN v END AS v
        FROM {grid} LEFT JOIN {flat} USING (iy, ix))""",
    "cells": f"""(SELECT CAST(year(l_shipdate) AS INT) AS t, l_suppkey AS iy, l_partkey % {NX} AS ix,
        avg(l_quantity) AS thk, sum(l_extendedprice) AS ice_mass, min(l_linenumber) AS mask,
        sum(l_extendedprice * (l_discount - l_tax)) AS glf,
        CAST(l_suppkey + 0.5 AS DOUBLE) AS y, CAST(l_partkey % {NX} + 0.5 AS DOUBLE) AS x
        FROM lineitem GROUP BY ALL)""",
    "flat": f"""(SELECT l_suppkey AS iy, l_partkey % {NX} AS ix, avg(l_quantity) AS v, min(l_linenumber) AS cls
        FROM lineitem GROUP BY ALL)""",
    "grid": f"(SELECT s_suppkey AS iy, ix FROM supplier, range({NX}) r(ix))",
    "edges": """(SELECT 'R' || s_suppkey AS region, e.ring, e.ring = 1 AS is_hole, e.seq,
        CAST(s_suppkey * 7 % 50 AS DOUBLE) + e.ax AS x0, CAST(s_suppkey AS DOUBLE) + e.ay AS y0,
        CAST(s_suppkey * 7 % 50 AS DOUBLE) + e.bx AS x1, CAST(s_suppkey AS DOUBLE) + e.by AS y1
        FROM supplier, (SELECT ring, seq, CAST(ax AS DOUBLE) ax, CAST(ay AS DOUBLE) ay,
          CAST(bx AS DOUBLE) bx, CAST("by" AS DOUBLE) AS "by" FROM (VALUES """
    + ", ".join(
        f"({r},{i},{ring[i][0]},{ring[i][1]},{ring[(i + 1) % len(ring)][0]},{ring[(i + 1) % len(ring)][1]})"
        for r, ring in enumerate((SHELL, HOLE)) for i in range(len(ring)))
    + """) v(ring, seq, ax, ay, bx, "by")) e)""",
    # brute force: crossing parity of every cell centre in reach of an outline
    "region_cells": """(SELECT e.region, g.iy, g.ix FROM {edges} e JOIN
        (SELECT 'R' || s.s_suppkey AS region, gy.s_suppkey AS iy, s.s_suppkey * 7 % 50 + dx AS ix
         FROM supplier s JOIN supplier gy ON gy.s_suppkey BETWEEN s.s_suppkey AND s.s_suppkey + 5, range(8) d(dx)) g
        ON e.region = g.region
        WHERE (e.y0 <= g.iy + 0.5) <> (e.y1 <= g.iy + 0.5)
          AND g.ix + 0.5 < e.x0 + (g.iy + 0.5 - e.y0) * (e.x1 - e.x0) / (e.y1 - e.y0)
        GROUP BY ALL HAVING count(*) % 2 = 1)""",
    "rate": "(SELECT user_id AS member, ts, value AS rate, event_id FROM events)",
    "series": """(SELECT o_custkey // 100 AS exp_id, o_orderpriority AS gcm_id,
        CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS value FROM orders GROUP BY ALL)""",
    "daily": "(SELECT CAST(ts AS DATE) AS day, event_type AS cell_y, user_id AS cell_x, value FROM events)",
    "simobs": f"""(SELECT l_linenumber AS exp_id, l_suppkey AS iy, l_partkey % {NX} AS ix,
        avg(l_extendedprice / l_quantity) AS sim, avg(p_retailprice) AS obs
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)""",
}


def expand(sql: str) -> str:
    """Replace ``{view}`` names, views inside views included."""
    pattern = re.compile(r"\{(" + "|".join(SQL_VIEWS) + r")\}")
    while pattern.search(sql):
        sql = pattern.sub(lambda m: SQL_VIEWS[m.group(1)], sql)
    return sql


def rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """Round for comparison; adding 0 turns -0 into 0."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})
