"""Polygon outlines as edge rows, and the joins between polygons, points and grids.

Edge frames have columns ``region, ring, seq, x0, y0, x1, y1``; rings (shells and
holes alike) follow the even-odd rule.  No join here pairs everything with
everything: edges meet rows, tiles or bands through equality keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.model import require_rows


@dataclass(frozen=True)
class Grid:
    """Regular grid: cell (iy, ix) covers [x0+ix*dx, x0+(ix+1)*dx) and likewise in y."""

    x0: float = 0.0
    y0: float = 0.0
    dx: float = 1.0
    dy: float = 1.0

    def col_of(self, x: Column) -> Column:
        return (x - F.lit(self.x0)) / F.lit(self.dx)

    def row_of(self, y: Column) -> Column:
        return (y - F.lit(self.y0)) / F.lit(self.dy)


def edges_from_rings(rings: DataFrame, keys: tuple[str, ...] = ("region", "ring"), points: str = "points") -> DataFrame:
    """Edges from an array of (x, y) structs per ring; the ring is closed if it is open."""
    p = F.col(points)
    closed = F.when(p[0] == F.element_at(p, -1), p).otherwise(F.concat(p, F.array(p[0])))
    pairs = F.arrays_zip(F.slice("__p", 1, F.size("__p") - 1).alias("a"), F.slice("__p", 2, F.size("__p") - 1).alias("b"))
    return (
        rings.withColumn("__p", closed)
        .select(*keys, F.posexplode(pairs).alias("seq", "e"))
        .select(*keys, "seq", F.col("e.a.x").alias("x0"), F.col("e.a.y").alias("y0"),
                F.col("e.b.x").alias("x1"), F.col("e.b.y").alias("y1"))
    )


def edges_from_wkt(df: DataFrame, region: str = "region", wkt: str = "wkt") -> DataFrame:
    """Edges from ``POLYGON ((x y, ...), (...))`` text, whole text, no geometry library."""
    rings = F.regexp_extract_all(F.col(wkt), F.lit(r"\(([^()]+)\)"), 1)
    point = lambda s: F.struct(
        F.split(F.trim(s), r"\s+")[0].cast("double").alias("x"),
        F.split(F.trim(s), r"\s+")[1].cast("double").alias("y"),
    )
    return edges_from_rings(
        df.select(F.col(region).alias("region"), F.posexplode(rings).alias("ring", "__r"))
        .withColumn("points", F.transform(F.split("__r", ","), point))
        .drop("__r")
    )


def polygon_area(edges: DataFrame, holes: tuple[int, ...] | None = None, scale: float = 1.0) -> DataFrame:
    """Planar area per region: shell rings minus the rings flagged by ``is_hole``."""
    ring = edges.groupBy("region", "ring", "is_hole").agg(
        (F.abs(F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0"))) / 2).alias("a")
    )
    return ring.groupBy("region").agg(
        (F.sum(F.when(F.col("is_hole"), -F.col("a")).otherwise(F.col("a"))) * F.lit(scale)).alias("area")
    )


def bounding_boxes(edges: DataFrame) -> DataFrame:
    """xmin, ymin, xmax, ymax per region."""
    return edges.groupBy("region").agg(
        F.min("x0").alias("xmin"), F.min("y0").alias("ymin"), F.max("x0").alias("xmax"), F.max("y0").alias("ymax")
    )


def _spans(crossings: DataFrame, by: list[str]) -> DataFrame:
    """Pair sorted crossings into inside spans (xa, xb); half-open rows give an even count."""
    w = Window.partitionBy(*by).orderBy("xc")
    return (
        crossings.withColumns({"rn": F.row_number().over(w), "xb": F.lead("xc").over(w)})
        .where((F.col("rn") % 2 == 1) & F.col("xb").isNotNull())
        .select(*by, F.col("xc").alias("xa"), "xb")
    )


def centre_cells(edges: DataFrame, grid: Grid = Grid(), check: bool = False) -> DataFrame:
    """Cells whose centre lies inside each region: ``(region, iy, ix)``, regions may overlap.

    Scan-line fill: every edge meets the rows it crosses, crossings per
    (region, row) pair into spans, spans expand into columns.
    """
    if check:
        require_rows(edges, "no outlines to rasterise")
    ya, yb = F.least("v0", "v1"), F.greatest("v0", "v1")
    e = edges.select(
        "region",
        grid.row_of(F.col("y0")).alias("v0"), grid.row_of(F.col("y1")).alias("v1"),
        grid.col_of(F.col("x0")).alias("u0"), grid.col_of(F.col("x1")).alias("u1"),
    )
    e = e.withColumns({"lo": F.ceil(ya - 0.5), "hi": F.ceil(yb - 0.5) - 1}).where(F.col("lo") <= F.col("hi"))
    rows = e.select("*", F.explode(F.sequence("lo", "hi")).alias("iy"))
    xc = F.col("u0") + (F.col("iy") + 0.5 - F.col("v0")) * (F.col("u1") - F.col("u0")) / (F.col("v1") - F.col("v0"))
    s = _spans(rows.select("region", "iy", xc.alias("xc")), ["region", "iy"])
    s = s.withColumns({"lo": F.ceil(F.col("xa") - 0.5), "hi": F.ceil(F.col("xb") - 0.5) - 1})
    return s.where(F.col("lo") <= F.col("hi")).select("region", "iy", F.explode(F.sequence("lo", "hi")).alias("ix"))


def touched_cells(edges: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """All-touched cells: centre cells plus every cell an edge passes through."""
    e = edges.select(
        "region",
        grid.row_of(F.col("y0")).alias("v0"), grid.row_of(F.col("y1")).alias("v1"),
        grid.col_of(F.col("x0")).alias("u0"), grid.col_of(F.col("x1")).alias("u1"),
    )
    e = e.select("*", F.explode(F.sequence(F.floor(F.least("v0", "v1")), F.floor(F.greatest("v0", "v1")))).alias("iy"))
    flat = F.col("v0") == F.col("v1")
    at = lambda v: F.col("u0") + (F.least(F.greatest(v, F.least("v0", "v1")), F.greatest("v0", "v1")) - F.col("v0")) * (
        F.col("u1") - F.col("u0")) / (F.col("v1") - F.col("v0"))
    e = e.withColumns({
        "ca": F.when(flat, F.col("u0")).otherwise(at(F.col("iy").cast("double"))),
        "cb": F.when(flat, F.col("u1")).otherwise(at(F.col("iy") + 1.0)),
    })
    walked = e.select("region", "iy", F.explode(F.sequence(
        F.floor(F.least("ca", "cb")), F.floor(F.greatest("ca", "cb")))).alias("ix"))
    return walked.unionByName(centre_cells(edges, grid)).distinct()


def label_cells(cells: DataFrame, order: str, label: str) -> DataFrame:
    """One label per cell; the feature with the greatest ``order`` wins."""
    return cells.groupBy("iy", "ix").agg(F.max_by(label, order).alias(label))


def label_grid(grid_cells: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Label every grid cell, 0 outside; labelled cells off the grid drop out."""
    return grid_cells.join(labels, ["iy", "ix"], "left").withColumn(label, F.coalesce(label, F.lit(0)))


def representative_points(edges: DataFrame) -> DataFrame:
    """Centre of the widest inside span on the middle scan line of each region."""
    mid = edges.groupBy("region").agg(((F.min("y0") + F.max("y0")) / 2).alias("py"))
    c = edges.join(mid, "region").where(
        (F.least("y0", "y1") <= F.col("py")) & (F.col("py") < F.greatest("y0", "y1"))
    )
    xc = F.col("x0") + (F.col("py") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    s = _spans(c.select("region", "py", xc.alias("xc")), ["region", "py"])
    width = F.col("xb") - F.col("xa")
    return s.groupBy("region", "py").agg(
        F.max_by((F.col("xa") + F.col("xb")) / 2, F.struct(width, -F.col("xa"))).alias("px")
    ).select("region", "px", "py")


#: The smallest level of a box, for points and hair lines; tiles of level l are 2^l wide.
LEAST_LEVEL = -60
#: Edges of an outline in a band of its scan lines, about.
BAND_EDGES = 8


def _leveled(df: DataFrame, xmin: str, xmax: str, ymin: str, ymax: str) -> DataFrame:
    """Add the level of each box: its tiles are no smaller than it, so that it lies in four of them at most."""
    extent = F.greatest(F.col(xmax) - F.col(xmin), F.col(ymax) - F.col(ymin))
    return df.withColumn("__l", F.greatest(F.when(extent > 0, F.ceil(F.log2(extent))).otherwise(LEAST_LEVEL), F.lit(LEAST_LEVEL)).cast("int"))


def _levels(df: DataFrame) -> list[int]:
    """The levels that occur: one for each power of two of the extents at most."""
    return sorted(r[0] for r in df.select("__l").distinct().collect())


def _tiles(df: DataFrame, level: Column, xmin: str, xmax: str, ymin: str, ymax: str) -> DataFrame:
    """A row for each tile of a level (column ``__at``) that the box lies in."""
    df = df.withColumn("__at", level)
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / F.pow(2.0, "__at")), F.floor(F.col(b) / F.pow(2.0, "__at"))))
    return df.withColumn("__ty", bins(ymin, ymax)).withColumn("__tx", bins(xmin, xmax))


def points_in_polygons(points: DataFrame, edges: DataFrame, group: str | None = None) -> DataFrame:
    """(point, region) pairs with the point inside; ``points`` has ``pid, px, py``.

    A region's box lies in few tiles of its own size; a point looks them up at every size that occurs (plus
    ``group`` when given).  The crossing count then reads only the edges in the point's band of the region,
    whose height goes by the number of its edges.
    """
    key = [group] if group else []
    boxes = edges.groupBy(*key, "region").agg(
        F.min("x0").alias("xmin"), F.max("x0").alias("xmax"), F.min("y0").alias("ymin"), F.max("y0").alias("ymax"), F.count(F.lit(1)).alias("n"))
    boxes = _leveled(boxes, "xmin", "xmax", "ymin", "ymax")
    boxes = boxes.withColumn("__h", F.pow(2.0, F.col("__l") - F.ceil(F.log2(F.greatest(F.col("n") / BAND_EDGES, F.lit(1.0))))))
    p = points.withColumn("__at", F.explode(F.array(*[F.lit(x) for x in _levels(boxes)]).cast("array<int>")))
    p = p.withColumns({"__ty": F.floor(F.col("py") / F.pow(2.0, "__at")), "__tx": F.floor(F.col("px") / F.pow(2.0, "__at"))})
    homes = _tiles(boxes, F.col("__l"), "xmin", "xmax", "ymin", "ymax")
    cand = p.join(homes, [*key, "__at", "__ty", "__tx"]).where(
        F.col("px").between(F.col("xmin"), F.col("xmax")) & F.col("py").between(F.col("ymin"), F.col("ymax"))
    ).select(*key, "pid", "px", "py", "region", F.floor(F.col("py") / F.col("__h")).alias("__band"))
    band = edges.where(F.col("y0") != F.col("y1")).join(boxes.select(*key, "region", "__h"), [*key, "region"]).withColumn(
        "__band", F.explode(F.sequence(F.floor(F.least("y0", "y1") / F.col("__h")), F.floor(F.greatest("y0", "y1") / F.col("__h")))))
    hit = (F.least("y0", "y1") <= F.col("py")) & (F.col("py") < F.greatest("y0", "y1")) & (
        F.col("px") < F.col("x0") + (F.col("py") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))
    n = cand.join(band.select(*key, "region", "__band", "x0", "y0", "x1", "y1"), [*key, "region", "__band"])
    return (n.groupBy(*key, "pid", "region").agg(F.count_if(hit).alias("n"))
            .where(F.col("n") % 2 == 1).select(*key, "pid", "region"))


def overlapping_boxes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(lid, rid) of boxes that intersect (closed); boxes have ``xmin ymin xmax ymax``.

    A box lies in few tiles of its own size, and looks up the other side's larger ones at each size that occurs.
    Each pair is reported only by the tile holding the corner of its intersection, so no distinct is needed.
    """
    sides = {}
    for side, df in (("l", left), ("r", right)):
        names = {c: f"{side}_{c}" for c in ("xmin", "ymin", "xmax", "ymax")}
        sides[side] = _leveled(df.select(f"{side}id", *[F.col(c).alias(n) for c, n in names.items()]), *[f"{side}_{c}" for c in ("xmin", "xmax", "ymin", "ymax")])
    levels = {side: _levels(df) for side, df in sides.items()}

    def tiles(side: str, others: list[int]) -> DataFrame:
        larger = F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > F.col("__l"))
        df = sides[side].withColumn("__each", F.explode(F.concat(F.array("__l"), larger)))
        df = _tiles(df, F.col("__each"), *[f"{side}_{c}" for c in ("xmin", "xmax", "ymin", "ymax")])
        return df.withColumnRenamed("__l", f"{side}_l").drop("__each")

    corner = lambda a: F.floor(F.greatest(f"l_{a}min", f"r_{a}min") / F.pow(2.0, "__at")) == F.col(f"__t{a}")
    return tiles("l", levels["r"]).join(tiles("r", levels["l"]), ["__at", "__ty", "__tx"]).where(
        (F.col("__at") == F.greatest("l_l", "r_l"))
        & (F.col("l_xmin") <= F.col("r_xmax")) & (F.col("r_xmin") <= F.col("l_xmax"))
        & (F.col("l_ymin") <= F.col("r_ymax")) & (F.col("r_ymin") <= F.col("l_ymax")) & corner("y") & corner("x")
    ).select("lid", "rid")


def containing_code(boxes: DataFrame, footprints: DataFrame) -> DataFrame:
    """First footprint (by ``order``) that fully contains each box, NULL code when none does.

    A containing footprint covers the box's lower corner, which is looked up at every size of footprints that occurs.
    """
    f = _leveled(footprints.select("code", "order", *[F.col(c).alias(f"f_{c}") for c in ("xmin", "ymin", "xmax", "ymax")]), "f_xmin", "f_xmax", "f_ymin", "f_ymax")
    b = boxes.withColumn("__at", F.explode(F.array(*[F.lit(x) for x in _levels(f)]).cast("array<int>")))
    b = b.withColumns({"__ty": F.floor(F.col("ymin") / F.pow(2.0, "__at")), "__tx": F.floor(F.col("xmin") / F.pow(2.0, "__at"))})
    f = _tiles(f, F.col("__l"), "f_xmin", "f_xmax", "f_ymin", "f_ymax")
    inside = ((F.col("f_xmin") <= F.col("xmin")) & (F.col("f_ymin") <= F.col("ymin"))
              & (F.col("f_xmax") >= F.col("xmax")) & (F.col("f_ymax") >= F.col("ymax")))
    found = b.join(f, ["__at", "__ty", "__tx"]).where(inside).groupBy("lid").agg(F.min_by("code", "order").alias("code"))
    return boxes.select("lid").join(found, "lid", "left")


def dissolve(region_cells: DataFrame, membership: DataFrame, group: str) -> DataFrame:
    """Merged outline of each group as a cell set."""
    return region_cells.join(membership, "region").select(group, "iy", "ix").distinct()


def row_spans(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The cells as runs without gaps: ``keys, iy, a, b`` with columns a to b."""
    at = F.row_number().over(Window.partitionBy(*keys, "iy").orderBy("ix"))
    runs = cells.select(*keys, "iy", "ix").distinct().withColumn("__run", F.col("ix") - at)
    return runs.groupBy(*keys, "iy", "__run").agg(F.min("ix").alias("a"), F.max("ix").alias("b")).drop("__run")


def united(spans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Overlapping and touching spans of each row as one."""
    row = Window.partitionBy(*keys, "iy").orderBy("a", "b")
    reached = F.max("b").over(row.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("a") <= reached + 1, 0).otherwise(1)
    part = spans.withColumn("__new", new).withColumn("__part", F.sum("__new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy(*keys, "iy", "__part").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("__part")


def dilate(cells: DataFrame, radius: float, keys: Sequence[str] = ()) -> DataFrame:
    """Cells within ``radius`` (cell units, centre to centre) of a cell of the set, each once.

    Runs of cells grow as a whole, by one span for each row that the disc reaches, so that rows grow with the
    outline's length times the radius; spans of a row are united before cells are written out.
    """
    reach = F.sequence(F.lit(-int(radius)), F.lit(int(radius)))
    wide = F.floor(F.sqrt(F.lit(float(radius) ** 2) - F.col("d") * F.col("d")))
    grown = row_spans(cells, keys).withColumn("d", F.explode(reach)).select(
        *keys, (F.col("iy") + F.col("d")).alias("iy"), (F.col("a") - wide).alias("a"), (F.col("b") + wide).alias("b"))
    return united(grown, keys).select(*keys, "iy", F.explode(F.sequence("a", "b")).alias("ix"))


def retreat_mask(reference: DataFrame, fronts: DataFrame, buffer: float = 0.0) -> DataFrame:
    """Monthly 1/0 mask: 1 while a reference cell is not yet covered by any front so far.

    ``fronts`` has ``month, iy, ix``.  One min-date per cell replaces the running
    union; the first month is dropped.
    """
    grown = dilate(fronts, buffer, ("month",)) if buffer else fronts
    seen = grown.groupBy("iy", "ix").agg(F.min("month").alias("seen"))
    span = fronts.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    months = F.sequence(F.add_months(span.select("a").scalar(), 1), span.select("b").scalar(),
                        F.expr("interval 1 month"))
    ref = reference.select("iy", "ix").distinct().join(seen, ["iy", "ix"], "left")
    return ref.select("iy", "ix", "seen", F.explode(months).alias("time")).select(
        "time", "iy", "ix",
        F.when(F.col("seen").isNull() | (F.col("seen") > F.col("time")), 1).otherwise(0).alias("retreat"))


def cell_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells of ``left`` that are not in ``right``."""
    return left.join(right.select("iy", "ix"), ["iy", "ix"], "left_anti")


def merge_group_tags(members: DataFrame, groups: DataFrame, group: str = "grp", tag: str = "tags") -> DataFrame:
    """Append ``;group`` to the members' list column, one entry per group the member is in."""
    names = groups.groupBy("region").agg(F.array_join(F.sort_array(F.collect_set(group)), ";").alias("__new"))
    joined = members.join(names, "region", "left")
    old = F.when(F.col(tag) != "", F.col(tag))
    return joined.withColumn(tag, F.concat_ws(";", old, F.col("__new"))).drop("__new")
