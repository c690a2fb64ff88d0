"""Plans and results that must hold when the tables grow."""

import glob
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldspark.catalog.compare import canonical, connect, duck_frame
from fieldspark.operators import design as d
from fieldspark.operators import distance, regrid
from fieldspark.operators.outlines import Grid
from fieldspark.session import scratch_path as scratch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def targets(spark, n):
    return spark.range(n).select(F.col("id").alias("ty"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tx")).withColumns(
        {"sx": F.col("tx") + 0.75, "sy": F.col("ty") + 0.5})


def field(spark, n, slices=1):
    return spark.range(n * 5 * slices).select((F.col("id") / 5 % n).cast("long").alias("iy"), (F.col("id") % 5).alias("ix"),
                                              F.floor(F.col("id") / (5 * n)).alias("step"), F.col("id").cast("double").alias("v"))


def test_bilinear_neighbours_are_not_broadcast(spark):
    out = regrid.bilinear(targets(spark, 6), field(spark, 6), ["v"])
    assert "SortMergeJoin [iy" in plan(out)
    assert out.count() == 24 and out.where("v is null").count() == 0


def test_slices_are_broadcast_and_not_their_copies(spark):
    out = regrid.every_slice(targets(spark, 2), field(spark, 6, 500), ["step"])
    assert "BroadcastHashJoin [__k" in plan(out) and "Inner, BuildRight" in plan(out)
    assert out.count() == 2 * 4 * 500


def test_supersampled_points_are_not_broadcast(spark):
    t = targets(spark, 6).select("ty", "tx", F.col("sx").alias("cx"), F.col("sy").alias("cy"))
    out = regrid.nearest_mean(regrid.supersample(t, 3), field(spark, 6), ["v"], Grid(), ["ty", "tx"])
    assert "SortMergeJoin [iy" in plan(out)
    assert out.count() == 24


def test_crossed_files_are_not_copied(spark):
    files = spark.range(7).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("sample_df"), (F.col("id") * 2).alias("climate"))
    samples = spark.range(5).select(F.col("id").alias("sample_uq"), (F.col("id") + 1).alias("size"))
    out = d.cross_files(files, samples)
    assert "Generate explode" not in plan(out)
    assert {tuple(r) for r in out.select("sample", "climate", "size").collect()} == {(f"f{i}_uq_{j}", 2 * i, j + 1) for i in range(7) for j in range(5)}
    assert d.cross_files(files.where("climate < 0"), samples).count() == 0


@pytest.fixture
def tables(sf, tmp_path):
    """A folder with the smallest tables, of which a test may replace some."""
    for path in glob.glob(f"{sf}/*.parquet"):
        os.symlink(path, tmp_path / os.path.basename(path))

    def replace(name, sql):
        con = connect(sf)
        os.unlink(tmp_path / f"{name}.parquet")
        con.execute(f"copy ({sql}) to '{tmp_path}/{name}.parquet'")

    replace.path = str(tmp_path)
    return replace


def agrees(spark, path, name):
    mine, (theirs, _) = entry.queries()[name](spark, path).toPandas(), duck_frame(connect(path), entry.oracle_sql()[name])
    assert canonical(mine) == canonical(theirs)
    return mine


def test_long_ids_keep_all_digits(spark, tables):
    tables("customer", "select * replace (c_custkey + 123400 as c_custkey) from customer")
    assert agrees(spark, tables.path, "S5_id_list_scan")["rgi_id"].str.fullmatch(r"RGI2000-v7.0-G-\d\d-\d{6}").all()


def test_one_of_equally_drawn_members_is_the_most_drawn(spark, tables):
    tables("orders", "select o.* replace (100 * e as o_custkey, 1000.0 as o_totalprice) from (from orders limit 1) o, range(1001) r(e)")
    got = agrees(spark, tables.path, "A28_resample_counts")
    assert (got["n"] == got["n"].max()).sum() > 1 and got["most_drawn"].sum() == 1


def test_conservative_remap_of_a_long_grid(spark, tables):
    tables("supplier", "select s.* replace (1300 + s_suppkey as s_suppkey) from supplier s")
    tables("lineitem", "select * replace (1300 + l_suppkey as l_suppkey) from lineitem")
    assert agrees(spark, tables.path, "J20_conservative_remap")["ty"].max() >= 400


def test_members_have_one_file_each(spark, sf, monkeypatch):
    from fieldspark.catalog import text

    made = []
    monkeypatch.setattr(text, "scratch_path", lambda s, name: made.append(scratch(s, name)) or made[-1])
    entry.queries()["S2_ensemble_scan"](spark, sf)
    files = glob.glob(f"{made[0]}/*/member=*/*.parquet")
    assert len(files) == len({os.path.dirname(f) for f in files}) > 0


def test_bands_of_a_long_grid_stay_small(spark):
    for height in (1_000, 60_000, 360_000):
        rows, columns = distance._bands(height, 60, 4)
        assert 60 * rows <= distance.CELLS and (columns == 1 or 4 * height * columns <= distance.CELLS)
    hole = spark.range(400 * 3).select(F.floor(F.col("id") / 3).alias("iy"), (F.col("id") % 3).alias("ix")).withColumn(
        "v", F.when(~F.col("iy").between(100, 298) | ((F.col("iy") == 150) & (F.col("ix") == 2)), F.col("iy").cast("double")))  # wider than the rows looked at one by one
    got = {(r.iy, r.ix): r.v for r in distance.fill_gaps(hole, "v").collect()}
    assert got[120, 1] == 99 and got[130, 0] == 150 and got[225, 0] == 299 and got[224, 0] == 150 and got[224, 1] == 150 and got[226, 2] == 299


def test_grouped_function_makes_no_group_of_each_key(spark, tables):
    tables("events", "select * replace (if(user_id % 3 = 0 or event_id % 2 = 0, null, value) as value) from events")
    agrees(spark, tables.path, "X1_grouped_function")
    assert "FlatMapGroups" not in plan(entry.queries()["X1_grouped_function"](spark, tables.path))


def test_task_sizes_are_bounded(spark):
    from fieldspark.session import BOUNDS, apply_settings

    before = {key: spark.conf.get(key) for key in BOUNDS}
    try:
        for key, value in BOUNDS.items():
            spark.conf.set(key, "128m")
            assert apply_settings(spark).conf.get(key) == f"{value}b"
            spark.conf.set(key, "8m")
            assert apply_settings(spark).conf.get(key) == "8m"  # smaller ones stay
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_overrides_are_marked_by_one_join(spark, sf):
    out = entry.queries()["J27_override_filter"](spark, sf)
    assert plan(out).count("Join") == 1
    over = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "a")], "member long, key string")
    allowed = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "a")], "member long, key string")
    got = sorted((str(r.member), r.key, r.state) for r in d.mark_overrides(over, allowed).collect())
    assert got == [("1", "a", "kept"), ("1", "a", "kept"), ("2", "a", "skipped"), ("None", "a", "skipped")]


def test_merged_forcings_are_written_once_before_the_fill(spark):
    from fieldspark.plans import forcing

    cells = [("G", "p", "c", 2000, 1, y, x, so) for y in range(3) for x, so in enumerate((None, 5.0 + y, 9.0))]
    long = spark.createDataFrame(cells, "gcm string, pathway string, forcing string, year int, month int, iy long, ix long, so double").unpivot(
        ["gcm", "pathway", "forcing", "year", "month", "iy", "ix"], ["so"], "variable", "value")
    monthly, _ = forcing.merge_forcings(long, {"so": "salinity", "mrro": "runoff"}, {"so": "salinity"}, ["mrro"])
    assert "LocalTableScan" not in plan(monthly) and "ExistingRDD" not in plan(monthly)  # reads of the written pivot alone
    assert sorted((r.iy, r.ix, r.salinity) for r in monthly.collect()) == [(y, x, s) for y in range(3) for x, s in ((0, 5.0 + y), (1, 5.0 + y), (2, 9.0))]


def test_factorial_levels_are_never_shuffled(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = entry.queries()["R2_full_factorial"](spark, sf)
        assert plan(out).count("BroadcastHashJoin") == 2 and "hashpartitioning" not in plan(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_holes_within_a_tile_take_no_round(spark):
    from fieldspark.operators import relax

    f = spark.range(16 * 16).select(F.floor(F.col("id") / 16).alias("iy"), (F.col("id") % 16).alias("ix"))
    hole = (F.col("iy").between(1, 3) & F.col("ix").between(2, 5)) | ((F.col("iy") == 12) & (F.col("ix") == 9))
    rounds = []
    out = relax.laplace_fill(f.withColumn("v", F.when(~hole, F.col("ix") * 2.0 + F.col("iy"))), "v", 16, 16, tile=8, on_round=lambda n, r: rounds.append(n))
    assert not rounds
    assert out.where("v IS NULL OR abs(v - (2 * ix + iy)) > 1e-9").count() == 0  # a plane solves the equation


def test_points_on_an_edge_are_those_of_the_sql(spark, tables):
    tables("customer", "select * replace (c_custkey + 4000 as c_custkey, 0 as c_nationkey) from customer")  # 4023 and 4128 lie on an edge
    tables("supplier", "select s.* replace (260 + s_suppkey as s_suppkey, 0 as s_nationkey) from supplier s union all select s.* replace (270 + s_suppkey as s_suppkey, 0 as s_nationkey) from supplier s")
    assert agrees(spark, tables.path, "J4_point_in_polygon")["complex"].notna().any()


@pytest.mark.parametrize("name, rows, most", [("R2_full_factorial", 1_000_000, 1 << 20), ("J7_design_cross_files", 20_000_000, 20 << 20)])
def test_written_products_take_few_bits_a_row(spark, tmp_path, name, rows, most):
    out, path = entry.queries()[name](spark, "/root/testdata/sf0.1"), str(tmp_path / "out")
    out.write.parquet(path)
    assert sum(os.path.getsize(f) for f in glob.glob(f"{path}/*.parquet")) < most  # about 5 and 91 MB in plain pages and snappy
    back = spark.read.parquet(path)
    sums = [F.count("*"), *(F.sum(F.xxhash64(c) % 1_000_003) for c in out.columns)]
    assert back.dtypes == out.dtypes and back.count() == rows and back.agg(*sums).first() == out.agg(*sums).first()


def test_settings_leave_tables_between_steps_in_plain_pages(spark):
    import pyarrow.parquet as pq
    from fieldspark.llm.common import written

    file = written(spark.range(9), "plain").inputFiles()[0].removeprefix("file:")
    assert not any("DELTA" in e for e in pq.ParquetFile(file).metadata.row_group(0).column(0).encodings)
