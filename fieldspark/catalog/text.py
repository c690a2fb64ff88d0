"""Names, configs, listings and sinks: F1-F15, S1-S16, U1-U3, O1-O3."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.catalog import views as v
from fieldspark.catalog.registry import query
from fieldspark.functions import text as fx
from fieldspark.functions import units
from fieldspark.session import scratch_path
from fieldspark.sources import manifest as mf
from fieldspark.sources import sinks

C, L = F.col, F.lit


def _orders(spark, sf):
    return v.table(spark, sf, "orders")


@query("F1_ids_from_names", """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS exp_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS gcm_id FROM orders""")
def _(spark, sf):
    model = F.when(C("o_orderstatus") != "P", F.concat(L("gcm_"), C("o_orderpriority"), L("_exp_a_"))).otherwise("x_")
    name = F.concat(L("spatial_g1200m_id_"), C("o_custkey").cast("string"), L("_"), model, L("0001-01-01_0002-01-01.nc"))
    return _orders(spark, sf).select("o_orderkey", name.alias("f")).select("o_orderkey", *fx.member_ids_from_name(C("f")))


@query("F2_config_json", """SELECT event_id, '{"a.type":"' || event_type || '","geometry.front_retreat.prescribed.file":"' || CASE WHEN event_id % 3 = 0 THEN 'f.nc' ELSE 'false' END || '","k":"' || json_extract_string(props, '$.k') || '"}' AS config,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def _(spark, sf):
    e = v.table(spark, sf, "events")
    raw = F.map_concat(F.create_map(L("k"), F.get_json_object("props", "$.k"), L("k_doc"), L("help"), L("a.type"), C("event_type"), L("k_units"), L("m")),
                       F.when(C("event_id") % 3 == 0, F.create_map(L(fx.FRONT_FILE_KEY), L("f.nc"))).otherwise(F.create_map().cast("map<string,string>")))
    return e.select("event_id", fx.config_json(raw).alias("config")).withColumn("k", F.get_json_object("config", "$['k']").cast("bigint"))


@query("F3_config_lookup", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 10.0::DOUBLE ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS threshold FROM events")
def _(spark, sf):
    m = F.when(C("event_id") % 4 != 0, F.from_json("props", "map<string,double>"))
    return v.table(spark, sf, "events").select("event_id", fx.config_value(m, "k", 10.0).alias("threshold"))


@query("F4_option_catalogue", "SELECT DISTINCT 'opt.' || replace(p_name, ' ', '_') || '.' || p_size AS option FROM part")
def _(spark, sf):
    key = F.concat(L("opt."), F.replace("p_name", L(" "), L("_")), L("."), C("p_size").cast("string"))
    lines = F.array(F.concat(L("    run_config:"), key, L(' = "x";')), F.concat(L("    run_config:"), key, L('_doc = "text";')), L("// comment"))
    return fx.option_names(v.table(spark, sf, "part").select(F.explode(lines).alias("line")), "line", "run_config")


@query("F5_submission_names", """SELECT o_orderkey, l || n AS set_counter, CASE WHEN l = 'P' THEN 'm' || n ELSE 'm001' END AS ism_member, CASE WHEN l = 'E' THEN 'f' || n ELSE 'f001' END AS forcing_member,
    'lim_GrIS_GRP_MOD_' || CASE WHEN l = 'P' THEN 'm' || n ELSE 'm001' END || '_ESM1_' || CASE WHEN l = 'E' THEN 'f' || n ELSE 'f001' END || '_ssp370_' || l || n || '_' || year(o_orderdate) || '-2100.nc' AS name
    FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'C' WHEN 'O' THEN 'E' ELSE 'P' END AS l, lpad(CAST(o_orderkey % 900 + 1 AS VARCHAR), 3, '0') AS n FROM orders)""")
def _(spark, sf):
    s = F.when(C("o_orderstatus") == "F", "core").when(C("o_orderstatus") == "O", "ESM").otherwise("ppe")
    d = _orders(spark, sf).select("o_orderkey", F.concat(F.year("o_orderdate").cast("string"), L("-2100")).alias("tr"), *fx.set_counter(s, C("o_orderkey") % 900))
    for n, x in (("d", "GrIS"), ("g", "GRP"), ("m", "MOD"), ("e", "ESM1"), ("x", "ssp370")):
        d = d.withColumn(n, L(x))
    stem = fx.submission_stem("d", "g", "m", "ism_member", "e", "forcing_member", "x", "set_counter", "tr")
    return d.select("o_orderkey", "set_counter", "ism_member", "forcing_member", F.concat(L("lim_"), stem, L(".nc")).alias("name"))


@query("F6_paths", """SELECT o_orderkey, 'a/b' || CASE WHEN o_orderstatus = 'F' THEN '' ELSE '/' || o_orderstatus END || '/' || o_custkey AS path,
    'tas_GrIS_' || o_orderpriority || '_hist' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '_SD' END || '_v1_' || year(o_orderdate) || '.nc' AS name, 'out/basin_g_' || o_orderkey || '.nc' AS basin FROM orders""")
def _(spark, sf):
    st = F.when(C("o_orderstatus") != "F", F.concat(L("/"), C("o_orderstatus"), L("/")))
    name = fx.forcing_name(L("tas"), L("GrIS"), C("o_orderpriority"), L("hist"), F.when(C("o_orderkey") % 2 == 0, "none").otherwise("SD"), L("v1"), F.year("o_orderdate"))
    basin = fx.basin_name(F.concat(L("x/y/spatial_g_"), C("o_orderkey").cast("string"), L(".nc")), L("out/"))
    return _orders(spark, sf).select("o_orderkey", fx.join_path(L("/a/b/"), st, C("o_custkey").cast("string")).alias("path"), name.alias("name"), basin.alias("basin"))


@query("F7_region_directory", "SELECT c_custkey, CASE WHEN c_nationkey BETWEEN 13 AND 15 THEN 'RGI-13-15' ELSE 'RGI-' || c_nationkey END AS dir FROM customer")
def _(spark, sf):
    rid = F.format_string("RGI2000-v7.0-G-%02d-%05d", "c_nationkey", "c_custkey")
    return v.table(spark, sf, "customer").select("c_custkey", fx.region_directory(rid).alias("dir"))


@query("F8_region_labels", """SELECT region, round(sum(value), 2) AS value FROM (SELECT event_type AS region, value FROM events UNION ALL SELECT event_type, value FROM events UNION ALL SELECT 'total', value FROM events) GROUP BY region""")
def _(spark, sf):
    e = v.table(spark, sf, "events")
    indexed = e.select(F.length("event_type").alias("glacier_id"), C("event_type").alias("glacier_id_name"), "value")
    parts = [fx.with_region_labels(d).select("region", "value") for d in (indexed, e.select(C("event_type").alias("basin"), "value"), e.select("value"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("region").agg(F.round(F.sum("value"), 2).alias("value"))


@query("F9_unit_conversion", """SELECT o_orderkey, round(o_totalprice * CASE o_orderstatus WHEN 'F' THEN 1e-12 * 365.25 WHEN 'O' THEN 365.25::DOUBLE ELSE 31557600e-12 END, 5) AS gt_per_year FROM orders""")
def _(spark, sf):
    unit = F.when(C("o_orderstatus") == "F", "kg/day").when(C("o_orderstatus") == "O", "Gt/day").otherwise("kg/s")
    return _orders(spark, sf).select("o_orderkey", F.round(units.convert_by_column(C("o_totalprice"), unit, "Gt/yr"), 5).alias("gt_per_year"))


@query("F10_effective_years", """SELECT o_orderkey, len(range(1995, l + 1)) AS n_years, CASE WHEN l >= 1995 THEN CAST(l AS VARCHAR) END AS last_year, '1995-' || l AS span FROM
    (SELECT o_orderkey, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) = 1 AND day(o_orderdate) = 1 THEN 1 ELSE 0 END AS INT) AS l FROM orders)""")
def _(spark, sf):
    d = _orders(spark, sf).select("o_orderkey", *fx.effective_years(F.to_date(L("1995-03-01")), F.to_date("o_orderdate")))
    return d.select("o_orderkey", F.coalesce(F.size("years"), L(0)).cast("bigint").alias("n_years"), F.try_element_at("years", L(-1)).cast("string").alias("last_year"), "span")


@query("F11_noleap_calendar", """SELECT o_orderkey, n, CAST(n // 365 + 1 AS INT) AS year, CAST(month(d) AS INT) AS month, CAST(day(d) AS INT) AS day FROM
    (SELECT *, DATE '2001-01-01' + CAST(n % 365 AS INT) AS d FROM (SELECT o_orderkey, CAST(o_custkey * 37 % 120000 AS BIGINT) AS n FROM orders))""")
def _(spark, sf):
    d = _orders(spark, sf).select("o_orderkey", (C("o_custkey") * 37 % 120000).alias("k")).select("o_orderkey", "k", *fx.noleap_date(C("k")))
    return d.select("o_orderkey", fx.noleap_day_number(C("year"), C("month"), C("day")).cast("bigint").alias("n"), "year", "month", "day")


@query("F12_format_checks", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_size * 1000.0::DOUBLE ELSE p_size + 0.5::DOUBLE END AS metres,
    concat_ws(';', CASE WHEN p_size % 3 = 0 THEN 'resolution' END, CASE WHEN p_type NOT IN ('center', 'corner') THEN 'registration' END, CASE WHEN p_size >= 25 THEN 'walltime' END) AS errors FROM part""")
def _(spark, sf):
    res = F.when(C("p_size") % 3 == 0, F.concat(C("p_size").cast("string"), L("ft"))).when(C("p_size") % 3 == 1, F.concat(C("p_size").cast("string"), L(" km"))).otherwise(
        F.concat(C("p_size").cast("string"), L(".5 m")))
    wall = F.when(C("p_size") >= 25, "1h").otherwise(F.concat(C("p_size").cast("string"), L(":00:00")))
    return v.table(spark, sf, "part").select("p_partkey", fx.resolution_metres(res).alias("metres"), F.array_join(fx.grid_config_errors(res, C("p_type"), wall), ";").alias("errors"))


@query("F13_row_to_options", """SELECT o_orderkey, '-c ' || o_orderstatus || CASE WHEN o_orderkey % 3 <> 0 THEN ' -k ' || o_custkey ELSE '' END || ' -p ' || CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE o_orderpriority END AS options FROM orders""")
def _(spark, sf):
    d = _orders(spark, sf).select("o_orderkey", F.when(C("o_orderkey") % 3 != 0, C("o_custkey")).alias("k"), C("o_orderstatus").alias("c"), C("o_orderpriority").alias("p"))
    over = F.create_map(L("p"), F.when(C("o_orderkey") % 2 == 0, "x"))
    return d.select("o_orderkey", fx.render_options(fx.merge_maps(fx.row_to_map(["k", "c", "p"]), over)).alias("options"))


@query("F14_vertical_arrays", "SELECT vec_id, CASE WHEN label < 5 THEN CAST(len(embedding) AS DOUBLE) END AS n_levels, CASE WHEN label < 5 THEN round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2)), 6) + 0.0 END AS column_sum FROM embeddings")
def _(spark, sf):
    lv = fx.mask_levels(C("embedding"), C("label") < 5)
    total = F.aggregate(F.transform(lv, lambda x: x.cast("double") * 2), L(0.0), lambda a, x: a + x)
    return v.table(spark, sf, "embeddings").select("vec_id", F.when(C("label") < 5, F.size(lv)).cast("double").alias("n_levels"), (F.round(total, 6) + 0.0).alias("column_sum"))


@query("F15_nested_specs", """SELECT p_partkey AS doc, 'a' AS name, 'uniform' AS distribution, NULL::VARCHAR AS derived_from, NULL::VARCHAR AS error FROM part
    UNION ALL SELECT p_partkey, 'b.c', CASE WHEN p_size % 5 = 0 THEN 'norm' END, 'a', CASE WHEN p_size % 5 = 0 THEN 'both' END FROM part
    UNION ALL SELECT p_partkey, 'b.d.' || p_type || '.e.f', 'expon', NULL, NULL FROM part""")
def _(spark, sf):
    c = F.when(C("p_size") % 5 == 0, L('{"distribution": "norm", "derived_from": "a"}')).otherwise(L('{"derived_from": "a"}'))
    doc = F.concat(L('{"a": {"distribution": "uniform", "loc": 1}, "b": {"c": '), c, L(', "d": {"'), C("p_type"), L('": {"loc": 2, "e": {"f": {"distribution": "expon"}, "g": {"loc": 3}}}}}}'))
    p = v.table(spark, sf, "part").select("p_partkey", doc.alias("text"))
    return fx.flatten_specs(p, "p_partkey", "text").drop("spec")


# ------------------------------------------------------------- sources


@query("S1_cube_scan", "SELECT t, count(*) AS n, round(sum(ice_mass), 2) AS ice_mass FROM {cells} GROUP BY t")
def _(spark, sf):
    path = scratch_path(spark, "cube")
    v.cells(spark, sf).repartitionByRange(C("t"), F.floor(C("iy") / 16)).sortWithinPartitions("t", "iy").write.parquet(path)
    cube = spark.read.parquet(path)
    return cube.groupBy("t").agg(F.count(L(1)).alias("n"), F.round(F.sum("ice_mass"), 2).alias("ice_mass"))


@query("S2_ensemble_scan", """SELECT CAST(exp_id AS VARCHAR) AS exp_id, gcm_id, count(*) AS n, round(sum(value), 2) AS value, count(CASE WHEN exp_id % 2 = 0 THEN 1 END) AS n_extra FROM {series} WHERE gcm_id IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') GROUP BY exp_id, gcm_id""")
def _(spark, sf):
    base = scratch_path(spark, "ensemble")
    s = v.series(spark, sf).withColumn("member", F.concat(L("id_"), C("exp_id").cast("string"), L("_gcm_"), C("gcm_id"), L("_exp_a")))
    paths = []
    for odd, df in ((0, s.withColumn("extra", L(1))), (1, s)):
        path = f"{base}/{odd}"
        # one file a member, by as many tasks as there are shuffle partitions
        dealt = df.where(C("exp_id") % 2 == odd).drop("exp_id", "gcm_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "member")
        dealt.write.partitionBy("member").parquet(path)
        paths.append(f"{path}/*")
    both = mf.scan_ensemble(spark, [p.removesuffix("/*") for p in paths][:1]).drop("member").unionByName(
        mf.scan_ensemble(spark, [paths[1].removesuffix("/*")]).drop("member"), allowMissingColumns=True)
    both = both.withColumn("gcm_id", F.url_decode("gcm_id"))
    return both.groupBy("exp_id", "gcm_id").agg(F.count(L(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"), F.count("extra").alias("n_extra"))


@query("S4_point_grid_scan", "SELECT round((c_custkey % 360)::DOUBLE, 1) AS longitude, round((c_custkey % 181 - 90)::DOUBLE, 1) AS latitude, CASE WHEN c_nationkey <> 4 THEN c_acctbal END AS flux FROM customer")
def _(spark, sf):
    path = scratch_path(spark, "points")
    d = v.table(spark, sf, "customer").select((C("c_custkey") % 360).alias("longiyude"), (C("c_custkey") % 181 - 90).alias("latitude"), F.when(C("c_nationkey") != 4, C("c_acctbal")).alias("hf"))
    d.write.csv(path, sep=";", header=True)
    return mf.scan_point_grid(spark, path)


@query("S5_id_list_scan", "SELECT 'RGI2000-v7.0-G-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-' || printf('%05d', c_custkey) AS rgi_id, 'N' || c_nationkey % 3 || '_AK' AS grp, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS region FROM customer")
def _(spark, sf):
    base = scratch_path(spark, "ids")
    d = v.table(spark, sf, "customer").select(F.format_string("RGI2000-v7.0-G-%02d-%05d", "c_nationkey", "c_custkey").alias("rgi_id"),
                                              F.format_string("N%d_target_AK_RGI_id", C("c_nationkey") % 3).alias("f"))
    d.write.partitionBy("f").csv(base, header=True)
    return mf.scan_id_lists(spark, f"{base}/*")


@query("S6_alias_links", "SELECT CAST(c_custkey AS VARCHAR) AS rgi6, CAST(c_nationkey AS VARCHAR) AS rgi7 FROM customer WHERE c_nationkey <> 5 UNION ALL SELECT CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS VARCHAR) FROM supplier")
def _(spark, sf):
    one = v.table(spark, sf, "customer").select(C("c_custkey").alias("RGIId"), F.when(C("c_nationkey") != 5, C("c_nationkey")).alias("rgi7_id"))
    two = v.table(spark, sf, "supplier").select(C("s_suppkey").alias("rgi60_id"), C("s_nationkey").alias("rgi_id"))
    bad = v.table(spark, sf, "part").select("p_partkey")
    return mf.scan_links([one, two, bad], ["rgi6", "rgi60_id", "RGIId"], ["rgi7", "rgi7_id", "rgi_id"])[0]


@query("S8_raster_manifest", "SELECT o_orderkey, 'pr' AS variable, 'CRU' AS units, CAST(date_trunc('month', o_orderdate) AS DATE) AS time FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 10 <> 0")
def _(spark, sf):
    good = F.concat(L("a/pr/pr_total_mm_CRU_"), C("o_orderkey").cast("string"), L("_"), F.date_format("o_orderdate", "MM_yyyy"), L(".tif"))
    path = F.when(C("o_orderstatus") == "P", F.concat(L("a/pr/tas_total_mm_CRU_"), F.date_format("o_orderdate", "MM_yyyy"), L(".tif"))).when(
        C("o_orderkey") % 10 == 0, F.concat(L("a/pr/pr_total_mm_CRU_"), C("o_orderkey").cast("string"), L("_13_1999.tif"))).otherwise(good)
    ok, _ = mf.parse_rasters(_orders(spark, sf).select(path.alias("path")))
    return ok.select(F.regexp_extract("path", r"CRU_(\d+)_", 1).cast("bigint").alias("o_orderkey"), "variable", "units", "time")


@query("S9_page_links", """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(replace(html, 'href="/', 'href="'), 'href="([^"]+)"', 1)) AS href FROM pages)
    WHERE href NOT LIKE '?%' AND href NOT LIKE '/%' AND href NOT LIKE '%/' AND href NOT LIKE '%..%' GROUP BY ALL""")
def _(spark, sf):
    pages = v.table(spark, sf, "pages").withColumn("html", F.replace("html", L('href="/'), L('href="')))
    return mf.page_links(pages, "html", ["page_id"]).groupBy("page_id", "href").agg(F.count(L(1)).alias("n"))


@query("S10_sync_plan", """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'delete' WHEN o_orderkey % 7 = 0 THEN 'transfer' WHEN o_orderkey % 11 = 0 THEN 'transfer' WHEN o_orderkey % 13 = 0 THEN 'unchanged' WHEN o_orderkey % 17 = 0 THEN 'transfer' ELSE 'unchanged' END AS action
    FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_orderkey % 7 = 0)""")
def _(spark, sf):
    k = C("o_orderkey")
    base = _orders(spark, sf).select(k.alias("key"), C("o_totalprice").alias("size"), F.md5(k.cast("string")).alias("md5"))
    remote = base.where("key % 5 <> 0").select("key", "size", F.when(C("key") % 13 == 0, F.concat("md5", L("-3"))).otherwise(C("md5")).alias("etag"))
    local = base.where("key % 7 <> 0").select("key", F.when(C("key") % 11 == 0, C("size") + 1).otherwise(C("size")).alias("size"), F.when(C("key") % 17 == 0, F.md5(L("x"))).otherwise(C("md5")).alias("md5"))
    return mf.sync_plan(remote, local, delete_extra=True)


@query("S13_batched_sinks", "SELECT t, TRUE AS agrees, count(*) AS n, round(sum(ice_mass), 2) AS total FROM {cells} GROUP BY t")
def _(spark, sf):
    from fieldspark.operators import zonal as z

    cells = v.cells(spark, sf)
    whole = sinks.write_and_read(spark, cells, "cube", ["t"])
    path = scratch_path(spark, "slabs")
    sinks.write_time_slabs(cells, path, "t", 2, max_records=5000)
    slabs = spark.read.parquet(path)
    n = slabs.groupBy("t").agg(F.count(L(1)).alias("n"), F.sum("ice_mass").alias("s"))
    same = z.agree(n, whole.groupBy("t").agg(F.sum("ice_mass").alias("s")), ["t"], "s")
    return same.join(n.select("t", "n", F.round("s", 2).alias("total")), "t")


@query("S14_series_sink", "SELECT exp_id, gcm_id, month, round(value, 2) AS value FROM {series}")
def _(spark, sf):
    path, s = scratch_path(spark, "series"), v.series(spark, sf).withColumn("value", F.round("value", 2))
    sinks.write_csv(s, path, ["exp_id", "gcm_id", "month"])
    return spark.read.csv(path, header=True, schema="exp_id bigint, gcm_id string, month date, value double")


@query("S15_result_csv", "SELECT exp_id AS uq, round(avg(value), 7) AS score FROM {series} GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "scores")
    s = v.series(spark, sf).groupBy(C("exp_id").alias("sample")).agg(F.round(F.avg("value"), 7).alias("score"))
    sinks.write_csv(s.withColumnRenamed("sample", "uq"), path, ["score"])
    return spark.read.csv(path, header=True, schema="uq bigint, score double")


@query("S16_variable_splitter", """SELECT variable, CAST(CASE WHEN variable = 'flux' THEN (epoch(ts) / 86400 + (epoch(ts) + 3600) / 86400) / 2 ELSE epoch(ts) / 86400 END AS FLOAT) AS time, CAST(value AS FLOAT) AS value, CASE WHEN variable = 'flux' THEN 'kg s-1' END AS units
    FROM (SELECT ts, 'snap' AS variable, value FROM events UNION ALL SELECT ts, 'flux', value * 2 FROM events)""")
def _(spark, sf):
    s = F.unix_micros(C("ts").cast("timestamp")) / 1e6
    d = v.table(spark, sf, "events").select(s.alias("time"), s.alias("lo"), (s + 3600).alias("hi"), C("value").alias("snap"), (C("value") * 2).alias("flux"))
    long = mf.split_variables(d, ["snap"], ["flux"], "time", ("lo", "hi"))
    return sinks.write_and_read(spark, long, "variables", ["variable"])


# ------------------------------------------------- set operations, order


@query("U1_concatenate", "SELECT 'ev' AS source, event_id AS id, value, NULL::DOUBLE AS custkey FROM events UNION ALL SELECT 'ord', o_orderkey, o_totalprice, CAST(o_custkey AS DOUBLE) FROM orders")
def _(spark, sf):
    a = v.table(spark, sf, "events").select(L("ev").alias("source"), C("event_id").alias("id"), "value")
    b = _orders(spark, sf).select(L("ord").alias("source"), C("o_orderkey").alias("id"), C("o_totalprice").alias("value"), C("o_custkey").cast("double").alias("custkey"))
    return a.unionByName(b, allowMissingColumns=True)


@query("U2_single_or_multi_model", "SELECT o_custkey AS exp_id, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '5-LOW')) > 0 AS is_multi FROM orders GROUP BY 1")
def _(spark, sf):
    from fieldspark.operators import design

    single = spark.createDataFrame([("1-URGENT",), ("5-LOW",)], "gcm_id string")
    return design.multi_model(_orders(spark, sf).select(C("o_custkey").alias("exp_id"), C("o_orderpriority").alias("gcm_id")), single)


@query("U3_name_sets", """SELECT p_name AS name, count(DISTINCT p_brand) = (SELECT count(DISTINCT p_brand) FROM part) AS common FROM part GROUP BY 1""")
def _(spark, sf):
    p = v.table(spark, sf, "part")
    n = p.agg(F.count_distinct("p_brand")).scalar()
    return p.groupBy(C("p_name").alias("name")).agg(F.count_distinct("p_brand").alias("k")).select("name", (C("k") == n).alias("common"))


@query("O1_sorts", "SELECT iy, ix, round(v, 6) AS v, '{\"a\":' || ix || ',\"b\":' || iy || '}' AS keyed FROM {flat}")
def _(spark, sf):
    m = F.create_map(L("b"), C("iy"), L("a"), C("ix"))
    return v.flat(spark, sf).select("iy", "ix", F.round("v", 6).alias("v"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m)))).alias("keyed")).orderBy("iy", "ix")


@query("O2_top_variables", """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events
    WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 ORDER BY sum(value) DESC, user_id LIMIT 8)) WHERE r <= 5""")
def _(spark, sf):
    from fieldspark.operators import design

    e = v.table(spark, sf, "events")
    top = e.groupBy("user_id").agg(F.sum("value").alias("size")).orderBy(F.desc("size"), "user_id").limit(8)
    return design.top_per_key(e.join(F.broadcast(top.select("user_id")), "user_id"), ["user_id"], [("value", False), ("event_id", True)], 5).select("user_id", "event_id")


@query("O3_first_match", "SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS o_orderkey FROM orders WHERE o_orderpriority LIKE '%HIGH%' GROUP BY 1")
def _(spark, sf):
    from fieldspark.operators import design

    return design.first_match(_orders(spark, sf), ["o_custkey"], "o_orderpriority", "HIGH", "o_orderkey", "o_orderkey")
