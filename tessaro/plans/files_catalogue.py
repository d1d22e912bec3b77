"""Queries on sources, sinks, projections and small operators; files are written below the session's shared folder first."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import graph, optimize, ranking, relational, schema, spatial, stats
from ..session import table, worker_path
from ..sources import files
from .catalogue import _EDGES, chosen, fx, query, score_stations, station_features, street_distances, street_edges

# ---------------------------------------------------------------- files


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; on a local session without one, in a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessaro-files-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def lines_to(spark: SparkSession, df: DataFrame, header: str, name: str) -> str:
    """Writes text lines after a header line as one file; for small tables."""
    path = scratch(spark, name)
    order = df.withColumn("_o", F.lit(1)).unionByName(spark.range(1).select(F.lit(header).alias("value"), F.lit(0).alias("_o")))
    one = order.coalesce(1).sortWithinPartitions("_o", "value").select("value")
    one.write.text(path)
    return path


@query("source_csv", "select cast(n_nationkey as integer) as k, n_name as name from nation")
def source_csv(spark, d):
    """Comma-separated, with a byte-order mark before the header."""
    n = table(spark, d, "nation").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("value"))
    df = files.read_csv(spark, lines_to(spark, n, "﻿k,name ", "csv"))
    return df.select(F.col("k").cast("int").alias("k"), "name")


@query("source_csv_sniffed", "select cast(n_nationkey as integer) as k, n_name || ', land' as name from nation")
def source_csv_sniffed(spark, d):
    """Semicolons are found; commas inside values stay."""
    n = table(spark, d, "nation").select(F.concat_ws(";", F.col("n_nationkey").cast("string"), F.concat("n_name", F.lit(", land"))).alias("value"))
    return files.read_csv(spark, lines_to(spark, n, "k;name", "sniffed")).select(F.col("k").cast("int").alias("k"), "name")


@query("source_csv_thousands", "select cast(c_custkey as integer) as k, cast(c_custkey * 1003 as bigint) as v from customer")
def source_csv_thousands(spark, d):
    c = table(spark, d, "customer").select(F.concat_ws(";", F.col("c_custkey").cast("string"), F.replace(F.format_number(F.col("c_custkey") * 1003, 0), F.lit(","), F.lit("."))).alias("value"))
    return files.read_thousands_csv(spark, lines_to(spark, c, "k;v", "thousands"), ["v"]).select(F.col("k").cast("int").alias("k"), "v")


@query("source_csv_latin1", "select cast(n_nationkey as integer) as k, 'é' || n_name as name from nation")
def source_csv_latin1(spark, d):
    path = scratch(spark, "latin1")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("é"), "n_name").alias("name"))
    n.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return files.read_csv(spark, path, sep=",", encoding="ISO-8859-1").select(F.col("k").cast("int").alias("k"), "name")


@query("source_csv_broken", "select cast(n_nationkey as integer) as k, n_name || ', x' as name from nation")
def source_csv_broken(spark, d):
    """Rows quoted as a whole, with blank lines between them."""
    row = F.concat(F.lit('"'), F.col("n_nationkey").cast("string"), F.lit(',""'), "n_name", F.lit(', x"""'))
    n = table(spark, d, "nation").select(F.explode(F.array(row, F.lit(" "))).alias("value"))
    return files.read_broken_csv(spark, lines_to(spark, n, '"k,""name"""', "broken")).select(F.col("k").cast("int").alias("k"), "name")


@query("source_px", "select n_name as zone, s as sex, cast(case when (n_nationkey * 2 + i) % 7 = 0 then null else n_nationkey * 2 + i end as double) as value from nation, (values ('f', 0), ('m', 1)) t(s, i)")
def source_px(spark, d):
    """A statistics file with two headings and marks for missing values."""
    worker_path(spark)
    n = table(spark, d, "nation").orderBy("n_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit('"'), x["n_name"], F.lit('"'))), ",").alias("names"), F.max("n_nationkey").alias("top"))
    cells = F.transform(F.sequence(F.lit(0), F.col("top") * 2 + 1), lambda i: F.when(i % 7 == 0, '".."').otherwise(i.cast("string")))
    body = F.concat(F.lit('STUB="zone";\nHEADING="sex";\nVALUES("zone")='), "names", F.lit(';\nVALUES("sex")="f","m";\nDATA=\n'), F.array_join(cells, " "), F.lit(";\n"))
    path = scratch(spark, "px")
    n.select(body.alias("value")).coalesce(1).write.text(path)
    return files.read_px(spark, path, "UTF-8").select("zone", "sex", "value")


@query("source_overpass", "select 'node' as type, cast(n_nationkey as bigint) as id, n_nationkey / 10.0::double as lat, n_name as name from nation")
def source_overpass(spark, d):
    el = table(spark, d, "nation").select(F.struct(F.lit("node").alias("type"), F.col("n_nationkey").alias("id"), (F.col("n_nationkey") / 10.0).alias("lat"), F.create_map(F.lit("name"), F.col("n_name")).alias("tags")).alias("e"))
    path = scratch(spark, "overpass")
    el.agg(F.to_json(F.struct(F.collect_list("e").alias("elements"))).alias("value")).write.text(path)
    return files.read_overpass(spark, path).select("type", "id", "lat", F.col("tags")["name"].alias("name"))


@query("source_many", "select cast(n_nationkey as integer) as k, case when n_regionkey < 3 then n_name end as name, case when n_regionkey > 1 then n_regionkey end as region from nation")
def source_many(spark, d):
    """Files with different keys, joined on the key."""
    n = table(spark, d, "nation")
    a = n.where("n_regionkey < 3").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("value"))
    b = n.where("n_regionkey > 1").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")).alias("value"))
    out = files.read_many(spark, [lines_to(spark, a, "k,name", "many"), lines_to(spark, b, "k,region", "many")], "k")
    return out.select(F.col("k").cast("int").alias("k"), "name", F.col("region").cast("int").alias("region"))


@query("sink_csv_quoted", "select cast(n_nationkey as integer) as k, n_name || '\"x, y' as name from nation")
def sink_csv_quoted(spark, d):
    """All fields quoted, written and read again."""
    path = scratch(spark, "quoted")
    files.write_csv(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat("n_name", F.lit('"x, y')).alias("name")), path, quote_all=True)
    return spark.read.option("header", True).option("escape", "\\").csv(path).select(F.col("k").cast("int").alias("k"), "name")


@query("sink_log", "select cast(n_regionkey as integer) as experiment_idx, n_name as best, cast(n_nationkey as double) as score from nation")
def sink_log(spark, d):
    """Rows appended run by run, the key first."""
    path, n = scratch(spark, "log"), table(spark, d, "nation").select(F.col("n_name").alias("best"), F.col("n_nationkey").cast("double").alias("score"), F.col("n_regionkey").cast("int").alias("experiment_idx"))
    for low, high in ((0, 2), (3, 4)):
        files.append_log(n.where(F.col("experiment_idx").between(low, high)), path)
    return spark.read.parquet(path)


@query("sink_csv_append", "select cast(n_nationkey as integer) as k, n_name as name from nation union all select cast(r_regionkey as integer), r_name from region")
def sink_csv_append(spark, d):
    """Two writes to one folder of CSV files, each with its header."""
    path = scratch(spark, "append")
    files.write_csv(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), path, mode="append")
    files.write_csv(table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), path, mode="append")
    return files.read_csv(spark, path, sep=",").select(F.col("k").cast("int").alias("k"), "name")


@query("sink_duplicates", "select cast(o_custkey as integer) as o_custkey, count(*) as n_rows from orders group by 1 having count(*) > 1")
def sink_duplicates(spark, d):
    """A report of duplicated keys, written only because there are some."""
    path = scratch(spark, "duplicates")
    if not files.write_duplicates(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], path):
        return spark.createDataFrame([], "o_custkey int, n_rows bigint")
    return files.read_csv(spark, path, sep=",").groupBy(F.col("o_custkey").cast("int").alias("o_custkey")).agg(F.count("*").alias("n_rows"))


@query("graph_files", f"select n.node, e.dst from {{gnodes}} n join {_EDGES} e on e.src = n.node")
def graph_files(spark, d):
    """A graph written and read again."""
    path = scratch(spark, "graph")
    files.write_graph(fx(spark, d, "gnodes"), street_edges(spark, d), path)
    nodes, edges = files.read_graph(spark, path)
    return nodes.join(edges, nodes["node"] == edges["src"]).select("node", "dst")


@query("cached_table", "select r_regionkey, r_name from region")
def cached_table(spark, d):
    """Built once; the second call reads what is there."""
    path = scratch(spark, "cache")
    files.cached(spark, path, lambda: table(spark, d, "region").select("r_regionkey", "r_name"))
    return files.cached(spark, path, lambda: table(spark, d, "region").where("false").select("r_regionkey", "r_name"))


@query("square_grid", "select cast(a * 6 + b as bigint) as cell, a * 500.0 - 1000.0 as minx, b * 500.0 - 1000.0 as miny from range(7) x(a), range(6) y(b)")
def square_grid(spark, d):
    return spatial.square_grid(spark, 0, 0, 1700, 1300).select("cell", "minx", "miny")


@query("lonlat_grid", "select cast(a * 23 + b as bigint) as id, round(2.1 + a * 50 / 111320.0, 8) as lon, round(41.4 + b * 50 / 110540.0, 8) as lat from range(23) x(a), range(23) y(b)")
def lonlat_grid(spark, d):
    return spatial.lonlat_grid(spark, 2.1, 41.4, 2.11, 41.41, 50).select("id", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


# ---------------------------------------------------------------- projections


@query("schema_projection", "select c_custkey as id, c_name as n_name_x, cast(c_acctbal as double) as n_acctbal_x, cast(c_nationkey as double) as region from customer")
def schema_projection(spark, d):
    """Cleaned headers, the first name that is there, wanted columns first, dropped keywords and empty columns, numbers, affixes."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("﻿id"), F.col("c_name").alias(" name"), F.col("c_acctbal").cast("string").alias("acctbal"), F.col("c_mktsegment").alias("Unemployment_rate"), F.lit(None).cast("int").alias("empty"), F.col("c_nationkey").cast("string").alias("region"))
    c = schema.drop_all_null(schema.drop_matching(schema.clean_headers(c), ["unemployment"]))
    key = schema.pick_column(c, ["station_id", "id"])
    c = schema.to_numeric(schema.keep_present(schema.order_columns(c, [key, "name", "name"]), [key, "name", "acctbal", "region", "gone"]), ["acctbal", "region"])
    return schema.affix(c, ["name", "acctbal"], "n_", "_x")


@query("weighted_variables", "select node, round((0.4::double * altitude + 0.6::double * norm_score), 6) as score, round(((0.4::double * altitude + 0.6::double * norm_score) - min(0.4::double * altitude + 0.6::double * norm_score) over ()) / (max(0.4::double * altitude + 0.6::double * norm_score) over () - min(0.4::double * altitude + 0.6::double * norm_score) over ()), 6) as norm from {gnodes}")
def weighted_variables(spark, d):
    """A scenario's weighted sum without its variables of weight 0, then as 0 to 1."""
    from ..operators.normalize import normalize

    weights = {"altitude": 0.4, "norm_score": 0.6, "absent": 0.0}
    n = fx(spark, d, "gnodes").withColumn("norm_score", F.col("norm_score").cast("double"))
    out = normalize(n.select("node", numeric.linear_score(weights).alias("score")), "score", "minmax", "norm")
    return out.select("node", F.round("score", 6).alias("score"), F.round("norm", 6).alias("norm"))


@query("age_sex_columns", "select column_name from (values ('10-19'), ('70+'), ('f'), ('m')) t(column_name)")
def age_sex_columns(spark, d):
    df = spark.createDataFrame([], "`10-19` int, `70+` int, f int, m int, age_x int, total int")
    return spark.createDataFrame([(c,) for c in schema.age_columns(df) + schema.sex_columns(df)], "column_name string")


# ---------------------------------------------------------------- filters, text, time


@query("sentinel_filter", "select c_custkey from customer where nullif(c_mktsegment, 'MACHINERY') is not null and c_nationkey not in (1, 2, 3)")
def sentinel_filter(spark, d):
    """Values other than a sentinel, and none of a list."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("m"))
    return c.where(F.col("m").isNotNull() & ~F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey")


@query("clip_to_box", "select id, x, y, greatest(x - 3000, 0) as v from {nodes} where x between 2000 and 7000 and y between 1000 and 9000")
def clip_to_box(spark, d):
    n = fx(spark, d, "nodes").withColumn("v", F.col("x") - 3000)
    return spatial.clip_to_box(n, 2000, 1000, 7000, 9000, ["v"])


@query("split_at_space", "select p_partkey, split_part(p_name, ' ', 1) as a, nullif(substr(p_name, strpos(p_name, ' ') + 1), '') as b from part")
def split_at_space(spark, d):
    parts = F.split("p_name", " ", 2)
    return table(spark, d, "part").select("p_partkey", parts[0].alias("a"), F.try_element_at(parts, F.lit(2)).alias("b"))


@query("value_patches", "select p_partkey, case when p_brand = 'Brand#3' then 'other' when p_size > 40 then 'big' else p_brand end as brand from part")
def value_patches(spark, d):
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_brand") == "Brand#3", "other").when(F.col("p_size") > 40, "big").otherwise(F.col("p_brand")).alias("brand"))


@query("line_names", "select p_partkey, coalesce(map {'Brand#1': 'Long-distance'}[p_brand], p_brand) as line, trim(regexp_replace(p_brand || ' L3 Metro x', '\\b(L\\d+|[Mm]etro)\\b', '', 'g')) as cleaned from part")
def line_names(spark, d):
    """A lookup that leaves what it doesn't know; names without line tokens."""
    from ..operators.transit import lookup_or_same

    p = table(spark, d, "part")
    return p.select("p_partkey", lookup_or_same(F.col("p_brand"), {"Brand#1": "Long-distance"}).alias("line"), F.trim(F.regexp_replace(F.concat("p_brand", F.lit(" L3 Metro x")), r"\b(L\d+|[Mm]etro)\b", "")).alias("cleaned"))


@query("serialised_values", "select n_nationkey, n_name as second, cast(2 as integer) as n, '{\"a\":' || n_nationkey || ',\"b\":1}' as json, 1.5::double as x, cast(n_nationkey as double) as y from nation")
def serialised_values(spark, d):
    """Lists and points from text, maps to text with ordered keys."""
    n = table(spark, d, "nation")
    items = text.parse_list(F.concat(F.lit("['L1', '"), "n_name", F.lit("']")))
    point = text.wkt_point(F.concat(F.lit("POINT (1.5 "), F.col("n_nationkey").cast("string"), F.lit(")")))
    return n.select("n_nationkey", items[1].alias("second"), F.size(items).alias("n"), text.map_json(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.col("n_nationkey").cast("int"))).alias("json"), point["x"].alias("x"), point["y"].alias("y"))


@query("latest_period", "select r_name, r_regionkey * 3 as value from region")
def latest_period(spark, d):
    t = table(spark, d, "region").select("r_name", F.col("r_regionkey").alias("2025-01"), (F.col("r_regionkey") * 3).alias("2026-01"))
    return t.select("r_name", F.col(f"`{text.latest_period_column(t.columns, ['r_name'])}`").alias("value"))


@query("scalar_clip", "select c_custkey, greatest(least(cast(c_acctbal as double), 5000), 0) as clipped, round(cast(c_custkey as double) / 7, 3) as rounded from customer")
def scalar_clip(spark, d):
    return table(spark, d, "customer").select("c_custkey", numeric.clip(F.col("c_acctbal").cast("double"), 0.0, 5000.0).alias("clipped"), F.round(F.col("c_custkey").cast("double") / 7, 3).alias("rounded"))


# ---------------------------------------------------------------- joins, sorting


@query("join_coalesce", "select coalesce(a.k, b.k) as k, coalesce(b.v, a.v) as v from (select s_nationkey as k, min(s_acctbal) as v from supplier where s_acctbal > 5000 group by 1) a full join (select c_nationkey as k, max(c_acctbal) as v from customer where c_acctbal > 9900 group by 1) b on a.k = b.k")
def join_coalesce(spark, d):
    """A full join whose values come from the right side where it has them."""
    a = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_acctbal").alias("a"))
    b = table(spark, d, "customer").where("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("b"))
    return a.join(b, "k", "full").select("k", F.coalesce("b", "a").alias("v"))


@query("usual_place", "select id, x, y from (select *, row_number() over (partition by id order by n desc, x, y) as k from (select user_id as id, cast(event_id % 3 as double) as x, cast(event_id % 2 as double) as y, count(*) as n from events group by all)) where k = 1")
def usual_place(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), (F.col("event_id") % 3).cast("double").alias("x"), (F.col("event_id") % 2).cast("double").alias("y"))
    return spatial.usual_place(e)


@query("top_then_ascending", "select c_custkey, c_acctbal, cast(row_number() over (order by c_acctbal, c_custkey desc) as integer) as place from (select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 15)")
def top_then_ascending(spark, d):
    """The top rows of a report, listed from the smallest on."""
    t = ranking.top(table(spark, d, "customer").select("c_custkey", "c_acctbal"), 15, [F.desc("c_acctbal"), F.asc("c_custkey")])
    return t.withColumn("place", F.row_number().over(Window.orderBy(F.asc("c_acctbal"), F.desc("c_custkey"))))  # fifteen rows


@query("nulls_first_in_group", "select s_suppkey, cast(row_number() over (partition by s_nationkey order by a nulls first, s_suppkey) as integer) as place from (select *, nullif(s_suppkey % 4, 0) as a from supplier)")
def nulls_first_in_group(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.expr("nullif(s_suppkey % 4, 0)").alias("a"))
    return s.select("s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.asc_nulls_first("a"), "s_suppkey")).alias("place"))


@query("cells_touching", "select cell from (select a * 20 + b as cell, a * 500.0 as minx, b * 500.0 as miny, a * 500.0 + 500 as maxx, b * 500.0 + 500 as maxy from range(20) x(a), range(20) y(b)) c where exists (select 1 from {buildings} z where c.minx <= z.maxx and c.maxx >= z.minx and c.miny <= z.maxy and c.maxy >= z.miny)")
def cells_touching(spark, d):
    cells = spatial.square_grid(spark, 0, 0, 10000, 10000, 500.0, 0.0)
    return spatial.cells_touching(cells, fx(spark, d, "buildings"), 500.0).select("cell")


@query("building_area", "select bid, round(case when bid % 5 = 0 then 32 * sin(2 * pi() / 64) * 100 else area end, 6) as area from {buildings}")
def building_area(spark, d):
    kind = F.when(F.col("bid") % 5 == 0, "Point").otherwise("Polygon")
    return fx(spark, d, "buildings").select("bid", F.round(spatial.building_area(kind, F.col("area")), 6).alias("area"))


# ---------------------------------------------------------------- graph, reports


_DIST = f"e as (select src, dst, min(weight) as w from {_EDGES} group by all), p(src, dst, d, h) as (select node, node, 0.0::double, 0 from {{gnodes}} union select p.src, e.dst, p.d + e.w, h + 1 from p join e on p.dst = e.src where h < 14), dist as (select src, dst, min(d) as d from p group by all)"
_SOL = "sol as (select distinct sol, node from {solutions} unpivot (node for k in (n0, n1, n2, n3)))"


@query("selected_distances", f"with recursive {_DIST}, {_SOL} select a.sol, a.node, b.node as other, x.d as d_out, y.d as d_in from sol a join sol b on a.sol = b.sol and a.node <> b.node left join dist x on x.src = a.node and x.dst = b.node left join dist y on y.src = b.node and y.dst = a.node")
def selected_distances(spark, d):
    return graph.selected_distances(street_distances(spark, d), chosen(spark, d))


@query("solution_paths", f"with recursive {_DIST}, {_SOL} select a.sol, src, dst, d from sol a join sol b on a.sol = b.sol and a.node <> b.node join dist on src = a.node and dst = b.node")
def solution_paths(spark, d):
    return graph.solution_paths(street_distances(spark, d), chosen(spark, d)).drop("path")


@query("mark_selected", f"with {_SOL} select node, cast(node in (select node from sol where sol = 3) as integer) as selected from {{gnodes}}")
def mark_selected(spark, d):
    return graph.mark_selected(fx(spark, d, "gnodes").select("node"), chosen(spark, d).where("sol = 3"))


@query("sampled_paths", None)
def sampled_paths(spark, d):
    """Shortest paths of a sampled, undirected street graph; tested against a plain loop."""
    worker_path(spark)
    return graph.sampled_paths(fx(spark, d, "gnodes"), street_edges(spark, d), 12).select("src", "dst", "d")


@query("dimension_means", None)
def dimension_means(spark, d):
    """The mean score of each dimension, the largest first."""
    names = ["accessibility", "activity", "socioeconomic", "topography"]
    f = score_stations(station_features(spark, d)).agg(*[F.avg(n).alias(n) for n in names])
    return f.unpivot([], names, "dimension", "mean").orderBy(F.desc("mean"), "dimension")


@query("income_by_zone", "select n_name, round(avg(c_acctbal), 4) as income from customer join nation on n_nationkey = c_nationkey where c_mktsegment = 'BUILDING' and n_name <> 'total' group by n_name")
def income_by_zone(spark, d):
    c, n = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), table(spark, d, "nation").where("n_name <> 'total'")
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.round(F.avg(F.col("c_acctbal").cast("double")), 4).alias("income"))


@query("solution_profile", f"with {_SOL}, m as (select avg(altitude / 12) as a, stddev_samp(altitude / 12) as sa, avg(norm_score) as b, stddev_samp(norm_score) as sb from sol join {{gnodes}} using (node) where sol = 3) select 'altitude' as label, round(a, 6) as mean, round(greatest(0, a - sa), 6) as low, round(least(1, a + sa), 6) as high from m union all select 'norm_score', round(b, 6), round(greatest(0, b - sb), 6), round(least(1, b + sb), 6) from m")
def solution_profile(spark, d):
    """Mean and deviation band of a solution's variables, clamped to 0 and 1, labels in order."""
    n = fx(spark, d, "gnodes").select("node", (F.col("altitude") / 12).alias("altitude"), F.col("norm_score").cast("double").alias("norm_score"))
    picked = n.join(chosen(spark, d).where("sol = 3"), "node")
    rows = F.array(*[F.struct(F.lit(c).alias("label"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")) for c in ("altitude", "norm_score")])
    r = picked.agg(rows.alias("r")).select(F.inline("r"))
    return r.select("label", F.round("mean", 6).alias("mean"), F.round(numeric.clip(F.col("mean") - F.col("sd"), 0.0, 1.0), 6).alias("low"), F.round(numeric.clip(F.col("mean") + F.col("sd"), 0.0, 1.0), 6).alias("high")).orderBy("label")


@query("layer_stats", "select feature, round(lo, 6) as lo, round(case when hi = lo then lo + 1e-9 else hi end, 6) as hi from (select min(altitude) as a, max(altitude) as b, min(norm_score) as c, max(norm_score) as d from {gnodes}), lateral (values ('altitude', a, b), ('norm_score', c, d)) t(feature, lo, hi)")
def layer_stats(spark, d):
    """The range of each variable with a weight."""
    weights = {"altitude": 0.5, "norm_score": 0.5, "gone": 0.0}
    use = [k for k, w in weights.items() if w]
    one = fx(spark, d, "gnodes").agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi")) for c in use]).alias("r")).select(F.inline("r"))
    return one.select("feature", F.round("lo", 6).alias("lo"), F.round(F.when(F.col("hi") == F.col("lo"), F.col("lo") + 1e-9).otherwise(F.col("hi")), 6).alias("hi"))


@query("solution_card", f"with recursive {_DIST}, {_SOL}, trip as (select x.src, x.dst, x.d + y.d as rt from dist x join dist y on x.src = y.dst and x.dst = y.src), acc as (select sum(m) as a from (select n.node, min(rt) as m from {{gnodes}} n, sol t, trip where t.sol = 3 and n.node not in (select node from sol where sol = 3) and trip.src = n.node and trip.dst = t.node group by n.node)), dsp as (select sum(d) as g from sol a join sol b on a.sol = b.sol join dist on src = a.node and dst = b.node where a.sol = 3) select round(1 - (g - 50) / 350, 6) as dispersion, round(1 - (a - 100) / 900, 6) as accessibility, round(0.3 * (1 - (g - 50) / 350) + 0.7 * (1 - (a - 100) / 900), 6) as composite, round((select sum(norm_score) from sol join {{gnodes}} using (node) where sol = 3), 6) as node_score from dsp, acc")
def solution_card(spark, d):
    """One solution's inverted dispersion and accessibility, their mix, and its node score."""
    one = chosen(spark, d).where("sol = 3")
    n = fx(spark, d, "gnodes").withColumn("norm_score", F.col("norm_score").cast("double"))
    f = optimize.fitness(one, n, street_distances(spark, d), 0.3, (50, 400), (100, 1000))
    inv = lambda c, lo, hi: F.round(F.lit(1.0) - numeric.scale(F.col(c), F.lit(float(lo)), F.lit(float(hi))), 6)
    return f.select(inv("dispersion", 50, 400).alias("dispersion"), inv("accessibility", 100, 1000).alias("accessibility"), F.round("graph_score", 6).alias("composite"), F.round("node_score", 6).alias("node_score"))
