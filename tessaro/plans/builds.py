"""The composite builds: whole tables from several sources, each as one plan, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, numeric, text
from ..operators import graph, relational, spatial, stats, transit
from ..operators.schema import drop_matching, order_columns
from ..session import ensure_checkpoint, table, worker_path
from ..sources import geometry
from .catalogue import POI, _EDGES, fx, lane_sql, poi_flags, query, street_edges, sub

# ---------------------------------------------------------------- station master

#: The preferred first columns of the station master.
MASTER_FIRST = ("id census_section neighborhood bus_count_300m bus_unique_lines_300m bus_nearest_m metro_count_500m metro_unique_lines_500m metro_nearest_m poi_count_300m bike_lane_len_300m bike_lane_nearest_m mean_altitude_150m mean_slope_150m").split()


def buffer_block(stations: DataFrame, features: DataFrame, radius: float, prefix: str, lines: bool = True) -> DataFrame:
    """(id, <prefix>_count_<r>m, <prefix>_unique_lines_<r>m) of the features within a radius."""
    r = int(radius)
    aggs = [F.count("*").alias(f"{prefix}_count_{r}m")] + ([F.count_distinct("line").alias(f"{prefix}_unique_lines_{r}m")] if lines else [])
    names = [f"{prefix}_count_{r}m"] + ([f"{prefix}_unique_lines_{r}m"] if lines else [])
    return spatial.aggregate_within(stations, features, radius, aggs, names)


def nearest_block(stations: DataFrame, features: DataFrame, prefix: str, cell: float) -> DataFrame:
    """(id, <prefix>_nearest_m)."""
    return spatial.nearest(stations, features.select("fid", "fx", "fy"), cell).select("id", F.col("dist").alias(f"{prefix}_nearest_m"))


def station_master(stations: DataFrame, sections: DataFrame, hoods: DataFrame, section_tables: list[DataFrame], hood_table: DataFrame, layers: dict[str, tuple[DataFrame, float, bool]], lanes: DataFrame, grid: DataFrame, cell: float) -> DataFrame:
    """One row per station (id, x, y): zones, socio-economic tables of the zones, proximity and terrain.

    sections, hoods: zid, minx..maxy and a name in ``name``; the nearest zone where
    none holds the station. section_tables have census_section, hood_table has
    neighborhood; keys are normalised, duplicates collapsed. layers: prefix ->
    (features, radius, has lines). grid: fid, fx, fy, altitude, slope. Every block
    is an aggregate per station, joined by id.
    """
    zone = spatial.zone_with_fallback(stations, sections.drop("name"), cell, 4 * cell).select("id", "zid")
    out = stations.join(zone, "id").join(sections.select("zid", F.col("name").alias("census_section")), "zid", "left").drop("zid")
    zone = spatial.zone_with_fallback(stations, hoods.drop("name"), cell, 4 * cell).select("id", "zid")
    out = out.join(zone, "id").join(hoods.select("zid", F.col("name").alias("neighborhood")), "zid", "left").drop("zid")
    for t in section_tables:
        out = relational.left_section_join(out, t, "census_section", text.normalize_section)
    named = hood_table.withColumn("_k", text.normalize_text(F.col("neighborhood"))).drop("neighborhood").where("_k is not null")
    keep = [c for c in named.columns if "unemployment" in c.lower()]
    out = drop_matching(out, ["unemployment"]).withColumn("_k", text.normalize_text(F.col("neighborhood")))
    out = out.join(relational.collapse(named.select("_k", *keep), "_k"), "_k", "left").drop("_k")
    for prefix, (features, radius, lines) in layers.items():
        out = out.join(buffer_block(stations, features, radius, prefix, lines), "id")
        if lines:
            out = out.join(nearest_block(stations, features, prefix, radius), "id")
    out = out.join(spatial.line_length_within(stations, lanes, 300.0).select("id", F.col("length").alias("bike_lane_len_300m")), "id")
    out = out.join(spatial.nearest_segment(stations, lanes, 300.0).withColumnRenamed("dist", "bike_lane_nearest_m"), "id")
    means = spatial.aggregate_within(stations, grid, 150.0, [F.avg("altitude").alias("mean_altitude_150m"), F.avg("slope").alias("mean_slope_150m")])
    return order_columns(out.join(means, "id"), MASTER_FIRST)


_NEAR = "(s.x - p.fx) ** 2 + (s.y - p.fy) ** 2"


def _layer_sql(name: str, word: str, radius: int, lines: bool) -> str:
    where = f"contains(category, '{word}')" if word else "true"
    more = f", count(distinct p.line) as {name}_unique_lines_{radius}m" if lines else ""
    return f"{name} as (select s.id, count(p.fid) as {name}_count_{radius}m{more} from {{stations}} s left join (select * from {{features}} where {where}) p on {_NEAR} <= {float(radius) ** 2} group by s.id)"


def lane_near_sql(points: str) -> str:
    """ln (id, d): the distance of each point to the nearest lane, over all pairs."""
    t = "greatest(0, least(1, coalesce(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif((x2 - x1) ** 2 + (y2 - y1) ** 2, 0), 0)))"
    return f"ln as (select id, min(sqrt((x1 + t * (x2 - x1) - x) ** 2 + (y1 + t * (y2 - y1) - y) ** 2)) as d from (select *, {t} as t from {points}, {sub('lanes')}) group by id)"


_MASTER_SQL = f"""with z as (select id, zid from (select s.id, z.zid, row_number() over (partition by s.id order by case when x >= minx and x < maxx and y >= miny and y < maxy then -1.0 else greatest(minx - x, 0.0, x - maxx) ** 2 + greatest(miny - y, 0.0, y - maxy) ** 2 end, z.zid) as k from {{stations}} s, (select * from {{zones}} where v >= 30) z) where k = 1),
    inc as (select c_nationkey as zid, avg(c_acctbal) as income from customer group by 1), edu as (select s_nationkey as zid, avg(s_acctbal) as education from supplier group by 1),
    hood as (select n_regionkey as r, avg(n_nationkey) as unemployment_percentage from nation group by 1),
    {_layer_sql('bus', 'STANDARD', 300, True)}, {_layer_sql('metro', 'LARGE', 500, True)}, {_layer_sql('poi', '', 300, False)},
    nb as (select s.id, min(sqrt({_NEAR})) as d from {{stations}} s, {{features}} p where contains(category, 'STANDARD') group by s.id), nm as (select s.id, min(sqrt({_NEAR})) as d from {{stations}} s, {{features}} p where contains(category, 'LARGE') group by s.id),
    {lane_near_sql('{stations}')},
    grid as (select s.id, avg(p.size) as a, avg(p.size * 2) as b from {{stations}} s left join {{features}} p on {_NEAR} <= 22500.0 group by s.id)
    select s.id, s.x, s.y, lpad(cast(z.zid as varchar), 10, '0') as census_section, r_name as neighborhood, round(income, 3) as income, round(education, 3) as education, round(unemployment_percentage, 3) as unemployment_percentage,
    bus_count_300m, bus_unique_lines_300m, round(nb.d, 3) as bus_nearest_m, metro_count_500m, metro_unique_lines_500m, round(nm.d, 3) as metro_nearest_m, poi_count_300m, round(l.length, 3) as bike_lane_len_300m, round(ln.d, 3) as bike_lane_nearest_m, round(a, 3) as mean_altitude_150m, round(b, 3) as mean_slope_150m
    from {{stations}} s join z using (id) join nation on n_nationkey = zid join region on r_regionkey = n_regionkey left join inc on inc.zid = z.zid left join edu on edu.zid = z.zid left join hood on hood.r = n_regionkey
    join bus using (id) join metro using (id) join poi using (id) left join nb using (id) left join nm using (id) left join ln using (id) join {lane_sql('{stations}', 300.0)} l using (id) join grid using (id)"""


@query("station_master", _MASTER_SQL)
def station_master_query(spark, d):
    """The station master on the stand-in tables: zones with gaps, keys in several spellings, three point layers, lanes, terrain."""
    worker_path(spark)
    ensure_checkpoint(spark)
    zones = fx(spark, d, "zones").where("v >= 30")
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    hoods = zones.drop("name").join(nation.select(F.col("n_nationkey").alias("zid"), "n_regionkey"), "zid").join(region.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("name")), "n_regionkey").drop("n_regionkey")
    sections = zones.withColumn("name", F.concat(F.col("zid").cast("string"), F.lit(".0")))
    income = table(spark, d, "customer").select(F.concat(F.col("c_nationkey").cast("string"), F.lit(",0")).alias("census_section"), F.col("c_acctbal").cast("double").alias("income"))
    education = table(spark, d, "supplier").select(F.lpad(F.col("s_nationkey").cast("string"), 10, "0").alias("census_section"), F.col("s_acctbal").cast("double").alias("education"))
    unemployment = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.concat(F.lit("  "), F.initcap("r_name"), F.lit(" ")).alias("neighborhood"), F.col("n_nationkey").cast("double").alias("unemployment_percentage"), F.lit("x").alias("other"))
    f = fx(spark, d, "features")
    layers = {"bus": (f.where("contains(category, 'STANDARD')"), 300.0, True), "metro": (f.where("contains(category, 'LARGE')"), 500.0, True), "poi": (f, 300.0, False)}
    grid = f.select("fid", "fx", "fy", F.col("size").cast("double").alias("altitude"), (F.col("size") * 2.0).alias("slope"))
    out = station_master(fx(spark, d, "stations"), sections, hoods, [income, education], unemployment, layers, fx(spark, d, "lanes"), grid, 2000.0)
    out = out.withColumn("census_section", text.normalize_section(F.col("census_section")))
    return out.withColumns({c: F.round(c, 3) for c in ("income", "education", "unemployment_percentage", "bus_nearest_m", "metro_nearest_m", "bike_lane_len_300m", "bike_lane_nearest_m", "mean_altitude_150m", "mean_slope_150m")})


@query("nearest_lane", f"with {lane_near_sql('{stations}')} select id, round(d, 4) as dist from ln")
def nearest_lane(spark, d):
    ensure_checkpoint(spark)
    return spatial.nearest_segment(fx(spark, d, "stations"), fx(spark, d, "lanes"), 50.0).select("id", F.round("dist", 4).alias("dist"))


# ---------------------------------------------------------------- node attributes


def node_attributes(nodes: DataFrame, modes: dict[str, DataFrame], lanes: DataFrame, pois: DataFrame, categories: list[str], zones: DataFrame, means: list[str], buildings: DataFrame, counts: list[str], radius: float, cell: float) -> DataFrame:
    """One row per node (id, x, y) with all attributes within its buffer.

    <mode>_lines; has_bike_lane and bike_lane_kms; a count per category flag, their
    total and entropy; area-weighted means of zone columns over the square around
    the node; zone counts split over buildings by area (bid, zone, area, minx..maxy and the
    counts) and summed by the share of each building inside the square.
    """
    at = F.struct("x", "y").alias("id")
    spots = nodes.select("x", "y").distinct().select(at, "x", "y")  # nodes of one place share all attributes
    out = spots.select("id")
    for mode, features in modes.items():
        lines = features.select("fx", "fy", "line").distinct()
        out = out.join(spatial.aggregate_within(spots, lines, radius, [F.count_distinct("line").alias(f"{mode}_lines")], [f"{mode}_lines"]), "id")
    lane = spatial.line_length_within(spots, lanes, radius)
    out = out.join(lane.select("id", F.col("any_line").alias("has_bike_lane"), (F.col("length") / 1000).alias("bike_lane_kms")), "id")
    sums = [F.sum(c).cast("bigint").alias(f"n_{c}") for c in categories]
    here = pois.groupBy("fx", "fy").agg(*[F.sum(c).alias(c) for c in categories])
    near = spatial.aggregate_within(spots, here, radius, sums, [f"n_{c}" for c in categories])
    each = [F.col(f"n_{c}") for c in categories]
    out = out.join(near.withColumns({"pois_total": numeric.row_sum(each), "pois_entropy": numeric.entropy(each)}), "id")
    box = spots.select("id", (F.col("x") - radius).alias("minx"), (F.col("y") - radius).alias("miny"), (F.col("x") + radius).alias("maxx"), (F.col("y") + radius).alias("maxy"))
    met = spatial.overlap_pairs(box, zones.withColumnRenamed("zid", "bid"), cell)
    out = out.join(spatial.area_weighted_mean(met, means), "id", "left")
    for c in counts:
        buildings = spatial.dasymetric(buildings, "zone", c, "area", f"_{c}")
    alike = buildings.groupBy("minx", "miny", "maxx", "maxy", F.col("area").alias("whole")).agg(*[F.sum(f"_{c}").alias(f"_{c}") for c in counts])
    inside = spatial.overlap_pairs(box, alike, radius)
    got = inside.groupBy("id").agg(*[F.sum(F.col(f"_{c}") * F.col("area") / F.col("whole")).alias(c) for c in counts])
    out = out.join(got, "id", "left").fillna(0.0, counts).withColumnRenamed("id", "_at")
    return nodes.select("id", at.alias("_at")).join(out, "_at", "left").drop("_at")


_FLAGS = ", ".join(f"cast(sum(case when {' or '.join(f'contains(category, {w!r})' for w in ws)} then 1 else 0 end) as bigint) as n_{k}" for k, ws in POI.items())
_N = [f"n_{k}" for k in POI]
_NODES_SQL = f"""with box as (select id, x - 300 as minx, y - 300 as miny, x + 300 as maxx, y + 300 as maxy from {{nodes}}),
    ln as (select s.id, count(distinct case when contains(category, 'STANDARD') then line end) as bus_lines, count(distinct case when contains(category, 'LARGE') then line end) as metro_lines, {_FLAGS} from {{nodes}} s left join {{features}} p on {_NEAR} <= 90000.0 group by s.id),
    tot as (select *, {' + '.join(_N)} as t from ln),
    zm as (select a.id, sum(b.v * area) / sum(area) as v from (select a.id, b.v, greatest(0.0, least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * greatest(0.0, least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) as area from box a, {{zones}} b) as a(id, v, area), (select 1) q(one), lateral (select a.v as v) b where area > 0 group by a.id),
    sh as (select bid, minx, miny, maxx, maxy, area, (100 + zone % 37) * area / sum(area) over (partition by zone) as people, (10 + zone % 7) * area / sum(area) over (partition by zone) as jobless from {{buildings}}),
    bn as (select a.id, sum(people * part) as people, sum(jobless * part) as jobless from (select a.id, people, jobless, greatest(0.0, least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * greatest(0.0, least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) / area as part from box a join sh b on a.minx < b.maxx and b.minx < a.maxx and a.miny < b.maxy and b.miny < a.maxy) a group by a.id)
    select t.id, bus_lines, metro_lines, l.any_line as has_bike_lane, round(l.length / 1000, 6) as bike_lane_kms, {', '.join(_N)}, t as pois_total,
    round({' + '.join(f'case when {c} > 0 then -({c} * 1.0 / t) * log2({c} * 1.0 / t) else 0 end' for c in _N)}, 2) as pois_entropy, round(v, 6) as v, round(coalesce(people, 0), 4) as people, round(coalesce(jobless, 0), 4) as jobless
    from tot t join {lane_sql('{nodes}', 300.0)} l using (id) left join zm using (id) left join bn using (id)"""


@query("node_attributes", _NODES_SQL)
def node_attributes_query(spark, d):
    f = fx(spark, d, "features")
    modes = {"bus": f.where("contains(category, 'STANDARD')"), "metro": f.where("contains(category, 'LARGE')")}
    b = fx(spark, d, "buildings").withColumns({"people": 100 + F.col("zone") % 37, "jobless": 10 + F.col("zone") % 7})
    pois = poi_flags(f).withColumnsRenamed({f"is_{k}": k for k in POI})
    out = node_attributes(fx(spark, d, "nodes"), modes, fx(spark, d, "lanes"), pois, list(POI), fx(spark, d, "zones").drop("name"), ["v"], b, ["people", "jobless"], 300.0, 2000.0)
    return out.withColumns({"bike_lane_kms": F.round("bike_lane_kms", 6), "v": F.round("v", 6), "people": F.round("people", 4), "jobless": F.round("jobless", 4)})


# ---------------------------------------------------------------- graph preparation

_XY = "cast((n_nationkey * 3571) % 1000 as double) as x, cast((n_nationkey * 9173) % 1000 as double) as y"
_CUT = "(select src, dst, weight from {edges1} where weight > 6 union all select src, dst, weight from {edges2} where weight < 7)"


def _street(spark, d) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, d, "nation").selectExpr("cast(n_nationkey as bigint) as node", *_XY.split(", "))
    return nodes, fx(spark, d, "edges1").where("weight > 6").unionByName(fx(spark, d, "edges2").where("weight < 7")).select("src", "dst", "weight")


_CLOSE_SQL = f"""n as (select cast(n_nationkey as bigint) as node, {_XY} from nation), e as (select distinct src, dst, weight from {_CUT}),
    bad as (select node, o.n is not null as leaves from n left join (select src as node, count(*) as n from e group by 1) o using (node) left join (select dst as node, count(*) as n from e group by 1) i using (node) where (o.n is null) <> (i.n is null)),
    near as (select b.node, b.leaves, m.node as other, sqrt((m.x - p.x) ** 2 + (m.y - p.y) ** 2) as dist, row_number() over (partition by b.node order by (m.x - p.x) ** 2 + (m.y - p.y) ** 2, m.node) as k from bad b join n p using (node) join n m on m.node <> b.node),
    fresh as (select case when leaves then other else node end as src, case when leaves then node else other end as dst, dist as weight from near where k = 1)"""


@query("closest_edges", f"with {_CLOSE_SQL} select src, dst, round(weight, 6) as weight from fresh")
def closest_edges(spark, d):
    """The missing direction of one-way nodes, to or from their closest node."""
    ensure_checkpoint(spark)
    nodes, edges = _street(spark, d)
    return graph.closest_edges(nodes, edges, 100.0).withColumn("weight", F.round("weight", 6))


@query(
    "graph_preparation",
    f"""with recursive {_CLOSE_SQL}, every as (select src, dst, weight, 'old' as edge_type from e union all select src, dst, weight, 'new' from fresh),
    r(a, b) as (select node, node from n union select r.a, every.dst from r join every on r.b = every.src), comp as (select x.a as node, min(x.b) as c from r x join r y on x.a = y.b and x.b = y.a group by x.a),
    back as (select distinct v.dst as src, v.src as dst, v.weight from every v join comp a on a.node = v.src join comp b on b.node = v.dst where a.c <> b.c and not exists (select 1 from every w where w.src = v.dst and w.dst = v.src))
    select src, dst, round(weight, 6) as weight, edge_type, false as reversed from (select src, dst, weight, min(edge_type) as edge_type from every group by all) union all select src, dst, round(weight, 6), 'old', true from back""",
)
def graph_preparation(spark, d):
    """Dead ends opened, components joined by reversed edges."""
    ensure_checkpoint(spark)
    nodes, edges = _street(spark, d)
    return graph.prepare(nodes, edges, 100.0).withColumn("weight", F.round("weight", 6))


@query(
    "join_components",
    f"""with recursive e as (select distinct src, dst, weight from {_CUT}), r(a, b) as (select node, node from {{gnodes}} union select r.a, e.dst from r join e on r.b = e.src),
    comp as (select x.a as node, min(x.b) as c from r x join r y on x.a = y.b and x.b = y.a group by x.a),
    back as (select distinct v.dst as src, v.src as dst, v.weight from e v join comp a on a.node = v.src join comp b on b.node = v.dst where a.c <> b.c and not exists (select 1 from e w where w.src = v.dst and w.dst = v.src))
    select src, dst, weight, false as reversed from {_CUT} union all select src, dst, weight, true from back""",
)
def join_components(spark, d):
    ensure_checkpoint(spark)
    nodes, edges = _street(spark, d)
    return graph.join_components(edges, graph.strong_components(nodes, edges))


# ---------------------------------------------------------------- unemployment

_RATES = "select s_suppkey, case when s_acctbal < 0 then 'Districte' when s_nationkey = 24 then '-' else ' Barri ' end as kind, '  ' || n_name || case when s_nationkey = 24 then ' (Barri)' else '' end as area, s_acctbal as r from supplier join nation on n_nationkey = s_nationkey"


def unemployment_rates(raw: DataFrame, area: str, kind: str) -> DataFrame:
    """(neighborhood, unemployment_percentage) of a wide table: the newest period of the rows that are neighbourhoods.

    A kind that is a dash is read from the parentheses of the name. Names are
    normalised; of several rows of a name the mean is taken.
    """
    newest = text.latest_period_column(raw.columns, [area, kind])
    k = F.lower(F.trim(F.when(F.trim(kind) == "-", text.in_parens(F.col(area))).otherwise(F.col(kind))))
    rows = raw.where(F.coalesce(k.contains("barri"), F.lit(False))).select(text.normalize_text(text.without_parens(F.col(area))).alias("neighborhood"), text.decimal_comma(F.col(newest)).alias("unemployment_percentage"))
    return relational.collapse(rows.where("neighborhood is not null"), "neighborhood")


def _raw_rates(spark, d) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    t = s.join(n, s["s_nationkey"] == n["n_nationkey"])
    kind = F.when(F.col("s_acctbal") < 0, "Districte").when(F.col("s_nationkey") == 24, "-").otherwise(" Barri ")
    area = F.concat(F.lit("  "), "n_name", F.when(F.col("s_nationkey") == 24, " (Barri)").otherwise(""))
    comma = F.concat(F.lit('"'), F.replace(F.round(F.col("s_acctbal").cast("double"), 2).cast("string"), F.lit("."), F.lit(",")), F.lit('"'))
    return t.select(area.alias("Territori"), kind.alias("Tipus de territori"), F.lit("1,0").alias("31 des 2025"), comma.alias("31 gen 2026"))


@query("unemployment_rebuild", f"select lower(trim(replace(area, ' (Barri)', ''))) as neighborhood, round(avg(r), 4) as unemployment_percentage from ({_RATES}) where lower(kind) like '%barri%' or kind = '-' group by 1")
def unemployment_rebuild(spark, d):
    worker_path(spark)
    return unemployment_rates(_raw_rates(spark, d), "Territori", "Tipus de territori").withColumn("unemployment_percentage", F.round("unemployment_percentage", 4))


_AREAS = "(select cast(c_custkey as bigint) as id, (c_custkey * 3571) % 10000 - 40.0 as minx, (c_custkey * 9173) % 10000 - 40.0 as miny, (c_custkey * 3571) % 10000 + 40.0 as maxx, (c_custkey * 9173) % 10000 + 40.0 as maxy, 50 + c_custkey % 90 as population from customer)"
_NEED = "greatest(" + ", ".join(f"sqrt({a} ** 2 + {b} ** 2)" for a in ("greatest(z.minx - a.minx, 0.0)", "greatest(a.maxx - z.maxx, 0.0)") for b in ("greatest(z.miny - a.miny, 0.0)", "greatest(a.maxy - z.maxy, 0.0)")) + ")"
_STEPS = spatial.buffer_steps()
_STEP = "case when need = 0 then 0 " + " ".join(f"when need <= {r} then {i + 1}" for i, r in enumerate(_STEPS)) + " end"


def _areas(spark, d) -> DataFrame:
    x, y = (F.col("c_custkey") * 3571) % 10000, (F.col("c_custkey") * 9173) % 10000
    return table(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("id"), (x - 40.0).alias("minx"), (y - 40.0).alias("miny"), (x + 40.0).alias("maxx"), (y + 40.0).alias("maxy"), (50 + F.col("c_custkey") % 90).alias("population"))


_ASSIGN = f"(select id, zid, step from (select *, row_number() over (partition by id order by step, need, zid) as k from (select a.id, z.zid, {_NEED} as need, {_STEP.replace('need', _NEED)} as step from {_AREAS} a, (select * from {{zones}} where v >= 30) z) where step is not null) where k = 1)"


@query("growing_buffers", f"select a.id, zid, step from {_AREAS} a left join {_ASSIGN} t using (id)")
def growing_buffers(spark, d):
    """Areas that no zone holds go to the zone whose buffer holds them at the earliest step."""
    return spatial.assign_with_growing_buffers(_areas(spark, d).drop("population"), fx(spark, d, "zones").where("v >= 30"), 2000.0)


@query("unemployment_areal", f"select zid, cast(sum(population) as bigint) as population, any_value(v) as unemployment_percentage, round(any_value(v) * sum(population) / 100, 4) as unemployment from {_AREAS} join {_ASSIGN} t using (id) join (select zid, v from {{zones}}) z using (zid) where population not in (50, 51, 52) group by zid")
def unemployment_areal(spark, d):
    """Areas to zones by growing buffers, their population summed, rates to absolute numbers."""
    a = _areas(spark, d).where(~F.col("population").isin(50, 51, 52))
    got = spatial.assign_with_growing_buffers(a.drop("population"), fx(spark, d, "zones").where("v >= 30"), 2000.0).where("zid is not null")
    pop = got.join(a.select("id", "population"), "id").groupBy("zid").agg(F.sum("population").alias("population"))
    z = fx(spark, d, "zones").select("zid", F.col("v").alias("unemployment_percentage"))
    return pop.join(z, "zid").withColumn("unemployment", F.round(numeric.pct_to_absolute(F.col("unemployment_percentage"), F.col("population")), 4))


# ---------------------------------------------------------------- transit

#: Fixed values of the stand-in: brands whose lines go by another name.
LINE_NAMES = {"Brand#1": "Long-distance", "Brand#2": "Long-distance"}


def elements(spark, d) -> DataFrame:
    """Map elements from the tables: parts are stops and entrances, brands are routes and areas that list them."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("id"), "p_brand", "p_type", F.col("p_size").cast("int").alias("size"))
    kind = F.when(F.col("p_type").contains("STANDARD"), F.create_map(F.lit("highway"), F.lit("bus_stop"), F.lit("route_ref"), F.concat_ws("  ", "p_brand", F.col("size").cast("string")), F.lit("name"), F.concat(F.lit("stop "), F.col("size").cast("string"))))
    kind = kind.when(F.col("p_type").contains("PROMO"), F.create_map(F.lit("railway"), F.lit("subway_entrance"), F.lit("name"), F.concat(F.lit("door "), F.col("id").cast("string"))))
    kind = kind.otherwise(F.create_map(F.lit("name"), F.concat(F.lit(" Area "), F.col("size").cast("string"))))
    member = "array<struct<type:string,ref:bigint,role:string>>"
    nodes = p.select(F.lit("node").alias("type"), "id", (F.col("id") % 100 / 100.0).alias("lat"), (F.col("id") % 90 / 90.0).alias("lon"), kind.alias("tags"), F.lit(None).cast(member).alias("members"))
    listed = F.collect_list(F.struct(F.lit("node").alias("type"), F.col("id").alias("ref"), F.lit("stop").alias("role")))
    none = F.lit(None).cast("double")
    routes = p.groupBy("p_brand").agg(listed.alias("members"), F.min("id").alias("k")).select(
        F.lit("relation").alias("type"), (F.col("k") + 10_000_000).alias("id"), none.alias("lat"), none.alias("lon"), F.create_map(F.lit("route"), F.lit("subway"), F.lit("ref"), "p_brand").alias("tags"), "members")
    areas = p.groupBy("size").agg(listed.alias("members")).select(
        F.lit("relation").alias("type"), (F.col("size") + 20_000_000).cast("bigint").alias("id"), none.alias("lat"), none.alias("lon"), F.create_map(F.lit("name"), F.concat(F.lit("Area "), F.col("size").cast("string"), F.lit(" (L3)"))).alias("tags"), "members")
    return nodes.unionByName(routes).unionByName(areas)


def stop_areas(el: DataFrame) -> DataFrame:
    """Without the relations that are routes."""
    return el.where("type <> 'relation' or tags['route'] is null")


@query("bus_stops", "select cast(p_partkey as bigint) as stop_id, 'stop ' || p_size as stop_name, line, p_partkey % 100 / 100.0::double as lat, p_partkey % 90 / 90.0::double as lon from part, unnest([p_brand, cast(p_size as varchar)]) as t(line) where contains(p_type, 'STANDARD')")
def bus_stops(spark, d):
    return transit.bus_stops(elements(spark, d))


_STOPS = "select min(line_id) as line_id, line, stop_name, lat, lon from (select 10000000 + min(p_partkey) over (partition by p_brand) as line_id, case when p_brand in ('Brand#1', 'Brand#2') then 'Long-distance' else p_brand end as line, case when contains(p_type, 'STANDARD') then 'stop ' || p_size when contains(p_type, 'PROMO') then 'door ' || p_partkey else ' Area ' || p_size end as stop_name, p_partkey % 100 / 100.0::double as lat, p_partkey % 90 / 90.0::double as lon from part) group by line, stop_name, lat, lon"


@query("route_stops", f"select cast(line_id as bigint) as line_id, line, stop_name, lat, lon from ({_STOPS})")
def route_stops(spark, d):
    return transit.route_stops(elements(spark, d), ["subway", "tram"], LINE_NAMES)


@query("stop_entrances", "select cast(p_partkey as bigint) as entrance_id, 'door ' || p_partkey as entrance_name, 'Area ' || p_size || ' (L3)' as stop_name, p_partkey % 100 / 100.0::double as lat, p_partkey % 90 / 90.0::double as lon from part where contains(p_type, 'PROMO') and not contains(p_type, 'STANDARD')")
def stop_entrances(spark, d):
    return transit.entrances(stop_areas(elements(spark, d)))


@query(
    "transit_build",
    f"""with stops as ({_STOPS}), doors as (select p_partkey as entrance_id, 'door ' || p_partkey as entrance_name, 'Area ' || p_size || ' (L3)' as stop_name, p_partkey % 100 / 100.0::double as lat, p_partkey % 90 / 90.0::double as lon from part where contains(p_type, 'PROMO') and not contains(p_type, 'STANDARD')),
    m as (select coalesce(d.stop_name, trim(s.stop_name)) as name, line, entrance_name, entrance_id, coalesce(d.lat, s.lat) as lat, coalesce(d.lon, s.lon) as lon from doors d full join stops s on trim(s.stop_name) = d.stop_name),
    c as (select trim(replace(name, ' (L3)', '')) as stop_name, case when trim(replace(name, ' (L3)', '')) = 'Area 7' then 'L1' when line is null then 'L3' else line end as line, entrance_name, entrance_id, lat, lon from m),
    w as (select * from (select *, row_number() over (partition by line, stop_name, entrance_name order by entrance_id, lat, lon) as k from c where entrance_id is not null) where k = 1),
    o as (select * from (select *, row_number() over (partition by line, stop_name order by lat, lon) as k from c where entrance_id is null) where k = 1),
    every as (select * from w union all select * from o where not exists (select 1 from w where w.line = o.line and w.stop_name = o.stop_name))
    select stop_name, coalesce(entrance_name, stop_name) as entrance_name, lat, lon, array_to_string(list_sort(list_distinct(list(line))), ',') as line, cast(min(entrance_id) as bigint) as entrance_id from every group by all""".replace("group by all", "group by 1, 2, 3, 4"),
)
def transit_build(spark, d):
    """Stops, lines and entrances of one network from map elements."""
    el = elements(spark, d)
    stops = transit.route_stops(el, ["subway", "tram"], LINE_NAMES)
    patches = [(F.col("stop_name") == "Area 7", "line", F.lit("L1"))]
    return transit.merge_entrances(stops, transit.entrances(stop_areas(el)), patches).withColumn("line", F.array_join("line", ","))


# ---------------------------------------------------------------- places

_KAPPA, _AS = 0.081819191042815791, (0.0008377318206244698, 7.608527773572307e-07, 1.197645503329453e-09)


def utm_sql(lon: str, lat: str, source: str, columns: str) -> str:
    """columns, x, y of the places of a table: the Krueger series with hyperbolic functions written out."""
    sinh, cosh = "((exp({0}) - exp(-({0}))) / 2)", "((exp({0}) + exp(-({0}))) / 2)"
    atanh = "(0.5 * ln((1 + ({0})) / (1 - ({0}))))"
    f = 1 / 298.257222101
    n = f / (2 - f)
    big = 6378137.0 / (1 + n) * (1 + n * n / 4 + n**4 / 64)
    al = (n / 2 - 2 * n * n / 3 + 5 * n**3 / 16, 13 * n * n / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k = 2 * n**0.5 / (1 + n)
    x = " + ".join(["eta"] + [f"{a!r} * cos({2 * j} * xi) * {sinh.format(f'{2 * j} * eta')}" for j, a in enumerate(al, 1)])
    y = " + ".join(["xi"] + [f"{a!r} * sin({2 * j} * xi) * {cosh.format(f'{2 * j} * eta')}" for j, a in enumerate(al, 1)])
    inner = f"select *, radians({lat}) as phi, radians({lon} - 3.0) as dl from {source}"
    mid = f"select *, {atanh.format('sin(phi)')} - {k!r} * {atanh.format(f'{k!r} * sin(phi)')} as w from ({inner})"
    t = f"select *, {sinh.format('w')} as t from ({mid})"
    return f"select {columns}, 500000.0::double + {0.9996 * big!r}::double * ({x}) as x, {0.9996 * big!r}::double * ({y}) as y from (select *, atan2(t, cos(dl)) as xi, {atanh.format('sin(dl) / sqrt(1 + t * t)')} as eta from ({t}))"


_PLACES = "(select id, 2.17 + (x - 5000) / 100000 as lon, 41.4 + (y - 5000) / 100000 as lat from {stations})"


@query("reproject_utm", f"select id, round(x, 4) as x, round(y, 4) as y from ({utm_sql('lon', 'lat', _PLACES, 'id')})")
def reproject_utm(spark, d):
    """Longitude and latitude to UTM 31N."""
    dx, dy = (F.col("x") - 5000) / 100000, (F.col("y") - 5000) / 100000
    p = fx(spark, d, "stations").select("id", geo.utm31(F.lit(2.17) + dx, F.lit(41.4) + dy).alias("p"))
    return p.select("id", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query("points_from_degrees", f"select id, round(x, 2) as x, round(y, 2) as y from ({utm_sql('lon', 'lat', '(select id, round(lon * 10000000) / 10000000 as lon, round(lat * 1000000) / 1000000 as lat from ' + _PLACES + ')', 'id')})")
def points_from_degrees(spark, d):
    """Places whose degrees lost their decimal points."""
    lon, lat = F.lit(2.17) + (F.col("x") - 5000) / 100000, F.lit(41.4) + (F.col("y") - 5000) / 100000
    raw = fx(spark, d, "stations").select("id", F.round(lon * 10_000_000).cast("bigint").cast("string").alias("lon"), F.round(lat * 1_000_000).cast("bigint").cast("string").alias("lat"))
    return geometry.with_points(raw).select("id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query("points_from_wkt", "select id, x, y from {stations} where id % 10 <> 3 and x + y > 0")
def points_from_wkt(spark, d):
    """Projected WKT; what is no point goes."""
    s = fx(spark, d, "stations").where("x + y > 0")
    wkt = F.concat(F.lit("POINT ("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")"))
    raw = s.select("id", F.when(F.col("id") % 10 == 3, "POINT EMPTY").otherwise(wkt).alias("geometry"))
    return geometry.with_points(raw).select("id", "x", "y")
