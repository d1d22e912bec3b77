"""All registered queries outside the corpus subpackage, with their SQL twins.

Domain inputs are derived from the test tables by integer arithmetic that both
engines evaluate alike; ``FIXTURES`` holds it once, as select lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, numeric, text
from ..operators import graph, ml, normalize, optimize, ranking, relational, schema, spatial, stats
from ..session import ensure_checkpoint, table, worker_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: name -> (table, select list); plain SQL that Spark and DuckDB read alike.
FIXTURES: dict[str, tuple[str, list[str]]] = {
    "stations": ("supplier", ["cast(s_suppkey as bigint) as id", "cast((s_suppkey * 7919) % 10000 as double) as x", "cast((s_suppkey * 6007) % 10000 as double) as y"]),
    "nodes": ("customer", ["cast(c_custkey as bigint) as id", "cast((c_custkey * 3571) % 10000 as double) as x", "cast((c_custkey * 9173) % 10000 as double) as y"]),
    "features": (
        "part",
        ["cast(p_partkey as bigint) as fid", "cast((p_partkey * 2411) % 10000 as double) as fx", "cast((p_partkey * 5113) % 10000 as double) as fy", "p_brand as line", "p_type as category", "cast(p_size as bigint) as size"],
    ),
    "zones": (
        "nation",
        ["cast(n_nationkey as bigint) as zid", "cast((n_nationkey % 5) * 2000 as double) as minx", "cast(floor(n_nationkey / 5) * 2000 as double) as miny", "cast((n_nationkey % 5) * 2000 + 2000 as double) as maxx", "cast(floor(n_nationkey / 5) * 2000 + 2000 as double) as maxy", "cast((n_nationkey * 37) % 101 as double) as v", "n_name as name"],
    ),
    "buildings": (
        "part",
        ["cast(p_partkey as bigint) as bid", "(p_partkey * 2411) % 10000 - p_size / 2.0 as minx", "(p_partkey * 5113) % 10000 - p_size / 2.0 as miny", "(p_partkey * 2411) % 10000 + p_size / 2.0 as maxx", "(p_partkey * 5113) % 10000 + p_size / 2.0 as maxy", "cast(p_size * p_size as double) as area", "cast(floor(((p_partkey * 2411) % 10000) / 2000) + 5 * floor(((p_partkey * 5113) % 10000) / 2000) as bigint) as zone"],
    ),
    "lanes": (
        "orders",
        ["cast((o_orderkey * 2411) % 10000 as double) as x1", "cast((o_orderkey * 5113) % 10000 as double) as y1", "cast((o_orderkey * 2411) % 10000 + o_orderkey % 301 - 150 as double) as x2", "cast((o_orderkey * 5113) % 10000 + o_custkey % 301 - 150 as double) as y2"],
    ),
    "edges1": ("nation", ["cast(n_nationkey as bigint) as src", "cast((n_nationkey + 1) % 25 as bigint) as dst", "cast(1 + (n_nationkey * 13) % 17 as double) as weight"]),
    "edges2": ("nation", ["cast(n_nationkey as bigint) as src", "cast((n_nationkey * 7 + 3) % 25 as bigint) as dst", "cast(2 + (n_nationkey * 5) % 11 as double) as weight"]),
    "gnodes": ("nation", ["cast(n_nationkey as bigint) as node", "cast((n_nationkey * 7) % 13 as double) as altitude", "cast((n_nationkey * 11) % 23 as double) / 22 as norm_score"]),
    "solutions": ("nation", ["cast(n_nationkey as bigint) as sol", "cast((n_nationkey * 3) % 25 as bigint) as n0", "cast((n_nationkey * 3 + 5) % 25 as bigint) as n1", "cast((n_nationkey * 3 + 10) % 25 as bigint) as n2", "cast((n_nationkey * 7 + 1) % 25 as bigint) as n3"]),
    "status": ("events", ["cast(user_id as bigint) as station_id", "ts", "event_type", "cast(value as double) as bikes", "cast(10 + user_id % 40 as double) as capacity", "cast(event_id as bigint) as event_id"]),
    "lines": ("lineitem", ["cast(l_orderkey as bigint) as k", "cast(l_quantity as double) as quantity", "cast(l_extendedprice as double) as price", "cast(l_discount as double) as discount", "cast(l_tax as double) as tax", "cast(l_quantity * 1000 + l_tax * 100 as double) as gross"]),
}


def fx(spark: SparkSession, d: str, name: str) -> DataFrame:
    t, cols = FIXTURES[name]
    return table(spark, d, t).selectExpr(*cols)


def sub(name: str) -> str:
    t, cols = FIXTURES[name]
    return f"(select {', '.join(cols)} from {t})"


def query(name: str, sql: str | None = None):
    """Registers a query; ``{name}`` in its SQL stands for a fixture."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir)

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            out = sql
            for k in FIXTURES:
                out = out.replace("{" + k + "}", sub(k))
            ORACLE_SQL[name] = out
        return f

    return put


def r6(c: str) -> str:
    return f"round({c}, 6) as {c}"


# ---------------------------------------------------------------- operational targets


@query(
    "station_targets",
    """select station_id, count(ts) as n_observations, round(cast(sum(cast(bikes as decimal(18, 2))) as double) / count(*), 6) as bikes_mean, round(stddev_samp(bikes), 6) as bikes_std,
    min(bikes) as bikes_min, max(bikes) as bikes_max, round((max(capacity) * count(*) - cast(sum(cast(bikes as decimal(18, 2))) as double)) / count(*), 6) as docks_mean, round(cast(sum(cast(bikes as decimal(18, 2))) as double) / count(*) / max(capacity), 6) as ratio_mean,
    round(stddev_samp(bikes / capacity), 6) as ratio_std, round(avg(case when bikes <= 0 then 1 else 0 end), 6) as pct_empty,
    round(avg(case when bikes <= 2 then 1 else 0 end), 6) as pct_near_empty, round(avg(case when capacity - bikes <= 0 then 1 else 0 end), 6) as pct_full, max(capacity) as capacity
    from (select distinct station_id, ts, bikes, capacity from {status}) group by station_id""",
)
def station_targets(spark, d):
    """Occupancy targets per station: duplicates out, ratios and flags, one hash aggregate."""
    s = fx(spark, d, "status").select("station_id", "ts", "bikes", "capacity").dropDuplicates()
    docks = F.col("capacity") - F.col("bikes")
    share = numeric.ratio(F.col("bikes"), F.col("capacity"))
    exact = F.sum(F.col("bikes").cast("decimal(18,2)")).cast("double")  # the same whatever the order of addition
    n, cap = F.count("*"), F.max("capacity")
    return s.groupBy("station_id").agg(
        F.count("ts").alias("n_observations"), F.round(exact / n, 6).alias("bikes_mean"), F.round(F.stddev_samp("bikes"), 6).alias("bikes_std"),
        F.min("bikes").alias("bikes_min"), F.max("bikes").alias("bikes_max"), F.round((cap * n - exact) / n, 6).alias("docks_mean"),
        F.round(numeric.ratio(exact / n, cap), 6).alias("ratio_mean"), F.round(F.stddev_samp(share), 6).alias("ratio_std"),
        F.round(F.avg(numeric.flag(F.col("bikes") <= 0)), 6).alias("pct_empty"), F.round(F.avg(numeric.flag(F.col("bikes") <= 2)), 6).alias("pct_near_empty"),
        F.round(F.avg(numeric.flag(docks <= 0)), 6).alias("pct_full"), F.max("capacity").alias("capacity"),
    )


@query("latest_snapshot", "select station_id, event_id, bikes from (select *, row_number() over (partition by station_id order by ts desc, event_id desc) as n from {status}) where n = 1")
def latest_snapshot(spark, d):
    return relational.latest(fx(spark, d, "status"), ["station_id"], "ts", "event_id").select("station_id", "event_id", "bikes")


@query("stream_targets_batch", "select station_id, cast(epoch(time_bucket(interval '1 hour', ts)) as bigint) as start_s, count(*) as n, round(avg(bikes), 6) as bikes_mean, min(bikes) as bikes_min, max(bikes) as bikes_max from (select station_id, ts, min(bikes) as bikes from {status} group by station_id, ts) group by all")
def stream_targets_batch(spark, d):
    """The streaming query's plan on the batch table."""
    from ..streaming.targets import stream_targets

    s = fx(spark, d, "status").groupBy("station_id", "ts").agg(F.min("bikes").alias("bikes")).withColumn("ts", F.col("ts").cast("timestamp"))
    return stream_targets(s).select("station_id", F.unix_timestamp("start").alias("start_s"), "n", F.round("bikes_mean", 6).alias("bikes_mean"), "bikes_min", "bikes_max")


# ---------------------------------------------------------------- relational


@query("dedup_subset", "select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) as n from lineitem) where n = 1")
def dedup_subset(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return relational.first_of(t, ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey")])


@query("duplicate_report", "select cast(coalesce(sum(n), 0) as bigint) as rows_in_duplicates, count(*) as duplicate_keys, cast(coalesce(sum(n - 1), 0) as bigint) as surplus_rows from (select count(*) as n from lineitem group by l_orderkey, l_linenumber) where n > 1")
def duplicate_report(spark, d):
    return relational.duplicate_counts(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("duplicate_rows", "select l_orderkey, l_linenumber, l_partkey, n_rows from (select *, count(*) over (partition by l_orderkey, l_linenumber) as n_rows from lineitem) where n_rows > 1")
def duplicate_rows(spark, d):
    return relational.duplicate_rows(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


@query("collapse_duplicates", "select l_orderkey, round(avg(l_quantity), 6) as l_quantity, round(avg(l_extendedprice), 6) as l_extendedprice, min(l_returnflag) as l_returnflag from lineitem group by l_orderkey")
def collapse_duplicates(spark, d):
    """Numbers by mean, text by the first value in order."""
    out = relational.collapse(table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag"), "l_orderkey")
    return out.select("l_orderkey", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_extendedprice", 6).alias("l_extendedprice"), "l_returnflag")


@query("modeling_join", "select cast(c_custkey as varchar) as station_id, c_name, c_mktsegment, n_orders, total from customer join (select o_custkey, count(*) as n_orders, round(sum(o_totalprice), 2) as total from orders group by o_custkey) on c_custkey = o_custkey")
def modeling_join(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("station_id"), "c_name", "c_mktsegment")
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("station_id")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return schema.order_columns(relational.inner_on_key(a, b, "station_id"), ["station_id", "c_name"])


@query("left_join_section", "select c_custkey, lpad(cast(c_nationkey as varchar), 10, '0') as section, n_name from customer left join nation on c_nationkey = n_nationkey and n_regionkey <> 1")
def left_join_section(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("section"))
    n = table(spark, d, "nation").select((F.col("n_regionkey") == 1).alias("gone"), F.col("n_nationkey").alias("k"), "n_name")
    n = n.select(F.when(~F.col("gone"), F.concat(F.col("k").cast("string"), F.lit(".0"))).alias("section"), "n_name")
    return relational.left_section_join(c, n, "section", text.normalize_section)


@query("full_join_chain", "select nationkey, n_suppliers, n_customers, n_name from (select s_nationkey as nationkey, count(*) as n_suppliers from supplier where s_acctbal < 2000 group by 1) full join (select c_nationkey as nationkey, count(*) as n_customers from customer where c_acctbal < -900 group by 1) using (nationkey) full join (select n_nationkey as nationkey, n_name from nation) using (nationkey)")
def full_join_chain(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal < 2000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("n_suppliers"))
    c = table(spark, d, "customer").where("c_acctbal < -900").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n_customers"))
    return relational.full_chain([s, c, table(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")], "nationkey")


@query("anti_fallback", "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def anti_fallback(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.unmatched(table(spark, d, "customer").select("c_custkey", "c_name"), o, ["c_custkey"])


@query("semi_select", "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def semi_select(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@query("key_validation", "select count(*) filter (where b is null) as only_left, count(*) filter (where a is null) as only_right, count(*) filter (where a is not null and b is not null) as common from (select distinct o_custkey as k, 1 as a from orders where o_orderstatus = 'P') full join (select distinct c_custkey as k, 1 as b from customer where c_acctbal > 0) using (k)")
def key_validation(spark, d):
    return relational.key_difference(table(spark, d, "orders").where("o_orderstatus = 'P'"), table(spark, d, "customer").where("c_acctbal > 0"), "o_custkey", "c_custkey")


@query(
    "pairwise_overlap",
    """with s as (select distinct event_type as g, user_id as k from events where value > 50), n as (select g, count(*) as n from s group by g),
    b as (select x.g as a, y.g as b, count(*) as c from s x join s y on x.k = y.k and x.g < y.g group by all)
    select p.g as a, q.g as b, p.n as n_a, q.n as n_b, coalesce(c, 0) as n_both, p.n - coalesce(c, 0) as only_a, q.n - coalesce(c, 0) as only_b,
    round(coalesce(c, 0) / p.n, 6) as share_a, round(coalesce(c, 0) / q.n, 6) as share_b from n p join n q on p.g < q.g left join b on b.a = p.g and b.b = q.g""",
)
def pairwise_overlap(spark, d):
    out = relational.pairwise_overlap(table(spark, d, "events").where("value > 50").select("event_type", "user_id"), "event_type", "user_id")
    return out.withColumns({c: F.round(c, 6) for c in ("share_a", "share_b")})


@query("union_concat", "select 's' as kind, s_suppkey as k, s_name as name, cast(null as varchar) as segment from supplier union all select 'c', c_custkey, c_name, c_mktsegment from customer")
def union_concat(spark, d):
    s = table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    c = table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("candidate_pool", "select o_custkey, cast(len(list_filter(list_distinct(list_concat(a, b)), lambda x: x <> 3)) as integer) as n_pool from (select o_custkey, list(o_orderkey % 10) filter (where o_orderstatus = 'O') as a, list(o_orderkey % 10) filter (where o_orderstatus = 'F') as b from orders group by o_custkey) where a is not null and b is not null")
def candidate_pool(spark, d):
    """Union of two parents' elements without the required one."""
    m = F.col("o_orderkey") % 10
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderstatus") == "O", m)).alias("a"), F.collect_set(F.when(F.col("o_orderstatus") == "F", m)).alias("b"))
    g = g.where((F.size("a") > 0) & (F.size("b") > 0))
    return g.select("o_custkey", F.size(F.array_except(F.array_union("a", "b"), F.array(F.lit(3).cast("bigint")))).alias("n_pool"))


@query("latest_per_customer", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1")
def latest_per_customer(spark, d):
    """The newest order of each customer, by one aggregate instead of a sort."""
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", F.col("m.o_orderkey").alias("o_orderkey"))


@query("synthetic_names", "select s_suppkey, case when s_acctbal < 3000 then 'helper_' || row_number() over (partition by s_nationkey, s_acctbal < 3000 order by s_suppkey) else s_name end as s_name from supplier")
def synthetic_names(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_acctbal") < 3000, "").otherwise(F.col("s_name")).alias("s_name"))
    return relational.synthetic_names(s, "s_nationkey", "s_name", "s_suppkey").select("s_suppkey", "s_name")


@query("education_pivot", "select o_custkey, count(*) filter (where o_orderpriority = '1-URGENT') as p_1_urgent, count(*) filter (where o_orderpriority = '2-HIGH') as p_2_high, count(*) filter (where o_orderpriority = '3-MEDIUM') as p_3_medium from orders group by o_custkey")
def education_pivot(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", F.lit(1).cast("bigint").alias("n"))
    out = relational.pivot_sum(o, "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"], "n", "p_")
    return out.toDF("o_custkey", "p_1_urgent", "p_2_high", "p_3_medium")


@query("percentage_share", "select o_orderpriority, o_orderstatus, n, round(100.0 * n / sum(n) over (partition by o_orderpriority), 1) as share from (select o_orderpriority, o_orderstatus, count(*) as n from orders group by all)")
def percentage_share(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", F.lit(1).cast("bigint").alias("n"))
    return relational.share_of_group(o, ["o_orderpriority", "o_orderstatus"], ["o_orderpriority"], "n")


@query("group_sums", "select c_nationkey, c_mktsegment, round(sum(c_acctbal), 2) as total, count(*) as n from customer group by all order by total desc, c_nationkey limit 20")
def group_sums(spark, d):
    g = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.round(F.sum("c_acctbal"), 2).alias("total"), F.count("*").alias("n"))
    return ranking.top(g, 20, [F.desc("total"), F.asc("c_nationkey")])


# ---------------------------------------------------------------- filters, text


@query("operational_filter", "select o_orderkey, o_orderstatus from orders where o_orderstatus in ('O', 'P') and o_orderpriority <> '5-LOW' and o_totalprice is not null")
def operational_filter(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return o.where(F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderpriority") != "5-LOW") & F.col("o_totalprice").isNotNull()).select("o_orderkey", "o_orderstatus")


@query("residential_filter", "select p_partkey from part where not coalesce(p_brand in ('Brand#1', 'Brand#2'), false) and not coalesce(nullif(p_type, p_brand) like '%PROMO%', false) and (p_size % 5 <> 0 or nullif(p_size % 2, 0) is null)")
def residential_filter(spark, d):
    """Exclusion lists that keep nulls, then a choice of null tests."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    gone = lambda c: F.coalesce(c, F.lit(False))
    return p.where(~gone(F.col("p_brand").isin("Brand#1", "Brand#2")) & ~gone(F.col("p_type").contains("PROMO")) & ((F.col("p_size") % 5 != 0) | (F.col("p_size") % 2 == 0))).select("p_partkey")


@query("text_exclusion", "select c_custkey from customer where not coalesce(contains(lower(c_name), '7'), false)")
def text_exclusion(spark, d):
    return table(spark, d, "customer").where(~F.coalesce(F.lower("c_name").contains("7"), F.lit(False))).select("c_custkey")


@query("text_normalize", "select doc_id, md5(nullif(trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g')), '')) as h from documents")
def text_normalize(spark, d):
    """Whole texts as a name field, normalised."""
    worker_path(spark)
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text")).cast("binary")).alias("h"))


@query("section_normalize", "select c_custkey, lpad(cast(c_custkey + 801900000 as varchar), 10, '0') as a, '08019' || lpad(cast(c_nationkey as varchar), 2, '0') || lpad(cast(c_custkey % 1000 as varchar), 3, '0') as b from customer")
def section_normalize(spark, d):
    """Ids from decimals, ids from their parts."""
    c = table(spark, d, "customer")
    a = text.normalize_section(F.concat((F.col("c_custkey") + 801900000).cast("string"), F.lit(",0")))
    b = F.concat(F.lit("08019"), text.zfill(F.col("c_nationkey").cast("string"), 2), text.zfill((F.col("c_custkey") % 1000).cast("string"), 3))
    return c.select("c_custkey", a.alias("a"), b.alias("b"))


@query("decimal_comma_parse", "select c_custkey, cast(c_custkey * 1000 + 234 as double) + 0.5 as v from customer")
def decimal_comma_parse(spark, d):
    n = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", text.decimal_comma(F.concat(n.cast("string"), F.lit(".234,5"))).alias("v"))


@query("natural_line_sort", "select p_brand, cast(row_number() over (order by regexp_extract(p_brand, '([A-Za-z]+)', 1), cast(regexp_extract(p_brand, '([0-9]+)', 1) as integer), p_brand) as integer) as place from (select distinct p_brand from part)")
def natural_line_sort(spark, d):
    w = Window.orderBy(*ranking.natural_line_order(F.col("p_brand")))  # one row per line
    return table(spark, d, "part").select("p_brand").distinct().withColumn("place", F.row_number().over(w))


@query("regex_extract_parens", "select s_suppkey, cast(s_nationkey as varchar) as inside, s_name as outside, split_part(s_name, '#', 2) as last from supplier")
def regex_extract_parens(spark, d):
    s = table(spark, d, "supplier").withColumn("label", F.concat("s_name", F.lit(" ("), F.col("s_nationkey").cast("string"), F.lit(")")))
    return s.select("s_suppkey", text.in_parens(F.col("label")).alias("inside"), text.without_parens(F.col("label")).alias("outside"), text.last_token(F.replace("s_name", F.lit("#"), F.lit(" "))).alias("last"))


@query("json_props_lookup", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props_lookup(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>")["k"].try_cast("bigint").alias("k"))


@query("explode_lines", "select s.word as word, count(*) as n, count(distinct p_partkey) as n_parts from part, unnest(string_split(p_name, ' ')) as s(word) group by s.word")
def explode_lines(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.explode_outer(F.split("p_name", " ")).alias("word"))
    return p.groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("n_parts"))


@query("collect_lines", "select p_type, array_to_string(list_sort(list_distinct(list(p_brand))), ',') as lines, count(distinct p_brand) as n_lines from part group by p_type")
def collect_lines(spark, d):
    g = table(spark, d, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_brand")).alias("l"))
    return g.select("p_type", F.array_join("l", ",").alias("lines"), F.size("l").cast("bigint").alias("n_lines"))


#: Fixed values of the stand-in for point-of-interest tags: category -> key words of a part's type.
POI = {"health": ("STANDARD",), "culture": ("ECONOMY",), "sport": ("MEDIUM", "PROMO"), "food": ("LARGE",)}


def poi_flags(p: DataFrame) -> DataFrame:
    flag = lambda words: F.greatest(*[F.col("category").contains(w).cast("int") for w in words], F.lit(0))
    return p.withColumns({f"is_{k}": flag(w) for k, w in POI.items()})


_POI_SQL = ", ".join(f"cast({' or '.join(f'contains(category, {w!r})' for w in ws)} as integer) as is_{k}" for k, ws in POI.items())


@query("poi_classify", f"select * from (select fid, {_POI_SQL} from {{features}}) where is_health + is_culture + is_sport + is_food > 0")
def poi_classify(spark, d):
    """Tag words to category flags; rows without any category go."""
    p = poi_flags(fx(spark, d, "features").select("fid", "category")).drop("category")
    return p.where(numeric.row_sum([F.col(f"is_{k}") for k in POI]) > 0)


@query("poi_entropy", "select line, n, round(-sum(c * 1.0 / n * log2(c * 1.0 / n)), 2) as entropy from (select line, category, count(*) as c, cast(sum(count(*)) over (partition by line) as bigint) as n from {features} group by line, category) group by line, n")
def poi_entropy(spark, d):
    f = fx(spark, d, "features")
    g = f.groupBy("line", "category").agg(F.count("*").alias("c")).groupBy("line").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return g.select("line", "n", F.round(F.log2("n") - F.col("s") / F.col("n"), 2).alias("entropy"))


@query("age_group_map", "select decade, count(*) as n from (select case when p_size >= 40 then '40+' else cast(cast(floor(p_size / 10) * 10 as integer) as varchar) || '-' || cast(cast(floor(p_size / 10) * 10 + 9 as integer) as varchar) end as decade from part) group by decade")
def age_group_map(spark, d):
    """Five-year bands to decades by a map literal."""
    five = F.concat((F.floor(F.col("p_size") / 5) * 5).cast("string"), F.lit("-"), (F.floor(F.col("p_size") / 5) * 5 + 4).cast("string"))
    pairs = [(f"{a}-{a + 4}", f"{a // 10 * 10}-{a // 10 * 10 + 9}" if a < 40 else "40+") for a in range(0, 100, 5)]
    lookup = F.create_map(*[F.lit(x) for p in pairs for x in p])
    return table(spark, d, "part").select(lookup[five].alias("decade")).groupBy("decade").agg(F.count("*").alias("n"))


@query("censored_impute", None)
def censored_impute(spark, d):
    """Censored counts by a hash of their keys; rows only."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "..").otherwise((F.col("o_orderkey") % 50).cast("string")).alias("raw"))
    return o.select("o_orderkey", numeric.impute_censored(F.col("raw"), [F.col("o_orderkey")]).alias("v"))


# ---------------------------------------------------------------- ranking and scores


@query("percentile_score", "with r as (select p_partkey, p_size, rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 as m, count(*) over () as n from part) select p_partkey, round(case when n = 1 then 1.0 else (m - 1) / (n - 1) end, 6) as score, round(case when n = 1 then 1.0 else 1 - (m - 1) / (n - 1) end, 6) as inverse from r")
def percentile_score(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    out = ranking.percentile_score(ranking.percentile_score(p, "p_size", "score"), "p_size", "inverse", False)
    return out.select("p_partkey", F.round("score", 6).alias("score"), F.round("inverse", 6).alias("inverse"))


@query("competition_rank", "select c_custkey, cast(rank() over (order by floor(c_acctbal / 100) desc) as bigint) as place from customer")
def competition_rank(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.floor(F.col("c_acctbal") / 100).alias("v"))
    return ranking.competition_rank(c, "v", "place").select("c_custkey", F.col("place").cast("bigint").alias("place"))


_PARTS = "case when c_custkey % 7 = 0 then null else cast(c_custkey % 101 as double) / 100 end as a, case when c_custkey % 5 = 0 then null else cast(c_custkey % 53 as double) / 52 end as b, case when c_custkey % 3 = 0 then null else cast(c_custkey % 29 as double) / 28 end as c"


@query("weighted_row_score", f"select c_custkey, round((0.5::double * coalesce(a, 0) + 0.3::double * coalesce(b, 0) + 0.2::double * coalesce(c, 0)) / nullif(0.5::double * (a is not null)::int + 0.3::double * (b is not null)::int + 0.2::double * (c is not null)::int, 0), 6) as score, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a is not null)::int + (b is not null)::int + (c is not null)::int, 0), 6) as mean from (select c_custkey, {_PARTS} from customer)")
def weighted_row_score(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", *[x.strip() for x in _PARTS.replace(" as a, ", " as a|").replace(" as b, ", " as b|").split("|")])
    cols = [F.col(x).cast("double") for x in "abc"]
    return c.select("c_custkey", F.round(numeric.weighted_score(list(zip(cols, (0.5, 0.3, 0.2)))), 6).alias("score"), F.round(numeric.row_mean(cols), 6).alias("mean"))


@query("score_bands", "select c_custkey, case when v <= 20 then 'very_low' when v <= 40 then 'low' when v <= 60 then 'medium' when v <= 80 then 'high' else 'very_high' end as band from (select c_custkey, c_custkey % 101 as v from customer)")
def score_bands(spark, d):
    return table(spark, d, "customer").select("c_custkey", numeric.band(F.col("c_custkey") % 101).alias("band"))


#: Dimension -> (weight, features as (column, higher is better)).
DIMENSIONS = {
    "accessibility": (0.35, [("bus_lines", True), ("metro_count", True), ("metro_near", False), ("tram_near", False), ("lane_length", True), ("bus_near", False)]),
    "activity": (0.25, [("poi_count", True)]),
    "socioeconomic": (0.25, [("population", True), ("income", True), ("college", True), ("unemployed", False)]),
    "topography": (0.15, [("slope", False)]),
}


def station_features(spark, d) -> DataFrame:
    """Stations with the twelve features: one spatial join serves all point layers, one the lanes."""
    st, f = fx(spark, d, "stations"), fx(spark, d, "features")
    bus, metro, tram = (F.col("category").contains(w) for w in ("STANDARD", "LARGE", "PROMO"))
    aggs = [
        F.count_distinct(F.when(bus, F.col("line"))).alias("bus_lines"), F.min(F.when(bus, F.col("dist"))).alias("bus_near"),
        F.count_if(metro).alias("metro_count"), F.min(F.when(metro, F.col("dist"))).alias("metro_near"),
        F.min(F.when(tram, F.col("dist"))).alias("tram_near"), F.count("*").alias("poi_count"),
    ]
    near = spatial.aggregate_within(st, f, 500.0, aggs, ["bus_lines", "metro_count", "poi_count"])
    lanes = spatial.line_length_within(st, fx(spark, d, "lanes"), 300.0).select("id", F.round("length", 4).alias("lane_length"))
    k = F.col("s_nationkey")
    s = table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("bigint").alias("id"), ((k * 37) % 101).cast("double").alias("population"), F.col("s_acctbal").cast("double").alias("income"),
        F.when(k % 6 != 0, (k % 11).cast("double")).alias("college"), (F.col("s_suppkey") % 13).cast("double").alias("unemployed"), (F.col("s_suppkey") % 7).cast("double").alias("slope"),
    )
    return near.join(lanes, "id").join(s, "id")


def score_stations(feats: DataFrame) -> DataFrame:
    ensure_checkpoint(feats.sparkSession)
    feats = feats.checkpoint()  # a row per station, read three times
    feats = ranking.percentile_scores(feats, "id", [(c, f"score__{c}", up) for _, columns in DIMENSIONS.values() for c, up in columns])
    for name, (_, columns) in DIMENSIONS.items():
        feats = feats.withColumn(name, numeric.row_mean([F.col(f"score__{c}") for c, _ in columns]))
    feats = feats.withColumn("score", F.round(numeric.weighted_score([(F.col(n), w) for n, (w, _) in DIMENSIONS.items()]) * 100, 4)).checkpoint()
    feats = ranking.rank_and_percentile(feats, "score", "place", "pct")
    return feats.withColumn("pct", F.round(F.col("pct") * 100, 2)).withColumn("band", numeric.band(F.col("score")))


_UX, _UY, _DX, _DY = "(x1 - x)", "(y1 - y)", "(x2 - x1)", "(y2 - y1)"


def lane_sql(points: str, radius: float) -> str:
    """(id, length, any_line) of the lanes within a radius of the points of a fixture."""
    a, b = f"({_DX} ** 2 + {_DY} ** 2)", f"(2 * ({_UX} * {_DX} + {_UY} * {_DY}))"
    c = f"({_UX} ** 2 + {_UY} ** 2 - {float(radius) ** 2})"
    reach = radius + 151
    t = f"greatest(0, least(1, -b / nullif(2 * a, 0)))"
    return (
        f"(select s.id, coalesce(sum(case when a = 0 or q <= 0 then 0 else sqrt(a) * greatest(0, least(1, (-b + sqrt(q)) / (2 * a)) - greatest(0, (-b - sqrt(q)) / (2 * a))) end), 0) as length, "
        f"coalesce(max(case when a * coalesce({t}, 0) ** 2 + b * coalesce({t}, 0) + c <= 0 then 1 else 0 end), 0) as any_line "
        f"from {points} s left join (select *, greatest(b * b - 4 * a * c, 0) as q from (select id, {a} as a, {b} as b, {c} as c from {points}, {sub('lanes')} where abs(x1 - x) <= {reach} and abs(y1 - y) <= {reach})) t using (id) group by s.id)"
    )


_FEATS_SQL = """f as (select s.id, count(distinct case when contains(category, 'STANDARD') then p.line end) as bus_lines, min(case when contains(category, 'STANDARD') then sqrt((s.x - p.fx) ** 2 + (s.y - p.fy) ** 2) end) as bus_near,
    count(*) filter (where contains(category, 'LARGE')) as metro_count, min(case when contains(category, 'LARGE') then sqrt((s.x - p.fx) ** 2 + (s.y - p.fy) ** 2) end) as metro_near,
    min(case when contains(category, 'PROMO') then sqrt((s.x - p.fx) ** 2 + (s.y - p.fy) ** 2) end) as tram_near, count(p.fid) as poi_count
    from {stations} s left join {features} p on (s.x - p.fx) ** 2 + (s.y - p.fy) ** 2 <= 250000.0 group by s.id),
    g as (select f.*, round(l.length, 4) as lane_length, cast((s_nationkey * 37) % 101 as double) as population, cast(s_acctbal as double) as income, case when s_nationkey % 6 <> 0 then cast(s_nationkey % 11 as double) end as college,
    cast(s_suppkey % 13 as double) as unemployed, cast(s_suppkey % 7 as double) as slope from f join supplier on s_suppkey = f.id join """ + lane_sql("{stations}", 300.0) + " l on l.id = f.id)"


def _mid_sql(c: str, up: bool = True) -> str:
    v = f"(rank() over (partition by {c} is null order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 - 1) / nullif(count({c}) over () - 1, 0)"
    return f"case when {c} is null then null when count({c}) over () = 1 then 1.0 else {v if up else f'1 - {v}'} end"


def _mean_sql(columns: list[str]) -> str:
    return f"({' + '.join(f'coalesce({c}, 0)' for c in columns)}) / nullif({' + '.join(f'({c} is not null)::int' for c in columns)}, 0)"


_SCORE_SQL = (
    f"with {_FEATS_SQL}, h as (select id, "
    + ", ".join(f"{_mid_sql(c, up)} as s_{c}" for _, cols in DIMENSIONS.values() for c, up in cols)
    + " from g), k as (select id, "
    + ", ".join(f"{_mean_sql([f's_{c}' for c, _ in cols])} as {name}" for name, (_, cols) in DIMENSIONS.items())
    + " from h), m as (select id, round(100 * ("
    + " + ".join(f"{w}::double * coalesce({name}, 0)" for name, (w, _) in DIMENSIONS.items())
    + ") / ("
    + " + ".join(f"{w}::double * ({name} is not null)::int" for name, (w, _) in DIMENSIONS.items())
    + "), 4) as score from k) "
    + f"select id, score, cast(rank() over (order by score desc) as bigint) as place, round(100 * ({_mid_sql('score')}), 2) as pct, case when score <= 20 then 'very_low' when score <= 40 then 'low' when score <= 60 then 'medium' when score <= 80 then 'high' else 'very_high' end as band from m"
)


@query("explanatory_score", _SCORE_SQL)
def explanatory_score(spark, d):
    """The composite index of stations: percentiles, dimension means, renormalised weights, rank, band."""
    return score_stations(station_features(spark, d)).select("id", "score", F.col("place").cast("bigint").alias("place"), "pct", "band")


@query("feature_coverage", "select feature, coverage from (select round(count(l_orderkey) / count(*), 6) as line, round(count(o_comment2) / count(*), 6) as odd from (select o_orderkey, nullif(o_orderkey % 7, 0) as o_comment2, l_orderkey from orders left join (select distinct l_orderkey from lineitem where l_returnflag = 'R') on o_orderkey = l_orderkey)) unpivot (coverage for feature in (line, odd))")
def feature_coverage(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("line", F.lit(1))
    o = table(spark, d, "orders").select("o_orderkey", F.expr("nullif(o_orderkey % 7, 0)").alias("odd")).join(li, "o_orderkey", "left")
    return stats.coverage(o, ["line", "odd"]).select("feature", F.round("coverage", 6).alias("coverage"))


# ---------------------------------------------------------------- statistics


_MID = "rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0"


@query("target_correlations", f"with r as (select quantity, price, {_MID.format(c='quantity')} as rq, {_MID.format(c='price')} as rp from {{lines}}) select count(*) as n, round(corr(quantity, price), 6) as pearson, round(corr(rq, rp), 6) as spearman from r")
def target_correlations(spark, d):
    out = stats.correlation(fx(spark, d, "lines"), "quantity", "price")
    return out.select("n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


_PAIRS = [("quantity", "gross"), ("price", "gross"), ("discount", "gross"), ("tax", "gross"), ("quantity", "price"), ("quantity", "discount"), ("quantity", "tax"), ("price", "discount"), ("price", "tax"), ("discount", "tax")]


@query("correlation_matrix", " union all ".join(f"select '{a}' as feature_a, '{b}' as feature_b, round(corr({a}, {b}), 6) as r from {{lines}}" for a, b in _PAIRS))
def correlation_matrix(spark, d):
    return stats.correlation_pairs(fx(spark, d, "lines"), ["quantity", "price", "discount", "tax", "gross"]).withColumn("r", F.round("r", 6))


_RANKED = "r as (select " + ", ".join(f"{_MID.format(c=c)} as {c}" for c in ("quantity", "price", "discount", "tax", "gross")) + " from {lines})"


@query("spearman_matrix", f"with {_RANKED} " + " union all ".join(f"select '{a}' as feature_a, '{b}' as feature_b, round(corr({a}, {b}), 6) as r from r" for a, b in _PAIRS))
def spearman_matrix(spark, d):
    return stats.spearman_pairs(fx(spark, d, "lines"), ["quantity", "price", "discount", "tax", "gross"]).withColumn("r", F.round("r", 6))


@query("high_corr_pairs", f"with {_RANKED} select * from (" + " union all ".join(f"select '{a}' as feature_a, '{b}' as feature_b, round(corr({a}, {b}), 6) as r from r" for a, b in _PAIRS) + ") where abs(r) >= 0.85")
def high_corr_pairs(spark, d):
    """Pairs of features whose rank correlation is 0.85 or more either way."""
    return spearman_matrix(spark, d).where(F.abs("r") >= 0.85)


@query("vif", "with g as (select sum(quantity * quantity) as a, sum(discount * discount) as b, sum(quantity * discount) as c from {lines}) select 'quantity' as feature, round(a * b / (a * b - c * c), 4) as vif from g union all select 'discount', round(a * b / (a * b - c * c), 4) from g")
def vif(spark, d):
    return stats.vif(fx(spark, d, "lines"), ["quantity", "discount"]).withColumn("vif", F.round("vif", 4))


@query("vif_many", None)
def vif_many(spark, d):
    return stats.vif(fx(spark, d, "lines"), ["quantity", "price", "discount", "tax"])


@query("quantile_fences", "select q1, median, q3, round(q3 - q1, 4) as iqr, round(q1 - 1.5 * (q3 - q1), 4) as lower, round(q3 + 1.5 * (q3 - q1), 4) as upper from (select round(quantile_cont(b, 0.25), 4) as q1, round(quantile_cont(b, 0.5), 4) as median, round(quantile_cont(b, 0.75), 4) as q3 from (select cast(c_acctbal as double) as b from customer))")
def quantile_fences(spark, d):
    out = stats.quartile_fences(table(spark, d, "customer").select(F.col("c_acctbal").cast("double").alias("b")), "b")
    r = {c: F.round(c, 4) for c in ("q1", "median", "q3")}
    out = out.withColumns(r)
    return out.withColumns({"iqr": F.round(F.col("q3") - F.col("q1"), 4), "lower": F.round(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), 4), "upper": F.round(F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")), 4)})


@query("length_summary", "select cast(min(n) as integer) as min_len, cast(max(n) as integer) as max_len, count(distinct n) as n_lens, array_to_string(list_sort(list_distinct(list(n)))[1:10], ',') as lens from (select length(p_name) as n from part)")
def length_summary(spark, d):
    return stats.length_summary(table(spark, d, "part"), "p_name")


@query("histogram_bins", "with e as (select min(v) as lo, max(v) as hi from (select cast(c_acctbal as double) as v from customer)) select cast(least(29, floor((v - lo) * 30 / (hi - lo))) as integer) as bin, count(*) as n from (select cast(c_acctbal as double) as v from customer), e group by 1")
def histogram_bins(spark, d):
    return stats.histogram(table(spark, d, "customer").select(F.col("c_acctbal").cast("double").alias("v")), "v").select("bin", "n")


_NORM = {
    "normalize_minmax": ("minmax", "(v - min(v) over ()) / (max(v) over () - min(v) over ())"),
    "normalize_inverted": ("inverted_minmax", "1 - (v - min(v) over ()) / (max(v) over () - min(v) over ())"),
    "normalize_zero_max": ("0-max", "v / max(v) over ()"),
    "normalize_zscore": ("zscore", "(z - min(z) over ()) / (max(z) over () - min(z) over ())"),
    "normalize_log": ("log", "(ln(1 + v) - min(ln(1 + v)) over ()) / (max(ln(1 + v)) over () - min(ln(1 + v)) over ())"),
    "normalize_robust": ("robust", "greatest(0, least(1, (v - (select quantile_cont(v, 0.5) from t)) / (select quantile_cont(v, 0.75) - quantile_cont(v, 0.25) from t)))"),
}


def _normalizer(name: str, method: str, expr: str) -> None:
    @query(name, f"with t as (select p_partkey, cast(p_retailprice as double) as v from part), u as (select *, (v - avg(v) over ()) / stddev_samp(v) over () as z from t) select p_partkey, round({expr}, 4) as v from u")
    def run(spark, d):
        t = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("v"))
        return normalize.normalize(t, "v", method).withColumn("v", F.round("v", 4))


for _n, (_m, _e) in _NORM.items():
    _normalizer(_n, _m, _e)


@query("normalize_boxcox", None)
def normalize_boxcox(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("v"))
    return normalize.normalize(t, "v", "boxcox")


@query("gap_analysis", f"with t as (select c_custkey, cast(c_custkey % 97 as double) as score, cast(c_acctbal as double) as target, round(cast(c_acctbal as double) * 0.9 + c_custkey % 13, 6) as pred from customer), p as (select *, round(100 * ({_mid_sql('score')}), 2) as sp, round(100 * ({_mid_sql('target')}), 2) as tp from t) select c_custkey, sp, tp, round(sp - tp, 2) as structural_gap, round(target - pred, 4) as predictive_gap, case when round(sp - tp, 2) >= 0 then 'over' else 'under' end as label from p")
def gap_analysis(spark, d):
    """Score percentile against target percentile, target against prediction."""
    t = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 97).cast("double").alias("score"), F.col("c_acctbal").cast("double").alias("target"))
    t = t.withColumn("pred", F.round(F.col("target") * 0.9 + F.col("c_custkey") % 13, 6))
    t = ranking.percentile_score(ranking.percentile_score(t, "score", "sp"), "target", "tp").withColumns({"sp": F.round(F.col("sp") * 100, 2), "tp": F.round(F.col("tp") * 100, 2)})
    gap = F.round(F.col("sp") - F.col("tp"), 2)
    return t.select("c_custkey", "sp", "tp", gap.alias("structural_gap"), F.round(F.col("target") - F.col("pred"), 4).alias("predictive_gap"), F.when(gap >= 0, "over").otherwise("under").alias("label"))


@query("top_gaps", "select c_custkey, v from (select c_custkey, c_acctbal as v from customer) order by v, c_custkey limit 25")
def top_gaps(spark, d):
    return ranking.top(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v")), 25, [F.asc("v"), F.asc("c_custkey")])


_PRED = "quantity * 1500 + discount * 1000"


@query(
    "summary_metrics",
    f"with p as (select *, {_PRED} as pred from {{lines}}), r as (select *, {_MID.format(c='quantity')} as rq, {_MID.format(c='price')} as rp, {_MID.format(c='pred')} as rr from p), "
    "t as (select * from (values ('quantity', (select abs(corr(quantity, price)) from p)), ('discount', (select abs(corr(discount, price)) from p)), ('tax', (select abs(corr(tax, price)) from p))) t(f, v) order by v desc, f limit 1) "
    "select 'score_vs_target_pearson' as metric, cast(round(corr(quantity, price), 4) as varchar) as value from r union all select 'score_vs_target_spearman', cast(round(corr(rq, rp), 4) as varchar) from r "
    "union all select 'prediction_vs_target_pearson', cast(round(corr(pred, price), 4) as varchar) from r union all select 'prediction_vs_target_spearman', cast(round(corr(rr, rp), 4) as varchar) from r "
    "union all select 'top_feature', f from t union all select 'top_feature_importance', cast(round(v, 4) as varchar) from t",
)
def summary_metrics(spark, d):
    """Six names and values: how score and prediction go with the target, and the feature that goes with it most."""
    t = fx(spark, d, "lines").withColumn("pred", F.expr(_PRED))
    said = lambda c: text.plain_number(F.col(c), 4)
    rows = [stats.correlation(t, c, "price").select(F.inline(F.array(*[F.struct(F.lit(f"{n}_vs_target_{m}").alias("metric"), said(m).alias("value")) for m in ("pearson", "spearman")]))) for n, c in (("score", "quantity"), ("prediction", "pred"))]
    size = {c: F.abs(F.corr(c, "price")) for c in ("quantity", "discount", "tax")}
    each = F.array(*[F.struct(v.isNull().alias("none"), (-v).alias("less"), F.lit(c).alias("f"), v.alias("v")) for c, v in size.items()])
    top = t.agg(F.array_min(each).alias("t")).select(F.inline(F.array(F.struct(F.lit("top_feature").alias("metric"), F.col("t.f").alias("value")), F.struct(F.lit("top_feature_importance").alias("metric"), said("t.v").alias("value")))))
    return rows[0].unionByName(rows[1]).unionByName(top)


@query("normalize_nodes", "select c_custkey, round((a - min(a) over ()) / (max(a) over () - min(a) over ()), 2) as a, round(1 - b / max(b) over (), 2) as b, round((ln(1 + c) - min(ln(1 + c)) over ()) / (max(ln(1 + c)) over () - min(ln(1 + c)) over ()), 2) as c from (select c_custkey, cast(c_acctbal as double) as a, cast(c_nationkey + 1 as double) as b, cast(c_custkey as double) as c from customer)")
def normalize_nodes(spark, d):
    """Each column by its own method."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("a"), (F.col("c_nationkey") + 1).cast("double").alias("b"), F.col("c_custkey").cast("double").alias("c"))
    return normalize.normalize_columns(c, {"a": "minmax", "b": "inverted_0-max", "c": "log"})


@query("error_metrics", "select cast(k % 5 as integer) as fold, count(*) as n, round(avg(abs(price - 1500 * quantity)), 2) as mae, round(sqrt(avg((price - 1500 * quantity) ** 2)), 2) as rmse from {lines} group by 1")
def error_metrics(spark, d):
    t = fx(spark, d, "lines").withColumn("pred", F.col("quantity") * 1500).withColumn("fold", (F.col("k") % 5).cast("int"))
    return stats.errors(t, "price", "pred", ["fold"]).select("fold", "n", F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"))


@query("linear_model", "select round(regr_slope(price, quantity), 4) as slope, round(regr_intercept(price, quantity), 2) as intercept from {lines}")
def linear_model(spark, d):
    """Least squares of one feature, in closed form from one aggregate."""
    t = fx(spark, d, "lines").agg(F.regr_slope("price", "quantity").alias("slope"), F.regr_intercept("price", "quantity").alias("intercept"))
    return t.select(F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("score_combinations", "select c_custkey, round(a * b, 6) as multiplied, round(a ** b, 6) as exponential, round(a * b ** 2, 6) as penalised from (select c_custkey, (1 + c_custkey % 50) / 50.0 as a, (1 + c_custkey % 20) / 20.0 as b from customer)")
def score_combinations(spark, d):
    a, b = (1 + F.col("c_custkey") % 50) / 50.0, (1 + F.col("c_custkey") % 20) / 20.0
    out = {"multiplied": ("multiply", 1), "exponential": ("exponential", 1), "penalised": ("power_penalty", 2)}
    return table(spark, d, "customer").select("c_custkey", *[F.round(numeric.combine(a, b, h, p), 6).alias(n) for n, (h, p) in out.items()])


@query("rate_to_absolute", "select c_custkey, round((c_custkey % 90) * (100 + c_custkey % 900) / 100, 6) as absolute, round((c_custkey % 500) * (100 + c_custkey % 900) / 1000, 3) as per_thousand from customer")
def rate_to_absolute(spark, d):
    k = F.col("c_custkey")
    pop = 100 + k % 900
    return table(spark, d, "customer").select("c_custkey", F.round(numeric.pct_to_absolute(k % 90, pop), 6).alias("absolute"), numeric.index_to_absolute(k % 500, pop, 3).alias("per_thousand"))


# ---------------------------------------------------------------- spatial


_NEAR = "(s.x - p.fx) ** 2 + (s.y - p.fy) ** 2"


@query("buffer_count", f"select s.id, count(p.fid) as n, count(distinct p.line) as n_lines, round(min(sqrt({_NEAR})), 4) as nearest_in from {{stations}} s left join {{features}} p on {_NEAR} <= 250000.0 group by s.id")
def buffer_count(spark, d):
    """Features, distinct lines and the nearest of them within 500 m of each station."""
    aggs = [F.count("*").alias("n"), F.count_distinct("line").alias("n_lines"), F.round(F.min("dist"), 4).alias("nearest_in")]
    return spatial.aggregate_within(fx(spark, d, "stations"), fx(spark, d, "features"), 500.0, aggs, ["n", "n_lines"])


@query("unique_lines", f"select s.id, count(distinct p.line) as n_lines from {{nodes}} s left join {{features}} p on {_NEAR} <= 90000.0 group by s.id")
def unique_lines(spark, d):
    f = fx(spark, d, "features").select("fx", "fy", "line").distinct()
    return spatial.aggregate_within(fx(spark, d, "nodes"), f, 300.0, [F.count_distinct("line").alias("n_lines")], ["n_lines"])


@query("category_counts", f"select s.id, count(*) filter (where contains(category, 'STANDARD')) as n_health, count(*) filter (where contains(category, 'ECONOMY')) as n_culture, count(*) filter (where contains(category, 'MEDIUM') or contains(category, 'PROMO')) as n_sport, count(*) filter (where contains(category, 'LARGE')) as n_food from {{stations}} s left join {{features}} p on {_NEAR} <= 160000.0 group by s.id")
def category_counts(spark, d):
    """Twelve-flag style category sums within a buffer, in one aggregate."""
    aggs = [F.sum(f"is_{k}").cast("bigint").alias(f"n_{k}") for k in POI]
    return spatial.aggregate_within(fx(spark, d, "stations"), poi_flags(fx(spark, d, "features")), 400.0, aggs, [f"n_{k}" for k in POI])


@query("nearest_distance", "select id, fid, round(dist, 4) as dist from (select s.id, n.id as fid, sqrt((s.x - n.x) ** 2 + (s.y - n.y) ** 2) as dist, row_number() over (partition by s.id order by (s.x - n.x) ** 2 + (s.y - n.y) ** 2, n.id) as k from {stations} s, {nodes} n) where k = 1")
def nearest_distance(spark, d):
    ensure_checkpoint(spark)
    n = fx(spark, d, "nodes").toDF("fid", "fx", "fy")
    return spatial.nearest(fx(spark, d, "stations"), n, 250.0).select("id", "fid", F.round("dist", 4).alias("dist"))


@query("grid_mean_in_buffer", f"select s.id, round(avg(p.size), 6) as mean_size from {{stations}} s left join {{features}} p on {_NEAR} <= 22500.0 group by s.id")
def grid_mean_in_buffer(spark, d):
    return spatial.aggregate_within(fx(spark, d, "stations"), fx(spark, d, "features"), 150.0, [F.round(F.avg("size"), 6).alias("mean_size")])


@query("point_in_zone", "select n.id, z.zid from {nodes} n left join {zones} z on x >= minx and x < maxx and y >= miny and y < maxy")
def point_in_zone(spark, d):
    return spatial.point_in_box(fx(spark, d, "nodes"), fx(spark, d, "zones"), 2000.0).select("id", "zid")


_BOXD = "greatest(minx - x, 0.0, x - maxx) ** 2 + greatest(miny - y, 0.0, y - maxy) ** 2"


@query("zone_fallback", f"select id, zid from (select n.id, z.zid, row_number() over (partition by n.id order by case when x >= minx and x < maxx and y >= miny and y < maxy then -1.0 else {_BOXD} end, z.zid) as k from {{nodes}} n, {{zones}} z where z.v >= 30) where k = 1")
def zone_fallback(spark, d):
    """Points outside all zones go to the nearest one."""
    z = fx(spark, d, "zones").where("v >= 30")
    return spatial.zone_with_fallback(fx(spark, d, "nodes"), z, 2000.0, 8000.0).select("id", "zid")


@query("points_per_zone", "select z.zid, z.name, count(n.id) as n from {zones} z left join {nodes} n on x >= minx and x < maxx and y >= miny and y < maxy and z.v >= 30 group by all")
def points_per_zone(spark, d):
    z = fx(spark, d, "zones")
    got = spatial.point_in_box(fx(spark, d, "nodes"), z.where("v >= 30"), 2000.0).groupBy("zid").agg(F.count("*").alias("n"))
    return z.select("zid", "name").join(got, "zid", "left").fillna(0, ["n"])


@query("lane_length_in_buffer", f"select id, round(length, 4) as length from {lane_sql('{stations}', 300.0)}")
def lane_length_in_buffer(spark, d):
    """Length of the lanes inside 300 m of each station."""
    out = spatial.line_length_within(fx(spark, d, "stations"), fx(spark, d, "lanes"), 300.0)
    return out.select("id", F.round("length", 4).alias("length"))


@query("lane_flag", f"select id, round(length / 1000, 6) as km, any_line as has_lane from {lane_sql('{nodes}', 150.0)}")
def lane_flag(spark, d):
    """Kilometres of lanes near each node and whether there is one."""
    out = spatial.line_length_within(fx(spark, d, "nodes"), fx(spark, d, "lanes"), 150.0)
    return out.select("id", F.round(F.col("length") / 1000, 6).alias("km"), F.col("any_line").cast("int").alias("has_lane"))


_BUF = "select id, x - 500 as minx, y - 500 as miny, x + 500 as maxx, y + 500 as maxy from {stations}"
_OV = "greatest(0.0, least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * greatest(0.0, least(a.maxy, b.maxy) - greatest(a.miny, b.miny))"


def _boxes(spark, d, half: float) -> DataFrame:
    h = F.lit(float(half))
    return fx(spark, d, "stations").select("id", (F.col("x") - h).alias("minx"), (F.col("y") - h).alias("miny"), (F.col("x") + h).alias("maxx"), (F.col("y") + h).alias("maxy"))


@query("area_weighted_mean", f"select id, round(sum(v * area) / sum(area), 6) as v from (select a.id, case when b.zid % 7 = 0 then null else b.v end as v, {_OV} as area from ({_BUF}) a, {{zones}} b) where area > 0 group by id")
def area_weighted_mean(spark, d):
    """Zone values at stations, weighted by the overlap with a square buffer; null values stay in the denominator."""
    z = fx(spark, d, "zones").select(F.col("zid").alias("bid"), "minx", "miny", "maxx", "maxy", F.when(F.col("zid") % 7 != 0, F.col("v")).alias("v"))
    return spatial.area_weighted_mean(spatial.overlap_pairs(_boxes(spark, d, 500), z, 2000.0), ["v"]).select("id", F.round("v", 6).alias("v"))


@query("circle_weighted_mean", None)
def circle_weighted_mean(spark, d):
    """The same with true circles and polygon rings; tested against analytic areas."""
    z = fx(spark, d, "zones")
    pt = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    z = z.withColumn("ring", F.array(pt("minx", "miny"), pt("maxx", "miny"), pt("maxx", "maxy"), pt("minx", "maxy"), pt("minx", "miny")))
    area = spatial.circle_polygon_area(fx(spark, d, "stations"), z.select("zid", "ring"), 500.0, 2000.0)
    return spatial.area_weighted_mean(area.join(z.select("zid", "v"), "zid"), ["v"])


@query("polygon_zone", "select n.id, z.zid from {nodes} n left join {zones} z on x >= minx and x < maxx and y >= miny and y < maxy and (x - minx) + (y - miny) < 2000 where (cast(x as bigint) % 2000) + (cast(y as bigint) % 2000) <> 2000 and cast(x as bigint) % 2000 <> 0 and cast(y as bigint) % 2000 <> 0")
def polygon_zone(spark, d):
    """Points in triangles by ray casting, without points on an edge."""
    pt = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    z = fx(spark, d, "zones").withColumn("ring", F.array(pt("minx", "miny"), pt("maxx", "miny"), pt("minx", "maxy"), pt("minx", "miny")))
    n = fx(spark, d, "nodes").where("(cast(x as bigint) % 2000) + (cast(y as bigint) % 2000) <> 2000 and cast(x as bigint) % 2000 <> 0 and cast(y as bigint) % 2000 <> 0")
    return spatial.point_in_polygon(n, z, 2000.0).select("id", "zid")


@query("dasymetric_equal", "select bid, round((100 + zone % 37) / count(*) over (partition by zone), 6) as share from {buildings}")
def dasymetric_equal(spark, d):
    b = fx(spark, d, "buildings").withColumn("amount", 100 + F.col("zone") % 37)
    return spatial.dasymetric(b, "zone", "amount").select("bid", F.round("share", 6).alias("share"))


@query("dasymetric_by_area", "select bid, round((100 + zone % 37) * area / sum(area) over (partition by zone), 6) as share from {buildings}")
def dasymetric_by_area(spark, d):
    b = fx(spark, d, "buildings").withColumn("amount", 100 + F.col("zone") % 37)
    return spatial.dasymetric(b, "zone", "amount", "area").select("bid", F.round("share", 6).alias("share"))


@query("buildings_to_nodes", f"select s.id, round(coalesce(sum(share * part), 0), 4) as people from {{stations}} s left join (select a.id, (100 + b.zone % 37) * b.area / sum(b.area) over (partition by a.id, b.zone) as unused, {_OV} / b.area as part, t.share from ({_BUF}) a, {{buildings}} b, (select bid, (100 + zone % 37) * area / sum(area) over (partition by zone) as share from {{buildings}}) t where t.bid = b.bid and {_OV} > 0) using (id) group by s.id")
def buildings_to_nodes(spark, d):
    """Zone counts to buildings by area, then to station buffers by the share of each building inside."""
    b = spatial.dasymetric(fx(spark, d, "buildings").withColumn("amount", 100 + F.col("zone") % 37), "zone", "amount", "area").withColumnRenamed("area", "whole")
    got = spatial.overlap_pairs(_boxes(spark, d, 500), b, 500.0).groupBy("id").agg(F.sum(F.col("share") * F.col("area") / F.col("whole")).alias("people"))
    return fx(spark, d, "stations").select("id").join(got, "id", "left").select("id", F.round(F.coalesce("people", F.lit(0.0)), 4).alias("people"))


@query("cell_density", "select cast(floor(x / 500) as integer) as i, cast(floor(y / 500) as integer) as j, count(*) as n from {nodes} group by all")
def cell_density(spark, d):
    return spatial.cell_density(fx(spark, d, "nodes"), 500.0)


@query("total_bounds", "select min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy from {nodes}")
def total_bounds(spark, d):
    return fx(spark, d, "nodes").agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))


@query("centrality_scores", "with b as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from {nodes}) select id, round(1 - least(sqrt((x - (x0 + x1) / 2) ** 2 + (y - (y0 + y1) / 2) ** 2) / sqrt(((x1 - x0) / 2) ** 2 + ((y1 - y0) / 2) ** 2), 1), 6) as near from {nodes}, b")
def centrality_scores(spark, d):
    n = fx(spark, d, "nodes")
    b = n.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    near, _ = geo.centrality_scores(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return n.join(F.broadcast(b)).select("id", F.round(near, 6).alias("near"))


@query("haversine_slope", "select id, round(h, 3) as dist, round(case when h = 0 then 0 else (id % 40 - 20) / h * 100 end, 6) as slope from (select id, 2 * 6371000.0 * asin(sqrt(sin(radians((y - 5000) / 100000) / 2) ** 2 + cos(radians(41.4)) * cos(radians(41.4 + (y - 5000) / 100000)) * sin(radians((x - 5000) / 100000) / 2) ** 2)) as h from {stations})")
def haversine_slope(spark, d):
    dx, dy = (F.col("x") - 5000) / 100000, (F.col("y") - 5000) / 100000
    h = geo.haversine(F.lit(2.17), F.lit(41.4), F.lit(2.17) + dx, F.lit(41.4) + dy)
    s = fx(spark, d, "stations").withColumn("h", h)
    return s.select("id", F.round("h", 3).alias("dist"), F.round(geo.slope_percent(F.lit(0.0), (F.col("id") % 40 - 20).cast("double"), F.col("h")), 6).alias("slope"))


_GRID = "(select cast(floor(k / 100) as integer) as i, cast(k % 100 as integer) as j, cast((floor(k / 100) * floor(k / 100) * 3 + k % 100 * 7 + floor(k / 100) * (k % 100)) % 101 as double) as altitude from range(10000) t(k))"


@query("grid_slope", f"with g as {_GRID} select a.i, a.j, round(avg(abs(b.altitude - a.altitude) / 50 * 100), 6) as avg_slope, round(max(abs(b.altitude - a.altitude) / 50 * 100), 6) as max_slope from g a join g b on abs(a.i - b.i) + abs(a.j - b.j) = 1 group by a.i, a.j")
def grid_slope(spark, d):
    """Slopes to the four neighbours of a 100 x 100 grid."""
    i, j = F.floor(F.col("id") / 100).cast("int"), (F.col("id") % 100).cast("int")
    g = spark.range(10000).select(i.alias("i"), j.alias("j"), ((i * i * 3 + j * 7 + i * j) % 101).cast("double").alias("altitude"))
    return spatial.grid_slopes(g, 50).select("i", "j", F.round("avg_slope", 6).alias("avg_slope"), F.round("max_slope", 6).alias("max_slope"))


_EL = "select o_orderkey, cast(100 + o_orderkey % 900 as double) as d, cast(o_custkey % 121 - 60 as double) as e from orders"


@query("elevation_piecewise", f"select o_orderkey, round(case when e > 0 then d + e * 8 when e < 0 and e / d * 100 < -12 then d - e * (2000.0 / 300) when e < 0 and e / d * 100 >= -5 then d + e * (2000.0 / 300) else d end, 6) as v from ({_EL})")
def elevation_piecewise(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey", "cast(100 + o_orderkey % 900 as double) as d", "cast(o_custkey % 121 - 60 as double) as e")
    return o.select("o_orderkey", F.round(numeric.elevation_piecewise(F.col("d"), F.col("e")), 6).alias("v"))


@query("elevation_parkin", f"select o_orderkey, round(d / greatest(6.01::double - 40.02::double * greatest(s, 0::double) - 23.79::double * least(s, 0::double), 0.1::double) * 6.01::double, 4) as v from (select *, greatest(least(e / d, 0.1::double), -0.1::double) as s from ({_EL}))")
def elevation_parkin(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey", "cast(100 + o_orderkey % 900 as double) as d", "cast(o_custkey % 121 - 60 as double) as e")
    return o.select("o_orderkey", F.round(numeric.elevation_parkin(F.col("d"), F.col("e")), 4).alias("v"))


# ---------------------------------------------------------------- graph and optimiser


def street_edges(spark, d) -> DataFrame:
    return fx(spark, d, "edges1").unionByName(fx(spark, d, "edges2"))


_EDGES = "(select * from {edges1} union all select * from {edges2})"
_DIST = f"""e as (select src, dst, min(weight) as w from {_EDGES} group by all),
    p(src, dst, d, h) as (select node, node, 0.0::double, 0 from {{gnodes}} union select p.src, e.dst, p.d + e.w, h + 1 from p join e on p.dst = e.src where h < 14),
    dist as (select src, dst, min(d) as d from p group by all)"""


def street_distances(spark, d) -> DataFrame:
    worker_path(spark)
    ensure_checkpoint(spark)
    return graph.shortest_paths(fx(spark, d, "gnodes").select("node"), street_edges(spark, d))


def chosen(spark, d) -> DataFrame:
    return fx(spark, d, "solutions").select("sol", F.explode(F.array("n0", "n1", "n2", "n3")).alias("node")).distinct()


_SOL = "sol as (select distinct sol, node from {solutions} unpivot (node for k in (n0, n1, n2, n3)))"


@query("node_connectivity", "with e as (select * from {edges1} where weight > 6) select node, coalesce(i, 0) as in_degree, coalesce(o, 0) as out_degree, case when i is null and o is null then 'none' when o is null then 'only_in' when i is null then 'only_out' else 'both' end as category from {gnodes} left join (select src as node, count(*) as o from e group by 1) using (node) left join (select dst as node, count(*) as i from e group by 1) using (node)")
def node_connectivity(spark, d):
    return graph.connectivity(fx(spark, d, "gnodes"), fx(spark, d, "edges1").where("weight > 6"))


@query("opposite_edges", "with e as (select src, dst, weight from {edges2}) select src, dst, min(weight) as weight, 'old' as edge_type from e group by all union all select dst, src, min(weight), 'new' from e a where not exists (select 1 from e b where b.src = a.dst and b.dst = a.src) group by all")
def opposite_edges(spark, d):
    out = graph.add_opposite(fx(spark, d, "edges2"))
    return out.groupBy("src", "dst", "edge_type").agg(F.min("weight").alias("weight"))


@query("strong_components", f"with recursive e as (select distinct src, dst from {{edges1}} where weight > 4 union select src, dst from {{edges2}} where weight < 8), r(a, b) as (select node, node from {{gnodes}} union select r.a, e.dst from r join e on r.b = e.src) select x.a as node, min(x.b) as component from r x join r y on x.a = y.b and x.b = y.a group by x.a")
def strong_components(spark, d):
    ensure_checkpoint(spark)
    e = fx(spark, d, "edges1").where("weight > 4").unionByName(fx(spark, d, "edges2").where("weight < 8"))
    return graph.strong_components(fx(spark, d, "gnodes"), e)


@query("edge_elevation", f"select src, dst, weight, round(b.altitude - a.altitude, 2) as elevation from {_EDGES} join {{gnodes}} a on src = a.node join {{gnodes}} b on dst = b.node")
def edge_elevation(spark, d):
    return graph.edge_elevation(street_edges(spark, d), fx(spark, d, "gnodes")).select("src", "dst", "weight", "elevation")


@query("shortest_paths", f"with recursive {_DIST} select src, dst, d from dist")
def shortest_paths(spark, d):
    return street_distances(spark, d).select("src", "dst", "d")


@query("eccentricity_max", f"with recursive {_DIST} select node, sum(d) as total from (select src as node, d from dist union all select dst, d from dist) group by node")
def eccentricity_max(spark, d):
    """Total distance to and from all others, per node."""
    return graph.distance_totals(street_distances(spark, d))


@query("dispersion", f"with recursive {_DIST}, {_SOL} select a.sol, sum(d) as dispersion from sol a join sol b on a.sol = b.sol join dist on src = a.node and dst = b.node group by a.sol")
def dispersion(spark, d):
    return graph.dispersion(street_distances(spark, d), chosen(spark, d))


_TRIP = "trip as (select x.src, x.dst, x.d + y.d as rt from dist x join dist y on x.src = y.dst and x.dst = y.src)"
_ACC = "acc as (select sol, sum(m) as accessibility from (select s.sol, n.node, min(rt) as m from (select distinct sol from sol) s, {gnodes} n, sol t, trip where not exists (select 1 from sol z where z.sol = s.sol and z.node = n.node) and t.sol = s.sol and trip.src = n.node and trip.dst = t.node group by all) group by sol)"


@query("accessibility", f"with recursive {_DIST}, {_SOL}, {_TRIP}, {_ACC} select sol, accessibility from acc")
def accessibility(spark, d):
    return graph.accessibility(street_distances(spark, d), chosen(spark, d))


@query("solution_scores", f"with recursive {_DIST}, {_SOL}, {_TRIP}, {_ACC}, dsp as (select a.sol, sum(d) as dispersion from sol a join sol b on a.sol = b.sol join dist on src = a.node and dst = b.node group by a.sol), ns as (select sol, sum(norm_score) as s from sol join {{gnodes}} using (node) group by sol) select sol, round(s * (0.3 * (1 - (dispersion - 50) / 350) + 0.7 * (1 - (accessibility - 100) / 900)), 6) as score from dsp join acc using (sol) join ns using (sol)")
def solution_scores(spark, d):
    """Node score times graph score of every solution."""
    out = optimize.fitness(chosen(spark, d), fx(spark, d, "gnodes").withColumn("norm_score", F.col("norm_score").cast("double")), street_distances(spark, d), 0.3, (50, 400), (100, 1000))
    return out.select("sol", F.round("score", 6).alias("score"))


@query("solution_validate", f"with recursive {_DIST}, {_SOL}, c as (select a.sol, count(*) as n_conflicts from sol a join sol b on a.sol = b.sol and a.node < b.node where exists (select 1 from dist where d < 12 and ((src = a.node and dst = b.node) or (src = b.node and dst = a.node))) group by a.sol) select sol, count(*) as n, coalesce(max(n_conflicts), 0) as n_conflicts, count(*) = 4 and coalesce(max(n_conflicts), 0) = 0 as valid from sol left join c using (sol) group by sol")
def solution_validate(spark, d):
    return optimize.validate(chosen(spark, d), street_distances(spark, d), 4, 12).select("sol", "n", "n_conflicts", "valid")


@query("population_diversity", "with s as (select sol, list_sort(list_distinct([n0, n1, n2, n3])) as nodes from {solutions}) select count(*) as n_pairs, round(avg(1 - len(list_intersect(a.nodes, b.nodes)) * 1.0 / len(list_distinct(list_concat(a.nodes, b.nodes)))), 6) as diversity from s a join s b on a.sol < b.sol")
def population_diversity(spark, d):
    p = fx(spark, d, "solutions").select("sol", F.array_distinct(F.array("n0", "n1", "n2", "n3")).alias("nodes"))
    return optimize.diversity(p).select("n_pairs", F.round("diversity", 6).alias("diversity"))


@query("greedy_topn", "select node, round(norm_score, 6) as norm_score from {gnodes} order by norm_score desc, node limit 8")
def greedy_topn(spark, d):
    return optimize.greedy_top(fx(spark, d, "gnodes"), 8).select("node", F.round(F.col("norm_score").cast("double"), 6).alias("norm_score"))


@query("weight_lattice", "select a / 10.0::double as w1, b / 10.0::double as w2, (10 - a - b) / 10.0::double as w3 from range(11) x(a), range(11) y(b) where a + b <= 10")
def weight_lattice(spark, d):
    return optimize.weight_lattice(spark, 10)


@query("exploration_metrics", "with v as (select distinct cast(floor(event_id % 40) as integer) as gen, user_id as node from events), f as (select node, min(gen) as gen from v group by node) select gen, n_nodes, coalesce(n_new, 0) as n_new, cast(sum(coalesce(n_new, 0)) over (order by gen) as bigint) as cum_nodes from (select gen, count(*) as n_nodes from v group by gen) left join (select gen, count(*) as n_new from f group by gen) using (gen)")
def exploration_metrics(spark, d):
    v = table(spark, d, "events").select((F.col("event_id") % 40).cast("int").alias("gen"), F.col("user_id").alias("node"))
    return optimize.exploration(v)


def _search(spark, d) -> optimize.Search:
    nodes = fx(spark, d, "gnodes").withColumn("norm_score", F.col("norm_score").cast("double"))
    dist = street_distances(spark, d)
    return optimize.Search(nodes, optimize.conflicts(dist, 6), dist)


@query("population_random", None)
def population_random(spark, d):
    """Random feasible solutions, one seed each."""
    worker_path(spark)
    return optimize.population(spark, _search(spark, d), 40, 5)


@query("ga_run", None)
def ga_run(spark, d):
    """Best solution of a seeded genetic search next to the exact and the greedy one, by node scores, and the best by node and graph score."""
    s = _search(spark, d)
    both, steps = optimize.genetic(s, 5, seed=1, score=s.scorer(0.5, *s.bounds(5)), selection="roulette")
    best, history = optimize.genetic(s, 5, seed=1)
    rows = [("genetic", [int(x) for x in best], history[-1])] + [(n, [int(s.ids[i]) for i in c], float(s.score[c].sum())) for n, c in (("greedy", s.greedy(5)), ("exact", s.exact(5)))]
    rows.append(("genetic_graph", [int(x) for x in both], steps[-1]))
    return spark.createDataFrame(rows, "method string, nodes array<long>, score double")


@query("ga_grid_search", None)
def ga_grid_search(spark, d):
    worker_path(spark)
    return optimize.grid_search(spark, _search(spark, d), 5, {"population_size": [10, 20], "elite": [0.2, 0.3], "rate": [0.05, 0.2], "generations": [10]}, alpha=0.5)


_VARIABLES = ("altitude", "norm_score", "degree")


def _variables(spark, d, s: optimize.Search):
    """A row per candidate, in its order."""
    import numpy as np

    n = {r["node"]: (r["altitude"], float(r["norm_score"]), float(r["node"] % 5)) for r in fx(spark, d, "gnodes").collect()}
    return np.array([n[int(i)] for i in s.ids])


@query("alpha_screening", None)
def alpha_screening(spark, d):
    """Searches for two scenarios of weights and three alphas, with one node that has to be in; tested against exact search."""
    worker_path(spark)
    s = _search(spark, d)
    scenarios = {"demand": {"altitude": 0.4, "norm_score": 0.6}, "access": {"degree": 0.7, "norm_score": 0.3}}
    return optimize.screen(spark, s, _variables(spark, d, s), list(_VARIABLES), scenarios, [0.0, 0.5, 1.0], 4, [3], generations=15)


@query("variable_ranking", None)
def variable_ranking(spark, d):
    """Variables by the dispersion of the exact solution that each of them alone gives."""
    s = _search(spark, d)
    return optimize.rank_variables(spark, s, _variables(spark, d, s), list(_VARIABLES), 4)


@query("metric_bounds", None)
def metric_bounds(spark, d):
    """Estimated bounds of both graph metrics; tested against enumeration."""
    s = _search(spark, d)
    disp, acc = s.bounds(4)
    return spark.createDataFrame([("dispersion", *disp), ("accessibility", *acc)], "metric string, low double, high double")


@query("random_weights", None)
def random_weights(spark, d):
    return optimize.random_weights(spark, ["bus", "metro", "lanes"], 50)


@query("centralities", None)
def centralities(spark, d):
    worker_path(spark)
    return graph.centralities(fx(spark, d, "gnodes").select("node"), street_edges(spark, d))


@query("synthetic_demand", None)
def synthetic_demand(spark, d):
    """Node scores of four strategies: uniform by hash, near the centre, far from it, plateaus of communities."""
    n = fx(spark, d, "gnodes").select("node", (F.col("node") % 5).cast("double").alias("x"), F.floor(F.col("node") / 5).cast("double").alias("y"))
    b = n.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    near, far = geo.centrality_scores(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    uniform = F.pmod(F.xxhash64("node", F.lit("uniform")), F.lit(1_000_003)) / 1_000_002.0
    out = n.join(F.broadcast(b)).select("node", uniform.alias("uniform"), near.alias("distance"), far.alias("inverse"))
    return out.join(graph.communities(fx(spark, d, "gnodes"), street_edges(spark, d)).select("node", F.col("plateau").alias("community")), "node")


@query("communities", None)
def communities(spark, d):
    return graph.communities(fx(spark, d, "gnodes"), street_edges(spark, d))


# ---------------------------------------------------------------- models


def _model_table(spark, d) -> DataFrame:
    s = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("balance"), (F.col("c_custkey") % 31).cast("double").alias("a"), (F.col("c_custkey") % 7).cast("double").alias("b"))
    return s.withColumn("target", F.col("a") * 2 - F.col("b") + F.col("balance") / 1000)


@query("cv_metrics", "with f as (select cast(k % 5 as integer) as fold, price as y, quantity as x from {lines}), m as (select t.fold, regr_slope(f.y, f.x) as s, regr_intercept(f.y, f.x) as i from (select distinct fold from f) t join f on f.fold <> t.fold group by t.fold) select round(avg(rmse), 2) as rmse_mean, round(stddev_pop(rmse), 2) as rmse_std from (select f.fold, sqrt(avg((y - s * x - i) ** 2)) as rmse from f join m using (fold) group by f.fold)")
def cv_metrics(spark, d):
    """Five-fold error of one-feature least squares: all folds' fits come from one pass over per-fold sums."""
    t = fx(spark, d, "lines").select((F.col("k") % 5).cast("int").alias("fold"), F.col("price").alias("y"), F.col("quantity").alias("x"))
    s = t.groupBy("fold").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    whole = s.agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "sx", "sy", "sxx", "sxy")])  # one row
    o = s.join(F.broadcast(whole)).select("fold", *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    o = o.withColumn("s", slope).select("fold", "s", ((F.col("sy") - F.col("s") * F.col("sx")) / F.col("n")).alias("i"))
    e = stats.errors(t.join(F.broadcast(o), "fold").withColumn("p", F.col("s") * F.col("x") + F.col("i")), "y", "p", ["fold"])
    return e.agg(F.round(F.avg("rmse"), 2).alias("rmse_mean"), F.round(F.stddev_pop("rmse"), 2).alias("rmse_std"))


@query("out_of_fold", None)
def out_of_fold(spark, d):
    return ml.out_of_fold(_model_table(spark, d), "c_custkey", ["a", "b", "balance"], "target", "linear_regression", 3)


@query("model_comparison", None)
def model_comparison(spark, d):
    return ml.compare_models(_model_table(spark, d), "c_custkey", ["a", "b", "balance"], "target", ["linear_regression", "elastic_net"], 3)


@query("rf_importance", None)
def rf_importance(spark, d):
    return ml.importance(_model_table(spark, d), ["a", "b", "balance"], "target", "random_forest")


@query("feature_ablation", None)
def feature_ablation(spark, d):
    return ml.ablation(_model_table(spark, d), "c_custkey", "target", {"all": ["a", "b", "balance"], "no_b": ["a", "balance"]}, ["linear_regression"], 3)


@query("kmeans_nodes", None)
def kmeans_nodes(spark, d):
    return ml.representative_nodes(fx(spark, d, "nodes").withColumnRenamed("id", "node"), 8)
