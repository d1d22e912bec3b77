"""Every query with a SQL twin against DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tessaro.operators import spatial
from tessaro.plans import builds, files_catalogue  # noqa: F401 - they register their queries
from tessaro.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(x):
    if x is None or isinstance(x, (bool, str)):
        return x
    return float(x) + 0.0


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, con, name):
    df = QUERIES[name](spark, SF)
    r = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(([plain(row[columns.index(c)]) for c in sorted(columns)] for row in r.fetchall()), key=repr)
    got = sorted(([plain(row[c]) for c in sorted(columns)] for row in df.collect()), key=repr)
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def test_poi_entropy_counts_every_category(spark, tmp_path):
    part = spark.range(512).selectExpr("id as p_partkey", "'b' as p_brand", "concat('t', id) as p_type", "1 as p_size")
    part.write.parquet(str(tmp_path / "part.parquet"))
    assert [tuple(r) for r in QUERIES["poi_entropy"](spark, str(tmp_path)).select("line", "n", "entropy").collect()] == [("b", 512, 9.0)]


def test_every_query_has_a_twin_or_a_test():
    """Queries without SQL are tested against plain loops in test_builds.py; the list is complete."""
    tested = "alpha_screening censored_impute centralities circle_weighted_mean communities dimension_means feature_ablation ga_grid_search ga_run kmeans_nodes metric_bounds model_comparison normalize_boxcox out_of_fold population_random random_weights rf_importance sampled_paths synthetic_demand variable_ranking vif_many"
    assert set(QUERIES) - set(ORACLE_SQL) == set(tested.split())


def test_searches_and_forests_run(spark):
    rows = {r["method"]: r for r in QUERIES["ga_run"](spark, SF).collect()}
    assert rows["genetic"]["score"] <= rows["exact"]["score"] + 1e-9 and len(set(rows["genetic_graph"]["nodes"])) == 5
    grid = QUERIES["ga_grid_search"](spark, SF).collect()
    assert len(grid) == 8 and all(len(set(r["nodes"])) == 5 for r in grid)
    forest = QUERIES["rf_importance"](spark, SF).collect()
    assert sum(r["importance"] for r in forest) == pytest.approx(1) and forest[0]["feature"] == "a"


@pytest.mark.parametrize("move, tie", [(0.1, 0), (-0.1, 0), (-0.002, 0), (0.1, 1)])
def test_summary_metrics_of_weak_correlations(spark, tmp_path, move, tie):
    """Coefficients below 0.001 are written without an exponent, those that round to 0 from below as -0.0; of equal features the first name counts."""
    price = lambda k: float(k // 2 % 2)
    other = lambda k: price(k) if tie else float(k // 4 % 2)
    rows = [(k, k % 2 + (move if k == 2 else 0.0), price(k), other(k), other(k)) for k in range(400)]
    cols = "l_orderkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "lineitem.parquet"))
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = dict(c.execute(ORACLE_SQL["summary_metrics"]).fetchall())
    assert {r["metric"]: r["value"] for r in QUERIES["summary_metrics"](spark, str(tmp_path)).collect()} == want


def test_unique_lines_pairs_places_with_distinct_features(spark, tmp_path, monkeypatch):
    """3,000 points and 3,000 features on 30 places with 5 lines: each place meets each line of a place once."""
    made, real = [], spatial.meet_on_grid
    monkeypatch.setattr(spatial, "meet_on_grid", lambda *sides: made.append(real(*sides)) or made[-1])
    t = spark.range(3000).selectExpr("id % 30 + 10000 * (id div 30) as k", "concat('b', id % 7 * (id div 30) % 5) as p_brand", "'t' as p_type", "1 as p_size")
    t.selectExpr("k as c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    t.withColumnRenamed("k", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(tuple(r) for r in QUERIES["unique_lines"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    for name in ("customer", "part"):
        c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(c.execute(ORACLE_SQL["unique_lines"]).fetchall())
    assert made[0].count() <= 30 * 30 * 5


def test_node_attributes_are_made_per_place(spark, tmp_path, monkeypatch):
    """900 nodes and 900 features on 30 places: no join makes a row per node, and the table equals the SQL."""
    made, real = [], spatial.meet_on_grid
    monkeypatch.setattr(spatial, "meet_on_grid", lambda *sides: made.append(real(*sides)) or made[-1])
    t = spark.range(900).selectExpr("id % 30 + 10000 * (id div 30) as k", "id")
    t.selectExpr("k as c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    part = t.selectExpr("k as p_partkey", "concat('b', id % 7) as p_brand", "elt(1 + id % 4, 'STANDARD', 'ECONOMY', 'PROMO', 'LARGE') as p_type", "cast(1 + id % 3 as int) as p_size")
    part.write.parquet(str(tmp_path / "part.parquet"))
    t.where("id < 60").selectExpr("k as o_orderkey", "id as o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.read.parquet(f"{SF}/nation.parquet").write.parquet(str(tmp_path / "nation.parquet"))
    df = QUERIES["node_attributes"](spark, str(tmp_path))
    c = duckdb.connect()
    for name in ("customer", "part", "orders", "nation"):
        c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    r = c.execute(ORACLE_SQL["node_attributes"] + " order by id")
    columns = [x[0] for x in r.description]
    got = df.select(*columns).orderBy("id").collect()
    want = r.fetchall()
    assert len(got) == len(want) == 900
    assert all(same(plain(x), plain(y)) for a, b in zip(got, want) for x, y in zip(a, b))
    assert len(made) == 6 and max(m.count() for m in made) <= 30 * 30 * 7
