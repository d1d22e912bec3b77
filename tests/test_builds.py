"""Queries that SQL can't express, and composite operators, against plain loops on small tables."""

import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaro.functions import text
from tessaro.operators import forest, graph, ml, normalize, optimize, ranking, relational, spatial, stats, transit
from tessaro.plans import builds, files_catalogue  # noqa: F401 - they register their queries
from tessaro.plans.catalogue import QUERIES, _model_table, fx, street_edges
from tessaro.session import ensure_checkpoint
from tessaro.sources import geometry

SF = "/root/testdata/sf0.001"


def matrix(edges, n, directed=True):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for a, b, w in edges:
        d[a, b] = min(d[a, b], w)
        if not directed:
            d[b, a] = min(d[b, a], w)
    for k in range(n):
        d = np.minimum(d, d[:, k, None] + d[None, k])
    return d


def street(spark):
    return [(r["src"], r["dst"], r["weight"]) for r in street_edges(spark, SF).collect()]


def test_centralities_equal_path_counts(spark):
    edges = street(spark)
    n, w = 25, {}
    for a, b, c in edges:
        w[a, b] = min(c, w.get((a, b), np.inf))
    d = matrix(edges, n)
    order = np.argsort(d, axis=1)
    paths = np.zeros((n, n))
    for s in range(n):
        paths[s, s] = 1
        for v in order[s]:
            if v != s:
                paths[s, v] = sum(paths[s, u] for u in range(n) if (u, v) in w and d[s, u] + w[u, v] == d[s, v])
    got = {r["node"]: r for r in QUERIES["centralities"](spark, SF).collect()}
    for v in range(n):
        between = sum(paths[s, v] * paths[v, t] / paths[s, t] for s in range(n) for t in range(n) if len({s, t, v}) == 3 and d[s, v] + d[v, t] == d[s, t])
        assert got[v]["betweenness"] == pytest.approx(between)
        assert got[v]["percolation"] == pytest.approx(between / ((n - 1) * (n - 2)))
        assert got[v]["closeness"] == pytest.approx((n - 1) / d[v].sum()) and got[v]["eccentricity"] == d[v].max()


def test_sampled_paths_equal_floyd_warshall(spark):
    got = {(r["src"], r["dst"]): r["d"] for r in QUERIES["sampled_paths"](spark, SF).collect()}
    few = {r["node"] for r in fx(spark, SF, "gnodes").orderBy(F.xxhash64("node", F.lit(0)), "node").limit(12).collect()}
    d = matrix([e for e in street(spark) if e[0] in few and e[1] in few], 25, directed=False)
    assert got == {(a, b): d[a, b] for a in few for b in few if np.isfinite(d[a, b])}


def test_synthetic_demand(spark):
    rows = {r["node"]: r for r in QUERIES["synthetic_demand"](spark, SF).collect()}
    plateau = {r["node"]: r["plateau"] for r in QUERIES["communities"](spark, SF).collect()}
    assert len(rows) == 25 and len({r["uniform"] for r in rows.values()}) == 25
    for n, r in rows.items():
        d = np.hypot(n % 5 - 2, n // 5 - 2) / np.hypot(2, 2)
        assert r["distance"] == pytest.approx(1 - d) and r["inverse"] == pytest.approx(d) and r["community"] == plateau[n] and 0 <= r["uniform"] <= 1


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [{items[0]}, *rest]
        for k in range(len(rest)):
            yield [*rest[:k], rest[k] | {items[0]}, *rest[k + 1 :]]


def test_communities_have_the_largest_modularity(spark):
    def value(parts, links):
        return graph.modularity(links, {v: i for i, p in enumerate(parts) for v in p})

    cliques = {(a, b) for base in (0, 4) for a, b in combinations(range(base, base + 4), 2)} | {(3, 4)}
    assert sorted(map(sorted, graph.louvain(list(range(8)), cliques))) == [[0, 1, 2, 3], [4, 5, 6, 7]]
    rng = np.random.default_rng(0)
    ratio = []
    for _ in range(12):
        links = {(int(a), int(b)) for a, b in rng.integers(0, 7, (9, 2)) if a < b}
        best = max(value(p, links) for p in partitions(list(range(7))))
        found = value(graph.louvain(list(range(7)), links), links)
        assert found <= best + 1e-9
        ratio.append(found / best if best > 0 else 1.0)
    assert np.mean(ratio) > 0.95
    rows = QUERIES["communities"](spark, SF).collect()
    assert {r["node"] for r in rows} == set(range(25)) and min(r["plateau"] for r in rows) == 0 and max(r["plateau"] for r in rows) == 1
    empty = graph.communities(spark.range(2).toDF("node"), street_edges(spark, SF).where("false")).collect()
    assert [r["community"] for r in empty] == [0, 1]


def test_scores_of_the_search_equal_the_tables(spark):
    from tessaro.plans import catalogue

    s = catalogue._search(spark, SF)
    dist = catalogue.street_distances(spark, SF)
    sols = [[0, 5, 9, 17], [1, 2, 3, 4], [24, 10, 11, 0]]
    nodes = fx(spark, SF, "gnodes").withColumn("norm_score", F.col("norm_score").cast("double"))
    frame = spark.createDataFrame([(i, n) for i, sol in enumerate(sols) for n in sol], "sol long, node long")
    for how, power in (("multiply", 1.0), ("exponential", 1.0), ("power_penalty", 2.0)):
        want = {r["sol"]: r["score"] for r in optimize.fitness(frame, nodes, dist, 0.3, (50, 400), (100, 1000), how, power).collect()}
        value = s.scorer(0.3, (50, 400), (100, 1000), how, power)
        for i, sol in enumerate(sols):
            assert value([s.at[n] for n in sol]) == pytest.approx(want[i])
    true = optimize.exact_bounds(s.dist, 4)
    (dl, dh), (al, ah) = s.bounds(4)
    assert dl <= true["dispersion"][0] and dh <= true["dispersion"][1] and true["accessibility"][0] <= al <= ah <= true["accessibility"][1]
    got = {r["metric"]: (r["low"], r["high"]) for r in QUERIES["metric_bounds"](spark, SF).collect()}
    assert got == {"dispersion": (dl, dh), "accessibility": (al, ah)}


def feasible(s, size, required=()):
    return [c for c in combinations(range(len(s.ids)), size) if set(required) <= set(c) and not any(b in s.near[a] for a, b in combinations([i for i in c if i not in required], 2))]


def test_screening_and_ranking_against_enumeration(spark):
    from tessaro.plans import catalogue

    s = catalogue._search(spark, SF)
    table = catalogue._variables(spark, SF, s)
    scenarios = {"demand": [0.4, 0.6, 0.0], "access": [0.0, 0.3, 0.7]}
    rows = QUERIES["alpha_screening"](spark, SF).collect()
    assert len(rows) == 6
    for r in rows:
        one = optimize.with_scores(s, table @ np.array(scenarios[r["scenario"]]))
        value = one.scorer(r["alpha"], *one.bounds(4))
        sol = [s.at[n] for n in r["nodes"]]
        assert 3 in r["nodes"] and len(set(sol)) == 4 and value(sol) == pytest.approx(r["best_score"])
        options = [c for c in combinations(range(25), 4) if s.at[3] in c and not any(b in s.near[a] for a, b in combinations(c, 2))]
        best = max(value(list(c)) for c in options)
        assert 0.9 * best <= r["best_score"] <= best + 1e-9
    ranked = QUERIES["variable_ranking"](spark, SF).collect()
    assert [r["dispersion"] for r in ranked] == sorted(r["dispersion"] for r in ranked)
    for r in ranked:
        one = optimize.with_scores(s, table[:, list(catalogue._VARIABLES).index(r["variable"])])
        assert one.score[[s.at[n] for n in r["nodes"]]].sum() == pytest.approx(max(one.score[list(c)].sum() for c in feasible(s, 4)))


def test_parents_crossover_and_stops(spark):
    rng = np.random.default_rng(1)
    picks = [optimize.parents(rng, np.array([0.0, 1.0, 3.0, 0.0]), "roulette") for _ in range(300)]
    assert {x for p in picks for x in p} == {1, 2} and all(a != b for a, b in picks)
    first = [optimize.parents(rng, np.arange(6.0), "tournament")[0] for _ in range(300)]
    assert max(first) == 5 and min(first) >= 1
    with pytest.raises(ValueError):
        optimize.parents(rng, np.ones(3), "luck")
    assert [optimize.segment(n) for n in (10, 20, 50, 60)] == [5, 10, 16, 15]
    nodes = spark.createDataFrame([(i, float(i % 7)) for i in range(12)], "node long, norm_score double")
    s = optimize.Search(nodes, spark.createDataFrame([(0, 1), (1, 0), (5, 6), (6, 5)], "src long, dst long"))
    child = s.crossover(rng, [0, 2, 4, 6], [1, 3, 5, 6], 4, how="segmented", value=lambda sol: float(s.score[sol].sum()))
    assert 6 in child and 5 not in child and len(set(child)) == 4
    _, history = optimize.genetic(s, 3, generations=400, patience=5, seed=3)
    assert len(history) < 400 and history == sorted(history)


def test_quantiles_ranks_and_vif_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)).round(1)
    x[:, 3] += x[:, 0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    q = stats.quantiles(df, ["a", "b"], [0, 0.25, 0.5, 0.9, 1])
    for k, c in enumerate("ab"):
        assert np.allclose(q[c], np.quantile(x[:, k], [0, 0.25, 0.5, 0.9, 1]))
    assert stats.quantiles(df.where("false"), ["a"], [0.5]) == {"a": [None]}
    assert stats.quartile_fences(df.where("false"), "a").first()["iqr"] is None
    got = {r["feature"]: r["vif"] for r in stats.vif(df, list("abcd"), centred=True).collect()}
    inverse = np.linalg.inv(np.corrcoef(x.T))
    assert np.allclose([got[c] for c in "abcd"], np.diag(inverse))
    one = [tuple(r) for r in ranking.mid_ranks(df, ["a", "b"], "r_").select("a", "r_a", "b", "r_b").collect()]
    import pandas as pd

    want = pd.DataFrame(x[:, :2], columns=["a", "b"])
    want = sorted(map(tuple, np.column_stack([want["a"], want["a"].rank(), want["b"], want["b"].rank()]).tolist()))
    assert np.allclose(sorted(one), want)
    vif = {r["feature"]: r["vif"] for r in QUERIES["vif_many"](spark, SF).collect()}
    m = np.array([[r[c] for c in ("quantity", "price", "discount", "tax")] for r in fx(spark, SF, "lines").collect()])
    g = m.T @ m
    assert np.allclose([vif[c] for c in ("quantity", "price", "discount", "tax")], np.diag(g) * np.diag(np.linalg.inv(g)), rtol=1e-5)


def test_boxcox_equals_a_dense_search(spark):
    x = np.array([float(r["p_retailprice"]) for r in spark.read.parquet(f"{SF}/part.parquet").collect()])
    x /= np.exp(np.log(x).mean())  # which changes no likelihood
    lams = np.linspace(-5, 5, 2000)
    best = lams[int(np.argmax([-np.log(np.var(x**la / la)) for la in lams]))]
    df = spark.createDataFrame([(float(v) * 1000,) for v in x], "v double")
    assert normalize.boxcox_lambda(df, "v")[0] == pytest.approx(best, abs=6e-3)
    rows = [r["v"] for r in QUERIES["normalize_boxcox"](spark, SF).collect()]
    y = x**best / best
    assert np.allclose(sorted(rows), sorted((y - y.min()) / (y.max() - y.min())), atol=2e-3)


def test_seeded_draws_are_repeatable(spark):
    one, two = ([tuple(sorted(r["weights"].items())) for r in QUERIES["random_weights"](spark, SF).orderBy("id").collect()] for _ in range(2))
    assert one == two and len(set(one)) == 50 and all(sum(v for _, v in r) == pytest.approx(1) and min(v for _, v in r) >= 0 for r in one)
    for r in QUERIES["censored_impute"](spark, SF).collect():
        assert 0 <= r["v"] <= 5 if r["o_orderkey"] % 9 == 0 else r["v"] == r["o_orderkey"] % 50
    pop = QUERIES["population_random"](spark, SF).collect()
    assert pop and all(len(set(r["nodes"])) == 5 for r in pop)


def test_circle_means_equal_a_fine_grid(spark):
    zones = {r["zid"]: r for r in fx(spark, SF, "zones").collect()}
    step = (np.arange(400) + 0.5) / 400 * 1000 - 500
    gx, gy = np.meshgrid(step, step)
    inside = gx**2 + gy**2 <= 500**2
    got = {r["id"]: r["v"] for r in QUERIES["circle_weighted_mean"](spark, SF).collect()}
    for s in fx(spark, SF, "stations").collect():
        x, y = s["x"] + gx[inside], s["y"] + gy[inside]
        x, y = x[(x >= 0) & (x < 10000) & (y >= 0) & (y < 10000)], y[(x >= 0) & (x < 10000) & (y >= 0) & (y < 10000)]
        zid = (x // 2000 + 5 * (y // 2000)).astype(int)
        assert got[s["id"]] == pytest.approx(np.mean([zones[z]["v"] for z in zid]), abs=0.4)


def test_predictions_equal_least_squares(spark):
    rows = {r["c_custkey"]: r for r in _model_table(spark, SF).collect()}
    got = QUERIES["out_of_fold"](spark, SF).collect()
    assert len(got) == len(rows)
    fold = {r["c_custkey"]: r["fold"] for r in got}
    errors = {}
    for k in set(fold.values()):
        x = {i: [1.0, r["a"], r["b"], r["balance"]] for i, r in rows.items()}
        train = [i for i in rows if fold[i] != k]
        w = np.linalg.lstsq(np.array([x[i] for i in train]), np.array([rows[i]["target"] for i in train]), rcond=None)[0]
        for r in got:
            if r["fold"] == k:
                p = float(np.dot(w, x[r["c_custkey"]]))
                assert r["prediction"] == pytest.approx(p, abs=1e-4) and r["abs_error"] == pytest.approx(abs(r["residual"]))
                errors.setdefault(k, []).append(r["residual"])
    best = QUERIES["model_comparison"](spark, SF).collect()
    assert best[0]["model"] == "linear_regression" and best[0]["cv_rmse_mean"] == pytest.approx(np.mean([np.sqrt(np.mean(np.square(e))) for e in errors.values()]), abs=1e-6)
    less = {r["scenario"]: r["cv_rmse_mean"] for r in QUERIES["feature_ablation"](spark, SF).collect()}
    assert less["all"] < less["no_b"]
    means = QUERIES["dimension_means"](spark, SF).collect()
    assert [r["mean"] for r in means] == sorted((r["mean"] for r in means), reverse=True) and len(means) == 4
    reps = QUERIES["kmeans_nodes"](spark, SF).collect()
    assert len({r["node"] for r in reps}) == len(reps) == 8


def test_one_row_per_key(spark):
    df = spark.createDataFrame([(1, None, "b"), (1, 3, "a"), (1, 3, "c"), (None, 1, "x"), (None, 1, "x")], "k int, v int, s string")
    assert sorted(tuple(r) for r in relational.first_of(df.where("v is not null"), ["k"], [F.col("v")]).collect() if r["k"]) == [(1, 3, "a")]
    assert relational.latest(df, ["k"], "v").where("k = 1").first()["s"] == "b"
    assert relational.first_of(df.where("false"), ["k"], [F.col("v")]).count() == 0
    got = relational.duplicate_rows(df, ["k", "v"]).select("k", "v", "s", "n_rows").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 3, "a", 2), (1, 3, "c", 2), (None, 1, "x", 2), (None, 1, "x", 2)], key=repr)


def test_text_and_places(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert [r[0] for r in spark.createDataFrame([("  Čapek  ﬁn Ώ ",), (None,), (" ",), ("x" * 500 + "É",)], "t string").select(text.normalize_text(F.col("t"))).collect()] == ["capek fin ω", None, None, "x" * 500 + "e"]
    assert one(text.parse_list(F.lit("['L1', 'A_1', 'B2']"))) == ["L1", "A_1", "B2"]
    assert geometry.with_points(spark.createDataFrame([("1", "2"), ("x", "2"), (None, "1")], "coord_x string, coord_y string")).select("x", "y").collect() == [(1.0, 2.0)]
    with pytest.raises(LookupError):
        geometry.with_points(spark.range(1))
    assert geometry.with_points(spark.createDataFrame([], "lon string, lat string")).count() == 0
    p = geometry.with_points(spark.createDataFrame([("POINT (3 45)",), ("no",), (None,)], "geometry string")).select("x", "y").collect()
    assert len(p) == 1 and p[0]["x"] == pytest.approx(500000, abs=1e-3)


def test_growing_buffers_equal_steps(spark):
    steps = spatial.buffer_steps()
    assert steps[:3] == [50, 110, 180] and len(steps) == 46
    areas = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 90.0, 0.0, 130.0, 10.0), (3, 160.0, 160.0, 170.0, 170.0), (4, 20000.0, 0.0, 20001.0, 1.0), (5, 95.0, 0.0, 205.0, 10.0)], "id int, minx double, miny double, maxx double, maxy double")
    zones = spark.createDataFrame([(7, 0.0, 0.0, 100.0, 100.0), (8, 200.0, 0.0, 300.0, 100.0)], "zid int, minx double, miny double, maxx double, maxy double")
    got = {r["id"]: (r["zid"], r["step"]) for r in spatial.assign_with_growing_buffers(areas, zones, 100.0).collect()}
    assert got == {1: (7, 0), 2: (7, 1), 3: (8, 2), 4: (None, None), 5: (7, 2)}
    assert spatial.assign_with_growing_buffers(areas.where("false"), zones, 100.0).count() == 0


def test_transit_edges(spark):
    kind = "type string, id bigint, lat double, lon double, tags map<string,string>, members array<struct<type:string,ref:bigint,role:string>>"
    rows = [
        ("node", 1, 1.0, 1.0, {"highway": "bus_stop", "route_ref": " H1  7 ", "name": "a"}, None), ("node", 2, 2.0, 2.0, {"highway": "bus_stop"}, None), ("node", 3, 3.0, 3.0, None, None),
        ("node", 4, 4.0, 4.0, {"name": "Mill (L2)"}, None), ("node", 5, 5.0, 5.0, {"railway": "subway_entrance", "name": "door"}, None),
        ("relation", 9, None, None, {"route": "subway", "ref": "X"}, [("node", 4, "s"), ("way", 4, "s"), ("node", 3, "s")]), ("relation", 10, None, None, {"name": "Harbour Metro (Metro)"}, [("node", 5, "e")]), ("relation", 11, None, None, None, None),
    ]
    el = spark.createDataFrame(rows, kind)
    assert sorted((r["stop_id"], r["line"]) for r in transit.bus_stops(el).fillna({"line": "-"}).collect()) == [(1, "7"), (1, "H1"), (2, "-")]
    stops = transit.route_stops(el, ["subway"], {"X": "L2"})
    assert [tuple(r) for r in stops.select("line_id", "line", "stop_name").collect()] == [(9, "L2", "Mill (L2)")]
    out = transit.merge_entrances(stops, transit.entrances(el)).collect()
    assert sorted((r["stop_name"], r["entrance_name"], r["line"], r["entrance_id"], r["lat"]) for r in out) == [("Harbour", "door", ["Metro"], 5, 5.0), ("Mill", "Mill", ["L2"], None, 4.0)]
    assert transit.merge_entrances(stops.where("false"), transit.entrances(el.where("false"))).count() == 0


def test_prepared_graph_is_connected(spark):
    ensure_checkpoint(spark)
    rng = np.random.default_rng(5)
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 100, (12, 2)))], "node long, x double, y double")
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(11)], "src long, dst long, weight double")
    got = graph.prepare(nodes, edges, 10.0)
    assert {r["component"] for r in graph.strong_components(nodes, got.select("src", "dst", "weight")).collect()} == {0}
    assert got.where("edge_type = 'new'").count() >= 2


def test_pictures_and_layers(spark, tmp_path):
    import sqlite3
    import struct
    import zlib

    from tessaro.sources import pictures

    df = spark.createDataFrame([(1, 0.0, 0.0, "a<b"), (2, 10.0, 5.0, None), (3, None, 1.0, "no place")], "v int, x double, y double, label string")
    for data, size in ((pictures.bars(df, "v", "v", 60, 30), (60, 30)), (pictures.scatter(df, "x", "y", 50, 40), (50, 40)), (pictures.heat(df, "x", "y", "v", 2), (22, 12))):
        assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == size
        at = data.index(b"IDAT")
        n = struct.unpack(">I", data[at - 4 : at])[0]
        assert len(zlib.decompress(data[at + 4 : at + 4 + n])) == size[1] * (3 * size[0] + 1)
    page = pictures.html_map({"one": df, "none": df.where("false")})
    assert page.count("<circle") == 2 and "a&lt;b" in page and page.count("checkbox") == 2
    path = str(tmp_path / "t.gpkg")
    assert pictures.write_geopackage(df, path, "stations") == 3 and pictures.write_geopackage(df.where("false"), path, "none") == 0
    con = sqlite3.connect(path)
    rows = con.execute("select geom, v, label from stations order by v").fetchall()
    assert [r[1:] for r in rows] == [(1, "a<b"), (2, None), (3, "no place")] and rows[2][0] is None
    assert rows[1][0][:4] == b"GP\x00\x01" and struct.unpack("<dd", rows[1][0][-16:]) == (10.0, 5.0)
    assert con.execute("select table_name, min_x, max_y from gpkg_contents order by 1").fetchall() == [("none", None, None), ("stations", 0.0, 5.0)]
    assert pictures.bars(df.where("false"), "v", "v")[:4] == b"\x89PNG" and pictures.scatter(df.where("false"), "x", "y")[:4] == b"\x89PNG"
    old, pictures.MAX_ROWS = pictures.MAX_ROWS, 1
    with pytest.raises(ValueError):
        pictures.bars(df, "v", "v")
    pictures.MAX_ROWS = old


def test_services(spark):
    from tessaro.session import worker_path
    from tessaro.sources import services

    worker_path(spark)

    def ask(places):
        if any(lat > 2 for lat, _ in places):
            raise OSError("busy")
        return [lat * 10 for lat, _ in places]

    pts = spark.createDataFrame([(i, float(i), 0.0) for i in range(5)], "id int, lat double, lon double").coalesce(1)
    got = {r["id"]: r["altitude"] for r in services.with_elevation(pts, ask, batch=2, tries=2, wait=0.0).collect()}
    assert got == {0: 0.0, 1: 10.0, 2: None, 3: None, 4: None} and services.with_elevation(pts.where("false"), ask).count() == 0
    el = spark.createDataFrame([(1, {"shop": "x"}, "p"), (2, {"shop": "y", "office": "z"}, "p"), (3, None, "p"), (4, {"office": "z"}, "q")], "id int, tags map<string,string>, place string")
    assert {r["id"] for r in services.features_by_tags(el, {"shop": ["x"], "office": True}, "p").collect()} == {1, 2}
    assert {r["id"] for r in services.features_by_tags(el, {"office": True}).collect()} == {2, 4} and services.features_by_tags(el, {}).count() == 0
    want = {"s1": {"population": 0.4, "pois": 0.6}, "s2": {"lines": 1.0}}
    assert services.read_scenarios("# weights\nall:\n  s1: # demand\n    population: 0.4\n    pois: 0.6\n\n  s2:\n    lines: 1\n") == want
    assert services.read_scenarios('{"weight_combinations": {"s1": {"population": 0.4, "pois": 0.6}, "s2": {"lines": 1}}}') == want
    with pytest.raises(ValueError):
        services.read_scenarios("x: 1")


def test_forest_importances_equal_mllib_and_end_in_time(spark):
    data, names = _model_table(spark, SF), ["a", "b", "balance"]
    got = ml.forest_importances(data, names, "target")
    want = ml.pipeline(names, "target", "random_forest").fit(data).stages[-1].featureImportances.toArray()
    assert np.allclose(got, want, atol=0.03) and got == ml.forest_importances(data, names, "target")
    start = time.monotonic()  # 15,000 rows; pyspark.ml doesn't end in 100 s
    rows = QUERIES["rf_importance"](spark, "/root/testdata/sf0.1").collect()
    assert [r["feature"] for r in rows] == ["a", "balance", "b"] and time.monotonic() - start < 60


def test_tree_equals_a_plain_loop():
    rng = np.random.default_rng(3)
    sizes = [4, 3, 5]
    codes = [c.astype(np.int64) for c in np.unravel_index(np.arange(60), sizes)]
    n, y = rng.poisson(1.5, 60).astype(float), rng.normal(size=60)
    want = np.zeros(3)

    def split(cells, depth):
        best = (1e-9, None, None)
        for f in range(3):
            for cut in range(sizes[f] - 1):
                left = cells[codes[f][cells] <= cut]
                right = cells[codes[f][cells] > cut]
                if min(n[left].sum(), n[right].sum()) < 3:
                    continue
                part = [(n[c] @ y[c]) ** 2 / n[c].sum() for c in (left, right, cells)]
                if part[0] + part[1] - part[2] > best[0]:
                    best = (part[0] + part[1] - part[2], f, (left, right))
        if best[1] is not None and depth:
            want[best[1]] += best[0]
            for c in best[2]:
                split(c, depth - 1)

    split(np.arange(60), 30)
    assert np.allclose(forest.grow(n, n * y, codes, sizes, 30, 3, 3, rng), want)
