import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessaro.functions import geo, numeric, text
from tessaro.operators import graph, normalize, optimize, ranking, relational, schema, spatial, stats
from tessaro.session import ensure_checkpoint


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_text(spark):
    assert one(spark, text.normalize_text(F.lit("  Can  Baró "))) == "can baro"
    assert one(spark, text.normalize_text(F.lit("   "))) is None
    for raw, want in (("801902008.0", "0801902008"), ("0801902008", "0801902008"), ("801902008,0", "0801902008"), ("", None), (None, None)):
        assert one(spark, text.normalize_section(F.lit(raw).cast("string"))) == want
    assert one(spark, text.decimal_comma(F.lit("1.234,5"))) == 1234.5
    assert one(spark, text.decimal_comma(F.lit("x"))) is None
    assert one(spark, text.parse_list(F.lit("['L4', 'L2']"))) == ["L4", "L2"]
    assert one(spark, text.parse_list(F.lit("L1"))) == ["L1"]
    assert one(spark, text.zfill(F.lit("12345678901"), 10)) == "12345678901"
    p = one(spark, text.wkt_point(F.lit("POINT (2.5 -1)")))
    assert (p["x"], p["y"]) == (2.5, -1.0)
    assert one(spark, text.wkt_point(F.lit("POINT EMPTY"))) is None
    ring = one(spark, text.wkt_ring(F.lit("POLYGON ((0 0, 4 0, 4 3, 0 0))")))
    assert [(q["x"], q["y"]) for q in ring] == [(0, 0), (4, 0), (4, 3), (0, 0)]
    assert text.clean_header("﻿a ") == "a"


def test_numbers(spark):
    assert [one(spark, numeric.band(F.lit(v))) for v in (20, 20.1, 80, 81)] == ["very_low", "low", "high", "very_high"]
    assert one(spark, numeric.band(F.lit(None).cast("double"))) is None
    assert one(spark, numeric.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, numeric.flag(F.lit(None).cast("int") <= 2)) == 0
    assert one(spark, numeric.weighted_score([(F.lit(None).cast("double"), 0.5), (F.lit(0.4), 0.2)])) == pytest.approx(0.4)
    assert one(spark, numeric.entropy([F.lit(1), F.lit(1), F.lit(0)])) == 1.0
    assert one(spark, numeric.entropy([F.lit(0)])) == 0.0
    assert one(spark, numeric.elevation_piecewise(F.lit(100.0), F.lit(-20.0))) == pytest.approx(100 + 20 * 2000 / 300)
    assert one(spark, numeric.elevation_piecewise(F.lit(100.0), F.lit(-8.0))) == 100.0


def test_geometry(spark):
    L = F.lit
    assert one(spark, geo.segment_in_circle(L(0.0), L(0.0), 1.0, L(-5.0), L(0.0), L(5.0), L(0.0))) == pytest.approx(2.0)
    assert one(spark, geo.segment_in_circle(L(0.0), L(0.0), 1.0, L(3.0), L(3.0), L(3.0), L(3.0))) == 0
    assert one(spark, geo.point_segment_distance(L(0.0), L(2.0), L(-1.0), L(0.0), L(1.0), L(0.0))) == pytest.approx(2.0)
    p = one(spark, geo.utm31(L(3.0), L(45.0)))
    assert p["x"] == pytest.approx(500000, abs=1e-3) and p["y"] == pytest.approx(4982950.4001, abs=1e-3)
    ring = F.array(*[F.struct(L(float(x)).alias("x"), L(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))])
    assert one(spark, geo.point_in_ring(L(1.0), L(1.0), ring)) is True
    assert one(spark, geo.point_in_ring(L(5.0), L(1.0), ring)) is False
    assert one(spark, geo.ring_area(ring)) == 16.0
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 2.0, 2.0)], "id int, x double, y double")
    poly = spark.range(1).select(F.lit(7).alias("zid"), ring.alias("ring"))
    got = {r["id"]: r["area"] for r in spatial.circle_polygon_area(pts, poly, 1.0, 4.0).collect()}
    assert got[1] == pytest.approx(np.pi / 4) and got[2] == pytest.approx(np.pi)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=0, max_size=30))
def test_percentiles_equal_pandas(spark, values):
    df = spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate(values)], "id int, v double")
    s = pd.Series(values, dtype=float)
    n = s.notna().sum()
    want = pd.Series(1.0, s.index).where(s.notna()) if n == 1 else (s.rank() - 1) / max(n - 1, 1)
    got = {r["id"]: r for r in ranking.percentile_scores(df, "id", [("v", "p", True), ("v", "q", False)], 4).collect()}
    rank = {r["id"]: r["k"] for r in ranking.competition_rank(df, "v", "k", 4).collect()}
    for i in s.index:
        assert got[i]["p"] is None if np.isnan(s[i]) else got[i]["p"] == pytest.approx(want[i])
        if n > 1 and not np.isnan(s[i]):
            assert got[i]["q"] == pytest.approx(1 - want[i])
        assert rank[i] is None if np.isnan(s[i]) else rank[i] == s.rank(method="min", ascending=False)[i]


def test_relational(spark):
    df = spark.createDataFrame([(1, None, 2.0, 1), (1, "b", 4.0, 2), (2, "c", None, 3)], "k int, name string, v double, seq int")
    got = {r["k"]: r for r in relational.collapse(df, "k", "seq").collect()}
    assert got[1]["name"] == "b" and got[1]["v"] == 3.0 and got[2]["v"] is None
    ts = spark.createDataFrame([(1, 5, "old"), (1, None, "null wins"), (2, 1, "x")], "k int, ts int, s string")
    assert {r["k"]: r["s"] for r in relational.latest(ts, ["k"], "ts").collect()} == {1: "null wins", 2: "x"}
    assert relational.duplicate_counts(df, ["k"]).first().asDict() == {"rows_in_duplicates": 2, "duplicate_keys": 1, "surplus_rows": 1}
    assert relational.duplicate_counts(df.where("false"), ["k"]).first().asDict() == {"rows_in_duplicates": 0, "duplicate_keys": 0, "surplus_rows": 0}
    nulls = spark.createDataFrame([(None,), (1,)], "k int")
    assert relational.unmatched(nulls, nulls.where("k is null"), ["k"]).collect()[0]["k"] == 1
    assert schema.pick_column(df, ["zzz", "v"]) == "v" and schema.pick_column(df, ["zzz"], False) is None
    assert schema.drop_all_null(df.withColumn("e", F.lit(None).cast("int"))).columns == df.columns


def test_spatial_joins_equal_loops(spark):
    rng = np.random.default_rng(3)
    a, b = rng.uniform(-500, 500, (40, 2)), rng.uniform(-500, 500, (60, 2))
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "id int, x double, y double")
    fts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)], "fid int, fx double, fy double")
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    got = spatial.aggregate_within(pts, fts, 120.0, [F.count("*").alias("n")], ["n"])
    assert {r["id"]: r["n"] for r in got.collect()} == {i: int((d[i] <= 120).sum()) for i in range(40)}
    ensure_checkpoint(spark)
    assert {r["id"]: r["fid"] for r in spatial.nearest(pts, fts, 20.0).collect()} == {i: int(d[i].argmin()) for i in range(40)}
    assert all(r["fid"] is None for r in spatial.nearest(pts, fts.where("false"), 20.0).collect())
    seg = spark.createDataFrame([(float(x), float(y), float(x) + 150, float(y) + 40) for x, y in b], "x1 double, y1 double, x2 double, y2 double")
    lens = {r["id"]: r["length"] for r in spatial.line_length_within(pts, seg, 100.0).collect()}
    t = np.linspace(0, 1, 4001)
    for i in range(10):
        inside = np.hypot(b[:, 0, None] + 150 * t - a[i, 0], b[:, 1, None] + 40 * t - a[i, 1]) <= 100
        assert lens[i] == pytest.approx(inside.mean(1).sum() * np.hypot(150, 40), abs=1.0)


def test_dasymetric_keeps_totals(spark):
    b = spark.createDataFrame([(i, i % 3, 10.0 * (i % 3 + 1), float(i)) for i in range(30)], "bid int, z int, amount double, area double")
    got = spatial.dasymetric(b, "z", "amount", "area").groupBy("z").agg(F.sum("share").alias("s"), F.max("amount").alias("a")).collect()
    assert all(r["s"] == pytest.approx(r["a"]) for r in got)


def test_graph_local_equals_distributed(spark):
    ensure_checkpoint(spark)
    nodes = spark.range(9).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (2, 0, 1.0), (2, 3, 4.0), (3, 4, 1.0), (4, 3, 1.0), (5, 6, 1.0), (0, 3, 9.0)], "src long, dst long, weight double")
    scc = [{r["node"]: r["component"] for r in graph.strong_components(nodes, edges, local=x).collect()} for x in (True, False)]
    assert scc[0] == scc[1] == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8}
    d = [{(r["src"], r["dst"]): r["d"] for r in graph.shortest_paths(nodes, edges, local=x).collect()} for x in (True, False)]
    assert d[0] == d[1] and d[0][0, 3] == 7.0 and (7, 0) not in d[0]
    near = graph.shortest_paths(nodes, edges, cutoff=2.0).collect()
    assert max(r["d"] for r in near) <= 2


def test_graph_limits_lose_nothing(spark, monkeypatch):
    nodes = spark.range(12).toDF("node")
    ring = spark.createDataFrame([(i, (i + 1) % 12, 1.0) for i in range(12)], "src long, dst long, weight double")
    for cut in (lambda: graph.shortest_paths(nodes, ring, rounds=2, local=False), lambda: graph.strong_components(nodes, ring, rounds=1, local=False)):
        with pytest.raises(RuntimeError):
            cut()
    assert {r["component"] for r in graph.strong_components(nodes, ring, local=False).collect()} == {0}
    monkeypatch.setattr(graph, "LOCAL_EDGES", 3)
    assert {r["node"]: r["component"] for r in graph.strong_components(nodes, ring.where("src < 2")).collect()} == {i: i for i in range(12)}


def test_search(spark):
    rng = np.random.default_rng(0)
    nodes = spark.createDataFrame([(i, float(s)) for i, s in enumerate(rng.random(14))], "node long, norm_score double")
    near = spark.createDataFrame([(i, (i * 5 + 1) % 14) for i in range(14)] + [((i * 5 + 1) % 14, i) for i in range(14)], "src long, dst long").where("src <> dst")
    s = optimize.Search(nodes, near)
    from itertools import combinations

    best = max((c for c in combinations(range(14), 4) if not any(b in s.near[a] for a, b in combinations(c, 2))), key=lambda c: s.score[list(c)].sum())
    exact = s.exact(4)
    assert s.score[exact].sum() == pytest.approx(s.score[list(best)].sum())
    assert s.score[s.greedy(4)].sum() <= s.score[exact].sum() + 1e-9
    found, history = optimize.genetic(s, 4, seed=2)
    assert history == sorted(history) and len(set(found)) == 4
    pop = optimize.population(spark, s, 6, 4).collect()
    assert all(len(set(r["nodes"])) == 4 and not any(b in s.near[a] for a, b in combinations(r["nodes"], 2)) for r in pop)


def test_normalizers(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)], "v double")
    for m in normalize.METHODS:
        got = [r["v"] for r in normalize.normalize(df, "v", m).collect()]
        assert min(got) >= 0 and max(got) <= 1
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert {r["v"] for m in ("minmax", "inverted_minmax", "inverted_zscore") for r in normalize.normalize(flat, "v", m).collect()} == {0.0}
    x = np.exp(np.random.default_rng(1).normal(0, 1, 400))
    lam, _ = normalize.boxcox_lambda(spark.createDataFrame([(float(v),) for v in x], "v double"), "v")
    assert abs(lam) < 0.2
    g = stats.vif(spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 1.0, 5.0), (3.0, 5.0, 5.0)], "a double, b double, c double"), ["a", "b", "c"]).collect()
    assert {r["feature"] for r in g} == {"a", "b"}


def test_sources(spark, tmp_path):
    import struct

    from tessaro.sources import files

    (tmp_path / "a.csv").write_text("﻿k ;v\n1;1.234\n2;x\n", encoding="utf-8")
    df = files.read_thousands_csv(spark, str(tmp_path / "a.csv"), ["v"])
    assert df.columns == ["k", "v"] and [r["v"] for r in df.collect()] == [1234, None]
    (tmp_path / "h.csv").write_text('"a,""b, c"""\n"1,""2, x"""\n"a,""b, c"""\n')
    got = files.read_broken_csv(spark, str(tmp_path / "h.csv"))
    assert got.columns == ["a", "b, c"] and sorted(tuple(r) for r in got.collect()) == [("1", "2, x"), ("a", "b, c")]
    (tmp_path / "b.csv").write_text('"a,b,""c d"""\n\n"1,2,""x y"""\n"3"\n')
    got = files.read_broken_csv(spark, str(tmp_path / "b.csv"))
    assert got.columns == ["a", "b", "c d"]
    assert sorted((r[0], r[1]) for r in got.collect()) == [("1", "2"), ("3", None)]
    (tmp_path / "t.px").write_text('STUB="zone";\nHEADING="sex";\nVALUES("zone")="A","B";\nVALUES("sex")="f","m";\nDATA=\n1 2\n3 ".."\n;\n')
    px = files.read_px(spark, str(tmp_path / "t.px"))
    assert {(r["zone"], r["sex"]): r["value"] for r in px.collect()} == {("A", "f"): 1.0, ("A", "m"): 2.0, ("B", "f"): 3.0, ("B", "m"): None}
    body = struct.pack("<i4d2i1i6d", 5, 0, 0, 1, 1, 1, 3, 0, 0, 0, 1, 1, 0, 0)
    (tmp_path / "s.shp").write_bytes(b"\0" * 100 + struct.pack(">ii", 1, len(body) // 2) + body)
    assert [(p["x"], p["y"]) for p in files.read_shapefile(spark, str(tmp_path / "s.shp")).first()["rings"][0]] == [(0, 0), (1, 1), (0, 0)]
    log = str(tmp_path / "log")
    for i in range(2):
        files.append_log(spark.createDataFrame([(0.5, i)], "score double, experiment_idx int"), log)
    assert spark.read.parquet(log).columns[0] == "experiment_idx" and spark.read.parquet(log).count() == 2
    assert files.cached(spark, str(tmp_path / "c"), lambda: spark.range(3)).count() == 3
    assert files.cached(spark, str(tmp_path / "c"), lambda: 1 / 0).count() == 3


@pytest.mark.parametrize("few", [50_000, 60, 0])
def test_points_of_one_place_meet_lanes_once(spark, monkeypatch, few):
    """Pairs are made per place, whichever side is broadcast; a point without a place has no lane."""
    made, real = [], spatial.meet_on_grid
    monkeypatch.setattr(spatial, "FEW", few)
    monkeypatch.setattr(spatial, "meet_on_grid", lambda *sides: made.append(real(*sides)) or made[-1])
    places = [(i * 37.0, i * i * 11.0 % 400) for i in range(80)]
    pts = spark.createDataFrame([(k, *places[k % 80]) for k in range(2400)] + [(9999, None, 5.0)], "id long, x double, y double")
    lanes = [(i * 53.0 % 3000, i * 29.0 % 400, i * 53.0 % 3000 + 60, i * 29.0 % 400 + 45) for i in range(50)]
    got = {r["id"]: (r["length"], r["any_line"]) for r in spatial.line_length_within(pts, spark.createDataFrame(lanes, "x1 double, y1 double, x2 double, y2 double"), 100.0).collect()}
    assert len(got) == 2401 and made[0].count() <= 80 * 50 and got[9999] == (0.0, 0)
    steps = (np.arange(20_000) + 0.5) / 20_000  # plain: points along each lane
    for k, (x, y) in enumerate(places):
        length = sum(75 * (np.hypot(a + 60 * steps - x, b + 45 * steps - y) <= 100).mean() for a, b, _, _ in lanes)
        assert got[k] == got[k + 80] and got[k][0] == pytest.approx(length, abs=0.1) and got[k][1] == (length > 0)
