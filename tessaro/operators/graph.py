"""Directed street graphs as tables: nodes (node), edges (src, dst, weight)."""

from __future__ import annotations

import heapq
import itertools
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Edges up to which a graph is worked on in one process (a few hundred MB).
LOCAL_EDGES = 1_000_000
#: Edges that labels travel between two checkpoints.
HOPS = 4


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, category): none, only_in, only_out or both."""
    o = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    i = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    out = nodes.select("node").join(o, "node", "left").join(i, "node", "left").fillna(0)
    kind = F.when((F.col("in_degree") == 0) & (F.col("out_degree") == 0), "none").when(F.col("out_degree") == 0, "only_in").when(F.col("in_degree") == 0, "only_out").otherwise("both")
    return out.select("node", "in_degree", "out_degree", kind.alias("category"))


def add_opposite(edges: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Edges with the missing opposite directions, edge_type ``new``; only those at nodes of ``only`` if given."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    if only is not None:
        back = back.join(only.select(F.col("node").alias("src")), "src", "left_semi")
    missing = back.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    return edges.select("src", "dst", "weight", F.lit("old").alias("edge_type")).unionByName(missing.select("src", "dst", "weight", F.lit("new").alias("edge_type")))


def edge_elevation(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with elevation = altitude(dst) - altitude(src), two decimals; missing altitudes are 0."""
    alt = nodes.select("node", F.coalesce("altitude", F.lit(0.0)).alias("alt"))
    a, b = alt.select(F.col("node").alias("src"), F.col("alt").alias("_a")), alt.select(F.col("node").alias("dst"), F.col("alt").alias("_b"))
    return edges.join(a, "src").join(b, "dst").withColumn("elevation", F.round(F.col("_b") - F.col("_a"), 2)).drop("_a", "_b")


def _rounds(limit: int | None) -> Iterator[int]:
    """Rounds without end; an error after ``limit`` of them, as what is there then is not the result."""
    yield from itertools.count() if limit is None else range(limit)
    raise RuntimeError(f"no result after {limit} rounds")


def _reach(nodes: DataFrame, edges: DataFrame, rounds: int | None, forward: bool) -> DataFrame:
    """(node, label): the smallest node that reaches each node (or that each node reaches)."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    hop = edges.select(F.col(a).alias("from"), F.col(b).alias("node")).distinct()
    labels = nodes.select("node", F.col("node").alias("label"))
    hop = hop.persist()
    for _ in _rounds(rounds):
        new = labels.select("node", "label", F.col("label").alias("was"))
        for _ in range(HOPS):
            sent = hop.join(new.select(F.col("node").alias("from"), "label"), "from").select("node", "label", F.lit(None).cast("long").alias("was"))
            new = new.unionByName(sent).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        new = new.checkpoint()
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            break
    hop.unpersist()
    return labels


def _small(edges: DataFrame) -> bool:
    """Whether a graph may go to one process: at most ``LOCAL_EDGES`` edges."""
    return edges.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES


def _adjacency(edges: DataFrame) -> dict:
    """source -> [(target, smallest weight)]; for graphs that are :func:`_small`."""
    adj: dict = defaultdict(list)
    for r in edges.groupBy("src", "dst").agg(F.min("weight").cast("double").alias("w")).collect():
        adj[r["src"]].append((r["dst"], r["w"]))
    return dict(adj)


def _tarjan(vertices: list, adj: dict) -> dict:
    """vertex -> smallest vertex of its strongly connected component, without recursion."""
    index, low, stack, inside, out = {}, {}, [], set(), {}
    for root in vertices:
        if root in index:
            continue
        todo = [(root, iter(adj.get(root, ())))]
        index[root] = low[root] = len(index)
        stack.append(root)
        inside.add(root)
        while todo:
            v, rest = todo[-1]
            for w, _ in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    inside.add(w)
                    todo.append((w, iter(adj.get(w, ()))))
                    break
                if w in inside:
                    low[v] = min(low[v], index[w])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(stack.pop())
                        inside.discard(part[-1])
                    out.update(dict.fromkeys(part, min(part)))
    return out


def strong_components(nodes: DataFrame, edges: DataFrame, rounds: int | None = None, local: bool | None = None) -> DataFrame:
    """(node, component): strongly connected components, named by their smallest node.

    A graph with few edges and nodes is one linear pass on the driver; beyond that (or with
    ``local=False``) the work stays distributed:
    Forward and backward minima; nodes with the same pair of minima where both
    are the same node are a component, and the others go round again. Rounds
    end when nothing changes; a limit, if given, raises. Needs a checkpoint folder.
    """
    if local or (local is None and _small(edges) and nodes.select("node").distinct().limit(2 * LOCAL_EDGES + 1).count() <= 2 * LOCAL_EDGES):
        e = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
        vertices = sorted(r[0] for r in nodes.select("node").distinct().collect())
        found = _tarjan(vertices, _adjacency(e))
        return nodes.sparkSession.createDataFrame([(v, found[v]) for v in vertices], "node long, component long")
    done, rest = None, nodes.select("node")
    while True:
        inner = edges.join(rest.withColumnRenamed("node", "src"), "src", "left_semi").join(rest.withColumnRenamed("node", "dst"), "dst", "left_semi")
        f = _reach(rest, inner, rounds, True).withColumnRenamed("label", "f")
        b = _reach(rest, inner, rounds, False).withColumnRenamed("label", "b")
        both = f.join(b, "node").checkpoint()
        now = both.where("f = b").select("node", F.col("f").alias("component"))
        done = now if done is None else done.unionByName(now)
        rest = both.where("f <> b").select("node").checkpoint()
        if rest.isEmpty():
            return done


def join_components(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges plus the reverse of every edge between components that has none, marked reversed."""
    c = components
    e = edges.join(c.select(F.col("node").alias("src"), F.col("component").alias("_a")), "src").join(c.select(F.col("node").alias("dst"), F.col("component").alias("_b")), "dst")
    back = e.where("_a <> _b").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight").join(edges.select("src", "dst"), ["src", "dst"], "left_anti").distinct()
    return edges.select("src", "dst", "weight", F.lit(False).alias("reversed")).unionByName(back.withColumn("reversed", F.lit(True)))


def _dijkstra(adj: dict, source, cutoff: float | None) -> list[tuple]:
    """(target, distance, path) from a source; of paths of equal length the smallest in node order."""
    best, done, heap = {source: 0.0}, [], [(0.0, [source])]
    seen = set()
    while heap:
        d, path = heapq.heappop(heap)
        v = path[-1]
        if v in seen:
            continue
        seen.add(v)
        done.append((v, d, path))
        for w, c in adj.get(v, ()):
            if w not in seen and (cutoff is None or d + c <= cutoff) and d + c <= best.get(w, float("inf")):
                best[w] = d + c
                heapq.heappush(heap, (d + c, [*path, w]))
    return done


def shortest_paths(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, cutoff: float | None = None, rounds: int | None = None, local: bool | None = None) -> DataFrame:
    """(src, dst, d, path): shortest paths from the sources (all nodes if not given), up to ``cutoff``.

    A small graph is broadcast and the sources are spread over the tasks, each
    with Dijkstra's algorithm. Beyond that (or with ``local=False``):
    Min-plus relaxation: each round extends only the paths that improved in the
    last one. With a cutoff the result holds near pairs alone, which is what
    feasibility needs on a large graph. Weights are not negative. Rounds end
    when nothing improves; a limit, if given, raises. Needs a checkpoint folder.
    """
    if local or (local is None and _small(edges)):
        kind = nodes.schema["node"].dataType.simpleString()
        graph = nodes.sparkSession.sparkContext.broadcast(_adjacency(edges))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for s in pdf["node"].tolist():
                    yield pd.DataFrame([(s, *r) for r in _dijkstra(graph.value, s, cutoff)], columns=["src", "dst", "d", "path"])

        start = (sources if sources is not None else nodes).select("node").distinct()
        return start.mapInPandas(search, f"src {kind}, dst {kind}, d double, path array<{kind}>")
    short = edges.groupBy("src", "dst").agg(F.min("weight").cast("double").alias("w"))
    start = (sources if sources is not None else nodes).select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("d"), F.array("node").alias("path"))
    dist = front = start.checkpoint()
    for _ in _rounds(rounds):
        step = front.select("src", F.col("dst").alias("via"), "d", "path").join(short.select(F.col("src").alias("via"), "dst", "w"), "via")
        step = step.select("src", "dst", (F.col("d") + F.col("w")).alias("d"), F.concat("path", F.array("dst")).alias("path"))
        if cutoff is not None:
            step = step.where(F.col("d") <= cutoff)
        step = step.groupBy("src", "dst").agg(F.min(F.struct("d", "path")).alias("b")).select("src", "dst", "b.d", "b.path")
        better = step.join(dist.select("src", "dst", F.col("d").alias("_old")), ["src", "dst"], "left").where("_old is null or d < _old").drop("_old").checkpoint()
        if better.isEmpty():
            return dist
        dist = dist.join(better.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(better).checkpoint()
        front = better


def distance_totals(dist: DataFrame) -> DataFrame:
    """(node, total): sum of the distances to and from all others."""
    both = dist.select(F.col("src").alias("node"), "d").unionByName(dist.select(F.col("dst").alias("node"), "d"))
    return both.groupBy("node").agg(F.sum("d").alias("total"))


def dispersion(dist: DataFrame, solutions: DataFrame) -> DataFrame:
    """(sol, dispersion): the sum of distances over ordered pairs of a solution's nodes. solutions: sol, node."""
    a, b = solutions.select("sol", F.col("node").alias("src")), solutions.select("sol", F.col("node").alias("dst"))
    got = a.join(dist, "src").join(b, ["sol", "dst"]).groupBy("sol").agg(F.sum("d").alias("dispersion"))
    return solutions.select("sol").distinct().join(got, "sol", "left").fillna(0.0)


def accessibility(dist: DataFrame, solutions: DataFrame) -> DataFrame:
    """(sol, accessibility): over the nodes outside a solution, the sum of the smallest round trip to one inside."""
    trip = dist.select("src", "dst", "d").join(dist.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("d").alias("_back")), ["src", "dst"]).select("src", "dst", (F.col("d") + F.col("_back")).alias("rt"))
    got = solutions.select("sol", F.col("node").alias("dst")).join(trip, "dst")
    got = got.join(solutions.select("sol", F.col("node").alias("src")), ["sol", "src"], "left_anti")
    got = got.groupBy("sol", "src").agg(F.min("rt").alias("m")).groupBy("sol").agg(F.sum("m").alias("accessibility"))
    return solutions.select("sol").distinct().join(got, "sol", "left").fillna(0.0)


def centralities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, closeness, betweenness, percolation, eccentricity, degree): Brandes' algorithm per source over a broadcast graph.

    percolation: shares of betweenness weighted by the ``state`` of their source, 1 for all
    nodes if there is no such column.
    The graph itself must fit a task; the sources are spread over all tasks and
    their shares of betweenness are summed by Spark.
    """
    if not _small(edges):
        raise ValueError(f"more than {LOCAL_EDGES} edges: cut the network first")
    graph = nodes.sparkSession.sparkContext.broadcast(_adjacency(edges))
    states = {r[0]: r[1] for r in nodes.select("node", F.col("state").cast("double") if "state" in nodes.columns else F.lit(1.0)).collect()}
    n, total_state = len(states), sum(states.values())

    def brandes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = graph.value
        for pdf in batches:
            out = []
            for s in pdf["node"]:
                dist, sigma, pred, order, done = {s: 0.0}, defaultdict(float, {s: 1.0}), defaultdict(list), [], set()
                heap = [(0.0, s)]
                while heap:
                    d, v = heapq.heappop(heap)
                    if v in done:
                        continue
                    done.add(v)
                    order.append(v)
                    for w, c in g.get(v, ()):
                        if w not in dist or d + c < dist[w]:
                            dist[w], sigma[w], pred[w] = d + c, sigma[v], [v]
                            heapq.heappush(heap, (d + c, w))
                        elif d + c == dist[w] and w not in done:
                            sigma[w] += sigma[v]
                            pred[w].append(v)
                delta = defaultdict(float)
                for v in reversed(order):
                    for u in pred[v]:
                        delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
                total, m = sum(dist.values()), len(dist) - 1
                out.append((s, m / total * m / (n - 1) if total and n > 1 else 0.0, 0.0, 0.0, max(dist.values())))
                for v, b in delta.items():
                    if v != s and b:
                        left = total_state - states[v]
                        out.append((v, 0.0, b, b * states[s] / left / (n - 2) if left and n > 2 else 0.0, 0.0))
            yield pd.DataFrame(out, columns=["node", "closeness", "betweenness", "percolation", "eccentricity"])

    kind = nodes.schema["node"].dataType.simpleString()
    parts = nodes.select("node").mapInPandas(brandes, f"node {kind}, closeness double, betweenness double, percolation double, eccentricity double")
    got = parts.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("closeness", "betweenness", "percolation", "eccentricity")])
    deg = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg((F.count("*") / max(n - 1, 1)).alias("degree"))
    return got.join(deg, "node", "left").fillna(0.0, ["degree"])


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, community, plateau) of largest modularity, by Louvain's moves on the undirected graph.

    Communities are numbered from the largest on, ties by their smallest node; plateau
    is the number as 0 to 1. Edges count once however often and whichever way they run.
    The graph must fit one process (``LOCAL_EDGES``).
    """
    if not _small(edges):
        raise ValueError(f"more than {LOCAL_EDGES} edges: cut the network first")
    links = {(min(r["src"], r["dst"]), max(r["src"], r["dst"])) for r in edges.select("src", "dst").distinct().collect()}
    vertices = sorted(r[0] for r in nodes.select("node").distinct().collect())
    parts = sorted(louvain(vertices, links), key=lambda p: (-len(p), min(p)))
    top = max(1, len(parts) - 1)
    rows = [(v, i, i / top) for i, p in enumerate(parts) for v in sorted(p)]
    return nodes.sparkSession.createDataFrame(rows, "node long, community int, plateau double")


def modularity(links: set[tuple], group: dict) -> float:
    """Newman's modularity of a partition of an undirected graph without weights."""
    m = len(links)
    inside, degree = defaultdict(int), defaultdict(int)
    for a, b in links:
        degree[group[a]] += 1
        degree[group[b]] += 1
        inside[group[a]] += group[a] == group[b]
    return sum(inside[g] / m - (degree[g] / (2 * m)) ** 2 for g in degree) if m else 0.0


def louvain(vertices: list, links: set[tuple]) -> list[set]:
    """Sets of vertices: moves of single vertices, then of whole sets, as long as modularity rises."""
    members = {v: {v} for v in vertices}
    weight: dict = {v: defaultdict(float) for v in vertices}
    for a, b in links:
        weight[a][b] += 1
        if a != b:
            weight[b][a] += 1
    total = sum(sum(w.values()) + w.get(v, 0.0) for v, w in weight.items())  # a loop counts twice
    while total:
        group = {v: v for v in weight}
        degree = {v: sum(w.values()) + w.get(v, 0.0) for v, w in weight.items()}
        sums, moved, any_move = dict(degree), True, False
        while moved:
            moved = False
            for v in sorted(weight):
                to = defaultdict(float)
                for u, w in weight[v].items():
                    if u != v:
                        to[group[u]] += w
                sums[group[v]] -= degree[v]
                gain = {g: w - sums[g] * degree[v] / total for g, w in to.items()}
                stay = gain.get(group[v], -sums[group[v]] * degree[v] / total)
                best = max(gain, key=lambda g: (gain[g], -g), default=group[v])
                if gain.get(best, stay) > stay + 1e-12:
                    group[v], moved, any_move = best, True, True
                sums[group[v]] += degree[v]
        if not any_move:
            break
        merged, next_weight = defaultdict(set), defaultdict(lambda: defaultdict(float))
        for v in weight:
            merged[group[v]] |= members[v]
            own = next_weight[group[v]]
            for u, w in weight[v].items():
                if group[u] != group[v]:
                    own[group[u]] += w
                else:
                    own[group[v]] += w if u == v else w / 2
        members, weight = dict(merged), dict(next_weight)
    return list(members.values())


def closest_edges(nodes: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """(src, dst, weight): for nodes (node, x, y) of one direction only, the missing direction to or from the closest other node."""
    from .spatial import nearest

    bad = connectivity(nodes, edges).where("category in ('only_in', 'only_out')").select("node", "category")
    points = nodes.join(bad, "node").select(F.col("node").alias("id"), "x", "y")
    near = nearest(points, nodes.select(F.col("node").alias("fid"), F.col("x").alias("fx"), F.col("y").alias("fy")), cell, exclude_self=True)
    got = near.join(bad.withColumnRenamed("node", "id"), "id").where("fid is not null")
    out = F.col("category") == "only_in"
    return got.select(F.when(out, F.col("id")).otherwise(F.col("fid")).alias("src"), F.when(out, F.col("fid")).otherwise(F.col("id")).alias("dst"), F.col("dist").alias("weight"))


def prepare(nodes: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """(src, dst, weight, edge_type, reversed): the street graph with every dead end opened and its components joined.

    nodes: node, x, y, altitude; edges: src, dst, weight. One-way nodes get an edge
    to or from their closest node (``new``); every edge between components gets its
    reverse. Needs a checkpoint folder.
    """
    new = closest_edges(nodes, edges, cell)
    every = edges.select("src", "dst", "weight", F.lit("old").alias("edge_type")).unionByName(new.select("src", "dst", "weight", F.lit("new").alias("edge_type"))).checkpoint()
    joined = join_components(every, strong_components(nodes, every))
    kinds = every.groupBy("src", "dst", "weight").agg(F.min("edge_type").alias("edge_type"))
    return joined.join(kinds, ["src", "dst", "weight"], "left").select("src", "dst", "weight", F.coalesce("edge_type", F.lit("old")).alias("edge_type"), "reversed").distinct()


def mark_selected(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Nodes with selected 1 or 0."""
    flag = chosen.select("node").distinct().withColumn("selected", F.lit(1))
    return nodes.join(flag, "node", "left").fillna(0, ["selected"])


def selected_distances(dist: DataFrame, solutions: DataFrame) -> DataFrame:
    """(sol, node, other, d_out, d_in) between the nodes of each solution; null where there is no path."""
    a, b = solutions.select("sol", "node"), solutions.select("sol", F.col("node").alias("other"))
    pairs = a.join(b, "sol").where("node <> other")
    out = pairs.join(dist.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.col("d").alias("d_out")), ["node", "other"], "left")
    return out.join(dist.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.col("d").alias("d_in")), ["node", "other"], "left").select("sol", "node", "other", "d_out", "d_in")


def solution_paths(dist: DataFrame, solutions: DataFrame) -> DataFrame:
    """(sol, src, dst, d, path) of every ordered pair of a solution's nodes."""
    a, b = solutions.select("sol", F.col("node").alias("src")), solutions.select("sol", F.col("node").alias("dst"))
    return a.join(dist, "src").join(b, ["sol", "dst"]).where("src <> dst").select("sol", "src", "dst", "d", "path")


def sampled_paths(nodes: DataFrame, edges: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(src, dst, d, path) over a sample of the nodes and the edges between them, taken as undirected.

    The sample is the feature here: the nodes with the smallest hashes, the same at every run.
    """
    few = nodes.select("node").orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(size)
    inner = edges.join(few.withColumnRenamed("node", "src"), "src", "left_semi").join(few.withColumnRenamed("node", "dst"), "dst", "left_semi")
    both = inner.select("src", "dst", "weight").unionByName(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return shortest_paths(few, both)
