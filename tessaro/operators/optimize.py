"""Facility location: validation and scoring of solutions in Spark, seeded search in tasks.

Scoring and validating any population are plain joins. The search itself is
order-dependent; it runs in numpy inside tasks, one task per seed, with the
conflicts (pairs closer than the minimum distance) of the candidate nodes. The
candidates of one city are a few thousand nodes; their number is checked.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import combine, mix_metrics, scale
from . import graph

#: Candidate nodes up to which the search takes a broadcast of all of them.
MAX_NODES = 20_000
#: Solutions that are compared in pairs, at most.
MAX_POPULATION = 5_000
#: Conflicting pairs that reach the driver, and nodes whose distances to each other do, at most.
MAX_PAIRS, MAX_MATRIX = 20_000_000, 4_000


def conflicts(dist: DataFrame, minimum: float) -> DataFrame:
    """(src, dst) of different nodes closer than ``minimum`` in either direction, both ways round."""
    near = dist.where((F.col("src") != F.col("dst")) & (F.col("d") < minimum)).select("src", "dst")
    return near.unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def validate(solutions: DataFrame, dist: DataFrame, size: int, minimum: float, required: list[int] = ()) -> DataFrame:
    """(sol, n, n_distinct, n_conflicts, n_required, valid) of (sol, node); pairs of required nodes may conflict."""
    req = F.col("node").isin(list(required)) if required else F.lit(False)
    n = solutions.groupBy("sol").agg(F.count("*").alias("n"), F.count_distinct("node").alias("n_distinct"), F.count_distinct(F.when(req, F.col("node"))).alias("n_required"))
    pairs = solutions.select("sol", F.col("node").alias("src")).distinct().join(conflicts(dist, minimum).where("src < dst"), "src")
    pairs = pairs.join(solutions.select("sol", F.col("node").alias("dst")).distinct(), ["sol", "dst"])
    if required:
        pairs = pairs.where(~(F.col("src").isin(list(required)) & F.col("dst").isin(list(required))))
    bad = pairs.groupBy("sol").agg(F.count("*").alias("n_conflicts"))
    out = n.join(bad, "sol", "left").fillna(0, ["n_conflicts"])
    ok = (F.col("n") == size) & (F.col("n_distinct") == size) & (F.col("n_conflicts") == 0) & (F.col("n_required") == len(set(required)))
    return out.select("sol", "n", "n_distinct", "n_conflicts", "n_required", ok.alias("valid"))


def node_scores(solutions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sol, node_score): the sum of norm_score of a solution's nodes."""
    got = solutions.join(nodes.select("node", "norm_score"), "node", "left")
    return got.groupBy("sol").agg(F.coalesce(F.sum("norm_score"), F.lit(0.0)).alias("node_score"))


def fitness(solutions: DataFrame, nodes: DataFrame, dist: DataFrame, alpha: float, disp_bounds: tuple, acc_bounds: tuple, how: str = "multiply", power: float = 1.0) -> DataFrame:
    """(sol, node_score, dispersion, accessibility, graph_score, score)."""
    out = node_scores(solutions, nodes).join(graph.dispersion(dist, solutions), "sol").join(graph.accessibility(dist, solutions), "sol")
    inv = lambda c, b: F.lit(1.0) - scale(F.col(c), F.lit(float(b[0])), F.lit(float(b[1])))
    out = out.withColumn("graph_score", mix_metrics(inv("dispersion", disp_bounds), inv("accessibility", acc_bounds), alpha))
    return out.withColumn("score", combine(F.col("node_score"), F.col("graph_score"), how, power))


def jaccard_distance(a, b):
    """1 - |A & B| / |A | B| of two array columns; two empty sets are equal."""
    return F.when(F.size(F.array_union(a, b)) == 0, 0.0).otherwise(F.lit(1.0) - F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)))


def diversity(population: DataFrame) -> DataFrame:
    """One row: the mean Jaccard distance over the pairs of a population (sol, nodes) of at most ``MAX_POPULATION``."""
    if population.count() > MAX_POPULATION:
        raise ValueError(f"more than {MAX_POPULATION} solutions: sample the population first")
    a, b = population.select(F.col("sol").alias("a"), F.col("nodes").alias("na")), population.select(F.col("sol").alias("b"), F.col("nodes").alias("nb"))
    return a.join(b, F.col("a") < F.col("b")).agg(F.count("*").alias("n_pairs"), F.coalesce(F.avg(jaccard_distance(F.col("na"), F.col("nb"))), F.lit(0.0)).alias("diversity"))


def exploration(visits: DataFrame) -> DataFrame:
    """(gen, n_nodes, n_new, cum_nodes) of (gen, node): distinct nodes, first seen, seen so far."""
    seen = visits.select("gen", "node").distinct()
    n = seen.groupBy("gen").agg(F.count("*").alias("n_nodes"))
    new = seen.groupBy("node").agg(F.min("gen").alias("gen")).groupBy("gen").agg(F.count("*").alias("n_new"))
    out = n.join(new, "gen", "left").fillna(0, ["n_new"])
    w = Window.orderBy("gen").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per generation
    return out.withColumn("cum_nodes", F.sum("n_new").over(w))


def greedy_top(nodes: DataFrame, n: int) -> DataFrame:
    """The n nodes with the highest score, without constraint."""
    return nodes.orderBy(F.desc("norm_score"), F.asc("node")).limit(n)


class Search:
    """Candidates of one instance as arrays: scores and the neighbours that conflict."""

    def __init__(self, nodes: DataFrame, near: DataFrame, dist: DataFrame | None = None):
        rows = nodes.select("node", "norm_score").orderBy("node").limit(MAX_NODES + 1).collect()
        if len(rows) > MAX_NODES:
            raise ValueError(f"more than {MAX_NODES} candidates: split the area")
        self.ids = np.array([r[0] for r in rows])
        self.score = np.array([float(r[1] or 0) for r in rows])
        at = {int(v): i for i, v in enumerate(self.ids)}
        self.near: list[set[int]] = [set() for _ in rows]
        if near.count() > MAX_PAIRS:
            raise ValueError(f"more than {MAX_PAIRS} conflicting pairs: split the area")
        for a, b in near.toLocalIterator():
            if a in at and b in at:
                self.near[at[a]].add(at[b])
        self.at = at
        self.dist: np.ndarray | None = None
        if dist is not None:
            if len(rows) > MAX_MATRIX:
                raise ValueError(f"more than {MAX_MATRIX} candidates for a distance matrix: split the area")
            self.dist = np.full((len(rows), len(rows)), np.inf)
            for a, b, v in dist.select("src", "dst", "d").toLocalIterator():
                if a in at and b in at:
                    self.dist[at[a], at[b]] = v

    def metrics(self, sol: list[int]) -> tuple[float, float]:
        """(dispersion, accessibility) of a solution, from the matrix."""
        inner = self.dist[np.ix_(sol, sol)]
        rest = np.setdiff1d(np.arange(len(self.ids)), sol)
        trip = self.dist[np.ix_(rest, sol)] + self.dist[np.ix_(sol, rest)].T
        return float(inner[np.isfinite(inner)].sum()), float(sum(x for x in trip.min(1) if np.isfinite(x))) if len(rest) and len(sol) else 0.0

    def scorer(self, alpha: float, disp_bounds: tuple, acc_bounds: tuple, how: str = "multiply", power: float = 1.0):
        """The value of a solution: its node score and graph score combined, as :func:`fitness` has it."""

        def inverted(v: float, b: tuple) -> float:
            return 1.0 - ((v - b[0]) / (b[1] - b[0]) if b[1] != b[0] else 0.0)

        def value(sol: list[int]) -> float:
            disp, acc = self.metrics(sol)
            graph_score = alpha * inverted(disp, disp_bounds) + (1 - alpha) * inverted(acc, acc_bounds)
            node = float(self.score[sol].sum())
            return node * graph_score if how == "multiply" else node**graph_score if how == "exponential" else node * graph_score**power

        return value

    def closest_feasible(self, size: int) -> list[int]:
        """The node of the largest total distance and the feasible nodes closest to it: far from everything else."""
        total = self.dist.sum(0) + self.dist.sum(1)
        first = int(np.argmax(np.where(np.isfinite(total), total, -1)))
        return self.fill([first], np.lexsort((self.ids, self.dist[first])), size)

    def bounds(self, size: int, spread: list[int] | None = None) -> tuple[tuple[float, float], tuple[float, float]]:
        """((min, max) dispersion, (min, max) accessibility) estimates for solutions of ``size``.

        From below N (N - 1) shortest distances, and the accessibility of ``spread``
        (nodes that represent all, else the greedy dispersed choice); from above the greedy dispersed choice and
        the closest feasible nodes.
        """
        apart = self.dist[np.isfinite(self.dist) & (self.dist > 0)]
        wide = greedy_dispersion(np.where(np.isfinite(self.dist), self.dist, 0.0), size)
        low = self.metrics(spread or wide)[1]
        return (min_dispersion_bound(size, float(apart.min()) if len(apart) else 0.0), self.metrics(wide)[0]), (low, max(low, self.metrics(self.closest_feasible(size))[1]))

    def fill(self, chosen: list[int], order, size: int) -> list[int]:
        """Adds feasible nodes in ``order`` until ``size``."""
        banned = set(chosen).union(*(self.near[i] for i in chosen)) if chosen else set()
        for i in order:
            if len(chosen) >= size:
                break
            if i not in banned:
                chosen.append(int(i))
                banned |= self.near[i] | {int(i)}
        return chosen

    def greedy(self, size: int, pool=None) -> list[int]:
        order = np.lexsort((self.ids, -self.score))
        return self.fill([], [i for i in order if pool is None or i in pool], size)

    def random(self, rng, size: int, required: list[int] = (), attempts: int = 50) -> list[int]:
        for _ in range(attempts):
            out = self.fill(list(required), rng.permutation(len(self.ids)), size)
            if len(out) == size:
                return out
        return out

    def crossover(self, rng, a: list[int], b: list[int], size: int, required: list[int] = (), how: str = "greedy", value=None) -> list[int]:
        """A child of the parents' nodes: best first, by weighted chance, the shuffled top quarter first, or segmented.

        Segmented: the first nodes are those that raise ``value`` most, the rest go by score.
        """
        pool = np.array(sorted((set(a) | set(b)) - set(required)), int)
        if how == "segmented":
            start = self.fill_exactly(list(required), pool, segment(size), value or (lambda sol: float(self.score[sol].sum())))
            return self.fill(self.crossover(rng, a, b, size, start), rng.permutation(len(self.ids)), size)
        by_score = pool[np.lexsort((self.ids[pool], -self.score[pool]))]
        if how == "greedy":
            order = by_score
        elif how == "weighted":
            order = pool[np.argsort(rng.exponential(size=len(pool)) / np.maximum(self.score[pool], 1e-9))]
        elif how == "top_first":
            q = max(1, len(pool) // 4)
            order = np.concatenate([rng.permutation(by_score[:q]), rng.permutation(by_score[q:])])
        else:
            raise ValueError(f"unknown crossover: {how}")
        return self.fill(self.fill(list(required), order, size), rng.permutation(len(self.ids)), size)

    def fill_exactly(self, chosen: list[int], pool: np.ndarray, more: int, value) -> list[int]:
        """Adds ``more`` feasible nodes of ``pool``, each the one with which the solution's value is largest."""
        for _ in range(more):
            banned = set(chosen).union(*(self.near[i] for i in chosen)) if chosen else set()
            free = [int(i) for i in pool if i not in banned]
            if not free:
                break
            chosen = [*chosen, max(free, key=lambda i: (value([*chosen, i]), -self.ids[i]))]
        return chosen

    def mutate(self, rng, sol: list[int], rate: float, required: list[int] = (), most: float = 0.2) -> list[int]:
        """Replaces positions by chance, at most a fifth of them, keeping the constraint and the required nodes."""
        hit = [i for i in sol if i not in set(required) and rng.random() < rate][: max(1, int(most * len(sol)))]
        kept = [i for i in sol if i not in hit]
        return self.fill(self.fill(kept, rng.permutation(len(self.ids)), len(sol)), hit, len(sol))

    def exact(self, size: int) -> list[int]:
        """The best feasible choice by branch and bound; for small instances."""
        order = np.lexsort((self.ids, -self.score)).tolist()
        top = self.score[order]
        best, best_sum = self.greedy(size), -np.inf
        if len(best) == size:
            best_sum = self.score[best].sum()
        stack = [(0, [], 0.0, frozenset())]
        while stack:
            k, sol, total, banned = stack.pop()
            if len(sol) == size:
                if total > best_sum + 1e-12:
                    best, best_sum = sol, total
                continue
            need = size - len(sol)
            if k + need > len(order) or total + top[k : k + need].sum() <= best_sum + 1e-12:
                continue
            stack.append((k + 1, sol, total, banned))
            i = order[k]
            if i not in banned:
                stack.append((k + 1, [*sol, i], total + self.score[i], banned | self.near[i]))
        return best


def population(spark: SparkSession, search: Search, count: int, size: int, required: list[int] = (), seed: int = 0) -> DataFrame:
    """(sol, nodes): random feasible solutions, one seed each; those that can't be filled are left out."""
    shared, req = spark.sparkContext.broadcast(search), [search.at[r] for r in required]

    def build(batches):
        s = shared.value
        for pdf in batches:
            rows = [(int(i), s.random(np.random.default_rng([seed, int(i)]), size, req)) for i in pdf["id"]]
            rows = [(i, s.ids[r].tolist()) for i, r in rows if len(r) == size]
            yield pd.DataFrame({"sol": [i for i, _ in rows], "nodes": [r for _, r in rows]})

    return spark.range(count).mapInPandas(build, "sol long, nodes array<long>")


def segment(size: int) -> int:
    """How many nodes of a segmented child are chosen exactly."""
    return size // 2 if size <= 20 else size // 3 if size <= 50 else size // 4


def parents(rng, fit: np.ndarray, selection: str, rivals: int = 5) -> tuple[int, int]:
    """Two places of a population: winners of tournaments, or by chance in proportion to fitness."""
    if selection == "roulette":
        weight = np.clip(fit, 0, None)
        p = weight / weight.sum() if np.count_nonzero(weight) > 1 else None
        a, b = rng.choice(len(fit), 2, replace=len(fit) < 2, p=p)
        return int(a), int(b)
    if selection != "tournament":
        raise ValueError(f"unknown selection: {selection}")
    one = lambda: max(rng.choice(len(fit), min(rivals, len(fit)), replace=False), key=lambda i: fit[i])
    return int(one()), int(one())


def genetic(search: Search, size: int, population_size: int = 20, generations: int = 30, elite: float = 0.2, rate: float = 0.1, patience: int = 300, required: list[int] = (), seed: int = 0, how: str = "greedy", score=None, selection: str = "tournament") -> tuple[list[int], list[float]]:
    """(best nodes, best score so far after each generation) by elites, parents, crossover and mutation.

    Ends early when neither the best nor the average score has risen for ``patience``
    generations. ``elite`` counts parents in pairs: half of that share is kept.
    """
    rng = np.random.default_rng(seed)
    req = [search.at[r] for r in required]
    value = score or (lambda sol: float(search.score[sol].sum()))
    pop = [s for s in (search.random(rng, size, req) for _ in range(population_size)) if len(s) == size]
    if not pop:
        return [], []
    best, top, average, history = pop[0], -np.inf, -np.inf, []
    stale = [0, 0]
    for _ in range(generations):
        fit = np.array([value(s) for s in pop])
        order = np.argsort(-fit, kind="stable")
        stale = [0 if now > seen + 1e-12 else n + 1 for now, seen, n in ((fit[order[0]], top, stale[0]), (fit.mean(), average, stale[1]))]
        if fit[order[0]] > top:
            best, top = pop[order[0]], float(fit[order[0]])
        average = max(average, float(fit.mean()))
        history.append(top)
        if min(stale) >= patience:
            break
        keep = [pop[i] for i in order[: max(1, int(elite * population_size / 2))]]
        children = []
        while len(keep) + len(children) < population_size:
            a, b = (pop[i] for i in parents(rng, fit, selection))
            child = search.mutate(rng, search.crossover(rng, a, b, size, req, how, value), rate, req)
            children.append(child if len(child) == size else a)
        pop = keep + children
    return search.ids[best].tolist(), history


def screen(spark: SparkSession, search: Search, variables: np.ndarray, names: list[str], scenarios: dict[str, dict[str, float]], alphas: list[float], size: int, required: list[int] = (), seed: int = 0, **options) -> DataFrame:
    """(scenario, alpha, best_score, generations, nodes): a search per scenario of variable weights and alpha, one task each.

    variables: a row per candidate of ``search``, in its order. Node scores are the
    weighted sums as 0 to 1; ``required`` nodes are in every solution (an expansion).
    """
    shared = spark.sparkContext.broadcast((search, variables))
    rows = [(s, float(a)) for s in scenarios for a in alphas]

    def run(batches):
        base, table = shared.value
        for pdf in batches:
            out = []
            for s, a in zip(pdf["scenario"], pdf["alpha"]):
                one = with_scores(base, table @ np.array([scenarios[s].get(n, 0.0) for n in names]))
                nodes, history = genetic(one, size, required=list(required), seed=seed, score=one.scorer(a, *one.bounds(size)), **options)
                out.append((s, a, history[-1] if history else None, len(history), nodes))
            yield pd.DataFrame(out, columns=["scenario", "alpha", "best_score", "generations", "nodes"])

    todo = spark.createDataFrame(rows, "scenario string, alpha double").repartition(max(1, len(rows)))
    return todo.mapInPandas(run, "scenario string, alpha double, best_score double, generations int, nodes array<long>")


def with_scores(search: Search, raw: np.ndarray) -> Search:
    """The same instance with other node scores, scaled to 0 to 1."""
    out = object.__new__(Search)
    out.__dict__ |= search.__dict__
    low, high = float(raw.min()), float(raw.max())
    out.score = (raw - low) / (high - low) if high > low else np.zeros(len(raw))
    return out


def rank_variables(spark: SparkSession, search: Search, variables: np.ndarray, names: list[str], size: int) -> DataFrame:
    """(variable, dispersion, accessibility, nodes): the exact solution of each variable alone, the least dispersed first."""
    rows = []
    for k, n in enumerate(names):
        sol = with_scores(search, variables[:, k]).exact(size)
        rows.append((n, *search.metrics(sol), sorted(int(search.ids[i]) for i in sol)))
    rows.sort(key=lambda r: (r[1], r[2], r[0]))
    return spark.createDataFrame(rows, "variable string, dispersion double, accessibility double, nodes array<long>")


def grid_search(spark: SparkSession, search: Search, size: int, grid: dict[str, list], done: DataFrame | None = None, seed: int = 0, alpha: float | None = None) -> DataFrame:
    """(experiment, params, best_score, generations, nodes) of every parameter row that is not in ``done``.

    With ``alpha`` solutions are valued by node and graph score together.
    """
    names = sorted(grid)
    rows = [dict(zip(names, v)) for v in product(*(grid[n] for n in names))]
    rows = [r for r in rows if 0 <= r.get("rate", 0) <= 1 and int(r.get("elite", 0.2) * r.get("population_size", 20)) >= 2]
    keys = [(i, ";".join(f"{n}={r[n]}" for n in names)) for i, r in enumerate(rows)]
    todo = spark.createDataFrame(keys, "experiment int, params string")
    if done is not None:
        todo = todo.join(done.select("params"), "params", "left_anti").select("experiment", "params")
    shared = spark.sparkContext.broadcast(search)

    def run(batches):
        for pdf in batches:
            out = []
            for i, p in zip(pdf["experiment"], pdf["params"]):
                one = shared.value
                score = None if alpha is None else one.scorer(alpha, *one.bounds(size))
                nodes, history = genetic(one, size, seed=seed, score=score, **rows[i])
                out.append((i, p, history[-1] if history else None, len(history), nodes))
            yield pd.DataFrame(out, columns=["experiment", "params", "best_score", "generations", "nodes"])

    return todo.mapInPandas(run, "experiment int, params string, best_score double, generations int, nodes array<long>")


def min_dispersion_bound(size: int, shortest: float) -> float:
    """N (N - 1) ordered pairs at the smallest distance, both ways."""
    return size * (size - 1) / 2 * shortest * 2


def exact_bounds(dist: np.ndarray, size: int) -> dict[str, tuple[float, float]]:
    """(min, max) dispersion and accessibility by enumeration; for small instances."""
    n = len(dist)
    trip = dist + dist.T
    disp, acc = [], []
    for c in combinations(range(n), size):
        c = list(c)
        rest = [i for i in range(n) if i not in c]
        disp.append(dist[np.ix_(c, c)].sum())
        acc.append(trip[np.ix_(rest, c)].min(1).sum() if rest else 0.0)
    return {"dispersion": (min(disp), max(disp)), "accessibility": (min(acc), max(acc))}


def greedy_dispersion(dist: np.ndarray, size: int) -> list[int]:
    """Start at the node with the largest total distance, then always the one farthest from the chosen."""
    trip = dist + dist.T
    chosen = [int(trip.sum(1).argmax())]
    gain = trip[chosen[0]].copy()
    while len(chosen) < size:
        gain[chosen] = -np.inf
        k = int(gain.argmax())
        chosen.append(k)
        gain += trip[k]
    return chosen


def weight_lattice(spark: SparkSession, steps: int = 10) -> DataFrame:
    """(w1, w2, w3): all multiples of 1 / steps that sum to one."""
    n = F.sequence(F.lit(0), F.lit(steps))
    rows = spark.range(1).select(F.explode(n).alias("a")).select("a", F.explode(n).alias("b")).where(F.col("a") + F.col("b") <= steps)
    return rows.select((F.col("a") / steps).alias("w1"), (F.col("b") / steps).alias("w2"), ((steps - F.col("a") - F.col("b")) / steps).alias("w3"))


def random_weights(spark: SparkSession, names: list[str], count: int, seed: int = 0) -> DataFrame:
    """(id, weights): random points of the simplex, the same at every run."""
    u = [-F.log((F.pmod(F.xxhash64("id", F.lit(f"{seed}:{n}")), F.lit(1_000_003)) + 1) / 1_000_004.0) for n in names]
    total = sum(u[1:], u[0])
    return spark.range(count).select("id", F.create_map(*[x for n, c in zip(names, u) for x in (F.lit(n), c / total)]).alias("weights"))
