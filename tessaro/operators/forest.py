"""Impurity importances of a bagged regression forest: whole trees grown in tasks from binned rows.

Trees split binned features, so a tree sees of its bootstrap rows only their number and
the sum of their targets in each combination of bins. A task streams all rows once, fills
these two sums for each of its trees, and grows the trees from them level by level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a chunk, and the combinations of bins up to which trees are grown here (1 MB per tree).
CHUNK = 65_536
CELLS = 65_536
_PAIR = np.dtype([("cell", "<i4"), ("y", "<f8")])


def thresholds(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """Ascending upper ends of all bins but the last: middles between few distinct values, else quantiles of all rows."""
    out = {}
    for c in columns:
        few = sorted(r[0] for r in df.select(c).distinct().limit(bins + 1).collect())
        if len(few) <= bins:
            out[c] = [(a + b) / 2 for a, b in zip(few, few[1:])]
        else:
            top = df.agg(F.max(c)).first()[0]
            out[c] = sorted({v for v in df.approxQuantile(c, [(i + 1) / bins for i in range(bins - 1)], 0.001) if v < top})
    return out


def grow(n: np.ndarray, s: np.ndarray, codes: list[np.ndarray], sizes: list[int], depth: int, least: int, k: int, rng: np.random.Generator) -> np.ndarray:
    """Each feature's part of what one tree's splits take from the sum of squares.

    n, s: rows and sums of targets per cell; codes: the cells' bins per feature, sizes: the numbers of bins.
    Every node looks at ``k`` features drawn for it, both sides of a split keep ``least`` rows.
    """
    gains, use = np.zeros(len(sizes)), [f for f in range(len(sizes)) if sizes[f] > 1]
    have = np.flatnonzero(n)
    n, s, codes, node, m = n[have], s[have], [c[have] for c in codes], np.zeros(len(have), np.int64), 1
    tiny = 1e-12 * float((s * s / n).sum()) if len(have) else 0.0
    for _ in range(depth):
        if not use or not len(node):
            break
        drawn = np.argsort(rng.random((m, len(use))), axis=1)[:, :k]
        best, feature, cut = np.zeros(m), np.full(m, -1), np.zeros(m, np.int64)
        for i, f in enumerate(use):
            asked = np.flatnonzero((drawn == i).any(axis=1))
            place = np.full(m, -1)
            place[asked] = np.arange(len(asked))
            at = place[node]
            here = at >= 0
            key, shape = at[here] * sizes[f] + codes[f][here], (len(asked), sizes[f])
            left_n = np.bincount(key, n[here], shape[0] * shape[1]).reshape(shape).cumsum(axis=1)
            left_s = np.bincount(key, s[here], shape[0] * shape[1]).reshape(shape).cumsum(axis=1)
            all_n, all_s = left_n[:, -1:], left_s[:, -1:]
            left_n, left_s = left_n[:, :-1], left_s[:, :-1]
            right_n, right_s = all_n - left_n, all_s - left_s
            ok = (left_n >= least) & (right_n >= least)
            gain = np.where(ok, left_s**2 / np.maximum(left_n, 1) + right_s**2 / np.maximum(right_n, 1) - all_s**2 / all_n, -1.0)
            place, most = gain.argmax(axis=1), gain.max(axis=1)
            better = most > np.maximum(best[asked], tiny)
            won = asked[better]
            best[won], feature[won], cut[won] = most[better], f, place[better]
        split = feature >= 0
        gains += np.bincount(feature[split], best[split], len(sizes))
        child = np.cumsum(split) - 1
        go = split[node]
        n, s, codes, node = n[go], s[go], [c[go] for c in codes], node[go]
        own = feature[node]
        code = np.choose(own, codes) if len(codes) < 32 else np.stack(codes)[own, np.arange(len(own))]
        node, m = 2 * child[node] + (code > cut[node]), 2 * int(split.sum())
    return gains


def importances(df: DataFrame, columns: list[str], target: str, trees: int, depth: int, least: int, bins: int, rate: float, k: int, seed: int) -> list[float] | None:
    """The mean of the trees' shares per feature, or None with more than ``CELLS`` combinations of bins.

    df: features and target as doubles without nulls. All rows are read; bootstrap counts are Poisson draws seeded by tree and chunk.
    """
    ends = thresholds(df, columns, bins)
    sizes = [len(ends[c]) + 1 for c in columns]
    cells = int(np.prod([float(b) for b in sizes]))
    if cells > CELLS:
        return None
    mean = df.agg(F.avg(target)).first()[0] or 0.0

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, number = [], 0, TaskContext.get().partitionId() << 32

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["id", "chunk"])

        for b in batches:
            part = np.zeros(b.num_rows, _PAIR)
            for c, size in zip(columns, sizes):
                part["cell"] = part["cell"] * size + np.searchsorted(ends[c], b.column(c).to_numpy(zero_copy_only=False))
            part["y"] = b.column(target).to_numpy(zero_copy_only=False) - mean
            held.append(part)
            rows += len(part)
            if rows >= CHUNK:
                yield packed()
                held, rows, number = [], 0, number + 1
        if rows:
            yield packed()

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for g, i, raw in zip(b.column("g").to_pylist(), b.column("id").to_pylist(), b.column("chunk")):
                rows = np.frombuffer(raw.as_buffer(), _PAIR)
                cell, y = rows["cell"].astype(np.int64), rows["y"].copy()
                for t in range(g, trees, groups):
                    n, s = sums.setdefault(t, (np.zeros(cells), np.zeros(cells)))
                    w = np.random.default_rng([seed, t, i]).poisson(rate, len(y)).astype(np.float64)
                    n += np.bincount(cell, w, cells)
                    s += np.bincount(cell, w * y, cells)
        codes = [c.astype(np.int64) for c in np.unravel_index(np.arange(cells), sizes)]
        for t in sorted(sums):
            got = grow(*sums.pop(t), codes, sizes, depth, least, k, np.random.default_rng([seed, t]))
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()), pa.array([got.tolist()], pa.list_(pa.float64()))], names=["tree", "gains"])

    groups = min(trees, 2 * df.sparkSession.sparkContext.defaultParallelism)
    every = df.select(*columns, target).mapInArrow(chunks, "id long, chunk binary").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = every.repartitionById(groups, F.col("g")).sortWithinPartitions("g", "id")
    found = [np.array(r["gains"]) for r in dealt.mapInArrow(forest, "tree long, gains array<double>").orderBy("tree").collect()]
    whole = sum((g / g.sum() for g in found if g.sum() > 0), np.zeros(len(columns)))
    return (whole / whole.sum() if whole.sum() > 0 else whole).tolist()
