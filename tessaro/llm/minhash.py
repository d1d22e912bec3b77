"""Near-duplicate documents by min-max hashing, banding and exact confirmation.

Min-max hashing (Ji, Li, Yan, Tian, Zhang) keeps the minimum and the maximum of
each permutation: 64 hash evaluations give a signature of 128 values, an
unbiased estimate of the Jaccard similarity with less variance than 128 minima.
32 bands of 4 values bring pairs together; at a similarity of 0.75 a pair
shares no band with a probability below 6e-6.

Copies with the same set of shingles are one vertex from the start. In each
bucket first all vertices are compared with the smallest one; only vertices
that are then still in different components are compared with each other, in
blocks, so a large group of near copies never gives all its pairs. Links are
confirmed on the full sets, and the components are those of the confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .graph import components
from .storage import materialise
from .tables import join_to_copies, pick

PERMUTATIONS = 64
BANDS = 32
ROWS = 4
#: Vertices of a block; a block pair is one unit of work.
BLOCK = 1024
#: Bytes of members that one task of block pairs gets on average.
PER_TASK = 4 << 20

_MULTIPLIERS = tb.mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each document of a chunk, and n + 1 offsets.

    Fewer than ``k`` words: the whole sequence is the one shingle.
    """
    words = tb.Words(data, offs)
    hashes = words.hashes(lower=True)
    ok = words.starts(k)
    x, doc = words.windows(hashes, k)[ok], words.doc()[ok]
    few = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(few):
        whole = tb.sequences(hashes, words.first)[few]
        x, doc = np.concatenate([x, whole]), np.concatenate([doc, few])
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    x, doc = x[new], doc[new]
    return x, np.searchsorted(doc, np.arange(len(offs)))


def identities(x: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """16 bytes that stand for each document's set; None for an empty one."""
    both = np.empty((len(first) - 1, 2), np.uint64)
    for i, c in enumerate((0x51, 0xA7)):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(x + np.uint64(c)), dtype=np.uint64)])
        both[:, i] = run[first[1:]] - run[first[:-1]]
    return [None if a == b else row.tobytes() for a, b, row in zip(first[:-1].tolist(), first[1:].tolist(), both)]


def signatures(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bands of the sets that begin at ``starts``."""
    n = len(starts)
    low, high = np.empty((PERMUTATIONS, n), np.uint64), np.empty((PERMUTATIONS, n), np.uint64)
    for p in range(PERMUTATIONS):
        y = x * _MULTIPLIERS[p]
        np.minimum.reduceat(y, starts, out=low[p])
        np.maximum.reduceat(y, starts, out=high[p])
    low, high = tb.mix(low), tb.mix(high)
    bands = np.empty((n, BANDS), np.uint64)
    for b in range(BANDS):  # two minima and two maxima, of four permutations
        p = 2 * b
        four = (low[p], low[p + 1], high[(p + 2) % PERMUTATIONS], high[(p + 3) % PERMUTATIONS])
        v = np.full(n, np.uint64(b + 1))
        for part in four:
            v = tb.mix(v * np.uint64(0x9E3779B97F4A7C15) + part)
        bands[:, b] = v
    return bands


def signature_table(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, digest, n_shingles, key (16 bytes), bands of (doc_id, text, digest); the last two null for empty sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in tb.chunks(batch.column(1)):
                x, first = shingle_sets(data, offs, k)
                n = np.diff(first)
                live = np.flatnonzero(n)
                bands: list = [None] * len(n)
                if len(live):
                    for i, r in zip(live.tolist(), signatures(x, first[live]).view(np.int64)):
                        bands[i] = r
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.array(n, pa.int64()),
                        pa.array(identities(x, first), pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "digest", "n_shingles", "key", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"doc_id {kind}, digest long, n_shingles long, key binary, bands array<long>")


def set_table(docs: DataFrame, k: int) -> DataFrame:
    """key, items (the sorted set as bytes) and high (the upper halves of its items) of (text)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in tb.chunks(batch.column(0)):
                x, first = shingle_sets(data, offs, k)
                half = (x >> np.uint64(32)).astype(np.uint32)
                items, high = ([v[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())] for v in (x, half))
                cols = (identities(x, first), items, high)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], names=["key", "items", "high"])

    return docs.mapInArrow(build, "key binary, items binary, high binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                z = np.concatenate([x, y])
                z.sort()
                both = int(np.count_nonzero(z[1:] == z[:-1]))
                keep.append(100 * both >= percent * (len(z) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("key").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("key").alias("b"), F.col("items").alias("ib"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ia", "ib").mapInArrow(check, "a binary, b binary")


def common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many items of each of ``others`` the sorted array ``one`` has."""
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    run = np.concatenate([[0], np.cumsum(one[at] == every)])
    ends = np.cumsum([len(x) for x in others])
    return run[ends] - run[ends - [len(x) for x in others]]


def block_pairs(members: DataFrame, vertices: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the same bucket but different components that are links by the halves of their items.

    members: (band, key), all of each bucket. A pair is looked at in the first
    band that both share. Buckets are dealt in blocks, and each unit of work is
    a pair of blocks; pairs that are no links never leave it. Equal items have
    equal halves, so no link is missed.
    """
    known = members.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    per = known.groupBy("band", "label").agg(F.count("*").alias("n")).groupBy("band")
    open_ = per.agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    open_ = open_.select("band", F.col("top.label").alias("most"), F.ceil(F.col("top.n") / BLOCK).alias("b1"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("b2"))
    # The largest component has blocks of its own, which are never compared with each other.
    large = F.col("label") == F.col("most")
    own = F.when(large, F.pmod(F.xxhash64("key"), F.col("b1"))).otherwise(F.col("b1") + F.pmod(F.xxhash64("key"), F.col("b2")))
    rows = (
        known.join(open_, "band")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.when(large, F.col("b1")).otherwise(F.lit(0)), F.col("b1") + F.col("b2") - 1)))
        .select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "key", "label")
        .join(vertices, "key")
        .join(sets.select("key", "high"), "key")
    )
    rows = materialise(rows, "blocks")
    size = rows.agg(F.sum(F.length("high") + 8 * BANDS + 100)).first()[0] or 0
    tasks = max(1, -(-size // PER_TASK))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (band, i, j), g in pdf.groupby(["band", "i", "j"], sort=False):
            bands = np.stack(g["bands"].to_numpy())
            at = (bands == band).argmax(1)[0]
            label, key = pd.factorize(g["label"])[0], g["key"].to_numpy()
            high = [np.frombuffer(h, np.uint32) for h in g["high"]]
            size = np.array([len(h) for h in high])
            left = np.arange(len(g)) if i == j else np.flatnonzero(~g["second"].to_numpy())
            right = left if i == j else np.flatnonzero(g["second"].to_numpy())
            for x in left.tolist():
                y = right[(label[right] != label[x]) & ((key[right] > key[x]) | (i != j))]
                y = y[~(bands[y, :at] == bands[x, :at]).any(1)]
                y = y[100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x])]
                if len(y):
                    both = common(high[x], [high[z] for z in y.tolist()])
                    y = y[100 * both >= percent * (size[y] + size[x] - both)]
                    out += ((key[x], key[z]) for z in y.tolist())
        return pd.DataFrame(out, columns=["a", "b"])

    dealt = rows.withColumn("task", F.pmod(F.xxhash64("band", "i", "j"), F.lit(tasks)))
    found = dealt.groupBy("task").applyInPandas(compare, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, digest: one row per row of ``docs``.

    A document's set: its distinct ``k``-word shingles, A-Z in lower case. Null
    or wordless texts have an empty set and are linked with nothing. component_id
    is the smallest doc_id among linked documents, kept marks that one. Rows with
    a null doc_id take no part in links: component_id null, kept true. A repeated
    row is a copy with the same doc_id. digest, the xxhash64 of the text, leads
    with doc_id back to the row. An empty table gives no rows; other columns of
    ``docs`` are not looked at.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    table = materialise(signature_table(docs.withColumn("digest", F.xxhash64("text")), k), "signatures")
    named = table.where("doc_id is not null and key is not null")
    owners = materialise(named.groupBy("key").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"), F.first("bands").alias("bands")), "vertices")
    vertices = owners.select("key", "bands")

    bands = vertices.select("key", F.explode("bands").alias("band"))
    leaders = bands.groupBy("band").agg(F.min("key").alias("leader"), F.count("*").alias("n")).where("n > 1").select("band", "leader")
    members = materialise(bands.join(leaders, "band"), "members")

    wanted = owners.join(members.select("key").distinct(), "key", "left_semi").select(F.col("owner").alias("doc_id"), "key")
    sets = materialise(
        set_table(docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("text"), k).join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"]),
        "sets",
    )

    star = members.where("key <> leader").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    first = materialise(confirm(star, sets, percent), "links")
    rest = block_pairs(members.select("band", "key"), vertices, sets, components(first), percent)
    second = materialise(confirm(rest, sets, percent), "links")
    labels = components(first.unionByName(second))

    named_label = owners.select("key", "owner").join(labels, "key")
    smallest = named_label.groupBy("label").agg(F.min("owner").alias("component_id"))
    of_key = owners.select("key", "owner", "n").join(named_label.select("key", "label").join(smallest, "label").select("key", "component_id"), "key", "left")
    of_key = of_key.select("key", "owner", "n", F.coalesce("component_id", "owner").alias("component_id"))
    out = join_to_copies(table.select("doc_id", "digest", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")), of_key)
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "digest")
