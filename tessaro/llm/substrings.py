"""Removal of word sequences that an earlier document already has.

Level-wise doubling: windows of a quarter of the target length are compared
first. Only those that repeat in another document are extended to twice that
length and compared again, and so on until no candidates survive or the target
length is reached; nothing else leaves its document. Below the target length
not every window is compared: each target window nominates the shorter window
with the smallest hash that it holds (winnowing: Schleimer, Wilkerson, Aiken).
Equal target windows nominate equal windows at each level, so no repeat is
lost, while one in about 20 short windows is enough. Longer repeats are unions
of target windows, so the doubling ends at the target length.

Whole copies are one document from the start. Windows are compared by 128-bit
hashes of two independent word hashes; a window that a large part of the corpus
shares costs each task one partial minimum, and the join that brings the minimum
back is one that adaptive execution can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .storage import materialise
from .tables import join_to_copies, pick

_NOTHING = hashlib.sha256(b"").hexdigest()


#: Doublings before the target length.
LEVELS = 2


def sizes(length: int, levels: int) -> list[int]:
    """The window lengths of all levels; each is twice the one before it, or one word more."""
    return [length >> k for k in range(levels, -1, -1) if length >> k]


def _nominated(words: tb.Words, hashes: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the target windows, the window of ``size`` words that each nominates, the hashes of all those)."""
    grams = words.windows(hashes, size)
    at = np.flatnonzero(words.starts(length))
    if not len(at) or size == length:
        return at, at, grams
    view = np.lib.stride_tricks.sliding_window_view(grams, length - size + 1)
    best = np.empty(len(at), np.int64)
    for a in range(0, len(at), 65536):  # bounded copies
        rows = at[a : a + 65536]
        best[a : a + 65536] = rows + view[rows].argmin(1)
    return at, best, grams


def document_table(docs: DataFrame, length: int, size: int) -> DataFrame:
    """doc_id, key (of the word sequence), n_words, full_sha256, anchors (nominated windows of ``size`` words)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in tb.chunks(batch.column(1)):
                words = tb.Words(data, offs)
                hashes = words.hashes()
                _, best, grams = _nominated(words, hashes, length, size)
                best = np.unique(best)
                cut = np.searchsorted(best, words.first)
                both = np.stack([tb.sequences(hashes, words.first), tb.sequences(words.hashes(seed=1), words.first, 1)], 1)
                raw = data.tobytes()
                keys, shas, anchors = [], [], []
                for i in range(b - a):
                    keys.append(both[i].tobytes())
                    shas.append(hashlib.sha256(b" ".join(raw[offs[i] : offs[i + 1]].split())).hexdigest())
                    anchors.append(np.unique(grams[best[cut[i] : cut[i + 1]]]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(keys, pa.binary()),
                        pa.array(words.count, pa.int64()),
                        pa.array(shas, pa.string()),
                        pa.array(anchors, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "key", "n_words", "full_sha256", "anchors"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(scan, f"doc_id {kind}, key binary, n_words long, full_sha256 string, anchors array<long>")


def _live(batches: Iterator[pa.RecordBatch], length: int, size: int) -> Iterator[tuple]:
    """Per chunk of (row, owner, text, anchors): the target windows that nominate one of the anchors of ``size`` words."""
    for batch in batches:
        anchors, cuts = _lists(batch.column(3))
        for a, b, data, offs in tb.chunks(batch.column(2)):
            words = tb.Words(data, offs)
            hashes = words.hashes()
            at, best, grams = _nominated(words, hashes, length, size)
            live = np.isin(grams[best], np.unique(anchors[cuts[a] : cuts[b]]))
            yield batch, a, words, hashes, at[live]


def extended_table(texts: DataFrame, length: int, size: int, longer: int) -> DataFrame:
    """owner, row, anchor: the windows of ``longer`` words that the live target windows of (row, owner, text, anchors) nominate."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, words, hashes, at in _live(batches, length, size):
            every, best, grams = _nominated(words, hashes, length, longer)
            best = np.unique(best[np.searchsorted(every, at)])
            rows = pa.array(a + words.doc()[best])
            yield pa.RecordBatch.from_arrays([batch.column(1).take(rows), batch.column(0).take(rows), pa.array(grams[best].view(np.int64))], names=["owner", "row", "anchor"])

    kind = texts.schema["owner"].dataType.simpleString()
    return texts.select("row", "owner", "text", "anchors").mapInArrow(scan, f"owner {kind}, row long, anchor long")


def window_table(texts: DataFrame, length: int, size: int) -> DataFrame:
    """h1, h2, owner, row, at: the live target windows of (row, owner, text, anchors)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, words, hashes, at in _live(batches, length, size):
            doc = words.doc()[at]
            rows = pa.array(a + doc)
            h1, h2 = words.windows(hashes, length)[at], words.windows(words.hashes(seed=1), length)[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), batch.column(1).take(rows), batch.column(0).take(rows), pa.array((at - words.first[doc]).astype(np.int32))],
                names=["h1", "h2", "owner", "row", "at"],
            )

    kind = texts.schema["owner"].dataType.simpleString()
    return texts.select("row", "owner", "text", "anchors").mapInArrow(scan, f"h1 long, h2 long, owner {kind}, row long, at int")


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column as uint64, and the n + 1 offsets; null counts as empty."""
    sizes = [0 if x is None else len(x) for x in col.to_pylist()] if col.null_count else np.diff(col.offsets.to_numpy())
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def cut_table(texts: DataFrame, length: int) -> DataFrame:
    """key, n_removed, kept_sha256 of (key, text, starts): the words of the windows at ``starts`` go."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas = [], []
            for text, starts in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.array(starts.as_py(), np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist()) if not g)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=["key", "n_removed", "kept_sha256"])

    return texts.select("key", "text", "starts").mapInArrow(scan, "key binary, n_removed long, kept_sha256 string")


def _shared(nominated: DataFrame) -> DataFrame:
    """The anchors of (anchor, owner) that windows of several documents have."""
    return nominated.groupBy("anchor").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi")).where("lo < hi").select("anchor")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, levels: int = LEVELS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per row of ``docs``.

    A word goes if a window of ``length`` consecutive words covers it whose
    sequence also starts in a document with a smaller doc_id. ``levels``
    doublings come before the target length; they change the cost alone. Null
    texts have no words. Rows with a null doc_id neither lose words nor take any
    from others. Rows that repeat a doc_id are the same document, so they take
    nothing from each other. An empty table gives no rows; other columns are not
    looked at.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    steps = sizes(length, levels)
    table = materialise(document_table(docs, length, steps[0]), "words")
    owners = materialise(
        table.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"), F.first("anchors").alias("anchors")),
        "owners",
    )

    # The first level comes with the scan of all documents; only what repeats is read again.
    nominated = owners.select("key", "owner", F.explode("anchors").alias("anchor"))
    shared = materialise(_shared(nominated), "anchors")
    hit = materialise(nominated.join(shared, "anchor").groupBy("key", "owner").agg(F.collect_list("anchor").alias("anchors")), "hit")
    texts = materialise(
        docs.join(hit.withColumnRenamed("owner", "doc_id"), "doc_id").withColumnRenamed("doc_id", "owner").withColumn("row", F.monotonically_increasing_id()),
        "texts",
    )
    for size, longer in zip(steps, steps[1:-1]):
        nominated = materialise(extended_table(texts, length, size, longer), "longer")
        shared = materialise(_shared(nominated), "anchors")
        if shared.isEmpty():
            texts = texts.where("false")
            break
        hit = nominated.join(shared, "anchor").groupBy("row").agg(F.collect_list("anchor").alias("anchors"))
        texts = texts.drop("anchors").join(materialise(hit, "hit"), "row")

    windows = materialise(window_table(texts, length, steps[-2] if len(steps) > 1 else steps[-1]), "windows")
    first = materialise(windows.groupBy("h1", "h2").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi")).where("lo < hi").select("h1", "h2", "lo"), "first")
    later = windows.join(first, ["h1", "h2"]).where("lo < owner").groupBy("row").agg(F.collect_list("at").alias("starts"))
    later = materialise(later, "later")
    cut = materialise(cut_table(texts.join(later, "row"), length), "cut")

    known = owners.select("key", "owner", "n").join(cut.dropDuplicates(["key"]), "key", "left")
    out = join_to_copies(table.select("doc_id", "n_words", "full_sha256", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")), known)
    copy = F.coalesce((F.col("owner") < F.col("doc_id")) & (F.col("n_words") >= length), F.lit(False))
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(_NOTHING)).otherwise(F.coalesce("kept_sha256", "full_sha256")).alias("kept_sha256"),
    )
