"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths run over them, each filter keeps
its maximum over a fixed-length window, and a softmax layer turns the maxima
into languages. The log probabilities of all windows of a text, weighted by
their letters, decide for the whole text.

For prediction the embedding and the filters are folded into tables over byte
pairs, so a filter of width four costs two table rows per byte, and windows of
all texts in a batch run through them together in blocks that fit the cache.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .tables import crc_mod, pick

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
#: Labelled rows of each language that the network is trained on, at most.
TRAIN_ROWS = 1_500
EPOCHS = 7
#: Windows of an epoch, at least; few rows are seen more often.
LEAST_WINDOWS = 6_000
BLOCK = 64
UNKNOWN = "und"

LETTER = re.compile(r"[^\W\d_]")
#: Bytes that may belong to a letter: A-Z, a-z and every byte beyond ASCII.
_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[65:91] = _LETTER_BYTE[97:123] = _LETTER_BYTE[128:] = True


class Network:
    """embedding (256, EMBED); per width: filters (width * EMBED, FILTERS) and bias; softmax layer."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p: dict[str, np.ndarray] = {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        n = FILTERS * len(WIDTHS)
        self.p["out"] = rng.normal(0, n**-0.5, (n, len(langs))).astype(np.float32)
        self.p["bias"] = np.zeros(len(langs), np.float32)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Logits of the windows ``x`` (n, WINDOW) of bytes, and what the backward pass needs."""
        e = self.p["embed"][x]
        tops, kept = [], []
        for w in WIDTHS:
            m = x.shape[1] - w + 1
            view = np.concatenate([e[:, k : k + m] for k in range(w)], axis=2)
            h = view @ self.p[f"f{w}"] + self.p[f"b{w}"]
            at = h.argmax(1)
            top = np.take_along_axis(h, at[:, None], 1)[:, 0]
            kept.append((view, at, top > 0))
            tops.append(np.maximum(top, 0))
        hidden = np.concatenate(tops, 1)
        return hidden @ self.p["out"] + self.p["bias"], [kept, hidden]

    def step(self, x: np.ndarray, y: np.ndarray, adam: dict, t: int, rate: float) -> None:
        logits, (kept, hidden) = self.forward(x)
        z = np.exp(logits - logits.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        grad = {"out": hidden.T @ d, "bias": d.sum(0), "embed": np.zeros_like(self.p["embed"])}
        back = d @ self.p["out"].T
        rows = np.arange(len(x))
        for k, w in enumerate(WIDTHS):
            view, at, live = kept[k]
            g = back[:, k * FILTERS : (k + 1) * FILTERS] * live
            grad[f"b{w}"] = g.sum(0)
            best = view[rows[:, None], at]  # (n, FILTERS, w * EMBED)
            grad[f"f{w}"] = np.einsum("nfe,nf->ef", best, g)
            into = (g[:, :, None] * self.p[f"f{w}"].T[None]).reshape(len(x), FILTERS, w, EMBED)
            for j in range(w):
                np.add.at(grad["embed"], x[rows[:, None], at + j], into[:, :, j])
        for name, g in grad.items():
            m, v = adam.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.p[name] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def tables(self) -> list[tuple[list[np.ndarray], np.ndarray]]:
        """Per width: tables over byte pairs (a last odd byte: over bytes), and the bias."""
        e, out = self.p["embed"], []
        for w in WIDTHS:
            f = self.p[f"f{w}"].reshape(w, EMBED, FILTERS)
            single = [e @ f[k] for k in range(w)]
            pairs = [(single[k][:, None] + single[k + 1][None]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
            out.append((pairs + ([single[-1]] if w % 2 else []), self.p[f"b{w}"]))
        return out


def predict_windows(x: np.ndarray, tables: list, net: Network) -> np.ndarray:
    """Log probabilities of windows, block by block."""
    out = np.empty((len(x), len(net.langs)), np.float32)
    for a in range(0, len(x), BLOCK):
        part = x[a : a + BLOCK].astype(np.int32)
        pair = part[:, :-1] * 256 + part[:, 1:]
        tops = []
        for w, (parts, bias) in zip(WIDTHS, tables):
            m = part.shape[1] - w + 1
            h = parts[0].take(pair[:, :m], 0)
            for k, t in enumerate(parts[1:], 1):
                h += t.take((pair if len(t) > 256 else part)[:, 2 * k : 2 * k + m], 0)
            tops.append(np.maximum(h.max(1) + bias, 0))
        z = np.concatenate(tops, 1) @ net.p["out"] + net.p["bias"]
        z -= z.max(1, keepdims=True)
        out[a : a + BLOCK] = z - np.log(np.exp(z).sum(1, keepdims=True))
    return out


def windows_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, their documents, their letters): every byte of every document, in lower case."""
    size = np.diff(offs)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = offs[doc] + k * WINDOW
    length = np.minimum(WINDOW, offs[doc + 1] - start)
    col = np.arange(WINDOW)
    inside = col < length[:, None]
    at = np.minimum(start[:, None] + col, max(len(data) - 1, 0))
    x = np.where(inside, tb.LOWER[data[at]], 0).astype(np.uint8) if len(data) else np.zeros((0, WINDOW), np.uint8)
    return x, doc, _LETTER_BYTE[x].sum(1)


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, holdout: int = 4, held: int = 2, epochs: int = EPOCHS, seed: int = 7) -> Network | None:
    """A network trained on rows (doc_id, text, lang) with a language whose crc32(doc_id) mod ``holdout`` is not ``held``.

    Of each language the ``train_rows`` rows with the smallest hashes, and of
    each of those three pieces of different length at different places. None
    if no row has a language.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(crc_mod(F.col("doc_id"), holdout) != held)
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row per language
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return None
    # One pass for all languages: of each the rows below a hash that leaves a few more than are taken.
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    enough = train_rows + 6 * train_rows**0.5 + 20
    below = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1 << 40, int((1 << 40) * enough / r["n"]) + 1))])
    pieces = [F.substring("text", (1 + F.pmod(F.shiftright(h, 7 * i), F.greatest(F.lit(1), F.length("text") - WINDOW))).cast("int"), WINDOW) for i in range(3)]
    some = known.where(h < below[F.col("lang")]).select("lang", h.alias("h"), "doc_id", *(p.alias(f"p{i}") for i, p in enumerate(pieces))).dropDuplicates(["lang", "doc_id"])
    rng = np.random.default_rng(seed)
    xs, ys, taken = [], [], [0] * len(langs)
    for r in sorted(some.collect(), key=lambda r: (r["h"], r["doc_id"])):
        k = langs.index(r["lang"])
        if taken[k] >= train_rows:
            continue
        taken[k] += 1
        for i in range(3):
            raw = np.frombuffer(r[f"p{i}"].encode(), np.uint8)[:WINDOW]
            if i == 2:  # short texts exist as well
                raw = raw[: int(rng.integers(6, 80))]
            row = np.zeros(WINDOW, np.uint8)
            row[: len(raw)] = tb.LOWER[raw]
            xs.append(row)
            ys.append(k)
    x, y = np.array(xs), np.array(ys)
    net = Network(langs, seed)
    adam: dict = {}
    t = 0
    for epoch in range(epochs):
        rounds = -(-LEAST_WINDOWS // len(x))
        order = np.concatenate([rng.permutation(len(x)) for _ in range(rounds)])
        for a in range(0, len(order), 64):
            t += 1
            rows = order[a : a + 64]
            net.step(x[rows], y[rows], adam, t, 0.004 * (1 - epoch / epochs) + 0.0005)
    return net


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    train_rows: int = TRAIN_ROWS,
    holdout: int = 4,
    held: int = 2,
    train_on: DataFrame | None = None,
    carry: tuple[str, ...] = (),
    epochs: int = EPOCHS,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score, has_letters, and in_<name> for columns to ``carry``: one row per row of ``docs``.

    Learned from ``train_on`` (``docs`` if not given), from at most ``train_rows``
    rows of each of its languages. Texts that are null or have no letters are
    ``und`` with score 0; so is everything if there is nothing to learn from,
    and has_letters tells these apart. held_out is null where doc_id is. Equal
    probabilities: the language first in the alphabet. Repeated rows are scored
    like others. An empty table gives no rows; other columns are not looked at.
    """
    known = pick(docs if train_on is None else train_on, doc_id=id_col, text=text_col, lang=lang_col)
    net = train(known, train_rows, holdout, held, epochs)
    docs = pick(docs, doc_id=id_col, text=text_col, **{f"in_{c}": c for c in carry})
    extra = [f for f in docs.schema if f.name.startswith("in_")]
    docs = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), holdout) == held).alias("held_out"), *(f.name for f in extra))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables() if net else []
        for batch in batches:
            for a, b, data, offs in tb.chunks(batch.column(1)):
                lang: list[str] = [UNKNOWN] * (b - a)
                score, lettered = np.zeros(b - a), np.zeros(b - a, bool)
                texts = batch.column(1).slice(a, b - a)
                for i in np.flatnonzero(np.diff(offs)).tolist():
                    lettered[i] = LETTER.search(texts[i].as_py()) is not None
                if net:
                    x, doc, letters = windows_of(data, offs)
                    logs = predict_windows(x, tables, net) * letters[:, None]
                    total, weight = np.zeros((b - a, len(net.langs))), np.bincount(doc, letters, b - a)
                    np.add.at(total, doc, logs)
                    z = total / np.maximum(weight, 1)[:, None] * np.minimum(np.bincount(doc, minlength=b - a), 4)[:, None]
                    z = np.exp(z - z.max(1, keepdims=True))
                    z /= z.sum(1, keepdims=True)
                    for i in np.flatnonzero(lettered).tolist():
                        k = int(z[i].argmax())
                        lang[i], score[i] = net.langs[k], z[i, k]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score), pa.array(lettered), *(c.slice(a, b - a) for c in batch.columns[3:])],
                    names=["doc_id", "held_out", "lang_pred", "score", "has_letters", *batch.schema.names[3:]],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in extra)
    return docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, has_letters boolean{more}")
