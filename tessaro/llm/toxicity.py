"""Toxicity: Levenshtein automata over a lexicon trie, and the context of each hit.

The lexicon is learned from labelled documents: terms, and stems with many
continuations, whose document frequency is far higher under label 1. The
Levenshtein automata of all terms are intersected with the trie of the
lexicon and made deterministic on demand, so a token costs one table lookup
per character, and most tokens end in the dead state after two or three.
Misspelled terms are hits of their own, with weights of their own.

The words around each hit are scored as well: log odds of the window's words
between hits in toxic and in other documents, and marks of quotation. A small
logistic model puts the document's hits together.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .tables import crc_mod, pick

#: Labelled rows of each label that the model is fitted on, at most.
TRAIN_ROWS = 5_000
#: Words on either side of a hit that count as its context.
CONTEXT = 6
STEM_LENGTHS = range(4, 9)
FEATURES = 6

WORD = re.compile(r"[^\W\d_]+")
# Marks and verbs of quotation.
QUOTES = frozenset("\"“”„«»‘’")
REPORTING = frozenset("said says quote quoted quotes called calling wrote writes term word".split())


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The Levenshtein automata of all terms, intersected with their trie.

    A state is a set of (trie node, edits so far). Stems accept as soon as they
    are read without an edit.
    """

    LIMIT = 100_000

    def __init__(self, terms: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        for word, place in [*((t, self.term) for t in terms), *((s, self.stem) for s in stems)]:
            node = 0
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.stem.append(None)
                node = self.children[node][c]
            place[node] = word
        # The most edits that any term below a node allows; -1: stems only.
        self.slack = [-1] * len(self.children)
        for i in range(len(self.children) - 1, -1, -1):  # children have larger numbers
            own = edits_allowed(self.term[i]) if self.term[i] else -1
            self.slack[i] = max([own, *(self.slack[j] for j in self.children[i].values())])
        self._reset()

    def _reset(self) -> None:
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        todo, best = list(pairs), {}
        while todo:  # closure over letters that the token lacks
            node, e = todo.pop()
            if best.get(node, 99) <= e or e > max(0, self.slack[node]):
                continue
            best[node] = e
            todo += ((j, e + 1) for j in self.children[node].values() if e < self.slack[j])
        key = frozenset(best.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.states[state]:
            if e < self.slack[node]:
                out.add((node, e + 1))  # a letter too many
            for d, j in self.children[node].items():
                if d == c:
                    out.add((j, e))
                elif e < self.slack[j]:
                    out.add((j, e + 1))
        return self._state(out)

    def match(self, token: str) -> tuple[str, int] | None:
        """(term, edits) of the closest term, (stem + "*", 0) of a stem, or None."""
        if len(self.states) > self.LIMIT:
            self._reset()
        state, found = self.start, None
        for c in token:
            follow = self.moves[state].get(c)
            if follow is None:
                follow = self.moves[state][c] = self._move(state, c)
            state = follow
            if not self.states[state]:
                return found
            if found is None:
                for node, e in self.states[state]:
                    if e == 0 and self.stem[node]:
                        found = (self.stem[node] + "*", 0)
        hits = [(e, self.term[n]) for n, e in self.states[state] if self.term[n] and e <= edits_allowed(self.term[n])]
        if hits:
            e, term = min(hits)
            return (term, e) if e == 0 or found is None else found
        return found


Rows = Iterable[tuple[str | None, int]]


def tokens_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def count_terms(rows: Rows) -> Counter:
    """(kind, term, label) -> documents: kind ``term`` for tokens, ``head`` for what longer tokens begin with, ``all`` for documents."""
    out: Counter = Counter()
    for text, y in rows:
        own = {t for t in tokens_of(text) if len(t) >= 3}
        out.update(("term", t, y) for t in own)
        out.update(("head", h, y) for h in {t[:k] for t in own for k in STEM_LENGTHS if len(t) > k})
        out["all", "", y] += 1
    return out


def odds(n1: float, n0: float, total: tuple[int, int]) -> float:
    return ((n1 + 0.5) / (total[1] + 1)) / ((n0 + 0.5) / (total[0] + 1))


def least_documents(total: tuple[int, int]) -> int:
    return max(4, total[1] // 50)


def learn_lexicon(terms: Iterable[str], heads: dict[str, int]) -> tuple[list[str], list[str]]:
    """(terms, stems) of frequent terms, and of frequent heads with the number of their continuations."""
    stems: list[str] = []
    for s in sorted(heads, key=lambda s: (len(s), s)):
        if heads[s] >= 5 and not any(s.startswith(x) for x in stems):
            stems.append(s)
    return sorted(t for t in terms if not any(t.startswith(s) for s in stems)), stems


class Model:
    """The lexicon, the weights of hits and contexts, and the logistic model."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.terms, self.stems = terms, stems
        self.hit: dict[tuple[str, int], float] = {}
        self.context: dict[str, float] = {}
        self.weights = np.zeros(FEATURES + 1)
        self.automaton: Automaton | None = None
        self.cache: dict[str, tuple[str, int] | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"automaton": None, "cache": {}}

    def hits(self, tokens: list[str]) -> list[tuple[int, tuple[str, int]]]:
        if self.automaton is None:
            self.automaton = Automaton(self.terms, self.stems)
        if len(self.cache) > 400_000:
            self.cache = {}
        cache, match, out = self.cache, self.automaton.match, []
        for i, t in enumerate(tokens):
            try:
                m = cache[t]
            except KeyError:
                m = cache[t] = match(t)
            if m is not None:
                out.append((i, m))
        return out

    def features(self, text: str) -> tuple[list[float], int]:
        low = text.lower()
        tokens = WORD.findall(low)
        hits = self.hits(tokens)
        if not hits:
            return [0.0] * FEATURES, 0
        spans = [m.span() for m in WORD.finditer(low)] if any(q in text for q in QUOTES) else None
        exact = fuzzy = best = context = quoted = 0.0
        for i, m in hits:
            w = self.hit.get((m[0], m[1]), 0.0)
            around = tokens[max(0, i - CONTEXT) : i] + tokens[i + 1 : i + 1 + CONTEXT]
            ctx = sum(self.context.get(t, 0.0) for t in around)
            quote = sum(t in REPORTING for t in around)
            if spans:
                a, b = spans[i]
                quote += sum(c in QUOTES for c in low[max(0, a - 2) : a] + low[b : b + 2])
            quoted += min(quote, 2) / 2
            context += max(-3.0, min(3.0, ctx))
            best = max(best, w)
            exact, fuzzy = exact + w * (m[1] == 0), fuzzy + w * (m[1] > 0)
        n = len(hits)
        return [best, math.log1p(max(0.0, exact)), math.log1p(max(0.0, fuzzy)), context / n, quoted / n, 100 * n / (len(tokens) + 20)], n

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)
        return 1 / (1 + np.exp(-z))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Weights with the intercept first, by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + penalty * w
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty)
        w -= np.clip(np.linalg.solve(h, g), -5, 5)
    return w


def count_hits(model: Model, rows: Rows) -> Counter:
    """(kind, term, edits, label) -> number: ``hit`` by documents, ``near`` (words around hits) by hits."""
    out: Counter = Counter()
    for text, y in rows:
        tokens = tokens_of(text)
        hits = model.hits(tokens)
        out.update(("hit", *m, y) for m in {m for _, m in hits})
        for i, _ in hits:
            out.update(("near", t, 0, y) for t in set(tokens[max(0, i - CONTEXT) : i] + tokens[i + 1 : i + 1 + CONTEXT]))
    return out


def weigh(model: Model, hits: dict[tuple[str, int], tuple[int, int]], near: dict[str, tuple[int, int]], n: tuple[int, int], total: tuple[int, int]) -> None:
    """Sets the weights of hits and of context words; (label 0, label 1) counts, ``n`` all context words of each label."""
    for m, (n0, n1) in hits.items():
        model.hit[m] = max(0.0, math.log(odds(n1, n0, total)))
    for t, (n0, n1) in near.items():
        if n0 + n1 >= 20 and min(n) > 200:
            model.context[t] = math.log(((n1 + 1) / n[1]) / ((n0 + 1) / n[0]))


def blank() -> Model:
    """Scores everything 0."""
    model = Model([], [])
    model.weights[0] = -30.0
    return model


def _by_label(counts: dict[tuple, int], kind: str) -> dict:
    out: dict = {}
    for (k, *key, y), n in counts.items():
        if k == kind:
            both = out.setdefault(tuple(key), [0, 0])
            both[y] += n
    return out


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """A model of (text, label) rows in memory; :func:`train` does the same in tasks. Without both labels it scores everything 0."""
    counts = count_terms(rows)
    total = (counts["all", "", 0], counts["all", "", 1])
    if 0 in total:
        return blank()
    least = least_documents(total)
    terms = [t for (t,), (n0, n1) in _by_label(counts, "term").items() if n1 >= least and odds(n1, n0, total) >= 10]
    good = {h for (h,), (n0, n1) in _by_label(counts, "head").items() if n1 >= least and odds(n1, n0, total) >= 20}
    tails = Counter(h for k, t, y in counts if k == "term" and y == 1 for h in {t[:i] for i in STEM_LENGTHS if len(t) > i} & good)
    model = Model(*learn_lexicon(terms, tails))
    seen = count_hits(model, rows)
    near = {t: tuple(n) for (t, _), n in _by_label(seen, "near").items()}
    n = tuple(sum(v[k] for v in near.values()) + 1 for k in (0, 1))
    weigh(model, {m: tuple(v) for m, v in _by_label(seen, "hit").items()}, near, n, total)
    x = np.array([model.features(t or "")[0] for t, _ in rows])
    model.weights = fit_logistic(x, np.array([y for _, y in rows], float))
    return model


def _counted(rows: DataFrame, count, kinds: str) -> DataFrame:
    """The sums of the counts that ``count`` takes of (text, y) rows, by their keys as columns."""
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = count(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            cols = list(zip(*((*k, n) for k, n in found.items()))) or [[]] * (len(names) + 1)
            types = [pa.string() if x.endswith("string") else pa.int32() for x in kinds.split(", ")]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types)), pa.array(cols[-1], pa.int64())], names=[*names, "n"])

    return rows.select("text", "y").mapInArrow(run, f"{kinds}, n long").groupBy(*names).agg(F.sum("n").alias("n"))


def _pairs(counts: DataFrame, *keys: str) -> DataFrame:
    """keys, n0, n1: the counts of both labels side by side."""
    at = lambda k: F.sum(F.when(F.col("y") == k, F.col("n")).otherwise(0))
    return counts.groupBy(*keys).agg(at(0).alias("n0"), at(1).alias("n1"))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", train_rows: int = TRAIN_ROWS, holdout: int = 5) -> Model:
    """Fit on labelled rows whose crc32(doc_id) mod ``holdout`` is not 0, at most ``train_rows`` of each label.

    The rows are those with the smallest hashes, the same at every run. Texts stay
    in the tasks; the driver gets the terms and context words that count, and six
    numbers per row.
    """
    known = pick(labels, doc_id="doc_id", y=label_col).where("doc_id is not null and y is not null").where(crc_mod(F.col("doc_id"), holdout) != 0)
    known = known.groupBy("doc_id").agg(F.max(F.col("y").cast("int")).alias("y"))
    chosen = None
    for k in (0, 1):
        part = known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * train_rows ids.
    rows = materialise(docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")), "training")
    found = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    total = (found.get(0, 0), found.get(1, 0))
    if 0 in total:
        return blank()

    counts = materialise(_counted(rows, count_terms, "kind string, term string, y int"), "terms")
    ratio = ((F.col("n1") + 0.5) / (total[1] + 1)) / ((F.col("n0") + 0.5) / (total[0] + 1))
    both = _pairs(counts, "kind", "term").where(F.col("n1") >= least_documents(total))
    terms = [r["term"] for r in both.where((F.col("kind") == "term") & (ratio >= 10)).collect()]
    good = both.where((F.col("kind") == "head") & (ratio >= 20)).select(F.col("term").alias("head"))
    longer = counts.where("kind = 'term' and y = 1").select(F.explode(F.array(*[F.when(F.length("term") > k, F.substring("term", 1, k)) for k in STEM_LENGTHS])).alias("head"))
    tails = {r["head"]: r["count"] for r in longer.join(good, "head").groupBy("head").count().collect()}

    model = Model(*learn_lexicon(terms, tails))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    seen = materialise(_counted(rows, lambda r: count_hits(shared.value, r), "kind string, term string, edits int, y int"), "hits")
    hits = {(r["term"], r["edits"]): (r["n0"], r["n1"]) for r in _pairs(seen.where("kind = 'hit'"), "term", "edits").collect()}
    words = _pairs(seen.where("kind = 'near'"), "term")
    n = words.agg(F.coalesce(F.sum("n0"), F.lit(0)) + 1, F.coalesce(F.sum("n1"), F.lit(0)) + 1).first()
    near = {r["term"]: (r["n0"], r["n1"]) for r in words.where("n0 + n1 >= 20").collect()}
    weigh(model, hits, near, tuple(n), total)

    weighed = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [weighed.value.features(t or "")[0] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    got = sorted((r["y"], *r["x"]) for r in rows.select("text", "y").mapInArrow(measure, "y int, x array<double>").collect())
    table = np.array(got, float)
    model.weights = fit_logistic(table[:, 1:], table[:, 0])
    return model


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    train_rows: int = TRAIN_ROWS,
    holdout: int = 5,
) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits: one row per row of ``docs``.

    Null and empty texts have no hits and score like any text without. Rows with
    a null doc_id are never learned from; held_out is null for them. A doc_id
    with several labels has the largest, one with several texts is learned from
    the first of them in the alphabet. With no labels, or only one kind, all
    scores are 0. An empty table gives no rows; other columns are not looked at.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label_col, train_rows, holdout))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            got = [m.features(t.as_py() or "") for t in batch.column(1)]
            s = m.score(np.array([g[0] for g in got]).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array([g[1] for g in got], pa.int64())],
                names=["doc_id", "held_out", "score", "predicted", "n_hits"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.withColumn("held_out", crc_mod(F.col("doc_id"), holdout) == 0)
    return marked.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_hits long")
