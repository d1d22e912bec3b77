"""Quality rules as a short-circuit cascade.

Every rule is a fixed predicate on a few measures of a document; a document is
kept if none rejects it, so the order of the rules changes the cost and not the
verdict. On a sample, in the tasks that hold it, each measure is timed and each
rule's rejections are noted. The rules then run in the order of rejections per
cost: next comes the rule that rejects most of the sample's survivors per second
that its measures still cost, for measures are shared. A measure is taken only
of documents that no earlier rule has rejected.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbytes as tb
from .tables import pick

#: Rows of the sample on which the order of the rules is measured, on average.
SAMPLE_ROWS = 2048

#: The symbols that are counted.
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STARTS = np.ones(256, bool)  # bytes that begin a code point
_STARTS[0x80:0xC0] = False


class Measured:
    """The measures of the documents of a chunk; each is taken once, of the documents asked for."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self._data, self._offs = data, offs
        self._rows: np.ndarray | None = None  # of the chunk; None: all
        self._words: tb.Words | None = None
        self.known: dict[str, np.ndarray] = {}

    def take(self, rows: np.ndarray) -> Measured:
        """Some of the documents, with what is known of them."""
        out = Measured(self._data, self._offs)
        out._rows = rows if self._rows is None else self._rows[rows]
        out._words = self._words and self._words.take(rows)
        out.known = {k: v[rows] for k, v in self.known.items()}
        return out

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.known:
            self.known[name] = MEASURES[name](self)
        return self.known[name]

    @property
    def bytes(self) -> tuple[np.ndarray, np.ndarray]:
        if self._rows is not None:
            parts = [self._data[self._offs[i] : self._offs[i + 1]] for i in self._rows.tolist()]
            self._data = np.concatenate(parts) if parts else self._data[:0]
            self._offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            self._rows = None
        return self._data, self._offs

    @property
    def words(self) -> tb.Words:
        if self._words is None:
            self._words = tb.Words(*self.bytes)
        return self._words

    def count(self, flags: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        data, offs = self.bytes
        run = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags(data), out=run[1:])
        return run[offs[1:]] - run[offs[:-1]]


def _repeat_words(m: Measured) -> np.ndarray:
    """Words in windows of three words that the text has twice or more."""
    words = m.words
    tri = words.windows(words.hashes(), 3)
    at = np.flatnonzero(words.starts(3))
    doc = words.doc()
    order = np.lexsort((tri[at], doc[at]))
    a, b = at[order[:-1]], at[order[1:]]
    same = (tri[a] == tri[b]) & (doc[a] == doc[b])
    cover = np.zeros(len(tri) + 3, np.int8)
    for starts in (a[same], b[same]):
        for k in range(3):
            cover[starts + k] = 1
    run = np.concatenate([[0], np.cumsum(cover[: len(tri)], dtype=np.int64)])
    return run[words.first[1:]] - run[words.first[:-1]]


def _dup_lines(m: Measured) -> np.ndarray:
    """Lines with a word that equal an earlier line; the number of lines with a word is noted besides."""
    data, offs = m.bytes
    raw = data.tobytes()
    dup, total = [], []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        total.append(len(lines))
        dup.append(len(lines) - len(set(lines)))
    m.known["n_lines"] = np.array(total, np.int64)
    return np.array(dup, np.int64)


MEASURES: dict[str, Callable[[Measured], np.ndarray]] = {
    "n_words": lambda m: m.words.count.astype(np.int64),
    "word_chars": lambda m: m.count(lambda d: _STARTS[d] & ~tb.SPACE[d]),
    "n_symbols": lambda m: m.count(lambda d: SYMBOL[d]),
    "n_upper": lambda m: m.count(lambda d: _UPPER[d]),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
}
#: What the table of :func:`assess` has of every document if counts are asked for.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Rule(NamedTuple):
    needs: tuple[str, ...]
    rejects: Callable[[Measured], np.ndarray]


#: All rules; the first two are the base.
RULES: dict[str, Rule] = {
    "few_words": Rule(("n_words",), lambda m: m["n_words"] < 50),
    "repeated_words": Rule(("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    "symbols": Rule(("n_words", "n_symbols"), lambda m: 100 * m["n_symbols"] > 25 * m["n_words"]),
    "short_words": Rule(("n_words", "word_chars"), lambda m: m["word_chars"] < 2 * m["n_words"]),
    "long_words": Rule(("n_words", "word_chars"), lambda m: m["word_chars"] > 20 * m["n_words"]),
    "upper_case": Rule(("n_upper", "word_chars"), lambda m: 100 * m["n_upper"] > 50 * m["word_chars"]),
    "dup_lines": Rule(("n_dup_lines",), lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
}
BASE = ("few_words", "repeated_words")


class Step(NamedTuple):
    """A rule's place in the cascade: what it costs and rejects there, on the sample."""

    rule: str
    seconds: float
    rejected: int
    seen: int


def order_of(rejects: dict[str, np.ndarray], seconds: dict[str, float], rules: dict[str, Rule], free: tuple[str, ...] = ()) -> list[Step]:
    """The steps by rejections per cost; ties by name.

    rejects: by rule, which documents of the sample; seconds: what each measure
    costs for the whole sample; free: measures that are taken anyway. Costs count
    as powers of two, so that noise seldom changes the order.
    """
    n = max((len(x) for x in rejects.values()), default=0)
    left, known, todo, out = np.ones(n, bool), set(free), set(rules), []
    floor = max(min(seconds.values(), default=1e-9), 1e-9) / 64  # a predicate on known measures
    while todo:
        cost = {r: floor + sum(seconds.get(x, 0.0) for x in rules[r].needs if x not in known) * left.sum() / max(1, n) for r in todo}
        gain = {r: int((rejects[r] & left).sum()) if n else 0 for r in todo}
        best = min(todo, key=lambda r: (-gain[r] / 2.0 ** round(np.log2(cost[r])), cost[r] if not gain[r] else 0, r))
        out.append(Step(best, cost[best], gain[best], int(left.sum())))
        if n:
            left &= ~rejects[best]
        known |= set(rules[best].needs)
        todo.remove(best)
    return out


def plan(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, rules: dict[str, Rule] | None = None, free: tuple[str, ...] = ()) -> list[Step]:
    """The cascade's steps, from about ``sample_rows`` rows; texts stay in the tasks that read them."""
    rules = RULES if rules is None else rules
    texts = pick(docs, text=text_col).where("text is not null")
    rows = texts.count()
    if not rows:
        return order_of({r: np.zeros(0, bool) for r in rules}, {}, rules, free)
    names = sorted(rules)
    some = texts if rows <= sample_rows else texts.sample(sample_rows / rows, seed=7)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in tb.chunks(batch.column(0)):
                m, spent = Measured(data, offs), {}
                m.words  # noqa: B018 - all rules share the words
                for x in MEASURES:
                    began = time.perf_counter()
                    m[x]
                    spent[x] = time.perf_counter() - began
                bits = sum(rules[r].rejects(m).astype(np.int64) << k for k, r in enumerate(names))
                cost = np.zeros((b - a, len(MEASURES)))
                cost[0] = [spent[x] for x in MEASURES]
                yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64()), pa.array(cost.tolist(), pa.list_(pa.float64()))], names=["bits", "cost"])

    got = some.mapInArrow(measure, "bits long, cost array<double>").collect()  # a few numbers per row of the sample
    bits = np.array([r["bits"] for r in got], np.int64)
    cost = np.array([r["cost"] for r in got]).reshape(-1, len(MEASURES)).sum(0)
    return order_of({r: (bits >> k & 1).astype(bool) for k, r in enumerate(names)}, dict(zip(MEASURES, cost.tolist())), rules, free)


def judge(m: Measured, order: list[str], rules: dict[str, Rule]) -> np.ndarray:
    """Which rule rejects each document, by place in ``order``; -1: none does."""
    verdict = None
    rows = None
    for k, name in enumerate(order):
        bad = rules[name].rejects(m)
        if verdict is None:
            verdict, rows = np.full(len(bad), -1, np.int32), np.arange(len(bad))
        if bad.any():
            verdict[rows[bad]] = k
            left = np.flatnonzero(~bad)
            rows, m = rows[left], m.take(left)
            if not len(rows):
                break
    return verdict


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, counts: bool = True) -> DataFrame:
    """The cascade's verdict, one row per row of ``docs``.

    Returns doc_id, kept and rejected_by (the rule that ended the cascade, or
    null); with ``counts`` also n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and base_failed of every document, which the rules then share.
    The order of the rules comes from about ``sample_rows`` rows; it can change
    rejected_by and the cost, never kept. Null and empty texts have no words and
    fail the base. Repeated rows are judged like others. An empty table gives no
    rows; other columns are not looked at.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    order = [s.rule for s in plan(docs, "text", sample_rows, free=COUNTS if counts else ())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in tb.chunks(batch.column(1)):
                m = Measured(data, offs)
                more = {}
                if counts:
                    more = {c: pa.array(m[c], pa.int64()) for c in COUNTS}
                    failed = np.zeros(b - a, bool)
                    for r in BASE:
                        failed |= RULES[r].rejects(m)
                    more["base_failed"] = pa.array(failed)
                verdict = judge(m, order, RULES)
                out = {"doc_id": batch.column(0).slice(a, b - a), **more, "kept": pa.array(verdict < 0), "rejected_by": pa.array([order[v] if v >= 0 else None for v in verdict.tolist()], pa.string())}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "".join(f", {c} long" for c in COUNTS) + ", base_failed boolean" if counts else ""
    return docs.mapInArrow(run, f"doc_id {kind}{more}, kept boolean, rejected_by string")
