"""Benchmark decontamination on templates.

Texts are canonicalised: numbers, names and units become typed placeholders,
everything else is lower case. Windows of five template tokens are hash-joined
with those of the benchmark. Where placeholders stand, the values in them are
compared slot by slot: a value of the item that one other value stands for
throughout marks a re-parameterised question; windows that say otherwise don't
count. Windows of the plain tokens are joined as well, so what is held word for
word counts however it is capitalised.

Tokens, case and digits are those of Unicode, from tables over code points that
whole chunks of texts are looked up in at once.

A document that has ``share`` of an item's windows has one of the item's
``n - ceil(share * n) + 1`` rarest windows, whatever the rest is (the prefix
filter of set similarity joins). Only these windows make candidates, so a phrase
that many items and many documents share costs no pair of its own.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .storage import materialise
from .tables import pick

WINDOW = 5
#: Share of an item's windows that a leak holds.
SHARE = 0.75
#: Tokens of an item below which it says too little to be told from ordinary text.
LEAST_TOKENS = 3
#: Tokens of a template window that are no placeholders, at least.
LEAST_FIXED = 2
#: Windows of the benchmark up to which their hashes go to every task (8 bytes each).
BROADCAST_WINDOWS = 4_000_000
#: Bytes of the benchmark's rarest windows, slot values included, up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: Code points that are worked on at once; a longer text is a chunk alone.
CHUNK = 1 << 20

NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x6E756D, 0x6E616D65, 0x756E6974))

# Words that count as units.
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg lb lbs oz ml l litre litres liter liters "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents pound pounds percent degrees".split()
)

OTHER, DIGIT, LETTER, SINGLE = range(4)


@cache
def _unicode() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: class, the code point it is compared as, and whether it is a capital.

    Decimal digits of all scripts are digits; letters and marks are letters;
    ideographs and kana, which no spaces part, are tokens of their own.
    """
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    fold = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    upper = np.zeros(sys.maxunicode + 1, bool)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        category = unicodedata.category(c)
        if category == "Nd":
            kind[i], fold[i] = DIGIT, 48 + unicodedata.decimal(c)
        elif category[0] in "LM":
            kind[i] = LETTER
            if category in ("Lu", "Lt", "Ll"):
                low = c.casefold() if len(c.casefold()) == 1 else c.lower()
                fold[i], upper[i] = ord(low[0]), category != "Ll"
    for a, b in ((0x3041, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):
        kind[a : b + 1][kind[a : b + 1] == LETTER] = SINGLE
    fold[0x2019] = 0x27  # the typographic apostrophe
    return kind, fold, upper


_SEPARATORS = np.array([0x2C, 0x2E, 0x3A, 0x66B, 0x66C], np.uint32)  # fixed values: inside numbers
_APOSTROPHES = np.array([0x27, 0x2019], np.uint32)
_LINKS = np.array([0x20, 0x2D], np.uint32)  # fixed values: between the words of a name


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points, offsets) of runs of whole texts, in compatibility form; null counts as empty."""
    some: list[str] = []
    size = first = 0
    for i, t in enumerate(texts):
        t = t.as_py() or ""
        t = t if t.isascii() else unicodedata.normalize("NFKC", t)
        if some and size + len(t) > CHUNK:
            yield first, *_points(some)
            some, size, first = [], 0, i
        some.append(t)
        size += len(t)
    if some:
        yield first, *_points(some)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([0, *map(len, texts)])


class Templates:
    """The tokens of a chunk of texts, plain and as templates.

    A plain token is a run of letters (with apostrophes inside) or of digits (with
    points, commas or colons inside), compared without case. In the template a
    number is a slot; so is a unit after a number; so are capitalised words of two
    letters or more, of which a space or hyphen away from each other all make
    one name. What a token is depends on itself and its neighbours alone.

    plain, doc, start, end, first: the plain tokens. token, slot, head, t_doc,
    t_first: the template tokens; head: the first plain token of each, and one
    past the last.
    """

    def __init__(self, points: np.ndarray, offs: np.ndarray):
        kinds, fold, upper = _unicode()
        n = len(points)
        kind = kinds[points]
        self.low = fold[points]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        if n > 2:
            inner = np.flatnonzero((kind[1:-1] == OTHER) & (kind[:-2] == kind[2:]) & ((kind[2:] == DIGIT) | (kind[2:] == LETTER)) & ~edge[1:-2] & ~edge[2:-1]) + 1
            number = kind[inner - 1] == DIGIT
            inside = np.where(number, np.isin(points[inner], _SEPARATORS), np.isin(points[inner], _APOSTROPHES))
            kind[inner[inside]] = kind[inner[inside] - 1]
        before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        self.start = np.flatnonzero((kind != OTHER) & ((before != kind) | edge[:-1] | (kind == SINGLE)))
        self.end = np.flatnonzero((kind != OTHER) & ((after != kind) | edge[1:] | (kind == SINGLE))) + 1
        self.first = np.searchsorted(self.start, offs)
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))
        self.plain = tb.run_hashes(self.low.view(np.uint8), 4 * self.start, 4 * self.end)
        m = len(self.plain)
        same = np.zeros(m, bool)  # as the document of the token before
        same[1:] = self.doc[1:] == self.doc[:-1]
        of = kind[self.start] if m else np.zeros(0, np.uint8)
        number = of == DIGIT
        unit = np.zeros(m, bool)
        unit[1:] = number[:-1] & same[1:]
        unit[unit] = np.isin(self.plain[unit], _units())
        name = (of == LETTER) & upper[points[self.start]] & (self.end - self.start > 1) & ~unit if m else np.zeros(0, bool)
        follows = np.zeros(m, bool)
        follows[1:] = name[1:] & name[:-1] & same[1:] & (self.start[1:] - self.end[:-1] == 1)
        follows[follows] = np.isin(points[self.start[follows] - 1], _LINKS)
        head = np.flatnonzero(~follows)
        self.head = np.append(head, m)
        self.slot = (number | unit | name)[head]
        self.token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, self.plain)))[head]
        self.t_doc = self.doc[head]
        self.t_first = np.searchsorted(head, self.first)

    def slots(self, a: int) -> list[str]:
        """The values in the slots of the template window from ``a`` on."""
        at = (i for i in range(a, a + WINDOW) if self.slot[i])
        return [self.low[self.start[self.head[i]] : self.end[self.head[i + 1] - 1]].tobytes().decode("utf-32-le", "surrogatepass") for i in at]


def _windows(hashes: np.ndarray, doc: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the windows of ``k`` tokens."""
    at = np.flatnonzero(np.arange(len(hashes)) + k <= first[1:][doc])
    return tb.grams(hashes, k)[at], at


@cache
def _units() -> np.ndarray:
    words = sorted(UNITS)
    points, offs = _points(words)
    return np.sort(tb.run_hashes(points.view(np.uint8), 4 * offs[:-1], 4 * offs[1:]))


class Known:
    """A set of hashes that most others are told from by one look at a table."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.bits = max(16, int(16 * len(hashes)).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._place(hashes)] = True

    def _place(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bits)

    def has(self, h: np.ndarray) -> np.ndarray:
        """The places in ``h`` of members."""
        at = np.flatnonzero(self.table[self._place(h)])
        if not len(self.hashes):
            return at[:0]
        found = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        return at[self.hashes[found] == h[at]]


def _distinct(doc: np.ndarray, h: np.ndarray, also: np.ndarray) -> np.ndarray:
    """The first place of each (doc, h, also)."""
    order = np.lexsort((also, h, doc))
    new = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    new[1:] = (doc[a] != doc[b]) | (h[a] != h[b]) | (also[a] != also[b])
    return order[new]


def item_table(items: DataFrame) -> DataFrame:
    """id, form, size, hash, slots: the distinct windows of (id, text) as plain tokens, and as templates where those have slots.

    A text of fewer tokens than a window is one plain window.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for first, points, offs in chunks(batch.column(1)):
                t = Templates(points, offs)
                size = np.diff(t.first)
                for k in range(LEAST_TOKENS, WINDOW + 1):
                    h, at = _windows(t.plain, t.doc, t.first, k)
                    doc = t.doc[at]
                    if k < WINDOW:
                        h, doc = h[size[doc] == k], doc[size[doc] == k]
                    rows += {(first + int(d), "plain", k, int(x), ()) for d, x in zip(doc, h.view(np.int64))}
                h, at = _windows(t.token, t.t_doc, t.t_first, WINDOW)
                n_slots = _counts(t.slot, at)
                own: dict[int, set] = {}
                for d, x, a, s in zip(t.t_doc[at].tolist(), h.view(np.int64).tolist(), at.tolist(), n_slots.tolist()):
                    if s <= WINDOW - LEAST_FIXED:
                        own.setdefault(d, set()).add((first + d, "template", WINDOW, x, tuple(t.slots(a))))
                rows += (r for some in own.values() if any(r[4] for r in some) for r in some)
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.list_(pa.string()))],
                names=["id", "form", "size", "hash", "slots"],
            )

    kind = items.schema["id"].dataType.simpleString()
    return items.mapInArrow(scan, f"id {kind}, form string, size int, hash long, slots array<string>")


def _counts(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(flags)])
    return run[at + WINDOW] - run[at]


def window_table(texts: DataFrame, sizes: list[int], known=None) -> DataFrame:
    """id, hash, slots: the distinct windows of (id, text), of the known hashes only if given.

    Every variant of a template window is a row; plain windows have no slots.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, points, offs in chunks(batch.column(1)):
                t = Templates(points, offs)
                ids, hashes, slots = [], [], []
                for k in sizes:
                    h, at = _windows(t.plain, t.doc, t.first, k)
                    live = known.value.has(h) if known else np.arange(len(h))
                    live = live[_distinct(t.doc[at[live]], h[live], np.zeros(len(live)))]
                    ids.append(t.doc[at[live]])
                    hashes.append(h[live])
                    slots += [()] * len(live)
                h, at = _windows(t.token, t.t_doc, t.t_first, WINDOW)
                n_slots = _counts(t.slot, at)
                live = np.flatnonzero((n_slots > 0) & (n_slots <= WINDOW - LEAST_FIXED))
                live = live[known.value.has(h[live])] if known else live
                ids.append(t.t_doc[at[live]])
                hashes.append(h[live])
                slots += [tuple(t.slots(a)) for a in at[live].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first + np.concatenate(ids))), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(slots, pa.list_(pa.string()))], names=["id", "hash", "slots"]
                )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(scan, f"id {kind}, hash long, slots array<string>")


def ranked(items: DataFrame, share: float) -> DataFrame:
    """The windows of :func:`item_table` with n (of the item in that form) and rare: whether a leak has one of these."""
    items = items.dropDuplicates(["item_id", "form", "hash", "slots"])
    n = items.groupBy("item_id", "form").agg(F.count("*").alias("n"))
    often = items.groupBy("hash").agg(F.count("*").alias("often"))
    by = Window.partitionBy("item_id", "form").orderBy("often", "hash", F.to_json("slots"))  # the windows of one item
    rank = F.row_number().over(by)
    need = F.ceil(F.col("n") * share - 1e-9)
    return items.join(n, ["item_id", "form"]).join(often, "hash").withColumn("rare", rank <= F.col("n") - need + 1).drop("often")


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    share: float = SHARE,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """The (document, benchmark item) pairs that match; clean documents have no row.

    Returns doc_id, item_id, n_shared (windows of the item that the document
    has), n_item (the item's windows), share, and kind: ``verbatim``, or
    ``reparameterised`` where more windows agree as templates with other values
    than word for word. A pair counts if ``share`` or more of the item's plain
    windows are in the document, or of its template windows with slots that are
    consistent: of several values for one of the item's the one in most windows
    counts, of equally frequent ones the greatest. Items of three or four tokens are
    one window, held word for word; shorter ones match nothing. Null, empty and
    wordless texts match nothing; rows with null ids are left out. Rows that
    repeat an id are one document, or one item. Empty tables give no rows; other
    columns are not looked at.
    """
    spark = docs.sparkSession
    items = item_table(pick(benchmark, id=item_col, text=item_text_col).where("id is not null")).withColumnRenamed("id", "item_id")
    items = materialise(ranked(items, share), "items")
    facts = items.agg(F.count("*"), F.sum(F.when(F.col("rare"), 64 + F.length(F.to_json("slots")))), F.collect_set("size")).first()
    known = None
    if facts[0] <= broadcast_windows:
        known = spark.sparkContext.broadcast(Known(np.unique(np.array([r[0] for r in items.select("hash").distinct().toLocalIterator()], np.int64)).view(np.uint64)))
    texts = pick(docs, id=id_col, text=text_col).where("id is not null")
    found = window_table(texts, sorted({*facts[2], WINDOW}), known).withColumnRenamed("id", "doc_id").dropDuplicates(["doc_id", "hash", "slots"])
    found = materialise(found, "found")

    rare = items.where("rare").select("item_id", "form", "hash").distinct()
    rare = F.broadcast(rare) if (facts[1] or 0) <= BROADCAST_BYTES else rare
    pairs = found.select("doc_id", "hash").distinct().join(rare, "hash").select("doc_id", "item_id", "form").distinct()
    hits = pairs.join(items.drop("rare", "size").withColumnRenamed("slots", "item_slots"), ["item_id", "form"]).join(found, ["doc_id", "hash"])
    hits = materialise(hits, "hits")

    pair = ["doc_id", "item_id"]
    plain = hits.where("form = 'plain'").groupBy(*pair).agg(F.count("*").alias("n_shared"), F.max("n").alias("n_item")).withColumn("other", F.lit(False))

    # Each value of the item stands for the value that most of its windows in the document have.
    slots = hits.where("form = 'template' and size(slots) = size(item_slots)").withColumn("own", F.xxhash64("hash", "item_slots"))
    each = slots.select(*pair, "own", "slots", F.explode(F.arrays_zip(F.col("item_slots").alias("x"), F.col("slots").alias("y"))).alias("z")).select(*pair, "own", "slots", "z.x", "z.y")
    votes = each.groupBy(*pair, "x", "y").agg(F.count_distinct("own").alias("votes")).groupBy(*pair, "x").agg(F.max_by("y", F.struct("votes", "y")).alias("best"))
    agree = each.join(votes, [*pair, "x"]).groupBy(*pair, "own", "slots").agg(F.min(F.col("y") == F.col("best")).alias("ok"), F.max(F.col("x") != F.col("y")).alias("other"))
    agree = agree.where("ok").select(*pair, "own", "other").unionByName(slots.where("size(slots) = 0").select(*pair, "own", F.lit(False).alias("other")))
    template = agree.groupBy(*pair, "own").agg(F.min("other").alias("other")).groupBy(*pair).agg(F.count("*").alias("n_shared"), F.max("other").alias("other"))
    template = template.join(slots.groupBy(*pair).agg(F.max("n").alias("n_item")), pair)

    both = plain.select(*pair, "n_shared", "n_item", "other").unionByName(template.select(*pair, "n_shared", "n_item", "other"))
    both = both.withColumn("share", F.col("n_shared") / F.col("n_item")).where(F.col("share") >= share)
    best = both.groupBy(*pair).agg(F.max(F.struct("share", (~F.col("other")).alias("same"), "n_item", "n_shared")).alias("b"))
    return best.select(*pair, "b.n_shared", "b.n_item", "b.share", F.when(F.col("b.same"), "verbatim").otherwise("reparameterised").alias("kind"))
