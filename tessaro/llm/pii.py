"""Personal data by bootstrapped contextual extraction.

Seeds are entities that their form proves: addresses, IPs, card numbers with
the right check digit, phone numbers. The words around seeds become lexical
patterns. Spark scores the bipartite graph of patterns and instances in
rounds: a pattern is as trustworthy as the instances it extracts, an unseen
instance as likely as the patterns that extract it. Identifiers without a
provable form become spans once patterns of high confidence discover them.
Rounds go on until a round discovers nothing that was not known before.

The graph holds distinct (pattern, instance) pairs of identifier-like tokens
only, so it stays far below the text in size; a pattern or an instance that is
very frequent is one partial sum in each task.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as sp
from .storage import materialise
from .tables import pick

KINDS = ("email", "ip", "card", "phone", "context")

# The base patterns, and the characters of an address before its @.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Tokens that may be identifiers; four digits are asked for besides.
TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9./_-]{3,}[A-Za-z0-9]")
WORD = re.compile(r"[^\W\d_]+")
DIGIT = re.compile(r"[0-9]")

#: Distinct seeds a pattern must extract.
SUPPORT = 8
#: Confidence that a pattern and an unseen instance must reach.
CONFIDENCE = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the address pattern, in time linear in the text.

    A match starts where the run of local characters before its @ starts.
    """
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > low and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    return out


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank, kind, end) of the base kinds."""
    out = [(a, 0, "email", b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, "ip", m.end()))
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() < 64 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, "card", m.end()))
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(m[0])) <= 15:
                out.append((m.start(), 3, "phone", m.end()))
    return out


def mentions(text: str, base: list[tuple[int, int, str, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, seed) of the seeds and of the identifier-like tokens that touch none."""
    out = [(a, b, True) for a, _, _, b in base]
    if DIGIT.search(text):
        known = sp.Taken(base)
        for m in TOKEN.finditer(text):
            if len(DIGIT.findall(m[0])) >= 4 and not known.touches(m.start(), m.end()):
                out.append((m.start(), m.end(), False))
    return out


class Context:
    """The words of a text, to be found from any place in it."""

    def __init__(self, text: str):
        self.text = text
        self.spans = [m.span() for m in WORD.finditer(text)]
        self.starts = [a for a, _ in self.spans]
        self.ends = [b for _, b in self.spans]

    def patterns(self, a: int, b: int) -> list[str]:
        """Of a mention: the two words before it; the word before and the word after it, however far away.

        Of a word that the mention begins or ends in, the part outside of it counts.
        """
        i, j = bisect_left(self.starts, a), bisect_right(self.ends, b)
        before = [self.text[x : min(y, a)].lower() for x, y in self.spans[max(0, i - 2) : i]]
        after = [self.text[max(x, b) : y].lower() for x, y in self.spans[j : j + 1]]
        out = []
        if len(before) == 2:
            out.append("<" + " ".join(before))
        if before and after:
            out.append(before[-1] + "<>" + after[0])
        return out


def mention_table(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns, base (the spans), and found: every mention with its patterns."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])
        mention = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("hash", pa.binary()), ("patterns", pa.list_(pa.string()))])
        for batch in batches:
            counts, shas, bases, founds = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = sorted(base_spans(text))
                counts.append([sum(x[1] == k for x in base) for k in range(4)])
                shas.append(sp.digest(sp.as_text(base)))
                bases.append([dict(zip(("start", "rank", "kind", "end"), x)) for x in base])
                found = mentions(text, base)
                context = Context(text) if found else None
                founds.append(
                    [{"start": a, "end": b, "seed": seed, "hash": hashlib.blake2b(text[a:b].encode(), digest_size=16).digest(), "patterns": context.patterns(a, b)} for a, b, seed in found]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(shas, pa.string()), pa.array(bases, pa.list_(span)), pa.array(founds, pa.list_(mention))],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "found"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        scan,
        f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<{sp.SPAN}>,"
        "found array<struct<start:int,end:int,seed:boolean,hash:binary,patterns:array<string>>>",
    )


def scores(edges: DataFrame, support: int, confidence: float) -> DataFrame:
    """(hash, score) of the unseen instances of (pattern, hash, seed) that trusted patterns extract.

    Scores of instances and patterns only grow from round to round, so what is
    discovered does too; the rounds end when its number stays the same.
    """
    score = edges.select("hash", F.lit(0.0).alias("score")).where("false")
    before = 0
    while True:
        known = edges.join(score, "hash", "left").withColumn("s", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        trusted = known.groupBy("pattern").agg(F.avg("s").alias("conf"), F.count_if("seed").alias("n")).where((F.col("n") >= support) & (F.col("conf") >= confidence)).select("pattern", "conf")
        unseen = edges.where("not seed").join(trusted, "pattern")
        score = unseen.groupBy("hash").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("conf")))))).alias("score"))
        score = materialise(score, "scores")
        now = score.count()
        if now == before:
            return score
        before = now


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    support: int = SUPPORT,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """Personal data of every text, one row per row of ``docs``.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans
    (``kind:start:end`` in code points, comma-joined) and n_context, the number
    of spans that patterns discovered. Null and empty texts have no spans.
    Repeated rows are scanned like others; in the graph an instance counts once
    per pattern. An empty table gives no rows; other columns are not looked at.
    """
    rows = mention_table(pick(docs, doc_id=id_col, text=text_col)).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "mentions")
    each = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("m")).select("row", "m.*")
    edges = materialise(each.select(F.explode("patterns").alias("pattern"), "hash", "seed").groupBy("pattern", "hash").agg(F.max("seed").alias("seed")), "graph")
    found = scores(edges, support, confidence).where(F.col("score") >= confidence).select("hash")
    added = each.where("not seed").join(found, "hash", "left_semi").groupBy("row")
    added = added.agg(F.collect_list(F.struct("start", F.lit(4).alias("rank"), F.lit("context").alias("kind"), "end")).alias("added"))
    out = rows.drop("found").join(added, "row", "left")
    both = F.concat("base", F.coalesce("added", F.array().cast(f"array<{sp.SPAN}>")))
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", sp.joined(both).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_context"),
    )
