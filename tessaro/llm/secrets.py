"""Secrets, and what their ownership across the corpus says about them.

Candidates are found in each text alone: assignments, access keys and hex
digests, and besides these any long token of letters and digits with high
entropy. Spark then aggregates hashes of the candidates over the corpus, by
distinct owners and distinct repositories. A value that several owners have, or
two of them in many repositories, is a widely copied example; one that stays
with one or two owners looks like a live credential of theirs. Base spans stay
as they are; high-entropy tokens become spans only if their ownership is narrow.

Values leave a text only as 128-bit hashes. A value in a large part of all
texts costs each task one partial row per owner and repository.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as sp
from .storage import materialise
from .tables import pick

KINDS = ("assign", "access", "hex", "owned")

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs that may be opaque credentials.
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Bits per character from which an opaque run counts as random.
ENTROPY = 3.5
#: Owners from which on a value is a copied example.
COPIED = 3
#: Repositories from which on a value of several owners, if few, is a copied example as well.
COPIED_REPOSITORIES = 32


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, str, int, str]]:
    """(start, rank, kind, end, value) of the base kinds."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, "assign", m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, "access", m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end(), m[0]) for m in HEX.finditer(text)]
    return out


def opaque_spans(text: str, taken: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int, str]]:
    """High-entropy runs with letters and digits that touch no base span."""
    out, known = [], sp.Taken(taken)
    for m in OPAQUE.finditer(text):
        s = m[0]
        if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)) or entropy(s) < ENTROPY:
            continue
        if not known.touches(m.start(), m.end()):
            out.append((m.start(), 3, "owned", m.end(), s))
    return out


def candidate_table(docs: DataFrame) -> DataFrame:
    """doc_id, owner, repository, digest, the base columns, and cands: every candidate with its hash."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("hash", pa.binary())])
        for batch in batches:
            counts, shas, cands = [], [], []
            for text in batch.column(3):
                text = text.as_py() or ""
                base = base_spans(text)
                places = [x[:4] for x in base]
                counts.append([sum(x[1] == k for x in base) for k in range(3)])
                shas.append(sp.digest(sp.as_text(places)))
                cands.append([(*x[:4], hashlib.blake2b(x[4].encode(), digest_size=16).digest()) for x in base + opaque_spans(text, places)])
            cands = [[dict(zip(("start", "rank", "kind", "end", "hash"), x)) for x in c] for c in cands]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(4), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array(shas, pa.string()), pa.array(cands, pa.list_(span))],
                names=["doc_id", "owner", "repository", "digest", "n_assign", "n_access", "n_hex", "base_sha256", "cands"],
            )

    kind, own, repo = (docs.schema[c].dataType.simpleString() for c in ("doc_id", "owner", "repository"))
    return docs.mapInArrow(
        scan,
        f"doc_id {kind}, owner {own}, repository {repo}, digest long, n_assign long, n_access long, n_hex long, base_sha256 string,"
        "cands array<struct<start:int,rank:int,kind:string,end:int,hash:binary>>",
    )


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str | None = None,
    copied: int = COPIED,
    copied_repositories: int = COPIED_REPOSITORIES,
) -> DataFrame:
    """Secrets of every text, one row per row of ``docs``.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans (``kind:start:end``
    in code points, comma-joined), found (the spans as an array), n_copied and
    n_live: how many of the base spans hold a copied value, or another; digest,
    the xxhash64 of the text, which with doc_id leads back to the row. A value is
    copied if ``copied`` owners or more have it, or two or more in
    ``copied_repositories`` repositories. Without ``repo_col`` each doc_id is a
    repository. Null and empty texts have no spans. Null owners count as one owner
    together, null repositories as one repository. Repeated rows are scanned like
    others. An empty table gives no rows; other columns of ``docs`` are not looked
    at.
    """
    texts = pick(docs, doc_id=id_col, owner=owner_col, repository=repo_col or id_col, text=text_col).withColumn("digest", F.xxhash64("text"))
    rows = candidate_table(texts).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "candidates")
    each = rows.where(F.size("cands") > 0).select("row", "owner", "repository", F.explode("cands").alias("c")).select("row", "owner", "repository", "c.*")
    # Structs, as nulls count.
    spread = each.groupBy("hash").agg(F.count_distinct(F.struct("owner")).alias("owners"), F.count_distinct(F.struct("repository")).alias("repositories"))
    wide = (F.col("owners") >= copied) | ((F.col("owners") > 1) & (F.col("repositories") >= copied_repositories))
    judged = each.join(spread.select("hash", (~wide).alias("live")), "hash")
    keep = (F.col("rank") < 3) | F.col("live")
    per_row = judged.groupBy("row").agg(
        F.collect_list(F.when(keep, F.struct("start", "rank", "kind", "end"))).alias("found"),
        F.count_if((F.col("rank") < 3) & ~F.col("live")).alias("n_copied"),
        F.count_if((F.col("rank") < 3) & F.col("live")).alias("n_live"),
    )
    out = rows.drop("cands", "owner", "repository").join(per_row, "row", "left")
    none = F.lit(0).cast("long")
    out = out.withColumn("found", F.coalesce(F.array_sort("found"), F.array().cast(f"array<{sp.SPAN}>")))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", sp.joined(F.col("found")).alias("spans"), "found",
        F.coalesce("n_copied", none).alias("n_copied"), F.coalesce("n_live", none).alias("n_live"), "digest",
    )
