"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

Each document becomes its token ids plus an end id. Documents longer than a
sequence are cut into full pieces; only the first piece may be shorter. Every
piece is placed where the sum of the squared numbers of open sequences per
residual gap becomes smallest (Csirik, Johnson, Kenyon, Orlin, Shor, Weber:
the Sum-of-Squares algorithm). That keeps all gaps about equally frequent, so
that a fitting gap exists for whatever comes next.

Scale: full pieces are sequences of their own and stay where they are. The
others are dealt at random to packers of about ``PER_PACKER`` pieces, whose
number grows with the corpus, and each packer is one task. What a packer wastes
is about one sequence in 500, and less the more pieces it has.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .tables import pick

#: Pieces shorter than a sequence that one packing task gets on average.
PER_PACKER = 65_536

_ENCODERS: dict[str, Encoder] = {}

#: The pre-tokenisation of byte-level BPE vocabularies of this family (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same without look-ahead; equal on texts in which no white space follows white space.
PLAIN = PATTERN.replace(r"|\s+(?!\S)", "")

_PROBES = ("", " a", "It's  we'll\n\n x1 22 ", "Über  élève — ñ\t\t日本 <|endoftext|> don't'S\n")


def tokenizer_file(name: str) -> str:
    """A path as it is, or the place of a public tokenizer file on this machine."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids exactly as ``tokenizers`` gives them, by the faster engine of ``tiktoken`` where that is equal.

    Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.fast = None
        import regex
        import tiktoken

        self.gap = regex.compile(r"\s\s")
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # Byte-level vocabularies write the bytes that don't print as code points from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown}
        byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        try:
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if not t.startswith("<|")}
            fast = tiktoken.Encoding("full", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            plain = tiktoken.Encoding("plain", pat_str=PLAIN, mergeable_ranks=ranks, special_tokens={})
        except (KeyError, ValueError):
            return
        if all(fast.encode_ordinary(x) == self._slow(x) for x in _PROBES):
            self.fast, self.plain = fast, plain

    def _slow(self, text: str) -> list[int]:
        return self.slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        if self.fast is None:
            return self._slow(text)
        return (self.fast if self.gap.search(text) else self.plain).encode_ordinary(text)


def encoder(name: str) -> Encoder:
    path = tokenizer_file(name)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, placed one after another in the given order.

    Of places with equal sums the fullest sequence is taken.
    """
    n = len(lengths)
    where, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open sequences by level; full ones don't count
    opened: list[list[int]] = [[] for _ in range(capacity + 1)]
    last = 0
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        if s < capacity:
            # Moving a sequence from level h to h + s changes the sum by 2 (N[h + s] - N[h] + 1); closing it by 1 - 2 N[h].
            low = count[1 : capacity - s + 1]
            gain = 2 * (count[s + 1 :] - low + 1)
            gain[-1] = 1 - 2 * low[-1]
            gain[low == 0] = never
            h = len(gain) - int(np.argmin(gain[::-1]))
            if low[h - 1] and gain[h - 1] <= 2 * count[s] + 1:
                where[i], offset[i] = opened[h].pop(), h
                count[h] -= 1
                if h + s < capacity:
                    count[h + s] += 1
                    opened[h + s].append(int(where[i]))
                continue
            count[s] += 1
            opened[s].append(last)
        where[i], offset[i] = last, 0
        last += 1
    return where, offset


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`sum_of_squares` from the longest to the shortest, in rounds.

    The rule keeps all gaps equally frequent to the end, so some sequences stay
    open. What these hold is taken out and packed again, as long as that saves
    a sequence.
    """
    n = len(lengths)
    where, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    rows = np.argsort(-lengths, kind="stable")
    base, before = 0, np.inf
    while len(rows):
        seq, at = sum_of_squares(lengths[rows], capacity)
        opened = np.bincount(seq, weights=lengths[rows]).astype(np.int64) < capacity
        if len(opened) >= before:
            break
        where[rows], offset[rows] = base + seq, at
        before = int(opened.sum())
        base += len(opened)
        rows = rows[opened[seq]]
    return where, offset


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                doc_id = doc_id.as_py()
                out += ((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_packer: int = PER_PACKER,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row
    per piece. A null or empty text is the end id alone. Repeated rows and null
    ids are packed like any other row. An empty table gives no rows. Other
    columns of ``docs`` are not looked at. Lengths that tie are taken by doc_id,
    piece and checksum. Sequences of one full piece have numbers below 0.
    """
    cut = materialise(pieces(pick(docs, doc_id=id_col, text=text_col), tokenizer, capacity, end_id), "pieces")
    shorter = F.col("length") < capacity
    packers = max(1, -(-cut.where(shorter).count() // per_packer))

    def place(rows: pa.Table) -> pa.Table:
        # Ids stay in Arrow: pandas would round longs beside a null.
        rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")]))
        where, offset = pack_lengths(rows["length"].to_numpy(), capacity)
        sequence = (rows["packer"].to_numpy().astype(np.int64) << np.int64(32)) + where
        rows = rows.drop_columns(["packer"])
        return rows.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = cut.where(shorter).withColumn("packer", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(packers)))
    kind = cut.schema["doc_id"].dataType.simpleString()
    packed = dealt.groupBy("packer").applyInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    alone = cut.where(~shorter).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)
