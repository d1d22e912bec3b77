"""Spans of entities in texts: finding, ordering, writing out."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A span as rows of the operators carry it: by start, then by the kind's place in the list.
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def as_text(found: list[tuple[int, int, str, int]]) -> str:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def joined(spans: Column) -> Column:
    """:func:`as_text` of an array of ``SPAN``."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


class Taken:
    """The places that spans cover; each question costs the logarithm of their number."""

    def __init__(self, spans: list[tuple[int, int, str, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted((x[0], x[3]) for x in spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        """Whether a span has a place of ``a`` to ``b`` (exclusive)."""
        i = bisect_left(self.starts, b)
        return i > 0 and self.ends[i - 1] > a


def replace(text: str, spans: list[tuple[int, int, str]], mask: str = "<{}>") -> str:
    """``text`` with each (start, end, kind) replaced; of overlapping spans the union is."""
    out, at, open_ = [], 0, None
    for a, b, kind in sorted(spans):
        if open_ and a < open_[1]:
            open_ = (open_[0], max(open_[1], b), open_[2])
            continue
        if open_:
            out += [text[at : open_[0]], mask.format(open_[2])]
            at = open_[1]
        open_ = (a, b, kind)
    if open_:
        out += [text[at : open_[0]], mask.format(open_[2])]
        at = open_[1]
    return "".join([*out, text[at:]])
