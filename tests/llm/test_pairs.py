"""Near duplicates and substring dedup against plain loops."""

import hashlib
import random
import re

import pytest

from tessaro.llm import graph, minhash, substrings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(40, 160))] for _ in range(12)]
    rows = [(None, "no id " * 30), (0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "One two"), (5, "one two three four five")]
    passage = [rng.choice(vocab) for _ in range(60)]
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if i % 7 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage
        rows.append((10 + i, (" " if i % 3 else "\n").join(w)))
    rows += [(200, "long " + " ".join(rng.choice(vocab) for _ in range(20000))), rows[-1], rows[-1]]
    return rows


def plain_components(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates(make, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus()
    got = minhash.near_duplicates(make(rows)).collect()
    assert len(got) == len(rows)
    want = plain_components(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert len({w[1] for w in want.values()}) < len(want)


def test_near_duplicates_ask_no_signature(make, monkeypatch):
    """What shares a band is decided by its sets, however many signature values agree."""
    monkeypatch.setattr(minhash, "SIGMAS", -10.0, raising=False)
    words = [f"w{i}" for i in range(84)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:80])), (3, " ".join(words[40:]))]
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(make(rows)).collect()} == {1: 1, 2: 1, 3: 3}


def test_near_duplicates_empty(make):
    assert minhash.near_duplicates(make(corpus()[:1]).where("false")).count() == 0


def test_contraction_on_a_long_path(spark):
    edges = spark.createDataFrame([(f"{i:04}", f"{i + 1:04}") for i in range(60)] + [("a", "b"), ("b", "a"), ("c", "c")], "a string, b string")
    got = {r["key"]: r["label"] for r in graph.components(edges).collect()}
    assert {got[f"{i:04}"] for i in range(61)} == {"0000"} and got["b"] == "a" and "c" not in got


def plain_removed(rows, n):
    first, out = {}, []
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for i, t in known:
        w = WORDS.findall(t or "")
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    for i, t in rows:
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - n + 1):
                if first[tuple(w[k : k + n])] < i:
                    gone[k : k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length, levels", [(50, 2), (50, 0), (50, 3), (8, 1), (3, 5)])
def test_substrings(make, length, levels):
    rows = corpus()
    got = substrings.drop_repeats(make(rows), length=length, levels=levels).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == plain_removed(rows, length)
    assert substrings.drop_repeats(make(rows).where("false")).count() == 0


def test_whole_table(docs):
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    got = substrings.drop_repeats(docs).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == plain_removed(rows, 50)
    want = plain_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()} == want


def doubled(n, a, b):
    """The Thue-Morse sequence of two symbols: sums of powers modulo 2**64 take it and its complement for equal."""
    return [(a, b)[bin(i).count("1") % 2] for i in range(n)]


def test_thue_morse_words_and_sequences_differ(make):
    one, two = "".join(doubled(1024, "a", "b")), "".join(doubled(1024, "b", "a"))
    few = ["w%d" % i for i in range(60)]
    rows = [(1, " ".join([one] * 60)), (2, " ".join([two] * 60)), (3, " ".join(doubled(4096, "x", "y"))), (4, " ".join(doubled(4096, "y", "x"))), (5, " ".join(few)), (6, " ".join(few))]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(make(rows)).collect()}
    assert got == {i: w[1] for i, w in plain_components(rows).items()}
    assert got[2] == 2
    got = substrings.drop_repeats(make(rows)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == plain_removed(rows, 50)
