"""Secrets and personal data against the contract's patterns, read plainly."""

import hashlib
import re

from tessaro.llm import pii, secrets, spans


def base_text(found):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def plain_secrets(t):
    t = t or ""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]


def plain_pii(t):
    t = t or ""
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    return out + [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


TEXTS = [
    None, "", "é password = 'abc123' TOKEN:xyz", 'api_key="s3cr3t-value" apikey: short', "AKIA" + "A" * 16 + " AKIA123", "0123456789abcdef01234567 ABCDEF",
    "Secret==abcdefgh pasſword=abcdefg", "a.b@c.d e@f g@h.i@j.k @x.y a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 01.02.03.004", "4111 1111 1111 1111 4111-1111-1111-1112",
    "+1 (555) 123-4567 +12 +1.2.3.4.5.6.7.8.9", "ü +49 30 1234567, x@y.zz", "9" * 500 + " 1" * 200, "token: " + "z" * 70000, "a" * 50000 + "@b.cc",
]


def test_secrets(make, docs):
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(TEXTS)]
    for table, pairs in ((make(rows), rows), (docs, [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])):
        got = {r["doc_id"]: r for r in secrets.scan_secrets(table).collect()}
        assert len(got) == len(pairs)
        for i, t, *_ in pairs:
            want = plain_secrets(t)
            assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[2] == k for x in want) for k in ("assign", "access", "hex")]
            assert got[i]["base_sha256"] == hashlib.sha256(base_text(want).encode()).hexdigest()
            have = got[i]["spans"].split(",") if got[i]["spans"] else []
            assert set(base_text(want).split(",")) - {""} <= set(have)
    assert secrets.scan_secrets(make(rows).where("false")).count() == 0


def test_ownership_decides(make):
    live, copied = "Zk8sQ2mX9vLr4TtY7wBn5c", "Qp3xV7nR2kLm9sTt4yWb6z"
    rows = [(1, f"use {live} here", "a"), (2, f"again {live}", "a")] + [(10 + i, f"see {copied} in docs", f"o{i}") for i in range(5)] + [(30, f"null owner {live}", None)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(make(rows)).collect()}
    assert got[1] == "owned:4:26" and all(got[10 + i] == "" for i in range(5))
    base = [(50 + i, "password=hunter22", f"o{i}") for i in range(4)] + [(60, "password=only0ne", "x")]
    got = {r["doc_id"]: (r["n_copied"], r["n_live"], r["spans"]) for r in secrets.scan_secrets(make(base)).collect()}
    assert got[50] == (1, 0, "assign:0:17") and got[60] == (0, 1, "assign:0:16")


def test_personal_data(make, docs):
    rows = list(enumerate(TEXTS))
    for table, pairs in ((make(rows), rows), (docs, [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])):
        got = {r["doc_id"]: r for r in pii.find_personal_data(table).collect()}
        assert len(got) == len(pairs)
        for i, t in pairs:
            want = plain_pii(t)
            assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[2] == k for x in want) for k in ("email", "ip", "card", "phone")]
            assert got[i]["base_sha256"] == hashlib.sha256(base_text(want).encode()).hexdigest()
    assert pii.find_personal_data(make(rows).where("false")).count() == 0


def test_identifiers_are_whole():
    for one in ("A1b2" * 20, "x/" * 30 + "1234"):
        assert pii.mentions(f"ref {one}. end", []) == [(4, 4 + len(one), False)]


def test_patterns_discover(make):
    rows = [(i, f"Please call my number +1 555 010 {1000 + i} or wait") for i in range(40)] + [(100, "Please call my number 0049-30-99887 or wait"), (101, "the year 2024/2025x ended")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(make(rows)).collect()}
    assert got[100] == "context:22:35" and got[101] == ""


def plain_owned(rows):
    """spans of (doc_id, text, owner) by the operator's rules, one text at a time."""
    import math
    from collections import Counter, defaultdict

    owners, docs, found = defaultdict(set), defaultdict(set), []
    for i, t, own in rows:
        base = plain_secrets(t)
        spans = [(a, r, k, b, re.fullmatch(r"""\w+["']?\x20*[:=]\x20*["']?(.*)""", t[a:b])[1] if k == "assign" else t[a:b]) for a, r, k, b in base]
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t or ""):
            s = m[0]
            bits = -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())
            free = all(b <= m.start() or m.end() <= a for a, _, _, b in base)
            if re.search("[0-9]", s) and re.search("[A-Za-z]", s) and bits >= 3.5 and free:
                spans.append((m.start(), 3, "owned", m.end(), s))
        for x in spans:
            owners[x[4]].add(own)
            docs[x[4]].add(i)
        found.append((i, spans))
    wide = {v for v in owners if len(owners[v]) >= 3 or (len(owners[v]) > 1 and len(docs[v]) >= secrets.COPIED_REPOSITORIES)}
    return sorted((i, base_text([x[:4] for x in spans if x[1] < 3 or x[4] not in wide])) for i, spans in found)


def test_owned_spans_equal_the_plain_rules(make):
    import random

    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdefghijKLMNOPQ0123456789+/_-") for _ in range(rng.randint(18, 40))) for _ in range(30)] + ["0123456789abcdef" * 2, "AKIA" + "B7" * 10]
    rows = []
    for i in range(400):
        words = [rng.choice(["see", "password=", "token: ", "é", "x" * 30, rng.choice(pool), rng.choice(pool[:4])]) for _ in range(rng.randint(0, 9))]
        rows.append((i, rng.choice([" ", "", ", "]).join(words), rng.choice([None, "a", "b", "c"]) if i % 3 else "a"))
    # One value of two owners in many documents, and one in a few.
    rows += [(1000 + i, "use Zq8sQ2mX9vLr4TtY7wBn5c now", "ab"[i % 2]) for i in range(40)] + [(2000 + i, "use Yq8sQ2mX9vLr4TtY7wBn5c now", "ab"[i % 2]) for i in range(4)]
    got = sorted((r["doc_id"], r["spans"]) for r in secrets.scan_secrets(make(rows)).collect())
    assert got == plain_owned(rows)
    assert dict(got)[1000] == "" and dict(got)[2000] == "owned:4:26"


def plain_context(rows, support=8, confidence=0.9):
    """spans of (doc_id, text) by the operator's rules."""
    import math

    seen, edges = [], {}
    for i, t in rows:
        t = t or ""
        base = plain_pii(t)
        marks = [(a, b, True) for a, _, _, b in base]
        for m in re.finditer(r"[A-Za-z0-9][A-Za-z0-9./_-]{3,}[A-Za-z0-9]", t):
            if len(re.findall("[0-9]", m[0])) >= 4 and all(b <= m.start() or m.end() <= a for a, _, _, b in base):
                marks.append((m.start(), m.end(), False))
        for a, b, seed in marks:
            before, after = re.findall(r"[^\W\d_]+", t[:a]), re.findall(r"[^\W\d_]+", t[b:])
            if len(before) > 1:
                edges.setdefault("<" + " ".join(before[-2:]).lower(), {})
                edges["<" + " ".join(before[-2:]).lower()][t[a:b]] = seed or edges["<" + " ".join(before[-2:]).lower()].get(t[a:b], False)
            if before and after:
                p = (before[-1] + "<>" + after[0]).lower()
                edges.setdefault(p, {})
                edges[p][t[a:b]] = seed or edges[p].get(t[a:b], False)
        seen.append((i, base, marks, t))
    score, last = {}, 0
    while True:
        conf = {p: sum(1.0 if s else score.get(v, 0.0) for v, s in e.items()) / len(e) for p, e in edges.items() if sum(e.values()) >= support}
        new = {}
        for p, c in conf.items():
            if c >= confidence - 1e-12:
                for v, s in edges[p].items():
                    if not s:
                        new.setdefault(v, []).append(c)
        score = {v: 1 - math.exp(sum(math.log(max(1e-9, 1 - c)) for c in cs)) for v, cs in new.items()}
        if len(score) == last:
            break
        last = len(score)
    found = {v for v, s in score.items() if s >= confidence - 1e-12}
    return sorted((i, base_text(base + [(a, 4, "context", b) for a, b, s in marks if not s and t[a:b] in found])) for i, base, marks, t in seen)


def test_context_spans_equal_the_plain_rules(make):
    import random

    rng = random.Random(6)
    rows = []
    for i in range(500):
        lead = rng.choice(["please call me at", "write to my mail", "my card is", "order number", "Ref no"])
        value = f"+1 555 {rng.randint(100, 999)} {rng.randint(1000, 9999)}" if rng.random() < 0.93 and lead != "order number" else f"ID-{rng.randint(1000, 1400)}/x"
        rows.append((i, f"{'x, ' * rng.randint(0, 40)}{lead}{rng.choice([' ', ': ', ' ' * 90])}{value}{rng.choice([' or', ' and', '', '.' * 80 + ' or'])} wait"))
    rows += [(900, "é1234a 99é please call me at é12345é or"), (901, None), (902, "")]
    got = sorted((r["doc_id"], r["spans"]) for r in pii.find_personal_data(make(rows)).collect())
    assert got == plain_context(rows)
    assert any("context" in s for _, s in got)


def test_texts_of_many_entities_take_linear_time():
    import time

    text = " ".join(f"password=hunter{i}22 Zk8sQ2mX9vLr4TtY7wBn{i} mail{i}@x.example.com call number 0049-30-{i}" for i in range(100_000))
    began = time.perf_counter()
    base = secrets.base_spans(text)
    secrets.opaque_spans(text, [x[:4] for x in base])
    found = pii.mentions(text, sorted(pii.base_spans(text)))
    context = pii.Context(text)
    assert sum(len(context.patterns(a, b)) > 0 for a, b, _ in found) > 100_000
    assert time.perf_counter() - began < 30


def test_replace():
    assert spans.replace("ab secret cd", [(3, 9, "x"), (5, 9, "y")]) == "ab <x> cd"
    assert spans.replace("abc", []) == "abc"
