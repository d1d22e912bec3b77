"""Language, packing, toxicity, quality, extraction, decontamination and the pipeline."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql.functions import lit as F_lit

from tessaro.llm import decontaminate, html_extract, langid, packing, quality, textbytes, toxicity

SF = "/root/testdata/sf0.001"
EDGE = [(None, "a b c"), (1, None), (2, ""), (3, "123 !!"), (4, "x"), (4, "x"), (5, "word " * 30000)]


def test_language(spark, make):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    small = dict(train_rows=60, epochs=4)
    net = langid.train(docs.select("doc_id", "text", "lang"), **small)
    x, doc, letters = langid.windows_of(np.frombuffer(b"abc" * 200 + b"Xyz", np.uint8), np.array([0, 600, 603]))
    assert x.shape == (4, langid.WINDOW) and list(doc) == [0, 0, 0, 1] and letters.sum() == 603
    logits, _ = net.forward(x)
    z = logits - logits.max(1, keepdims=True)
    assert np.allclose(langid.predict_windows(x, net.tables(), net), z - np.log(np.exp(z).sum(1, keepdims=True)), atol=1e-4)
    lang = {r[0]: r[1] for r in docs.select("doc_id", "lang").collect()}
    got = langid.identify(docs, train_rows=150, epochs=6).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95
    # Every prediction against a loop over the text's windows.
    some = docs.where("doc_id % 9 = 1")
    net = langid.train(docs.select("doc_id", "text", "lang"), **small)
    want = {}
    for i, t in [(r[0], r[1]) for r in some.select("doc_id", "text").collect()]:
        raw = "".join(c.lower() if c.isascii() else c for c in t or "").encode()
        cut = [raw[k : k + langid.WINDOW] for k in range(0, len(raw), langid.WINDOW)]
        if not re.search(r"[^\W\d_]", t or ""):
            want[i] = ("und", 0.0)
            continue
        logits, _ = net.forward(np.array([list(c.ljust(langid.WINDOW, b"\0")) for c in cut], np.uint8))
        p = np.exp(logits - logits.max(1, keepdims=True))
        logs = np.log(p / p.sum(1, keepdims=True))
        n = np.array([sum(b > 127 or chr(b).isalpha() for b in c) for c in cut])
        z = (logs * n[:, None]).sum(0) / max(1, n.sum()) * min(4, len(cut))
        z = np.exp(z - z.max())
        want[i] = (net.langs[int(z.argmax())], float(z.max() / z.sum()))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(some, train_on=docs, **small).collect()}
    assert got.keys() == want.keys()
    for i, (lang_, p) in want.items():
        assert got[i][0] == lang_ and abs(got[i][1] - p) < 1e-3
    edge = langid.identify(make(EDGE), train_on=docs, train_rows=40).collect()
    assert len(edge) == len(EDGE) and {r["doc_id"] for r in edge if r["lang_pred"] == "und"} == {1, 2, 3}
    assert {r["lang_pred"] for r in langid.identify(make(EDGE)).collect()} == {"und"}
    assert langid.identify(make(EDGE).where("false")).count() == 0


def test_packing(make, docs):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.tokenizer_file("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()} | {10**6: "  a\n\n b \t c's don't <|endoftext|>", 10**6 + 1: None}
    got = packing.pack(make(list(texts.items())), per_packer=64).collect()
    pieces, room = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == texts.keys()
    for i, t in texts.items():
        ids = np.array(slow.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]] and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 1024 for r in own[1:]) and all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    for parts in room.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 1024
    edge = packing.pack(make(EDGE)).collect()
    assert Counter(r["doc_id"] for r in edge if r["piece"] == 0) == Counter(i for i, _ in EDGE) and packing.pack(make(EDGE).where("false")).count() == 0


def test_packing_keeps_large_ids_beside_nulls(make):
    ids = [2**53 + 1, 2**53 + 3, None, -(2**62) - 1]
    got = packing.pack(make([(i, f"text {k}") for k, i in enumerate(ids)])).collect()
    assert sorted(map(repr, ids)) == sorted(repr(r["doc_id"]) for r in got)


def test_sum_of_squares_rule():
    rng = np.random.default_rng(1)
    lengths, cap = rng.integers(1, 31, 200), 30
    where, offset = packing.sum_of_squares(lengths, cap)
    levels: list[int] = []
    for s, w, o in zip(lengths.tolist(), where.tolist(), offset.tolist()):
        count = Counter(x for x in levels if x < cap)
        def total(c):
            return sum(v * v for v in c.values())
        options = {}
        for h in {x for x in levels if x + s <= cap} | {0}:
            c = Counter(count)
            if h:
                c[h] -= 1
            if h + s < cap:
                c[h + s] += 1
            options[h] = total(c)
        assert options[o] == min(options.values())
        if o == 0:
            levels.append(s)
        else:
            assert levels[w] == o
            levels[w] += s
    big = np.minimum(1024, rng.gamma(2.0, 220, 6000).astype(int) + 1)
    where, offset = packing.pack_lengths(big, 1024)
    assert len(set(where.tolist())) <= 1.005 * big.sum() / 1024 + 2


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, x, b, i)
    return row[-1]


def _next(row, x, b, i):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[j - 1] + 1, row[j - 1] + (x != y)))
    return out


def test_automaton_equals_distance():
    import random

    rng = random.Random(3)
    terms = ["idiot", "worthless", "scum", "stupidity", "moron"]
    auto = toxicity.Automaton(terms, ["lowe"])
    for _ in range(3000):
        t = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "o", "s"])
        t = "".join(t) or "x"
        want = min(((edits(t, w), w) for w in terms if edits(t, w) <= toxicity.edits_allowed(w)), default=None)
        got = auto.match(t)
        if not t.startswith("lowe"):
            assert (got and (got[1], got[0])) == want
    assert auto.match("loweabc") == ("lowe*", 0) and auto.match("low") is None


def test_toxicity(spark, make):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    rows = labels.collect()
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([got[r["doc_id"]]["predicted"] == r["toxic"] for r in rows if got[r["doc_id"]]["held_out"]]) > 0.9
    edge = toxicity.score_documents(make(EDGE), labels).collect()
    assert len(edge) == len(EDGE) and all(0 <= r["score"] <= 1 for r in edge)
    # The model of the tasks is the one of a loop over the same rows.
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    known = [(texts[r["doc_id"]], r["toxic"]) for r in rows if r["toxic"] is not None and r["doc_id"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    one, two = toxicity.train(docs, labels), toxicity.fit(known)
    assert (one.terms, one.stems, one.hit, one.context) == (two.terms, two.stems, two.hit, two.context) and one.terms
    assert np.allclose(one.weights, two.weights)
    none = toxicity.score_documents(make(EDGE), labels.where("false")).collect()
    assert {r["predicted"] for r in none} == {0}
    assert toxicity.score_documents(make(EDGE).where("false"), labels).count() == 0


def test_scores_equal_a_plain_loop():
    """Terms by the edit distance to each of the lexicon, stems by their letters, and the features from these."""
    import math

    rows = [(f"you are an idiot number{i} go away now", 1) for i in range(60)] + [(f'he said "idiot" number{i} is a word', 0) for i in range(60)]
    rows += [(f"plain text about things {i}", 0) for i in range(200)] + [(f"such worth{t} scum here {i}", 1) for i in range(12) for t in ("less", "lesss", "y", "ily", "ier")]
    model = toxicity.fit(rows)
    assert model.terms and model.stems
    texts = ["", "you idiott", "an idoit and scum", "he wrote “worthily” of it", "scun! worthlesss idiots", "idiot " * 50, *(t for t, _ in rows[::7])]

    def closest(token):
        stem = [s for s in model.stems if token.startswith(s)]
        near = min(((edits(token, t), t) for t in model.terms if edits(token, t) <= toxicity.edits_allowed(t)), default=None)
        if near and (near[0] == 0 or not stem):
            return near[1], near[0]
        return (min(stem, key=len) + "*", 0) if stem else None

    for text in texts:
        found = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W\d_]+", text.lower())]
        exact = fuzzy = best = context = quoted = n = 0.0
        for i, (a, b, token) in enumerate(found):
            m = closest(token)
            if not m:
                continue
            n += 1
            w = model.hit.get(m, 0.0)
            around = [x for *_, x in found[max(0, i - 6) : i] + found[i + 1 : i + 7]]
            quote = sum(x in toxicity.REPORTING for x in around) + sum(c in toxicity.QUOTES for c in text[max(0, a - 2) : a] + text[b : b + 2])
            quoted += min(quote, 2) / 2
            context += max(-3.0, min(3.0, sum(model.context.get(x, 0.0) for x in around)))
            best = max(best, w)
            exact, fuzzy = exact + w * (m[1] == 0), fuzzy + w * (m[1] > 0)
        want = [best, math.log1p(exact), math.log1p(fuzzy), context / n, quoted / n, 100 * n / (len(found) + 20)] if n else [0.0] * 6
        got, hits = model.features(text)
        assert hits == n and np.allclose(got, want)


def test_quotation_and_abuse_differ():
    rows = [(f"you are an idiot number{i} go away now", 1) for i in range(60)] + [(f'he said "idiot" number{i} is a word', 0) for i in range(60)] + [(f"plain text about things {i}", 0) for i in range(200)]
    model = toxicity.fit(rows)
    score = lambda t: float(model.score(np.array([model.features(t)[0]]))[0])
    assert score("you are an idiot go away") > 0.5 > score('she said "idiot" is a word')


def test_quality(make, docs):
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in quality.assess(docs).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(tri)
        cover = set()
        for k, x in enumerate(tri):
            if n[x] > 1:
                cover |= {k, k + 1, k + 2}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (got[i]["kept"] and got[i]["base_failed"])
    lean = {r["doc_id"]: r["kept"] for r in quality.assess(docs, counts=False).collect()}
    assert lean == {i: r["kept"] for i, r in got.items()}
    import pyarrow as pa

    order = list(quality.RULES)
    for _, _, data, offs in textbytes.chunks(pa.array([t for _, t in rows])):
        one, two = quality.judge(quality.Measured(data, offs), order, quality.RULES) < 0, quality.judge(quality.Measured(data, offs), order[::-1], quality.RULES) < 0
        assert (one == two).all()
    for counts in (True, False):
        assert quality.assess(make(EDGE), counts=counts).count() == len(EDGE) and quality.assess(make(EDGE).where("false"), counts=counts).count() == 0


def test_cascade_takes_measures_of_survivors_alone(monkeypatch):
    import pyarrow as pa

    asked = []
    for name, f in list(quality.MEASURES.items()):
        monkeypatch.setitem(quality.MEASURES, name, lambda m, f=f, name=name: (asked.append((name, len(f(m)))), f(m))[1])
    texts = ["a b", "# " * 80, " ".join(f"word{i}" for i in range(90)), None]
    (_, _, data, offs), = textbytes.chunks(pa.array(texts))
    verdict = quality.judge(quality.Measured(data, offs), ["few_words", "symbols", "repeated_words", "dup_lines"], quality.RULES)
    assert verdict.tolist() == [0, 1, -1, 0]
    assert asked == [("n_words", 4), ("n_symbols", 2), ("n_repeat_words", 1), ("n_dup_lines", 1)]


def test_cascade_order_is_rejections_per_cost():
    on = lambda *x: np.isin(np.arange(100), x)
    rules = {n: quality.Rule((m,), None) for n, m in (("cheap", "a"), ("dear", "b"), ("dear_too", "b"), ("none", "c"))}
    steps = quality.order_of({"cheap": on(*range(5)), "dear": on(*range(60)), "dear_too": on(*range(55, 64)), "none": on()}, {"a": 1.0, "b": 64.0, "c": 4.0}, rules)
    assert [(s.rule, s.rejected, s.seen) for s in steps] == [("cheap", 5, 100), ("dear", 55, 95), ("dear_too", 4, 40), ("none", 0, 36)]
    # Where b is taken anyway, its rules come first.
    steps = quality.order_of({"cheap": on(*range(5)), "dear": on(*range(60)), "dear_too": on(*range(55, 64)), "none": on()}, {"a": 1.0, "b": 64.0, "c": 4.0}, rules, free=("b",))
    assert [s.rule for s in steps][:2] == ["dear", "dear_too"]


def test_extraction(spark):
    w = html_extract.fit_weights(html_extract.labelled_pages())
    page = """<html><head><title>T x</title><script>var a = "</p>";</script></head><body><header>Site name</header><nav><a href=x>home</a></nav>
    <div id="cookie-notice">We use cookies</div><article><h1>Big <i>Title</i></h1><p>First with a <a href=y>link</a> and&nbsp;more &lt;ok&gt; fo<b>o</b>bar here for length.<br>
    next</p><div class="ad">Buy now</div><!-- no --><p>Second &am one which goes on.</p></article><aside>Related</aside><section class="comments"><p>I think this is a reader comment
    which goes on and on for quite some time</p></section><form><label>Name</label></form><footer>&copy; x</footer>"""
    assert html_extract.main_text(page, w) == "Big Title\n\nFirst with a link and more <ok> foobar here for length. next\n\nSecond &am one which goes on."
    assert html_extract.main_text("", w) == "" and html_extract.main_text("<nav>a b</nav>", w) == ""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    import html

    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r["page_id"]]["text"] == "\n\n".join(b for b in blocks if b) and got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id long, url string, html string")
    assert [r["text"] for r in html_extract.extract(odd).collect()] == ["", "", ""] and html_extract.extract(odd.where("false")).count() == 0


def test_extraction_drops_opaque_elements_alone():
    w = html_extract.fit_weights(html_extract.labelled_pages())
    body = "<article><h1>A title of some words</h1><p>First words that go on for a while.</p><p>Second words that go on as well.</p></article>"
    want = "A title of some words\n\nFirst words that go on for a while.\n\nSecond words that go on as well."
    for odd in ('<svg class="i" data-x="a>b" />', "<svg/>", "<select>", '<object data="x">', "<svg-icon></svg-icon>", "<select-menu>", "<Script src='a.js' />", "<svg viewBox='0'><text>no words of it</text></SVG >", "<script>if (a < b) x('</p>')</script>"):
        assert html_extract.main_text(f"<html><body>{odd}{body}</body></html>", w) == want, odd
        assert html_extract.main_text(f"<html><body>{odd}{body}<svg><text>none</text></svg><p></p></body></html>", w) == want, odd
    for name in ("script", "style", "textarea"):
        assert html_extract.main_text(f"<html><body>{body}<{name}>and so on to the end of it all", w) == want


def test_extraction_decides_by_place_and_not_by_name():
    w = html_extract.fit_weights(html_extract.labelled_pages())
    p = "The text of the page is this one and it goes on for a while."
    inside = f'<article><h1>Title of it all</h1><p>{p}</p><h2 id="feedback">Feedback loops</h2><p class="alert">Take care of this one here.</p><h2 id="discussion">Discussion</h2><p>{p}</p><h2 id="related-work">Related work</h2><p>More.</p></article>'
    assert html_extract.main_text(f"<html><body>{inside}</body></html>", w).split("\n\n") == ["Title of it all", p, "Feedback loops", "Take care of this one here.", "Discussion", p, "Related work", "More."]
    teaser = f"<main><h1>Main title here</h1><p>{p}</p></main><aside><article><h3>Teaser</h3><p>A teaser text of some words that one could read.</p></article></aside>"
    assert html_extract.main_text(teaser, w) == f"Main title here\n\n{p}"
    menu = "<ul><li>Home</li><li>About us</li><li>Contact</li><li>Prices</li></ul>"
    assert html_extract.main_text(f"{menu}<h1>The title</h1><p>{p}</p>", w) == f"The title\n\n{p}"
    assert html_extract.main_text(f"{menu}<p>{p}</p><p>{p}</p>", w) == f"{p}\n\n{p}"
    voices = "".join(f'<div class="voice"><p>I liked this text number {k} a lot, thank you for it.</p></div>' for k in range(3))
    for element in ("article", "div class='xx'"):
        assert html_extract.main_text(f"<{element}><h1>The title</h1><p>{p}</p><p>{p}</p></{element.split()[0]}><div class='voices'>{voices}</div>", w) == f"The title\n\n{p}\n\n{p}"
    wrapped = f'<body class="has-sidebar"><div class="page with-sidebar"><article><h1>The title</h1><p>{p}</p></article></div></body>'
    assert html_extract.main_text(wrapped, w) == f"The title\n\n{p}"


def test_extraction_on_held_out_layouts():
    w = html_extract.fit_weights(html_extract.labelled_pages())
    kept, n = [0, 0], [0, 0]
    for page, content in html_extract.labelled_pages(150, seed=99):
        got = html_extract.main_text(page, w).split("\n\n")
        for block, good in zip([b for b in html_extract.blocks_of(page) if b.words], content):
            kept[good] += " ".join(block.said) in got
            n[good] += 1
    assert kept[1] > 0.98 * n[1] and kept[0] < 0.02 * n[0]


def test_extraction_without_an_article_element():
    w = html_extract.fit_weights(html_extract.labelled_pages())
    p, q, r = (f"The {x} text of the page is this one and it goes on for a while." for x in ("first", "second", "third"))
    assert html_extract.main_text(f"<body><nav>Menu</nav><table><tr><td>{p}<br>{q}</td></tr></table><p>{r}</p></body>", w) == f"{p} {q}\n\n{r}"
    beside = f"<body><div id='main'><h1>Title</h1><p>{p}</p><p>{q}</p></div><div class='sidebar'><h3>Popular</h3><p>The ten best places of the city, as our readers chose them.</p></div></body>"
    assert html_extract.main_text(beside, w) == f"Title\n\n{p}\n\n{q}"
    assert html_extract.main_text(f"<body><div class='page has-sidebar'><div>{p}</div><div>{q}</div></div></body>", w) == f"{p}\n\n{q}"
    teasers = "".join(f"<article><h3>Story {k}</h3><p>A short teaser of some words that one may read.</p></article>" for k in "ab")
    assert html_extract.main_text(f"<body><div><h1>Title</h1><p>{p}</p><p>{q}</p></div><section>{teasers}</section></body>", w) == f"Title\n\n{p}\n\n{q}"
    assert html_extract.main_text(f"<body><header><h1>Daily</h1></header><article><h2>Title</h2><p>{p}</p><p>{q}</p><p>{r}</p></article>{teasers}</body>", w).endswith(f"Title\n\n{p}\n\n{q}\n\n{r}")


def test_extraction_knows_roles_and_beginnings_of_class_words():
    w = html_extract.fit_weights(html_extract.labelled_pages())
    p, q = (f"The {x} text of the page is this one and it goes on for a while." for x in ("first", "second"))
    other = "Words that are not of the text, and as many as a paragraph has."
    assert html_extract.main_text(f"<body><div class='container'><h1>Title</h1><p>{p}</p><p>{q}</p></div><div class='commentlist'><p>{other}</p></div><div class='footerlinks'><p>{other}</p></div></body>", w) == f"Title\n\n{p}\n\n{q}"
    assert html_extract.main_text(f"<body><div role='main'><p>{p}</p><p>{q}</p></div><div role='complementary'><p>{other}</p></div><div role='contentinfo'><p>{other}</p></div></body>", w) == f"{p}\n\n{q}"
    assert html_extract.main_text(f"<body><article><h1>Title</h1><div class='table-responsive'><table><tr><td>One</td><td>Two</td></tr></table></div><div class='container'><p>{p}</p></div></article></body>", w) == f"Title\n\nOne\n\nTwo\n\n{p}"


def test_extraction_goes_on_after_insertions():
    w = html_extract.fit_weights(html_extract.labelled_pages())
    p = "The text of the page is this one and it goes on for a while."
    advert = "<div class='ads'><ul><li><a href='/'>One two</a></li><li><a href='/'>Three four</a></li><li><a href='/'>Five</a></li></ul></div>"
    for element in ("article", "main", "div"):
        assert html_extract.main_text(f"<body><nav>Menu</nav><{element}><h1>Title</h1><p>{p}</p>{advert}<p>The end.</p></{element}><footer>Foot</footer></body>", w) == f"Title\n\n{p}\n\nThe end.", element


def test_extraction_is_linear():
    import time

    w = html_extract.fit_weights(html_extract.labelled_pages(60))
    for page in ("<div class='a'>" * 20000 + "x y z" + "</div>" * 20000, "<p>" + "word " * 500_000, "<div><b>" * 20000, "<" * 50000, "<a " * 50000, "<div><p hidden>x" * 10000):
        began = time.perf_counter()
        html_extract.main_text(page, w)
        assert time.perf_counter() - began < 5


def test_leaks(spark, make):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))

    def grams(t):
        w = re.findall(r"\w+", (t or "").lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    items = {r[0]: grams(r[1]) for r in bench.select("item_id", "text").collect()}
    own = {r[0]: grams(r[1]) for r in docs.select("doc_id", "text").collect()}
    want = {(d, i) for d, have in own.items() for i, g in items.items() if len(have & g) >= 0.9 * len(g)}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert want and got == want
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench, broadcast_windows=0).collect()} == want
    item = spark.createDataFrame([(1, "A train leaves Boston with 120 people and after 3 hours arrives in Denver with 90 people on board")], "item_id long, text string")
    rows = [(1, "Now: A train leaves Madrid with 450 people and after 7 hours arrives in Lisbon with 80 people on board. Done"), (2, "a plane leaves with people"), *EDGE]
    got = decontaminate.find_leaks(make(rows), item).collect()
    assert [(r["doc_id"], r["kind"]) for r in got] == [(1, "reparameterised")]
    assert decontaminate.find_leaks(make(rows).where("false"), item).count() == 0 and decontaminate.find_leaks(make(rows), item.where("false")).count() == 0


def test_leaks_held_word_for_word(spark, make):
    q = "In the spring Rose will bring 12 boxes of apples to the market and sell them to Bill for 30 coins"
    item = spark.createDataFrame([(1, q)], "item_id long, text string")
    rows = [(1, f"{q}. Prices rose and the bill grew."), (2, q.lower()), (3, q.upper()), (4, f"Well. {q}"), (5, " ".join(q.split()[:12]) + " prices rose and the bill grew"), *EDGE[:4], *EDGE[6:]]
    for few in (decontaminate.BROADCAST_WINDOWS, 0):
        got = decontaminate.find_leaks(make(rows), item, broadcast_windows=few).collect()
        assert sorted((r["doc_id"], r["kind"], r["share"]) for r in got) == [(k, "verbatim", 1.0) for k in (1, 2, 3, 4)]
    low = spark.createDataFrame([(1, q.lower())], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.find_leaks(make(rows), low).collect()} == {1, 2, 3, 4}


def kinds(spark, make, items, rows):
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return sorted((r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.find_leaks(make(rows), items).collect())


def test_leaks_of_all_scripts_and_places(spark, make):
    items = [
        "В понедельник утром поезд везёт Ивана из города Москва с 120 пассажирами и через 3 часа он приходит в город Тверь",
        "Paris, London and Rome each have 12 trams that run for 40 km to the north side of the town",
        "capital of France",
        "Question。答えは何ですか，次の問題に進みます 12 回",
        "Der Dichter Čapek schrieb 14 Stücke und 3 Romane für das kleine Theater am Rand der Stadt",
        "a lift carries ١٢ crates up in ٣ hours and then comes back down for the men who wait below",
        "ox",
    ]
    rows = [
        (1, "Так. В понедельник утром поезд везёт Петра из города Казань с 75 пассажирами и через 9 часа он приходит в город Омск. Всё"),
        (2, "So: Oslo, Berlin and Madrid each have 31 trams that run for 9 km to the north side of the town"),
        (3, "the name of the capital of France is known to all of us here"),
        (4, "前の文。Question。答えは何ですか，次の問題に進みます 57 回。"),
        (5, "Ja, der Dichter Šalda schrieb 2 Stücke und 11 Romane für das kleine Theater am Rand der Stadt"),
        (6, "a lift carries 450 crates up in 7 hours and then comes back down for the men who wait below"),
        (7, "an ox and nothing more of note in all of this"),
        (8, "Trams: Oslo, Berlin and Madrid each have 31 trams that run for 9 km to the north side of the town. " + items[1]),
    ]
    r = "reparameterised"
    assert kinds(spark, make, items, rows) == [(1, 0, r), (2, 1, r), (3, 2, "verbatim"), (4, 3, r), (5, 4, r), (6, 5, r), (8, 1, "verbatim")]


def plain_leaks(items, rows, share=0.75):
    """The rules of the operator, one text at a time and all pairs."""
    import unicodedata

    import regex

    single = r"[\p{Lo}&&[\u3041-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF]]"
    token = regex.compile(rf"(?V1)(?P<one>{single})|(?P<num>\p{{Nd}}+(?:[.,:٫٬]\p{{Nd}}+)*)|(?P<word>[[\p{{L}}\p{{M}}]--{single}]+(?:['’][[\p{{L}}\p{{M}}]--{single}]+)*)")

    def fold(c):
        if c == "’":
            return "'"
        if unicodedata.category(c) == "Nd":
            return str(unicodedata.decimal(c))
        return c.casefold() if len(c.casefold()) == 1 else c.lower()[0]

    def read(text):
        text = unicodedata.normalize("NFKC", text or "")
        found = list(token.finditer(text))
        low = ["".join(map(fold, m[0])) for m in found]
        out, last = [], None  # [placeholder or None, value, end]
        for i, m in enumerate(found):
            kind = None
            if m["num"]:
                kind = "number"
            elif i and found[i - 1]["num"] and low[i] in decontaminate.UNITS:
                kind = "unit"
            elif m["word"] and len(m[0]) > 1 and unicodedata.category(m[0][0]) in ("Lu", "Lt"):
                kind = "name"
            if kind == "name" and out and out[-1][0] == "name" and m.start() - last == 1 and text[last] in " -":
                out[-1][1] += text[last] + low[i]
            else:
                out.append([kind, low[i]])
            last = m.end()
        k = min(5, len(low))
        plain = {tuple(low[i : i + k]) for i in range(len(low) - k + 1)} if k >= 3 else set()
        wins = {tuple((kind, value if kind else value) for kind, value in out[i : i + 5]) for i in range(len(out) - 4)}
        wins = {w for w in wins if sum(kind is None for kind, _ in w) >= 2}
        return low, plain, wins

    def form(w):
        return tuple(kind or ("=", value) for kind, value in w)

    def slots(w):
        return [v for kind, v in w if kind]

    own = {}
    for d, t in rows:
        if d is not None:
            low, plain, wins = read(t)
            have = own.setdefault(d, (set(), set()))
            for k in (3, 4, 5):
                have[0].update(tuple(low[i : i + k]) for i in range(len(low) - k + 1))
            have[1].update(wins)
    out = []
    for i, t in items:
        _, plain, wins = read(t)
        for d, (have, theirs) in own.items():
            results = []
            if plain:
                results.append((len(plain & have) / len(plain), True))
            if any(slots(w) for w in wins):
                match = {w: [x for x in theirs if form(x) == form(w)] if slots(w) else [w] * (tuple(v for _, v in w) in have) for w in wins}
                votes = {}
                for w, xs in match.items():
                    for x in xs:
                        for a, b in zip(slots(w), slots(x)):
                            votes.setdefault(a, {}).setdefault(b, set()).add(w)
                best = {a: max((len(ws), b) for b, ws in by.items())[1] for a, by in votes.items()}
                ok = {w: [x for x in xs if all(best[a] == b for a, b in zip(slots(w), slots(x)))] for w, xs in match.items()}
                ok = {w: xs for w, xs in ok.items() if xs}
                results.append((len(ok) / len(wins), all(w in xs for w, xs in ok.items())))
            results = [r for r in results if r[0] >= share]
            if results:
                s, same = max(results)
                out.append((d, i, round(s, 9), "verbatim" if same else "reparameterised"))
    return sorted(out)


def test_leaks_equal_the_plain_rules(spark, make):
    import random

    rng = random.Random(8)
    words = "the of train runs слово дом 'tis it's l’eau naïve ὁδός straße 本 の dog-eared Km km hours ﬁne".split() + ["e\u0301t\u0301"]
    names = "Paris London Иван Čapek Ελλάδα NASA New York McCoy Élodie".split()

    def sentence(n):
        out = []
        for _ in range(n):
            x = rng.random()
            out.append(rng.choice(words) if x < 0.7 else rng.choice(names) if x < 0.85 else rng.choice(["12", "3.5", "1,200", "٣٤", "7 km", "9:30", "5 hours"]))
        return (rng.choice([" ", " ", ", ", "\n", ". "])).join(out)

    def vary(text):
        out = []
        for w in text.split(" "):
            x = rng.random()
            if x < 0.25 and any(c.isdigit() for c in w):
                w = str(rng.randint(1, 99))
            elif x < 0.25 and w[:1].isupper():
                w = rng.choice(names)
            elif x < 0.04:
                w = rng.choice(words)
            out.append(w.upper() if x > 0.97 else w)
        return " ".join(out)

    items = [(i, sentence(rng.choice([2, 3, 4, 6, 12, 25]))) for i in range(40)] + [(90, None), (91, ""), (0, "one more text of the same item as the first")]
    rows = list(EDGE)
    for k in range(250):
        rows.append((100 + k, " ".join([sentence(rng.randint(0, 30)), vary(rng.choice(items[:40])[1]), sentence(rng.randint(0, 20)), vary(rng.choice(items[:40])[1])])))
    merged = [(i, t) for i, t in items[1:40]]  # the item with two texts is left to the test of repeated ids
    frame = spark.createDataFrame(merged + items[40:42], "item_id long, text string")
    for few in (decontaminate.BROADCAST_WINDOWS, 0):
        got = sorted((r["doc_id"], r["item_id"], round(r["share"], 9), r["kind"]) for r in decontaminate.find_leaks(make(rows), frame, broadcast_windows=few).collect())
        assert got == plain_leaks(merged, rows)
    assert {k for *_, k in got} == {"verbatim", "reparameterised"}
    twice = spark.createDataFrame([items[0], items[-1], (None, "a b c d e f")], "item_id long, text string")
    assert decontaminate.find_leaks(make(rows), twice).where("item_id is null").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    leak = bench.orderBy("item_id").first()["text"]
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    more = [(9001, None), (9002, "12 34"), (9003, f"Intro here. {leak} And the end."), (9004, "my password=hunter2222 is set in this file"), (9005, "my password=hunter2222 is set in this file")]
    base.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in more], base.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == list(cp.COLUMNS)
        if name == "secrets":
            assert docs.where("doc_id = 9004").first()["text"] == "my <secret> is set in this file"
    assert {9001, 9002} & seen["language_id"] == set() and 9004 in seen["language_id"]
    assert 9005 not in seen["near_duplicates"] and 9003 in seen["near_duplicates"] and 9003 not in seen["decontamination"]
    assert seen["packing"] == seen["secrets"] == seen["decontamination"]
    assert {r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()} == seen["packing"]


def plain_pipeline(docs, bench):
    """doc_id and text of what the pipeline packs, by the plain rules of its stages; languages of no labels reject nothing but texts without letters."""
    from test_pairs import plain_components
    from test_spans import plain_owned

    rows = [r for r in docs if re.search(r"[^\W\d_]", r[1] or "")]
    groups = plain_components([(r[0], r[1]) for r in rows])
    seen, one = set(), []
    for r in rows:
        if r[0] is None or (groups[r[0]][1] == r[0] and (r[0], r[1]) not in seen):
            seen.add((r[0], r[1]))
            one.append(r)
    leaks = {d for d, *_ in plain_leaks(bench, [(r[0], r[1]) for r in one])}
    one = [r for r in one if r[0] not in leaks]
    out = []
    for r, (_, found) in zip(one, sorted_spans(one, plain_owned)):
        marks = [(int(a), int(b), "secret") for _, a, b in (x.split(":") for x in found.split(",") if x)]
        from tessaro.llm import spans

        out.append((r[0], spans.replace(r[1], marks)))
    return out


def sorted_spans(rows, owned):
    keyed = [(k, r[1], r[3]) for k, r in enumerate(rows)]
    return owned(keyed)


def test_pipeline_equals_the_plain_rules(spark, tmp_path):
    import corpus_pipeline as cp

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    leak = bench.orderBy("item_id").first()["text"]
    some = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(70)
    more = [(None, "a text without an id but with password=hunter2222", "en", None, None), (None, "a text without an id but with password=hunter2222", "en", None, None), (9001, None, "en", "s", 0), (9002, "12 34", None, "s", 5)]
    more += [(9003, f"Intro here. {leak} And the end.", "en", "s", 9), (9004, "my password=hunter2222 is set in this file", "en", "b", 9), (9004, "my password=hunter2222 is set in this file", "en", "a", 9), (9005, "long " * 30000, "en", "s", 9)]
    table = some.unionByName(spark.createDataFrame(more, some.schema)).withColumns({c: F_lit("clash") for c in ("key", "digest", "found", "row", "of", "masked", "packer")})
    for labels in (True, False):
        path = tmp_path / str(labels)
        docs = table if labels else table.withColumn("lang", F_lit(None).cast("string"))
        docs.write.parquet(str(path / "documents.parquet"))
        bench.write.parquet(str(path / "benchmark.parquet"))
        rows = [tuple(r[c] for c in cp.COLUMNS) for r in docs.collect()]
        want = plain_pipeline(rows, [(r[0], r[1]) for r in bench.collect()])
        now = docs
        for k, (name, stage) in enumerate(cp.STAGES[:-1]):
            stage(spark, now, str(path)).write.parquet(str(path / name))
            now = spark.read.parquet(str(path / name))
        assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["text"])) for r in now.collect())
        assert [r["source"] for r in now.where("doc_id = 9004").collect()] == ["a"]
        assert all(r["n_chars"] == len(r["text"]) for r in now.where("text like '%<secret>%'").collect())
        packed = cp.run(spark, str(path)).where("piece = 0").collect()
        assert Counter(r["doc_id"] for r in packed) == Counter(i for i, _ in want)


def test_pipeline_stages_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as cp

    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_scratch_tables_go(spark, tmp_path):
    from tessaro.llm import storage

    with storage.scratch("stay"):
        one = storage.materialise(spark.range(3), "gone")
        two = storage.materialise(one, "stay")
    assert two.count() == 3 and any("stay-" in p for p in storage._WRITTEN) and not any("gone-" in p for p in storage._WRITTEN)
    assert spark.conf.get(storage._CLEANUP, "false") == "false"
