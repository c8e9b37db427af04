"""Toxicity, perplexity, packing, extraction: held-out accuracy, exact probabilities, round trips."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from riskweave.llm import extraction, packing, perplexity, storage, toxicity
from riskweave.llm.queries import tokenizer_path

DOC = "doc_id long, text string, lang string, source string, score double, bits int, row string"
CLEAN = "the river ran past a small house and trees grew over its roof while birds sang at dawn near water".split()
TOXIC = ["idiot", "moron", "stupid"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0.0, 1, "r") for i, t, lang in rows], DOC)


def labels(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int")


def made(n, seed=3):
    random = np.random.default_rng(seed)
    rows, marks = [], []
    for i in range(n):
        words = random.choice(CLEAN, 30).tolist()
        toxic = i % 4 == 0
        if toxic:
            words[5] = str(random.choice(TOXIC)).replace("o", "oo" if i % 8 == 0 else "o")
        rows.append((i, " ".join(words), "en"))
        marks.append((i, int(toxic)))
    return rows, marks


def test_toxicity_of_held_out_texts(spark):
    rows, marks = made(600)
    odd = [(1000, None, None), (1001, "", "en"), (None, "idiot", "en"), (1002, "idioot " * 3000, "en"), (1002, "idioot " * 3000, "en")]
    got = toxicity.judge(docs(spark, rows + odd), labels(spark, [*marks, (5, None), (None, 1), (7, 9)], "toxic")).collect()
    assert len(got) == len(rows) + len(odd)
    truth = dict(marks)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    odd_scores = [r["score"] for r in got if r["doc_id"] == 1002]
    assert odd_scores[0] == odd_scores[1] > 0.5


def test_held_out_labels_teach_nothing(spark):
    rows, marks = made(200)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in marks]
    one, two = ({r["doc_id"]: r["score"] for r in toxicity.judge(docs(spark, rows), labels(spark, m, "toxic")).collect()} for m in (marks, flipped))
    assert one == two


def test_long_texts_teach(spark):
    """The only toxic texts are long ones; the sample is bounded by its characters, not by their length."""
    rows, _ = made(200, seed=5)
    clean = [(i, t.replace("idiot", "river").replace("moron", "river").replace("stupid", "river").replace("moroon", "river").replace("idioot", "river"), lang) for i, t, lang in rows]
    long = [(1000 + i, " ".join(CLEAN * 150) + " idiot moron" * 60, "en") for i in range(40)]
    marks = [(i, 0) for i, _, _ in clean] + [(i, 1) for i, _, _ in long]
    got = {r["doc_id"]: r for r in toxicity.judge(docs(spark, [*clean, *long, (5000, "you idiot moron " * 9, "en")]), labels(spark, marks, "toxic")).collect()}
    assert got[5000]["predicted"] == 1 and not any(got[i]["predicted"] for i, _, _ in clean)
    model = toxicity.fit(docs(spark, long + clean), labels(spark, marks, "toxic"), sample_chars=20_000)
    assert model.scores(pa.array(["you idiot moron " * 9]))[0] > model.scores(pa.array([clean[0][1]]))[0]


def test_toxicity_without_labels(spark):
    rows, marks = made(8)
    assert len({r["score"] for r in toxicity.judge(docs(spark, rows), labels(spark, [], "toxic")).collect()}) == 1
    assert toxicity.judge(docs(spark, []), labels(spark, marks, "toxic")).count() == 0


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney by plain counting: a function (five symbols) -> probability."""
    grams = [g for t in texts for g in perplexity.grams(pa.array([t]))[0].tolist()]
    count = {5: {}}
    for g in grams:
        count[5][g] = count[5].get(g, 0) + 1
    for k in (4, 3, 2, 1):
        count[k] = {}
        for g in count[k + 1]:
            s = g & ((1 << (12 * k)) - 1)
            count[k][s] = count[k].get(s, 0) + 1
    distinct = len(count[1]) + 1

    def discounts(c):
        n = [sum(1 for v in c.values() if v == i) for i in range(5)]
        if not n[1] or not n[2]:
            return 0.5, 0.75, 0.9
        y = n[1] / (n[1] + 2 * n[2])
        d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k - 0.5 for k in (1, 2, 3)]
        return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d))

    d = {k: discounts(count[k]) for k in count}
    context = {k: {} for k in count}
    for k in count:
        for g, v in count[k].items():
            all_, rest = context[k].get(g >> 12, (0, 0.0))
            context[k][g >> 12] = (all_ + v, rest + d[k][min(v, 3) - 1])

    def p(g, k=5):
        if k == 0:
            return 1 / distinct
        own = g & ((1 << (12 * k)) - 1)
        if own >> 12 not in context[k]:
            return p(g, k - 1)
        all_, rest = context[k][own >> 12]
        v = count[k].get(own, 0)
        return (v - d[k][min(v, 3) - 1] if v else 0) / all_ + rest / all_ * p(g, k - 1)

    return p


def test_perplexity_equals_plain_counting(spark):
    texts = ["the cat sat on the mat", "a cat  ate the rat", "the rat ran", "2024 tea 日本", "the the the mat"]
    model = perplexity.train(docs(spark, [(i, t, "en") for i, t in enumerate(texts)] + [(9, None, None), (10, "", None)]))
    p = kneser_ney(texts)
    for text in [*texts, "unseen words zz", "the", ""]:
        wide, _ = perplexity.grams(pa.array([text]))
        bits, symbols = model.bits(pa.array([text]))
        assert symbols[0] == len(wide) and bits[0] == pytest.approx(-sum(np.log2(p(g)) for g in wide.tolist()))


def test_perplexity_of_a_large_corpus_equals_plain_counting(spark, monkeypatch):
    """Over a million symbols: grams seen once are still known; texts are scored in several chunks."""
    monkeypatch.setattr(perplexity, "CHUNK_BYTES", 400_000)
    texts = ["the cat sat on the mat " * 60_000, "zebu quay", "a rat ran"]
    d = docs(spark, [(i, t, "en") for i, t in enumerate(texts)] + [(5, "zebu quay", None), (6, None, "en")])
    p = kneser_ney(texts)
    got = {bytes(r["key"]): r for r in perplexity.score(d, perplexity.train(d.where("doc_id < 3"))).collect()}
    assert len(got) == 4
    for text in [*texts, ""]:
        wide, n = np.unique(perplexity.grams(pa.array([text]))[0], return_counts=True)
        r = got[hashlib.md5(text.encode()).digest()]
        assert r["symbols"] == n.sum() and r["bits"] == pytest.approx(-sum(c * np.log2(p(g)) for g, c in zip(wide.tolist(), n.tolist())))


def test_probabilities_sum_to_one(spark):
    model = perplexity.train(docs(spark, [(0, "abba cab", "en"), (1, "bac abc", "en")]))
    alphabet = [*{*perplexity.symbols(pa.array(["abba cab bac abc"]))[0].tolist()} - {perplexity.BEGIN}]
    for context in ("abba", "cabb", "zzzz"):
        head = 0
        for c in context:
            head = head << 12 | ord(c)
        total = sum(2.0 ** model.log2(np.array([head << 12 | a])) for a in [*alphabet, 4000])
        assert total[0] == pytest.approx(1.0)


def test_quality_keeps_clean_and_drops_noise(spark):
    rows, _ = made(400)
    noise = [(2000 + i, " ".join("%" + w[::-1] + "***" for w in t.split()), "en") for i, t, _ in rows[:40]]
    odd = [(3000, None, "en"), (3001, " \n ", None), (None, rows[0][1], None), (3002, rows[1][1] + " " + " ".join(CLEAN * 400), "xx"), (3002, rows[1][1], "xx")]
    good = labels(spark, [(i, 1) for i, _, _ in rows[:200]] + [(2000, 0), (None, 1), (3, None)], "quality")
    d = docs(spark, rows + noise + odd)
    out = perplexity.classify(d, good, keep_rows=True).collect()
    assert len(out) == d.count()
    kept = {r["doc_id"] for r in out if r["kept"]}
    assert len(kept & {i for i, _, _ in rows}) > 395 and not kept & {i for i, _, _ in noise} and not kept & {3000, 3001}
    assert set(out[0]["row"].asDict()) == set(d.columns)
    assert perplexity.classify(d.limit(0), good).count() == 0
    assert perplexity.classify(d, good.limit(0)).where("kept").count() == d.count() - 2


def test_limits_are_the_quantiles_of_the_language(spark):
    """Judged anew from the model alone, by numpy, for a language with many held-out documents and one with few."""
    random = np.random.default_rng(8)
    rows = [(i, " ".join(random.choice(CLEAN, int(random.integers(3, 40)))), "en" if i % 20 else "de") for i in range(1600)]
    good = labels(spark, [(i, 1) for i, _, _ in rows], "quality")
    out = {r["doc_id"]: r for r in perplexity.classify(docs(spark, rows), good, low=0.02, high=0.97).collect()}
    held = {r[0] for r in spark.createDataFrame([(i,) for i, _, _ in rows], "doc_id long").where("pmod(xxhash64(doc_id, 'held out'), 4) = 0").collect()}
    for lang, n in (("en", 300), ("de", 1)):
        own = [r for i, r in out.items() if r["lang"] == lang and i in held]
        assert len(own) >= n
        if len(own) < perplexity.LEAST_DOCUMENTS:
            own = [r for i, r in out.items() if i in held]
            assert len({(r["low"], r["high"]) for r in out.values() if r["lang"] == lang}) == 1
            continue
        rates, sizes = np.log2([r["perplexity"] for r in own]), np.array([r["symbols"] for r in own])
        centre = np.quantile(rates, 0.5, method="inverted_cdf")
        judged = 2 ** ((rates * sizes + perplexity.SHRINK * centre) / (sizes + perplexity.SHRINK))
        assert np.allclose(sorted(judged), sorted(r["judged"] for r in own))
        assert own[0]["low"] == pytest.approx(np.quantile(judged, 0.02, method="inverted_cdf")) and own[0]["high"] == pytest.approx(np.quantile(judged, 0.97, method="inverted_cdf"))
    assert all(r["kept"] == (r["low"] <= r["judged"] <= r["high"]) for r in out.values())


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    texts = pa.array(["ab  cd " * 900, "short 12", "", "x" * 5000])
    wide, bounds = perplexity.grams(texts)
    monkeypatch.setattr(perplexity, "SLICE_BYTES", 700)
    monkeypatch.setattr(perplexity, "SLICE_SYMBOLS", 333)
    got = [np.zeros(0, np.int64) for _ in texts]
    for first, own, ends in perplexity.parts(texts):
        for k in range(len(ends) - 1):
            got[first + k] = np.concatenate([got[first + k], own[ends[k] : ends[k + 1]]])
    for k in range(len(texts)):
        assert got[k].tolist() == wide[bounds[k] : bounds[k + 1]].tolist()


def test_tables_on_the_way_are_deleted(spark, tmp_path, monkeypatch):
    """What stays is what the result reads: scores and limits."""
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    rows, _ = made(60)
    out = perplexity.classify(docs(spark, rows), labels(spark, [(i, 1) for i, _, _ in rows[:40]], "quality"))
    assert len(list(tmp_path.iterdir())) == 2 and out.count() == 60
    with storage.cleared():
        storage.materialize(out)
        storage.kept(out)
        assert len(list(tmp_path.iterdir())) == 4
    assert len(list(tmp_path.iterdir())) == 3


@pytest.mark.parametrize("texts", [["a b"] * 50 + ["word " * n for n in (1, 700, 2047, 2048, 2049, 5000)] + [None, "", "don't İΣ <|endoftext|> 日本"]])
def test_pack_round_trip(spark, texts):
    from tokenizers import Tokenizer

    d = docs(spark, [(i if i else None, t, "en") for i, t in enumerate(texts)] + [(1, "a b", "en")])
    got = packing.pack(d, tokenizer_path()).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t in [(i if i else None, t) for i, t in enumerate(texts)] + [(1, "a b")]:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 2048) + 2


def test_pack_nothing(spark):
    assert packing.pack(docs(spark, []), tokenizer_path()).count() == 0


def test_best_fit_takes_the_fullest_bin():
    assert sorted(sorted(b) for b in packing.best_fit([6, 5, 4, 3, 2], 10)) == [[0, 2], [1, 3, 4]]
    bins = packing.best_fit(np.random.default_rng(1).integers(1, 101, 3000).tolist(), 100)
    assert sorted(i for b in bins for i in b) == list(range(3000))


PAGE = """<html><head><title>T</title><script>var x="<p>no</p>";</script></head><body><div id="cookie-notice">We use cookies, please accept, now.</div><header><h1>Site</h1></header>
<ul class="menu"><li><a href=/>Home</a><li><a href=/b>B</a></ul><div class="layout"><div class="content-wrap"><h2>Title &amp; more</h2><p>First para, with some   text, and commas, long enough to count really well.
<p>Second para &eacute;, also long enough, and more commas, so it counts as well.</p><ul><li>item one</li><li>item two</li></ul></div><div class="sidebar"><p>Side bar text, that is long enough to be counted, but never mind.</p></div>
<div id="comments"><p>I am a reader, and I comment, at length, on all of this here.</p></div></div><form><p>Sign up, here, now, to get our newsletter in your inbox</p></form><footer>c</footer></body>"""


def test_extraction(spark):
    pages = [(1, "u", PAGE, 3), (2, None, None, 3), (3, "u", "", 3), (None, "u", "plain &lt;text&gt;\n only", 3), (4, "u", "<p>cut &am", 3), (5, "u", "<div>" * 3000 + "deep text that goes on, and on, for a while" , 3), (5, "u", "<nav>a</nav><script>x", 3), (6, "u", "<article><h1>A</h1><p>b<br>c</p></article>" + "x" * 1000, 3)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string, text int")
    out = extraction.extract_pages(d).collect()
    assert len(out) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in out)
    got = {(r["page_id"], r["text"]) for r in out}
    first = "Title & more\nFirst para, with some text, and commas, long enough to count really well.\nSecond para é, also long enough, and more commas, so it counts as well.\nitem one\nitem two"
    assert {(1, first), (2, ""), (3, ""), (None, "plain <text> only"), (4, "cut &am"), (5, "deep text that goes on, and on, for a while"), (5, "")} <= got
    assert extraction.extract_pages(d.limit(0)).count() == 0


def generated(random):
    """A page and the blocks of its article."""
    word = lambda: "".join(random.choice(list("abcdefghijklmno"), int(random.integers(2, 9))))
    sentence = lambda n: " ".join(word() for _ in range(n)) + random.choice([",", "."])
    prose = lambda: " ".join(sentence(int(random.integers(6, 15))) for _ in range(int(random.integers(2, 6))))
    links = lambda n: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n))
    blocks, inside = [], []

    def add(markup, *texts):
        inside.append(markup)
        blocks.extend(texts)

    title = sentence(5)
    add(f"<h1>{title}</h1>", title)
    for _ in range(int(random.integers(4, 12))):
        kind = int(random.integers(0, 10))
        a, b, c = prose(), prose(), sentence(4)
        if kind == 0:
            add(f'<h4><a href="/x">{c}</a></h4>', c)
        elif kind == 1:
            add(f'<ul class="sources"><li>{c} <a href="http://s/1">{a}</a></li><li><a href="http://s/2">{b}</a></li></ul>', f"{c} {a}", b)
        elif kind == 2:
            add(f'<section class="related-work"><h2>{c}</h2><p>{a}</p></section>', c, a)
        elif kind == 3:
            add(f'<p class="tag">{a}</p>', a)
        elif kind == 4:
            add(f"<p>{c} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {a}</p>", f"{c} x=2 {a}")
        elif kind == 5:
            add(f"<blockquote><p>{a}</p></blockquote><p>{b}</p>", a, b)
        elif kind == 6:
            add(f"<table><tr><td>{a}</td><td>{c}</td></tr></table>", a, c)
        elif kind == 7:
            add(f'<div class="ad-slot">{sentence(8)}</div><p>{a}<script>var t="</p>";</script></p>', a)
        elif kind == 8:
            add(f'<div class="header-note"><p>{a}</p></div><!-- {b} -->', a)
        else:
            add(f"<p>{a}<p>{b}", a, b)
    for _ in range(3):
        a = prose()
        add(f"<p>{a}</p>", a)
    body = "".join(inside)
    wrap = int(random.integers(0, 4))
    body = [f"<article>{body}</article>", f'<div class="post-content">{body}</div>', f'<div id="x"><div>{body}</div></div>', f"<main><div>{body}</div></main>"][wrap]
    noise = lambda: "".join(
        random.choice(
            [
                f"<nav><ul>{links(5)}</ul></nav>", f'<div class="sidebar"><p>{prose()}</p><ul>{links(6)}</ul></div>', f'<div class="cookie-notice"><p>{prose()}</p></div>', f'<div id="comments"><div class="comment"><p>{prose()}</p></div></div>', f'<aside><p>{prose()}</p></aside>',
                f"<form><p>{prose()}</p><input></form>", f'<div class="ad">{sentence(9)}</div>', f'<div style="display: none"><p>{prose()}</p></div>', f"<header><p>{sentence(5)}</p></header>", f'<ul class="menu">{links(7)}</ul>', f'<div role="navigation">{links(3)}</div>',
            ],
            int(random.integers(1, 5)),
        )
    )
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{noise()}{body}{noise()}<footer>&copy; {sentence(4)}</footer></body></html>", "\n".join(blocks)


def test_extraction_of_generated_pages(spark):
    """Pages whose article is known, block by block."""
    random = np.random.default_rng(17)
    pages = [generated(random) for _ in range(400)]
    got = {r["page_id"]: r["text"] for r in extraction.extract_pages(spark.createDataFrame([(i, "u", p) for i, (p, _) in enumerate(pages)], "page_id long, url string, html string")).collect()}
    wrong = [i for i, (_, want) in enumerate(pages) if got[i] != want]
    assert not wrong, (len(wrong), pages[wrong[0]][0], got[wrong[0]], pages[wrong[0]][1])


@pytest.mark.parametrize(("names", "out"), [("related-work", False), ("related-posts", True), ("tag", False), ("comment-list", True), ("comments", True), ("header-note", False), ("site-header", True), ("ad", True), ("adage", False), ("note content", False), ("sidebar_left2", True), ("", False), ("shares-outstanding", False)])
def test_names_of_parts(names, out):
    assert extraction.unlikely(names) is out
