"""Mixing, fingerprints, host reputation, quotations: against plain Python, and on odd rows."""

import hashlib
import re

import numpy as np
import pytest

from riskweave.llm import fingerprints, hosts, mixing, quotes

DOC = "doc_id long, text string, lang string, source string, n_chars long, size int, target string, row int, part int, kind int"


def docs(spark, rows):
    """Rows of (doc_id, text, source) with further columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, "en", s, 0, 1, "x", 2, 3, 4) for i, t, s in rows], DOC)


ODD = [(1, None, "a"), (2, "", "a"), (3, "a b c", None), (3, "a b c", None), (None, "x y", "b"), (4, "w " * 5000, "b"), (5, " \t\n", "c"), (6, "é ü\u00a0z", "é")]


def by_hand(rows):
    """Targets by resharing until none is above three times its source's size."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while free:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            out |= share
            break
        for s in above:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= above
    return sizes, out


@pytest.mark.parametrize("rows", [ODD, [(i, "w " * (i % 17 + 1), f"s{i % 5}" if i % 3 else "hot") for i in range(400)]])
def test_mix_meets_its_targets(spark, rows):
    got = mixing.mix(docs(spark, rows)).select("row.source", "row.size", "doc_id", "size", "source_size", "target", "taken", "copies", "position").collect()
    sizes, targets = by_hand(rows)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        source, size = r[0], r[3]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(targets[source])
        assert 0 <= r["taken"] <= 3 * size and (r["position"] is None) == (r["taken"] == 0)
        assert r["position"] is None or 0 <= r["position"] <= 1
        taken[source] = taken.get(source, 0) + r["taken"]
    for source in sizes:
        assert abs(taken[source] - targets[source]) <= 1


def test_mix_again_is_the_same(spark):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 4}") for i in range(300)]
    one, two = (sorted(map(tuple, mixing.mix(docs(spark, part)).drop("row", "schedule").collect())) for part in (rows, rows[::-1]))
    assert one == two


def test_mix_of_rows_without_ids(spark):
    rows = [(None, f"w{i} " * (i % 3 + 1), "a") for i in range(400)] + [(i, "w " * 900, "b") for i in range(20)]
    one, two = ({r[0]: tuple(r[1:]) for r in mixing.mix(docs(spark, part)).where("doc_id IS NULL").select("row.text", "before", "taken").collect()} for part in (rows, rows[::-1]))
    assert len(one) == 400 and one == two
    assert len({before for before, _ in one.values()}) == 400


def test_mix_of_nothing(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, "", "a"), (2, None, None)])).agg({"taken": "sum"}).first()[0] == 0


def test_due_inverts_the_integral(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 101).select((F.col("id") / 100).alias("u"))
    schedule = F.array(*map(F.lit, (2.0, 0.5, 0.1, 3.0)))
    steps = 30_000
    weights = [2.0, 0.5, 0.1, 3.0]

    def at(t):
        k = min(int(t * 3), 2)
        return weights[k] + (weights[k + 1] - weights[k]) * (t * 3 - k)

    total, sums = 0.0, [0.0]
    for i in range(steps):
        total += at((i + 0.5) / steps) / steps
        sums.append(total)
    for r in rows.select("u", mixing.due(F.col("u") * 70, F.lit(70.0), schedule).alias("t")).collect():
        assert sums[round(r["t"] * steps)] / total == pytest.approx(r["u"], abs=2e-3)


def test_training_order_repeats_and_drops(spark):
    rows = [(i, "w " * 10, "few" if i < 10 else "many") for i in range(200)]
    out = mixing.training_order(mixing.mix(docs(spark, rows)))
    counts = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert out.columns == docs(spark, []).columns and counts == {"few": 30, "many": 170}


def test_fingerprints(spark):
    words = ["alpha", "beta", "gamma", "delta", "rho", "tau", "psi", "chi"]
    rows = [(i, " ".join(words[(i * 3 + k * k) % 8] + str((i // 4) % 5) for k in range(30)), "s") for i in range(900)] + [(5000, None, None), (5001, "", None), (5002, "🙂 é", None), (5003, rows_text := "alpha0 " * 3000, None), (5003, rows_text, None)]
    got = fingerprints.fingerprint_documents(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    want = {}
    for i, (doc_id, text, _) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text)
        want.setdefault(doc_id, set()).add((n, hashlib.sha256((text[: n - n // 3] + following[: n // 3]).encode()).hexdigest()))
    for r in got:
        assert (r["n_chars"], r["edited_sha256"]) in want[r["doc_id"]]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    texts = {i: t or "" for i, t, _ in rows}
    prints = {}
    for r in got:
        prints.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_fingerprints_of_rows_without_ids(spark):
    rows = [(None, f"text number {i} " * 3, "s") for i in range(1500)] + [(None, "copy", "s")] * 3 + [(i, f"named {i}", "s") for i in range(400)]
    table = docs(spark, rows)
    near = fingerprints.with_next(table)
    sizes = near.where("doc_id IS NULL").groupBy("part").count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 600
    order = [r["text"] for r in table.selectExpr("doc_id", "text", "xxhash64(text) AS h").orderBy("doc_id", "h").collect()]
    nulls, named = order[:1503][::-1], order[1503:][::-1]
    order = named + nulls
    want = sorted(zip(order, order[1:] + order[:1], strict=True))
    assert sorted((r["text"], r["next_text"]) for r in near.collect()) == want


def test_fingerprints_of_little(spark):
    assert fingerprints.fingerprint_documents(docs(spark, [])).count() == 0
    one = fingerprints.fingerprint_documents(docs(spark, [(None, "abc def", None)])).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 7
    assert fingerprints.fingerprint_documents(docs(spark, [(None, None, None), (1, "a", "s"), (None, "b", None)])).count() == 3


URLS = [
    "http://a.ORG/x", "https://sub.example.org/es/1", "http://example.org/en/17?x=/", "http://x.com/fr/1", "http://x.com/de", "http://x.com/de/#", "nothing", None, "", "a://", "://h", "http://org", "http://ÄB.com/de/", "http://forg/x",
    "http://h.co.uk:80/p", "x://y://z/q", "http://example.org/en/2", "http://a\nb/c\nd",
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "html", "r") for i, u in enumerate(URLS)] + [(None, "http://q.net/", None, None)], "page_id long, url string, html string, rule string")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(len(URLS))] + [(0, None, None), (None, 1, 1), (1, 7, 0)], "doc_id long, quality int, toxic int")
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
    got = {r["page_id"]: r for r in hosts.judge(pages, labels).collect()}
    assert len(got) == len(URLS) + 1
    for i, url in enumerate(URLS):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            raw = re.split(r"[/?#]", rest, maxsplit=1)[0]
            host = "".join(c.lower() if c.isascii() else c for c in raw)
            path = re.split(r"[?#]", rest[len(raw) :], maxsplit=1)[0]
        fits = [r for r, _ in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule = max(fits, key=len, default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), url
        assert got[i]["verdict"] == dict(rules)[rule] if rule else got[i]["verdict"] in ("allow", "block")


def test_reputation_shrinks_and_blocks(spark):
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(["bad.spam.net"] * 60 + ["good.fine.net"] * 60 + ["new.spam.net"] * 2 + ["one.other.net"])], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i < 60 else 1) for i in range(120)] + [(122, 0)], "doc_id long, quality int")
    got = {r["host"]: r for r in hosts.judge(pages, labels).collect()}
    assert got["bad.spam.net"]["verdict"] == "block" and got["good.fine.net"]["verdict"] == "allow"
    assert got["new.spam.net"]["good_rate"] < got["good.fine.net"]["good_rate"]
    assert 0 < got["one.other.net"]["good_rate"] < 1
    assert hosts.judge(pages.limit(0), labels).count() == 0
    assert {r["good_rate"] for r in hosts.judge(pages, labels.limit(0)).collect()} == {0.5}


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there.\nHow are you?"), (1, 1, "a", "> Hello there.\n> how are you?\nFine."), (1, 2, "u", "other"), (1, 3, "a", "On Monday X wrote:\n> > hello   there. How are you\n> fine\nGood > bad"), (1, 4, "u", ">nothing\nx"),
        (2, 0, None, None), (None, 1, "u", "> a"), (2, 1, "u", ""), (2, 1, "u", ""), (3, 5, "u", "> later"), (3, 6, "u", "later"),
    ]
    chain = [(9, i, "u", f"m{i}" if not i else f"> m{i - 1}\nm{i}") for i in range(40)]
    m = spark.createDataFrame([(*r, 7, "z") for r in rows + chain], "conv_id long, turn long, role string, text string, depth int, body string")
    out = quotes.link_quotes(m).collect()
    got = {(r["conv_id"], r["turn"]): r for r in out}
    assert len(out) == len(rows) + len(chain)
    assert got[1, 1]["reply_to"] == 0 and got[1, 1]["body"] == "Fine." and got[1, 3]["reply_to"] == 1 and got[1, 3]["body"] == "Good > bad" and (got[1, 3]["quotes"], got[1, 3]["linked"]) == (2, 2)
    assert got[1, 4]["reply_to"] is None and got[1, 4]["quotes"] == 1 and got[2, 0]["body"] == "" and got[3, 5]["reply_to"] is None
    assert [(got[9, i]["root_turn"], got[9, i]["depth"], got[9, i]["body"]) for i in range(40)] == [(0, i, f"m{i}") for i in range(40)]
    assert quotes.link_quotes(m.limit(0)).count() == 0


def test_quotes_of_lines_and_sentences(spark):
    rows = [
        (1, 0, "First line\nsecond line here\nThird one. Fourth sentence! And the end"), (1, 1, "> second line here\nyes"), (1, 2, "> And the end\nok"), (1, 3, "> First line\n> second line here\nboth"),
        (1, 4, "> line here\nhalf a line"), (1, 5, "> Third one. Fourth\n> sentence!\nwrapped anew"), (1, 6, "> second line here\n> First line\nother order"), (1, 7, "First line\nsomething else"), (1, 8, "> first line\nagain"), (2, 0, "> First line\nelsewhere"),
    ]
    m = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["linked"], r["reply_to"]) for r in quotes.link_quotes(m).collect()}
    linked = {k: v[1] for k, v in got.items() if v[0]}
    assert linked == {(1, 1): 0, (1, 2): 0, (1, 3): 0, (1, 4): 0, (1, 5): 0, (1, 8): 7}


def test_quotes_equal_a_search_in_every_earlier_message(spark):
    """Quotes of any words in a row, wrapped and nested anew, some with words left out, some of nothing, one long message."""
    import re

    random = np.random.default_rng(31)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünder", "x-y"]
    plain = lambda t: [w for w in re.sub(r"[^\w]+|_", " ", t.lower()).split(" ") if w]
    rows, own, want = [], {}, {}
    for conv in range(6):
        turns = 60 if conv else 200  # one long conversation
        for turn in range(turns):
            words = random.choice(vocabulary, 3000 if (conv, turn) == (0, 3) else int(random.integers(1, 40))).tolist()
            said = " ".join(words[:7]) + ".\n" + " ".join(words[7:])
            lines, quotes_ = [], []
            if turn and random.random() < 0.7:
                for level in range(1, 1 + int(random.integers(1, 3))):
                    source = own[conv, int(random.integers(0, turn))]
                    if random.random() < 0.2:
                        source = random.choice(vocabulary, 8).tolist()
                    a = int(random.integers(0, len(source)))
                    b = a + int(random.integers(1, 30))
                    fragments = [source[a:b]]
                    if random.random() < 0.3 and len(source) > b + 2:
                        fragments.append(source[b + 1 : b + 6])
                    fragments = [f for f in fragments if f]
                    quotes_.append((level, fragments))
                    text = " [...] ".join(" ".join(f) for f in fragments).upper()
                    cut = len(text) // 2 + text[len(text) // 2 :].find(" ") if " " in text[len(text) // 2 :] else len(text)
                    lines += ["Am 3. Mai hat X geschrieben:"] if random.random() < 0.3 and not lines else []
                    lines += [">" * level + " " + text[:cut]] + ([">" * level + text[cut:]] if text[cut:].strip() else []) + [""]
            own[conv, turn] = plain(said)
            rows.append((conv, turn, "u", "\n".join([*lines, said])))
            found = []
            for level, fragments in quotes_:
                holds = lambda words, f: any(words[i : i + len(f)] == f for i in range(len(words) - len(f) + 1))
                origins = [t for t in range(turn) if all(holds(own[conv, t], plain(" ".join(f))) for f in fragments)]
                found.append((level, max(origins) if origins else None))
            there = sorted((level, -t) for level, t in found if t is not None)
            want[conv, turn] = (-there[0][1] if there else None, said)
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["body"]) for r in quotes.link_quotes(m).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert {k: plain(v[1]) for k, v in got.items()} == {k: plain(v[1]) for k, v in want.items()}
    assert sum(v[0] is not None for v in want.values()) > 150


def test_attributions_by_shape(spark):
    rows = [
        (1, 0, "alpha beta gamma"), (1, 1, "Am 3. Mai hat X geschrieben:\n> alpha beta\nyes"), (1, 2, "Anna:\n\n> gamma\nok"), (1, 3, "I do not quite agree with what follows here:\n> beta gamma\nno"), (1, 4, "Le mar. 4 mai, Y a écrit :\n> beta\noui"), (1, 5, "Note:\nno quote"),
        (1, 5, "Note:\nno quote"), (1, 6, "> no quote\ntwice there"),
    ]
    m = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: (r["reply_to"], r["body"]) for r in quotes.link_quotes(m).collect()}
    assert got == {0: (None, "alpha beta gamma"), 1: (0, "yes"), 2: (0, "ok"), 3: (0, "I do not quite agree with what follows here:\nno"), 4: (0, "oui"), 5: (None, "Note:\nno quote"), 6: (5, "twice there")}
