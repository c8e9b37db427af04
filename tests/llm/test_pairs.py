"""Neighbours and near duplicates against brute force; the pipeline and the registry."""

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
import corpus_pipeline
from riskweave.llm import neardup, neighbours, storage
from riskweave.llm.graph import components

SF = "/root/testdata/sf0.001"


def brute(ids, vectors, every=100, k=10):
    out = {}
    for q, v in zip(ids, vectors):
        if q % every == 0:
            d = np.sqrt(((vectors - v) ** 2).sum(axis=1))
            order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
            out[q] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def result(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_nearest_of_clusters(spark):
    random = np.random.default_rng(5)
    centres = random.normal(size=(40, 16))
    vectors = (centres[random.integers(0, 40, 6000)] + random.normal(scale=0.2, size=(6000, 16))).round(6)
    vectors[1000:1400] = vectors[0]  # a large group of equal vectors
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, cell int")
    got, want = result(neighbours.nearest(df)), brute(np.arange(6000), vectors)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert recall > 0.95
    assert [i for i, _ in got[0]] == list(range(1000, 1010)) and all(i == 0 or i in range(1000, 1400) for i, _ in got[1100])
    for q, found in got.items():
        assert all(d == pytest.approx(float(np.sqrt(((vectors[i] - vectors[q]) ** 2).sum()))) for i, d in found)


def test_nearest_of_few_and_odd(spark):
    good = [(i, [float(i), 1.0]) for i in range(0, 700, 100)]
    odd = [(1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, []), (300, [300.0, 1.0])]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>")
    got = result(neighbours.nearest(df))
    assert got == brute(np.array([i for i, _ in good]), np.array([v for _, v in good]))
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert result(neighbours.nearest(spark.createDataFrame([(0, [1.0])], df.schema))) == {}


def groups_by_hand(texts, idf):
    """Classes of texts by comparing all pairs that share a shingle."""
    k, w, b = neardup.shingles(pa.array(texts), idf)
    bags = [dict(zip(k[b[i] : b[i + 1]].tolist(), w[b[i] : b[i + 1]].tolist())) for i in range(len(texts))]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = texts[i] == texts[j]
            if not same and bags[i] and bags[j]:
                common = sum(min(v, bags[j].get(s, 0)) for s, v in bags[i].items())
                same = common / (sum(bags[i].values()) + sum(bags[j].values()) - common) >= 0.8 - 1e-9
            if same:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def near_texts():
    random = np.random.default_rng(8)
    word = lambda: "".join(random.choice(list("abcdefghij"), 4))
    common = [word() for _ in range(60)]
    texts = []
    for i in range(60):
        own = [word() for _ in range(int(random.integers(8, 120)))]
        if i % 5 == 0:
            own += common  # a passage that many texts share
        texts.append(" ".join(own))
        for _ in range(i % 4):
            copy = list(own)
            for _ in range(int(random.integers(0, 1 + len(copy) // 40))):
                copy[int(random.integers(0, len(copy)))] = word()
            texts.append(" ".join(copy))
    drift = [word() for _ in range(100)]
    for i in range(25):  # a chain of small edits
        drift[i * 4] = word()
        texts.append(" ".join(drift))
    return texts + ["", "", " ", "one", "one", "one two", "a b c d", "A, b c D", *[texts[3]] * 40]


def test_near_duplicates_equal_brute_force(spark):
    texts = near_texts()
    d = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, key string, weight double")
    got = {r["doc_id"]: r for r in neardup.near_duplicates(d).collect()}
    want = groups_by_hand(texts, neardup.word_idf(d))
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    assert all(got[i]["kept"] == (want[i] == i) and got[i]["class_rows"] == want.count(want[i]) for i in range(len(texts)))
    one = neardup.keep_one(d)
    assert one.columns == d.columns and sorted(r["doc_id"] for r in one.collect()) == sorted(set(want))


def test_near_copies_inside_a_large_family_below_the_threshold(spark, monkeypatch):
    """300 texts of one template at 0.75 to 0.79, 40 of them with a copy at 0.80 to 0.90: the key's leader is like none."""
    monkeypatch.setattr(neardup, "BLOCK", 40)
    random = np.random.default_rng(21)
    new = lambda n: [f"u{x}" for x in random.integers(0, 10**12, n)]
    template = [f"t{i}" for i in range(300)]
    own = [new(9) for _ in range(260)]
    own += [own[i][: 4 + i % 3] + new(5 - i % 3) for i in range(40)]
    texts = [" ".join(template + x) for x in own]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = neardup.word_idf(d)
    k, w, b = neardup.shingles(pa.array(texts), idf)
    bags = [dict(zip(k[b[i] : b[i + 1]].tolist(), w[b[i] : b[i + 1]].tolist())) for i in range(len(texts))]

    def alike(i, j):
        common = sum(min(v, bags[j].get(s, 0)) for s, v in bags[i].items())
        return common / (sum(bags[i].values()) + sum(bags[j].values()) - common)

    assert all(0.75 < alike(i, j) < 0.79 for i, j in ((41, 50), (50, 259), (0, 100), (1, 262)))
    assert all(0.8 < alike(i, 260 + i) < 0.9 for i in range(40))
    want = groups_by_hand(texts, idf)
    assert len(set(want)) == 260
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(d).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b c d e f g"), (None, "a b c d e f g"), (3, "q w e r t y u i o p"), (3, "q w e r t y u i o p"), (4, "long " * 30_000), (5, "long " * 30_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = neardup.near_duplicates(d).collect()
    assert len(out) == len(rows) and {r["class_id"] for r in out} == {1, None, 3, 4}
    assert sorted((r["doc_id"] or 0) for r in neardup.keep_one(d).collect()) == [0, 1, 3, 4]
    assert neardup.near_duplicates(d.limit(0)).count() == 0 and neardup.keep_one(d.limit(0)).count() == 0


def test_samples_agree_at_the_rate_of_similarity():
    idf = neardup.Idf(np.zeros(0, np.uint64), np.zeros(0), 5.0)
    random = np.random.default_rng(2)
    agreed, expected = [], []
    for _ in range(120):
        a = [f"w{random.integers(0, 10**6)}" for _ in range(200)]
        b = list(a)
        for p in random.integers(0, 200, 8):
            b[p] = "z"
        k, w, bounds = neardup.shingles(pa.array([" ".join(a), " ".join(b)]), idf)
        s = neardup.samples(k, w, bounds)
        agreed.append((s[0] == s[1]).mean())
        one, two = set(k[: bounds[1]].tolist()), set(k[bounds[1] :].tolist())
        expected.append(len(one & two) / len(one | two))
    assert np.mean(agreed) == pytest.approx(np.mean(expected), abs=0.03)


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 102), (101, 103)]
    got = {r["key"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 104)}}


def test_pipeline_stages_take_effect(spark):
    docs, rows = corpus_pipeline.table(spark, SF, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = storage.materialize(stage(spark, docs, SF))
        assert docs.columns == columns
        rows[name] = [r["doc_id"] for r in docs.collect()]
    assert len(rows["quality"]) >= len(rows["toxicity"]) >= len(rows["near-dedup"]) == len(set(rows["near-dedup"])) and set(rows["mix"]) <= set(rows["near-dedup"])
    junk = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    assert len(junk & set(rows["quality"])) < len(junk) / 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted({r["doc_id"] for r in packed}) == sorted(set(rows["mix"]))
    assert sum(r["piece"] == 0 for r in packed) == len(rows["mix"])


def test_registry():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
