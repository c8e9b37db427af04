"""Whitening, filter audit and risk-controlled rules: against numpy, plain counting and SQL, with odd rows."""

import math
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from riskweave.llm import audit, cutoffs, queries, whitening

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, part int, mask string, stratum string, n long, x string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "m", "s", 2, "x") for i, t, lang in rows], DOC)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, mask int")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<float>, x string, n int")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _text(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", ["op12_audit", "op13_rules"])
def test_query_equals_sql(spark, duck, name):
    df, result = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    columns, names = sorted(df.columns), result.columns
    assert columns == sorted(names)
    mine = sorted(tuple(_text(r[c]) for c in columns) for r in df.collect())
    assert mine == sorted(tuple(_text(dict(zip(names, r))[c]) for c in columns) for r in result.fetchall())


# Whitening.


def brute(rows, k=4):
    """What op11 has to return, by numpy: {vec_id: rows}, eigenvalues, components."""
    keep = [(i, [math.floor(256 * np.float64(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in keep}))
    n, sums = len(fit), [sum(int(c) for c in column) for column in fit.T]
    centred = fit - np.array(sums) / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    values, components = values[::-1][:k], components[:, ::-1][:, :k]
    return keep, n, sums, values, components, np.trace(centred.T @ centred / n)


def test_whitening_equals_numpy(spark):
    random = np.random.default_rng(5)
    rows = [(i, [float(c) for c in random.normal(size=12) * np.linspace(3, 0.2, 12) + 40]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(None, rows[3][1]), (5, rows[5][1])]
    odd = [(2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2004, [1.0, 2.0]), (2005, [])]
    got = whitening.whiten(vectors(spark, rows + odd).repartition(5)).collect()
    keep, n, sums, values, components, trace = brute(rows)
    assert len(got) == 4 * len(keep) and {r["n"] for r in got} == {n}
    found = {}
    for r in got:
        found.setdefault((r["vec_id"], r["component"]), set()).add((r["deviation"], r["whitened"], r["explained"], r["identity_error"]))
    for i, x in keep:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for k in range(4):
            ((d, w, e, error),) = found[i, k + 1]  # equal vectors have equal results to the last bit
            assert d == deviation and abs(w) == pytest.approx(abs((np.array(x) - np.array(sums) / n) @ components[:, k]) / math.sqrt(values[k]), rel=1e-9, abs=1e-9)
            assert e == pytest.approx(values[k] / trace, rel=1e-10) and error < 1e-9
    assert not {2000, 2001, 2002, 2003, 2004, 2005} & {r["vec_id"] for r in got}


def test_whitening_of_few_dimensions_and_none(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0])])).count() == 0  # no two differ
    assert whitening.whiten(vectors(spark, [(0, []), (1, None)])).count() == 0
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)])).collect()  # one direction only
    assert {r["component"] for r in line} == {1} and all(r["explained"] == pytest.approx(1) for r in line)
    assert sum(r["whitened"] ** 2 for r in line) / 9 == pytest.approx(1)


def test_whitening_of_very_uneven_and_very_large_entries(spark):
    random = np.random.default_rng(6)
    uneven = [(i, [float(c) for c in random.normal(size=4) * [1e5, 300.0, 1.0, 0.05]]) for i in range(400)]
    got = whitening.whiten(vectors(spark, uneven)).collect()
    assert len(got) == 1600 and got[0]["identity_error"] < 1e-4
    *_, values, _, trace = brute(uneven)
    for r in got[:4]:
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-4)
    large = whitening.whiten(vectors(spark, [(i, [float(x), -float(y)]) for i, (x, y) in enumerate([(1e15, 1.0), (2e15, 2e30), (3e38, 3.0), (5.0, 1e14)])])).collect()
    assert large and all(r["deviation"] is None for r in large)


def eigen_error(matrix, k):
    values, x = whitening.leading(matrix, k)
    norm = max(np.abs(matrix).max(), 1e-300)
    return values, max(np.abs(matrix @ x - x * values).max() / norm, np.abs(x.T @ x - np.eye(len(values))).max())


@pytest.mark.parametrize("size", [1, 2, 3, 10, 80])
def test_eigenvalues_and_vectors(size):
    a = np.random.default_rng(size).normal(size=(size, 2 * size + 3))
    values, error = eigen_error(a @ a.T, 4)
    assert error < 1e-13 and np.allclose(values, np.linalg.eigvalsh(a @ a.T)[::-1][:4], rtol=1e-13)


def test_eigenvalue_clusters():
    turn = np.linalg.qr(np.random.default_rng(1).normal(size=(40, 40)))[0]
    for leading in ([5, 5, 5, 5, 5], [5, 5 - 1e-14, 5 - 1e-9, 5 - 1e-5], [1e9, 1, 1, 1]):
        matrix = turn @ np.diag([*leading, *np.linspace(0.5, 0, 40 - len(leading))]) @ turn.T
        values, error = eigen_error((matrix + matrix.T) / 2, 4)
        assert len(values) == 4 and error < 1e-12
    for matrix in (np.eye(6), np.kron(np.eye(3), [[2.0, 1.0], [1.0, 2.0]]), np.diag([1.0, 1, 1, 1, 0])):
        values, error = eigen_error(matrix, 4)
        assert len(values) == 4 and error < 1e-13
    assert len(eigen_error(np.ones((5, 5)), 4)[0]) == 1 and not len(whitening.leading(np.zeros((3, 3)), 4)[0])


def test_sturm_counts():
    d, e = np.array([2.0, 2, 2, 2]), np.array([-1.0, -1, -1])
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.array([0.0, 0.5, 1.5, 3.0, 9.0])
    assert whitening.below(d, e**2, at, 1e-300).tolist() == [(values < x).sum() for x in at]


# Filter audit.


def failing(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    return {
        name
        for name, fails in {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text),
        }.items()
        if fails
    }


def plain_audit(rows, marks):
    """Every order applied to every document, one after another."""
    out = {}
    sets = []
    for i, t, lang in rows:
        fails = failing(t or "")
        if i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows):
            fails.add("E")
        sets.append((lang or "", fails, any(m[0] == i and m[1] == 1 for m in marks if m[0] is not None), any(m[0] == i and m[2] == 1 for m in marks if m[0] is not None)))
    for part in {s[0] for s in sets}:
        own = [s for s in sets if s[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, name in enumerate(order):
                earlier = set(order[:step])
                here = [s for s in own if name in s[1] and not s[1] & earlier]
                out[part, order, step + 1] = [
                    sum(not s[1] & (earlier | {name}) for s in own), len(here), sum(name in s[1] and bool(s[1] & earlier) for s in own), sum(s[1] == {name} for s in own), sum(s[2] for s in here), sum(s[3] for s in here),
                ]
        for name in "ABCDE":
            total = sum(v[1] for (p, order, step), v in out.items() if p == part and order[step - 1] == name)
            for (p, order, step), v in out.items():
                if p == part and order[step - 1] == name:
                    v.append(total)
    return out


AUDIT_ROWS = [
    (0, None, "en"), (1, "", "en"), (2, " \t\n", None), (3, "a b # c", ""), (4, "ABC abc", "en"), (5, " ".join(f"w{i}" for i in range(250)), "en"), (6, " ".join(f"w{i}" for i in range(250)), "de"),
    (6, " ".join(f"w{i}" for i in range(250)), "de"), (7, "same " * 300, "en"), (None, "same " * 300, "en"), (None, "same " * 300, "en"), (8, "same " * 300, "de"), (9, "ÀÉ x　y " * 120, "en"), (10, "Z$ " * 500, None), (11, "long " * 60_000, "en"),
]


def test_audit_equals_plain_counting(spark):
    marks = [(0, 1, 0), (5, 1, 0), (5, 0, 1), (6, None, 1), (7, 0, 0), (None, 1, 1), (8, 1, None), (10, 7, 3), (99, 1, 1)]
    got = audit.audit(docs(spark, AUDIT_ROWS).repartition(3), labels(spark, [(*m, 0) for m in marks])).collect()
    want = plain_audit(AUDIT_ROWS, marks)
    assert len(got) == len(want) == 600 * 3
    names = [*audit.OUTCOMES, "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got} == want


def test_audit_without_documents_or_labels(spark):
    none = labels(spark, [])
    assert audit.audit(docs(spark, []), none).count() == 0
    rows = audit.audit(docs(spark, [(1, "x", "en")]), none).collect()
    assert len(rows) == 600 and sum(r["good_lost"] + r["toxic_lost"] for r in rows) == 0


def test_packed_counters_never_overflow_into_their_neighbours():
    most = (1 << 62) - 1
    counts = audit.unpacked(audit.packed(31, True, True) * most + audit.packed(0, False, False) * most)
    assert set(np.unique(counts)) == {0, most}
    assert (counts[:, 0, 1] == most).all() and (counts[:, 1:, 2] == most).all() and (counts[:, :, 3] == 0).all()


# Risk-controlled rules.


def test_measures_by_plain_counting():
    import re

    texts = ["a b c d e a b c d e", "x x x x x x x", "one\n two\none\n\n \none", "", "no repeat here at all #$ | Q.", "Ünï x <y> ! a\tb\x0bc", "p q r s t . p q r s t . q r s t .", None]
    got = cutoffs.measure(pa.array(texts))
    for k, text in enumerate(texts):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        inside = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = {
            "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(cutoffs.SYMBOLS, text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside),
            "n_lines": len(lines), "n_distinct": len(set(words)), "n_capitals": len(re.findall("[A-Z]", text)), "n_marks": len(re.findall(cutoffs.MARKS, text)),
        }
        assert {m: int(got[m][k]) for m in cutoffs.MEASURES} == want, text


@pytest.mark.parametrize(("n", "p"), [(1, 0.02), (30, 0.3), (200, 0.02), (1000, 0.5)])
def test_binomial_tail_is_exact(n, p):
    from fractions import Fraction

    exact, own = Fraction(0), Fraction(p)
    for k in range(n + 1):
        exact += math.comb(n, k) * own**k * (1 - own) ** (n - k)
        if k in (0, 1, n // 50, n // 3, n // 2, n - 1, n):
            assert cutoffs.binomial_tail(k, n, p) == pytest.approx(float(exact), rel=1e-9, abs=1e-14)


def test_upper_bound():
    assert cutoffs.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    assert cutoffs.upper_bound(5, 5, 0.05) == 1.0
    assert cutoffs.binomial_tail(10**6, 10**8, 0.0101) < 1e-10  # large counts


def corpus(n_good, n_bad, lang, first=0):
    random = np.random.default_rng(first + 1)
    words = [f"wo{i}rd" for i in range(900)]
    good = [" ".join(random.choice(words, 40)) for _ in range(n_good)]
    bad = [" ".join(w + "%%%" for w in random.choice(words, 40)) for _ in range(n_bad)]
    rows = [(first + i, t, lang) for i, t in enumerate([*good, *bad])]
    return rows, [(first + i, int(i < n_good), 0) for i in range(n_good + n_bad)]


def test_rules_reject_bad_texts_within_the_risk(spark):
    rows, marks = corpus(900, 100, "en")
    few, few_marks = corpus(30, 10, "xx", 5000)  # too few to certify anything
    none, none_marks = corpus(1200, 60, None, 7000)
    odd = [(9000, None, "en"), (9001, "", "en"), (9002, "word%%% " * 5, "en"), (9003, "a b c d e " * 9, "en"), (None, rows[950][1], "en"), (rows[950][0], rows[950][1], "en"), (9004, "w%%% " * 50_000, "zz")]
    marks = [(*m, 0) for m in [*marks, *few_marks, *none_marks, (None, 1, 0), (3, None, 0), (4, 0, 0), (9004, 5, 0)]]
    d = docs(spark, [*rows, *few, *none, *odd])
    got = cutoffs.judge(d.repartition(4), labels(spark, marks)).collect()
    assert len(got) == d.count()
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not any(kept[i] for i, _, _ in rows[900:]) and not any(kept[i] for i, _, _ in none[1200:])
    assert sum(not kept[i] for i, _, _ in rows[:900]) <= 0.02 * 900
    assert all(kept[i] for i, _, _ in few)  # nothing certified, nothing rejected
    assert not kept[9000] and not kept[9001] and not kept[9002] and not kept[9003] and not kept[None]
    assert all((r["rule"] is None) == (r["kept"] or r["base_failed"]) for r in got)
    assert cutoffs.judge(docs(spark, []), labels(spark, marks)).count() == 0
    unlabelled = cutoffs.judge(d, labels(spark, [])).collect()
    assert all(r["kept"] != r["base_failed"] for r in unlabelled)


def test_copies_are_no_evidence(spark):
    """One good text, a thousand times: the holdout has one text at most and certifies nothing."""
    rows, marks = corpus(1, 200, "en")
    copies = [(10_000 + i, rows[0][1], "en") for i in range(1000)]
    got = cutoffs.judge(docs(spark, rows + copies), labels(spark, [(*m, 0) for m in marks] + [(10_000 + i, 1, 0, 0) for i in range(1000)])).collect()
    assert all(r["kept"] for r in got)


def test_fixed_sequence_stops_at_the_first_failure():
    rows = [{"stratum": "s", "steps": 3, "place": p, "n": n} for p, n in ((None, 1000), (2, 900), (3, 1))]
    passed = cutoffs._certified(0.05, 0.02)(pa.Table.from_pylist(rows))
    assert passed["passed"].to_pylist() == [1]
