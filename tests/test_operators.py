"""Walks of schemas, version keys, suppression by anchors, rule tables and the one-pass report: against plain Python and against the operators one by one."""

import functools
import itertools
import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from riskweave import corpora
from riskweave.functions import paths
from riskweave.operators import dependencies as deps
from riskweave.operators import detect, findings, report, ruletable, suppress
from riskweave.operators.matching import match_rules
from riskweave.plans import detection as d
from riskweave.plans import rollups
from riskweave.rules import ruleset as r

SF = "/root/testdata/sf0.001"


def nest(n, inside, by_array=True):
    for _ in range(n):
        inside = {"anyOf": [inside]} if by_array else {"a": inside}
    return inside


def test_nested_descriptions_equal_a_plain_walk(spark):
    schemas = [nest(n, {"description": f"deep {n}", "x": [{"description": f"item {n}"}]}, by_array) for n in range(22) for by_array in (True, False)]
    schemas += [
        {"a": [[{"description": "array in array"}], {"description": "item"}, 5, "s", None]}, {"description": 5, "b": {"description": {"description": "inner"}}}, {"description": ["list"], "c": {"description": None}},
        {"description": 'quote " and \\ and ​ and 字', "": {"description": ""}}, [], [{"description": "root array"}], "text", 7, None, {}, {"properties": {"description": {"type": "string", "description": "a property of that name"}}},
    ]
    texts = [json.dumps(s) for s in schemas] + ['{"descr\\u0069ption":"escaped key"}', "not json", "", None, '{"description":"cut']
    rows = spark.createDataFrame([("t", "s", str(i), x) for i, x in enumerate(texts)], "target string, snapshot string, tool_name string, input_schema string")
    got = sorted((r["tool_name"], r["description"]) for r in detect.nested_descriptions(rows).collect())
    want = sorted((str(i), x) for i, s in enumerate(schemas) for x in d.walked(s)) + [(str(len(schemas)), "escaped key")]
    assert got == sorted(want)
    assert {x for _, x in want} >= {"deep 20", "item 19", "inner", "a property of that name"} and "deep 21" not in {x for _, x in want}


def test_nested_descriptions_are_scanned_for_invisible_characters(spark):
    rows = spark.createDataFrame([("t", "s", "n", json.dumps({"a": {"description": "zero​wi\U000e0041dth"}}))], "target string, snapshot string, tool_name string, input_schema string")
    got = {(r["rule"], r["message"], r["severity"], r["confidence"], r["cwe"]) for r in detect.scan_nested(rows).collect()}
    assert got == {
        ("mcp-unicode-injection", "[nested schema] Found 2 invisible Unicode characters in tool description (possible steganographic payload)", 3, 2, "CWE-116"),
        ("mcp-unicode-tags-block", "[nested schema] Unicode Tags block characters detected — hidden ASCII message embedded in description", 3, 3, "CWE-116"),
    }


# Versions.


def parts(v):
    v = re.sub(r"^([^-]*)-[^0-9].*\Z", r"\1", v, flags=re.S).rstrip(".")
    return v.split(".") if v else []


def compared(a, b):
    number = lambda x: int(x) if re.fullmatch(r"[+-]?[0-9]+", x) and -(2**63) <= int(x) < 2**63 else None
    for x, y in itertools.zip_longest(parts(a), parts(b), fillvalue="0"):
        nx, ny = number(x), number(y)
        pair = (nx, ny) if nx is not None and ny is not None else (x, y)
        if pair[0] != pair[1]:
            return -1 if pair[0] < pair[1] else 1
    return 0


VERSIONS = [
    *[f"{a}.{b}.{c}" for a in (0, 1, 9, 10, 16, 255) for b in (0, 2, 15, 17) for c in (0, 1, 300)], "", "0", "1", "1.0", "1.0.0.0", "01.2", "2025.12.17", "2025.12.18", "9223372036854775807", "9223372036854775808", "1.9223372036854775807.1", "alpha", "beta.1", "1.alpha", "1.beta", "1.alph", "Alpha",
    "1.2.3-beta", "1.2.3-1", "2.4.9.", "1..2", "v1.2", "v1.10", "1.-1", "+1", "-1", "1a", "2b.1", "1.0.0.0.0.1", "1._", "x.0", "x", "x.0.1",
]


def test_versions_compare_and_sort_by_their_keys(spark):
    rows = spark.createDataFrame([(v,) for v in VERSIONS], "v string").select("v", deps.version_key(F.col("v")).alias("k"))
    keys = {r["v"]: None if r["k"] is None else bytes(r["k"]) for r in rows.collect()}
    keyed = [v for v in VERSIONS if keys[v] is not None]
    for a, b in itertools.product(keyed, repeat=2):
        assert (keys[a] > keys[b]) - (keys[a] < keys[b]) == compared(a, b), (a, b)
    assert {v for v in VERSIONS if keys[v] is None} == {"9223372036854775808", "1.2.3-1", "1..2", "1.-1", "+1", "-1", "1a", "2b.1", "1._"}
    pairs = list(itertools.product(VERSIONS[::3] + VERSIONS[72:], VERSIONS[72:]))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", deps.compare_versions(F.col("a"), F.col("b")).alias("c"), deps.at_most(F.col("a"), deps.version_key(F.col("a")), F.col("b"), deps.version_key(F.col("b"))).alias("le")).collect()
    for row in got:
        assert row["c"] == compared(row["a"], row["b"]) and row["le"] == (row["c"] <= 0), row


def test_sorting_by_key_sorts_versions(spark):
    keyed = [r["v"] for r in spark.createDataFrame([(v,) for v in VERSIONS], "v string").withColumn("k", deps.version_key(F.col("v"))).where("k IS NOT NULL").orderBy("k", "v").collect()]
    assert keyed == sorted(keyed, key=functools.cmp_to_key(lambda a, b: compared(a, b) or (a > b) - (a < b)))


# Suppression.

GLOBS = ["*", "**", "src/**", "*.ts", "server*.py", "a/*/f[0-9]*", "f1?.go", "index.js", "[ab]*", "te*", "lib/a/x.py", "/abs/*.py", "*.min.*", "we[/]ird", "dir.d/**", "a\\*b", "?.py", "x*/**", "*/y*", ".env", "_*", "*.tar.gz", "lib/", "./src/*.py", "[", "a[.]py", "*.p[y]"]
PATHS = ["src/a.py", "x/src/b.ts", "server_1.py", "a/b/f1.go", "f1x.go", "index.js", "lib/a/x.py", "/abs/x.py", "q/app.min.js", "dir.d/z", "a*b", "z.py", "x*/k", "p/yak", ".env", "_p.py", "b.tar.gz", "", "lib/", "./src/c.py", "a.py", "téa", "test_x", "src", "[", "x1/k"]


def test_every_path_has_the_anchor_of_its_globs(spark):
    rows = spark.createDataFrame([(g, p) for g in GLOBS for p in PATHS], "glob string, path string")
    hit = paths.glob_match(F.col("path"), paths.glob_to_regex(F.col("glob")))
    got = rows.select("glob", "path", hit.alias("hit"), F.array_contains(suppress.path_tokens(F.col("path")), suppress.glob_anchor(F.col("glob"))).alias("met")).collect()
    assert not [r for r in got if r["hit"] and not r["met"]] and sum(r["hit"] for r in got) > 60
    assert sum(r["met"] for r in got) < 0.4 * len(got)  # most pairs are never tested


def flagged(spark, found, rules):
    f = spark.createDataFrame(found, "target string, file string, rule string, line int")
    return suppress.suppressed_by_rule(f, spark.createDataFrame(rules, "target string, kind string, glob string, rule string"))


def test_suppression_equals_every_rule_on_every_finding(spark):
    found = [("t", p, rule, i) for i, p in enumerate([*PATHS, None]) for rule in ("r1", "r2")] * 2 + [("u", "src/a.py", "r1", 0), (None, "src/a.py", "r1", 0), ("t", "src/a.py", None, 1)]
    rules = [("t", "glob" if i % 2 else "file_rule", g, None if i % 2 else "r1") for i, g in enumerate(GLOBS[2:])] + [("t", "rule", None, "r2"), ("t", "rule", None, "r2"), ("v", "glob", "*", None)]
    rules = [x for x in rules if x[1] != "rule"][:9] + rules[-3:]
    rows = spark.createDataFrame([(g, p) for _, _, g, _ in rules if g for p in PATHS], "glob string, path string").distinct()
    match = {(r["glob"], r["path"]) for r in rows.where(paths.glob_match(F.col("path"), paths.glob_to_regex(F.col("glob")))).collect()}
    want = [(t, p, rule, line, any(x[0] == t and ((x[1] == "rule" and x[3] == rule) or (x[1] != "rule" and (x[2], p) in match and x[3] in (None, rule))) for x in rules)) for t, p, rule, line in found]
    got = [tuple(r) for r in flagged(spark, found, rules).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and {x[-1] for x in got} == {True, False}


def test_a_hundred_thousand_rules_of_one_target(spark):
    n = 100_000
    rules = spark.range(n).select(F.lit("t").alias("target"), F.lit("glob").alias("kind"), F.concat(F.lit("pkg"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, "/**").otherwise("/*.py")).alias("glob"), F.lit(None).cast("string").alias("rule"))
    found = spark.range(0, n, 10).select(F.lit("t").alias("target"), F.concat(F.lit("lib/pkg"), F.col("id").cast("string"), F.lit("/x/a.py")).alias("file"), F.lit("r").alias("rule"))
    got = suppress.suppressed_by_rule(found, rules)
    assert got.count() == n // 10 and got.where("suppressed").count() == n // 10  # even numbers: all below the folder
    assert "collect_set" not in got._jdf.queryExecution().toString() and "CartesianProduct" not in got._jdf.queryExecution().toString()


# Rules as a table.


def test_rule_table_equals_the_literal_rules(spark):
    texts = d.lines(spark, SF).select("target", "path", "line_no", "line").unionByName(corpora.responses(spark, SF).limit(400).select("target", F.lit("p").alias("path"), F.lit(0).alias("line_no"), F.col("text").alias("line")))
    texts = texts.distinct()
    rules = (*r.SOURCE, *r.EGRESS, *r.DESCRIPTIONS, *r.ARGUMENTS, *r.RESPONSES, *r.HOOKS)
    own = spark.createDataFrame([(str(i), x.pattern) for i, x in enumerate(rules)], "rule_id string, pattern string")
    by_table = ruletable.match_table(texts, "line", own)
    literal = match_rules(texts, "line", rules).select(*texts.columns, F.col("rule_ord").cast("string").alias("rule_id"))
    one, two = sorted(map(str, by_table.collect())), sorted(map(str, literal.collect()))
    assert one == two and len(one) > 500


def test_five_thousand_rules_from_a_table(spark):
    patterns = [rf"(?i)word{i}x\b" if i % 3 else rf"(?:alpha{i}|beta{i}) *=" for i in range(5000)] + ["^x.z$", "", r"[0-9]{9}"]
    texts = [None, "", "xyz", "WORD17X word4999x. alpha12 = beta12 =", "word17xy", "123456789"] + [f"call word{i}x and beta{i}=1" for i in range(0, 5000, 7)]
    rules = spark.createDataFrame([(str(i), p) for i, p in enumerate(patterns)] + [(None, "x"), ("n", None)], "rule_id string, pattern string")
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = sorted((r["k"], int(r["rule_id"])) for r in ruletable.match_table(rows, "text", rules).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE p (id INTEGER, pattern VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?)", list(enumerate(patterns)))
    con.execute("CREATE TABLE t (k INTEGER, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    assert got == sorted(con.execute("SELECT k, id FROM t JOIN p ON regexp_matches(text, pattern)").fetchall()) and len(got) > 1400


# Roll-ups and the report.


def test_counts_by_grouping_sets(spark):
    rows = [("a", 0, "CWE-2"), ("a", 3, None), ("b", 3, "CWE-1"), ("b", 3, ""), ("b", 2, "CWE-2")]
    got = findings.counts(spark.createDataFrame(rows, "target string, severity int, cwe string")).first().asDict()
    assert got == {"findings": 5, "info": 1, "warning": 0, "high": 1, "critical": 3, "with_findings": 2, "by_cwe": {"CWE-1": 1, "CWE-2": 2}}
    none = findings.counts(spark.createDataFrame([], "target string, severity int, cwe string")).first().asDict()
    assert none["findings"] == 0 and none["by_cwe"] == {}


def test_report_reads_each_corpus_once(spark):
    plan = rollups.whole_report(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    scans = {t: len(re.findall(rf"Relation \[{column}", plan)) for t, column in (("supplier", "s_"), ("lineitem", "l_"), ("part", "p_"), ("documents", "doc_id"), ("orders", "o_"))}
    # lineitem holds calls and traces, orders source files and responses; a hook's script is read again by its join.
    assert scans == {"supplier": 1, "lineitem": 2, "part": 3, "documents": 1, "orders": 2}


def test_report_leaves_out_skipped_detectors(spark):
    skipped = ["argument", "connection", "response", "source", "hook", "exposure"]
    assert {x["detector"] for x in rollups.whole_report(spark, SF, skipped).select("detector").distinct().collect()} <= set(report.DETECTORS) - set(skipped)
    with pytest.raises(ValueError):
        report.report(events=None)


def test_messages_of_findings(spark):
    """Texts that a user sees, written out."""
    one = lambda df, **where: [x["message"] for x in df.collect() if all(x[k] == v for k, v in where.items())]
    lines = spark.createDataFrame([("t", "a.py", "python", 3, "requests.get(url)")], "target string, path string, lang string, line_no int, line string")
    assert one(report.from_lines(lines), detector="egress") == [m for m in one(detect.egress_findings(detect.detect_egress(lines)))] and one(report.from_lines(lines), detector="egress")[0].startswith("Tool makes outbound network call via ")
    tool = spark.createDataFrame([("t", 'run "it"', "executes a shell command", None)], "target string, tool_name string, description string, input_schema string")
    assert one(report.from_tools(tool), detector="exposure") == ['Tool "run \\"it\\"" exposes CRITICAL-risk capabilities']
    files = spark.createDataFrame([("t", "x/package.json", "{"), ("t", "requirements.txt", "a\nmcp-remote==0.1.15"), ("t", "pyproject.toml", '"mcp-remote",')], "target string, path string, content string")
    got = {(x["rule"], x["line"]): x for x in report.from_packages(files).collect()}
    assert got["mcp-install-hook-malformed-json", None]["message"] == "package.json could not be parsed (malformed JSON): x/package.json"
    bad = got["dep-audit-vulnerable", 2]
    assert bad["message"].startswith("mcp-remote==0.1.15 is vulnerable (CVE-2025-6514, CVSS 9.6): ") and bad["fix"] == "Upgrade mcp-remote above 0.1.15 to fix CVE-2025-6514" and bad["cwe"] == "CWE-1395" and bad["refs"] == ["CVE-2025-6514"]
    unknown = got["dep-audit-unknown-version", 1]
    assert unknown["message"].startswith("mcp-remote: version unknown in pyproject.toml — manual check required against CVE-2025-6514 (CVSS 9.6): ") and unknown["fix"] == "Pin mcp-remote to a version > 0.1.15 to avoid CVE-2025-6514"
