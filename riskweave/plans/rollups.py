"""Queries of filters, unions and roll-ups over the findings of the planted source files and the responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskweave import corpora
from riskweave.functions import labels
from riskweave.operators import detect, report
from riskweave.operators import findings as ops
from riskweave.operators.matching import ORD, match_rules
from riskweave.plans import dependencies as deps
from riskweave.plans import detection as d
from riskweave.plans import network as net
from riskweave.rules import ruleset as r

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


COLUMNS = ["target", "detector", "rule", "severity", "confidence", "message", "file", "line", "tool", "cwe"]
_SOURCE = f"SELECT * FROM {d.SOURCE} AS s"
_RESPONSE = f"SELECT target, detector, rule, severity, confidence, message, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS INTEGER) AS line, tool, cwe FROM {d.RESPONSES} AS r"
_EGRESS = f"SELECT target, 'egress', 'mcp-network-egress', 1, 0, 'Tool makes outbound network call via ' || method, path, line_no, NULL, NULL FROM {d.EGRESS} AS e"
FINDINGS = f"({_SOURCE} UNION ALL {_RESPONSE} UNION ALL {_EGRESS})"


def findings(spark, sf_dir) -> DataFrame:
    """Source, response and egress findings."""
    lines = d.lines(spark, sf_dir)
    return ops.union_findings(detect.scan_source(lines).drop("quoted"), d.response_findings(spark, sf_dir), detect.egress_findings(detect.detect_egress(lines)).drop("quoted")).select(*COLUMNS)


def targets(spark, sf_dir) -> DataFrame:
    """Every target that the corpora know, and more: one for each customer number below 60, and each source of documents."""
    own = corpora.table(spark, sf_dir, "customer").select(F.concat(F.lit("src"), (F.col("c_custkey") % 60).cast("string")).alias("target"))
    return own.unionByName(corpora.table(spark, sf_dir, "documents").select(F.col("source").alias("target"))).distinct()


TARGETS = "(SELECT DISTINCT 'src' || CAST(c_custkey % 60 AS VARCHAR) AS target FROM customer UNION SELECT source FROM documents)"
FAILURES = f"(SELECT target, CASE WHEN target LIKE '%5' THEN 'timeout' ELSE 'error' END AS reason FROM {TARGETS} AS t WHERE target LIKE '%5' OR target LIKE '%9')"


def failures(spark, sf_dir) -> DataFrame:
    t = targets(spark, sf_dir)
    return t.where(F.endswith("target", F.lit("5")) | F.endswith("target", F.lit("9"))).withColumn("reason", F.when(F.endswith("target", F.lit("5")), "timeout").otherwise("error"))


def _report_sql(source: str, **given: str) -> str:
    """Rows of ``source`` with the columns of a report: those named in ``has``, given ones as they are given, null for the rest."""
    kinds = {"severity": "INTEGER", "confidence": "INTEGER", "line": "INTEGER"}
    default = {"confidence": "0"}
    return "SELECT " + ", ".join(f"CAST({given.get(x, default.get(x, 'NULL'))} AS {kinds.get(x, 'VARCHAR')}) AS {x}" for x in report.REPORT) + f" FROM {source} AS s"


_OWN = lambda *names: {x: x for x in names}
_FIXES = "CASE rule " + " ".join(f"WHEN '{rule}' THEN {d.text_sql(text)}" for rule, text in report.CONNECTION_FIXES.items()) + " END"
_TEXTS = f"(SELECT target, snapshot, tool_name, description, '' AS prefix FROM ({d.TOOLS}) AS t)"
_BASE = ("target", "rule", "severity", "message")
REPORT_PARTS = {
    "source": _report_sql(d.SOURCE, **_OWN("detector", "confidence", "file", "line", "cwe", *_BASE)),
    "egress": _report_sql(f"(SELECT * FROM ({_EGRESS}) AS e(target, detector, rule, severity, confidence, message, file, line, tool, cwe))", **_OWN("detector", "file", "line", *_BASE)),
    "dependency": " UNION ALL ".join([
        _report_sql(deps.NPM, detector="'dependency'", **_OWN("file", "cwe", "fix", "refs", *_BASE)), _report_sql(deps.PIP, detector="'dependency'", **_OWN("file", "line", "cwe", "fix", "refs", *_BASE)), _report_sql(deps.SUSPICIOUS, detector="'dependency'", **_OWN("file", *_BASE)),
        _report_sql(f"(SELECT * FROM {deps.MALFORMED} AS m WHERE rule = 'dep-audit-parse-error')", detector="'dependency'", **_OWN("file", *_BASE)),
    ]),
    "hook": " UNION ALL ".join([
        _report_sql(deps.HOOK_FINDINGS, detector="'hook'", **_OWN("file", "cwe", *_BASE)), _report_sql(deps.REFERENCED, detector="'hook'", **_OWN("file", "line", "cwe", *_BASE)), _report_sql(deps.PYTHON_HOOKS, detector="'hook'", **_OWN("file", "line", "cwe", *_BASE)),
        _report_sql(f"(SELECT * FROM {deps.MALFORMED} AS m WHERE rule <> 'dep-audit-parse-error')", detector="'hook'", **_OWN("file", *_BASE)),
    ]),
    "description": " UNION ALL ".join(_report_sql(x, **_OWN("detector", "confidence", "tool", "cwe", *_BASE)) for x in (d.DESCRIPTIONS, d.unseen_sql(_TEXTS), d.NESTED)),
    "exposure": _report_sql(d.EXPOSURES, **_OWN("detector", "tool", *_BASE)),
    "argument": _report_sql(d.ARGUMENTS, **_OWN("detector", "confidence", "tool", "cwe", *_BASE)),
    "response": _report_sql(d.RESPONSES, **_OWN("detector", "confidence", "tool", "cwe", *_BASE)),
    "connection": _report_sql(net.CONNECTIONS, detector="'connection'", fix=_FIXES, **_OWN("tool", *_BASE)),
}


def whole_report(spark, sf_dir, skip=()) -> DataFrame:
    """All detectors' findings over all planted corpora, each corpus read once."""
    found = report.report(
        lines=d.lines(spark, sf_dir), files=deps.files(spark, sf_dir), tools=corpora.tools(spark, sf_dir), arguments=detect.string_arguments(corpora.tool_calls(spark, sf_dir)),
        responses=corpora.responses(spark, sf_dir), events=net.events(spark, sf_dir), skip=skip,
    )
    return found.withColumn("refs", F.array_join("refs", ","))


@query(" UNION ALL ".join(REPORT_PARTS.values()))
def union_findings(spark, sf_dir):
    return whole_report(spark, sf_dir)


@query(f"SELECT * FROM {FINDINGS} AS f WHERE confidence >= 2")
def filter_confidence(spark, sf_dir):
    return ops.filter_confidence(findings(spark, sf_dir), "medium")


@query(f"SELECT * FROM {FINDINGS} AS f WHERE severity >= 2")
def filter_severity(spark, sf_dir):
    return ops.filter_severity(findings(spark, sf_dir), "high")


_SKIPPED = ("egress", *report.DEPENDENCY_AUDIT, "argument", "connection")


@query(" UNION ALL ".join(sql for name, sql in REPORT_PARTS.items() if name not in _SKIPPED))
def select_detectors(spark, sf_dir):
    return whole_report(spark, sf_dir, _SKIPPED)


@query(f"SELECT * REPLACE (coalesce(nullif(tool, ''), target) AS tool) FROM {FINDINGS} AS f")
def tag_with_server(spark, sf_dir):
    return ops.tag_with_server(findings(spark, sf_dir))


_SEV = ", ".join(f"count(*) FILTER (severity = {i}) AS {s.lower()}" for i, s in enumerate(labels.SEVERITIES))
_DOCS = f"(SELECT t.source AS target, r.severity FROM documents AS t JOIN {d.rules_sql(r.RESPONSES)} ON regexp_matches(t.text, r.pattern) UNION ALL SELECT t.source, r.severity FROM documents AS t JOIN {d.rules_sql(r.CREDENTIALS)} ON regexp_matches(t.text, r.pattern))"


@query(f"SELECT target AS source, {_SEV}, count(*) AS total FROM {_DOCS} AS f GROUP BY ROLLUP (target)")
def severity_summary(spark, sf_dir):
    docs = corpora.table(spark, sf_dir, "documents").select("source", "text")
    hits = ops.union_findings(*[match_rules(docs, "text", rules).select("source", "severity") for rules in (r.RESPONSES, r.CREDENTIALS)])
    return ops.severity_summary(hits, "source")


@query(f"SELECT target, CASE WHEN max(severity) >= 2 THEN 'NOT SAFE' WHEN max(severity) = 1 THEN 'REVIEW' ELSE 'OK' END AS verdict FROM {FINDINGS} AS f GROUP BY target")
def verdict(spark, sf_dir):
    return ops.verdict(findings(spark, sf_dir))


@query(f"SELECT target, bool_or(severity >= 3) AS failed FROM {FINDINGS} AS f GROUP BY target")
def fail_gate(spark, sf_dir):
    return ops.fail_gate(findings(spark, sf_dir), "critical")


_CATEGORY = "CASE " + " ".join(f"WHEN {' OR '.join(f'starts_with(rule, {d.text_sql(s)})' for s in starts)} THEN '{name}'" for name, starts in ops.CATEGORIES) + " ELSE 'other' END"


@query(f"SELECT {_CATEGORY} AS category, count(*) AS findings FROM {FINDINGS} AS f GROUP BY 1")
def category_breakdown(spark, sf_dir):
    return ops.category_breakdown(findings(spark, sf_dir))


CWES = f"(SELECT cwe, count(*) AS findings FROM {FINDINGS} AS f WHERE coalesce(cwe, '') <> '' GROUP BY cwe)"


@query(f"SELECT * FROM {CWES} AS c")
def cwe_counts(spark, sf_dir):
    return ops.cwe_counts(findings(spark, sf_dir))


@query(f"SELECT * FROM {CWES} AS c ORDER BY findings DESC, cwe LIMIT 10")
def top_cwes(spark, sf_dir):
    return ops.top_cwes(findings(spark, sf_dir))


@query(f"SELECT * FROM {FINDINGS} AS f ORDER BY severity DESC, rule, file, line")
def report_order(spark, sf_dir):
    return ops.report_order(findings(spark, sf_dir))


@query(f"SELECT target, path, line_no, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY target, path, line_no ORDER BY ord) AS n FROM {d.HITS} AS h) AS k WHERE n = 1")
def first_match(spark, sf_dir):
    hits = match_rules(d.lines(spark, sf_dir), "line", r.SOURCE, lang="lang")
    return ops.first_match(hits, ["target", "path", "line_no"], ORD).select("target", "path", "line_no", "rule_id")


_STATUS = f"""SELECT t.target, coalesce(n, 0) AS findings, CASE WHEN reason = 'timeout' THEN 'TIMEOUT' WHEN reason IS NOT NULL THEN 'FAIL' WHEN gate THEN 'FINDINGS' WHEN n > 0 THEN 'OK ' || CAST(n AS VARCHAR) || ' findings' ELSE 'OK clean' END AS status
FROM {TARGETS} AS t LEFT JOIN {FAILURES} AS x USING (target) LEFT JOIN (SELECT target, count(*) AS n, bool_or(severity >= 2) AS gate FROM {FINDINGS} AS f GROUP BY target) AS g USING (target)"""


@query(_STATUS)
def target_status(spark, sf_dir):
    return ops.target_status(targets(spark, sf_dir), findings(spark, sf_dir), failures(spark, sf_dir))


_COUNTED = f"(SELECT * FROM {FINDINGS} AS f WHERE target IN (SELECT target FROM {TARGETS} AS t) AND target NOT IN (SELECT target FROM {FAILURES} AS y))"


@query(f"""SELECT count(*) AS targets, count(*) FILTER (reason IS NULL) AS scanned, count(reason) AS failed, count(*) FILTER (reason = 'timeout') AS timeouts, CAST(coalesce(sum(n), 0) AS BIGINT) AS findings,
 CAST(coalesce(sum(info), 0) AS BIGINT) AS info, CAST(coalesce(sum(warning), 0) AS BIGINT) AS warning, CAST(coalesce(sum(high), 0) AS BIGINT) AS high, CAST(coalesce(sum(critical), 0) AS BIGINT) AS critical, count(*) FILTER (n > 0) AS with_findings, count(*) FILTER (reason IS NULL AND n IS NULL) AS clean,
 (SELECT string_agg(cwe || '=' || CAST(n AS VARCHAR), ',' ORDER BY cwe) FROM (SELECT cwe, count(*) AS n FROM {_COUNTED} AS f WHERE coalesce(cwe, '') <> '' GROUP BY cwe) AS c) AS by_cwe
FROM {TARGETS} AS t LEFT JOIN {FAILURES} AS x USING (target) LEFT JOIN (SELECT target, count(*) AS n, {_SEV} FROM {_COUNTED} AS f GROUP BY target) AS g USING (target)""")
def sweep_summary(spark, sf_dir):
    row = ops.sweep_summary(targets(spark, sf_dir), findings(spark, sf_dir), failures(spark, sf_dir))
    entries = F.transform(F.array_sort(F.map_entries("by_cwe")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return row.withColumn("by_cwe", F.array_join(entries, ","))


_VERDICTS = f"(SELECT target, rule, file, CASE length(file) % 4 WHEN 0 THEN 'FP' WHEN 1 THEN 'NOISE' WHEN 2 THEN 'TP' END AS verdict FROM {d.SOURCE} AS s WHERE length(file) % 4 < 3 GROUP BY ALL)"
LABELLED = f"(SELECT f.target, f.rule, f.file, f.line, coalesce(v.verdict, 'UNREVIEWED') AS verdict FROM {d.SOURCE} AS f LEFT JOIN {_VERDICTS} AS v USING (target, rule, file))"


def labelled(spark, sf_dir):
    found = d.source_findings(spark, sf_dir)
    n = F.length("file") % 4
    verdicts = found.select("target", "rule", "file", F.when(n == 0, "FP").when(n == 1, "NOISE").when(n == 2, "TP").alias("verdict")).where("verdict IS NOT NULL").distinct()
    return ops.label_findings(found, verdicts)


@query(f"SELECT * FROM {LABELLED} AS l")
def label_findings(spark, sf_dir):
    return labelled(spark, sf_dir).select("target", "rule", "file", "line", "verdict")


@query(f"SELECT rule, count(*) FILTER (verdict = 'TP') AS tp, count(*) FILTER (verdict = 'FP') AS fp, count(*) FILTER (verdict = 'NOISE') AS noise, count(*) AS total, count(*) FILTER (verdict = 'FP') / count(*) AS fp_share, count(*) FILTER (verdict = 'NOISE') / count(*) AS noise_share FROM {LABELLED} AS l GROUP BY ROLLUP (rule)")
def precision_report(spark, sf_dir):
    return ops.precision_report(labelled(spark, sf_dir))


_RULES = ["mcp-cmd-injection", "mcp-code-eval", "mcp-hardcoded-secret", "mcp-xss-risk", "mcp-sandbox-escape", "mcp-not-there"]
EXPECTED = f"(SELECT 'case' || CAST(p_partkey AS VARCHAR) AS case_id, 'src' || CAST(p_partkey % 24 AS VARCHAR) AS target, unnest([{d.corpora.pick_sql(_RULES, 'p_partkey')}, {d.corpora.pick_sql(_RULES, 'p_partkey // 6')}]) AS rule FROM part)"
CASES = f"(SELECT case_id, bool_and(f.rule IS NOT NULL) AS detected FROM {EXPECTED} AS e LEFT JOIN (SELECT DISTINCT target, rule FROM {d.SOURCE} AS s) AS f ON e.target = f.target AND e.rule = f.rule GROUP BY case_id)"


def cases(spark, sf_dir):
    k = F.col("p_partkey")
    expected = corpora.table(spark, sf_dir, "part").select(F.concat(F.lit("case"), k.cast("string")).alias("case_id"), F.concat(F.lit("src"), (k % 24).cast("string")).alias("target"), F.explode(F.array(corpora.pick(_RULES, k), corpora.pick(_RULES, F.floor(k / 6)))).alias("rule"))
    return ops.expected_detection(expected, d.source_findings(spark, sf_dir))


@query(f"SELECT * FROM {CASES} AS c")
def expected_detection(spark, sf_dir):
    return cases(spark, sf_dir)


@query(f"SELECT count(*) FILTER (detected) AS detected, count(*) AS total, count(*) FILTER (detected) * 100.0 / count(*) AS rate FROM {CASES} AS c")
def detection_rate(spark, sf_dir):
    return ops.detection_rate(cases(spark, sf_dir)).withColumn("rate", F.col("rate").cast("double"))


@query(f"SELECT 'g' || CAST(length(target) AS VARCHAR) || right(target, 1) AS \"group\", count(f.rule) AS findings, count(DISTINCT f.rule) AS rules FROM {TARGETS} AS t LEFT JOIN (SELECT target, rule FROM {d.SOURCE} AS s) AS f USING (target) GROUP BY 1")
def coverage_by_group(spark, sf_dir):
    groups = targets(spark, sf_dir).withColumn("group", F.concat(F.lit("g"), F.length("target").cast("string"), F.right("target", F.lit(1))))
    return ops.coverage_by_group(groups, d.source_findings(spark, sf_dir))


@query(f"SELECT target, rule, severity, ['INFO', 'WARNING', 'HIGH', 'CRITICAL'][severity + 1] AS severity_label, confidence, ['unknown', 'low', 'medium', 'high'][confidence + 1] AS confidence_label FROM {FINDINGS} AS f")
def severity_labels(spark, sf_dir):
    return findings(spark, sf_dir).select("target", "rule", "severity", labels.severity_label(F.col("severity")).alias("severity_label"), "confidence", labels.confidence_label(F.col("confidence")).alias("confidence_label"))


@query(f"SELECT target, rule, severity, ['note', 'warning', 'error', 'error'][severity + 1] AS level FROM {FINDINGS} AS f")
def sarif_level(spark, sf_dir):
    return findings(spark, sf_dir).select("target", "rule", "severity", labels.sarif_level(F.col("severity")).alias("level"))
