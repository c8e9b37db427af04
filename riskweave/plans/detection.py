"""Queries of the source, description, argument and response detectors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskweave import corpora
from riskweave.corpora import text_sql
from riskweave.functions import labels, paths
from riskweave.functions.text import render, trim_space, truncate
from riskweave.operators import detect
from riskweave.operators.matching import ORD, match_rules, with_rule_columns
from riskweave.rules import catalog as c
from riskweave.rules import ruleset as r

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rules_sql(rules) -> str:
    """(ord, id, rule, severity, confidence, cwe, pattern, template, langs, excludes, secret) as a VALUES list."""
    lists = lambda xs: "CAST([" + ", ".join(map(text_sql, xs)) + "] AS VARCHAR[])"
    rows = [f"({i}, {text_sql(x.id)}, {text_sql(x.rule)}, {x.severity}, {x.confidence}, {text_sql(x.cwe)}, {text_sql(x.pattern)}, {text_sql(x.template)}, {lists(x.langs)}, {lists(x.excludes)}, {str(x.secret).upper()})" for i, x in enumerate(rules)]
    return "(VALUES " + ", ".join(rows) + ") AS r(ord, rule_id, rule, severity, confidence, cwe, pattern, template, langs, excludes, secret)"


def patterns_sql(patterns, text: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {text_sql(p)})" for p in patterns) + ")"


FILES, LINES_SQL = corpora.SOURCE_FILES_SQL, ""
_BASE = "regexp_extract(path, '[^/]*$')"
_EXT = "lower(regexp_extract(path, '[.][^./]*$'))"
LANG = f"""CASE WHEN {_EXT} = '.json' AND lower({_BASE}) IN ({', '.join(map(text_sql, c.CONFIG_FILES))}) THEN 'json' WHEN {_EXT} = '.py' THEN 'python' WHEN {_EXT} IN ('.js', '.mjs', '.cjs') THEN 'javascript'
 WHEN {_EXT} IN ('.ts', '.mts') THEN 'typescript' WHEN {_EXT} = '.go' THEN 'go' ELSE 'unknown' END"""
_DIRS = "|".join(d.replace(".", "[.]") for d in c.DEPENDENCY_DIRS + c.TEST_DIRS)
IN_DIR = f"regexp_matches(path, '(?:^|/)(?:{_DIRS})/')"
GENERATED = f"regexp_matches(lower({_BASE}), {text_sql(paths.GENERATED_NAME)})"
TEST = f"(regexp_matches({_BASE}, {text_sql(paths.TEST_NAME)}) OR contains(lower({_BASE}), 'mock'))"
BUNDLED = "(lang IN ('javascript', 'typescript') AND len(list_filter(list_slice(string_split(content, chr(10)), 1, 20), lambda x: strlen(x) > 1000)) > 0)"
F_LANG = f"(SELECT *, {LANG} AS lang FROM ({FILES}) AS f)"
SCANNED = f"(SELECT * FROM {F_LANG} AS f WHERE lang <> 'unknown' AND NOT {IN_DIR} AND NOT {GENERATED} AND NOT {TEST} AND NOT {BUNDLED})"
LINES_OF = lambda files: f"(SELECT target, path, lang, CAST(unnest(range(1, len(string_split(content, chr(10))) + 1)) AS INTEGER) AS line_no, unnest(string_split(content, chr(10))) AS line FROM {files} AS f)"
LINES = LINES_OF(SCANNED)
TRIMMED = "trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
COMMENT = f"(regexp_matches({TRIMMED}, '^(?://|/[*]|[*]|--)') OR (lang = 'python' AND starts_with({TRIMMED}, '#')))"
HITS = f"(SELECT l.*, r.* FROM {LINES} AS l JOIN {rules_sql(r.SOURCE)} ON list_contains(r.langs, l.lang) AND regexp_matches(l.line, r.pattern))"
CODE_HITS = f"(SELECT * FROM {HITS} AS h WHERE NOT {COMMENT})"
EXCLUDED = "(len(list_filter(excludes, lambda x: regexp_matches(line, x))) > 0)"
KEY = f"regexp_extract(line, {text_sql(c.KEY_VALUE_PATTERN)}, 1)"
VALUE = f"regexp_extract(line, {text_sql(c.KEY_VALUE_PATTERN)}, 2)"
_PLACE = lambda x: f"({patterns_sql(c.PLACEHOLDER_PATTERNS, x)} OR regexp_matches({x}, {text_sql(c.TYPE_NAME_PATTERN)}))"
PLACEHOLDER = f"(secret AND ({_PLACE('regexp_extract(line, pattern, 0)')} OR ({VALUE} <> '' AND {_PLACE(VALUE)})))"
SELF = f"(secret AND {KEY} <> '' AND lower({KEY}) = lower({VALUE}))"
SEVERITY = f"CASE WHEN rule = '{c.TEMP_DIR_RULE}' AND {patterns_sql(c.TEMP_DIR_PATTERNS, 'line')} THEN 0 ELSE severity END"
CUT = lambda x, n: f"CASE WHEN length({x}) > {n} THEN left({x}, {n}) || '...' ELSE {x} END"
SOURCE = f"""(SELECT target, 'source' AS detector, rule, {SEVERITY} AS severity, confidence, replace(template, '%s', {CUT(TRIMMED, 100)}) AS message, path AS file, line_no AS line, CAST(NULL AS VARCHAR) AS tool, cwe
 FROM (SELECT * FROM {CODE_HITS} AS h WHERE NOT {EXCLUDED} AND NOT {PLACEHOLDER} AND NOT {SELF}) AS k)"""
EGRESS = f"(SELECT target, path, line_no, replace(template, '%s', regexp_extract(line, CASE WHEN contains(template, '%s') THEN pattern ELSE '()' END, 1)) AS method FROM (SELECT l.*, r.* FROM {LINES} AS l JOIN {rules_sql(r.EGRESS)} ON list_contains(r.langs, l.lang) AND regexp_matches(l.line, r.pattern)) AS h)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.source_files(spark, sf_dir)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.explode_lines(detect.scanned_files(files(spark, sf_dir)))


def source_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.scan_source(lines(spark, sf_dir)).select(*detect.FINDING)


@query("SELECT source, doc_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents")
def explode_lines(spark, sf_dir):
    return detect.explode_lines(corpora.table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "text")


@query(f"SELECT target, path, lang FROM {F_LANG} AS f")
def detect_language(spark, sf_dir):
    return detect.with_language(files(spark, sf_dir)).select("target", "path", "lang")


@query(f"SELECT target, path FROM {F_LANG} AS f WHERE NOT {IN_DIR}")
def exclude_dirs(spark, sf_dir):
    return files(spark, sf_dir).where(~paths.in_excluded_dir(F.col("path"))).select("target", "path")


@query(f"SELECT target, path FROM {F_LANG} AS f WHERE NOT {GENERATED}")
def exclude_generated_files(spark, sf_dir):
    return files(spark, sf_dir).where(~paths.is_generated(F.col("path"))).select("target", "path")


@query(f"SELECT target, path FROM {F_LANG} AS f WHERE NOT {TEST}")
def exclude_test_files(spark, sf_dir):
    return files(spark, sf_dir).where(~paths.is_test_file(F.col("path"))).select("target", "path")


_DOC_FILES = "(SELECT source AS target, doc_id, text AS content, CASE WHEN doc_id % 3 = 0 THEN 'javascript' ELSE 'python' END AS lang FROM documents)"


@query(f"SELECT target, doc_id, lang FROM {_DOC_FILES} AS f WHERE NOT {BUNDLED}")
def drop_bundled_content(spark, sf_dir):
    docs = corpora.table(spark, sf_dir, "documents").select(F.col("source").alias("target"), "doc_id", F.col("text").alias("content"), F.when(F.col("doc_id") % 3 == 0, "javascript").otherwise("python").alias("lang"))
    return detect.drop_bundled(docs).select("target", "doc_id", "lang")


@query(f"SELECT target, path, lang, line_no, line FROM {LINES} AS l WHERE NOT {COMMENT}")
def drop_comment_lines(spark, sf_dir):
    return lines(spark, sf_dir).where(~detect.is_comment(F.col("line"), F.col("lang"))).select("target", "path", "lang", "line_no", "line")


_KEYS = ["target", "path", "line_no", "rule_id"]


def _hits(spark, sf_dir):
    return detect.source_hits(lines(spark, sf_dir))


@query(f"SELECT target, path, line_no, rule_id FROM {HITS} AS h WHERE NOT {EXCLUDED}")
def drop_excluded_matches(spark, sf_dir):
    return _hits(spark, sf_dir).where(~detect.excluded(F.col("line"), r.SOURCE)).select(*_KEYS)


@query(f"SELECT target, path, line_no, rule_id FROM {HITS} AS h WHERE NOT {PLACEHOLDER}")
def drop_placeholder_secrets(spark, sf_dir):
    return _hits(spark, sf_dir).where(~detect.placeholder_secret(F.col("line"), r.SOURCE)).select(*_KEYS)


@query(f"SELECT target, path, line_no, rule_id FROM {HITS} AS h WHERE NOT {SELF}")
def drop_self_assigned_secrets(spark, sf_dir):
    return _hits(spark, sf_dir).where(~detect.self_assigned_secret(F.col("line"), r.SOURCE)).select(*_KEYS)


@query(f"SELECT target, path, line_no, rule_id, {SEVERITY} AS severity FROM {HITS} AS h")
def downgrade_temp_dir(spark, sf_dir):
    return _hits(spark, sf_dir).withColumn("severity", detect.temp_severity(F.col("line"))).select(*_KEYS, "severity")


@query(f"SELECT * FROM {SOURCE} AS s")
def scan_source(spark, sf_dir):
    return source_findings(spark, sf_dir)


@query(f"SELECT target, tool_name, rule_id, count(*) AS hits FROM (SELECT t.*, r.rule_id FROM ({corpora.RESPONSES_SQL}) AS t JOIN {rules_sql(r.CREDENTIALS)} ON regexp_matches(t.text, r.pattern)) AS h GROUP BY ALL")
def scan_secrets(spark, sf_dir):
    return detect.scan_secrets(corpora.responses(spark, sf_dir)).groupBy("target", "tool_name", "rule_id").agg(F.count(F.lit(1)).alias("hits"))


@query(f"SELECT * FROM {EGRESS} AS e")
def detect_egress(spark, sf_dir):
    return detect.detect_egress(lines(spark, sf_dir))


@query(f"SELECT target, 'egress' AS detector, 'mcp-network-egress' AS rule, 1 AS severity, 0 AS confidence, 'Tool makes outbound network call via ' || method AS message, path AS file, line_no AS line FROM {EGRESS} AS e")
def egress_findings(spark, sf_dir):
    return detect.egress_findings(detect.detect_egress(lines(spark, sf_dir))).drop("tool", "cwe", "quoted")


TOOLS = corpora.TOOLS_SQL
_DESC = f"(SELECT t.*, r.* FROM ({TOOLS}) AS t JOIN {rules_sql(r.DESCRIPTIONS)} ON regexp_matches(t.description, r.pattern))"
DESCRIPTIONS = f"(SELECT target, 'description' AS detector, rule, severity, confidence, replace(template, '%s', {CUT('regexp_extract(description, pattern, 0)', 100)}) AS message, tool_name AS tool, cwe FROM {_DESC} AS h)"


@query(f"SELECT * FROM {DESCRIPTIONS} AS d")
def scan_descriptions(spark, sf_dir):
    return detect.scan_descriptions(corpora.tools(spark, sf_dir)).drop("file", "line", "quoted")


_COUNT = lambda col, ranges: f"len(regexp_extract_all({col}, {text_sql(r.code_points(ranges))}))"


def unseen_sql(texts: str) -> str:
    """Findings of the invisible-character rules in rows (target, tool_name, description, prefix)."""
    return f"""(SELECT target, 'description' AS detector, rule, 3 AS severity, CASE rule WHEN 'mcp-unicode-injection' THEN 2 ELSE 3 END AS confidence, prefix || CASE rule WHEN 'mcp-unicode-injection' THEN 'Found ' || CAST(n AS VARCHAR) || ' invisible Unicode characters in tool description (possible steganographic payload)'
  ELSE {text_sql(r.INVISIBLE[1].message)} END AS message, tool_name AS tool, 'CWE-116' AS cwe FROM (SELECT *, {_COUNT('description', c.INVISIBLE_RANGES)} AS n, {_COUNT('description', [c.TAG_BLOCK])} AS tags FROM {texts} AS t) AS t JOIN (VALUES ('mcp-unicode-injection'), ('mcp-unicode-tags-block')) AS r(rule) ON n > 0 AND (rule = 'mcp-unicode-injection' OR tags > 0))"""


@query(f"""SELECT target, snapshot, tool_name, invisible, rule FROM (SELECT *, CAST({_COUNT('description', c.INVISIBLE_RANGES)} AS INTEGER) AS invisible, {_COUNT('description', [c.TAG_BLOCK])} AS tags FROM ({TOOLS}) AS t) AS t
 JOIN (VALUES ('mcp-unicode-injection'), ('mcp-unicode-tags-block')) AS r(rule) ON invisible > 0 AND (rule = 'mcp-unicode-injection' OR tags > 0)""")
def scan_invisible_chars(spark, sf_dir):
    return detect.scan_invisible(corpora.tools(spark, sf_dir)).select("target", "snapshot", "tool_name", "invisible", "rule")


def walked(schema, depth: int = 0) -> list[str]:
    """What a plain walk of a schema finds: descriptions of objects, in members and in items of arrays, 20 objects below the root."""
    if not isinstance(schema, dict) or depth > 20:
        return []
    items = [x for v in schema.values() for x in ([v] if isinstance(v, dict) else v if isinstance(v, list) else [])]
    own = [schema["description"]] if isinstance(schema.get("description"), str) else []
    return own + [d for x in items for d in walked(x, depth + 1)]


def parsed(text: str | None):
    try:
        return json.loads(text or "")
    except ValueError:
        return None


_SAID = "(VALUES " + ", ".join(f"({text_sql(s)}, {text_sql(d)})" for s in dict.fromkeys(corpora.SCHEMAS) if s for d in walked(parsed(s))) + ") AS w(schema, said)"
NESTED_TEXTS = f"(SELECT target, snapshot, tool_name, said AS description, '[nested schema] ' AS prefix FROM ({TOOLS}) AS t JOIN {_SAID} ON input_schema = schema)"
_IN_TEXTS = lambda texts: f"(SELECT target, 'description' AS detector, rule, severity, confidence, prefix || replace(template, '%s', {CUT('regexp_extract(description, pattern, 0)', 100)}) AS message, tool_name AS tool, cwe FROM {texts} AS t JOIN {rules_sql(r.DESCRIPTIONS)} ON regexp_matches(t.description, r.pattern))"
NESTED = f"(SELECT * FROM {_IN_TEXTS(NESTED_TEXTS)} AS a UNION ALL SELECT * FROM {unseen_sql(NESTED_TEXTS)} AS b)"


@query(f"SELECT * FROM {NESTED} AS n")
def scan_nested_descriptions(spark, sf_dir):
    return detect.scan_nested(corpora.tools(spark, sf_dir).drop("description")).drop("snapshot", "file", "line")


ARGUMENTS = f"(SELECT target, 'argument' AS detector, rule, severity, confidence, replace(template, '%s', {CUT('value', 80)}) AS message, arg AS tool, cwe FROM (SELECT t.*, r.* FROM ({corpora.TOOL_CALLS_SQL}) AS t JOIN {rules_sql(r.ARGUMENTS)} ON regexp_matches(t.value, r.pattern)) AS h)"


@query(f"SELECT * FROM {ARGUMENTS} AS a")
def scan_arguments(spark, sf_dir):
    return detect.scan_arguments(detect.string_arguments(corpora.tool_calls(spark, sf_dir))).drop("file", "line", "quoted")


RESPONSES = f"(SELECT target, 'response' AS detector, rule, severity, confidence, template AS message, tool_name AS tool, cwe FROM (SELECT t.*, r.* FROM ({corpora.RESPONSES_SQL}) AS t JOIN {rules_sql(r.RESPONSES)} ON regexp_matches(t.text, r.pattern)) AS h)"


def response_findings(spark, sf_dir):
    return detect.scan_responses(corpora.responses(spark, sf_dir)).drop("file", "line", "quoted")


@query(f"SELECT * FROM {RESPONSES} AS a")
def scan_responses(spark, sf_dir):
    return response_findings(spark, sf_dir)


_TIER = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(description), {text_sql(w)})' for w in words)} THEN {n}" for n, words in c.TIER_KEYWORDS) + " ELSE 0 END"
TIERS = f"(SELECT target, snapshot, tool_name, {_TIER} AS tier FROM ({TOOLS}) AS t)"


def tiers(spark, sf_dir):
    return corpora.tools(spark, sf_dir).select("target", "snapshot", "tool_name", detect.risk_tier(F.col("description")).alias("tier"))


@query(f"SELECT target, snapshot, tool_name, tier, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][tier + 1] AS label FROM {TIERS} AS t")
def classify_tools(spark, sf_dir):
    return tiers(spark, sf_dir).withColumn("label", labels.tier_label(F.col("tier")))


EXPOSURES = f"(SELECT target, 'exposure' AS detector, 'mcp-sensitive-exposure' AS rule, tier - 1 AS severity, 0 AS confidence, 'Tool \"' || tool_name || '\" exposes ' || ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][tier + 1] || '-risk capabilities' AS message, tool_name AS tool FROM {TIERS} AS t WHERE tier >= 2)"


@query(f"SELECT * FROM {EXPOSURES} AS e")
def exposure_findings(spark, sf_dir):
    return detect.exposure_findings(tiers(spark, sf_dir))


@query(f"SELECT target, path, line_no, line AS full_line, {CUT(TRIMMED, 100)} AS at_100, {CUT(TRIMMED, 80)} AS at_80 FROM {LINES} AS l")
def truncate_message(spark, sf_dir):
    t = trim_space(F.col("line"))
    return lines(spark, sf_dir).select("target", "path", "line_no", F.col("line").alias("full_line"), truncate(t, 100).alias("at_100"), truncate(t, 80).alias("at_80"))


@query(f"SELECT target, path, line_no, rule_id, replace(template, '%s', {TRIMMED}) AS message FROM {HITS} AS h")
def render_message(spark, sf_dir):
    return _hits(spark, sf_dir).select(*_KEYS, render(F.col("template"), trim_space(F.col("line"))).alias("message"))


@query(f"SELECT target, path, line_no, {KEY} AS key, {VALUE} AS value FROM {LINES} AS l WHERE {KEY} <> ''")
def key_value_extract(spark, sf_dir):
    key, value = detect.key_value(F.col("line"))
    return lines(spark, sf_dir).select("target", "path", "line_no", key.alias("key"), value.alias("value")).where("key <> ''")
