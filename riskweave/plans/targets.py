"""Queries of targets, configurations, listings, suppression, results and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave import corpora
from riskweave.corpora import pick, pick_sql, text_sql
from riskweave.functions import paths
from riskweave.operators import findings as rollups
from riskweave.operators import pins, ruletable
from riskweave.operators import suppress as ops
from riskweave.operators import targets as names
from riskweave.plans import detection as d
from riskweave.plans import network as net
from riskweave.sources import sinks, tree
from riskweave.streaming import streams

QUERIES, ORACLES = {}, {}
_K = "c_custkey"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Files with the names that source trees have, one for each customer.
TREE_NAMES = ["__init__.py", ".env", "_private/x.py", "src/__mocks__/a.js", ".cfg/.hidden/b", "a b/%20 c.py", "plain.go"]
TREE_TEXTS = ["x = 1\r\ny = 2\r\n", "", "\n\n", "é – 字", "\t# no end", "a\nb"]


def tree_files(spark, sf_dir):
    k = F.col(_K)
    name = F.concat(F.lit("d"), k.cast("string"), F.lit("/"), pick(TREE_NAMES, k))
    return corpora.table(spark, sf_dir, "customer").select(F.concat(pick(["t", "_t", ".t"], k), (k % 20).cast("string")).alias("target"), name.alias("path"), pick(TREE_TEXTS, F.floor(k / 7)).alias("content"))


@query(f"SELECT {pick_sql(['t', '_t', '.t'], 'c_custkey')} || CAST(c_custkey % 20 AS VARCHAR) AS target, 'd' || CAST(c_custkey AS VARCHAR) || '/' || {pick_sql(TREE_NAMES, 'c_custkey')} AS path, {pick_sql(TREE_TEXTS, 'c_custkey // 7')} AS content FROM customer")
def read_source_tree(spark, sf_dir):
    root = sinks.scratch(spark, "tree")
    tree.write_source_tree(tree_files(spark, sf_dir), root)
    return tree.read_source_tree(spark, root)


# Client configurations, one for each customer.
COMMANDS = ["npx", "node", "uvx", "python"]
ARGS = [["-y", "pkg-a"], ["--flag"], ["server.py", "-x"], []]


def configs(spark, sf_dir):
    k = F.col(_K)
    entry = F.concat(F.lit('{"command":"'), pick(COMMANDS, k), F.lit('","args":'), pick(['["-y","pkg-a"]', '["--flag"]', '["server.py","-x"]', "[]"], F.floor(k / 4)), F.lit(',"env":{"A":"1"}}'))
    body = F.when(k % 7 == 0, '{"mcpServers":{}}').when(k % 11 == 0, "{}").otherwise(F.concat(F.lit('{"mcpServers":{"s'), k.cast("string"), F.lit('":'), entry, F.lit(',"other":{"command":"x"}},"theme":1}')))
    return corpora.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), k.cast("string"), F.lit("/mcp.json")).alias("path"), body.alias("content"))


_NAMED = f"(SELECT * FROM customer WHERE {_K} % 7 <> 0 AND {_K} % 11 <> 0)"
_TARGETS4 = ["pkg-a", None, "server.py", None]
_ARGS_TEXT = ["-y pkg-a", "--flag", "server.py -x", ""]
SERVERS = f"""(SELECT 's' || CAST({_K} AS VARCHAR) AS name, {pick_sql(COMMANDS, _K)} AS command, {pick_sql(_ARGS_TEXT, f'{_K} // 4')} AS args, 'A=1' AS env, 'c' || CAST({_K} AS VARCHAR) || '/mcp.json' AS source, coalesce({pick_sql(_TARGETS4, f'{_K} // 4')}, {pick_sql(COMMANDS, _K)}) AS target FROM {_NAMED} AS n
 UNION ALL SELECT 'other', 'x', NULL, NULL, 'c' || CAST({_K} AS VARCHAR) || '/mcp.json', 'x' FROM {_NAMED} AS n)"""


@query(f"SELECT name, command, args, env, source FROM {SERVERS} AS s")
def read_client_configs(spark, sf_dir):
    env = F.array_join(F.transform(F.map_entries("env"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return names.servers(configs(spark, sf_dir)).select("name", "command", F.array_join("args", " ").alias("args"), env.alias("env"), "source")


@query(f"SELECT source, count(*) AS servers FROM {SERVERS} AS s GROUP BY source")
def config_coverage(spark, sf_dir):
    return names.coverage(names.servers(configs(spark, sf_dir)))


@query(f"SELECT name, source, target FROM {SERVERS} AS s")
def server_target(spark, sf_dir):
    return names.servers(configs(spark, sf_dir)).select("name", "source", names.server_target(F.col("command"), F.col("args")).alias("target"))


# Captured protocol answers, one for each order.
LISTING = "result struct<tools:array<struct<name:string,description:string,inputSchema:variant>>>, error struct<message:string>"
CONTENT = "result struct<content:array<struct<type:string,text:string>>>"


def answers(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    listing = F.when(F.col("o_orderkey") % 9 == 0, '{"error":{"message":"no"}}').otherwise(F.concat(F.lit('{"result":{"tools":[{"name":"a'), k, F.lit('","description":"reads"},{"name":"b'), k, F.lit('","inputSchema":{"type":"object","properties":{"a":1}}}]}}')))
    content = F.concat(F.lit('{"result":{"content":[{"type":"text","text":"t'), k, F.lit('"},{"type":"image","data":"x"},{"type":"text","text":"'), F.col("o_orderstatus"), F.lit('"}]}}'))
    return corpora.table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), k).alias("target"), listing.alias("listing"), content.alias("content"))


@query("""SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS target, n.p || CAST(o_orderkey AS VARCHAR) AS tool_name, n.d AS description, n.s AS input_schema FROM orders CROSS JOIN (VALUES ('a', 'reads', NULL), ('b', NULL, '{"properties":{"a":1},"type":"object"}')) AS n(p, d, s) WHERE o_orderkey % 9 <> 0""")
def read_tool_listings(spark, sf_dir):
    parsed = answers(spark, sf_dir).select("target", F.from_json("listing", LISTING).alias("r")).where("r.error IS NULL")
    return parsed.select("target", F.explode("r.result.tools").alias("t")).select("target", F.col("t.name").alias("tool_name"), "t.description", F.to_json("t.inputSchema").alias("input_schema"))


@query("SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS target, 't' || CAST(o_orderkey AS VARCHAR) AS text FROM orders UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR), o_orderstatus FROM orders")
def read_result_text(spark, sf_dir):
    parsed = answers(spark, sf_dir).select("target", F.from_json("content", CONTENT).alias("r"))
    return parsed.select("target", F.explode("r.result.content").alias("b")).where("b.type = 'text'").select("target", "b.text")


# Suppression.
IGNORES = ["# note", "", "!mcp-code-eval", "src/**", "*.ts", "server*.py:mcp-cmd-injection", "lib/a/*/f[0-9]*", "!", "docs/**:mcp-env-read", "f1?.go", "index.js", "[-a]x"]
_G = "s_suppkey"
IGNORE_LINES = f"(SELECT 'src' || CAST({_G} % 20 AS VARCHAR) AS target, {pick_sql(IGNORES, f'{_G} // 3 + {_G}')} AS line FROM supplier)"
_LAST = r"^(.+):([^:/\\]+)$"
RULES = f"""(SELECT target, CASE WHEN starts_with(line, '!') THEN 'rule' WHEN regexp_matches(line, {text_sql(_LAST)}) THEN 'file_rule' ELSE 'glob' END AS kind,
 CASE WHEN starts_with(line, '!') THEN NULL WHEN regexp_matches(line, {text_sql(_LAST)}) THEN regexp_extract(line, {text_sql(_LAST)}, 1) ELSE line END AS glob, CASE WHEN starts_with(line, '!') THEN substr(line, 2) WHEN regexp_matches(line, {text_sql(_LAST)}) THEN regexp_extract(line, {text_sql(_LAST)}, 2) END AS rule
 FROM {IGNORE_LINES} AS l WHERE line NOT IN ('', '!') AND NOT starts_with(line, '#'))"""


def ignore_lines(spark, sf_dir):
    k = F.col(_G)
    return corpora.table(spark, sf_dir, "supplier").select(F.concat(F.lit("src"), (k % 20).cast("string")).alias("target"), pick(IGNORES, F.floor(k / 3) + k).alias("line"))


@query(f"SELECT * FROM {RULES} AS r")
def parse_ignore_lines(spark, sf_dir):
    return ops.parse_ignore_lines(ignore_lines(spark, sf_dir))


@query(f"SELECT target, kind, count(*) AS rules FROM {RULES} AS r GROUP BY ALL")
def read_ignore_rules(spark, sf_dir):
    return ops.parse_ignore_lines(ignore_lines(spark, sf_dir)).groupBy("target", "kind").agg(F.count(F.lit(1)).alias("rules"))


# The globs of the samples as regular expressions over whole paths, written by hand.
GLOB_REGEX = {"src/**": "(^|/)src(/|$)", "*.ts": "^(.*/)?[^/]*[.]ts$", "server*.py": "^(.*/)?server[^/]*[.]py$", "lib/a/*/f[0-9]*": "^(.*/)?lib/a/[^/]*/f[0-9][^/]*$", "docs/**": "(^|/)docs(/|$)", "f1?.go": "^(.*/)?f1[^/][.]go$", "index.js": "^(.*/)?index[.]js$", "[-a]x": "^a^"}
_GLOBBED = "(VALUES " + ", ".join(f"({text_sql(g)}, {text_sql(x)})" for g, x in GLOB_REGEX.items()) + ") AS g(pattern, regex)"


@query(f"SELECT target, path, pattern AS \"glob\" FROM ({d.FILES}) AS f CROSS JOIN {_GLOBBED} WHERE regexp_matches(path, regex)")
def glob_match(spark, sf_dir):
    rows = d.files(spark, sf_dir).select("target", "path", F.explode(F.array(*map(F.lit, GLOB_REGEX))).alias("glob"))
    return rows.where(paths.glob_match(F.col("path"), paths.glob_to_regex(F.col("glob"))))


_BY_RULE = f"EXISTS (SELECT 1 FROM {RULES} AS r LEFT JOIN {_GLOBBED} ON r.\"glob\" = g.pattern WHERE r.target = f.target AND ((r.kind = 'rule' AND r.rule = f.rule) OR (r.kind <> 'rule' AND regexp_matches(f.file, g.regex) AND (r.rule IS NULL OR r.rule = f.rule))))"
FLAGGED = f"(SELECT target, rule, file, line, {_BY_RULE} AS suppressed FROM {d.SOURCE} AS f)"


def flagged(spark, sf_dir):
    found = sinks.stored(d.source_findings(spark, sf_dir).select("target", "rule", "file", "line"), "found")
    return ops.suppressed_by_rule(found, ops.parse_ignore_lines(ignore_lines(spark, sf_dir)))


@query(f"SELECT * FROM {FLAGGED} AS f")
def suppress_by_rule(spark, sf_dir):
    return flagged(spark, sf_dir)


@query(f"SELECT target, count(*) FILTER (NOT suppressed) AS kept, count(*) FILTER (suppressed) AS suppressed FROM {FLAGGED} AS f GROUP BY target")
def split_suppressed(spark, sf_dir):
    kept, suppressed = rollups.split_suppressed(sinks.stored(flagged(spark, sf_dir), "flagged"))
    both = kept.withColumn("k", F.lit(1)).unionByName(suppressed.withColumn("k", F.lit(0)))
    return both.groupBy("target").agg(F.sum("k").alias("kept"), F.sum(1 - F.col("k")).alias("suppressed"))


MARKS = ["", f" # {ops.MARKER}", f" # {ops.MARKER} mcp-cmd-injection", f" # {ops.MARKER}   mcp-code-eval because"]
_MARKED = f"(SELECT *, line || {pick_sql(MARKS, 'length(path) + line_no')} AS marked FROM {d.HITS} AS h)"
_REST = f"trim(split_part(marked, '{ops.MARKER}', 2))"
_INLINE = f"(contains(marked, '{ops.MARKER}') AND ({_REST} = '' OR split_part({_REST}, ' ', 1) = rule))"


def marked(spark, sf_dir):
    lines = d.lines(spark, sf_dir)
    hits = d.match_rules(lines, "line", d.r.SOURCE, lang="lang")
    return hits.withColumn("marked", F.concat("line", pick(MARKS, F.length("path") + F.col("line_no"))))


@query(f"SELECT target, path, line_no, rule_id, {_INLINE} AS suppressed FROM {_MARKED} AS m")
def suppress_inline(spark, sf_dir):
    return marked(spark, sf_dir).select("target", "path", "line_no", "rule_id", ops.inline_suppressed(F.col("marked"), F.col("rule")).alias("suppressed"))


@query(f"SELECT {_INLINE} AS suppressed, count(*) AS hits FROM {_MARKED} AS m GROUP BY 1")
def inline_marker(spark, sf_dir):
    return marked(spark, sf_dir).groupBy(ops.inline_suppressed(F.col("marked"), F.col("rule")).alias("suppressed")).agg(F.count(F.lit(1)).alias("hits"))


# Results in and out.
@query(f"SELECT target, rule, file, line, severity FROM {d.SOURCE} AS f")
def write_findings_json(spark, sf_dir):
    path = sinks.scratch(spark, "findings")
    sinks.write_findings(d.source_findings(spark, sf_dir), path)
    back = spark.read.text(path).select("target", F.from_json("value", "rule string, file string, line int, severity int").alias("f"))
    return back.select("target", "f.rule", "f.file", "f.line", "f.severity")


@query(f"SELECT target, rule AS rule_id, ['note', 'warning', 'error', 'error'][severity + 1] AS level, message, file AS uri, line AS start_line, cwe, ['', 'low', 'medium', 'high'][confidence + 1] AS confidence FROM {d.SOURCE} AS f")
def write_sarif(spark, sf_dir):
    path = sinks.scratch(spark, "sarif")
    sinks.write_sarif(d.source_findings(spark, sf_dir), path)
    kind = "ruleId string, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>, properties struct<cwe:string,confidence:string>"
    back = spark.read.text(f"{path}/results").select("target", F.from_json("value", kind).alias("r"))
    place = F.get("r.locations", 0)["physicalLocation"]
    return back.select("target", F.col("r.ruleId").alias("rule_id"), "r.level", F.col("r.message.text").alias("message"), place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("start_line"), "r.properties.cwe", "r.properties.confidence")


@query(f"SELECT target, '2.1.0' AS version, 'riskweave' AS tool, string_agg(DISTINCT rule || coalesce(' ' || cwe, ''), ',' ORDER BY rule || coalesce(' ' || cwe, '')) AS rules FROM {d.SOURCE} AS f GROUP BY target")
def sarif_runs(spark, sf_dir):
    path = sinks.scratch(spark, "sarif")
    sinks.write_sarif(sinks.stored(d.source_findings(spark, sf_dir), "found"), path)
    kind = "version string, runs array<struct<tool:struct<driver:struct<name:string,version:string,rules:array<struct<id:string,properties:struct<cwe:string>>>>>>>"
    run = spark.read.text(f"{path}/documents").select("target", F.from_json("value", kind).alias("r")).select("target", "r.version", F.get("r.runs", 0)["tool"]["driver"].alias("driver"))
    rules = F.transform("driver.rules", lambda x: F.concat(x["id"], F.coalesce(F.concat(F.lit(" "), x["properties"]["cwe"]), F.lit(""))))
    return run.select("target", "version", F.col("driver.name").alias("tool"), F.array_join(F.array_sort(rules), ",").alias("rules"))


_BODY = ["null", "", "[broken", '[{"rule":"x","severity":2,"line":3},{"rule":"y","severity":0}]', "[]", '{"a":1}']


@query(f"SELECT target, count(rule) AS findings, bool_or(body IN ('[broken', '{{\"a\":1}}')) AS failed FROM (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS target, {pick_sql(_BODY, 'o_orderkey')} AS body, unnest(CASE WHEN o_orderkey % 6 = 3 THEN ['x', 'y'] ELSE [NULL] END) AS rule FROM orders) AS b GROUP BY target")
def read_scan_results(spark, sf_dir):
    k = F.col("o_orderkey")
    bodies = corpora.table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), k.cast("string")).alias("target"), pick(_BODY, k).alias("body"))
    found, failed = sinks.scan_results(bodies)
    n = found.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return bodies.select("target").join(n, "target", "left").join(failed, "target", "left").select("target", F.coalesce("n", F.lit(0)).alias("findings"), F.col("reason").isNotNull().alias("failed"))


ROOTS = ["/w/src", "/w", "/w/src/a/", "/x/y"]
FULL = ["/w/src/a/b.py", "rel/c.py", "/w/src", "/x/z/./d.py", "/w/../x/y/e.py"]
_RELATIVE = {("/w/src", 0): "a/b.py", ("/w", 0): "src/a/b.py", ("/w/src/a/", 0): "b.py", ("/x/y", 0): "../../w/src/a/b.py", ("/w/src", 2): ".", ("/w", 2): "src", ("/w/src/a/", 2): "..", ("/x/y", 2): "../../w/src", ("/w/src", 3): "../../x/z/d.py", ("/w", 3): "../x/z/d.py", ("/w/src/a/", 3): "../../../x/z/d.py", ("/x/y", 3): "../z/d.py"}
_REL = "(VALUES " + ", ".join([f"({text_sql(root)}, {text_sql(FULL[i])}, {text_sql(x)})" for (root, i), x in _RELATIVE.items()] + [f"({text_sql(root)}, 'rel/c.py', 'rel/c.py')" for root in ROOTS]) + ") AS x(root, path, relative)"


@query(f"SELECT k, p.root, p.path, relative FROM (SELECT o_orderkey AS k, {pick_sql(ROOTS, 'o_orderkey')} AS root, {pick_sql(FULL[:4], 'o_orderkey // 4')} AS path FROM orders) AS p JOIN {_REL} ON p.root = x.root AND p.path = x.path")
def relative_path(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = corpora.table(spark, sf_dir, "orders").select(k.alias("k"), pick(ROOTS, k).alias("root"), pick(FULL[:4], F.floor(k / 4)).alias("path"))
    return rows.withColumn("relative", paths.relative_to(F.col("path"), F.col("root")))


NAMES = ["./a", "../b", "/c", "~/d", "github:o/r", "@s/p", "left-pad", "a/b", "x (y) z", "@-a//b-"]


@query(f"SELECT p_partkey AS k, {pick_sql(NAMES, 'p_partkey')} AS target, CASE p_partkey % 10 WHEN 4 THEN 'github' WHEN 5 THEN 'npm' WHEN 6 THEN 'npm' WHEN 8 THEN 'npm' WHEN 9 THEN 'npm' ELSE 'local' END AS kind FROM part")
def target_kind(spark, sf_dir):
    t = pick(NAMES, F.col("p_partkey"))
    return corpora.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), t.alias("target"), names.target_kind(t).alias("kind"))


_SAFE = "regexp_replace(regexp_replace(regexp_replace({x}, '[@/ ()]', '-', 'g'), '-{{2,}}', '-', 'g'), '^-|-$', '', 'g')"


@query(f"SELECT p_partkey AS k, {_SAFE.format(x=pick_sql(NAMES, 'p_partkey'))} AS planted, {_SAFE.format(x='p_name')} AS part FROM part")
def safe_name(spark, sf_dir):
    return corpora.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), names.safe_name(pick(NAMES, F.col("p_partkey"))).alias("planted"), names.safe_name(F.col("p_name")).alias("part"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN 'pkg' || CAST(c_custkey AS VARCHAR) ELSE 'github:own/r' || CAST(c_custkey AS VARCHAR) END AS target FROM customer")
def sweep_target(spark, sf_dir):
    k = F.col("c_custkey")
    package = F.when(k % 5 != 0, F.concat(F.lit("pkg"), k.cast("string")))
    repo = F.concat(F.lit("https://github.com/own/r"), k.cast("string"), F.lit("/tree/main"))
    return corpora.table(spark, sf_dir, "customer").select(k.alias("k"), names.sweep_target(F.when(k % 3 == 0, "npm").otherwise("git"), package, repo).alias("target"))


ROOT_FILES = ["README.md", "go.mod", "setup.py", "src/package.json", "package.json", "requirements.txt", "pyproject.toml"]


@query(f"SELECT target, CASE WHEN bool_or(path = 'package.json') THEN 'javascript' WHEN bool_or(path IN ('pyproject.toml', 'requirements.txt', 'setup.py')) THEN 'python' WHEN bool_or(path = 'go.mod') THEN 'go' ELSE 'unknown' END AS language FROM (SELECT 'l' || CAST(l_orderkey AS VARCHAR) AS target, {pick_sql(ROOT_FILES, 'l_orderkey // 5 + l_linenumber * l_linenumber')} AS path FROM lineitem) AS f GROUP BY target")
def project_language(spark, sf_dir):
    files = corpora.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("l"), F.col("l_orderkey").cast("string")).alias("target"), pick(ROOT_FILES, F.floor(F.col("l_orderkey") / 5) + F.col("l_linenumber") * F.col("l_linenumber")).alias("path"))
    return names.project_language(files)


@query("SELECT c_custkey AS pos, c_name AS target FROM customer ORDER BY c_custkey LIMIT 25")
def limit_targets(spark, sf_dir):
    return names.limit_targets(corpora.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("target")), 25)


# Streams, drained.
def _stream(spark, sf_dir, corpus, name):
    """The planted corpus as files in a shared folder, read as a stream."""
    path = sinks.scratch(spark, name)
    corpus(spark, sf_dir).write.parquet(f"{path}/in")
    return streams.table_stream(spark, f"{path}/in"), path


@query(f"SELECT * FROM {d.ARGUMENTS} AS a")
def stream_scan_arguments(spark, sf_dir):
    calls, path = _stream(spark, sf_dir, corpora.tool_calls, "calls")
    return streams.drain(streams.scan_arguments(calls).drop("file", "line", "quoted"), path)


@query(f"SELECT target, 'response' AS detector, rule, severity, confidence, template AS message, tool_name AS tool, cwe FROM (SELECT source AS target, lang AS tool_name, text FROM documents) AS t JOIN {d.rules_sql(d.r.RESPONSES)} ON regexp_matches(t.text, r.pattern)")
def stream_scan_responses(spark, sf_dir):
    docs = streams.table_stream(spark, f"{sf_dir}/documents.parquet").select(F.col("source").alias("target"), F.col("lang").alias("tool_name"), "text")
    return streams.drain(streams.scan_responses(docs).drop("file", "line", "quoted"), sinks.scratch(spark, "responses"))


@query(f"SELECT * FROM {net.CONNECTIONS} AS c")
def stream_classify_connections(spark, sf_dir):
    lines, path = _stream(spark, sf_dir, net.trace_lines, "trace")
    return streams.drain(streams.classify_connections(lines), path)


@query(f"SELECT target, tool_name, state FROM {net.DIFFS} AS d WHERE state <> 'removed' OR target IN (SELECT target FROM ({corpora.TOOLS_SQL}) AS t WHERE snapshot = 'new')")
def stream_pin_check(spark, sf_dir):
    """Each listing arrives as a file; three or more batches."""
    path = sinks.scratch(spark, "listings")
    tools = corpora.tools(spark, sf_dir)
    tools.where("snapshot = 'new'").repartition("target").write.parquet(f"{path}/in")
    pins.write(tools.where("snapshot = 'old'"), f"{path}/pins")
    return streams.check_listings(streams.table_stream(spark, f"{path}/in", files_per_batch=2), pins.read(spark, f"{path}/pins"), path).select("target", "tool_name", "state")


# Rules as a table: one for each supplier's phone digits and key, beside the built-in ones for responses.
_OWN = "SELECT 'own-' || CAST(s_suppkey AS VARCHAR) AS rule_id, '(?i)TOOL' || CAST(s_suppkey AS VARCHAR) || '\\b' AS pattern FROM supplier"
_TABLE = f"({_OWN} UNION ALL SELECT rule_id, pattern FROM {d.rules_sql(d.r.RESPONSES)})"
_CALLED = f"(SELECT o_orderkey AS k, 'called Tool' || CAST(o_custkey % 120 AS VARCHAR) || ' got ' || {pick_sql(corpora.RESPONSE_SAMPLES, 'o_orderkey')} AS text FROM orders)"


def rule_table(spark, sf_dir):
    own = corpora.table(spark, sf_dir, "supplier").select(F.concat(F.lit("own-"), F.col("s_suppkey").cast("string")).alias("rule_id"), F.concat(F.lit("(?i)TOOL"), F.col("s_suppkey").cast("string"), F.lit("\\b")).alias("pattern"))
    return own.unionByName(spark.createDataFrame([(x.id, x.pattern) for x in d.r.RESPONSES], "rule_id string, pattern string"))


@query(f"SELECT k, rule_id FROM {_CALLED} AS t JOIN {_TABLE} AS r ON regexp_matches(text, pattern)")
def scan_rule_table(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("called Tool"), (F.col("o_custkey") % 120).cast("string"), F.lit(" got "), pick(corpora.RESPONSE_SAMPLES, k))
    return ruletable.match_table(corpora.table(spark, sf_dir, "orders").select(k.alias("k"), text.alias("text")), "text", rule_table(spark, sf_dir)).select("k", "rule_id")
