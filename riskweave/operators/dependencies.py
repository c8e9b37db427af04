"""Package manifests, requirement lines, versions and the vulnerability table; install hooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweave.functions import paths
from riskweave.functions.text import SCRIPT_CUT, bound, once, quoted, render, trim_space, truncate
from riskweave.operators.detect import explode_lines
from riskweave.operators.matching import match_rules
from riskweave.rules import catalog as c
from riskweave.rules import ruleset as r
from riskweave.rules.dialect import to_java

# Operators in the order in which they are tried.
REQUIREMENT_OPERATORS = ["===", "~=", "!=", "==", ">=", "<=", ">", "<"]
VERSION_PREFIXES = [">=", "<=", "~=", "!=", "==", "^", "~", "=", ">", "<"]
UNPINNED = ["", "*", "latest"]
MANIFEST = "dependencies map<string,string>, devDependencies map<string,string>, scripts map<string,string>"
#: What the two findings on an unreadable manifest say; the second ends with the path.
PARSE_ERROR, HOOK_PARSE_ERROR = "Failed to parse package.json: not an object of string maps", "package.json could not be parsed (malformed JSON): "
_MEMBERS = ["dependencies", "devDependencies", "scripts"]


def with_manifest(files: DataFrame, where: Column | None = None) -> DataFrame:
    """``files`` and valid, m (where the condition holds, if one is given): a text is a manifest if it is an object whose three members map to strings.  Each text is parsed once."""
    content = F.col("content") if where is None else F.when(where, F.col("content"))
    rest = files.columns
    files = once(files, _v=F.try_parse_json(content), m=F.from_json(content, MANIFEST))
    members = {f"_{name}": F.try_variant_get("_v", f"$.{name}", "variant") for name in _MEMBERS}
    files = once(files, **members)
    kinds = {f"_kind{name}": F.schema_of_variant(name) for name in members}
    files = once(files, **kinds)
    valid = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    for name in members:
        kind, entries = F.col(f"_kind{name}"), F.try_variant_get(name, "$", "map<string,variant>")
        fine = kind.startswith("OBJECT") & F.coalesce(F.forall(F.map_values(entries), lambda x: F.schema_of_variant(x).isin("STRING", "VOID")), F.lit(True))
        valid = valid & F.coalesce(F.col(name).isNull() | (kind == "VOID") | fine, F.lit(True))
    return files.select(*rest, valid.alias("valid"), "m")


def manifests(files: DataFrame) -> DataFrame:
    """target, path, content, valid, m: every package.json below no excluded directory."""
    own = files.where((paths.base_name(F.col("path")) == "package.json") & ~paths.in_excluded_dir(F.col("path")))
    return with_manifest(own.select("target", "path", "content"))


def merged(m: Column) -> Column:
    """Name to version; the development version of a name wins."""
    empty = F.create_map().cast("map<string,string>")
    dependencies, dev = F.coalesce(m["dependencies"], empty), F.coalesce(m["devDependencies"], empty)
    return F.map_concat(F.map_filter(dependencies, lambda k, _: ~F.map_contains_key(dev, k)), dev)


def merged_dependencies(parsed: DataFrame) -> DataFrame:
    """target, path, name, version of all dependencies of readable manifests."""
    return parsed.where("valid").select("target", "path", F.explode(merged(F.col("m"))).alias("name", "version"))


def scripts(parsed: DataFrame) -> DataFrame:
    return parsed.where("valid").select("target", "path", F.explode("m.scripts").alias("hook", "script"))


def normalize_version(version: Column) -> Column:
    """Without the first range operator, cut at the first space, tab, bar or comma."""
    v = trim_space(F.coalesce(version, F.lit("")))
    out = v
    for prefix in reversed(VERSION_PREFIXES):
        out = F.when(F.startswith(v, F.lit(prefix)), trim_space(F.substring(v, F.lit(len(prefix) + 1), F.length(v)))).otherwise(out)
    return F.regexp_extract(out, r"^[^ \t|,]*", 0)


def normalize_name(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit("_"), F.lit("-")))


def parse_requirement(line: Column) -> tuple[Column, Column]:
    """(name, version) by the first operator of the list that occurs anywhere in the line."""
    name, version = trim_space(line), F.lit("")
    for op in reversed(REQUIREMENT_OPERATORS):
        at = F.instr(line, F.lit(op))
        rest = trim_space(F.substring(line, at + len(op), F.length(line)))
        name = F.when(at > 0, trim_space(F.left(line, at - 1))).otherwise(name)
        version = F.when(at > 0, trim_space(F.substring_index(rest, ",", 1))).otherwise(version)
    return normalize_name(name), version


def version_parts(version: Column) -> Column:
    """Segments between dots without a pre-release label; trailing empty ones dropped, so that an empty version has none."""
    bare = F.regexp_replace(F.regexp_replace(version, r"^([^-]*)-[^0-9].*\z", "$1"), r"\.+\z", "")
    return bound(bare, lambda v: F.when(v == "", F.array().cast("array<string>")).otherwise(F.split(v, r"\.")))


def version_segments(version: Column) -> Column:
    """The parts as (n, s): the number where a part is one, and its text."""
    return F.transform(version_parts(version), lambda x: F.struct(F.when(x.rlike(r"^[+-]?[0-9]+\z"), x.try_cast("long")).alias("n"), x.alias("s")))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1: segment by segment, the shorter filled with zeros; as numbers where both are, else as text."""
    return compare_segments(version_segments(a), version_segments(b))


def compare_segments(a: Column, b: Column) -> Column:
    """``compare_versions`` of versions that are cut into segments already."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit("0").alias("s"))
    sign = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)

    def one(x: Column, y: Column) -> Column:
        x, y = F.coalesce(x, zero), F.coalesce(y, zero)
        return F.when(x["n"].isNotNull() & y["n"].isNotNull(), sign(x["n"], y["n"])).otherwise(sign(x["s"], y["s"]))

    differs = F.filter(F.zip_with(a, b, one), lambda z: z != 0)
    return F.coalesce(F.get(differs, F.lit(0)), F.lit(0))


def version_key(version: Column) -> Column:
    """Bytes whose order is that of ``compare_versions``, so that versions can be sorted and ranges of them filtered.

    A segment that is a number is its length and digits, one that begins with a
    letter sorts behind all numbers, by its text; zeros at the end don't count.
    Null where segments have no such order: text that begins with a digit is
    compared with numbers as text, which isn't transitive.  Signed numbers, empty
    segments and segments that begin with other signs have no key either.
    """
    digits = lambda n: F.concat(F.lit("1"), F.hex(F.length(F.hex(n)).cast("long") - 1), F.hex(n))
    code = lambda x: F.when(x["s"].rlike(r"^[0-9]+\z") & x["n"].isNotNull(), digits(x["n"])).when(x["s"].rlike(r"(?s)^[A-Za-z][^\x00]*\z"), F.concat(F.lit("2"), F.hex(F.encode(x["s"], "UTF-8")), F.lit("!")))
    codes = F.transform(version_segments(version), code)
    key = F.regexp_replace(F.array_join(codes, "."), r"(?:(?:^|\.)100)+\z", "")
    return F.when(~F.exists(codes, lambda x: x.isNull()), key).cast("binary")


def at_most(version: Column, key: Column, limit: Column, limit_key: Column) -> Column:
    """``version`` is not above ``limit``: by their keys where both have one, else segment by segment."""
    return F.when(key.isNotNull() & limit_key.isNotNull(), key <= limit_key).otherwise(compare_versions(version, limit) <= 0)


def vulnerabilities(spark: SparkSession) -> DataFrame:
    """The advisory table, with keys of the last affected versions: a fixed list, so its broadcast is bounded."""
    table = spark.createDataFrame(c.VULNERABLE_PACKAGES, "vuln string, max_affected string, cve string, cvss double, vuln_severity int, about string")
    return F.broadcast(table.withColumn("max_key", version_key(F.col("max_affected"))))


def _score() -> Column:
    return F.concat(F.col("cve"), F.lit(" (CVSS "), F.format_string("%.1f", "cvss"), F.lit("): "), F.col("about"))


def _vulnerable() -> Column:
    return F.concat(F.lit(" is vulnerable ("), F.col("cve"), F.lit(", CVSS "), F.format_string("%.1f", "cvss"), F.lit("): "), F.col("about"))


def _audit(unknown: Column, what: Column) -> list[Column]:
    """The columns of a finding that don't hang on the kind of file; ``what`` is pinned to avoid an advisory."""
    return [
        F.when(unknown, "dep-audit-unknown-version").otherwise("dep-audit-vulnerable").alias("rule"), F.when(unknown, c.WARNING).otherwise(F.col("vuln_severity")).alias("severity"), F.lit(c.UNSET).alias("confidence"), F.when(~unknown, "CWE-1395").alias("cwe"),
        F.when(unknown, F.concat(F.lit("Pin "), what, F.lit(" > "), "max_affected", F.lit(" to avoid "), "cve")).otherwise(F.concat(F.lit("Upgrade "), "name", F.lit(" above "), "max_affected", F.lit(" to fix "), "cve")).alias("fix"),
        F.when(~unknown, F.array("cve")).alias("refs"),
    ]


def audit_npm(deps: DataFrame) -> DataFrame:
    """Dependencies at or below a vulnerable version, and unpinned ones of a vulnerable package; one row for each advisory."""
    d = deps.join(vulnerabilities(deps.sparkSession), F.col("name") == F.col("vuln"))
    rest = [x for x in d.columns]
    own = bound(normalize_version(F.col("version")), lambda v: F.struct(v.alias("v"), version_key(v).alias("key")))
    d = d.select(*rest, F.explode(F.array(own)).alias("own"))
    v, unknown = F.col("own.v"), F.col("own.v").isin(*UNPINNED)
    hit = d.where(unknown | at_most(v, F.col("own.key"), F.col("max_affected"), F.col("max_key")))
    message = F.when(unknown, F.concat("name", F.lit(": version "), quoted(F.col("version")), F.lit(" is unpinned — cannot verify against "), _score())).otherwise(F.concat("name", F.lit("@"), v, _vulnerable()))
    return hit.select("target", *_audit(unknown, F.lit("to a version")), message.alias("message"), F.col("path").alias("file"), "cve")


def requirement_text(raw: Column) -> Column:
    """A requirement line without comment and markers; null for blank lines, comments and options."""
    cut = lambda x, mark: trim_space(F.substring_index(x, mark, 1))
    return bound(trim_space(raw), lambda x: F.when((x != "") & ~F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit("-")), cut(cut(x, " #"), ";")))


def pyproject_text(raw: Column) -> Column:
    """A project file's line without comment, quotes and brackets; null for blank lines and comments."""
    return bound(trim_space(raw), lambda x: F.when((x != "") & ~F.startswith(x, F.lit("#")), F.btrim(trim_space(F.substring_index(x, " #", 1)), F.lit("\"',[]"))))


def _requirements(files: DataFrame, name: str, text) -> DataFrame:
    lines = explode_lines(files.where((paths.base_name(F.col("path")) == name) & ~paths.in_excluded_dir(F.col("path"))))
    lines = lines.withColumn("line", text(F.col("line"))).where("line IS NOT NULL")
    name, version = parse_requirement(F.col("line"))
    return lines.select("target", "path", "line_no", name.alias("name"), version.alias("version")).where("name != ''")


def requirement_lines(files: DataFrame) -> DataFrame:
    """target, path, line_no, name, version of requirements.txt lines: no comments, options, markers."""
    return _requirements(files, "requirements.txt", requirement_text)


def pyproject_lines(files: DataFrame) -> DataFrame:
    return _requirements(files, "pyproject.toml", pyproject_text)


def audit_pip(deps: DataFrame) -> DataFrame:
    """As ``audit_npm`` by lower-cased name; only a missing version is unknown.  Messages say where a project file names the package."""
    d = deps.join(vulnerabilities(deps.sparkSession), F.lower("name") == F.lower("vuln"))
    d = d.select("*", F.explode(F.array(F.struct(version_key(F.col("version")).alias("key")))).alias("own"))
    unknown = F.col("version") == ""
    hit = d.where(unknown | at_most(F.col("version"), F.col("own.key"), F.col("max_affected"), F.col("max_key")))
    place = F.when(paths.base_name(F.col("path")) == "pyproject.toml", " in pyproject.toml").otherwise("")
    message = F.when(unknown, F.concat("name", F.lit(": version unknown"), place, F.lit(" — manual check required against "), _score())).otherwise(F.concat("name", F.lit("=="), "version", place, _vulnerable()))
    return hit.select("target", *_audit(unknown, F.concat("name", F.lit(" to a version"))), message.alias("message"), F.col("path").alias("file"), F.col("line_no").alias("line"), "name", "version", "cve")


def malformed(parsed: DataFrame) -> DataFrame:
    """Two findings for each manifest that can't be read: of the dependency audit and of the hook analysis."""
    texts = {"dep-audit-parse-error": F.lit(PARSE_ERROR), "mcp-install-hook-malformed-json": F.concat(F.lit(HOOK_PARSE_ERROR), "path")}
    each = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), text.alias("message")) for rule, text in texts.items()])).alias("f")
    return parsed.where("NOT valid").select("target", "path", each).select("target", "f.rule", F.lit(c.WARNING).alias("severity"), F.lit(c.UNSET).alias("confidence"), "f.message", F.col("path").alias("file"))


def suspicious_scripts(found: DataFrame) -> DataFrame:
    """Lifecycle scripts with the first pattern of the list that they match."""
    which = F.coalesce(*[F.when(F.col("script").rlike(to_java(p)), F.lit(p)) for p in c.LIFECYCLE_PATTERNS])
    return found.where(F.col("hook").isin(*c.LIFECYCLE_SCRIPTS)).select("target", F.col("path").alias("file"), "hook", "script", which.alias("pattern")).where("pattern IS NOT NULL")


def suspicious_findings(found: DataFrame) -> DataFrame:
    message = F.concat(F.lit("package.json scripts."), "hook", F.lit(" contains suspicious pattern "), quoted(F.col("pattern")), F.lit(": "), truncate(F.col("script"), SCRIPT_CUT))
    return suspicious_scripts(found).select("target", F.lit("dep-suspicious-install-script").alias("rule"), F.lit(c.HIGH).alias("severity"), F.lit(c.UNSET).alias("confidence"), message.alias("message"), "file")


def hook_findings(found: DataFrame) -> DataFrame:
    """Install-hook rules on the scripts themselves."""
    own = found.where(F.col("hook").isin(*c.HOOK_SCRIPTS) & (trim_space(F.col("script")) != ""))
    hits = match_rules(own, "script", r.HOOKS)
    return hits.select("target", "rule", "severity", render(F.col("template"), truncate(F.col("script"), SCRIPT_CUT)).alias("message"), F.col("path").alias("file"), "hook", "cwe")


def referenced_files(found: DataFrame) -> DataFrame:
    """target, path: the script file that a hook starts, from the manifest's folder; one row for each hook."""
    own = found.where(F.col("hook").isin(*c.HOOK_SCRIPTS) & (trim_space(F.col("script")) != ""))
    file = F.regexp_extract("script", to_java(c.SCRIPT_FILE_PATTERN), 1)
    return own.where(file != "").select("target", paths.join_path(paths.dir_name(F.col("path")), file).alias("path"), "hook")


def _lines_with(lines: DataFrame, rules) -> DataFrame:
    hits = match_rules(lines, "line", rules)
    return hits.select("target", "rule", "severity", render(F.col("template"), truncate(trim_space(F.col("line")), SCRIPT_CUT)).alias("message"), F.col("path").alias("file"), F.col("line_no").alias("line"), "cwe")


def referenced_findings(found: DataFrame, files: DataFrame) -> DataFrame:
    """Install-hook rules on the lines of the files that hooks start; an equi-join on target and path, before lines are split."""
    started = files.join(referenced_files(found), ["target", "path"])
    return _lines_with(explode_lines(started.select("target", "path", "content")), r.HOOKS)


def python_hooks(files: DataFrame) -> DataFrame:
    own = files.where(paths.base_name(F.col("path")).isin("setup.py", "pyproject.toml") & ~paths.in_excluded_dir(F.col("path")))
    return _lines_with(explode_lines(own.select("target", "path", "content")), r.PYTHON_HOOKS)
