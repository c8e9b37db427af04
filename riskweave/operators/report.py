"""The whole report: all detectors' findings in one table, each corpus read and matched once.

Detectors that look at the same rows share one pass: their rules are one list, cut
into runs that apply under their own conditions, and the hits are told apart
afterwards.  A detector that is skipped has its rules left out of the pass.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, functions as F

from riskweave.functions import paths
from riskweave.functions.text import SCRIPT_CUT, LINE_CUT, bound, each, quoted, render, trim_space, truncate
from riskweave.operators import dependencies as deps
from riskweave.operators import detect, network
from riskweave.operators.findings import union_findings
from riskweave.operators.matching import ORD, match_rules, matched_text, rule_ords, with_rule_columns
from riskweave.rules import catalog as c
from riskweave.rules import ruleset as r
from riskweave.rules.dialect import to_java

REPORT = detect.REPORT
#: Detectors that one skip flag leaves out together.
DEPENDENCY_AUDIT = ("dependency", "hook")
DETECTORS = ("source", "egress", "dependency", "hook", "description", "exposure", "argument", "response", "connection")
# What to do about a connection, by rule.
CONNECTION_FIXES = {
    "net-probe-dns-query": "Review why the server resolves external hostnames during tool execution.",
    "net-probe-outbound-connection": "Audit outbound connections; ensure no data exfiltration is occurring.",
    "net-probe-metadata-service": "This is a strong SSRF indicator. Block access to 169.254.169.254.",
    "net-probe-private-ip": "Verify this internal connection is intentional and not SSRF.",
}
_TYPES = {"severity": "int", "confidence": "int", "line": "int", "refs": "array<string>"}


def as_report(findings: DataFrame, detector: str | None = None) -> DataFrame:
    """The columns of a report in order; those that ``findings`` lacks are null, a lacking confidence is unset."""
    fill = {"detector": F.lit(detector), "confidence": F.lit(c.UNSET)}
    return findings.select(*[(F.col(x) if x in findings.columns else fill.get(x, F.lit(None))).cast(_TYPES.get(x, "string")).alias(x) for x in REPORT])


def from_lines(lines: DataFrame, skip: Collection[str] = ()) -> DataFrame:
    """Source and egress findings of lines (target, path, lang, line_no, line)."""
    source = () if "source" in skip else r.SOURCE
    egress = () if "egress" in skip else r.EGRESS
    line = F.col("line")
    hits = match_rules(lines, "line", (*source, *egress), lang="lang", runs=[(len(source), ~detect.is_comment(line, F.col("lang"))), (len(egress), None)])
    own = F.col(ORD) < len(source)
    hits = hits.where(~own | (~detect.excluded(line, source) & ~detect.placeholder_secret(line, source) & ~detect.self_assigned_secret(line, source)))
    message = F.when(own, render(F.col("template"), truncate(trim_space(line), LINE_CUT))).otherwise(F.concat(F.lit(detect.EGRESS_MESSAGE), detect.call_method(len(source))))
    found = hits.select("target", F.when(own, "source").otherwise("egress").alias("detector"), "rule", detect.temp_severity(line).alias("severity"), "confidence", message.alias("message"), F.col("path").alias("file"), F.col("line_no").alias("line"), "cwe")
    return as_report(found)


#: Not matched: a tool's tier decides.
_EXPOSURE = r.Rule("exposure", "mcp-sensitive-exposure", c.WARNING, c.UNSET, None, "", "")


def from_tools(tools: DataFrame, skip: Collection[str] = ()) -> DataFrame:
    """Findings in the descriptions of tools (target, tool_name, description, input_schema), in those of their schemas, and by their tier."""
    rules = () if "description" in skip else (*r.DESCRIPTIONS, *r.INVISIBLE)
    patterns = len(rules) - len(r.INVISIBLE) if rules else 0
    text = lambda x, prefix, tier: F.struct(x.alias("description"), F.lit(prefix).alias("prefix"), tier.alias("tier"))
    nested = F.transform(detect.schema_descriptions(F.col("input_schema")), lambda x: text(x, detect.NESTED_PREFIX, F.lit(-1)))
    own = F.array(text(F.col("description"), "", detect.risk_tier(F.col("description"))))
    texts = each(tools, F.concat(own, nested), "t").select("target", "tool_name", "t.*")
    places = rule_ords("description", rules) if rules else F.array().cast("array<int>")
    if "exposure" not in skip:
        places = F.concat(F.coalesce(places, F.array().cast("array<int>")), F.when(F.col("tier") >= 2, F.array(F.lit(len(rules)))).otherwise(F.array().cast("array<int>")))
    hits = with_rule_columns(each(texts, places, ORD), (*rules, _EXPOSURE))
    exposed = F.col(ORD) == len(rules)
    counted = F.concat(F.lit(detect.INVISIBLE_MESSAGE[0]), detect.invisible_count(F.col("description")).cast("string"), F.lit(detect.INVISIBLE_MESSAGE[1]))
    quotes = F.coalesce(matched_text(F.col("description"), rules[:patterns]), F.lit(""))
    said = F.concat(F.lit("Tool "), quoted(F.col("tool_name")), F.lit(" exposes "), detect.tier_label(F.col("tier")), F.lit("-risk capabilities"))
    message = F.when(exposed, said).when(F.col(ORD) == patterns, F.concat("prefix", counted)).otherwise(F.concat("prefix", render(F.col("template"), truncate(quotes, LINE_CUT))))
    return as_report(hits.select("target", F.when(exposed, "exposure").otherwise("description").alias("detector"), "rule", F.when(exposed, F.col("tier") - 1).otherwise(F.col("severity")).alias("severity"), "confidence", message.alias("message"), F.col("tool_name").alias("tool"), "cwe"))


_ITEM = "array<struct<kind:string,line_no:int,name:string,version:string,hook:string,text:string>>"
_FOUND = "array<struct<detector:string,rule:string,severity:int,message:string,line:int,cwe:string,fix:string,refs:array<string>>>"


def _item(kind: str, line_no: Column | None = None, **values: Column) -> Column:
    null = lambda kind="string": F.lit(None).cast(kind)
    return F.struct(F.lit(kind).alias("kind"), (null("int") if line_no is None else line_no).alias("line_no"), *[values.get(x, null()).alias(x) for x in ("name", "version", "hook", "text")])


def package_items(files: DataFrame) -> DataFrame:
    """target, path and what a package's files say, from one read of them: kind (npm, pip, script, line, malformed) with its columns.

    A manifest's dependencies and scripts, the requirements of requirement and
    project files, and the lines of build files; malformed has one item for a
    manifest that can't be read.
    """
    base = paths.base_name(F.col("path"))
    files = files.where(base.isin("package.json", "requirements.txt", "pyproject.toml", "setup.py") & ~paths.in_excluded_dir(F.col("path")))
    none = F.array().cast(_ITEM)
    files = deps.with_manifest(files.select("target", "path", "content"), base == "package.json")
    merged = F.transform(F.map_entries(deps.merged(F.col("m"))), lambda e: _item("npm", name=e["key"], version=e["value"]))
    scripts = F.transform(F.map_entries("m.scripts"), lambda e: _item("script", hook=e["key"], text=e["value"]))
    manifest = F.when(F.col("valid"), F.concat(F.coalesce(merged.cast(_ITEM), none), F.coalesce(scripts.cast(_ITEM), none))).otherwise(F.array(_item("malformed")).cast(_ITEM))

    def requirements(cleaned) -> Column:
        """The items of all lines that ``cleaned`` (line -> requirement text, null for none) leaves with a name."""
        each = F.transform(F.split("content", "\n", -1), lambda x, i: bound(cleaned(x), lambda y: bound(F.struct(*[p.alias(n) for p, n in zip(deps.parse_requirement(y), ("name", "version"), strict=True)]), lambda p: _item("pip", (i + 1).cast("int"), name=p["name"], version=p["version"]))))
        return F.filter(each, lambda x: F.coalesce(x["name"] != "", F.lit(False))).cast(_ITEM)

    lines = F.transform(F.split("content", "\n", -1), lambda x, i: _item("line", (i + 1).cast("int"), text=x)).cast(_ITEM)
    items = (
        F.when(base == "package.json", manifest).when(base == "requirements.txt", requirements(deps.requirement_text))
        .when(base == "pyproject.toml", F.concat(requirements(deps.pyproject_text), lines)).otherwise(lines)
    )
    return each(files, items, "i").select("target", "path", "i.*")


def _advisories(items_path: Column) -> Column:
    """Findings of the dependency audit for an item, from the fixed list of advisories."""
    known = F.array(*[F.struct(F.lit(n).alias("vuln"), F.lit(m).alias("max_affected"), F.lit(cve).alias("cve"), F.lit(f"{score:.1f}").alias("score"), F.lit(sev).alias("severity"), F.lit(about).alias("about")) for n, m, cve, score, sev, about in c.VULNERABLE_PACKAGES])
    npm, name, version = F.col("kind") == "npm", F.col("name"), F.col("version")
    place = F.when(paths.base_name(items_path) == "pyproject.toml", " in pyproject.toml").otherwise("")

    def found(own: Column, v: Column) -> Column:
        unknown = F.when(npm, own.isin(*deps.UNPINNED)).otherwise(version == "")
        score = F.concat(v["cve"], F.lit(" (CVSS "), v["score"], F.lit("): "), v["about"])
        bad = F.concat(place, F.lit(" is vulnerable ("), v["cve"], F.lit(", CVSS "), v["score"], F.lit("): "), v["about"])
        asks = F.when(npm, F.concat(name, F.lit(": version "), quoted(version), F.lit(" is unpinned — cannot verify against "), score)).otherwise(F.concat(name, F.lit(": version unknown"), place, F.lit(" — manual check required against "), score))
        tells = F.when(npm, F.concat(name, F.lit("@"), own, bad)).otherwise(F.concat(name, F.lit("=="), own, bad))
        pin = F.concat(F.lit("Pin "), F.when(npm, "").otherwise(F.concat(name, F.lit(" "))), F.lit("to a version > "), v["max_affected"], F.lit(" to avoid "), v["cve"])
        up = F.concat(F.lit("Upgrade "), name, F.lit(" above "), v["max_affected"], F.lit(" to fix "), v["cve"])
        return F.struct(
            F.lit("dependency").alias("detector"), F.when(unknown, "dep-audit-unknown-version").otherwise("dep-audit-vulnerable").alias("rule"), F.when(unknown, c.WARNING).otherwise(v["severity"]).alias("severity"), F.when(unknown, asks).otherwise(tells).alias("message"),
            F.col("line_no").alias("line"), F.when(~unknown, "CWE-1395").alias("cwe"), F.when(unknown, pin).otherwise(up).alias("fix"), F.when(~unknown, F.array(v["cve"])).alias("refs"),
        )

    def hit(own: Column, v: Column) -> Column:
        same = F.when(npm, v["vuln"] == name).otherwise(F.lower(v["vuln"]) == F.lower(name))
        unknown = F.when(npm, own.isin(*deps.UNPINNED)).otherwise(version == "")
        return same & (unknown | (deps.compare_versions(own, v["max_affected"]) <= 0))

    own = F.when(npm, deps.normalize_version(version)).otherwise(version)
    listed = F.filter(known, lambda v: F.when(npm, v["vuln"] == name).otherwise(F.lower(v["vuln"]) == F.lower(name)))
    return F.when(F.col("kind").isin("npm", "pip") & (F.size(listed) > 0), bound(own, lambda o: F.transform(F.filter(listed, lambda v: hit(o, v)), lambda v: found(o, v)))).cast(_FOUND)


def from_packages(files: DataFrame, skip: Collection[str] = ()) -> DataFrame:
    """Dependency and install-hook findings of packages' files (target, path, content); only the scripts that hooks start are read a second time, by a join."""
    items = package_items(files)
    none = F.array().cast(_FOUND)
    hook_rules = (*r.HOOKS, *r.PYTHON_HOOKS)
    started = (F.col("kind") == "script") & F.col("hook").isin(*c.HOOK_SCRIPTS) & (trim_space(F.col("text")) != "")
    shown = truncate(F.when(F.col("kind") == "line", trim_space(F.col("text"))).otherwise(F.col("text")), SCRIPT_CUT)
    meta = F.array(*[F.struct(F.lit(x.rule).alias("rule"), F.lit(x.severity).alias("severity"), F.lit(x.template).alias("template"), F.lit(x.cwe).cast("string").alias("cwe")) for x in hook_rules])
    said = lambda m, shown: F.struct(F.lit("hook").alias("detector"), m["rule"], m["severity"], render(m["template"], shown).alias("message"), F.col("line_no").alias("line"), m["cwe"], F.lit(None).cast("string").alias("fix"), F.lit(None).cast("array<string>").alias("refs"))
    hooks = bound(shown, lambda x: F.transform(rule_ords("text", hook_rules, runs=[(len(r.HOOKS), started), (len(r.PYTHON_HOOKS), F.col("kind") == "line")]), lambda o: said(F.get(meta, o), x)))
    plain = lambda rule, severity, message, detector: F.array(F.struct(F.lit(detector).alias("detector"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("cwe"), F.lit(None).cast("string").alias("fix"), F.lit(None).cast("array<string>").alias("refs"))).cast(_FOUND)
    first = F.coalesce(*[F.when(F.col("text").rlike(to_java(p)), F.lit(p)) for p in c.LIFECYCLE_PATTERNS])
    suspicious = F.when((F.col("kind") == "script") & F.col("hook").isin(*c.LIFECYCLE_SCRIPTS), bound(first, lambda p: F.when(p.isNotNull(), plain("dep-suspicious-install-script", c.HIGH, F.concat(F.lit("package.json scripts."), "hook", F.lit(" contains suspicious pattern "), quoted(p), F.lit(": "), truncate(F.col("text"), SCRIPT_CUT)), "dependency"))))
    bad = F.col("kind") == "malformed"
    parts = []
    if "dependency" not in skip:
        parts += [_advisories(F.col("path")), suspicious, F.when(bad, plain("dep-audit-parse-error", c.WARNING, F.lit(deps.PARSE_ERROR), "dependency"))]
    if "hook" not in skip:
        parts += [F.when(F.col("kind").isin("script", "line"), hooks.cast(_FOUND)), F.when(bad, plain("mcp-install-hook-malformed-json", c.WARNING, F.concat(F.lit(deps.HOOK_PARSE_ERROR), "path"), "hook"))]
    found = each(items, F.concat(*[F.coalesce(p, none) for p in parts]), "f").select("target", F.col("path").alias("file"), "f.*")
    if "hook" in skip:
        return as_report(found)
    scripts = deps.scripts(deps.manifests(files))  # their texts alone: no item of other files is made again
    return union_findings(as_report(found), as_report(deps.referenced_findings(scripts, files), "hook"))


def from_connections(events: DataFrame) -> DataFrame:
    fix = F.lit(None).cast("string")
    for rule, text in CONNECTION_FIXES.items():
        fix = F.when(F.col("rule") == rule, text).otherwise(fix)
    return as_report(network.classify(events).withColumn("fix", fix), "connection")


def report(
    *, lines: DataFrame | None = None, files: DataFrame | None = None, tools: DataFrame | None = None, arguments: DataFrame | None = None, responses: DataFrame | None = None, events: DataFrame | None = None, skip: Collection[str] = (),
) -> DataFrame:
    """All findings of the corpora that are given, without those of skipped detectors; a bag, nothing is dropped as repeated."""
    wanted = lambda *names: not set(names) <= set(skip)
    parts = []
    if lines is not None and wanted("source", "egress"):
        parts.append(from_lines(lines, skip))
    if files is not None and wanted("dependency", "hook"):
        parts.append(from_packages(files, skip))
    if tools is not None and wanted("description", "exposure"):
        parts.append(from_tools(tools, skip))
    if arguments is not None and wanted("argument"):
        parts.append(as_report(detect.scan_arguments(arguments)))
    if responses is not None and wanted("response"):
        parts.append(as_report(detect.scan_responses(responses)))
    if events is not None and wanted("connection"):
        parts.append(from_connections(events))
    if not parts:
        raise ValueError("no corpus is left to report on")
    return union_findings(*parts)
