"""Detectors: text rows against the rule tables, one finding for each (text, pattern) hit.

Findings have target, detector, rule, severity, confidence, message, file, line,
tool and cwe, and ``quoted``, the uncut text that the message quotes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskweave.functions import paths
from riskweave.functions.labels import tier_label
from riskweave.functions.text import ARGUMENT_CUT, LINE_CUT, bound, quoted as in_quotes, render, trim_space, truncate
from riskweave.operators.matching import ORD, matched_text, match_rules
from riskweave.rules import catalog as c
from riskweave.rules import ruleset as r
from riskweave.rules.dialect import to_java

#: Names of the findings' columns; a report has also what to do about a finding and where it is described.
FINDING = ["target", "detector", "rule", "severity", "confidence", "message", "file", "line", "tool", "cwe"]
REPORT = [*FINDING, "fix", "refs"]
# Texts of messages.
EGRESS_MESSAGE = "Tool makes outbound network call via "
INVISIBLE_MESSAGE = ("Found ", " invisible Unicode characters in tool description (possible steganographic payload)")
NESTED_PREFIX = "[nested schema] "
COMMENT = r"^(?://|/\*|\*|--)"


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def explode_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row for each line, numbered from 1; split at line feeds only, so a final one leaves an empty line."""
    rest = [x for x in files.columns if x != content]
    return files.select(*rest, F.posexplode(F.split(content, "\n", -1)).alias("pos", "line")).select(*rest, (F.col("pos") + 1).alias("line_no"), "line")


def with_language(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumn("lang", paths.language(F.col(path)))


def scanned_files(files: DataFrame, *, bundle_bytes: int | None = 1000, bundle_lines: int = 20) -> DataFrame:
    """Files of a known language outside of excluded directories that are neither generated, tests nor bundles."""
    path = F.col("path")
    kept = with_language(files).where((F.col("lang") != paths.UNKNOWN) & ~paths.in_excluded_dir(path) & ~paths.is_generated(path) & ~paths.is_test_file(path))
    return drop_bundled(kept, bundle_bytes, bundle_lines) if bundle_bytes else kept


def is_bundled(content: Column, lang: Column, most_bytes: int = 1000, lines: int = 20) -> Column:
    first = F.slice(F.split(content, "\n", lines + 1), 1, lines)
    return lang.isin("javascript", "typescript") & F.exists(first, lambda x: F.octet_length(x) > most_bytes)


def drop_bundled(files: DataFrame, most_bytes: int = 1000, lines: int = 20) -> DataFrame:
    """Without script files that have a line of more than ``most_bytes`` among their first ``lines``."""
    return files.where(~is_bundled(F.col("content"), F.col("lang"), most_bytes, lines))


def is_comment(line: Column, lang: Column) -> Column:
    start = trim_space(line)
    return start.rlike(COMMENT) | ((lang == "python") & F.startswith(start, F.lit("#")))


def _any(text: Column, patterns: Sequence[str]) -> Column:
    """Does any of the RE2 patterns match?  One alternation, each pattern with its own flags."""
    return text.rlike("|".join(f"(?:{to_java(p)})" for p in patterns))


def is_type_name(text: Column) -> Column:
    """Two or more capitalised words run together: ``TYPE_NAME_PATTERN`` as flat tests, without a loop over a group."""
    return text.rlike(r"\A[A-Z][a-z][A-Za-z]*[a-z]\z") & ~text.rlike("[A-Z][A-Z]") & text.rlike(r"\A.[a-z]+[A-Z]")


def is_placeholder(text: Column) -> Column:
    return _any(text, c.PLACEHOLDER_PATTERNS) | is_type_name(text)


def key_value(line: Column) -> tuple[Column, Column]:
    """The first ``KEY = "value"`` on a line."""
    pattern = to_java(c.KEY_VALUE_PATTERN)
    return F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2)


def excluded(line: Column, rules: Sequence[r.Rule]) -> Column:
    """One of the hit's rule's own exclusions matches the line."""
    out = F.lit(False)
    for i, rule in enumerate(rules):
        if rule.excludes:
            out = F.when(F.col(ORD) == i, _any(line, rule.excludes)).otherwise(out)
    return out


def is_secret(rules: Sequence[r.Rule]) -> Column:
    return F.col(ORD).isin([i for i, rule in enumerate(rules) if rule.secret])


def placeholder_secret(line: Column, rules: Sequence[r.Rule]) -> Column:
    """A secret whose match, or whose line's first quoted value, is documentation."""
    _, value = key_value(line)
    return is_secret(rules) & (bound(_matched_secret(line, rules), is_placeholder) | bound(value, lambda v: (v != "") & is_placeholder(v)))


def _matched_secret(line: Column, rules: Sequence[r.Rule]) -> Column:
    """What a secret's pattern matched; only those patterns are in the expression."""
    out = _null()
    for i, rule in enumerate(rules):
        if rule.secret:
            out = F.when(F.col(ORD) == i, F.regexp_extract(line, rule.java, 0)).otherwise(out)
    return out


def self_assigned_secret(line: Column, rules: Sequence[r.Rule]) -> Column:
    key, value = key_value(line)
    return is_secret(rules) & bound(key, lambda k: (k != "") & (F.lower(k) == F.lower(value)))


def temp_severity(line: Column) -> Column:
    """Severity, lowered to INFO where a destructive call names a temporary place."""
    return F.when((F.col("rule") == c.TEMP_DIR_RULE) & _any(line, c.TEMP_DIR_PATTERNS), c.INFO).otherwise(F.col("severity"))


def source_hits(lines: DataFrame, rules: Sequence[r.Rule] = r.SOURCE) -> DataFrame:
    """Raw hits on target, path, lang, line_no, line."""
    return match_rules(lines, "line", rules, lang="lang")


def scan_source(lines: DataFrame, rules: Sequence[r.Rule] = r.SOURCE) -> DataFrame:
    """Hits on lines that aren't comments, without excluded, placeholder and self-assigned ones."""
    line = F.col("line")
    hits = source_hits(lines.where(~is_comment(line, F.col("lang"))), rules)
    hits = hits.where(~excluded(line, rules) & ~placeholder_secret(line, rules) & ~self_assigned_secret(line, rules))
    quoted = trim_space(line)
    return hits.select("target", F.lit("source").alias("detector"), "rule", temp_severity(line).alias("severity"), "confidence", render(F.col("template"), truncate(quoted, LINE_CUT)).alias("message"), F.col("path").alias("file"), F.col("line_no").alias("line"), _null().alias("tool"), "cwe", quoted.alias("quoted"))


def scan_secrets(rows: DataFrame, text: str = "text") -> DataFrame:
    """The credential rules alone, over any text column; the input's columns stay."""
    return match_rules(rows, text, r.CREDENTIALS)


def detect_egress(lines: DataFrame) -> DataFrame:
    """Outbound calls: target, path, line_no, method; comments count."""
    return match_rules(lines, "line", r.EGRESS, lang="lang").select("target", "path", "line_no", call_method().alias("method"))


def call_method(first: int = 0) -> Column:
    """The method of an egress hit, ``first`` being the place of the first egress rule; two of the patterns capture it."""
    capture = _null()
    for i, rule in enumerate(r.EGRESS):
        if "%s" in rule.message:
            capture = F.when(F.col(ORD) == first + i, F.regexp_extract("line", rule.java, 1)).otherwise(capture)
    return F.when(F.contains("template", F.lit("%s")), render(F.col("template"), capture)).otherwise(F.col("template"))


def egress_findings(calls: DataFrame) -> DataFrame:
    message = F.concat(F.lit(EGRESS_MESSAGE), "method")
    return calls.select("target", F.lit("egress").alias("detector"), F.lit("mcp-network-egress").alias("rule"), F.lit(c.WARNING).alias("severity"), F.lit(c.UNSET).alias("confidence"), message.alias("message"), F.col("path").alias("file"), F.col("line_no").alias("line"), _null().alias("tool"), _null().alias("cwe"), F.col("method").alias("quoted"))


def scan_descriptions(tools: DataFrame, rules: Sequence[r.Rule] = r.DESCRIPTIONS) -> DataFrame:
    """Prompt-injection rules on tool descriptions; the message quotes the match."""
    hits = match_rules(tools.select("target", "tool_name", "description"), "description", rules)
    quoted = matched_text(F.col("description"), rules)
    return hits.select("target", F.lit("description").alias("detector"), "rule", "severity", "confidence", render(F.col("template"), truncate(quoted, LINE_CUT)).alias("message"), _null().alias("file"), _null("int").alias("line"), F.col("tool_name").alias("tool"), "cwe", quoted.alias("quoted"))


def invisible_count(text: Column, ranges: Sequence[tuple[int, int]] = tuple(c.INVISIBLE_RANGES)) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r.code_points(ranges))), F.lit(0))


def scan_invisible(rows: DataFrame, text: str = "description") -> DataFrame:
    """Two rules: any invisible code point, and any of the tag block; with their counts."""
    counted = rows.withColumn("invisible", invisible_count(F.col(text))).withColumn("tags", invisible_count(F.col(text), [c.TAG_BLOCK])).where("invisible > 0")
    found = F.array_compact(F.array(F.lit("mcp-unicode-injection"), F.when(F.col("tags") > 0, "mcp-unicode-tags-block")))
    return counted.select("*", F.explode(found).alias("rule"))


_OBJECT = "map<string,variant>"


def schema_descriptions(schema: Column, depth: int = 20) -> Column:
    """All ``description`` strings of a JSON schema, in its objects and in objects that arrays hold, down to ``depth`` objects below the root.

    A walk of the VARIANT, a level at a time: an object's members that are
    objects, and the objects among the items of those that are arrays, are the
    next level.  Arrays are no level of their own; arrays in arrays aren't entered.
    """
    as_object = lambda v: F.try_variant_get(v, "$", _OBJECT)

    def below(value: Column) -> Column:
        items = F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), as_object), lambda x: x.isNotNull())
        return bound(as_object(value), lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(F.coalesce(items, F.array().cast(f"array<{_OBJECT}>"))))

    def step(walk: Column, _: Column) -> Column:
        named = F.filter(F.transform(walk["open"], lambda x: F.try_element_at(x, F.lit("description"))), lambda v: F.schema_of_variant(v) == "STRING")
        found = F.concat(walk["found"], F.transform(named, lambda v: F.try_variant_get(v, "$", "string")))
        return F.struct(found.alias("found"), F.flatten(F.transform(walk["open"], lambda x: F.flatten(F.transform(F.map_values(x), below)))).alias("open"))

    root = F.filter(F.array(as_object(F.try_parse_json(schema))), lambda x: x.isNotNull())
    start = F.struct(F.array().cast("array<string>").alias("found"), root.alias("open"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(depth)), start, step, lambda walk: walk["found"])


def nested_descriptions(tools: DataFrame, depth: int = 20) -> DataFrame:
    """target, snapshot, tool_name, description: a row for each description in a tool's JSON schema."""
    return tools.select("target", "snapshot", "tool_name", F.explode(schema_descriptions(F.col("input_schema"), depth)).alias("description"))


def scan_description_texts(texts: DataFrame, rules: Sequence[r.Rule] = r.DESCRIPTIONS) -> DataFrame:
    """Findings of the prompt-injection and the invisible-character rules in one pass over texts (target, tool_name, description, prefix of their messages); columns beside these stay."""
    rest = [x for x in texts.columns if x not in ("target", "tool_name", "description", "prefix")]
    every = (*rules, *r.INVISIBLE)
    hits = match_rules(texts, "description", every)
    counted = F.concat(F.lit(INVISIBLE_MESSAGE[0]), invisible_count(F.col("description")).cast("string"), F.lit(INVISIBLE_MESSAGE[1]))
    quoted = matched_text(F.col("description"), rules)
    message = F.when(F.col(ORD) == len(rules), counted).otherwise(render(F.col("template"), truncate(F.coalesce(quoted, F.lit("")), LINE_CUT)))
    return hits.select(*rest, "target", F.lit("description").alias("detector"), "rule", "severity", "confidence", F.concat("prefix", message).alias("message"), _null().alias("file"), _null("int").alias("line"), F.col("tool_name").alias("tool"), "cwe")


def scan_nested(tools: DataFrame, rules: Sequence[r.Rule] = r.DESCRIPTIONS) -> DataFrame:
    """``scan_description_texts`` on nested descriptions; messages carry a prefix."""
    return scan_description_texts(nested_descriptions(tools).withColumn("prefix", F.lit(NESTED_PREFIX)), rules)


def string_arguments(calls: DataFrame) -> DataFrame:
    """Call arguments (JSON objects) as rows, strings only: target, tool_name, arg, value."""
    return calls.select("target", "tool_name", F.explode(F.from_json("args", "map<string,variant>")).alias("arg", "v")).where(F.schema_of_variant("v") == "STRING").select("target", "tool_name", "arg", F.try_variant_get("v", "$", "string").alias("value"))


def scan_arguments(arguments: DataFrame) -> DataFrame:
    """Injection rules on argument values; ``tool`` is the argument's name and the message quotes the whole value."""
    hits = match_rules(arguments, "value", r.ARGUMENTS)
    return hits.select("target", F.lit("argument").alias("detector"), "rule", "severity", "confidence", render(F.col("template"), truncate(F.col("value"), ARGUMENT_CUT)).alias("message"), _null().alias("file"), _null("int").alias("line"), F.col("arg").alias("tool"), "cwe", F.col("value").alias("quoted"))


def scan_responses(responses: DataFrame) -> DataFrame:
    """Data-leak rules on responses; messages are fixed."""
    hits = match_rules(responses.select("target", "tool_name", "text"), "text", r.RESPONSES)
    return hits.select("target", F.lit("response").alias("detector"), "rule", "severity", "confidence", F.col("template").alias("message"), _null().alias("file"), _null("int").alias("line"), F.col("tool_name").alias("tool"), "cwe", _null().alias("quoted"))


def risk_tier(description: Column) -> Column:
    """The first tier with a keyword that the lower-cased text contains; 0 without any."""
    text = F.lower(F.coalesce(description, F.lit("")))
    tier = F.lit(0)
    for level, words in reversed(c.TIER_KEYWORDS):
        has = F.lit(False)
        for w in words:
            has = has | F.contains(text, F.lit(w))
        tier = F.when(has, level).otherwise(tier)
    return tier


def exposure_findings(classified: DataFrame) -> DataFrame:
    """Tools of tier HIGH or CRITICAL, one severity below their tier."""
    message = F.concat(F.lit("Tool "), in_quotes(F.col("tool_name")), F.lit(" exposes "), tier_label(F.col("tier")), F.lit("-risk capabilities"))
    return classified.where("tier >= 2").select("target", F.lit("exposure").alias("detector"), F.lit("mcp-sensitive-exposure").alias("rule"), (F.col("tier") - 1).alias("severity"), F.lit(c.UNSET).alias("confidence"), message.alias("message"), F.col("tool_name").alias("tool"))
