"""Suppression of findings by ignore files and by marks in the source line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweave.functions.paths import base_name, glob_match, glob_to_regex
from riskweave.functions.text import trim_space

#: The mark that suppresses findings on its line; what follows it may name one rule.
MARKER = "risk:ignore"


def parse_ignore_lines(lines: DataFrame) -> DataFrame:
    """Columns of ``lines`` but line, and kind (rule, file_rule, glob), glob and rule; blank lines, comments and a bare ``!`` drop out."""
    rest = [x for x in lines.columns if x != "line"]
    rows = lines.select(*rest, trim_space(F.col("line")).alias("line")).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")) & (F.col("line") != "!"))
    last = r"(?s)^(.+):([^:/\\]+)\z"
    by_rule, both = F.startswith("line", F.lit("!")), F.col("line").rlike(last)
    kind = F.when(by_rule, "rule").when(both, "file_rule").otherwise("glob")
    rule = F.when(by_rule, F.substring("line", 2, 1 << 20)).when(both, F.regexp_extract("line", last, 2))
    glob = F.when(by_rule, None).when(both, F.regexp_extract("line", last, 1)).otherwise(F.col("line"))
    return rows.select(*rest, kind.alias("kind"), glob.alias("glob"), rule.alias("rule"))


_META = r"[*?\[\]\\]"


def glob_anchor(glob: Column) -> Column:
    """A token that every path under the glob has among its ``path_tokens``.

    The longest folder or file name that the glob spells out, else the extension
    of its last part, else how that part begins, else the token of all paths.
    """
    names = F.filter(F.split(glob, "/"), lambda x: (x != "") & ~x.rlike(_META))
    longest = F.get(F.sort_array(F.transform(names, lambda x: F.struct(F.length(x).alias("n"), x.alias("name"))), asc=False), F.lit(0))["name"]
    last = base_name(glob)
    ending, start = F.regexp_extract(last, r"\.([^.*?\[\]\\]+)\z", 1), F.regexp_extract(last, r"^[^*?\[\]\\]+", 0)
    return F.when(longest.isNotNull(), F.concat(F.lit("/"), longest)).when(ending != "", F.concat(F.lit("."), ending)).when(start != "", F.concat(F.lit("^"), F.left(start, F.lit(3)))).otherwise("")


def path_tokens(path: Column) -> Column:
    """What globs can be looked up by: names of a path's folders and its own, its extension, how its name begins, and the token of all paths."""
    base = base_name(path)
    names = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("/"), x))
    ending = F.when(F.contains(base, F.lit(".")), F.concat(F.lit("."), F.substring_index(base, ".", -1)))
    return F.array_distinct(F.array_compact(F.concat(names, F.array(ending, *[F.concat(F.lit("^"), F.left(base, F.lit(n))) for n in (1, 2, 3)], F.lit("")))))


def suppressed_by_rule(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """``findings`` with the column suppressed.

    Rules stay rows, however many a target has: names of rules meet those of
    findings by equality; globs are looked up by an anchor that their paths must
    have (``glob_anchor``), and only candidates are tested.  All of it is done on
    the distinct (target, file, rule) of ``findings``, which is read twice: hand
    in one that is written.
    """
    keys = findings.select("target", "file", "rule").distinct()
    named = rules.where("kind = 'rule'").select("target", "rule").distinct()
    globs = rules.where("kind <> 'rule'").select("target", "glob", F.col("rule").alias("only")).distinct().withColumn("token", glob_anchor(F.col("glob"))).withColumn("regex", glob_to_regex(F.col("glob")))
    files = keys.select("target", "file").distinct().where("file <> ''").withColumn("token", F.explode(path_tokens(F.col("file"))))
    fits = files.join(globs, ["target", "token"]).where(glob_match(F.col("file"), F.col("regex"))).select("target", "file", "only").distinct()
    by_glob = keys.join(fits, ["target", "file"]).where("only IS NULL OR only = rule").select("target", "file", "rule")
    hit = keys.join(named, ["target", "rule"]).select("target", "file", "rule").unionByName(by_glob).distinct()
    hit = hit.select(F.col("target").alias("_target"), F.col("file").alias("_file"), F.col("rule").alias("_rule"))
    same = (findings["target"] == hit["_target"]) & (findings["rule"] == hit["_rule"]) & findings["file"].eqNullSafe(hit["_file"])
    return findings.join(hit, same, "left").withColumn("suppressed", F.col("_target").isNotNull()).drop("_target", "_file", "_rule")


def inline_suppressed(line: Column, rule: Column, marker: str = MARKER) -> Column:
    """The line carries the marker, alone or with the rule's name as the first word after it."""
    at = F.instr(line, F.lit(marker))
    rest = trim_space(F.substring(line, at + len(marker), F.length(line)))
    first = F.regexp_extract(rest, r"^\S*", 0)
    return F.coalesce((at > 0) & ((rest == "") | (first == rule)), F.lit(False))
