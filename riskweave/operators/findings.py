"""The algebra of findings: filters, unions, roll-ups and report order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskweave.functions.labels import SEVERITIES, confidence_level, severity_level

# Category by the beginning of a rule's name, first match wins.
CATEGORIES = [
    ("source", ("mcp-cmd-", "mcp-code-", "mcp-path-traversal-risk")),
    ("hook", ("mcp-install-hook-",)),
    ("description", ("mcp-tool-", "mcp-sensitive-path", "mcp-secrecy", "mcp-prompt-", "mcp-exfiltration", "mcp-credential-access", "mcp-unicode")),
    ("credential", ("mcp-hardcoded",)),
]
TOP_CWES = 10


def filter_confidence(findings: DataFrame, word: str) -> DataFrame:
    """At least the named confidence; unset (0) passes only the lowest, which keeps all."""
    least = confidence_level(word)
    return findings if least <= 1 else findings.where(F.col("confidence") >= least)


def filter_severity(findings: DataFrame, word: str) -> DataFrame:
    return findings.where(F.col("severity") >= severity_level(word))


def select_detectors(findings: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Without the detectors that are skipped."""
    return findings.where(~F.col("detector").isin(*skip)) if skip else findings


def union_findings(*parts: DataFrame) -> DataFrame:
    """All rows of all detectors, repeated ones too."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def tag_with_server(findings: DataFrame, server: str = "target") -> DataFrame:
    return findings.withColumn("tool", F.coalesce(F.nullif("tool", F.lit("")), F.col(server)))


def _by_severity() -> list[Column]:
    return [F.count_if(F.col("severity") == i).alias(name.lower()) for i, name in enumerate(SEVERITIES)]


def severity_summary(findings: DataFrame, key: str = "target") -> DataFrame:
    """Findings by severity, for each ``key`` and, where it is null, overall."""
    return findings.rollup(key).agg(*_by_severity(), F.count(F.lit(1)).alias("total"))


def verdict(findings: DataFrame, key: str = "target") -> DataFrame:
    worst = F.max("severity")
    return findings.groupBy(key).agg(F.when(worst >= 2, "NOT SAFE").when(worst == 1, "REVIEW").otherwise("OK").alias("verdict"))


def fail_gate(findings: DataFrame, word: str, key: str = "target") -> DataFrame:
    return findings.groupBy(key).agg(F.bool_or(F.col("severity") >= severity_level(word)).alias("failed"))


def category(rule: Column) -> Column:
    out = F.lit("other")
    for name, starts in reversed(CATEGORIES):
        hit = reduce(Column.__or__, [F.startswith(rule, F.lit(s)) for s in starts])
        out = F.when(hit, name).otherwise(out)
    return out


def category_breakdown(findings: DataFrame) -> DataFrame:
    return findings.groupBy(category(F.col("rule")).alias("category")).agg(F.count(F.lit(1)).alias("findings"))


def cwe_counts(findings: DataFrame) -> DataFrame:
    return findings.where(F.coalesce("cwe", F.lit("")) != "").groupBy("cwe").agg(F.count(F.lit(1)).alias("findings"))


def top_cwes(findings: DataFrame, n: int = TOP_CWES) -> DataFrame:
    return cwe_counts(findings).orderBy(F.desc("findings"), "cwe").limit(n)


def report_order(findings: DataFrame) -> DataFrame:
    """Highest severity first; rule, file and line decide ties."""
    return findings.orderBy(F.desc("severity"), "rule", "file", "line")


def first_match(hits: DataFrame, keys: Sequence[str], order: str = "rule_ord") -> DataFrame:
    """The hit that comes first in the list of rules, for each key."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def target_status(targets: DataFrame, findings: DataFrame, failures: DataFrame, word: str = "high") -> DataFrame:
    """Status of every target: TIMEOUT, FAIL, FINDINGS (the gate is hit), OK with n findings, OK clean."""
    found = findings.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("severity") >= severity_level(word)).alias("gate"))
    rows = targets.select("target").join(failures.select("target", "reason"), "target", "left").join(found, "target", "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(F.col("reason") == "timeout", "TIMEOUT").when(F.col("reason").isNotNull(), "FAIL").when(F.coalesce("gate", F.lit(False)), "FINDINGS").when(n > 0, F.concat(F.lit("OK "), n.cast("string"), F.lit(" findings"))).otherwise("OK clean")
    return rows.select("target", n.alias("findings"), status.alias("status"))


def counts(findings: DataFrame) -> DataFrame:
    """One row: findings, by severity, with_findings (targets) and by_cwe (a map), from one aggregation by grouping sets."""
    sets = findings.select("target", "severity", F.coalesce("cwe", F.lit("")).alias("cwe")).groupingSets([[], ["severity"], ["cwe"], ["target"]], "target", "severity", "cwe")
    rows = sets.agg(F.grouping("target").alias("all_targets"), F.grouping("severity").alias("all_severities"), F.grouping("cwe").alias("all_cwes"), F.count(F.lit(1)).alias("n"))
    by = lambda name: F.col(f"all_{name}") == 0
    whole = ~by("targets") & ~by("severities") & ~by("cwes")
    cwe = F.collect_list(F.when(by("cwes") & (F.col("cwe") != ""), F.struct("cwe", "n")))  # the weakness classes of the rules
    return rows.agg(
        F.coalesce(F.max(F.when(whole, F.col("n"))), F.lit(0)).alias("findings"),
        *[F.coalesce(F.max(F.when(by("severities") & (F.col("severity") == i), F.col("n"))), F.lit(0)).alias(s.lower()) for i, s in enumerate(SEVERITIES)],
        F.count_if(by("targets")).alias("with_findings"), F.map_from_entries(F.array_sort(cwe)).alias("by_cwe"),
    )


def sweep_summary(targets: DataFrame, findings: DataFrame, failures: DataFrame) -> DataFrame:
    """One row for a run over many targets; findings of targets that failed, or that aren't listed, don't count."""
    rows = targets.select("target").join(failures.select("target", "reason"), "target", "left")
    status = rows.agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("reason").isNull()).alias("scanned"), F.count("reason").alias("failed"), F.count_if(F.col("reason") == "timeout").alias("timeouts"))
    found = counts(findings.join(rows.where("reason IS NULL"), "target", "left_semi"))
    both = status.crossJoin(found)  # one row each
    return both.withColumn("clean", F.col("scanned") - F.col("with_findings"))


def label_findings(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    return findings.join(verdicts, ["target", "rule", "file"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("UNREVIEWED")))


def precision_report(labelled: DataFrame) -> DataFrame:
    """Counts and shares of true, false and noisy findings, for each rule and, where it is null, overall."""
    n = F.count(F.lit(1))
    of = lambda v: F.count_if(F.col("verdict") == v)
    return labelled.rollup("rule").agg(of("TP").alias("tp"), of("FP").alias("fp"), of("NOISE").alias("noise"), n.alias("total"), (of("FP") / n).alias("fp_share"), (of("NOISE") / n).alias("noise_share"))


def expected_detection(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """A case is detected if every rule that it expects was found in its target."""
    found = findings.select("target", "rule").distinct().withColumn("hit", F.lit(True))
    return expected.join(found, ["target", "rule"], "left").groupBy("case_id").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("detected"))


def detection_rate(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count_if("detected").alias("detected"), F.count(F.lit(1)).alias("total"), (F.count_if("detected") * 100.0 / F.count(F.lit(1))).alias("rate"))


def coverage_by_group(groups: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings and distinct rules of each group of targets; groups without any stay."""
    return groups.join(findings.select("target", "rule"), "target", "left").groupBy("group").agg(F.count("rule").alias("findings"), F.count_distinct("rule").alias("rules"))


def split_suppressed(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed) of rows with the column suppressed."""
    return flagged.where("NOT suppressed"), flagged.where("suppressed")
