"""Rule matching: text rows against a rule table, one row per (text, pattern) hit.

The rules enter the plan as literals, so the match is a narrow transformation: no
join, no shuffle, every text is read once.  Each regular expression runs only where
its needles occur in the text.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from riskweave.functions.text import each
from riskweave.rules.needles import fold, guard
from riskweave.rules.ruleset import Rule

ORD = "rule_ord"
META = ["rule_id", "rule", "severity", "confidence", "cwe", "template"]


def rule_ords(text: str, rules: Sequence[Rule], lang: str | None = None, runs: Sequence[tuple[int, Column | None]] = ()) -> Column:
    """The places (in ``rules``) of the rules that match a text, as an array.

    With ``lang``, a rule applies to rows of its languages only.  ``runs`` cuts the
    list into runs of so many rules, each of which applies where its condition holds
    (None: everywhere), so that several families share one pass.
    """
    # The text and its folded form are bound once per row as a lambda variable; a
    # plain column would be recomputed for every needle once filters are pushed down.
    subject = F.struct(F.col(text).alias("text"), fold(F.col(text)).alias("folded"),
                       (F.col(lang) if lang else F.lit(None).cast("string")).alias("lang"),
                       *[F.coalesce(condition, F.lit(False)).alias(f"run{k}") for k, (_, condition) in enumerate(runs) if condition is not None])
    run_of = [f"run{k}" if condition is not None else None for k, (n, condition) in enumerate(runs) for _ in range(n)] or [None] * len(rules)

    # Rules of the same run and languages are one family, whose condition is tested once.
    families: dict[tuple, list[int]] = {}
    for i, (rule, run) in enumerate(zip(rules, run_of, strict=True)):
        families.setdefault((run, tuple(rule.langs) if lang else ()), []).append(i)

    def matches(row):
        parts = []
        for (run, langs), own in families.items():
            found = F.array_compact(F.array(*[F.when(_condition(rules[i], row), F.lit(i)) for i in own]))
            applies = ([row[run]] if run else []) + ([row["lang"].isin(*langs)] if langs else [])
            parts.append(F.when(reduce(Column.__and__, applies), found).otherwise(F.array().cast("array<int>")) if applies else found)
        return parts[0] if len(parts) == 1 else F.flatten(F.array(*parts)) if parts else F.array().cast("array<int>")

    return F.flatten(F.transform(F.array(subject), matches))


def match_rules(df: DataFrame, text: str, rules: Sequence[Rule], lang: str | None = None, runs: Sequence[tuple[int, Column | None]] = ()) -> DataFrame:
    """Input columns plus ``rule_ord`` and the rule's columns, one row for each match (see ``rule_ords``).

    A text that holds a pattern several times still gives one row for it.
    """
    clash = sorted({ORD, *META} & set(df.columns))
    if clash:
        raise ValueError(f"rename the input's columns {clash}: hits add columns of these names")
    if not rules:
        return with_rule_columns(df.withColumn(ORD, F.lit(0)).where(F.lit(False)), rules)
    return with_rule_columns(each(df, rule_ords(text, rules, lang, runs), ORD), rules)


def _condition(rule: Rule, row: Column) -> Column:
    parts = []
    wanted = guard(rule.needles, row["text"], row["folded"])
    if wanted is not None:
        parts.append(wanted)
    found = row["text"].rlike(rule.java)
    if rule.linear:
        found = F.when(F.contains(row["text"], F.lit("\n")), found).otherwise(row["text"].rlike(rule.linear))
    parts.append(found)
    return reduce(Column.__and__, parts)


def with_rule_columns(hits: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Look the rule's columns up in a constant array."""
    def pick(values, type_):
        return F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{type_}>"), F.col(ORD))

    return hits.select(
        "*",
        pick([r.id for r in rules], "string").alias("rule_id"),
        pick([r.rule for r in rules], "string").alias("rule"),
        pick([r.severity for r in rules], "int").alias("severity"),
        pick([r.confidence for r in rules], "int").alias("confidence"),
        pick([r.cwe for r in rules], "string").alias("cwe"),
        pick([r.template for r in rules], "string").alias("template"))


def matched_text(text: Column, rules: Sequence[Rule], group: int = 0) -> Column:
    """What the hit's pattern (or one of its groups) matched in the text."""
    if not rules:
        return F.lit(None).cast("string")
    branches = [(F.col(ORD) == i, F.regexp_extract(text, r.java, group)) for i, r in enumerate(rules)]
    expr = F.when(*branches[0])
    for condition, value in branches[1:]:
        expr = expr.when(condition, value)
    return expr
