"""Rules that come as a table: thousands of patterns against many texts.

Rules as literals (``matching``) make a plan that grows with their number.  Here
the rules are rows.  A pattern's literals (see ``needles``) are indexed by a gram of
each, texts are split into their distinct grams, and an equi-join brings each text
together with the rules whose gram it has.  Only those are tested with their
regular expression.  The few rules without a literal are met by every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from riskweave.rules.dialect import to_java
from riskweave.rules.needles import fold, needles

#: Characters of a gram.
GRAM = 4
#: Index rows up to this number (about 100 MB) are broadcast; beyond it grams are joined by a shuffle, whose hot grams adaptive execution splits.
MOST_BROADCAST = 200_000
_INDEX = "rule_id string, java string, gram string, before array<string>"


def _grams(pattern: str) -> list[str]:
    """One gram for each literal of the set of literals of which a match must hold one; [""] where a match needs none that is long enough."""
    sets = [sorted({_folded(w) for w in n.words}) for n in needles(pattern)]
    sets = [s for s in sets if s and min(map(len, s)) >= GRAM]
    if not sets:
        return [""]
    best = max(sets, key=lambda s: (min(map(len, s)), -len(s)))
    # The last gram of a literal is seldom shared: literals begin alike more often than they end alike.
    return sorted({w[-GRAM:] for w in best})


def _folded(word: str) -> str:
    return word.replace("ſ", "s").lower()


def _indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for rule_id, pattern in zip(batch["rule_id"], batch["pattern"], strict=True):
            grams, java = _grams(pattern), to_java(pattern)
            rows += [(rule_id, java, g, grams[:i]) for i, g in enumerate(grams)]
        yield pd.DataFrame(rows, columns=["rule_id", "java", "gram", "before"])


def index_rules(rules: DataFrame) -> DataFrame:
    """Rows (rule_id, java, gram, before) for the distinct rules (rule_id, pattern): a rule has a row for each of its grams, before being those ahead of it."""
    return rules.select(F.col("rule_id").cast("string").alias("rule_id"), "pattern").where("rule_id IS NOT NULL AND pattern IS NOT NULL").distinct().mapInPandas(_indexed, _INDEX)


def text_grams(text: Column) -> Column:
    """The distinct grams of a text, folded, and the empty one, which all texts have."""
    folded = fold(text)
    places = F.sequence(F.lit(1), F.greatest(F.length(folded) - GRAM + 1, F.lit(1)))
    return F.array_union(F.array(F.lit("")), F.flatten(F.transform(F.array(folded), lambda x: F.transform(places, lambda i: F.substring(x, i, F.lit(GRAM))))))


def match_table(df: DataFrame, text: str, rules: DataFrame) -> DataFrame:
    """Columns of ``df`` and rule_id, one row for each (row, rule) whose pattern (RE2 syntax) occurs in the text.

    A null text matches nothing; a rule with a null id or pattern is none; rules
    that share an id and have different patterns are one rule each.  A text with
    several of a rule's grams is tested for the first of them only.
    """
    if "rule_id" in df.columns:
        raise ValueError("rename the input's column rule_id: hits add one of this name")
    index = index_rules(rules)
    small = index.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    rows = df.where(F.col(text).isNotNull()).select("*", F.explode(text_grams(F.col(text))).alias("gram"))
    met = rows.join(F.broadcast(index) if small else index, "gram")
    first = ~F.exists("before", lambda g: F.contains(fold(F.col(text)), g))
    return met.where(first & F.regexp_like(F.col(text), F.col("java"))).select(*df.columns, "rule_id")
