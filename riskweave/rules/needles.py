"""Literal strings a pattern cannot match without.

``contains`` on UTF-8 bytes is far cheaper than a regular expression, so every rule
is guarded by the literals that must occur in the text.  The guard is a necessary
condition only: it never changes which rows match.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from riskweave.rules.dialect import Needles, translate


def needles(pattern: str) -> tuple[Needles, ...]:
    """Sets of literals of an RE2 pattern; one word of each set must occur."""
    return translate(pattern).needles


def fold(text: Column) -> Column:
    """Lower case in which every character that case-insensitively equals an ASCII
    letter becomes that letter (long s is the one ``lower`` leaves alone)."""
    return F.lower(F.replace(text, F.lit("ſ"), F.lit("s")))


def guard(found: Sequence[Needles], text: Column, folded: Column) -> Column | None:
    """True where the text may match; None when every text may."""
    if not found:
        return None
    any_of = [reduce(Column.__or__, [F.contains(folded if n.folded else text, F.lit(w)) for w in n.words]) for n in found]
    return reduce(Column.__and__, any_of)
