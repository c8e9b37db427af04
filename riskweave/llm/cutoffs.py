"""Operator 13, quality rules with risk-controlled thresholds.

Every text is measured once.  A rule is a ratio of two measures and a ladder of
cutoffs, from lenient to strict.  For each stratum (language) one half of the
labelled texts, the guide, orders all (rule, cutoff) steps by how well they tell
bad from good; the steps taken in this order are nested filters, each stricter
than the last.  The other half, the holdout, tests them one after another: the
exact binomial bound on the share of good texts that are rejected must stay
within RISK.  The first step that fails ends the sequence (fixed-sequence testing
needs no correction within a stratum); strata share the error level (Bonferroni).
So with probability 1 - LEVEL no stratum's cutoffs reject more than RISK of its
good texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.storage import materialize
from riskweave.llm.words import slices, split_arrow

WINDOW = 5
SYMBOLS, CAPITALS, MARKS = r"[#*$%&|<>]", r"[A-Z]", r"[.,;:!?]"
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Share of good texts that a stratum's cutoffs may reject, and the probability that any stratum exceeds it.
RISK, LEVEL = 0.02, 0.05
#: A step is worth taking if it rejects bad texts of the guide at so many times the rate of good ones.
LEAST_GAIN = 2.0
SLICE_BYTES = 2 << 20
#: Strata are broadcast up to this number (under 100 MB), joined by a shuffle beyond it.
MOST_STRATA = 100_000


@dataclass(frozen=True)
class Rule:
    """Rejects texts with ``over`` > cutoff * ``base``, or ``over`` < cutoff * ``base`` where ``less``."""

    name: str
    over: str
    base: str
    cutoffs: tuple[float, ...]
    less: bool = False


RULES = (
    Rule("symbols", "n_symbols", "word_chars", (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)),
    Rule("duplicate lines", "n_dup_lines", "n_lines", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1)),
    Rule("repeated words", "n_repeat_words", "n_words", (0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)),
    Rule("capitals", "n_capitals", "word_chars", (0.8, 0.6, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    Rule("marks", "n_marks", "n_words", (3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.4, 0.3)),
    Rule("long words", "word_chars", "n_words", (40.0, 25.0, 18.0, 14.0, 12.0, 10.0, 9.0)),
    Rule("short words", "word_chars", "n_words", (1.5, 2.0, 2.5, 3.0, 3.5, 4.0), less=True),
    Rule("few distinct words", "n_distinct", "n_words", (0.02, 0.05, 0.1, 0.15, 0.2, 0.3), less=True),
)
STEPS = [(r, c) for r, rule in enumerate(RULES) for c in range(len(rule.cutoffs))]
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = (*BASE, "n_lines", "n_distinct", "n_capitals", "n_marks")


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each pair, equal for equal pairs and less than the number of pairs."""
    if not len(left):
        return left
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]


def repeated_words(at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text, its words that lie in a window of five words found twice or more in it; ``at`` numbers the words."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.flatnonzero(np.arange(len(at)) + WINDOW <= np.repeat(bounds[1:], np.diff(bounds)))
    out = np.zeros(len(bounds) - 1, np.int64)
    if not len(starts):
        return out
    two = _pairs(at[:-1], at[1:])
    four = _pairs(two[starts], two[starts + 2])
    window = _pairs(_pairs(four, at[starts + 4]), doc[starts])
    again = starts[np.bincount(window)[window] > 1]
    cover = np.zeros(len(at) + 1, np.int64)  # +1 where a repeated window begins, -1 behind its end
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    inside = np.cumsum(cover[:-1]) > 0
    return np.bincount(doc[inside], minlength=len(out))


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text, its lines that hold a word, and how many of them are equal to an earlier line."""
    lists = pc.split_pattern(texts, "\n")
    doc = pc.list_parent_indices(lists).to_numpy()
    coded = pc.list_flatten(lists).dictionary_encode()
    line = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(pc.ascii_trim_whitespace(coded.dictionary), "").to_numpy(zero_copy_only=False)[line]
    doc, line = doc[full], line[full]
    width = max(len(coded.dictionary), 1)
    distinct = np.bincount(np.unique(doc * width + line) // width, minlength=len(texts))
    n = np.bincount(doc, minlength=len(texts))
    return n, n - distinct


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    words, at, bounds = split_arrow(texts)
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(texts)), sizes)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(len(words), 1)
    count = lambda pattern: pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)
    lines, dup = _lines(texts)
    return {
        "n_words": sizes, "word_chars": np.bincount(doc, weights=chars[at], minlength=len(texts)).astype(np.int64), "n_symbols": count(SYMBOLS), "n_dup_lines": dup, "n_repeat_words": repeated_words(at, bounds),
        "n_lines": lines, "n_distinct": np.bincount(np.unique(doc * width + at) // width, minlength=len(texts)), "n_capitals": count(CAPITALS), "n_marks": count(MARKS),
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in slices(batch.column(3), SLICE_BYTES):
            found = measure(texts)
            own = [batch.column(k).slice(first, len(texts)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(found[m], pa.int64()) for m in MEASURES]], names=["doc_id", "stratum", "key", *MEASURES])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def binomial_tail(k: int, n: int, p: float) -> float:
    """The probability of at most ``k`` of ``n`` at rate ``p``, exactly (by the incomplete beta function, so that ``n`` may be large)."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    log = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(log) * _beta_fraction(a, b, x) / a
    return 1 - math.exp(log) * _beta_fraction(b, a, p) / b


def upper_bound(k: int, n: int, level: float) -> float:
    """The exact (Clopper-Pearson) upper bound on the rate behind ``k`` of ``n``, wrong with probability ``level`` at most."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if binomial_tail(k, n, middle) > level else (low, middle)
    return high


def fails(rule: Rule, cutoff: float) -> Column:
    over, limit = F.col(rule.over).cast("double"), F.lit(cutoff) * F.col(rule.base).cast("double")
    return over < limit if rule.less else over > limit


def strictness() -> Column:
    """For each rule, how many of its cutoffs a text fails: as ladders are sorted, these are the strictest ones."""
    return F.array(*[sum((fails(rule, c).cast("int") for c in reversed(rule.cutoffs)), F.lit(0)) for rule in RULES])


def _level(rule: int) -> Column:
    return F.get("levels", F.lit(rule))


def _ordered(table: pa.Table) -> pa.Table:
    """A stratum's steps in the order of their gain: for each rule and number of failed cutoffs, the place of the first step that rejects (0 where none does)."""
    rows = {r["good"]: r for r in table.to_pylist()}
    good, bad = rows.get(True, {"n": 0}), rows.get(False, {"n": 0})
    ranked = []
    for r, c in STEPS:
        hits = bad.get(f"_{r}_{c}", 0)
        # One more hit among the good, so that a few texts prove little.
        gain = (hits / bad["n"]) / ((good.get(f"_{r}_{c}", 0) + 1) / (good["n"] + 1)) if hits else 0.0
        if gain >= LEAST_GAIN:
            ranked.append((-gain, r, c))
    place = {(r, c): i + 1 for i, (_, r, c) in enumerate(sorted(ranked))}
    first = [[min((place[r, c] for c in range(len(rule.cutoffs)) if (r, c) in place and len(rule.cutoffs) - c <= failed), default=0) for failed in range(len(rule.cutoffs) + 1)] for r, rule in enumerate(RULES)]
    return pa.table({"stratum": table["stratum"].slice(0, 1), "first": pa.array([first], pa.list_(pa.list_(pa.int32()))), "steps": pa.array([len(place)], pa.int32())})


def _place() -> Column:
    """The place of the first step that rejects a text, by its ``levels`` and its stratum's ``first``; null where none does."""
    places = [F.get(F.get("first", F.lit(r)), _level(r)) for r in range(len(RULES))]
    return F.least(*[F.when(p > 0, p) for p in places])


def _certified(level: float, risk: float):
    """How many steps of a stratum's sequence pass, from its good holdout texts by the place that rejects them (null: none)."""

    def run(table: pa.Table) -> pa.Table:
        counts = {r["place"]: r["n"] for r in table.to_pylist()}
        n, steps = sum(counts.values()), table["steps"][0].as_py()
        rejected, passed = 0, 0
        for step in range(1, steps + 1):
            rejected += counts.get(step, 0)
            if binomial_tail(rejected, n, risk) > level:
                break
            passed = step
        return pa.table({"stratum": table["stratum"].slice(0, 1), "passed": pa.array([passed], pa.int32())})

    return run


def choose(texts: DataFrame, *, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, first, passed): each stratum's steps and how many of them are certified.

    ``texts`` holds each labelled text once: stratum (not null), good, guide and
    levels.  A stratum's counts are one row for each label or step.
    """
    hits = [F.sum((F.lit(len(RULES[r].cutoffs) - c) <= _level(r)).cast("long")).alias(f"_{r}_{c}") for r, c in STEPS]
    guide = texts.where("guide").groupBy("stratum", "good").agg(F.count(F.lit(1)).alias("n"), *hits)
    paths = materialize(guide.groupBy("stratum").applyInArrow(_ordered, "stratum string, first array<array<int>>, steps int"))
    held = texts.where("good AND NOT guide").join(small(paths), "stratum")
    counts = materialize(held.groupBy("stratum", "steps", _place().alias("place")).agg(F.count(F.lit(1)).alias("n")))
    strata = counts.select("stratum").distinct().count()
    passed = counts.groupBy("stratum").applyInArrow(_certified(level / max(strata, 1), risk), "stratum string, passed int")
    return materialize(paths.join(passed, "stratum").select("stratum", "first", "passed"))


def small(rows: DataFrame) -> DataFrame:
    """Rows of strata (under 1 KB each), broadcast up to a checked number."""
    return F.broadcast(rows) if rows.limit(MOST_STRATA + 1).count() <= MOST_STRATA else rows


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Which documents pass the base rules and the certified cutoffs of their stratum.

    Returns one row for each row of ``docs``: doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and rule (the name
    of the rule whose step rejects first; null where none does).

    Labelled are ids whose labels (0 or 1; others and null say nothing) agree;
    a text that several of them have counts once in its stratum, as good if one
    of them is, so that copies are no independent evidence.  Texts that fail the
    base rules neither guide nor test.  A stratum without enough labelled good
    texts to certify anything at ``risk`` rejects by the base rules only, as do
    all without labels.  The null stratum is one of its own, apart from the empty
    one.  A null text is the empty text and has no words.  A null id has no
    label.  Repeated rows are judged each for itself, alike.  An empty table gives
    an empty result.  Other columns are ignored, whatever their names.
    """
    # Strata carry a sign before their name, so that null has a name too.
    stratum = F.when(F.col(stratum_col).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(stratum_col).cast("string")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), stratum.alias("stratum"), F.md5(text).alias("key"), text.alias("text"))
    measured = rows.mapInArrow(_measured, "doc_id long, stratum string, key string, " + ", ".join(f"{m} long" for m in MEASURES))
    n_words = F.col("n_words")
    failed = (n_words < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n_words)
    measured = materialize(measured.withColumn("base_failed", failed).withColumn("levels", strictness()))
    said = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    said = said.agg(F.min(label_col).alias("least"), F.max(label_col).alias("most")).where("least = most").select("doc_id", (F.col("most") == 1).alias("good"))
    labelled = measured.where("NOT base_failed AND doc_id IS NOT NULL").groupBy("doc_id", "stratum", "key").agg(F.first("levels").alias("levels")).join(said, "doc_id")
    texts = materialize(labelled.groupBy("stratum", "key").agg(F.max("good").alias("good"), F.first("levels").alias("levels")).select("stratum", "good", (F.col("key") < "8").alias("guide"), "levels"))
    judged = measured.join(small(choose(texts, risk=risk, level=level)), "stratum", "left").withColumn("place", _place())
    rejected = ~F.col("base_failed") & F.coalesce(F.col("place") <= F.col("passed"), F.lit(False))
    names = F.coalesce(*[F.when(F.get(F.get("first", F.lit(r)), _level(r)) == F.col("place"), rule.name) for r, rule in enumerate(RULES)])
    return judged.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"), F.when(rejected, names).alias("rule"))
