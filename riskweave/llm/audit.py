"""Operator 12, filter interaction audit by wide packed counters.

Each document becomes a mask of the filters that it fails.  Masks are counted by
part first, so what is left of a part is at most 32 masks times four kinds of
labels, however many documents it has.  Each of these maps to one big integer
whose fields hold the outcome of all 600 steps (five steps of 120 orders).  A
part's integers, times their counts, are summed, and the sum is unpacked.
"""

from __future__ import annotations

from functools import cache, reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.storage import materialize

#: White space between words, as a character class and as what words are made of.
BREAK, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, "[#$%&*|]"
FILTERS = "ABCDE"
ORDERS = ["".join(x) for x in permutations(FILTERS)]
#: Counters of a step; each has a field of 64 bits, which no count of a part's rows (a long) overflows.
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELD = 8
_SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{x} long" for x in OUTCOMES) + ", shapley long"


def failures(text: Column) -> Column:
    """The mask of the filters A to D (bits 0 to 3) that a text fails."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, BREAK), "")
    # Bound once, so that the words are split once for both sizes.
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    few = F.transform(F.array(sizes), lambda s: F.when(s["all"] < LEAST_WORDS, 1).otherwise(0) + F.when(100 * s["distinct"].cast("long") < LEAST_DISTINCT * s["all"].cast("long"), 2).otherwise(0))[0]
    capitals = (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("long")
    return few + F.when(100 * capitals > MOST_CAPITALS * F.length(text).cast("long"), 4).otherwise(0) + F.when(text.rlike(SYMBOLS), 8).otherwise(0)


def mask_counts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, mask, good, toxic, n): documents of each part by the filters they fail and by their labels.

    No join meets a hot key: equal rows are counted before they move, the first
    of equal texts are found by (text, id), and ids that repeat (or are null) are
    down to one row for each part and mask before they meet their labels.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.unhex(F.sha2(text, 256)).alias("key"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), failures(F.col(text_col)).alias("mask"),
    )
    rows = materialize(rows.groupBy("key", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n")))
    first = rows.where("id IS NOT NULL").groupBy("key").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    met = rows.join(first, ["key", "id"], "left").withColumn("mask", F.col("mask") + F.when(F.col("first").isNull() & F.col("id").isNotNull(), 16).otherwise(0))
    met = met.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    said = said.agg(F.max(F.coalesce(F.col(good_col) == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col(toxic_col) == 1, F.lit(False))).alias("toxic"))
    said = said.where("good OR toxic")
    known = met.join(said, "id", "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")
    return known.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


@cache
def packed(mask: int, good: bool, toxic: bool) -> int:
    """The big integer of a document: for each order, step and counter a field that is 1 where the document counts there."""
    fields = np.zeros((len(ORDERS), len(FILTERS), len(OUTCOMES)), "<u8")
    for o, order in enumerate(ORDERS):
        gone = False
        for s, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            fails = bool(mask & bit)
            removed = fails and not gone
            fields[o, s] = (not gone and not fails, removed, fails and gone, mask == bit, removed and good, removed and toxic)
            gone = gone or fails
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """Counts (orders x steps x counters) in the fields of a sum of ``packed`` integers."""
    size = len(ORDERS) * len(FILTERS) * len(OUTCOMES) * FIELD
    return np.frombuffer(total.to_bytes(size, "little"), "<u8").astype(np.int64).reshape(len(ORDERS), len(FILTERS), len(OUTCOMES))


def _steps(table: pa.Table) -> pa.Table:
    """A part's 600 rows, from its at most 128 counts."""
    rows = zip(*(table[c].to_pylist() for c in ("mask", "good", "toxic", "n")), strict=True)
    counts = unpacked(reduce(lambda total, r: total + packed(*r[:3]) * r[3], rows, 0))
    removed = {name: sum(int(counts[o, order.index(name), 1]) for o, order in enumerate(ORDERS)) for name in FILTERS}
    steps, n = len(FILTERS), len(ORDERS) * len(FILTERS)
    columns = [
        pa.array([table["part"][0].as_py()] * n, pa.string()), pa.array([x for x in ORDERS for _ in range(steps)], pa.string()), pa.array(list(range(1, steps + 1)) * len(ORDERS), pa.int32()),
        *[pa.array(counts[:, :, k].ravel(), pa.int64()) for k in range(len(OUTCOMES))], pa.array([removed[name] for order in ORDERS for name in order], pa.int64()),
    ]
    return pa.Table.from_arrays(columns, names=["part", "filter_order", "step", *OUTCOMES, "shapley"])


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """What each filter does at each place of each order of the five filters, for each part of ``docs``.

    Returns 600 rows for each part (each language; null and empty are one part):
    part, filter_order, step, and as longs kept, removed, redundant,
    unique_fails, good_lost, toxic_lost and shapley (the removals of the step's
    filter summed over all orders; divided by 120, its Shapley value).

    A null text is the empty text, which fails A only.  A null id is smaller than
    none and equal to none: its row fails E never, and makes no other row fail
    it.  Of rows that repeat id and text none is a copy of the other.  An id with
    several labels is good or toxic if one of them says so; labels other than 1,
    null labels and missing rows say nothing.  An empty table gives an empty
    result.  Other columns are ignored, whatever their names.
    """
    return mask_counts(docs, labels, **columns).groupBy("part").applyInArrow(_steps, _SCHEMA)
