"""Operator 2, mixing sources to target weights along a curriculum.

Every source has a share of the training words and a weight schedule over
training time.  The integral of the schedule, scaled to the source's target, is
its cumulative demand; a document that stands ``c`` words into its source's own
order is due when the demand reaches ``c``.  Documents are sorted by that time.
Everything is built-in column functions; no task ever holds a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.ranks import ranked
from riskweave.llm.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Weight of a source at equally spaced times from the start to the end of training, by the place of its weight.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
MOST_REPEATS = 3
#: A source's documents are dealt into this many buckets at most, with about this many rows where that suffices.
MOST_BUCKETS, BUCKET_ROWS = 1 << 16, 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``sizes`` (source, size) with rank, weight and target.

    Targets share the sum of sizes by weight; one that would pass ``most`` times
    its source's size stops there, and the rest is shared anew among the others.
    Only two sums of each sharing reach the driver.
    """
    known = materialize(
        ranked(sizes, [F.col("source").asc_nulls_last()]).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    )
    limit = F.lit(float(most)) * F.col("size")
    total, share = known.agg(F.sum("size"), F.sum("weight")).first()
    level, seen = (total or 0) / share if share else 0.0, None
    while level != seen:
        full = F.col("weight") * F.lit(level) > limit
        fixed, share = known.agg(F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        seen, level = level, max(level, ((total or 0) - fixed) / share) if share else level
    return known.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def due(words: Column, target: Column, schedule: Column) -> Column:
    """The time from 0 to 1 at which a piecewise linear ``schedule``, integrated and scaled to ``target``, has asked for ``words``."""
    steps = F.size(schedule) - 1
    area = F.transform(F.sequence(F.lit(0), steps - 1), lambda i: F.struct(i.alias("i"), ((F.get(schedule, i) + F.get(schedule, i + 1)) / 2 / steps).alias("words")))
    whole = F.aggregate(area, F.lit(0.0), lambda a, x: a + x["words"])
    start = F.struct(F.lit(0).alias("i"), (F.least(words / target, F.lit(1.0)) * whole).alias("left"))
    at = F.aggregate(area, start, lambda a, x: F.when((a["i"] == x["i"]) & (a["left"] > x["words"]) & (x["i"] < steps - 1), F.struct((a["i"] + 1).alias("i"), (a["left"] - x["words"]).alias("left"))).otherwise(a))
    low, slope = F.get(schedule, at["i"]), (F.get(schedule, at["i"] + 1) - F.get(schedule, at["i"])) * steps
    root = F.sqrt(F.greatest(low * low + 2 * slope * at["left"], F.lit(0.0)))
    return F.least(at["i"] / steps + F.when(at["left"] > 0, 2 * at["left"] / (low + root)).otherwise(0.0), F.lit(1.0))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, schedules: tuple[tuple[float, ...], ...] = SCHEDULES, most: int = MOST_REPEATS, seed: str = "mix") -> DataFrame:
    """What the mix takes of every document, and when.

    Returns one row for each row of ``docs``: row (the input row as a struct),
    doc_id, size, source_size, target, taken (words, repeats counted), passes
    (times the source is taken whole), copies (whole documents, the last part
    rounded), before (words of the source that come earlier), position (time of
    the first copy, null where nothing is taken) and schedule.

    A source is taken whole as often as its target allows; the rest is the
    beginning of its order, a hash of seed and id, and the last document of that
    is taken in part.  Null and empty texts have size 0 and are never taken.  The
    null source is a source, sorted last.  Rows without an id stand in the order
    of a hash of their text, so that they spread like others.  Repeated rows count each for itself;
    which of two equal ones comes first cannot be told.  An empty table gives an
    empty result.  Other columns stay in ``row``, whatever their names.
    """
    n = docs.count()
    bits = max(0, min(int(math.log2(MOST_BUCKETS)), math.ceil(math.log2(max(1, n / BUCKET_ROWS)))))
    unnamed = F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), unnamed))), 1, 8), 16, 10).cast("long")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null")).alias("source_key"),
        word_count(F.col(text_col)).alias("size"),
        key.alias("key"),
    ).withColumn("bucket", F.shiftright("key", 32 - bits))
    sums = materialize(rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("size")))
    sources = targets(sums.groupBy("source_key").agg(F.sum("size").alias("size")).select("source_key", F.when(F.col("source_key") != "null", F.substring("source_key", 2, 1 << 30)).alias("source"), "size"), weights, most)
    schedule = F.element_at(F.array(*[F.array(*map(F.lit, s)) for s in schedules]), (F.col("rank") % len(schedules) + 1).cast("int"))
    offsets = sums.select("source_key", "bucket", (F.sum("size").over(Window.partitionBy("source_key").orderBy("bucket")) - F.col("size")).alias("bucket_before"))
    offsets = offsets.join(sources.select("source_key", F.col("size").alias("source_size"), "target", schedule.alias("schedule")), "source_key")
    own = Window.partitionBy("source_key", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - F.col("passes") * F.col("source_size") + 0.5).cast("long")
    return (
        rows.join(offsets, ["source_key", "bucket"])
        .withColumn("before", F.col("bucket_before") + F.sum("size").over(own) - F.col("size"))
        .withColumn("passes", passes)
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))))
        .withColumn("taken", F.col("passes") * F.col("size") + F.col("part"))
        .withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + F.when(F.col("part") * 2 >= F.col("size"), 1).otherwise(0)).otherwise(0))
        .withColumn("position", F.when(F.col("taken") > 0, due(F.col("before"), F.col("target"), F.col("schedule"))))
        .select("row", "doc_id", "size", "source_size", "target", "taken", "passes", "copies", "before", "position", "schedule")
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """The mixed documents' own rows, one for each copy, sorted by the time at which each copy is due."""
    copies = mixed.where("copies > 0").select("row", "doc_id", "source_size", "target", "before", "schedule", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1)).alias("turn"))
    at = due(F.col("turn") * F.col("source_size") + F.col("before"), F.col("target"), F.col("schedule"))
    return copies.orderBy(at, "doc_id", "turn").select("row.*")
