"""Numbering all rows of a table in order, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.storage import materialize


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with ``name``: 0 for the first row in ``order``, 1 for the next, ...

    Rows are dealt out by ranges of ``order``; each range is numbered for itself
    and shifted by the rows of the ranges before it (one row for each range).
    """
    ranges = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranges.withColumn(name, within.cast("long")).join(before, "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
