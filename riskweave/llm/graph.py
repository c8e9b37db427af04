"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.storage import materialize


def components(links: DataFrame) -> DataFrame:
    """(key, label) for every key of ``links`` (a, b): the smallest key that it is linked to by any path.

    Each round every key takes the smallest label among its neighbours', then
    its label's label, so a chain of n links takes about log2(n) rounds.  Only
    the number of changed labels reaches the driver.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("near")).select("key", F.least("key", "near").alias("label")))
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        taken = materialize(labels.join(near, "key").select("key", F.least("label", "near").alias("new"), "label"))
        jump = taken.select(F.col("key").alias("new"), F.col("new").alias("further"))
        done = materialize(taken.join(jump, "new").select("key", F.least("new", "further").alias("label"), (F.least("new", "further") != F.col("label")).alias("moved")))
        labels = done.select("key", "label")
        if not done.where("moved").limit(1).count():
            return labels
