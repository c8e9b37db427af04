"""Fingerprints of tools, the pinned baseline and what has drifted from it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def canonical(schema: Column) -> Column:
    """JSON with its keys in order, whatever their order in the text; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(schema))


def fingerprint() -> Column:
    """SHA-256 over name, description and canonical input schema; title and other columns don't count."""
    return F.sha2(F.to_json(F.struct(F.col("tool_name").alias("name"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce(canonical(F.col("input_schema")), F.lit("")).alias("inputSchema"))), 256)


def pin_table(tools: DataFrame) -> DataFrame:
    """target, tool_name, sha256; of a repeated name one stays."""
    return tools.groupBy("target", "tool_name").agg(F.max(fingerprint()).alias("sha256"))


PIN = "target string, tool_name string, sha256 string"
#: Name of the file that names the snapshots, newest first, and how many of them stay.
POINTER, KEPT = "current", 2


def _snapshots(spark: SparkSession, path: str) -> list[str]:
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    if not pointer.getFileSystem(spark._jsc.hadoopConfiguration()).exists(pointer):
        return []
    return [r["value"] for r in spark.read.text(f"{path}/{POINTER}").collect() if r["value"]]  # at most KEPT lines


def write(tools: DataFrame, path: str) -> None:
    """The pins of ``tools`` as the baseline at ``path``, in place of the one before.

    Each baseline is a folder of its own; one small file names the current one and
    is replaced last, in one step.  So a baseline can be read while it is replaced
    (also by what is being written), and a write that fails leaves the old one.
    The one before the current stays for those who still read it.
    """
    spark, name = tools.sparkSession, f"snapshot-{uuid.uuid4().hex}"
    before = _snapshots(spark, path)
    pin_table(tools).write.parquet(f"{path}/{name}")
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    aside, pointer = hadoop.Path(f"{path}/{name}.pointer"), hadoop.Path(f"{path}/{POINTER}")
    files = pointer.getFileSystem(conf)
    stream = files.create(aside, True)
    stream.write(bytearray("\n".join([name, *before][:KEPT]).encode()))
    stream.close()
    replace = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    replace[0] = getattr(hadoop.Options, "Rename").OVERWRITE
    hadoop.FileContext.getFileContext(pointer.toUri(), conf).rename(aside, pointer, replace)
    for old in before[KEPT - 1 :]:
        files.delete(hadoop.Path(f"{path}/{old}"), True)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The current baseline (target, tool_name, sha256); empty where none was ever written."""
    found = _snapshots(spark, path)
    return spark.read.schema(PIN).parquet(f"{path}/{found[0]}") if found else spark.createDataFrame([], PIN)


def diff(tools: DataFrame, pins: DataFrame) -> DataFrame:
    """Every current tool and every pin: unchanged, changed, new or removed, with both hashes."""
    now = tools.select("target", "tool_name", fingerprint().alias("new_hash"))
    both = now.join(pins.select("target", "tool_name", F.col("sha256").alias("old_hash")), ["target", "tool_name"], "full")
    state = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    about = F.when(F.col("state") == "new", "New tool — not in pinned baseline").when(F.col("state") == "removed", "Tool removed from server").when(F.col("state") == "changed", "Tool description or schema changed — possible rug pull")
    return both.withColumn("state", state).withColumn("changed", F.col("state") != "unchanged").withColumn("description", about)


def changed(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("target").agg(F.bool_or("changed").alias("changed"))
