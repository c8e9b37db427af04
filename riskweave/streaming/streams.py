"""The detectors on streams: the batch functions over ``readStream``, drained to a table.

Sink and checkpoint lie in folders that the caller names on shared storage.  The
transformations keep no state, so they hold for any rate and need no watermark.
``pin_check`` joins a static baseline; what only full listings can tell (removed
tools) is told by ``check_listings``, batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskweave.operators import detect, network, pins


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Run what is there through the stream, and return the table it has written.

    The sink's own log makes each batch count once; a second run goes on from the
    checkpoint with what has come since.
    """
    query = stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files of a table; a single file is watched by its name.  A batch takes ``files_per_batch`` files at most, all without that."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    files = spark.readStream.schema(schema)
    files = files.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else files
    single = [f for f in spark.read.parquet(path).inputFiles() if f.rstrip("/").endswith(f"/{name}")]
    return files.option("pathGlobFilter", name).parquet(folder) if single else files.parquet(path)


def scan_arguments(calls: DataFrame) -> DataFrame:
    return detect.scan_arguments(detect.string_arguments(calls))


def scan_responses(responses: DataFrame) -> DataFrame:
    return detect.scan_responses(responses)


def classify_connections(lines: DataFrame) -> DataFrame:
    return network.classify(network.parse_trace(lines))


def pin_check(tools: DataFrame, baseline: DataFrame) -> DataFrame:
    """Every arriving tool against the static baseline: new, changed or unchanged."""
    now = tools.select("target", "tool_name", pins.fingerprint().alias("new_hash"))
    both = now.join(baseline.select("target", "tool_name", F.col("sha256").alias("old_hash")), ["target", "tool_name"], "left")
    state = F.when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return both.select("target", "tool_name", state.alias("state"))


def _check_batch(baseline: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, number: int) -> None:
        listed = batch.select("target").distinct()
        pinned = baseline.join(listed, "target", "left_semi")
        pins.diff(batch, pinned).select("target", "tool_name", "state", "old_hash", "new_hash").write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    return run


def check_listings(tools: DataFrame, baseline: DataFrame, path: str) -> DataFrame:
    """Run the listings that are there against the baseline, and return what all runs have found so far.

    A batch holds whole listings: all tools that a target has (as a source of one
    file for each listing gives them).  So of its targets it can tell new, changed,
    unchanged and removed tools.  Its result is a folder named by the batch: a
    batch that is run again after a failure replaces its own result, and each
    counts once.  A target that is listed again has its last listing's states.
    """
    query = tools.writeStream.foreachBatch(_check_batch(baseline, path)).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return states(tools.sparkSession, path)


def states(spark: SparkSession, path: str) -> DataFrame:
    """target, tool_name, state, old_hash, new_hash of the last listing of each target."""
    found = spark.read.schema("target string, tool_name string, state string, old_hash string, new_hash string, batch long").parquet(f"{path}/data")
    last = found.groupBy("target").agg(F.max("batch").alias("batch"))
    return found.join(last, ["target", "batch"]).select("target", "tool_name", "state", "old_hash", "new_hash")
