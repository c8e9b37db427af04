"""Readers of landed files and writers of results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweave import __version__
from riskweave.functions.labels import confidence_label, sarif_level


TOOL = "riskweave"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session may do without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        shared = f"file://{tempfile.mkdtemp(prefix='riskweave-')}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a scratch folder and read back, for what is read several times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result (JSON) for each finding; empty members are left out.  Results of a target are rows, so a large target is many tasks' work."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    properties = F.struct(text("cwe").alias("cwe"), F.when(F.col("confidence") != 0, confidence_label(F.col("confidence"))).alias("confidence"))
    region = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine")))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.when(text("file").isNotNull(), F.array(place)).alias("locations"),
        F.when(text("cwe").isNotNull() | (F.col("confidence") != 0), properties).alias("properties"),
    )
    return findings.select("target", F.to_json(result).alias("result"))


# Version of the format and where its schema lies.
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"


def sarif_runs(findings: DataFrame) -> DataFrame:
    """What a target's SARIF document says beside its results (JSON): schema, version, tool, and the rules that its findings name."""
    rule = F.struct(F.col("rule").alias("id"), F.when(F.nullif(F.col("cwe"), F.lit("")).isNotNull(), F.struct(F.col("cwe"))).alias("properties"))
    driver = F.struct(F.lit(TOOL).alias("name"), F.lit(__version__).alias("version"), F.array_sort(F.collect_set(rule)).alias("rules"))  # at most the rules there are
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"))
    return findings.groupBy("target").agg(F.to_json(F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version"), F.array(run).alias("runs"))).alias("document"))


def write_sarif(findings: DataFrame, path: str) -> None:
    """A folder for each target: result rows as JSON lines below ``results``, the document that they belong in below ``documents``."""
    sarif_results(findings).write.mode("overwrite").partitionBy("target").text(f"{path}/results")
    sarif_runs(findings).write.mode("overwrite").partitionBy("target").text(f"{path}/documents")


def finding_json() -> Column:
    """A finding with the members that it has."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.to_json(F.struct("rule", "severity", "confidence", confidence_label(F.col("confidence")).alias("confidenceLabel"), "message", text("file").alias("file"), F.when(F.col("line") > 0, F.col("line")).alias("line"), text("tool").alias("tool"), text("cwe").alias("cwe")))


def write_findings(findings: DataFrame, path: str) -> None:
    findings.select("target", finding_json().alias("finding")).write.mode("overwrite").partitionBy("target").text(path)


SCAN_RESULT = "array<struct<rule:string,severity:int,confidence:int,message:string,file:string,line:int,tool:string,cwe:string>>"


def scan_results(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, failures) of target and body: null, ``null`` and empty bodies are no findings, what isn't an array fails."""
    v = F.try_parse_json("body")
    blank = F.coalesce(F.trim("body"), F.lit("")).isin("", "null")
    fine = blank | F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    found = bodies.where(fine & ~blank).select("target", F.inline(F.from_json("body", SCAN_RESULT)))
    return found, bodies.where(~fine).select("target", F.lit("error").alias("reason"))
