"""Queries over their own small tables: the whole job is done, and work is spread however few splits a table has."""

import pytest
from pyspark.sql import functions as F

from riskweave import corpora
from riskweave import queries as core
from riskweave.operators import dependencies as deps
from riskweave.operators import network, report
from riskweave.operators.matching import match_rules
from riskweave.plans import dependencies as plans
from riskweave.rules import catalog as c
from riskweave.rules import ruleset as r


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A folder with parts 0 to 59, 40 to 44 twice, and one without a key."""
    sf = str(tmp_path_factory.mktemp("parts"))
    keys = [(k,) for k in [*range(60), *range(40, 45), None]]
    spark.createDataFrame(keys, "p_partkey long").coalesce(1).write.parquet(f"{sf}/part.parquet")
    return sf


def test_every_dependency_meets_every_advisory(spark, parts):
    own = [(r["target"], r["name"], r["version"]) for r in deps.merged_dependencies(plans.manifests(spark, parts)).collect()]
    limits = [v[1] for v in c.VULNERABLE_PACKAGES]
    got = core.QUERIES["compare_versions"](spark, parts)
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted((*o, limit) for o in own for limit in limits)
    own = deps.normalize_version(F.col("version"))
    assert got.where(F.col("compared") != deps.compare_versions(own, F.col("max_affected"))).count() == 0
    assert {r["compared"] for r in got.select("compared").distinct().collect()} == {-1, 0, 1}


def test_work_on_few_keys_is_spread(spark, parts):
    """A table of one split is worked on by as many tasks as the session shuffles into; repeated and missing keys stay."""
    spark.range(40).selectExpr("id AS s_suppkey").coalesce(1).write.mode("overwrite").parquet(f"{parts}/supplier.parquet")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = plans.files(spark, parts)
    assert files.rdd.getNumPartitions() == n and corpora.tools(spark, parts).rdd.getNumPartitions() == n
    assert files.count() == 4 * 66 and files.where("target IS NULL").count() == 4


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_manifest_is_parsed_once(spark, parts):
    for found in (deps.manifests(plans.files(spark, parts)), report.package_items(plans.files(spark, parts))):
        assert plan(found).count("parseJson") == 1
    texts = ["{}", "[]", "null", "x", "", None, '{"scripts":null}', '{"scripts":[]}', '{"scripts":{"a":"b","c":null}}', '{"scripts":{"a":1}}', '{"dependencies":{"a":"1"},"devDependencies":{"a":"2"}}', '{"dependencies":"a"}']
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "target int, content string").withColumn("path", F.lit("package.json"))
    got = {r["target"]: r["valid"] for r in deps.manifests(rows).collect()}
    assert {texts[i] for i, valid in got.items() if valid} == {"{}", '{"scripts":null}', '{"scripts":{"a":"b","c":null}}', '{"dependencies":{"a":"1"},"devDependencies":{"a":"2"}}'} and len(got) == len(texts)


def test_connections_are_classified_without_lambdas(spark):
    v4 = 'connect(3, {sa_family=AF_INET, sin_port=htons(%s), sin_addr=inet_addr("%s")}, 16) = 0'
    lines = [
        (v4 % ("80", "10.0.0.1"), ("tcp", "10.0.0.1:80", "net-probe-private-ip")), (v4 % ("53", "a.b"), ("dns", "a.b:53", "net-probe-dns-query")), (v4 % ("1", "172.32.0.1"), ("tcp", "172.32.0.1:1", "net-probe-outbound-connection")),
        (v4 % ("1", "256.1.1.1"), ("tcp", "256.1.1.1:1", "net-probe-outbound-connection")), (v4 % ("1", "169.254.169.254"), ("tcp", "169.254.169.254:1", "net-probe-metadata-service")),
        ('sendto(4, "x", 1, 0, {sa_family=AF_INET6, sin6_port=htons(9), sin6_addr=inet_pton(AF_INET6, "::1"', ("udp", "[::1]:9", "net-probe-outbound-connection")),
        ('write(1, htons(80), "connect("', None), ("", None), (None, None),
    ]
    rows = spark.createDataFrame([(str(i), "t", x) for i, (x, _) in enumerate(lines)], "target string, tool_name string, line string")
    events = network.parse_trace(rows)
    found = network.classify(events)
    assert "lambda" not in plan(found).lower()
    rules = {r["target"]: r["rule"] for r in found.collect()}
    got = {r["target"]: (r["type"], r["destination"], rules[r["target"]]) for r in events.collect()}
    assert got == {str(i): want for i, (_, want) in enumerate(lines) if want}
    odd = spark.createDataFrame([("[::1]:9", "::1"), ("a:b:c", "a:b:c"), ("[x", "[x"), ("", ""), (":", ""), ("a:[1]", "a"), ("[]:", ""), (None, None)], "d string, h string")
    assert [r["d"] for r in odd.where(~network.host_of(F.col("d")).eqNullSafe(F.col("h"))).collect()] == []


def test_a_match_is_made_once(spark):
    rows = spark.createDataFrame([("a; rm",), (None,), ("x",)], "value string")
    found = match_rules(rows, "value", r.ARGUMENTS)
    assert plan(found).count("<!ENTITY") == 1 + plan(rows).count("<!ENTITY") and [x["value"] for x in found.collect()] == ["a; rm"]
