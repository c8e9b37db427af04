"""Source trees, pins and streams: files as they were written, baselines while they are replaced, batches that count once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import pins
from riskweave.rules import catalog as c
from riskweave.sources import sinks, tree
from riskweave.streaming import streams

FILES = [
    ("a", "__init__.py", b"x = 1\r\ny = 2\r\n"), ("a", ".env", b""), ("a", "_p/.q/__mocks__/z.py", b"\xff\xfe\x00 bytes"), ("_b", "c.py", "é – 字".encode()), (".c", "d", b"\n"), ("a b", "d e/%20 f=g.py", b"s" * 100_000), ("a", "node_modules/x/y.js", b"j"), (None, "top.txt", b"t"), (None, "_top", b""),
]


def key(row):
    return tuple(str(x) for x in row)


@pytest.fixture
def tree_root(spark, tmp_path):
    root = str(tmp_path / "tree")
    tree.write_source_tree(spark.createDataFrame(FILES, tree.SCHEMA).repartition(3), root)
    return root


def test_tree_comes_back_file_by_file(spark, tree_root):
    got = [(r["target"], r["path"], bytes(r["content"])) for r in tree.read_source_tree(spark, tree_root, binary=True).collect()]
    assert sorted(got, key=key) == sorted(FILES, key=key)
    texts = {(r["target"], r["path"]): r["content"] for r in tree.read_source_tree(spark, tree_root).collect()}
    assert texts["a", "__init__.py"] == "x = 1\r\ny = 2\r\n" and texts["_b", "c.py"] == "é – 字" and texts["a", "_p/.q/__mocks__/z.py"] == "��\0 bytes"
    assert not [name for name in os.listdir(tree_root) if name.startswith(".writing")]


def test_tree_is_the_same_however_it_is_shared_out(spark, tree_root, monkeypatch):
    """Folders listed by the driver or walked by tasks, alone or several in one task."""
    reader = lambda: tree.TreeReader(tree_root, "")
    for spread, most, size in ((1, 10_000, 1 << 20), (100, 10_000, 1), (2, 1, 1 << 20)):
        monkeypatch.setattr(tree, "SPREAD", spread)
        monkeypatch.setattr(tree, "MOST_TASKS", most)
        monkeypatch.setattr(tree, "PART_BYTES", size)
        own = reader()
        rows = [tuple(r.values()) for part in own.partitions() for batch in own.read(part) for r in batch.to_pylist()]
        assert sorted(rows, key=key) == sorted(FILES, key=key)


def test_tree_leaves_excluded_folders_unlisted(spark, tree_root, monkeypatch):
    os.symlink(tree_root, f"{tree_root}/a/loop")
    got = {(r["target"], r["path"]) for r in tree.read_source_tree(spark, tree_root, exclude=[*c.DEPENDENCY_DIRS, *c.TEST_DIRS]).collect()}
    assert got == {(t, p) for t, p, _ in FILES if "node_modules" not in p and "__mocks__" not in p}
    listed = []
    plain = tree._listed
    monkeypatch.setattr(tree, "_listed", lambda files, folder, excluded: listed.append(folder) or plain(files, folder, excluded))
    own = tree.TreeReader(tree_root, "node_modules")
    for part in own.partitions():
        list(own.read(part))
    assert listed and not [f for f in listed if "node_modules" in f]


def test_tree_of_nothing_and_of_names_that_lead_out(spark, tmp_path):
    os.mkdir(tmp_path / "none")
    assert tree.read_source_tree(spark, str(tmp_path / "none")).count() == 0
    for target, path in (("a", "../x"), ("..", "x"), ("a/b", "x"), ("a", "/x"), ("a", "")):
        with pytest.raises(Exception, match="not a file below the tree"):
            tree.write_source_tree(spark.createDataFrame([(target, path, b"")], tree.SCHEMA), str(tmp_path / "out"))
    assert not [name for _, _, names in os.walk(tmp_path) for name in names]


TOOL = "target string, tool_name string, description string, input_schema string"


def tools(spark, rows):
    return spark.createDataFrame(rows, TOOL)


def test_baseline_is_read_while_it_is_replaced(spark, tmp_path):
    path = str(tmp_path / "pins")
    assert pins.read(spark, path).count() == 0
    old, new = tools(spark, [("s", "a", "x", None), ("s", "b", "y", "{}")]), tools(spark, [("s", "a", "changed", None), ("s", "c", "z", "{}")])
    pins.write(old, path)
    before = pins.read(spark, path)
    diffs = pins.diff(new, before)
    pins.write(new, path)  # replaces what diffs still reads
    assert {(r["tool_name"], r["state"]) for r in diffs.collect()} == {("a", "changed"), ("b", "removed"), ("c", "new")}
    assert {r["state"] for r in pins.diff(new, pins.read(spark, path)).collect()} == {"unchanged"}
    # The baseline from what differs from itself.
    pins.write(tools(spark, [("s", "d", "w", None)]).unionByName(new.join(pins.read(spark, path), ["target", "tool_name"], "left_semi").select("target", "tool_name", "description", "input_schema")), path)
    assert {r["tool_name"] for r in pins.read(spark, path).collect()} == {"a", "c", "d"}
    assert len([x for x in os.listdir(path) if x.startswith("snapshot") and not x.endswith("pointer")]) == pins.KEPT


def test_a_failed_write_leaves_the_old_baseline(spark, tmp_path):
    path = str(tmp_path / "pins")
    pins.write(tools(spark, [("s", "a", "x", None)]), path)
    with pytest.raises(Exception, match="on purpose"):
        pins.write(tools(spark, [("s", "b", "x", None)]).withColumn("description", F.raise_error(F.lit("on purpose"))), path)
    assert [r["tool_name"] for r in pins.read(spark, path).collect()] == ["a"]


def listing(spark, folder, target, names):
    tools(spark, [(target, n, d, None) for n, d in names]).coalesce(1).write.mode("append").parquet(folder)


def test_listings_in_batches_with_a_restart_equal_the_diff(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    base = tools(spark, [(t, n, "d", None) for t in ("s1", "s2", "s3", "s4") for n in ("a", "b")])
    pins.write(base, str(tmp_path / "pins"))
    baseline = pins.read(spark, str(tmp_path / "pins"))
    first = {"s1": [("a", "d"), ("b", "other")], "s2": [("a", "d")], "s3": [("a", "d"), ("b", "d"), ("c", "new")]}
    for target, names in first.items():
        listing(spark, folder, target, names)
    stream = lambda: streams.table_stream(spark, folder, files_per_batch=1)
    streams.check_listings(stream(), baseline, out)
    listing(spark, folder, "s2", [("b", "d")])  # listed again, otherwise
    listing(spark, folder, "s4", [("x", "d")])
    got = {(r["target"], r["tool_name"], r["state"]) for r in streams.check_listings(stream(), baseline, out).collect()}
    last = tools(spark, [(t, n, d, None) for t, names in (first | {"s2": [("b", "d")], "s4": [("x", "d")]}).items() for n, d in names])
    want = pins.diff(last, baseline)
    assert got == {(r["target"], r["tool_name"], r["state"]) for r in want.collect()}
    assert {s for _, _, s in got} == {"new", "changed", "removed", "unchanged"}
    assert len([x for x in os.listdir(f"{out}/data") if x.startswith("batch=")]) == 5  # a file each
    # A batch that runs again, as after a failure before its commit, counts once.
    streams._check_batch(baseline, out)(spark.read.parquet(folder).where("target = 's4'"), 4)
    assert {(r["target"], r["tool_name"], r["state"]) for r in streams.states(spark, out).collect()} == got


@pytest.mark.parametrize(("kind", "rows", "schema"), [
    ("scan_arguments", [("s", "t", '{"q":"a; rm -rf b"}'), ("s", "t", '{"q":"plain"}'), ("s", "u", '{"q":"../../etc/passwd"}')], "target string, tool_name string, args string"),
    ("scan_responses", [("s", "t", "password: hunter2"), ("s", "t", "nothing"), ("s", "u", "123-45-6789")], "target string, tool_name string, text string"),
    ("classify_connections", [("s", "t", 'connect(3, {sa_family=AF_INET, sin_port=htons(443), sin_addr=inet_addr("10.1.2.3")}, 16) = 0'), ("s", "u", "write(1)")], "target string, tool_name string, line string"),
])
def test_streams_in_batches_with_a_restart_equal_the_batch(spark, tmp_path, kind, rows, schema):
    folder, out, scan = str(tmp_path / "in"), str(tmp_path / "out"), getattr(streams, kind)
    for part in (rows, rows[:1]):
        for row in part:
            spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)
        streams.drain(scan(streams.table_stream(spark, folder, files_per_batch=1)), out)
    got = streams.drain(scan(streams.table_stream(spark, folder, files_per_batch=1)), out)  # nothing has come since
    assert sorted(map(key, got.collect())) == sorted(map(key, scan(spark.read.parquet(folder)).collect())) and got.count()


def test_sarif_document_names_tool_and_rules(spark):
    found = spark.createDataFrame([("t", "r2", None), ("t", "r1", "CWE-1"), ("t", "r1", "CWE-1")], "target string, rule string, cwe string")
    import json

    (row,) = sinks.sarif_runs(found).collect()
    document = json.loads(row["document"])
    assert document["version"] == "2.1.0" and document["$schema"].endswith("sarif-schema-2.1.0.json")
    driver = document["runs"][0]["tool"]["driver"]
    assert driver["name"] == "riskweave" and driver["version"] and [x["id"] for x in driver["rules"]] == ["r1", "r2"] and driver["rules"][0]["properties"] == {"cwe": "CWE-1"}


def test_random_trees(spark, tmp_path):
    draw = random.Random(4)
    name = lambda: draw.choice(["_", ".", "", "a."]) + draw.choice("xyz") + str(draw.randrange(30))
    files = {(name(), "/".join("d" + name() for _ in range(draw.randrange(4))) + ("/" if draw.random() < 0 else "")): None for _ in range(60)}
    rows = [(t, f"{p}/f" if p else "f", draw.randbytes(draw.randrange(50))) for t, p in files]
    tree.write_source_tree(spark.createDataFrame(rows, tree.SCHEMA), str(tmp_path / "r"))
    assert sorted(((r["target"], r["path"], bytes(r["content"])) for r in tree.read_source_tree(spark, str(tmp_path / "r"), binary=True).collect()), key=key) == sorted(rows, key=key)
