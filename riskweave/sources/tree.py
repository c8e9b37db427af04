"""Source trees as a table, and tables as source trees: a data source of its own.

Spark's own file index passes over every name that begins with ``_`` or ``.``;
a source tree is full of them (``__init__.py``, ``.env``).  Here the driver lists
folders only until there are enough of them to share out; each task walks the
folders that it was given, leaves excluded ones unlisted, and reads files whole as
bytes.  Files are written by tasks, each under a name of its own first.
"""

from __future__ import annotations

import os
import uuid
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "target string, path string, content binary"
#: Folders to share out, the listings that the driver makes for that at most, and the tasks at most.
SPREAD, MOST_LISTED, MOST_TASKS = 256, 2_000, 10_000
#: Bytes of the files that lie in the folders that the driver has listed, for each task; bytes of a batch.
PART_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
_WRITING = ".writing-"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    files, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")
    return files, path.rstrip("/")


def _listed(files: fs.FileSystem, folder: str, excluded: frozenset[str]) -> tuple[list[str], list[tuple[str, int]]]:
    """Folders and (file, bytes) in a folder, in order; folders that are links aren't followed."""
    folders, found = [], []
    for info in files.get_file_info(fs.FileSelector(folder)):
        if info.type == fs.FileType.Directory:
            linked = isinstance(files, fs.LocalFileSystem) and os.path.islink(info.path)
            if info.base_name not in excluded and not info.base_name.startswith(_WRITING) and not linked:
                folders.append(info.path)
        elif info.type == fs.FileType.File:
            found.append((info.path, info.size or 0))
    return sorted(folders), sorted(found)


@dataclass
class Part(InputPartition):
    """Folders to walk, and single files."""

    folders: tuple[str, ...]
    files: tuple[str, ...]

    def __init__(self, folders: Sequence[str] = (), files: Sequence[str] = ()) -> None:
        super().__init__(None)
        self.folders, self.files = tuple(folders), tuple(files)


class TreeReader(DataSourceReader):
    def __init__(self, root: str, exclude: str) -> None:
        self.root, self.excluded = root, frozenset(x for x in exclude.split(",") if x)

    def partitions(self) -> list[Part]:
        files, root = opened(self.root)
        first, single = _listed(files, root, frozenset())  # what is called like an excluded folder may be a target
        open_folders = deque(first)
        listings = 0
        while open_folders and len(open_folders) < SPREAD and listings < MOST_LISTED:
            folders, found = _listed(files, open_folders.popleft(), self.excluded)
            open_folders.extend(folders)
            single += found
            listings += 1
        each = max(1, -(-len(open_folders) // MOST_TASKS))
        walk = list(open_folders)
        parts = [Part(folders=walk[i : i + each]) for i in range(0, len(walk), each)]
        batch, size = [], 0
        for path, length in single:
            if batch and size + length > PART_BYTES:
                parts.append(Part(files=batch))
                batch, size = [], 0
            batch.append(path)
            size += length
        return parts + ([Part(files=batch)] if batch or not parts else [])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        files, root = opened(self.root)

        def walked() -> Iterator[str]:
            yield from partition.files
            waiting = list(partition.folders)
            while waiting:
                folders, found = _listed(files, waiting.pop(), self.excluded)
                waiting += folders
                yield from (path for path, _ in found)

        rows: list[tuple[str | None, str, bytes]] = []
        size = 0
        for full in walked():
            target, inside, path = full[len(root) + 1 :].partition("/")
            with files.open_input_stream(full) as stream:
                content = stream.read()
            rows.append((target, path, content) if inside else (None, target, content))
            size += len(content)
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str | None, str, bytes]]) -> pa.RecordBatch:
    targets, paths, contents = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(targets, pa.string()), pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["target", "path", "content"])


class TreeWriter(DataSourceArrowWriter):
    """Each file is written aside and moved to its name when it is whole, so that a lost task's leftovers are no files of the tree."""

    def __init__(self, root: str) -> None:
        self.root, self.aside = root, f"{_WRITING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = opened(self.root)
        aside = f"{root}/{self.aside}/{uuid.uuid4().hex}"
        files.create_dir(aside, recursive=True)
        made: set[str] = set()
        for batch in iterator:
            for target, path, content in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("target", "path", "content")), strict=True):
                target, path = target.as_py(), path.as_py()
                names = ([target] if target is not None else []) + (path or "").split("/")
                if any(n in ("", ".", "..") for n in names) or (target and "/" in target):
                    raise ValueError(f"not a file below the tree: {target!r}, {path!r}")
                full = "/".join([root, *names])
                folder = full.rpartition("/")[0]
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                with files.open_output_stream(f"{aside}/file") as stream:
                    stream.write(content.as_py() or b"")
                files.move(f"{aside}/file", full)
        return WriterCommitMessage()

    def _cleared(self) -> None:
        files, root = opened(self.root)
        if files.get_file_info(f"{root}/{self.aside}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.aside}")

    def commit(self, messages) -> None:
        self._cleared()

    def abort(self, messages) -> None:
        self._cleared()


class SourceTree(DataSource):
    """``format("source_tree")``: path is the root, exclude the names of folders to leave out."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], self.options.get("exclude", ""))

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"])


def read_source_tree(spark: SparkSession, root: str, *, exclude: Sequence[str] = (), binary: bool = False) -> DataFrame:
    """target (the first folder below root; null for files that lie in root itself), path below it and content of every file.

    Names that begin with a dot or an underscore are files like others.  Content
    is text, with U+FFFD for bytes that aren't UTF-8, or with ``binary`` the bytes
    as they are.  Folders named in ``exclude`` are not listed, below the targets;
    links to folders are not followed.
    """
    spark.dataSource.register(SourceTree)
    files = spark.read.format("source_tree").option("exclude", ",".join(exclude)).load(root)
    return files if binary else files.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))


def write_source_tree(files: DataFrame, root: str) -> None:
    """A file for each row (target, path, content as text or bytes); a file that is there is replaced.  Of rows with the same name one stays."""
    files.sparkSession.dataSource.register(SourceTree)
    files.select("target", "path", F.col("content").cast("binary").alias("content")).write.format("source_tree").mode("append").save(root)
