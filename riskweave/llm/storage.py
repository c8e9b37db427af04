"""Where jobs cut lineage: the shared checkpoint folder of the session, never a folder of one machine on a cluster.

Tables written on the way are deleted when the work that needs them is done
(``cleared``); shuffle files of a job that has written its table go with it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables (session, path) that open scopes will delete, innermost last; those of the first are deleted at the end of the driver.
_SCOPES: list[list[tuple[SparkSession, str]]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary folder; a
    cluster session must name one, as its machines share no local disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    folder = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
    spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def _without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Jobs within leave no shuffle files behind: their results are written, and nothing reads them again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _written(df: DataFrame, scope: list[tuple[SparkSession, str]]) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    scope.append((df.sparkSession, path))
    with _without_leftovers(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back; lost executors cost no recomputation of what led to it."""
    return _written(df, _SCOPES[-1])


def kept(df: DataFrame) -> DataFrame:
    """As ``materialize``, for what outlives the innermost ``cleared``."""
    return _written(df, _SCOPES[-2] if len(_SCOPES) > 1 else _SCOPES[-1])


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    while tables:
        spark, path = tables.pop()
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def cleared() -> Iterator[None]:
    """Deletes the tables that were materialized within; what is still to be read must be ``kept``."""
    _SCOPES.append([])
    try:
        yield
    finally:
        _delete(_SCOPES.pop())


@atexit.register
def _at_the_end() -> None:
    """What results still read goes with the driver."""
    try:
        _delete(_SCOPES[0])
    except (Py4JError, OSError, AttributeError, TypeError):  # the JVM has gone first
        pass
