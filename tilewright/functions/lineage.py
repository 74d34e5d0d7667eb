"""Cutting lineage through the shared folder of the cluster."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

class _Blocks(threading.local):
    """Folders written inside the open blocks of ``scratch`` of this thread, the innermost one last."""

    def __init__(self):
        self.open: list[list[str]] = []


_BLOCKS = _Blocks()
#: Folders of local sessions without a setting, by application.
_LOCAL: dict[str, str] = {}
_LOCK = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor see: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session (tests) gets a temporary folder, one for its application;
    a cluster without the setting is an error, because a machine-local folder would lose rows there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    with _LOCK:
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="tilewright-")
        return _LOCAL[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later jobs start there.

    The rows survive the loss of any executor, unlike cached or locally checkpointed ones.
    Inside a block of ``scratch`` the files go at its end.
    """
    path = fresh_path(df.sparkSession, name)
    if _BLOCKS.open:
        _BLOCKS.open[-1].append(path)
    return _written(df, path)


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """Like ``cut``, but the files outlive the innermost block of ``scratch`` (an outer one deletes them at its end)."""
    path = fresh_path(df.sparkSession, name)
    if len(_BLOCKS.open) > 1:
        _BLOCKS.open[-2].append(path)
    return _written(df, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A block whose ``cut`` files are deleted at its end; what leaves it must go through ``keep``.

    A block belongs to the thread that opens it, so runs in other threads keep their files.
    """
    _BLOCKS.open.append([])
    try:
        yield
    finally:
        discard(spark, *_BLOCKS.open.pop())


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared storage that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
