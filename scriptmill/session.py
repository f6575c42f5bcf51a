"""Session settings and staging of intermediate tables."""

import os
import re
import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache
from threading import Lock

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the operators rely on; partition counts are left to the cluster and to AQE."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session that names none, as in tests, gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.conf.get("spark.master", "")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or _own_folder(spark.sparkContext.applicationId)


@lru_cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"scriptmill-{application}-")


_made: dict[str, list[str]] = {}
#: what each `passing` block around the running code has staged, the outermost first
_blocks: ContextVar[tuple[list[str], ...]] = ContextVar("blocks", default=())


def new_path(spark: SparkSession, label: str) -> str:
    path = os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted where the block ends, but for those staged as `lasting`, which belong to the block around it.

    For steps whose result is itself staged: nothing that is returned may still read what passes. Threads have blocks of their own.
    """
    own: list[str] = []
    token = _blocks.set((*_blocks.get(), own))
    try:
        yield
    finally:
        _blocks.reset(token)
        made = _made.get(spark.sparkContext.applicationId, [])
        for path in own:
            _delete(spark, path)
            if path in made:
                made.remove(path)


def drop_staged(spark: SparkSession) -> int:
    """Deletes what this application has staged; for when all readers of its results are done.

    A folder that cannot be reached is told in a warning and tried again by the next call; the others are deleted.
    """
    application = spark.sparkContext.applicationId
    paths, left = _made.pop(application, []), []
    for path in paths:
        try:
            _delete(spark, path)
        except (PySparkException, Py4JError) as error:
            warnings.warn(f"{path} is not deleted: {error}", stacklevel=2)
            left.append(path)
    if left:
        _made.setdefault(application, []).extend(left)
    return len(paths) - len(left)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning: list[str | None] = []
_lock = Lock()


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written, and not when the driver's memory is next cleaned.

    Blocks of several threads may overlap: the first sets the session's setting, the last puts back what it was.
    """
    with _lock:
        _cleaning.append(_cleaning[0] if _cleaning else spark.conf.get(CLEANUP, None))
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            before = _cleaning.pop()
            if not _cleaning:
                spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Writes `df` once to the shared folder and reads it back.

    For tables that several later passes read: lineage ends at the files, so a lost executor
    costs a re-read and not the passes before, and column pruning reaches the scan. Files are packed by zstd,
    which takes about half the bytes of the default for text. `lasting` tables outlive the `passing` block they are made in.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    blocks = _blocks.get()[:-1] if lasting else _blocks.get()
    if blocks:
        blocks[-1].append(path)
    with _shuffles_go(spark):  # no one else reads the shuffles of this write
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
