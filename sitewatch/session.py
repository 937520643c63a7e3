"""Session settings for the jobs, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A few subjects may own most rows of a domain; split them even where the
    # split costs one more exchange further up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Shuffles start with many partitions and are joined to as few as their bytes ask
    # for; at hundreds of terabytes give more (a partition should hold about 128 MB).
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def job_session(app_name: str, initial_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    settings = dict(SETTINGS)
    if initial_partitions is not None:
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(initial_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


class Scratch:
    """Owner of written intermediates; it removes them when its scope ends."""

    def __init__(self, outer: Scratch | None = None):
        self.outer = outer
        self.folders: list[tuple[SparkSession, str]] = []
        self.undo: list[Callable[[], None]] = []

    def own(self, spark: SparkSession, folder: str) -> str:
        self.folders.append((spark, folder))
        return folder

    def drop(self) -> None:
        while self.undo:
            self.undo.pop()()
        while self.folders:
            remove_folder(*self.folders.pop())


#: What no scope owns lasts as long as this process.
_PROCESS = Scratch()
_SCOPE: ContextVar[Scratch] = ContextVar("scratch", default=_PROCESS)
_LOCAL_BASES: list[str] = []


def set_for_scope(spark: SparkSession, settings: dict[str, str]) -> None:
    """Session settings that the scope takes back at its end; outside any, they stay."""
    before = {key: spark.conf.get(key, None) for key in settings}
    if all(before[key] == value for key, value in settings.items()):
        return

    def restore() -> None:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)

    at_scope_end(restore)
    for key, value in settings.items():
        spark.conf.set(key, value)


def at_scope_end(action: Callable[[], None]) -> None:
    """Do this when the scope ends; outside any, never."""
    if _SCOPE.get() is not _PROCESS:
        _SCOPE.get().undo.append(action)


def process_scope() -> Scratch:
    """The scope of what must outlast every other."""
    return _PROCESS


@atexit.register
def _leave_nothing() -> None:
    _PROCESS.drop()
    while _LOCAL_BASES:
        shutil.rmtree(_LOCAL_BASES.pop(), ignore_errors=True)


@contextmanager
def scratch() -> Iterator[Scratch]:
    """A scope that owns every folder written inside it and removes them at its end.

    Frames built inside read those folders: use them up, or ``saved`` them into
    ``scope.outer``, before the scope ends.
    """
    scope = Scratch(_SCOPE.get())
    token = _SCOPE.set(scope)
    try:
        yield scope
    finally:
        _SCOPE.reset(token)
        scope.drop()


def result_only(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``build``, its result written for the caller and all that led to it removed."""

    @functools.wraps(build)
    def run(*args, **kwargs) -> DataFrame:
        with scratch() as scope:
            return saved(build(*args, **kwargs), scope.outer)

    return run


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder wherever Spark can reach it; a session that is gone leaves it."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except (AttributeError, OSError, Py4JError):
        shutil.rmtree(folder, ignore_errors=True)


def shared_folder(spark: SparkSession, scope: Scratch | None = None) -> str:
    """A new folder, reachable by every executor, for written intermediates.

    The cluster names its folder in ``spark.checkpoint.dir``. Only a local
    session, as in tests, may fall back to a folder of this machine. The scope
    it is asked for in removes it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        if not _LOCAL_BASES:
            _LOCAL_BASES.append(tempfile.mkdtemp(prefix="sitewatch-"))
        base = _LOCAL_BASES[0]
    return (scope or _SCOPE.get()).own(spark, f"{base.rstrip('/')}/sitewatch-{uuid.uuid4().hex}")


def saved(df: DataFrame, scope: Scratch | None = None) -> DataFrame:
    """The same rows, written to the shared folder and read from there."""
    folder = shared_folder(df.sparkSession, scope)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
