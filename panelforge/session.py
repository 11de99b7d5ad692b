"""Session settings, lineage cuts and size checks shared by the operators."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

SPLIT_BYTES = 64 * 1024 * 1024
#: Spark's setting under which the shuffle files of a query go when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "panelforge", cpus: str | int = "*", **conf) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the one it gives you."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one only for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="panelforge-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later jobs read files, so a lost executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_held = threading.local()  # places of the frames stored by the steps of this thread that are under way
_dropping = threading.Lock()
_writes: list[str | None] = []  # one entry per write under way, what was set before


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files; else they stay until the driver's memory is next collected."""
    with _dropping:
        _writes.append(_writes[-1] if _writes else spark.conf.get(DROP_SHUFFLES, None))
        spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        with _dropping:
            before = _writes.pop()
            if not _writes:
                spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


def _file_system(spark: SparkSession, place: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the checkpoint folder and read it back.

    Later jobs prune columns from compressed files and a lost executor costs nothing. The
    files go when the step ends that ``settled`` runs, or else the session's JVM; those of the shuffles go at once.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.parquet(place)
    path, files = _file_system(spark, place)
    files.deleteOnExit(path)
    if getattr(_held, "steps", None):
        _held.steps[-1].append(place)
    return spark.read.schema(df.schema).parquet(place)


def settled(spark: SparkSession, step: Callable[[], T]) -> T:
    """The frame, or tuple of frames, of ``step``, stored; what the step stored on its way is dropped.

    Steps may lie within each other. Frames stored by threads that a step starts are not dropped with it.
    """
    _held.steps = [*getattr(_held, "steps", []), []]
    places = _held.steps[-1]
    try:
        found = step()
        _held.steps = _held.steps[:-1]  # the result belongs to the step around this one
        return tuple(store(f) for f in found) if isinstance(found, tuple) else store(found)
    finally:
        _held.steps = [s for s in _held.steps if s is not places]
        for place in places:
            path, files = _file_system(spark, place)
            files.delete(path, True)
            files.cancelDeleteOnExit(path)


def side_by_side(spark: SparkSession, steps: Sequence[Callable[[], T]]) -> list[T]:
    """Results of independent steps in their order, whose jobs share the cluster.

    For a few steps that each run many short jobs or a long task, so that one alone leaves cores idle.
    """
    ensure_checkpoint_dir(spark)  # named once, before the threads ask for it
    with ThreadPoolExecutor(max(1, len(steps))) as threads:
        return [f.result() for f in [threads.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input too small to fill them by its own splits.

    Above one split's worth of bytes per core the frame is returned as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if estimate < SPLIT_BYTES * cores else df


def is_small(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows, reading no more than needed."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Store a derived side once, count it, and hint a broadcast only within the bound.

    Beyond the bound the join is left to a shuffle, where AQE splits skewed keys.
    """
    stored = cut_lineage(df)
    return F.broadcast(stored) if is_small(stored, max_rows) else stored
