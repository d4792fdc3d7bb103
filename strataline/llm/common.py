"""Shared pieces: where intermediate tables go, ASCII case, words, salted lookups."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of rows handed to a Python worker at once. Spark's own 64 MB would stand several times in an executor: in the JVM's
#: buffers of each running task and, as Arrow and as Python objects, in its workers.
BATCH_BYTES = "2m"


def ready(spark: SparkSession) -> SparkSession:
    """The session, with this package on its workers and batches for them bounded, unless it has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(name, BATCH_BYTES)
    return session.ready(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session has none, a local session gets one under /tmp/checkpoints; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"/tmp/checkpoints/strataline-{os.getpid()}"
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def _own_dir(spark: SparkSession) -> str:
    """This application's folder: other applications may use the same shared one."""
    return f"{shared_dir(spark)}/strataline/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: lineage is cut there, and a lost executor costs no more than its own tasks.

    The shuffle files behind it go as soon as it is written, not when the driver happens to collect its garbage.
    """
    path, conf, name = scratch_path(df.sparkSession, label), df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*frames: DataFrame) -> None:
    """Delete tables made by `written` from which nothing is read any more."""
    for frame in frames:
        _delete(frame.sparkSession, frame._scratch)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table of this application (call it once results have been written)."""
    _delete(spark, _own_dir(spark))


def ascii_lower(col: Column | str) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(F.col(col) if isinstance(col, str) else col, UPPER, LOWER)


def n_words(col: Column | str) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def salted_lookup(rows: DataFrame, facts: DataFrame, key: str, salts: int = 16, salt_by: Column | None = None) -> DataFrame:
    """rows left-joined with facts (one row a key) where a key may hold a large share of rows.

    Each row takes one of `salts` lanes and facts are repeated in every lane, so a hot key is
    spread over `salts` tasks whatever the planner knows of it.
    """
    lane = F.pmod(salt_by if salt_by is not None else F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    lanes = facts.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_lane", lane).join(lanes, [key, "_lane"], "left").drop("_lane")


def rested(spark: SparkSession) -> SparkSession:
    """The session, ready, after every executor has collected its garbage.

    A heap that one stage has filled stays in the executor's memory until a full collection, which gives most of it back to the system;
    in a chain of stages that is memory which the next one's Python workers need. As many tasks as there are slots, each a collection:
    while nothing else runs, every executor gets its share of them. Where the JVM ignores such calls, nothing happens.
    """
    tasks = spark.sparkContext.defaultParallelism
    ready(spark).range(0, tasks, 1, tasks).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()
    return spark


#: Tables that a worker keeps between the tasks of one operator.
KEPT: dict = {}


def let_go() -> None:
    """Free what another operator's tasks left in this worker."""
    if KEPT:
        KEPT.clear()
        gc.collect()


def settled(run: Callable) -> Callable:
    """run of a task, after which the worker gives memory that it no longer holds objects in back to the system."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return tidy


def slices(batch: pa.RecordBatch, rows: int = 512, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that Python objects of few rows are held at once; without keep, KEPT is let go."""
    if not keep:
        let_go()
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def packed(docs: DataFrame, *read: str) -> DataFrame:
    """docs as one struct column `row` beside the columns `read`, so that no column of the caller meets a name of ours."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(F.col(f"`{c}`") for c in read))


def strings(column: pa.Array) -> list[str]:
    """Python strings of a text column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]
