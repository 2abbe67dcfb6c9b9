"""What the operators share: worker set-up, tables in the cluster's shared folder, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Most bytes of text that an operator holds in arrays at a time.
BLOCK_BYTES = 8 << 20
#: The same where a block's words and n-grams become arrays of numbers, some thirty times the text.
WORD_BLOCK_BYTES = 4 << 20
#: Most bytes that the JVM hands to Python in one Arrow batch.
BATCH_BYTES = 8 << 20
ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches and lets the Python workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it.  Where it is unset, a folder of this machine if the session runs on it alone, as
    in tests; on a cluster that is an error, as executors would write elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="qaloom-")
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's own switch to drop a finished job's shuffle files at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For each scratch() that is open, the tables that go with it and their paths, by the id of the DataFrame (which is held, as
#: ids of dead ones come again).
_open: list[dict[int, tuple[DataFrame, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written within go when the block ends, but those that keep() has handed on."""
    mine: dict[int, tuple[DataFrame, str]] = {}
    _open.append(mine)
    try:
        yield
    finally:
        _open.remove(mine)
        for df, path in mine.values():
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame, part: str = "") -> None:
    """Written tables within a scratch() that nothing reads any more go at once; part: only that folder of theirs ("level=2")."""
    for df in tables:
        for mine in _open:
            if id(df) in mine:
                _delete(df.sparkSession, f"{mine[id(df)][1]}/{part}")
                if not part:
                    del mine[id(df)]


def keep(df: DataFrame) -> DataFrame:
    """A written table outlives the innermost scratch(): it goes with the next one, or stays."""
    if _open and (entry := _open[-1].pop(id(df), None)) and len(_open) > 1:
        _open[-2][id(df)] = entry
    return df


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """While a table is written: nothing needs the shuffle files once it stands, and a few folders are written side by side,
    without a sort."""
    ours = {CLEANUP: "true", "spark.sql.maxConcurrentOutputFileWriters": "8"}
    before = {k: spark.conf.get(k) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _listed(df: DataFrame, path: str) -> DataFrame:
    if _open:
        _open[-1][id(df)] = (df, path)
    return df


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows of `df`, computed once: written as a table to the shared folder and read again, so lost executors cost
    no more than the tasks that they ran.  by: a column of few values, of which a reader wants one or two."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _writing(spark):
        writer = df.write.option("compression", "zstd").option("maxRecordsPerFile", 0)
        (writer.partitionBy(by) if by else writer).parquet(path)
    return _listed(spark.read.schema(df.schema).parquet(path), path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """The rows of `df`, dealt by `key` and written as a table in the shared folder that is bucketed by it: any number of
    joins on the key then move the other side alone.  The catalog forgets the table at once; its files stay."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"qaloom_{uuid.uuid4().hex}"
    path = new_path(spark, "bucketed")
    with _writing(spark):
        df.repartition(parts, key).write.bucketBy(parts, key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return _listed(out, path)


def partitions(df: DataFrame, each: int) -> int:
    """As many as the session wants, or more, so that each has about `each` bytes of the input as it is stored: what a task holds
    then doesn't grow with the input.  The size is Spark's own estimate; where it has none the session's number stands."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = stored_bytes(df)
    return parts if size >= 1 << 60 else max(parts, -(-size // each))


def stored_bytes(df: DataFrame) -> int:
    """Bytes of what a table is read from, as Spark estimates them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def release() -> None:
    """Gives memory that Arrow and the C library keep for later back to the machine: a worker's peak counts, and workers
    idle between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with what `make` sets up once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            yield from each(batch)
            release()

    return df.mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """Small rows from few partitions to as many tasks as the session wants."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
