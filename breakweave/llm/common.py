"""Helpers that the corpus operators share: reading tables, staging, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256
#: Bytes of texts in them, above which there are fewer rows.
SLICE_BYTES = 8 << 20
#: Bytes after which an output batch is handed on.
FLUSH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one in the warehouse.

    A temporary folder of this machine serves where all executors run in the driver's process.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        one_process = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        path = "file://" + tempfile.mkdtemp(prefix="breakweave-") if one_process else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


#: Spark's own setting that drops the shuffle files of a finished query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Folders staged since each scratch() that is open began.
_scratches: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged inside goes when this ends, but for what is staged as lasting."""
    _scratches.append([])
    try:
        yield
    finally:
        sc = spark.sparkContext
        for name in _scratches.pop():
            path = sc._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's own bound on the bytes of a batch that goes to a Python worker, and what it is inside sparing().
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: How many sparing() are open.
_sparing = 0


@contextmanager
def sparing(spark: SparkSession) -> Iterator[None]:
    """What is staged inside takes little of an executor's memory: batches are small, and files of a local file system are written by Python workers.

    Hadoop's own writer starts chmod twice for each file there, and until such a process runs, its executor's memory counts twice.
    """
    global _sparing
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(BATCH_BYTES))
    _sparing += 1
    try:
        yield
    finally:
        _sparing -= 1
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def _written(folder: str, work: Callable | None):
    """A mapInArrow function: writes a task's rows, or what work() makes of them, to a file that readers ignore until it is renamed, and gives its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, writer, held, size = f".part-{uuid.uuid4().hex}", None, [], 0

        def flush() -> None:
            nonlocal writer, held, size
            if held:
                writer = writer or pq.ParquetWriter(f"{folder}/{name}", held[0].schema, compression="zstd")
                writer.write_table(pa.Table.from_batches(held))
                held, size = [], 0

        try:
            for batch in work(batches) if work else batches:
                if batch.num_rows:
                    held.append(batch)
                    size += batch.nbytes
                if size >= FLUSH_BYTES:
                    flush()
            flush()
        finally:
            if writer:
                writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([name] if writer else [], pa.string())], names=["name"])

    return run


def stage(df: DataFrame, lasting: bool = False, work: Callable | None = None, schema: str = "") -> DataFrame:
    """Write df, or df.mapInArrow(work, schema), to the shared folder and read it back. Later steps start from files that outlive any executor.

    What was shuffled on the way is of no use any more and goes at once, so that disks hold one step's shuffles and not all.
    """
    spark = df.sparkSession
    path, before = new_path(spark, "staged"), spark.conf.get(CLEANUP, None)
    made = df.mapInArrow(work, schema) if work else df
    for own in _scratches[-1 - lasting : len(_scratches) - lasting]:
        own.append(path)
    spark.conf.set(CLEANUP, "true")
    try:
        if _sparing and path.startswith("file:/"):
            folder = "/" + path.removeprefix("file:").lstrip("/")
            os.makedirs(folder)
            # a task that ran twice leaves a file that nobody reads
            for row in df.mapInArrow(_written(folder, work), "name string").collect():
                os.rename(f"{folder}/{row['name']}", f"{folder}/{row['name'][1:]}.parquet")
        else:
            made.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(made.schema).parquet(path)


def text_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text as UTF-8 bytes); a null text is empty."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary")).alias("text"),
    )


def decoded(value: bytes | None) -> str:
    return "" if not value else value.decode("utf-8", "replace")


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of at most so many rows, and of about so many bytes in columns of texts; a row is never cut."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_binary(column.type) or pa.types.is_string(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        upto, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            stop = max(at + 1, min(at + rows, int(np.searchsorted(upto, before + most, side="right"))))
            yield batch.slice(at, stop - at)
            at = stop


class Rows:
    """Collects rows and yields Arrow batches of a bounded size."""

    def __init__(self, schema: pa.Schema, flush_bytes: int = FLUSH_BYTES):
        self.schema, self.flush_bytes = schema, flush_bytes
        self.columns: list[list] = [[] for _ in schema]
        self.bytes = 0

    def add(self, *values, size: int = 64) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
        self.bytes += size

    def take(self, force: bool = False) -> Iterator[pa.RecordBatch]:
        if self.columns[0] and (force or self.bytes >= self.flush_bytes):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
            self.columns = [[] for _ in self.schema]
            self.bytes = 0


def per_document(schema: pa.Schema, work: Callable[[], Callable[[int | None, str], tuple]]):
    """A mapInArrow function: work() is called once a task and gives the function from (doc_id, text) to a row and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, rows = work(), Rows(schema)
        for part in slices(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                values, size = each(doc_id, decoded(text))
                rows.add(*values, size=size)
                yield from rows.take()
        yield from rows.take(force=True)

    return run
