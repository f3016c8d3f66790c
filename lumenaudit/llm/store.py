"""Work folder, tables and files that the driver and all executors share.

Everything that has to outlive a task goes below ``spark.checkpoint.dir``, which every
executor can reach. Tables are Parquet, committed by Spark's own protocol. Files that are not
tables are written under a temporary name and renamed, so that a task that is run twice leaves
one whole file.
"""

from __future__ import annotations

import ctypes
import math
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lineage
from ..lineage import base_dir, bound_batches, drop, on_hadoop, save  # noqa: F401  for the operators

MB = 1 << 20


def release() -> None:
    """Gives freed memory back to the system: Python workers are kept for later tasks, and what their
    allocators hold on to would count against the executor."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def lean(work):
    """For ``mapInArrow``: the same, releasing memory when a task ends."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            release()

    return run


def work_dir(spark: SparkSession, name: str) -> str:
    """A new, unique place for one run of an operator; it goes when the driver ends."""
    bound_batches(spark)
    folder = lineage.work_dir(spark, name)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base_dir(spark))
    return folder


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in either case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def estimated_bytes(df: DataFrame, unknown: int = 64 * MB) -> int:
    """Size of the files that ``df`` reads, after Catalyst; ``unknown`` for a source that can't tell."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n if n < 1 << 60 else unknown for n in sizes)


#: Tables up to this size, as written, may be broadcast.
BROADCAST = 4 * MB


def small(saved: DataFrame) -> DataFrame:
    """A written table, marked for broadcasting if its files are known to be small."""
    return F.broadcast(saved) if estimated_bytes(saved, unknown=1 << 60) <= BROADCAST else saved


def parts_for(df: DataFrame, least: int = 16 * MB, most: int = 128 * MB, size: int | None = None) -> int:
    """Number of partitions: about four for each core, none much under ``least`` or over ``most`` bytes."""
    size = estimated_bytes(df) if size is None else size
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(size / min(most, max(least, size // (4 * cores)))))


#: Names that Spark has for schemes that the executors' own file systems know by another.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme, mark, rest = uri.partition("://")
    uri = f"{SCHEMES.get(scheme, scheme)}{mark}{rest}"
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class Sink:
    """A file that appears under its name only when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = _open(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        """A file of that name that is there already is left by an earlier run of the same task."""
        self.out.close()
        try:
            self.fs.move(self.temp, self.path)
        except OSError:
            if self.fs.get_file_info(self.path).type != pafs.FileType.File:
                raise
            self.fs.delete_file(self.temp)

    def abort(self) -> None:
        self.out.close()
        self.fs.delete_file(self.temp)


def put(uri: str, data: bytes) -> None:
    sink = Sink(uri)
    sink.write(data)
    sink.commit()


def open_input(uri: str):
    """A file with random access."""
    fs, path = _open(uri)
    return fs.open_input_file(path)


def get(uri: str) -> bytes:
    with open_input(uri) as f:
        return f.read()
