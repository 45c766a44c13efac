"""Helpers shared by the training-data operators: table access, the shared work folder, Arrow plumbing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space between words: U+0020 and U+0009 to U+000D.
SPACES = b" \t\n\x0b\x0c\r"

#: Text handled at once inside one Python task; bounds its memory whatever a batch holds.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``. One whose files give fewer tasks than there are cores is dealt out to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tune(spark: SparkSession) -> None:
    """Small Arrow batches: texts of very different lengths then need little memory in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def work_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder under the shared one that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent in a local session a folder of the machine is set, once a session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="wordloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


_open: list[list[str]] = []


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, so that lost executors cost no recomputation.

    Its folder is the attribute ``path``; inside ``scratch`` it is a temporary table.
    """
    spark = df.sparkSession
    df.write.parquet(path := work_dir(spark, what))
    out = spark.read.schema(df.schema).parquet(path)
    out.path = path
    if _open:
        _open[-1].append(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of ``work_dir`` through Spark's file system, whichever that is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t.path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end; what outlives the block is written after it or inside ``lasting``."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


@contextmanager
def lasting() -> Iterator[None]:
    """Tables written inside stay, whatever ``scratch`` is open."""
    was, _open[:] = list(_open), []
    try:
        yield
    finally:
        _open[:] = was


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 of a string column's values."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` holds about ``most`` bytes each (a longer text stands alone)."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def arrow_map(df: DataFrame, column: str, f: Callable[[pa.RecordBatch], dict], schema: str, setup: Callable | None = None, most: int = CHUNK_BYTES) -> DataFrame:
    """``df.mapInArrow`` over slices of bounded text. ``f`` maps a slice (and what ``setup`` made in the task) to columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (setup(),) if setup else ()
        for batch in batches:
            for part in chunks(batch, column, most):
                out = f(part, *state)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[c.name], pa.Array) and x.type == c.type else pa.array(x, c.type) for c in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def ascii_lower_table(keep: bytes) -> bytes:
    """For ``bytes.translate``: A-Z in lower case, bytes outside ``keep`` and below 0x80 become a space."""
    t = bytearray(range(256))
    for i in range(128):
        t[i] = i if i in keep else 32
    for i in range(65, 91):
        t[i] = i + 32 if i in keep else 32
    return bytes(t)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on arrays of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
