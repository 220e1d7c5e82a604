"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  for pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[^\x20\x09-\x0D]+``: a word is a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where none is named and everything runs in this process (a local
    test) a temporary folder is made and set, so that later calls agree on
    it; elsewhere executors would write to disks of their own, so it raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="wavequarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def store(df: DataFrame, tag: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """``df`` written as a table in the shared folder and read back, and the table's path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    return store(df, tag, compression)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``store`` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread_join(left: DataFrame, key: str, right: DataFrame, of: str, n: str, total: int, keys: int = 1000, merge: bool = False) -> DataFrame:
    """``left`` joined with ``right`` on ``key = of``, no key in one task.

    ``right`` has one row for each ``of`` and tells in ``n`` how many rows of
    ``left`` have it, ``total`` in all.  Those of more than one in ``keys``
    rows are at most ``keys`` rows of ``right``: these are broadcast, and only
    the others are joined as Spark sees fit, or with ``merge`` shuffled at any
    size.
    """
    limit = max(64, total // keys)
    hot = right.where(F.col(n) > limit)
    marked = left.join(F.broadcast(hot.select(F.col(of).alias("__hot"))), F.col(key) == F.col("__hot"), "left")
    some = left.join(F.broadcast(hot), F.col(key) == F.col(of))
    rest = right.where(F.col(n) <= limit)
    return some.unionByName(marked.where("__hot IS NULL").drop("__hot").join(rest.hint("merge") if merge else rest, F.col(key) == F.col(of)))


def release_memory() -> None:
    """Hand freed memory back to the system, as a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def full_text(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def cut_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes.

    Rows are never split, so a slice may be larger by one row.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        begin, held = 0, 0
        for i, n in enumerate(lengths):
            held += n
            if held >= limit:
                yield batch.slice(begin, i + 1 - begin)
                begin, held = i + 1, 0
        if begin < batch.num_rows:
            yield batch.slice(begin)
