"""Shared intermediate tables, groups in Arrow streams, and session settings."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where it is unset, a folder of this machine if that is the whole cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Store:
    """Writes tables to the shared folder and reads them back, which cuts lineage and survives lost executors.

    A table is dropped by ``drop`` once a later one replaces it; the folder's owner clears what results still read.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/gridloom-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._kept_at = path
        return back

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_kept_at", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            with contextlib.suppress(Exception):
                there = jvm.org.apache.hadoop.fs.Path(path)
                there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)

    def forget(self) -> None:
        """Has the driver notice which shuffles nothing refers to any more, so that their files go before more are written."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the n + 1 row offsets of the groups in each.

    The stream is sorted by integer ``keys``; held are one batch and the group that it leaves open.
    """

    def cuts(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table) - 1, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            new |= v[1:] != v[:-1]
        return np.flatnonzero(new) + 1

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(held[-1].column(k)[-1] == batch.column(k)[0] == batch.column(k)[-1] for k in map(batch.schema.get_field_index, keys)):
            held.append(batch)  # the open group goes on through the whole batch
            continue
        table = pa.Table.from_batches([*held, batch])
        at = cuts(table)
        if not len(at):
            held = table.to_batches()
            continue
        yield table.slice(0, at[-1]), np.r_[0, at]
        held = table.slice(at[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.r_[0, cuts(table), len(table)]


def grouped(df: DataFrame, keys: list[str], then: Callable, schema: str, parts: int | None = None) -> DataFrame:
    """``then`` over each sorted partition dealt by ``keys``, as a stream of Arrow batches."""
    n = parts or partitions(df.sparkSession)
    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(then, schema)


def join_by_size(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` with what ``table`` knows of their ``keys``: one row for each key, with the number of its rows in ``size``.

    What is known of keys that hold more than a thousandth of the ``total`` rows is
    sent to all tasks; there are at most a thousand. In the shuffle that joins the
    others the rows of these keys are spread by their own hash.
    """
    limit = max(1, total // 1000)
    known = F.struct(*(c for c in table.columns if c not in keys))
    hot = table.where(F.col(size) > limit).select(*keys, known.alias("_hot"))
    cold = table.where(F.col(size) <= limit).select(*keys, F.least(F.col(size).cast("long"), F.lit(0)).alias("_part"), known.alias("_cold"))  # 0; a literal would be folded out of the join's keys
    parted = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30))))
    joined = parted.join(cold, [*keys, "_part"], "left").withColumn("_known", F.coalesce("_hot", "_cold")).where(F.col("_known").isNotNull())
    return joined.select(*rows.columns, "_known.*")


def keep_rows(df: DataFrame, make: Callable[[], Callable]) -> DataFrame:
    """The rows of ``df`` that the function which ``make`` gives in each task wants kept, from their text column.

    Only the texts go to Python and only a mark comes back; the other columns stay where they are.
    """

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        wanted = make()
        for column in columns:
            yield pa.array(np.asarray(wanted(column), bool))

    return df.where(F.arrow_udf(run, "boolean")(df["text"]))


def release() -> None:
    """Hands memory that the allocators hold back to the machine, after a task that took much."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
