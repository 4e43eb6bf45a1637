"""A Spark data source for arrays in chunks: one partition reads some chunks and gives coordinates and values.

Filters on coordinates reach the source and drop chunks before anything is read;
Spark checks the filters again on the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from gridloom.functions.dtypes import spark_type
from gridloom.operators.frame import ArrayFrame

FORMAT = "gridloom"
#: Bytes of an array that one partition reads, and cells that one batch holds.
PARTITION_BYTES, BATCH_CELLS = 32 << 20, 1 << 20


@dataclass
class Stored:
    """A dataset of a file: ``chunks`` is the shape of a chunk, ``reader`` gives the chunk at some grid place, whole."""

    shape: tuple[int, ...]
    dtype: np.dtype
    chunks: tuple[int, ...]
    attrs: dict = field(default_factory=dict)

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(-(-n // c) if c else 0 for n, c in zip(self.shape, self.chunks))

    def read(self, place: tuple[int, ...]) -> np.ndarray:
        raise NotImplementedError

    def places(self, bounds: dict[int, tuple[int, int]]) -> Iterator[tuple[int, ...]]:
        """Grid places with a cell inside ``bounds``, half-open ranges by axis."""
        spans = []
        for k, (n, c) in enumerate(zip(self.shape, self.chunks)):
            low, high = bounds.get(k, (0, n))
            low, high = max(0, low), min(n, high)
            spans.append(range(low // c, -(-high // c)) if low < high else range(0))
        total = math.prod(map(len, spans))
        for flat in range(total):
            place = []
            for s in reversed(spans):
                place.append(s[flat % len(s)])
                flat //= len(s)
            yield tuple(reversed(place))


def schema_of(stored: Stored) -> T.StructType:
    return T.StructType([*(T.StructField(f"i{k}", T.LongType()) for k in range(len(stored.shape))), T.StructField("v", spark_type(stored.dtype))])


def arrow_values(v: np.ndarray) -> pa.Array:
    """Values in the Arrow type of their Spark type."""
    kind, name = v.dtype.kind, v.dtype.name
    if kind == "c":
        part = v.real.dtype
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v.real), pa.from_numpy_dtype(part)), pa.array(np.ascontiguousarray(v.imag), pa.from_numpy_dtype(part))], ["re", "im"])
    if name == "uint64":
        return pa.array(v.astype(object).tolist(), pa.decimal128(20, 0)) if v.size else pa.array([], pa.decimal128(20, 0))
    wide = {"uint8": np.int16, "uint16": np.int32, "uint32": np.int64, "float16": np.float32}.get(name)
    return pa.array(v.astype(wide) if wide else v)


def batches(block: np.ndarray, origin: tuple[int, ...], shape: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk at ``origin``, cut where it reaches over the array's edge."""
    block = block[tuple(slice(0, max(0, min(b, n - o))) for b, n, o in zip(block.shape, shape, origin))]
    flat = np.ascontiguousarray(block).reshape(-1)
    names = [*(f"i{k}" for k in range(len(shape))), "v"]
    for low in range(0, flat.size, BATCH_CELLS):
        some = np.arange(low, min(flat.size, low + BATCH_CELLS))
        at = np.unravel_index(some, block.shape) if block.ndim else ()
        yield pa.RecordBatch.from_arrays([*(pa.array(a.astype(np.int64) + o) for a, o in zip(at, origin)), arrow_values(flat[some])], names)


class Places(InputPartition):
    def __init__(self, places: list[tuple[int, ...]]):
        super().__init__(places)
        self.places = places


class ChunkReader(DataSourceReader):
    def __init__(self, stored: Stored):
        self.stored = stored
        self.bounds: dict[int, tuple[int, int]] = {}

    def partitions(self) -> list[InputPartition]:
        bytes_each = max(1, math.prod(self.stored.chunks) * self.stored.dtype.itemsize)
        n = max(1, PARTITION_BYTES // bytes_each)
        out, now = [], []
        for place in self.stored.places(self.bounds):
            now.append(place)
            if len(now) == n:
                out.append(Places(now))
                now = []
        if now or not out:
            out.append(Places(now))
        return out

    def read(self, partition: Places) -> Iterator[pa.RecordBatch]:
        for place in partition.places:
            yield from batches(self.stored.read(place), tuple(p * c for p, c in zip(place, self.stored.chunks)), self.stored.shape)


class PruningReader(ChunkReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            yield f
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0].startswith("i") and f.attribute[0][1:].isdigit():
                k, x = int(f.attribute[0][1:]), f.value
                low, high = self.bounds.get(k, (0, self.stored.shape[k]))
                low = max(low, x if isinstance(f, (EqualTo, GreaterThanOrEqual)) else x + 1 if isinstance(f, GreaterThan) else low)
                high = min(high, x + 1 if isinstance(f, (EqualTo, LessThanOrEqual)) else x if isinstance(f, LessThan) else high)
                self.bounds[k] = (low, high)


class ArraySource(DataSource):
    """``spark.read.format("gridloom").option("item", ...).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _stored(self) -> Stored:
        from gridloom.sources.files import find

        return find(self.options["path"], self.options.get("item", ""), self.options.get("as"))

    def schema(self) -> T.StructType:
        return schema_of(self._stored())

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return (PruningReader if self.options.get("prune") == "true" else ChunkReader)(self._stored())


def frame(spark: SparkSession, stored: Stored, path: str, item: str, kind: str) -> ArrayFrame:
    """The lazy array of a stored dataset."""
    spark.dataSource.register(ArraySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    scan = lambda: spark.read.format(FORMAT).option("item", item).option("as", kind).option("prune", "true").schema(schema_of(stored)).load(path)
    return ArrayFrame(scan, stored.shape, stored.dtype, stored.attrs)
