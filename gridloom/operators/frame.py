"""ArrayFrame: a lazy N-dimensional array over a relation of coordinates and values."""

from __future__ import annotations

import threading
import time
import warnings
from concurrent.futures import Future, ThreadPoolExecutor
from functools import reduce as fold

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from gridloom.functions.dtypes import dtype_of, spark_type
from gridloom.operators import reduce as reductions
from gridloom.operators.resolve import Pick, Point, Range, Resolved, resolve

#: What to do when a function has no distributed form and the array must be collected, and from how many bytes on.
POLICY = {"mode": "warn", "threshold": 64 << 20}
#: Rows of an index relation that are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 1 << 18
#: Rows of a block in distributed numbering and running sums.
BLOCK = 1 << 16


#: What arrays delivered to the driver so far: reads, bytes and seconds.
_DELIVERED = {"reads": 0, "bytes": 0, "seconds": 0.0}
_LOCK = threading.Lock()


def stats() -> dict[str, float]:
    """Reads that were delivered to the driver, their bytes, the seconds they took together, and bytes a second."""
    with _LOCK:
        found = dict(_DELIVERED)
    return found | {"throughput": found["bytes"] / found["seconds"] if found["seconds"] else 0.0}


def reset_stats() -> None:
    with _LOCK:
        _DELIVERED.update(reads=0, bytes=0, seconds=0.0)


class FallbackWarning(UserWarning):
    """An array was collected to the driver."""


def set_policy(mode: str = "warn", threshold: int = 64 << 20) -> None:
    """``allow``, ``warn`` or ``error`` for collecting ``threshold`` bytes or more."""
    if mode not in ("allow", "warn", "error"):
        raise ValueError(f"no policy {mode!r}")
    POLICY.update(mode=mode, threshold=threshold)


class ArrayFrame(np.lib.mixins.NDArrayOperatorsMixin):
    """``df`` (or a function that gives it) has long columns i0 ... and v; each cell of ``shape`` has one row, in no order.

    Selecting and reducing give further frames and start no job. ``to_numpy`` is
    the only way to the driver. Operators are NumPy's ufuncs, cell by cell.
    """

    __hash__ = object.__hash__

    def __init__(self, df, shape: tuple[int, ...], dtype, attrs: dict | None = None, lists: DataFrame | None = None, quality: dict | None = None):
        self._df, self.shape, self.dtype = df, tuple(int(n) for n in shape), dtype_of(dtype)
        self.attrs, self._lists, self.applied_quality = attrs or {}, lists, quality or {"codec": "exact"}
        self._of_nothing: str | None = None  # what NaN in this result says, once it is delivered

    # construction

    @classmethod
    def of_lists(cls, df: DataFrame, index: str, column: str, shape: tuple[int, int], dtype, attrs: dict | None = None) -> ArrayFrame:
        """A matrix whose rows are the lists of ``column``, numbered from 0 by ``index``."""
        return cls(None, shape, dtype, attrs, df.select(F.col(index).cast("long").alias("i0"), F.col(column).alias("list")))

    @classmethod
    def of_column(cls, df: DataFrame, index: str, column: str, n: int, dtype, attrs: dict | None = None) -> ArrayFrame:
        """A vector from ``column`` by the dense key ``index``."""
        return cls(df.select(F.col(index).cast("long").alias("i0"), F.col(column).cast(spark_type(dtype_of(dtype))).alias("v")), (n,), dtype, attrs)

    @classmethod
    def of_numpy(cls, spark: SparkSession, array: np.ndarray) -> ArrayFrame:
        array = np.asarray(array)
        dtype = dtype_of(array.dtype)
        schema = T.StructType([*(T.StructField(f"i{k}", T.LongType()) for k in range(array.ndim)), T.StructField("v", spark_type(dtype))])
        return cls(spark.createDataFrame([(*map(int, i), to_spark(x, dtype)) for i, x in np.ndenumerate(array)], schema), array.shape, dtype)

    @classmethod
    def sparse(cls, df: DataFrame, coordinates: list[str], column: str, shape: tuple[int, ...], dtype, fill) -> ArrayFrame:
        """Cells without a row have the value ``fill``."""
        dtype = dtype_of(dtype)
        there = df.select(*(F.col(c).cast("long").alias(f"i{k}") for k, c in enumerate(coordinates)), F.col(column).alias("w"))
        names = [f"i{k}" for k in range(len(shape))]
        cells = grid(df.sparkSession, shape)
        whole = cells.join(there, names, "left").select(*names, F.coalesce("w", F.lit(fill)).cast(spark_type(dtype)).alias("v"))
        return cls(whole, shape, dtype)

    # properties

    @property
    def df(self) -> DataFrame:
        if callable(self._df):  # a scan keeps the filters pushed into it, so each use takes a scan of its own
            return self._df()
        if self._df is None:
            self._df = self._lists.select("i0", F.posexplode("list").alias("p", "v")).select("i0", F.col("p").cast("long").alias("i1"), F.col("v").cast(spark_type(self.dtype)).alias("v"))
        return self._df

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return int(np.prod(self.shape, dtype=object))

    @property
    def nbytes(self) -> int:
        return self.size * self.dtype.itemsize

    @property
    def view(self) -> ArrayFrame:
        """Selections are lazy anyway; the name is there for those who look for it."""
        return self

    def __len__(self) -> int:
        if not self.shape:
            raise TypeError("len() of unsized object")
        return self.shape[0]

    def __iter__(self):
        return (self[k] for k in range(len(self)))

    def __repr__(self) -> str:
        return f"ArrayFrame(shape={self.shape}, dtype={self.dtype.name})"

    def resolve(self, key) -> Resolved:
        return resolve(self.shape, key)

    # selection

    def __getitem__(self, key) -> ArrayFrame:
        if isinstance(key, ArrayFrame):
            return self.masked(key)
        found = self.resolve(key)
        if self._lists is not None and found.out == (("axis", 0), ("axis", 1)) and all(isinstance(a, Range) and a.step > 0 for a in found.axes):
            rows, columns = found.axes
            part = self._lists.where(_within("i0", rows)).select(_renumbered("i0", rows).alias("i0"), _sliced(F.col("list"), columns).alias("list"))
            return ArrayFrame(None, found.shape, self.dtype, self.attrs, part, self.applied_quality)
        df = self.df
        if self._lists is not None and isinstance(found.axes[1], (Point, Range)):
            # the list is cut before it is exploded, which a filter on its positions would not be
            low, high = _bounds(found.axes[1])
            lists = self._lists
            rows = found.axes[0]
            lists = lists.where(_among("i0", rows.at) if isinstance(rows, Pick) else _within("i0", rows))
            df = lists.select("i0", F.posexplode(F.slice("list", low + 1, high - low)).alias("p", "v")).select("i0", (F.col("p") + low).cast("long").alias("i1"), F.col("v").cast(spark_type(self.dtype)).alias("v"))
        return ArrayFrame(_select(df, found), found.shape, self.dtype, self.attrs, quality=self.applied_quality)

    def masked(self, mask: ArrayFrame) -> ArrayFrame:
        """The cells, or rows, where a computed boolean array is true, in order."""
        if mask.dtype != bool or mask.shape != self.shape[: mask.ndim]:
            raise IndexError("boolean index did not match the indexed axes")
        flat = F.lit(0).cast("long")
        for k in range(mask.ndim):
            flat = flat * mask.shape[k] + F.col(f"i{k}")
        true = mask.df.where("v").select(*(f"i{k}" for k in range(mask.ndim)), flat.alias("flat"))
        numbered, n = _numbered(true, "flat")
        names = [f"i{k}" for k in range(mask.ndim)]
        joined = self.df.join(numbered.withColumnRenamed("number", "o"), names)
        rest = [F.col(f"i{k}").alias(f"i{k - mask.ndim + 1}") for k in range(mask.ndim, self.ndim)]
        return ArrayFrame(joined.select(F.col("o").alias("i0"), *rest, "v"), (n, *self.shape[mask.ndim :]), self.dtype)

    def where(self, test) -> ArrayFrame:
        """A boolean array of ``test(v)``; NaN fails every comparison, as in NumPy."""
        v = F.col("v")
        ok = F.coalesce(test(v), F.lit(False))
        if self.dtype.kind == "f":
            ok = ok & ~F.isnan(v)
        return self.map(lambda _: ok, "bool")

    def gather(self, keys) -> DataFrame:
        """All selections in one relation: key number, flat position in that selection, value. Errors come before any job."""
        parts = [self[k] for k in keys]
        rows = [p.df.select(F.lit(n).cast("long").alias("key"), _flat(p.shape).alias("at"), "v") for n, p in enumerate(parts)]
        return fold(DataFrame.unionByName, rows)

    def gather_numpy(self, keys) -> list[np.ndarray]:
        """All selections as arrays, by one job."""
        keys = list(keys)
        if not keys:
            return []
        parts = [self[k] for k in keys]
        _guard(sum(p.nbytes for p in parts), "gather")
        out = [np.zeros(p.size, self.dtype) for p in parts]
        rows = self.gather(keys).toPandas()
        for n, part in rows.groupby("key"):
            out[n][part["at"].to_numpy()] = from_spark(part["v"], self.dtype)
        return [o.reshape(p.shape) for o, p in zip(out, parts)]

    # reductions and functions

    def reduce(self, function: str, axis=None, keepdims: bool = False, ddof: float = 0, dtype=None, where=None, initial=None) -> ArrayFrame:
        """A NumPy reduction. ``where`` is a boolean array of the same shape; ``initial`` joins sum, prod, max and min."""
        if float(ddof) != int(ddof):
            raise ValueError("ddof must be whole")
        if self.size == 0 and function in ("mean", "nanmean", "var", "std"):
            warnings.warn("Mean of empty slice", RuntimeWarning, stacklevel=2)
        name = reductions.ALIASES.get(function, function)
        if where is not None and initial is None and name in ("max", "min", "nanmax", "nanmin"):
            raise ValueError(f"reduction operation {name!r} does not have an identity, so to use a where mask one has to specify 'initial'")
        if self.size and name in ("var", "std") and where is None and int(np.prod([self.shape[a] for a in reductions.reduced_axes(axis, self.ndim)], dtype=object)) <= ddof:
            warnings.warn("Degrees of freedom <= 0 for slice", RuntimeWarning, stacklevel=2)
        if dtype is not None:
            return self.astype(dtype).reduce(function, axis, keepdims, ddof, None, where, initial)
        if where is None and initial is None and self._lists is not None and axis in (1, -1) and not keepdims and (quick := self._along_lists(function)) is not None:
            return quick
        df = self.df
        if where is not None:
            names = [f"i{k}" for k in range(self.ndim)]
            df = df.join(where.df.where("v").select(*names), names, "left_semi")
        out, shape, kind = reductions.reduce(df, self.shape, self.dtype, function, axis, keepdims, ddof)
        found = ArrayFrame(out, shape, kind)
        if where is not None and shape:
            empty = {"sum": 0, "nansum": 0, "prod": 1, "all": True, "any": False, "count_nonzero": 0}.get(function, float("nan") if initial is None else initial)
            found = ArrayFrame.sparse(out, [f"i{k}" for k in range(len(shape))], "v", shape, kind, empty)
        if self.dtype.kind in "fc" and initial is None:
            found._of_nothing = {"nanmax": "All-NaN slice encountered", "nanmin": "All-NaN slice encountered", "nanmedian": "All-NaN slice encountered", "nanmean": "Mean of empty slice"}.get(name)
        if initial is not None:
            nan = lambda v: F.isnan(v.cast("double")) if found.dtype.kind == "f" else F.lit(False)
            first = F.lit(initial)
            extreme = lambda pick: lambda v: F.when(nan(v) | F.isnan(first.cast("double")), F.lit(float("nan"))).otherwise(pick(v, first)) if found.dtype.kind == "f" else pick(v, first)
            join = {"sum": lambda v: v + initial, "prod": lambda v: v * initial, "max": extreme(F.greatest), "min": extreme(F.least)}[name]
            found = found.map(join, kind)
        return found

    def _along_lists(self, function: str) -> ArrayFrame | None:
        """Rows reduced inside their lists, without exploding them; the plain float cases."""
        n = self.shape[1]
        if self.dtype.kind != "f" or n == 0 or function not in ("sum", "mean"):
            return None
        total = F.aggregate("list", F.lit(0.0), lambda a, x: a + x.cast("double"))
        value = total / n if function == "mean" else total
        return ArrayFrame(self._lists.select("i0", value.cast(spark_type(self.dtype)).alias("v")), self.shape[:1], self.dtype)

    def map(self, function, dtype=None) -> ArrayFrame:
        """``function`` of the value column, cell by cell."""
        dtype = dtype_of(dtype or self.dtype)
        return ArrayFrame(self.df.select(*(f"i{k}" for k in range(self.ndim)), function(F.col("v")).cast(spark_type(dtype)).alias("v")), self.shape, dtype, self.attrs)

    def astype(self, dtype) -> ArrayFrame:
        return self.map(lambda v: v, dtype)

    def combine(self, other: ArrayFrame, function, dtype=None) -> ArrayFrame:
        """``function`` of both values cell by cell; axes of length 1 and those that one side lacks meet every place of the other's, as in NumPy."""
        shape = np.broadcast_shapes(self.shape, other.shape)
        dtype = dtype_of(dtype or np.result_type(self.dtype, other.dtype))
        if self is other:
            return self.map(lambda v: function(v, v), dtype)
        ndim = len(shape)
        ours, theirs = ((None,) * (ndim - x.ndim) + x.shape for x in (self, other))
        left = self.df.select(*(F.col(f"i{k}").alias(f"i{k + ndim - self.ndim}") for k in range(self.ndim)), "v")
        right = other.df.select(*(F.col(f"i{k}").alias(f"j{k + ndim - other.ndim}") for k in range(other.ndim)), F.col("v").alias("w"))
        shared = [k for k in range(ndim) if ours[k] == theirs[k] and shape[k] != 1]
        if shared:
            both = left.join(right, fold(Column.__and__, (left[f"i{k}"] == right[f"j{k}"] for k in shared)))
        else:
            both = left.crossJoin(right)  # an outer product, whose every pair is a cell, or a single value
        place = [F.col(f"i{k}") if ours[k] == n and ours[k] is not None else F.col(f"j{k}") for k, n in enumerate(shape)]
        return ArrayFrame(both.select(*(p.alias(f"o{k}") for k, p in enumerate(place)), function(F.col("v"), F.col("w")).cast(spark_type(dtype)).alias("v")).toDF(*(f"i{k}" for k in range(ndim)), "v"), shape, dtype)

    def reshape(self, *shape: int) -> ArrayFrame:
        if int(np.prod(shape, dtype=object)) != self.size:
            raise ValueError(f"cannot reshape {self.shape} into {shape}")
        rest, columns = F.col("flat"), []
        for k in range(len(shape) - 1, -1, -1):
            columns.append((rest % shape[k]).alias(f"i{k}"))
            rest = F.expr("1L") * F.floor(rest / shape[k]) if shape[k] else rest
        return ArrayFrame(self.df.select(_flat(self.shape).alias("flat"), "v").select(*reversed(columns), "v"), shape, self.dtype)

    # reduced precision

    def at(self, dtype=None, abs_error: float | None = None, rel_error: float | None = None, codec: str | None = None) -> ArrayFrame:
        """The array at a lower quality: a narrower float type, or values within ``abs_error``; what can't be had is given exactly, with a warning."""
        asked = [x is not None for x in (dtype, abs_error, rel_error)]
        if sum(asked) > 1:
            raise ValueError("at most one of dtype, abs_error and rel_error")
        if not any(asked) and codec is None:
            raise ValueError("ask for dtype, abs_error, rel_error or codec")
        if codec not in (None, "gzip", "raw"):
            warnings.warn(f"codec {codec!r} is not known; values are exact", stacklevel=2)
        applied = {"codec": codec if codec == "gzip" else "exact"}
        out = self
        if dtype is not None and (self.dtype.name, np.dtype(dtype).name) in (("float64", "float32"), ("float32", "float16")):
            out, applied["dtype"] = self.map((lambda v: v.cast("float")) if self.dtype.name == "float64" else _half, dtype), np.dtype(dtype).name
        elif abs_error is not None and self.dtype.name in ("float32", "float64") and np.isfinite(abs_error) and abs_error > 0:
            out, applied["abs_error"] = self.map(lambda v: within(v, abs_error, self.dtype)), float(abs_error)
        elif any(asked):
            warnings.warn("the quality asked for can't be had; values are exact", stacklevel=2)
        return ArrayFrame(out.df, self.shape, out.dtype, self.attrs, quality=applied)

    # to the driver

    def to_numpy(self) -> np.ndarray:
        """The array, read-only and in C order."""
        start = time.perf_counter()
        out = np.zeros(self.size, self.dtype)
        rows = self.df.select(_flat(self.shape).alias("at"), "v").toPandas()
        out[rows["at"].to_numpy(np.int64)] = from_spark(rows["v"], self.dtype)
        out = out.reshape(self.shape)
        with _LOCK:
            for name, value in (("reads", 1), ("bytes", out.nbytes), ("seconds", time.perf_counter() - start)):
                _DELIVERED[name] += value
        if self._of_nothing and np.isnan(out).any():
            warnings.warn(self._of_nothing, RuntimeWarning, stacklevel=2)
        out.flags.writeable = False
        return out

    def __array__(self, dtype=None, copy=None):
        _guard(self.nbytes, "conversion to an array")
        found = self.to_numpy()
        return found.astype(dtype) if dtype is not None and dtype != found.dtype else found

    def read_into(self, out: np.ndarray, key=()) -> np.ndarray:
        """The selection, written into a C-contiguous array of its shape and type."""
        part = self[key]
        if not isinstance(out, np.ndarray) or out.shape != part.shape or out.dtype != self.dtype or not out.flags.c_contiguous or not out.flags.writeable:
            raise ValueError(f"the buffer must be writable and C-contiguous, of shape {part.shape} and type {self.dtype.name}")
        out[...] = part.to_numpy()
        return out

    def read_as(self, dtype, key=()) -> np.ndarray:
        """The selection as an array, if its type is ``dtype``; TypeError before any job otherwise."""
        if dtype_of(dtype) != self.dtype:
            raise TypeError(f"the array is of {self.dtype.name}, not of {np.dtype(dtype).name}")
        return self[key].to_numpy()

    def get_async(self, key) -> Future:
        """The selection as an array, by a job of its own thread."""
        return _POOL.submit(lambda part: part.to_numpy(), self[key])

    # NumPy's protocols

    def __array_function__(self, function, types, args, kwargs):
        from gridloom.functions.numpy_api import dispatch

        return dispatch(function, args, kwargs)

    def __array_ufunc__(self, ufunc, method, *inputs, **kwargs):
        from gridloom.functions.numpy_api import ufunc_call

        return ufunc_call(ufunc, method, inputs, kwargs)


_POOL = ThreadPoolExecutor(4, thread_name_prefix="gridloom")


def _guard(nbytes: int, what: str) -> None:
    if nbytes >= POLICY["threshold"]:
        if POLICY["mode"] == "error":
            raise MemoryError(f"{what} would collect {nbytes} bytes")
        if POLICY["mode"] == "warn":
            warnings.warn(f"{what} collects {nbytes} bytes", FallbackWarning, stacklevel=3)


def grid(spark: SparkSession, shape: tuple[int, ...]) -> DataFrame:
    """Every coordinate of ``shape``."""
    rest, columns = F.col("id"), []
    for k in range(len(shape) - 1, -1, -1):
        columns.append((rest % F.lit(shape[k]) if shape[k] else rest).alias(f"i{k}"))
        rest = F.expr("1L") * F.floor(rest / shape[k]) if shape[k] else rest
    return spark.range(int(np.prod(shape, dtype=object))).select(*reversed(columns))


def _flat(shape: tuple[int, ...]) -> Column:
    out = F.lit(0).cast("long")
    for k, n in enumerate(shape):
        out = out * n + F.col(f"i{k}")
    return out


def _bounds(axis) -> tuple[int, int]:
    if isinstance(axis, Point):
        return axis.at, axis.at + 1
    if not axis.length:
        return 0, 0
    last = axis.start + axis.step * (axis.length - 1)
    return min(axis.start, last), max(axis.start, last) + 1


def _within(name: str, axis) -> Column:
    low, high = _bounds(axis)
    if isinstance(axis, Point):
        return F.col(name) == axis.at
    if not axis.length:
        return F.lit(False)
    inside = (F.col(name) >= low) & (F.col(name) < high)
    return inside if abs(axis.step) == 1 else inside & ((F.col(name) - axis.start) % axis.step == 0)


def _among(name: str, at: tuple[int, ...]) -> Column:
    """A filter that reaches the scan: the places of an index array if they are few, else their bounds."""
    places = sorted(set(at))
    if not places:
        return F.lit(False)
    return F.col(name).isin(places) if len(places) <= 64 else F.col(name).between(places[0], places[-1])


def _renumbered(name: str, axis: Range) -> Column:
    shifted = F.col(name) - axis.start
    return shifted if axis.step == 1 else F.expr(f"(`{name}` - {axis.start}L) div {axis.step}")


def _sliced(values: Column, axis: Range) -> Column:
    low, high = _bounds(axis)
    part = F.slice(values, low + 1, high - low)
    return part if axis.step == 1 or axis.length < 2 else F.filter(part, lambda _, k: k % axis.step == 0)


def _select(df: DataFrame, found: Resolved) -> DataFrame:
    names = [f"i{k}" for k in range(len(found.axes))]
    picks = {k: a.at for k, a in enumerate(found.axes) if isinstance(a, Pick)}
    for k, axis in enumerate(found.axes):
        df = df.where(_among(names[k], picks[k]) if k in picks else _within(names[k], axis))
    if picks:
        columns = [names[k] for k in picks]
        rows = [(n, *(int(at[n]) for at in picks.values())) for n in range(found.picked)]
        index = df.sparkSession.createDataFrame(rows, T.StructType([T.StructField(c, T.LongType()) for c in ("pick", *columns)]))
        df = df.join(F.broadcast(index) if found.picked <= BROADCAST_ROWS else index, columns)
    out = []
    for n, entry in enumerate(found.out):
        if entry[0] == "axis":
            out.append(_renumbered(names[entry[1]], found.axes[entry[1]]).cast("long").alias(f"i{n}"))
        else:
            out.append((F.col("pick") if entry[0] == "pick" else F.lit(0).cast("long")).alias(f"i{n}"))
    return df.select(*out, "v")


def _numbered(df: DataFrame, by: str) -> tuple[DataFrame, int]:
    """``number`` from 0 in the order of the long column ``by``, and how many rows there are.

    Rows are counted by block of ``BLOCK`` places, only the counts are summed in
    order, and rows are numbered inside their block, so no task sees all rows.
    """
    block = F.expr(f"`{by}` div {BLOCK}")
    counts = df.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    before = counts.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("block").orderBy(by)) - 1
    out = df.withColumn("block", block).withColumn("inside", inside).join(before, "block").withColumn("number", F.col("before") + F.col("inside")).drop("block", "before", "inside", by)
    return out, counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def to_spark(x, dtype: np.dtype):
    if dtype.kind == "c":
        return (float(x.real), float(x.imag))
    if dtype.name == "uint64":
        import decimal

        return decimal.Decimal(int(x))
    return bool(x) if dtype.kind == "b" else float(x) if dtype.kind == "f" else int(x)


def from_spark(values, dtype: np.dtype) -> np.ndarray:
    if dtype.kind == "c":
        return np.array([complex(v["re"], v["im"]) for v in values], dtype)
    if dtype.name == "uint64":
        return np.array([int(v) for v in values], dtype)
    return values.to_numpy().astype(dtype)


def within(v: Column, bound: float, dtype: np.dtype) -> Column:
    """A value near ``v`` by ``bound`` at most that takes few distinct values; ``v`` itself where rounding would break the bound."""
    x = v.cast("double")
    near = (F.rint(x / (2 * bound)) * (2 * bound)).cast(spark_type(dtype))
    return F.when(F.abs(near.cast("double") - x) <= bound, near).otherwise(v)


@F.pandas_udf(T.FloatType())
def _half(v):
    return v.astype("float16").astype("float32")
