"""NumPy's own functions on ArrayFrames: distributed where there is a form, collected otherwise."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F

from gridloom.functions.dtypes import dtype_of, result_dtype, spark_type, wrapped
from gridloom.operators.frame import BLOCK, BROADCAST_ROWS, ArrayFrame, _guard
from gridloom.operators.reduce import reduced_axes

_REDUCTIONS = {getattr(np, n): n for n in ("sum", "prod", "mean", "max", "min", "amax", "amin", "nanmax", "nanmin", "nansum", "nanmean", "var", "std", "all", "any", "argmax", "argmin", "count_nonzero", "median", "nanmedian", "ptp")}
_UNARY = {
    np.sqrt: F.sqrt, np.exp: F.exp, np.log: F.log, np.log2: F.log2, np.log10: F.log10, np.log1p: F.log1p, np.expm1: F.expm1,
    np.sin: F.sin, np.cos: F.cos, np.tan: F.tan, np.tanh: F.tanh, np.floor: F.floor, np.ceil: F.ceil, np.rint: F.rint,
    np.absolute: F.abs, np.negative: F.negative, np.square: lambda v: v * v, np.sign: F.signum,
}
_BINARY = {
    np.add: lambda a, b: a + b, np.subtract: lambda a, b: a - b, np.multiply: lambda a, b: a * b, np.true_divide: lambda a, b: F.try_divide(a, b),
    np.maximum: F.greatest, np.minimum: F.least, np.power: F.pow,
}
#: For booleans; Spark's logic has no surprises without nulls.
_LOGIC = {np.bitwise_and: lambda a, b: a & b, np.logical_and: lambda a, b: a & b, np.bitwise_or: lambda a, b: a | b, np.logical_or: lambda a, b: a | b, np.bitwise_xor: lambda a, b: a != b, np.logical_xor: lambda a, b: a != b}
#: For integers, exactly before they wrap around.
_WHOLE = {
    np.add: lambda a, b: a + b, np.subtract: lambda a, b: a - b, np.multiply: lambda a, b: a * b, np.maximum: F.greatest, np.minimum: F.least,
    np.negative: lambda v: -v, np.absolute: F.abs, np.square: lambda v: v * v,
}
_COMPARISONS = {
    np.greater: lambda a, b: a > b, np.greater_equal: lambda a, b: a >= b, np.less: lambda a, b: a < b, np.less_equal: lambda a, b: a <= b,
    np.equal: lambda a, b: a == b, np.not_equal: lambda a, b: a != b,
}


def _log(function):
    """Spark's logarithms are null where NumPy's are NaN or -inf."""
    return lambda v: F.when(v == 0, F.lit(float("-inf"))).when(v < 0, F.lit(float("nan"))).otherwise(function(v))


def _whole(function):
    """Spark's floor and ceil give integers, which NaN and very large values are not."""
    return lambda v: F.when(F.isnan(v) | (F.abs(v) >= 2.0**52), v.cast("double")).otherwise(function(v).cast("double"))


def _log1p(v):
    return F.when(v == -1, F.lit(float("-inf"))).when(v < -1, F.lit(float("nan"))).otherwise(F.log1p(v))


def _with_nan(form):
    """NaN on either side gives NaN; Spark's least would pass it over."""
    return lambda a, b: F.when(F.isnan(a.cast("double")) | F.isnan(b.cast("double")), F.lit(float("nan"))).otherwise(form(a, b))


def _integers(form, dtype: np.dtype):
    """``form`` of integers cast to ``dtype`` modulo its size."""
    if dtype.itemsize == 8:
        return lambda *values: wrapped(form(*(v.cast("decimal(20,0)") for v in values)).cast("decimal(38,0)"), False)
    low, span = int(np.iinfo(dtype).min), 1 << 8 * dtype.itemsize
    return lambda *values: F.pmod(form(*(v.cast("long") for v in values)) - low, F.lit(span)) + low


_UNARY[np.log1p] = _log1p
for _name in (np.floor, np.ceil):
    _UNARY[_name] = _whole(_UNARY[_name])
for _name in (np.maximum, np.minimum):
    _BINARY[_name] = _with_nan(_BINARY[_name])
for _name in (np.log, np.log2, np.log10):
    _UNARY[_name] = _log(_UNARY[_name])


def ufunc_call(ufunc, method, inputs, kwargs):
    """The ufunc cell by cell where it has a form for the types, with NumPy's broadcasting; else on collected arrays."""
    if method == "__call__" and not kwargs:
        frame = next(x for x in inputs if isinstance(x, ArrayFrame))
        spark = frame.df.sparkSession
        # small arrays beside a frame join it
        own = [ArrayFrame.of_numpy(spark, x) if isinstance(x, np.ndarray) and 0 < x.ndim and x.size <= BROADCAST_ROWS and x.dtype.kind in "biuf" else x for x in inputs]
        frames = [x for x in own if isinstance(x, ArrayFrame)]
        plain = all(isinstance(x, ArrayFrame) or np.ndim(x) == 0 and not isinstance(x, np.ndarray) for x in own)
        if plain and all(f.dtype.kind in "biuf" and f.dtype.name not in ("uint64", "float16") for f in frames):
            form, dtype = _form(ufunc, own, frames)
            if form is not None:
                if len(own) == 1:
                    return own[0].map(form, dtype)
                a, b = own
                if len(frames) == 2:
                    return a.combine(b, form, dtype)
                # a number of Python's own takes the type of floats beside it
                lit = lambda x: F.lit(x.item() if isinstance(x, np.generic) else x).cast(spark_type(frame.dtype) if frame.dtype.kind == "f" and type(x) in (int, float) else spark_type(dtype_of(np.asarray(x).dtype)))
                return a.map(lambda v: form(v, lit(b)), dtype) if isinstance(a, ArrayFrame) else b.map(lambda v: form(lit(a), v), dtype)
    return getattr(ufunc, method)(*map(collected, inputs), **kwargs)


def _form(ufunc, own, frames):
    """The ufunc as a column expression and the type of its result, or None."""
    kinds = {f.dtype.kind for f in frames}
    if ufunc is np.logical_not and kinds == {"b"} or ufunc is np.invert and kinds == {"b"}:
        return (lambda v: ~v), np.dtype(bool)
    if ufunc in _LOGIC and kinds == {"b"} and all(isinstance(x, (ArrayFrame, bool, np.bool_)) for x in own):
        return _LOGIC[ufunc], np.dtype(bool)
    if ufunc in _COMPARISONS:
        dtype = ufunc(*(np.ones(1, x.dtype) if isinstance(x, ArrayFrame) else x for x in own)).dtype
        return (_honest(_COMPARISONS[ufunc], ufunc, frames, own), dtype) if "b" not in kinds or kinds == {"b"} and len(frames) == 2 else (None, None)
    if ufunc not in _UNARY and ufunc not in _BINARY or len(own) != (1 if ufunc in _UNARY else 2):
        return None, None
    dtype = ufunc(*(np.ones(1, x.dtype) if isinstance(x, ArrayFrame) else x for x in own)).dtype if kinds != {"b"} or ufunc not in (np.negative, np.subtract) else None
    if dtype is None or dtype.name in ("uint64", "float16"):
        return None, None
    if dtype.kind in "iu":
        return (_integers(_WHOLE[ufunc], dtype), dtype) if ufunc in _WHOLE and "b" not in kinds else (None, None)
    if dtype.kind != "f":
        return None, None
    if ufunc is np.true_divide:
        return _divide, dtype
    form = _UNARY.get(ufunc) or _BINARY[ufunc]
    number = lambda v: v.cast("int") if "b" in kinds else v
    return (lambda *values: form(*map(number, values))), dtype


def _divide(a, b):
    a, b = a.cast("double"), b.cast("double")
    below = b.cast("string").startswith("-")  # tells -0.0 from 0.0
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when((a > 0) != below, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def _honest(form, ufunc, frames, own):
    """Comparisons with NaN are false, but for not_equal."""
    if not any(f.dtype.kind == "f" for f in frames) and not any(isinstance(x, float) for x in own):
        return form

    def test(a, b):
        odd = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
        return form(a, b) | odd if ufunc is np.not_equal else form(a, b) & ~odd

    return test


def collected(x):
    """ArrayFrames as arrays, inside lists and tuples too; each distinct one once."""
    seen: dict[int, np.ndarray] = {}

    def one(x):
        if isinstance(x, ArrayFrame):
            if id(x) not in seen:
                _guard(x.nbytes, "a function without a distributed form")
                seen[id(x)] = x.to_numpy()
            return seen[id(x)]
        return type(x)(map(one, x)) if isinstance(x, (list, tuple)) else x

    return one(x)


def dispatch(function, args, kwargs):
    first = args[0] if args else None
    if function in _REDUCTIONS and isinstance(first, ArrayFrame) and set(kwargs) <= {"axis", "keepdims", "ddof", "dtype", "where", "initial"} and len(args) <= 2:
        more = {k: v for k, v in kwargs.items() if v is not np._NoValue}
        if len(args) == 2:
            more["axis"] = args[1]
        name = _REDUCTIONS[function]
        if not (name == "ptp" and first.dtype.kind == "c") and not (name in ("median", "nanmedian") and first.dtype.kind == "c"):
            return first.reduce(name, **more)
    if function is np.cumsum and isinstance(first, ArrayFrame) and first.dtype.kind in "biuf" and first.dtype.name != "uint64" and set(kwargs) <= {"axis"}:
        return cumulative(first, kwargs.get("axis", args[1] if len(args) > 1 else None))
    if function is np.cumprod and isinstance(first, ArrayFrame) and first.dtype.name in ("float32", "float64") and set(kwargs) <= {"axis"} and len(args) <= 2:
        return cumulative(first, kwargs.get("axis", args[1] if len(args) > 1 else None), True)
    if function in (np.sort, np.argsort) and isinstance(first, ArrayFrame) and first.dtype.kind in "biuf" and set(kwargs) <= {"axis"}:
        return ordered(first, kwargs.get("axis", args[1] if len(args) > 1 else -1), function is np.argsort)
    if function is np.concatenate and all(isinstance(a, ArrayFrame) for a in first) and set(kwargs) <= {"axis"}:
        return concatenated(list(first), kwargs.get("axis", args[1] if len(args) > 1 else 0))
    if function in (np.shape, np.ndim, np.size) and len(args) == 1 and not kwargs:
        return {np.shape: first.shape, np.ndim: first.ndim, np.size: first.size}[function]
    return function(*collected(list(args)), **collected(tuple(kwargs.values())) and {k: collected(v) for k, v in kwargs.items()} or {})


def cumulative(a: ArrayFrame, axis, product: bool = False) -> ArrayFrame:
    """Running sums, or products of floats, along an axis, or over the whole array in C order.

    Blocks of ``BLOCK`` places are summed in order first; then each block
    runs on its own, so a long vector is no single task.
    """
    if axis is None:
        a, axis = a.reshape(a.size), 0
    axis = reduced_axes(axis, a.ndim)[0]
    others = [f"i{k}" for k in range(a.ndim) if k != axis]
    dtype = result_dtype("prod" if product else "sum", a.dtype)
    total, join = (F.product, lambda x, y: x * y) if product else (F.sum, lambda x, y: x + y)
    v = F.col("v").cast("double" if a.dtype.kind == "f" else "long")
    rows = a.df.withColumn("block", F.expr(f"i{axis} div {BLOCK}"))
    run = total(v).over(Window.partitionBy(*others, "block").orderBy(f"i{axis}").rowsBetween(Window.unboundedPreceding, 0))
    if a.shape[axis] <= BLOCK:
        return ArrayFrame(rows.select(*(f"i{k}" for k in range(a.ndim)), run.cast(spark_type(dtype)).alias("v")), a.shape, dtype)
    blocks = rows.groupBy(*others, "block").agg(total(v).alias("s"))
    ahead = total("s").over(Window.partitionBy(*others).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    before = blocks.select(*others, "block", F.coalesce(ahead, F.lit(1 if product else 0)).alias("before"))
    out = rows.withColumn("run", run).join(before, [*others, "block"])
    return ArrayFrame(out.select(*(f"i{k}" for k in range(a.ndim)), join(F.col("run"), F.col("before")).cast(spark_type(dtype)).alias("v")), a.shape, dtype)


def ordered(a: ArrayFrame, axis, places: bool) -> ArrayFrame:
    """Sorted values along an axis, NaN last, or the places that they had; ties keep their order."""
    if axis is None:
        a, axis = a.reshape(a.size), 0
    axis = reduced_axes(axis, a.ndim)[0]
    others = [f"i{k}" for k in range(a.ndim) if k != axis]
    rank = F.row_number().over(Window.partitionBy(*others).orderBy("v", f"i{axis}")) - 1
    value = F.col(f"i{axis}") if places else F.col("v")
    out = a.df.select(*(rank.cast("long").alias(f"i{k}") if k == axis else F.col(f"i{k}") for k in range(a.ndim)), value.alias("v"))
    return ArrayFrame(out, a.shape, dtype_of("int64") if places else a.dtype)


def concatenated(parts: list[ArrayFrame], axis: int) -> ArrayFrame:
    """The arrays end to end along an axis."""
    axis = reduced_axes(axis, parts[0].ndim)[0]
    dtype = dtype_of(np.result_type(*(p.dtype for p in parts)))
    trim = lambda s: (*s[:axis], *s[axis + 1 :])
    if any(p.ndim != parts[0].ndim or trim(p.shape) != trim(parts[0].shape) for p in parts):
        raise ValueError("all the input array dimensions except for the concatenation axis must match exactly")
    out, at = None, 0
    for p in parts:
        moved = p.astype(dtype).df.withColumn(f"i{axis}", F.col(f"i{axis}") + at)
        out, at = moved if out is None else out.unionByName(moved), at + p.shape[axis]
    return ArrayFrame(out, (*parts[0].shape[:axis], at, *parts[0].shape[axis + 1 :]), dtype)
