"""NumPy reductions as grouped aggregations over coordinates.

An array is a relation of coordinates i0, i1, ... and a value v, so reducing axes
is grouping by the others, with partial sums before the shuffle. Spark's NULL of
an empty group becomes NumPy's answer, and NaN follows NumPy's rules.
"""

from __future__ import annotations

import decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridloom.functions.dtypes import result_dtype, spark_type, wrapped

FUNCTIONS = ("sum", "prod", "mean", "max", "min", "nanmax", "nanmin", "nansum", "nanmean", "var", "std", "all", "any", "argmax", "argmin", "count_nonzero", "median", "nanmedian", "ptp")
ALIASES = {"amax": "max", "amin": "min"}
#: Functions without an answer for no elements.
NEED_ONE = ("max", "min", "nanmax", "nanmin", "argmax", "argmin", "ptp")


def reduced_axes(axis, ndim: int) -> tuple[int, ...]:
    """The axes as a sorted tuple; None means all, an empty tuple none."""
    if axis is None:
        return tuple(range(ndim))
    out = []
    for a in axis if isinstance(axis, tuple) else (axis,):
        a = int(a)
        if not -ndim <= a < ndim:
            raise np.exceptions.AxisError(a, ndim)
        out.append(a % ndim)
    if len(set(out)) != len(out):
        raise ValueError("duplicate value in 'axis'")
    return tuple(sorted(out))


def _number(v: Column, kind: str) -> Column:
    return v.cast("int") if kind == "b" else v


def _isnan(v: Column, kind: str) -> Column:
    return F.isnan(v) if kind == "f" else F.isnan(v.re) | F.isnan(v.im) if kind == "c" else F.lit(False)


@F.pandas_udf(T.LongType())
def _wrapping_product(v: pd.Series) -> int:
    with np.errstate(over="ignore"):
        return int(np.multiply.reduce(np.array([int(x) % (1 << 64) for x in v], np.uint64)).astype(np.int64))


def _partial_products(batches):
    """One wrapping product for each task's rows, so that a long array doesn't meet in one task."""
    out = 1
    for batch in batches:
        for x in batch.column(0).to_pylist():
            out = out * int(x) % (1 << 64)
    yield pa.RecordBatch.from_arrays([pa.array([decimal.Decimal(out)], pa.decimal128(20, 0))], ["v"])


def aggregate(function: str, dtype: np.dtype, position: Column, ddof: float = 0) -> Column:
    """The aggregate of column v; ``position`` is the place that arg-extremes answer with."""
    v, kind = F.col("v"), dtype.kind
    nan, no_number = _isnan(v, kind), F.lit(float("nan"))
    if function == "sum" or (function == "nansum" and kind in "biu"):
        if kind == "c":
            return F.struct(*(F.coalesce(F.sum(v[p].cast("double")), F.lit(0.0)).alias(p) for p in ("re", "im")))
        if kind == "f":
            return F.coalesce(F.sum(v.cast("double")), F.lit(0.0))
        return F.coalesce(wrapped(F.sum(_number(v, kind).cast("decimal(38,0)")), kind == "u"), F.lit(0).cast("decimal(20,0)" if kind == "u" else "long"))
    if function == "nansum":
        if kind == "c":
            return F.struct(*(F.coalesce(F.sum(F.when(~nan, v[p].cast("double"))), F.lit(0.0)).alias(p) for p in ("re", "im")))
        return F.coalesce(F.sum(F.when(~nan, v.cast("double"))), F.lit(0.0))
    if function == "prod":
        if kind == "f":
            return F.coalesce(F.product(v.cast("double")), F.lit(1.0))
        if kind == "c":
            # the product of the magnitudes and the sum of the angles
            size = F.product(F.hypot(v.re.cast("double"), v.im.cast("double")))
            turn = F.sum(F.atan2(v.im.cast("double"), v.re.cast("double")))
            return F.struct(F.coalesce(size * F.cos(turn), F.lit(1.0)).alias("re"), F.coalesce(size * F.sin(turn), F.lit(0.0)).alias("im"))
        product = _wrapping_product(_number(v, kind).cast("decimal(20,0)"))
        return wrapped(product.cast("decimal(38,0)"), True) if kind == "u" else product
    if function in ("mean", "nanmean"):
        keep = (lambda c: F.when(~nan, c)) if function == "nanmean" else (lambda c: c)
        if kind == "c":
            return F.struct(*(F.coalesce(F.avg(keep(v[p].cast("double"))), no_number).alias(p) for p in ("re", "im")))
        return F.coalesce(F.avg(keep(_number(v, kind).cast("double"))), no_number)
    if function in ("var", "std"):
        n = F.count(F.lit(1)).cast("double")
        parts = [v.re, v.im] if kind == "c" else [_number(v, kind)]
        total = sum((F.var_pop(p.cast("double")) for p in parts[1:]), F.var_pop(parts[0].cast("double"))) * n
        left = F.greatest(n - F.lit(float(ddof)), F.lit(0.0))
        out = F.when(n == 0, no_number).when(left == 0, F.when(total > 0, F.lit(float("inf"))).otherwise(no_number)).otherwise(total / F.when(left != 0, left))
        return F.sqrt(out) if function == "std" else out
    if function in ("max", "nanmax", "min", "nanmin"):
        least, skip = function.endswith("min"), function.startswith("nan")
        pick = F.min if least else F.max
        if kind in "biu":
            return pick(v)
        if kind == "f":
            if skip:
                return F.coalesce(pick(F.when(~nan, v)), no_number.cast(spark_type(dtype)))
            return F.when(F.bool_or(nan), no_number.cast(spark_type(dtype))).otherwise(pick(v))
        # complex numbers order by their parts; one with NaN goes before all others
        ranked = F.struct((~nan if least else nan).alias("n"), v.re.alias("re"), v.im.alias("im"))
        best = pick(F.when(~nan, ranked) if skip else ranked)
        return F.struct(F.coalesce(best.re, no_number.cast("float" if dtype.itemsize == 8 else "double")).alias("re"), F.coalesce(best.im, no_number.cast("float" if dtype.itemsize == 8 else "double")).alias("im"))
    if function in ("argmax", "argmin"):
        least = function == "argmin"
        of = [v.re, v.im] if kind == "c" else [v]
        if least:
            return F.min(F.struct((~nan).alias("n"), *(F.when(~nan, c).alias(f"x{k}") for k, c in enumerate(of)), position.alias("p"))).p
        return -F.max(F.struct(nan.alias("n"), *(F.when(~nan, c).alias(f"x{k}") for k, c in enumerate(of)), (-position).alias("p"))).p
    if function in ("all", "any", "count_nonzero"):
        true = (v.re != 0) | (v.im != 0) if kind == "c" else v if kind == "b" else v != 0
        if function == "count_nonzero":
            return F.count_if(true)
        return F.coalesce((F.bool_and if function == "all" else F.bool_or)(true), F.lit(function == "all"))
    if function in ("median", "nanmedian"):
        x = _number(v, kind).cast("double")
        if function == "nanmedian":
            return F.coalesce(F.percentile(F.when(~nan, x), 0.5), no_number)
        return F.when(F.bool_or(nan), no_number).otherwise(F.coalesce(F.percentile(x, 0.5), no_number))
    if function == "ptp":
        return F.when(F.bool_or(nan), no_number.cast(spark_type(dtype))).otherwise(F.max(v) - F.min(v)) if kind == "f" else (F.max(v) - F.min(v)).cast(spark_type(dtype))
    raise ValueError(f"no reduction {function!r}")


def reduce(df: DataFrame, shape: tuple[int, ...], dtype: np.dtype, function: str, axis=None, keepdims: bool = False, ddof: float = 0):
    """(relation of coordinates and v, shape, dtype) of a reduction of the relation ``df`` of an array."""
    function = ALIASES.get(function, function)
    if function not in FUNCTIONS:
        raise ValueError(f"no reduction {function!r}")
    ndim = len(shape)
    if function in ("argmax", "argmin") and isinstance(axis, tuple):
        raise TypeError(f"{function} reduces one axis or all")
    axes = reduced_axes(axis, ndim)
    n = int(np.prod([shape[a] for a in axes], dtype=object)) if axes else 1
    kept = [a for a in range(ndim) if a not in axes]
    if n == 0 and function in NEED_ONE and (not kept or all(shape[a] for a in kept)):
        raise ValueError(f"zero-size array to reduction operation {function} which has no identity")
    position = F.lit(0).cast("long")
    for a in axes:
        position = position * shape[a] + F.col(f"i{a}")
    out_dtype = result_dtype(function, dtype)
    value = aggregate(function, dtype, position, ddof)
    if function == "prod" and dtype.kind in "biu":  # the Python aggregate has no answer for no rows
        if n == 0:
            value = F.coalesce(F.max(F.lit(None).cast("long")), F.lit(1).cast("long"))
        elif not kept:
            df = df.select("v").unionByName(df.sparkSession.range(1).select(F.lit(1).cast(df.schema["v"].dataType).alias("v")))
            df = df.select(_number(F.col("v"), dtype.kind).cast("decimal(20,0)").alias("v")).mapInArrow(_partial_products, "v decimal(20,0)")
            value = _wrapping_product(F.col("v"))
            value = wrapped(value.cast("decimal(38,0)"), True) if dtype.kind == "u" else value
    keys = [f"i{a}" for a in kept]
    out = df.groupBy(*keys).agg(value.alias("v")) if keys else df.agg(value.alias("v"))
    if keys and n == 0:  # no element, so no group: every kept cell has the answer for nothing
        cells = df.sparkSession.range(int(np.prod([shape[a] for a in kept], dtype=object)))
        rest = F.col("id")
        columns = []
        for a in reversed(kept):
            columns.append((rest % shape[a]).alias(f"i{a}"))
            rest = F.floor(rest / shape[a]) if shape[a] else rest
        cells = cells.select(*reversed(columns))
        out = cells.crossJoin(F.broadcast(df.limit(0).agg(value.alias("v"))))  # one row
    out = out.withColumn("v", F.col("v").cast(spark_type(out_dtype)))
    if keepdims:
        return out.select(*(F.col(f"i{a}") if a in kept else F.lit(0).cast("long").alias(f"i{a}") for a in range(ndim)), "v"), tuple(shape[a] if a in kept else 1 for a in range(ndim)), out_dtype
    return out.select(*(F.col(f"i{a}").alias(f"i{k}") for k, a in enumerate(kept)), "v"), tuple(shape[a] for a in kept), out_dtype
