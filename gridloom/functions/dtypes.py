"""The element types, their Spark types, and the types of reduced results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F, types as T

#: The element types that arrays may have.
NAMES = ("bool", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float16", "float32", "float64", "complex64", "complex128")

_SPARK = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(),
}


def dtype_of(name) -> np.dtype:
    """The dtype by NumPy's names; TypeError for what arrays can't hold, multi-byte big-endian included."""
    d = np.dtype(name)
    if d.name not in NAMES or (d.itemsize > 1 and d.byteorder == ">"):
        raise TypeError(f"arrays of {name!r} are not supported")
    return d.newbyteorder("=")


def spark_type(dtype: np.dtype) -> T.DataType:
    """unsigned types take the next wider signed one, uint64 decimal(20, 0), float16 float, complex a struct of its parts."""
    if dtype.kind == "c":
        part = T.FloatType() if dtype.itemsize == 8 else T.DoubleType()
        return T.StructType([T.StructField("re", part), T.StructField("im", part)])
    return _SPARK[dtype.name]


def result_dtype(function: str, dtype: np.dtype) -> np.dtype:
    """NumPy's result type of a reduction."""
    kind = dtype.kind
    if function in ("all", "any"):
        return np.dtype(bool)
    if function in ("argmax", "argmin", "count_nonzero"):
        return np.dtype(np.int64)
    if function in ("sum", "prod", "nansum"):
        return np.dtype(np.int64) if kind in "bi" else np.dtype(np.uint64) if kind == "u" else dtype
    if function in ("mean", "nanmean", "median", "nanmedian"):
        return np.dtype(np.float64) if kind in "biu" else dtype
    if function in ("var", "std"):
        return np.dtype(np.float64) if kind in "biu" else np.dtype(f"f{dtype.itemsize // 2}") if kind == "c" else dtype
    return dtype


def wrapped(total: Column, unsigned: bool) -> Column:
    """A decimal total modulo 2 ** 64, as int64, or as decimal(20, 0) if unsigned."""
    span = F.lit("18446744073709551616").cast("decimal(38,0)")
    if unsigned:
        return F.pmod(total, span).cast("decimal(20,0)")
    half = F.lit("9223372036854775808").cast("decimal(38,0)")
    return (F.pmod(total + half, span) - half).cast("long")
