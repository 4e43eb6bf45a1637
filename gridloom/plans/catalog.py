"""Every registered array query with its DuckDB counterpart.

The driver's tables are read as arrays: E (embeddings, float32 [N, 64]), C (E as
[N, 8, 8]), EV (events.value), OT (orders.o_totalprice), PS (part.p_size, int32),
CB (customer.c_acctbal) and L (labels.quality over documents, with a fill value).
Float aggregates are rounded, since the order of summation is free.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.functions.numpy_api import concatenated, cumulative, ordered
from gridloom.operators.frame import ArrayFrame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# arrays


def _rows(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _n(df: DataFrame, key: str) -> int:
    """The length of an array by its dense key: a footer statistic, or one narrow scan."""
    top = df.agg(F.max(key)).first()[0]
    return 0 if top is None else int(top) + 1


def matrix(spark: SparkSession, sf_dir: str) -> ArrayFrame:
    df = _rows(spark, sf_dir, "embeddings")
    return ArrayFrame.of_lists(df, "vec_id", "embedding", (_n(df, "vec_id"), 64), "float32")


def cube(spark: SparkSession, sf_dir: str) -> ArrayFrame:
    a = matrix(spark, sf_dir)
    return ArrayFrame(a.df.select("i0", F.expr("i1 div 8").alias("i1"), (F.col("i1") % 8).alias("i2"), "v"), (a.shape[0], 8, 8), a.dtype)


def vector(table: str, key: str, column: str, dtype: str) -> Callable[[SparkSession, str], ArrayFrame]:
    def read(spark: SparkSession, sf_dir: str) -> ArrayFrame:
        df = _rows(spark, sf_dir, table)
        return ArrayFrame.of_column(df, key, column, _n(df, key), dtype)

    return read


events = vector("events", "event_id", "value", "float64")
totals = vector("orders", "o_orderkey", "o_totalprice", "float64")
sizes = vector("part", "p_partkey", "p_size", "int32")
balances = vector("customer", "c_custkey", "c_acctbal", "float64")


def holey(spark: SparkSession, sf_dir: str) -> ArrayFrame:
    """Events with NaN at every seventh place."""
    a = events(spark, sf_dir)
    return ArrayFrame(a.df.withColumn("v", F.when(F.col("i0") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("v"))), a.shape, a.dtype)


def holey_matrix(spark: SparkSession, sf_dir: str) -> ArrayFrame:
    """E with NaN where the coordinates sum to a multiple of five, and one column of NaN."""
    a = matrix(spark, sf_dir)
    return ArrayFrame(a.df.withColumn("v", F.when(((F.col("i0") + F.col("i1")) % 5 == 0) | (F.col("i1") == 3), F.lit(float("nan")).cast("float")).otherwise(F.col("v"))), a.shape, a.dtype)


def complexes(spark: SparkSession, sf_dir: str) -> ArrayFrame:
    """Column 0 of E with column 1 as its imaginary part."""
    df = _rows(spark, sf_dir, "embeddings")
    value = F.struct(F.col("embedding")[0].cast("double").alias("re"), F.col("embedding")[1].cast("double").alias("im"))
    return ArrayFrame(df.select(F.col("vec_id").alias("i0"), value.alias("v")), (_n(df, "vec_id"),), "complex128")


_E = "(SELECT vec_id AS i0, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i1, unnest(embedding) AS v FROM embeddings)"
_C = f"(SELECT i0, i1 // 8 AS i1, i1 % 8 AS i2, v FROM {_E})"
_EV = "(SELECT event_id AS i0, value AS v FROM events)"
_H = "(SELECT event_id AS i0, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE ELSE value END AS v FROM events)"
_HE = f"(SELECT i0, i1, CASE WHEN (i0 + i1) % 5 = 0 OR i1 = 3 THEN 'NaN'::FLOAT ELSE v END AS v FROM {_E})"
_PS = "(SELECT p_partkey AS i0, p_size AS v FROM part)"
_Z = "(SELECT vec_id AS i0, embedding[1]::DOUBLE AS re, embedding[2]::DOUBLE AS im FROM embeddings)"
_N = "(SELECT max(vec_id) + 1 FROM embeddings)"
_NE = "(SELECT max(event_id) + 1 FROM events)"


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def _frame(name: str, build: Callable[[SparkSession, str], ArrayFrame], sql: str, digits: int | None = None) -> None:
    """A query that returns an array's relation; floats rounded to ``digits``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build(spark, sf_dir).df
        return df if digits is None else df.withColumn("v", F.round(F.col("v").cast("double"), digits))

    _add(name, run, sql)


# selections

_frame("sel_whole", lambda s, d: matrix(s, d)[...], f"SELECT i0, i1, v FROM {_E}")
_frame("sel_single", lambda s, d: matrix(s, d)[5], f"SELECT i1 AS i0, v FROM {_E} WHERE i0 = 5")
_frame("sel_single_last", lambda s, d: matrix(s, d)[-1], f"SELECT i1 AS i0, v FROM {_E} WHERE i0 = {_N} - 1")
_frame("sel_slice", lambda s, d: matrix(s, d)[10:200, 4:20], f"SELECT i0 - 10 AS i0, i1 - 4 AS i1, v FROM {_E} WHERE i0 BETWEEN 10 AND 199 AND i1 BETWEEN 4 AND 19")
_frame("sel_step", lambda s, d: matrix(s, d)[3::7, ::16], f"SELECT (i0 - 3) // 7 AS i0, i1 // 16 AS i1, v FROM {_E} WHERE i0 >= 3 AND (i0 - 3) % 7 = 0 AND i1 % 16 = 0")
_frame("sel_negstep", lambda s, d: events(s, d)[499:100:-3], f"SELECT (499 - i0) // 3 AS i0, v FROM {_EV} WHERE i0 > 100 AND i0 <= 499 AND (499 - i0) % 3 = 0")
_frame("sel_reverse", lambda s, d: events(s, d)[::-1], f"SELECT {_NE} - 1 - i0 AS i0, v FROM {_EV}")
_frame("sel_empty", lambda s, d: matrix(s, d)[100:100], f"SELECT i0, i1, v FROM {_E} WHERE false")
_frame("sel_fancy", lambda s, d: matrix(s, d)[[3, 3, 0, -1]], f"SELECT k AS i0, i1, v FROM {_E} JOIN (SELECT unnest([0, 1, 2, 3])::BIGINT AS k, unnest([3, 3, 0, {_N} - 1])::BIGINT AS i0) USING (i0)")
_frame("sel_fancy_pair", lambda s, d: matrix(s, d)[[7, 40, 40], [60, 5, 5]], f"SELECT k AS i0, v FROM {_E} JOIN (VALUES (0::BIGINT, 7, 60), (1, 40, 5), (2, 40, 5)) p(k, i0, i1) USING (i0, i1)")
_frame("sel_fancy_int", lambda s, d: cube(s, d)[33, :, [6, 2, 5]], f"SELECT k AS i0, i1, v FROM {_C} JOIN (VALUES (0::BIGINT, 6), (1, 2), (2, 5)) p(k, i2) USING (i2) WHERE i0 = 33")
_frame("sel_fancy_sep", lambda s, d: cube(s, d)[[19, 8], :, [7, 3]], f"SELECT k AS i0, i1, v FROM {_C} JOIN (VALUES (0::BIGINT, 19, 7), (1, 8, 3)) p(k, i0, i2) USING (i0, i2)")
_frame("sel_fancy_slice", lambda s, d: matrix(s, d)[2:80, [1, 3, 5]], f"SELECT i0 - 2 AS i0, k AS i1, v FROM {_E} JOIN (VALUES (0::BIGINT, 1), (1, 3), (2, 5)) p(k, i1) USING (i1) WHERE i0 BETWEEN 2 AND 79")
_frame("sel_operator_mask", lambda s, d: (lambda a: a[(a[:, 0] > 0.1) & ~(a[:, 1] > 0.1)])(matrix(s, d)), f"SELECT dense_rank() OVER (ORDER BY i0) - 1 AS i0, i1, v FROM {_E} WHERE i0 IN (SELECT vec_id FROM embeddings WHERE embedding[1] > 0.1::FLOAT AND NOT embedding[2] > 0.1::FLOAT)")
_frame("sel_ellipsis", lambda s, d: cube(s, d)[..., 0], f"SELECT i0, i1, v FROM {_C} WHERE i2 = 0")
_frame("sel_newaxis", lambda s, d: matrix(s, d)[:10, None, 5], f"SELECT i0, 0::BIGINT AS i1, v FROM {_E} WHERE i0 < 10 AND i1 = 5")
_frame("sel_mask", lambda s, d: matrix(s, d)[:, np.arange(64) % 9 == 2], f"SELECT i0, i1 // 9 AS i1, v FROM {_E} WHERE i1 % 9 = 2")
_frame("sel_mask_nd", lambda s, d: cube(s, d)[:, np.eye(8, dtype=bool)], f"SELECT i0, i1, v FROM {_C} WHERE i1 = i2")
_frame("sel_predicate", lambda s, d: (lambda a: a[a[:, 0].where(lambda v: v > 0)])(matrix(s, d)), f"SELECT o AS i0, i1, v FROM {_E} JOIN (SELECT i0, row_number() OVER (ORDER BY i0) - 1 AS o FROM {_E} WHERE i1 = 0 AND v > 0) USING (i0)")
_frame("sel_mask_computed", lambda s, d: (lambda a: a[a.where(lambda v: v > 50)])(holey(s, d)), f"SELECT row_number() OVER (ORDER BY i0) - 1 AS i0, v FROM {_H} WHERE v > 50 AND NOT isnan(v)")
_frame("sel_view", lambda s, d: matrix(s, d).view[10:400].view[::-3, 8:].view[:, 1], f"SELECT (389 - (i0 - 10)) // 3 AS i0, v FROM {_E} WHERE i0 BETWEEN 10 AND 399 AND (389 - (i0 - 10)) % 3 = 0 AND i1 = 9")


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keys resolve to, without a job."""
    rows = []
    a = matrix(spark, sf_dir)
    for k, key in enumerate([(5,), (slice(8, 2, -3), slice(None, None, 16)), (None, [3, 0], Ellipsis)]):
        found = a[:64].resolve(key)
        rows.append((k, ",".join(map(str, found.shape)), ";".join(":".join(map(str, x)) for x in found.described())))
    return spark.createDataFrame(rows, "key int, shape string, axes string")


_add("sel_resolve", _described, "SELECT * FROM (VALUES (0, '64', 'point:5;range:0:1:64'), (1, '2,4', 'range:8:-3:2;range:0:16:4'), (2, '1,2,64', 'fancy:[3, 0];range:0:1:64')) t(key, shape, axes)")


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = matrix(spark, sf_dir)[:64]
    keys = {"out of bounds": 64, "too low": -65, "too many": (0, 0, 0), "two ellipses": (Ellipsis, Ellipsis), "zero step": slice(None, None, 0), "broadcast": ([0, 1], [0, 1, 2]), "float": 1.5, "bool": True, "text": "a", "2-D index": [[0]], "mask": np.ones(3, bool)}
    rows = []
    for name, key in keys.items():
        try:
            a[key]
            rows.append((name, "accepted"))
        except (IndexError, ValueError) as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "case string, error string")


_add("sel_errors", _errors, "SELECT unnest(['out of bounds', 'too low', 'too many', 'two ellipses', 'zero step', 'broadcast', 'float', 'bool', 'text', '2-D index', 'mask']) AS \"case\", 'IndexError' AS error")

# reductions

_frame("slice_mean_axis0", lambda s, d: matrix(s, d)[10:90:2, :32].reduce("mean", 0), f"SELECT i1 AS i0, round(CAST(CAST(avg(v::DOUBLE) AS FLOAT) AS DOUBLE), 5) AS v FROM {_E} WHERE i0 >= 10 AND i0 < 90 AND i0 % 2 = 0 AND i1 < 32 GROUP BY i1", 5)
for _f, _sql in {"sum": "sum(v)", "mean": "avg(v)", "max": "max(v)", "min": "min(v)", "var": "var_pop(v)", "std": "stddev_pop(v)"}.items():
    _frame(f"red_{_f}", lambda s, d, f=_f: events(s, d).reduce(f), f"SELECT round({_sql}, 4) AS v FROM {_EV}", 4)
    _frame(f"red_{_f}_axis1", lambda s, d, f=_f: matrix(s, d).reduce(f, 1), f"SELECT i0, round({_sql.replace('(v)', '(v::DOUBLE)')}, 4) AS v FROM {_E} GROUP BY i0", 4)
_frame("red_sum_int", lambda s, d: sizes(s, d).reduce("sum"), f"SELECT sum(v)::BIGINT AS v FROM {_PS}")
_frame("red_sum_wrap", lambda s, d: sizes(s, d).map(lambda v: v.cast("long") * 9000000000000000, "int64").reduce("sum"), f"SELECT CAST(((sum(v::HUGEINT * 9000000000000000) + 9223372036854775808) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616 - 9223372036854775808 AS BIGINT) AS v FROM {_PS}")
_add("red_sum_uint64", lambda s, d: sizes(s, d).map(lambda v: v.cast("decimal(20,0)") * 900000000000000000, "uint64").reduce("sum").df.select(F.col("v").cast("string").alias("v")), f"SELECT CAST(sum(v::HUGEINT * 900000000000000000) % 18446744073709551616 AS VARCHAR) AS v FROM {_PS}")
_frame("red_prod", lambda s, d: balances(s, d)[:60].map(lambda v: 1 + v / 100000).reduce("prod"), "SELECT round(product(1 + c_acctbal / 100000), 6) AS v FROM customer WHERE c_custkey < 60", 6)
_frame("red_prod_int", lambda s, d: sizes(s, d)[:8].map(lambda v: v % 5 + 1, "int32").reduce("prod"), f"SELECT product(v % 5 + 1)::BIGINT AS v FROM {_PS} WHERE i0 < 8")
_frame("red_prod_empty", lambda s, d: events(s, d)[5:5].reduce("prod"), "SELECT 1.0::DOUBLE AS v")
_frame("red_nanmax", lambda s, d: holey_matrix(s, d).reduce("nanmax", 0), f"SELECT i1 AS i0, coalesce(max(v) FILTER (NOT isnan(v)), 'NaN'::FLOAT) AS v FROM {_HE} GROUP BY i1")
_frame("red_nanmin", lambda s, d: holey_matrix(s, d).reduce("nanmin", 0), f"SELECT i1 AS i0, coalesce(min(v) FILTER (NOT isnan(v)), 'NaN'::FLOAT) AS v FROM {_HE} GROUP BY i1")
_frame("red_nansum", lambda s, d: holey_matrix(s, d).reduce("nansum", 0), f"SELECT i1 AS i0, round(coalesce(sum(v::DOUBLE) FILTER (NOT isnan(v)), 0), 3) AS v FROM {_HE} GROUP BY i1", 3)
_frame("red_nanmean", lambda s, d: holey(s, d).reduce("nanmean"), f"SELECT round(avg(v) FILTER (NOT isnan(v)), 6) AS v FROM {_H}", 6)
_frame("red_max_nan", lambda s, d: holey(s, d).reduce("max"), "SELECT 'NaN'::DOUBLE AS v")
_frame("red_min_nan", lambda s, d: holey_matrix(s, d).reduce("min", 1), f"SELECT i0, CASE WHEN bool_or(isnan(v)) THEN 'NaN'::FLOAT ELSE min(v) END AS v FROM {_HE} GROUP BY i0")
_frame("red_std_ddof", lambda s, d: matrix(s, d).reduce("std", 0, ddof=1), f"SELECT i1 AS i0, round(stddev_samp(v::DOUBLE), 5) AS v FROM {_E} GROUP BY i1", 5)
_frame("red_var_no_dof", lambda s, d: matrix(s, d)[:, :3].reduce("var", 1, ddof=3), f"SELECT i0, 'Infinity'::DOUBLE AS v FROM {_E} GROUP BY i0", 5)
_frame("red_all", lambda s, d: sizes(s, d).map(lambda v: v % 7, "int32").reduce("all"), f"SELECT bool_and(v % 7 <> 0) AS v FROM {_PS}")
_frame("red_any", lambda s, d: cube(s, d).where(lambda v: v > 0.3).reduce("any", (1, 2)), f"SELECT i0, bool_or(v > 0.3) AS v FROM {_C} GROUP BY i0")
_frame("red_argmax", lambda s, d: matrix(s, d).reduce("argmax", 1), f"SELECT i0, arg_max(i1, (v, -i1)) AS v FROM {_E} GROUP BY i0")
_frame("red_argmin", lambda s, d: matrix(s, d).reduce("argmin", 0), f"SELECT i1 AS i0, arg_min(i0, (v, i0)) AS v FROM {_E} GROUP BY i1")
_frame("red_argmax_flat", lambda s, d: matrix(s, d).reduce("argmax"), f"SELECT arg_max(i0 * 64 + i1, (v, -(i0 * 64 + i1))) AS v FROM {_E}")
_frame("red_argmin_nan", lambda s, d: holey(s, d)[3:].reduce("argmin"), "SELECT 4::BIGINT AS v")
_frame("red_argmax_ties", lambda s, d: sizes(s, d).reduce("argmax"), f"SELECT min(i0) AS v FROM {_PS} WHERE v = (SELECT max(v) FROM {_PS})")
_frame("red_axis", lambda s, d: cube(s, d).reduce("mean", (0, -1)), f"SELECT i1 AS i0, round(avg(v::DOUBLE), 5) AS v FROM {_C} GROUP BY i1", 5)
_frame("red_axis_none", lambda s, d: sizes(s, d).reduce("sum", ()), f"SELECT i0, v::BIGINT AS v FROM {_PS}")
_frame("red_keepdims", lambda s, d: cube(s, d).reduce("max", 1, keepdims=True), f"SELECT i0, 0::BIGINT AS i1, i2, max(v) AS v FROM {_C} GROUP BY i0, i2")
_frame("red_view", lambda s, d: matrix(s, d).view[::2, [0, 3]].reduce("sum", 0), f"SELECT CASE i1 WHEN 0 THEN 0 ELSE 1 END::BIGINT AS i0, round(sum(v::DOUBLE), 4) AS v FROM {_E} WHERE i0 % 2 = 0 AND i1 IN (0, 3) GROUP BY i1", 4)
_frame("red_bool", lambda s, d: events(s, d).where(lambda v: v > 50).reduce("sum"), f"SELECT count(*) FILTER (v > 50) AS v FROM {_EV}")
_frame("red_bool_mean", lambda s, d: events(s, d).where(lambda v: v > 50).reduce("mean"), f"SELECT round(avg((v > 50)::INTEGER), 8) AS v FROM {_EV}", 8)
_frame("red_empty", lambda s, d: matrix(s, d)[4:4].reduce("sum", 0), "SELECT range AS i0, 0.0::FLOAT AS v FROM range(64)")
_frame("red_where", lambda s, d: (lambda a: a.reduce("sum", where=a.where(lambda v: v > 100)))(events(s, d)), f"SELECT round(coalesce(sum(v) FILTER (v > 100), 0), 4) AS v FROM {_EV}", 4)
_frame("red_initial", lambda s, d: sizes(s, d).reduce("max", initial=1000), "SELECT 1000::INTEGER AS v")
_frame("red_args_fallback", lambda s, d: sizes(s, d).reduce("sum", dtype="float64"), f"SELECT sum(v)::DOUBLE AS v FROM {_PS}")


def _complex(function: str, **kw):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = complexes(spark, sf_dir).reduce(function, **kw).df
        return out.select(F.round("v.re", 6).alias("re"), F.round("v.im", 6).alias("im")) if "struct" in dict(out.dtypes)["v"] else out.select(F.round(F.col("v").cast("double"), 6).alias("v"))

    return run


_add("red_complex_sum", _complex("sum"), f"SELECT round(sum(re), 6) AS re, round(sum(im), 6) AS im FROM {_Z}")
_add("red_complex_mean", _complex("mean"), f"SELECT round(avg(re), 6) AS re, round(avg(im), 6) AS im FROM {_Z}")
_add("red_complex_var", _complex("var"), f"SELECT round(var_pop(re) + var_pop(im), 6) AS v FROM {_Z}")
_add("red_complex_max", _complex("max"), f"SELECT round(re, 6) AS re, round(im, 6) AS im FROM {_Z} ORDER BY re DESC, im DESC LIMIT 1")
_add("red_complex_argmin", _complex("argmin"), f"SELECT i0::DOUBLE AS v FROM {_Z} ORDER BY re, im, i0 LIMIT 1")

# functions of NumPy

_frame("fn_sqrt", lambda s, d: np.sqrt(events(s, d)), f"SELECT i0, round(sqrt(v), 8) AS v FROM {_EV}", 8)
_frame("fn_ufuncs", lambda s, d: np.add(np.absolute(np.negative(events(s, d))), np.log1p(events(s, d))), f"SELECT i0, round(abs(-v) + ln(1 + v), 6) AS v FROM {_EV}", 6)
_frame("fn_arith", lambda s, d: (lambda a: np.multiply(a[:, 0], a[:, 1]))(matrix(s, d)), f"SELECT vec_id AS i0, round((embedding[1] * embedding[2])::DOUBLE, 5) AS v FROM embeddings", 5)
_frame("fn_minimum", lambda s, d: np.minimum(holey(s, d), 50), f"SELECT i0, CASE WHEN isnan(v) THEN v ELSE least(v, 50) END AS v FROM {_H}")
_frame("fn_broadcast", lambda s, d: (lambda a: a - a[3] * 2)(matrix(s, d)), f"SELECT a.i0, a.i1, round((a.v - b.v * 2::FLOAT)::DOUBLE, 5) AS v FROM {_E} a JOIN (SELECT i1, v FROM {_E} WHERE i0 = 3) b ON a.i1 = b.i1", 5)
_frame("fn_integers", lambda s, d: (lambda a: -a * a + 7)(sizes(s, d)), f"SELECT i0, (-v * v + 7)::INTEGER AS v FROM {_PS}")
_frame("fn_compare", lambda s, d: np.greater(holey(s, d), 50), f"SELECT i0, v > 50 AND NOT isnan(v) AS v FROM {_H}")
_frame("fn_median", lambda s, d: np.median(matrix(s, d), axis=0), f"SELECT i1 AS i0, round(quantile_cont(v::DOUBLE, 0.5), 5) AS v FROM {_E} GROUP BY i1", 5)
_frame("fn_nanmedian", lambda s, d: np.nanmedian(holey(s, d)), f"SELECT round(quantile_cont(v, 0.5), 6) AS v FROM {_H} WHERE NOT isnan(v)", 6)
_frame("fn_cumsum", lambda s, d: cumulative(events(s, d), 0), f"SELECT i0, round(sum(v) OVER (ORDER BY i0 ROWS UNBOUNDED PRECEDING), 3) AS v FROM {_EV}", 3)
_frame("fn_cumsum_axis0", lambda s, d: np.cumsum(matrix(s, d)[:50], axis=0), f"SELECT i0, i1, round(CAST(CAST(sum(v::DOUBLE) OVER (PARTITION BY i1 ORDER BY i0 ROWS UNBOUNDED PRECEDING) AS FLOAT) AS DOUBLE), 3) AS v FROM {_E} WHERE i0 < 50", 3)
_frame("fn_cumprod", lambda s, d: np.cumprod(balances(s, d)[:12].map(lambda v: 1 + v / 10000)), "SELECT c_custkey AS i0, round(exp(sum(ln(1 + c_acctbal / 10000)) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING)), 6) AS v FROM customer WHERE c_custkey < 12", 6)
_frame("fn_count_nonzero", lambda s, d: np.count_nonzero(sizes(s, d).map(lambda v: v % 3, "int32")), f"SELECT count(*) FILTER (v % 3 <> 0) AS v FROM {_PS}")
_frame("fn_ptp", lambda s, d: np.ptp(matrix(s, d), axis=1), f"SELECT i0, round((max(v) - min(v))::DOUBLE, 5) AS v FROM {_E} GROUP BY i0", 5)
_frame("fn_sort", lambda s, d: np.sort(matrix(s, d), axis=0), f"SELECT row_number() OVER (PARTITION BY i1 ORDER BY v, i0) - 1 AS i0, i1, v FROM {_E}")
_frame("fn_argsort", lambda s, d: ordered(matrix(s, d), 1, True), f"SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS i1, i1 AS v FROM {_E}")
_frame("fn_concatenate", lambda s, d: (lambda a: concatenated([a[:5], a[100:103]], 0))(matrix(s, d)), f"SELECT CASE WHEN i0 < 5 THEN i0 ELSE i0 - 95 END AS i0, i1, v FROM {_E} WHERE i0 < 5 OR i0 BETWEEN 100 AND 102")

# quality

_frame("q_exact", lambda s, d: events(s, d).at(codec="raw"), f"SELECT i0, v FROM {_EV}")
_frame("q_cast", lambda s, d: events(s, d).at(dtype="float32"), f"SELECT i0, v::FLOAT AS v FROM {_EV}")
_frame("q_cast_half", lambda s, d: sizes(s, d).astype("float32").at(dtype="float16"), f"SELECT i0, v::FLOAT AS v FROM {_PS}")
_frame("q_gzip", lambda s, d: events(s, d).at(codec="gzip"), f"SELECT i0, v FROM {_EV}")


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of E that a bound of 1e-3 breaks (none), and whether it leaves fewer values."""
    a = matrix(spark, sf_dir)
    both = a.combine(a.at(abs_error=1e-3), lambda v, w: F.abs(v.cast("double") - w.cast("double")) <= 1e-3, "bool")
    fewer = a.at(abs_error=1e-3).df.agg(F.countDistinct("v").alias("n"))
    return both.df.agg(F.count_if(~F.col("v")).alias("broken"), F.count("*").alias("cells")).crossJoin(fewer).select("broken", "cells", (F.col("n") < F.col("cells")).alias("fewer"))  # one row each


_add("q_error_bound", _bound, f"SELECT 0::BIGINT AS broken, count(*) AS cells, true AS fewer FROM {_E}")


def _negotiated(spark: SparkSession, sf_dir: str) -> DataFrame:
    import warnings

    rows = []
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        a, b = matrix(spark, sf_dir), sizes(spark, sf_dir)
        for name, x, kw in (("half", a, {"dtype": "float16"}), ("wider", a, {"dtype": "float64"}), ("bound", a, {"abs_error": 0.5}), ("relative", a, {"rel_error": 0.5}), ("ints", b, {"abs_error": 0.5}), ("both", a, {"abs_error": 1, "dtype": "float16"}), ("none", a, {})):
            try:
                q = x.at(**kw).applied_quality
                rows.append((name, ",".join(f"{k}={v}" for k, v in sorted(q.items()))))
            except ValueError:
                rows.append((name, "ValueError"))
    return spark.createDataFrame(rows, "asked string, applied string")


_add("q_negotiate", _negotiated, "SELECT * FROM (VALUES ('half', 'codec=exact,dtype=float16'), ('wider', 'codec=exact'), ('bound', 'abs_error=0.5,codec=exact'), ('relative', 'codec=exact'), ('ints', 'codec=exact'), ('both', 'ValueError'), ('none', 'ValueError')) t(asked, applied)")

# delivery

_add("gather", lambda s, d: matrix(s, d).gather([slice(0, 2), (5, [1, 1]), (Ellipsis, -1)]), f"SELECT 0::BIGINT AS key, i0 * 64 + i1 AS at, v FROM {_E} WHERE i0 < 2 UNION ALL SELECT 1, k, v FROM {_E} JOIN (VALUES (0::BIGINT, 1), (1, 1)) p(k, i1) USING (i1) WHERE i0 = 5 UNION ALL SELECT 2, i0, v FROM {_E} WHERE i1 = 63")
_frame("get", lambda s, d: ArrayFrame.of_numpy(s, matrix(s, d)[:3, :4].to_numpy()), f"SELECT i0, i1, v FROM {_E} WHERE i0 < 3 AND i1 < 4")
_frame("get_async", lambda s, d: ArrayFrame.of_numpy(s, events(s, d).get_async(slice(0, 9)).result()), f"SELECT i0, v FROM {_EV} WHERE i0 < 9")
_frame("read_into", lambda s, d: ArrayFrame.of_numpy(s, events(s, d).read_into(np.zeros(7), slice(2, 9))), f"SELECT i0 - 2 AS i0, v FROM {_EV} WHERE i0 BETWEEN 2 AND 8")
_frame("to_array", lambda s, d: ArrayFrame.of_numpy(s, np.asarray(sizes(s, d)[:20], dtype="int64")), f"SELECT i0, v::BIGINT AS v FROM {_PS} WHERE i0 < 20")

# storage that was never written


def _filled(spark: SparkSession, sf_dir: str) -> ArrayFrame:
    n = _n(_rows(spark, sf_dir, "documents"), "doc_id")
    return ArrayFrame.sparse(_rows(spark, sf_dir, "labels"), ["doc_id"], "quality", (n,), "int32", -1)


_frame("scan_fill", _filled, "SELECT range AS i0, coalesce(quality, -1)::INTEGER AS v FROM range((SELECT max(doc_id) + 1 FROM documents)) LEFT JOIN labels ON doc_id = range")
_frame("reshape", lambda s, d: matrix(s, d)[:32].reshape(4, 8, 64), f"SELECT i0 // 8 AS i0, i0 % 8 AS i1, i1 AS i2, v FROM {_E} WHERE i0 < 32")

# the same operators over whole arrays; factors are scaled by the length, so that products stay finite


def _factors(spark: SparkSession, sf_dir: str) -> ArrayFrame:
    a = balances(spark, sf_dir)
    return a.map(lambda v: 1 + v / (1000.0 * a.size))


_FACTORS = "(SELECT c_custkey AS i0, 1 + c_acctbal / (1000.0::DOUBLE * (SELECT max(c_custkey) + 1 FROM customer)) AS v FROM customer)"
_ODD = "list_reduce(list_prepend(1::HUGEINT, list((v * 2 + 1)::HUGEINT)), lambda x, y: (x * y) % 18446744073709551616)"
_frame("red_prod_whole", lambda s, d: _factors(s, d).reduce("prod"), f"SELECT round(product(v), 6) AS v FROM {_FACTORS}", 6)
_frame("red_prod_int_whole", lambda s, d: sizes(s, d).map(lambda v: v * 2 + 1, "int32").reduce("prod"), f"SELECT CAST(CASE WHEN p >= 9223372036854775808 THEN p - 18446744073709551616 ELSE p END AS BIGINT) AS v FROM (SELECT {_ODD} AS p FROM {_PS})")
_frame("fn_cumsum_axis0_whole", lambda s, d: np.cumsum(matrix(s, d), axis=0), f"SELECT i0, i1, round(CAST(CAST(sum(v::DOUBLE) OVER (PARTITION BY i1 ORDER BY i0 ROWS UNBOUNDED PRECEDING) AS FLOAT) AS DOUBLE), 3) AS v FROM {_E}", 3)
_frame("fn_cumprod_whole", lambda s, d: np.cumprod(_factors(s, d)), f"SELECT i0, round(product(v) OVER (ORDER BY i0 ROWS UNBOUNDED PRECEDING), 6) AS v FROM {_FACTORS}", 6)
_frame("to_array_whole", lambda s, d: ArrayFrame.of_numpy(s, np.asarray(sizes(s, d), dtype="int64")), f"SELECT i0, v::BIGINT AS v FROM {_PS}")
_frame("reshape_whole", lambda s, d: (lambda a: a.reshape(a.shape[0] * 4, 4, 4))(matrix(s, d)), f"SELECT i0 * 4 + i1 // 16 AS i0, i1 // 4 % 4 AS i1, i1 % 4 AS i2, v FROM {_E}")
