"""Queries over array files: each writes a small file from the driver's tables, opens it and reads a part of it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import warnings
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.operators.frame import ArrayFrame, FallbackWarning, set_policy, stats
from gridloom.plans.catalog import _E, _EV, ORACLES, QUERIES, _add, _frame, events, matrix
from gridloom.sources.files import ArrayFile, NotAllowed, allowed, format_of, open_array
from gridloom.sources.writers import Hdf5Writer, zarr_array, zarr_group

_made: dict[str, str] = {}


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder for the files of the first rows."""
    path = os.path.join(_shared_folder(spark, sf_dir), "part")
    os.makedirs(path, exist_ok=True)
    return path


def _part(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """The first 90 rows of E."""
    return matrix(spark, sf_dir)[:90].to_numpy()


def _file(name: str, write: Callable[[str, np.ndarray], None]) -> Callable[[SparkSession, str], ArrayFile]:
    def opened(spark: SparkSession, sf_dir: str) -> ArrayFile:
        path = os.path.join(_folder(spark, sf_dir), name)
        if not os.path.exists(path):
            write(path, _part(spark, sf_dir))
        return open_array(spark, path)

    return opened


def _tree(path: str, a: np.ndarray) -> None:
    zarr_group(path, {"title": "demo", "levels": [1.5, 2.5]})
    zarr_group(f"{path}/g")
    zarr_array(f"{path}/g/e", a, (32, 16), ("zstd", "crc32c"), attrs={"units": "1"})
    zarr_array(f"{path}/holes", a, (30, 64), (), fill=-1.0, skip=[(1, 0)])
    zarr_array(f"{path}/shards", a, (64, 32), ("gzip",), inner=(16, 8))
    zarr_array(f"{path}/v2", a.astype("int16"), (50, 20), keys="v2")


def _hdf5(path: str, a: np.ndarray) -> None:
    Hdf5Writer().save(path, {"g": {"plain": (a, {"attrs": {"units": "1"}})}, "chunked": (a, {"chunks": (32, 20), "filters": (2, 1, 3)}), "holes": (a, {"chunks": (30, 64), "fill": -1, "skip": [(1, 0)]})}, {"title": "demo"})


npy_file, zarr_file, hdf5_file = _file("e.npy", np.save), _file("t.zarr", _tree), _file("t.h5", _hdf5)


def _shared_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder for the files of whole tables: under ``spark.checkpoint.dir``, which all executors share, where it is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    key = f"{root or ''}|{sf_dir}"
    if key not in _made:
        root = root and root.removeprefix("file://")
        if root:
            os.makedirs(root, exist_ok=True)
        _made[key] = tempfile.mkdtemp(prefix="gridloom-arrays-", dir=root or None)
        os.chmod(_made[key], 0o755)
        atexit.register(shutil.rmtree, _made[key], True)
    return _made[key]


def _rows_into(path: str):
    def run(batches):
        for batch in batches:
            at = batch.column(0).to_numpy()
            if len(at):
                out = np.load(path, mmap_mode="r+")
                out[at] = batch.column(1).flatten().to_numpy().reshape(len(at), out.shape[1])
                out.flush()
            yield pa.RecordBatch.from_arrays([pa.array([len(at)], pa.int64())], ["n"])

    return run


def _whole_npy(spark: SparkSession, sf_dir: str) -> str:
    """The whole of E as a file; each task writes its own rows, so E is never in one memory."""
    path = os.path.join(_shared_folder(spark, sf_dir), "e.npy")
    if not os.path.exists(path):
        shape, made = matrix(spark, sf_dir).shape, f"{path}.part"
        with open(made, "wb") as f:
            np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": shape})
            f.truncate(f.tell() + 4 * shape[0] * shape[1])
        if shape[0]:
            spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").mapInArrow(_rows_into(made), "n long").agg(F.sum("n")).collect()
        os.rename(made, path)
    return path


def _whole(name: str, write: Callable[[str, np.ndarray], None] | None = None) -> Callable[[SparkSession, str], ArrayFile]:
    """A file of the whole of E; ``write`` gets E mapped from a file and takes a chunk at a time."""

    def opened(spark: SparkSession, sf_dir: str) -> ArrayFile:
        source = _whole_npy(spark, sf_dir)
        path = os.path.join(os.path.dirname(source), name)
        if not os.path.exists(path):
            made = os.path.join(os.path.dirname(source), f"part-{name}")
            write(made, np.load(source, mmap_mode="r") if os.path.getsize(source) > 128 else np.load(source))
            os.rename(made, path)
        return open_array(spark, path)

    return opened


whole_npy, whole_zarr, whole_hdf5 = _whole("e.npy"), _whole("t.zarr", _tree), _whole("t.h5", _hdf5)
_P = f"(SELECT i0, i1, v FROM {_E} WHERE i0 < 90)"
_CUT = f"SELECT i0 - 10 AS i0, i1 // 3 AS i1, v FROM {_P} WHERE i0 BETWEEN 10 AND 69 AND i1 % 3 = 0"
_HOLES = f"SELECT i0, i1, CASE WHEN i0 BETWEEN 30 AND 59 THEN -1::FLOAT ELSE v END AS v FROM {_P}"

_frame("scan_npy", lambda s, d: whole_npy(s, d)["array"][10:70, ::3], _CUT)
_frame("scan_zarr", lambda s, d: whole_zarr(s, d)["g/e"][10:70, ::3], _CUT)
_frame("scan_zarr_sharded", lambda s, d: whole_zarr(s, d)["shards"][10:70, ::3], _CUT)
_frame("scan_zarr_fill", lambda s, d: zarr_file(s, d)["holes"], _HOLES)
_frame("scan_hdf5", lambda s, d: whole_hdf5(s, d)["g/plain"][10:70, ::3], _CUT)
_frame("scan_hdf5_chunked", lambda s, d: whole_hdf5(s, d)["chunked"][10:70, ::3], _CUT)
_frame("scan_hdf5_fill", lambda s, d: hdf5_file(s, d)["holes"], _HOLES)
_frame("scan_null", lambda s, d: open_array(s, "uint8:1000x7@250", format="null")["array"][::10], "SELECT range // 70 AS i0, range % 7 AS i1, CAST(range % 250 AS SMALLINT) AS v FROM range(7000) WHERE (range // 7) % 10 = 0")
_frame("red_file", lambda s, d: hdf5_file(s, d)["chunked"].reduce("mean", 0), f"SELECT i1 AS i0, round(avg(v::DOUBLE), 5) AS v FROM {_P} GROUP BY i1", 5)

# the same files without a bound on their rows

_WHOLE = f"SELECT i0, i1, v FROM {_E}"
_ALL_HOLES = f"SELECT i0, i1, CASE WHEN i0 BETWEEN 30 AND 59 THEN -1::FLOAT ELSE v END AS v FROM {_E}"

_frame("scan_npy_whole", lambda s, d: whole_npy(s, d)["array"], _WHOLE)
_frame("scan_zarr_whole", lambda s, d: whole_zarr(s, d)["g/e"], _WHOLE)
_frame("scan_zarr_sharded_whole", lambda s, d: whole_zarr(s, d)["shards"], _WHOLE)
_frame("scan_zarr_fill_whole", lambda s, d: whole_zarr(s, d)["holes"], _ALL_HOLES)
_frame("scan_hdf5_whole", lambda s, d: whole_hdf5(s, d)["g/plain"], _WHOLE)
_frame("scan_hdf5_chunked_whole", lambda s, d: whole_hdf5(s, d)["chunked"], _WHOLE)
_frame("scan_hdf5_fill_whole", lambda s, d: whole_hdf5(s, d)["holes"], _ALL_HOLES)
_frame("red_file_whole", lambda s, d: whole_hdf5(s, d)["chunked"].reduce("mean", 0), f"SELECT i1 AS i0, round(CAST(CAST(avg(v::DOUBLE) AS FLOAT) AS DOUBLE), 5) AS v FROM {_E} GROUP BY i1", 5)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a grid of (32, 16) that [40:90, 20:30] meets."""
    from gridloom.sources.files import find

    stored = find(zarr_file(spark, sf_dir).real, "g/e")
    return spark.createDataFrame(list(stored.places({0: (40, 90), 1: (20, 30)})), "c0 long, c1 long")


_add("chunk_walk", _chunks, f"SELECT DISTINCT i0 // 32 AS c0, i1 // 16 AS c1 FROM {_P} WHERE i0 BETWEEN 40 AND 89 AND i1 BETWEEN 20 AND 29")


def _rows(schema: str, make: Callable[[SparkSession, str], list[tuple]]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.createDataFrame(make(spark, sf_dir), schema)


def _values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t({columns})"


_add("list_children", lambda s, d: zarr_file(s, d).listing().select("path", "kind", "dtype", F.array_join(F.transform("shape", lambda n: n.cast("string")), "x").alias("shape")),
     _values("path, kind, dtype, shape", "('g', 'group', NULL, NULL)", "('g/e', 'array', 'float32', '90x64')", "('holes', 'array', 'float32', '90x64')", "('shards', 'array', 'float32', '90x64')", "('v2', 'array', 'int16', '90x64')"))
_add("attrs", _rows("item string, name string, value string", lambda s, d: [(i, k, str(v)) for i, x in (("", zarr_file(s, d)), ("g/e", zarr_file(s, d)["g/e"]), ("h5", hdf5_file(s, d))) for k, v in x.attrs.items()]),
     _values("item, name, value", "('', 'title', 'demo')", "('', 'levels', '[1.5 2.5]')", "('g/e', 'units', '1')", "('h5', 'title', 'demo')"))


def _mapping(spark: SparkSession, sf_dir: str) -> list[tuple]:
    f = zarr_file(spark, sf_dir)
    return [("keys", ",".join(f.keys())), ("len", str(len(f))), ("contains", f"{'g' in f},{'g/e' in f},{'x' in f}"), ("items", ",".join(k for k, _ in f["g"].items())), ("slashes", str(f["/g/e/"] is f["g/e"]))]


_add("mapping", _rows("what string, answer string", _mapping), _values("what, answer", "('keys', 'g,holes,shards,v2')", "('len', '4')", "('contains', 'True,True,False')", "('items', 'e')", "('slashes', 'True')"))


def _items(spark: SparkSession, sf_dir: str) -> list[tuple]:
    f, out = npy_file(spark, sf_dir), []
    for item in ("array", "none", ""):
        try:
            out.append((item, type(f.item(item)).__name__))
        except KeyError:
            out.append((item, "NotFound"))
    f.close()
    try:
        f.item("array")
    except ValueError:
        out.append(("array", "closed"))
    return out


_add("get_item", _rows("item string, found string", _items), _values("item, found", "('array', 'ArrayFrame')", "('none', 'NotFound')", "('', 'Group')", "('array', 'closed')"))
_add("array_props", _rows("ndim int, size long, nbytes long, length int, shape string, dtype string", lambda s, d: [(a.ndim, a.size, a.nbytes, len(a), ",".join(map(str, a.shape)), a.dtype.name) for a in [zarr_file(s, d)["v2"]]]),
     "SELECT 2 AS ndim, 5760::BIGINT AS size, 11520::BIGINT AS nbytes, 90 AS length, '90,64' AS shape, 'int16' AS dtype")


def _typed(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """Reads that name the type that they expect, and what was delivered."""
    a, out = matrix(spark, sf_dir), []
    before = stats()
    for dtype in ("float32", "float64", "int32"):
        try:
            out.append((dtype, ",".join(map(str, a.read_as(dtype, slice(3, 13)).shape))))
        except TypeError:
            out.append((dtype, "TypeError"))
    after = stats()
    return [*out, ("reads", str(after["reads"] - before["reads"])), ("bytes", str(after["bytes"] - before["bytes"]))]


_add("typed_stats", _rows("what string, answer string", _typed), _values("what, answer", "('float32', '10,64')", "('float64', 'TypeError')", "('int32', 'TypeError')", "('reads', '1')", "('bytes', '2560')"))


def _formats(spark: SparkSession, sf_dir: str) -> list[tuple]:
    out = []
    for path, named in (("a.npy", None), ("a.nc", None), ("a.H5", None), ("a.zarr/", None), ("a.npy", "zarr"), ("a.txt", None), ("a", None)):
        try:
            out.append((path, named or "", format_of(path, named)))
        except ValueError:
            out.append((path, named or "", "ValueError"))
    return out


_add("format_dispatch", _rows("path string, named string, format string", _formats), _values("path, named, format", "('a.npy', '', 'npy')", "('a.nc', '', 'hdf5')", "('a.H5', '', 'hdf5')", "('a.zarr/', '', 'zarr')", "('a.npy', 'zarr', 'zarr')", "('a.txt', '', 'ValueError')", "('a', '', 'ValueError')"))


def _paths(spark: SparkSession, sf_dir: str) -> list[tuple]:
    npy_file(spark, sf_dir)
    out = []
    for path in ("e.npy", "../e.npy", "/etc/passwd", "none.npy"):
        try:
            allowed(path, [_folder(spark, sf_dir)])
            out.append((path, "allowed"))
        except NotAllowed:
            out.append((path, "refused"))
    return out


_add("path_policy", _rows("path string, answer string", _paths), _values("path, answer", "('e.npy', 'allowed')", "('../e.npy', 'refused')", "('/etc/passwd', 'refused')", "('none.npy', 'refused')"))


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of an earlier, wider selection, and what the cache counted."""
    from gridloom.operators.cache import SelectionCache

    cache, a = SelectionCache(1 << 20), events(spark, sf_dir)
    cache.select("e", a, slice(100, 900, 2))
    out = cache.select("e", a, slice(700, 200, -6))
    n = cache.stats()
    return out.df.withColumns({"hits": F.lit(n["hits"]), "misses": F.lit(n["misses"])})


_add("cache_lookup", _cached, f"SELECT (700 - i0) // 6 AS i0, v, 1 AS hits, 1 AS misses FROM {_EV} WHERE i0 > 200 AND i0 <= 700 AND (700 - i0) % 6 = 0")


def _cache_counts(spark: SparkSession, sf_dir: str) -> list[tuple]:
    from gridloom.operators.cache import SelectionCache

    cache, a = SelectionCache(3000), events(spark, sf_dir)
    for key in (slice(0, 300), slice(10, 20), slice(400, 700), [1, 2], slice(400, 701), slice(0, 1000)):
        cache.select("e", a, key)
    n = cache.stats()
    cache.drop()
    return [(n["hits"], n["misses"], n["evictions"], n["entries"], n["bytes"], cache.stats()["entries"])]


_add("cache_store", _rows("hits int, misses int, evictions int, entries int, bytes long, dropped int", _cache_counts), "SELECT 1 AS hits, 5 AS misses, 1 AS evictions, 1 AS entries, 2408::BIGINT AS bytes, 0 AS dropped")


def _policies(spark: SparkSession, sf_dir: str) -> list[tuple]:
    a, out = events(spark, sf_dir)[:50], []
    try:
        for mode in ("allow", "warn", "error"):
            set_policy(mode, 100)
            with warnings.catch_warnings(record=True) as seen:
                warnings.simplefilter("always")
                try:
                    np.asarray(a)
                    out.append((mode, "warned" if any(w.category is FallbackWarning for w in seen) else "silent"))
                except MemoryError:
                    out.append((mode, "refused"))
    finally:
        set_policy()
    return out


_add("fb_policy", _rows("mode string, answer string", _policies), _values("mode, answer", "('allow', 'silent')", "('warn', 'warned')", "('error', 'refused')"))
_frame("fn_fallback", lambda s, d: ArrayFrame.of_numpy(s, np.asarray(np.diff(events(s, d)[:100]))), f"SELECT i0, round(lead(v) OVER (ORDER BY i0) - v, 6) AS v FROM {_EV} WHERE i0 < 100 QUALIFY i0 < 99", 6)
__all__ = ["ORACLES", "QUERIES"]
