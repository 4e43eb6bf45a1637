import json
import os

import numpy as np
import pytest

from gridloom.functions.dtypes import NAMES
from gridloom.operators.cache import SelectionCache
from gridloom.operators.frame import ArrayFrame
from gridloom.sources import zarr
from gridloom.sources.files import NotAllowed, NotFound, allowed, format_of, open_array
from gridloom.sources.writers import Hdf5Writer, zarr_array, zarr_group

S = np.arange(12 * 7 * 5, dtype=np.int32).reshape(12, 7, 5)


def typed(name):
    x = np.random.default_rng(0).random((5, 7)) * 100
    return (x + 1j * x[::-1]).astype(name) if name.startswith("complex") else (x > 50 if name == "bool" else x.astype(name))


def test_npy(spark, tmp_path):
    np.save(tmp_path / "s.npy", S)
    f = open_array(spark, str(tmp_path / "s.npy"))
    assert list(f) == ["array"] and "array" in f and "x" not in f and len(f) == 1
    a = f["array"]
    assert a.shape == S.shape and a.dtype == S.dtype
    assert (a[2:9:3, -1].to_numpy() == S[2:9:3, -1]).all() and a.reduce("sum").to_numpy() == S.sum()
    np.save(tmp_path / "f.npy", np.asfortranarray(S))
    with pytest.raises(ValueError):
        open_array(spark, str(tmp_path / "f.npy"))["array"]
    np.save(tmp_path / "t.npy", np.array(["a"]))
    with pytest.raises(TypeError):
        open_array(spark, str(tmp_path / "t.npy"))["array"]
    with open(tmp_path / "s.npy", "r+b") as g:
        g.truncate(400)
    with pytest.raises(OSError):
        open_array(spark, str(tmp_path / "s.npy"))["array"]
    np.save(tmp_path / "e.npy", np.zeros((0, 3)))
    assert open_array(spark, str(tmp_path / "e.npy"))["array"].to_numpy().shape == (0, 3)
    np.save(tmp_path / "o.npy", np.float64(7))
    assert open_array(spark, str(tmp_path / "o.npy"))["array"].to_numpy() == 7


def test_filters_drop_chunks(spark, tmp_path):
    zarr_array(str(tmp_path / "p.zarr"), S, (5, 3, 2))
    a = open_array(spark, str(tmp_path / "p.zarr"))[""]
    # a chunk outside the selection is broken: it must not be read
    with open(tmp_path / "p.zarr" / "c" / "2" / "2" / "2", "wb") as f:
        f.write(b"x")
    assert (a[:5, 0].to_numpy() == S[:5, 0]).all()
    with pytest.raises(Exception):
        a.to_numpy()


@pytest.mark.parametrize("codecs", [(), ("gzip",), ("zstd",), ("zstd", "crc32c")])
@pytest.mark.parametrize("inner", [None, (2, 2)])
def test_zarr_codecs(spark, tmp_path, codecs, inner):
    x = typed("float32")
    path = str(tmp_path / "c.zarr")
    zarr_array(path, x, (4, 4) if inner else (2, 3), codecs, fill=np.float32("nan"), inner=inner, skip=[(1, 1)])
    want = x.copy()
    want[(slice(4, 8), slice(4, 8)) if inner else (slice(2, 4), slice(3, 6))] = np.nan
    np.testing.assert_array_equal(open_array(spark, path)[""].to_numpy(), want)


@pytest.mark.parametrize("name", NAMES)
def test_types(spark, tmp_path, name):
    x = typed(name)
    zarr_array(str(tmp_path / "d.zarr"), x, (2, 3), keys="v2")
    np.save(tmp_path / "d.npy", x)
    Hdf5Writer().save(str(tmp_path / "d.h5"), {"d": (x, {"chunks": (2, 3), "filters": (2, 1)})})
    for path, item in (("d.zarr", ""), ("d.npy", "array"), ("d.h5", "d")):
        got = open_array(spark, str(tmp_path / path))[item].to_numpy()
        assert got.dtype == x.dtype and (got == x).all(), path


def test_zarr_tree_and_refusals(spark, tmp_path):
    root = str(tmp_path / "t.zarr")
    zarr_group(root, {"title": "x", "n": 3, "range": [1.5, 2.5], "odd": {"a": 1}})
    zarr_group(f"{root}/g")
    zarr_array(f"{root}/g/s", S, (5, 3, 2), attrs={"units": "m"})
    zarr_array(f"{root}/bad", S, (5, 3, 2))
    spec = json.load(open(f"{root}/bad/zarr.json"))
    f = open_array(spark, root)
    assert f.attrs["title"] == "x" and f.attrs["n"] == 3 and f.attrs["range"].tolist() == [1.5, 2.5] and "odd" not in f.attrs
    assert [r.path for r in f.listing().collect()] == ["bad", "g", "g/s"]
    assert f["/g/s/"].attrs == {"units": "m"} and (f["g"]["s"][3].to_numpy() == S[3]).all()
    with pytest.raises(NotFound):
        f["g/none"]
    for change in ({"codecs": [{"name": "blosc"}]}, {"data_type": "string"}, {"zarr_format": 2}, {"storage_transformers": [{"name": "x"}]}, {"fill_value": "text"}, {"chunk_grid": {"name": "odd"}}, {"codecs": [{"name": "transpose", "configuration": {"order": [2, 1, 0]}}, {"name": "bytes"}]}):
        json.dump(spec | change, open(f"{root}/bad/zarr.json", "w"))
        with pytest.raises((ValueError, TypeError)):
            open_array(spark, root)["bad"]
        assert list(open_array(spark, root)) == ["g"] and "bad" not in open_array(spark, root)
    assert zarr.crc32c(b"123456789") == 0xE3069283
    assert zarr.fill_value("0x7fc00000", np.dtype("f4")) != 1 and np.isinf(zarr.fill_value("-Infinity", np.dtype("f8")))


def test_hdf5(spark, tmp_path):
    path = str(tmp_path / "t.h5")
    part = np.full((50, 20), 9, np.int32)
    part[12:18, 5:15] = 1
    tree = {
        "g1": {"ds1": (np.arange(20000, dtype=np.float32).reshape(100, 200), {"attrs": {"units": "K", "valid_range": np.array([0.0, 1.0])}}), "g3": {"ds4": (np.zeros((100, 200), np.int16), {"fill": -3, "skip": [()]})}},
        "part": (part, {"chunks": (10, 10), "fill": 9, "skip": [(r, c) for r in range(5) for c in range(2) if r != 1]}),
        "s": (S, {"chunks": (5, 3, 2), "filters": (2, 1, 3)}),
    }
    Hdf5Writer().save(path, tree, {"title": "demo", "n": np.int64(4)})
    f = open_array(spark, path)
    assert f.attrs["title"] == "demo" and f.attrs["n"] == 4 and list(f) == ["g1", "part", "s"]
    assert f["g1/ds1"].attrs["units"] == "K" and f["g1/ds1"].attrs["valid_range"].tolist() == [0, 1]
    assert (f["g1/ds1"][10:20, ::50].to_numpy() == tree["g1"]["ds1"][0][10:20, ::50]).all()
    assert (f["g1/g3/ds4"][:3, :3].to_numpy() == -3).all()
    assert (f["part"].to_numpy() == part).all() and (f["s"][[3, 3, 0], 1].to_numpy() == S[[3, 3, 0], 1]).all()
    assert f["g1"]["/s"].shape == S.shape
    with pytest.raises(NotFound):
        f["g1/none"]
    f.close()
    with pytest.raises(ValueError):
        f["s"]


def test_synthetic(spark):
    a = open_array(spark, "uint16:300x7@100", format="null")["array"]
    want = (np.arange(300 * 7 * 2) % 100).astype(np.uint8).view(np.uint16).reshape(300, 7)
    assert (a[5:250:3].to_numpy() == want[5:250:3]).all()
    with pytest.raises(ValueError):
        open_array(spark, "uint16:3xq", format="null")["array"]


def test_dispatch_and_paths(tmp_path):
    assert format_of("a/b.NC") == "hdf5" and format_of("x.zarr/") == "zarr" and format_of("x.npy", "hdf5") == "hdf5"
    for wrong in (("x", None), ("x.txt", None), ("x.npy", "csv")):
        with pytest.raises(ValueError):
            format_of(*wrong)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.npy").write_bytes(b"")
    (tmp_path / "b.npy").write_bytes(b"")
    os.symlink(tmp_path / "b.npy", tmp_path / "in" / "c.npy")
    roots = [str(tmp_path / "in")]
    assert allowed("a.npy", roots) == os.path.realpath(tmp_path / "in" / "a.npy")
    for wrong in ("../b.npy", "c.npy", str(tmp_path / "b.npy"), "none.npy"):
        with pytest.raises(NotAllowed):
            allowed(wrong, roots)


def test_cache(spark):
    import random

    f = ArrayFrame.of_numpy(spark, S)
    f.df.persist()
    cache = SelectionCache(10_000)
    rng = random.Random(2)
    part = lambda n: rng.choice([rng.randrange(n), slice(None), slice(rng.randrange(n), rng.randrange(n + 1)), slice(None, None, 2), slice(None, None, -1), [rng.randrange(n), 0]])
    keys = [Ellipsis, (slice(2, 9),), (slice(3, 8, 2), 1)] + [tuple(part(n) for n in S.shape[: rng.randrange(1, 4)]) for _ in range(12)]
    for key in keys:
        got, want = cache.select("s", f, key).to_numpy(), S[key]
        assert got.shape == want.shape and (got == want).all(), key
    assert cache.hits == len(keys) - 1 and cache.stats()["entries"] == 1
    small = SelectionCache(600)
    for key in ((slice(0, 2),), (slice(5, 8),), (slice(0, 1),), (slice(5, 8), 2)):
        assert (small.select("s", f, key).to_numpy() == S[key]).all()
    assert small.evictions == 1 and small.nbytes <= 600
    small.drop()
    assert small.stats()["entries"] == 0
