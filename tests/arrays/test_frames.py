import warnings

import numpy as np
import pytest

from gridloom.functions.dtypes import NAMES, result_dtype
from gridloom.operators.frame import ArrayFrame, FallbackWarning, set_policy

A = (np.arange(120, dtype=np.int32) * 37 % 251).reshape(8, 3, 5)


@pytest.fixture(scope="module")
def a(spark):
    f = ArrayFrame.of_numpy(spark, A)
    f.df.persist()
    return f


def test_gather_of_many_keys(a):
    keys = [(), 7, (slice(2, -1), 1), slice(6, 0, -3), slice(9, None), np.zeros(0, int), [5, 0, 5], ([6, 1], [2, 0]), ([4, 7], slice(None), [2, 4]), (3, slice(None), [4, 1]), (None, [7, 2], [0, 1]), (slice(None), None, 1), np.arange(8) % 3 == 1, A[:, :, 0] % 4 == 0, (7, 2, 4)]
    for key, got in zip(keys, a.gather_numpy(keys), strict=True):
        assert got.shape == A[key].shape and (got == A[key]).all(), key


def test_delivery(a):
    assert (np.asarray(a[1]) == A[1]).all() and a[1].to_numpy().flags.writeable is False
    out = np.zeros((3, 5), np.int32)
    assert (a.read_into(out, 2) == A[2]).all()
    for wrong in (np.zeros((3, 5)), np.zeros((5, 3), np.int32), np.zeros((3, 10), np.int32)[:, ::2]):
        with pytest.raises(ValueError):
            a.read_into(wrong, 2)
    assert (a.get_async((slice(None), 0)).result() == A[:, 0]).all()
    assert len(a) == 8 and a.ndim == 3 and a.size == 120 and a.nbytes == 480 and [x.shape for x in a][:1] == [(3, 5)]
    with pytest.raises(TypeError):
        len(a[0, 0, 0])
    assert (a.view[1:5].view[::-2].view[:, 1].to_numpy() == A[1:5][::-2][:, 1]).all()


def test_computed_masks(a, spark):
    mask = a.where(lambda v: v % 3 == 0)
    assert (a[mask].to_numpy() == A[A % 3 == 0]).all()
    rows = a[:, 0, 0].where(lambda v: v > 30)
    assert (a[rows].to_numpy() == A[A[:, 0, 0] > 30]).all()
    x = np.array([1.0, np.nan, 3.0])
    f = ArrayFrame.of_numpy(spark, x)
    assert (f.where(lambda v: v > 2).to_numpy() == (x > 2)).all()
    with pytest.raises(IndexError):
        a[ArrayFrame.of_numpy(spark, np.ones(4, bool))]


def values(name):
    rng = np.random.default_rng(3)
    d = np.dtype(name)
    if d.kind == "b":
        return rng.random((4, 3, 2)) < 0.5
    if d.kind in "iu":
        info = np.iinfo(d)
        return rng.integers(info.min, info.max, (4, 3, 2), dtype=d, endpoint=True)
    x = rng.uniform(0.8, 1.25, (4, 3, 2)) * rng.choice([-1, 1], (4, 3, 2))
    if d.kind == "c":
        x = x + 1j * rng.permutation(x.ravel()).reshape(x.shape)
    return x.astype(d)


EXACT = ("max", "min", "all", "any", "argmax", "argmin", "count_nonzero")


@pytest.mark.parametrize("name", ["bool", "int8", "int64", "uint16", "uint64", "float16", "float32", "float64", "complex128"])
@pytest.mark.parametrize("nan", [False, True])
def test_reductions(spark, name, nan):
    x = values(name)
    if nan:
        if x.dtype.kind not in "fc":
            pytest.skip("no NaN")
        x[1, 1, 0] = x[3, :, 1] = np.nan
        x[:, 2, 1] = np.nan
    f = ArrayFrame.of_numpy(spark, x)
    f.df.persist()
    jobs = []
    functions = ["sum", "prod", "mean", "max", "min", "nansum", "nanmax", "nanmin", "nanmean", "var", "std", "all", "any", "argmax", "argmin", "count_nonzero"]
    for function in functions:
        for axis, keep in ((None, False), (1, True), ((0, 2), False), (-1, False)):
            if function.startswith("arg") and isinstance(axis, tuple):
                continue
            if name == "float16" and function in ("prod", "sum", "mean", "var", "std", "nansum", "nanmean"):
                continue  # NumPy itself rounds at each step there
            jobs.append((function, axis, keep))
    tolerance = {2: 1e-3, 4: 1e-5, 8: 1e-10, 16: 1e-10}[max(2, x.dtype.itemsize if x.dtype.kind != "c" else 8)]
    for function, axis, keep in jobs:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            want = getattr(np, function)(x, axis=axis, keepdims=keep)
            got = f.reduce(function, axis, keep)
        assert got.dtype == result_dtype(function, x.dtype) == np.asarray(want).dtype or function == "count_nonzero", (function, got.dtype)
        assert got.shape == np.shape(want), (function, axis)
        found = got.to_numpy()
        if x.dtype.kind in "fc" and function not in ("all", "any", "argmax", "argmin", "count_nonzero"):
            np.testing.assert_allclose(found, want, rtol=tolerance, atol=tolerance, err_msg=f"{function} {axis}")
        elif found.dtype.kind == "f":
            np.testing.assert_allclose(found, want, rtol=1e-10)
        else:
            assert (found == want).all(), (function, axis, found, want)


def test_edges_of_reductions(spark, a):
    for function, want in (("sum", 0), ("prod", 1), ("all", True), ("any", False)):
        assert a[3:3].reduce(function).to_numpy() == want
        assert (a[3:3].reduce(function, 0).to_numpy() == np.full((3, 5), want)).all()
    with pytest.warns(RuntimeWarning):
        assert np.isnan(a[3:3].reduce("mean").to_numpy())
    for function in ("max", "min", "argmax", "nanmin"):
        with pytest.raises(ValueError):
            a[3:3].reduce(function)
    with pytest.raises(ValueError):
        a.reduce("sum", (0, 0))
    with pytest.raises(ValueError):
        a.reduce("sum", 3)
    with pytest.raises(TypeError):
        a.reduce("argmax", (0, 1))
    with pytest.raises(ValueError):
        a.reduce("var", ddof=0.5)
    x = A.astype(float)
    for ddof in (0, 1, 4, 6):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            want = np.var(x, axis=2, ddof=ddof)
        np.testing.assert_allclose(a.reduce("var", 2, ddof=ddof).to_numpy(), want)
    assert (a.reduce("sum", ()).to_numpy() == A).all()
    assert np.sum(a, axis=(0, 1), dtype="float64").to_numpy().tolist() == A.sum((0, 1)).tolist()
    assert np.max(a, axis=0, initial=70).to_numpy().tolist() == np.max(A, axis=0, initial=70).tolist()


def test_numpy_functions(spark, a):
    x = np.array([[3.0, -1.0, np.nan], [0.0, 5.0, 2.0], [3.0, 7.0, -4.0]])
    f = ArrayFrame.of_numpy(spark, x)
    with np.errstate(all="ignore"):
        for call in (np.sqrt, np.log, np.abs, np.negative, np.floor, np.sign, lambda v: np.add(v, v), lambda v: np.subtract(v, 2.5), lambda v: np.true_divide(1.0, v), lambda v: np.greater(v, 2), lambda v: np.not_equal(v, v), lambda v: np.multiply(v, v)):
            np.testing.assert_allclose(np.asarray(call(f)), call(x))
        for call in (lambda v: np.median(v, axis=0), lambda v: np.nanmedian(v), lambda v: np.cumsum(v, axis=0), lambda v: np.sort(v, axis=1), lambda v: np.argsort(v, axis=0, kind="stable") if isinstance(v, np.ndarray) else np.argsort(v, axis=0), lambda v: np.ptp(v, axis=1), lambda v: np.count_nonzero(v), lambda v: np.concatenate([v, v[:1]]), lambda v: np.cumprod(v, axis=1), lambda v: np.trace(v)):
            np.testing.assert_allclose(np.asarray(call(f)), call(x))
    assert (np.cumsum(a).to_numpy() == np.cumsum(A)).all()
    assert np.shape(a) == A.shape


def test_quality(spark):
    x = np.random.default_rng(1).standard_normal(200) * 10.0 ** np.arange(-10, 10).repeat(10)
    for dtype in ("float32", "float64"):
        f = ArrayFrame.of_numpy(spark, x.astype(dtype))
        for bound in (1e-3, 1e-6, 0.5):
            assert (np.abs(f.at(abs_error=bound).to_numpy().astype(float) - x.astype(dtype).astype(float)) <= bound).all()
    big = ArrayFrame.of_numpy(spark, np.array([1e300, 1.1, -1e300]))
    assert (big.at(dtype="float32").to_numpy() == np.array([np.inf, np.float32(1.1), -np.inf], np.float32)).all()
    half = ArrayFrame.of_numpy(spark, np.array([1e6, 0.1], np.float32)).at(dtype="float16")
    assert (half.to_numpy() == np.array([np.inf, 0.1], np.float16)).all() and half.dtype == np.float16
    with pytest.warns(UserWarning):
        assert big.at(rel_error=0.1).applied_quality == {"codec": "exact"}
    with pytest.raises(ValueError):
        big.at()
    with pytest.raises(ValueError):
        big.at(dtype="float32", abs_error=1)


def test_policy(spark, a):
    try:
        set_policy("error", 100)
        with pytest.raises(MemoryError):
            np.linalg.norm(a)
        set_policy("warn", 100)
        with pytest.warns(FallbackWarning):
            np.asarray(a)
        set_policy("allow", 100)
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            np.asarray(a)
        with pytest.raises(ValueError):
            set_policy("never")
    finally:
        set_policy()


@pytest.mark.parametrize("name", NAMES)
def test_types_survive(spark, name):
    rng = np.random.default_rng(0)
    x = rng.random((4, 3)) * 100
    x = (x + 1j * x[::-1]).astype(name) if name.startswith("complex") else x.astype(name)
    f = ArrayFrame.of_numpy(spark, x)
    for key in ((), (slice(None, None, 2), [2, 0]), (3, 1)):
        got = f[key].to_numpy()
        assert got.dtype == x.dtype and (got == x[key]).all()


def test_cumprod_stays_on_the_cluster(spark, monkeypatch):
    from gridloom.functions import numpy_api

    monkeypatch.setattr(numpy_api, "BLOCK", 7)
    a = np.random.default_rng(3).uniform(-1.2, 1.2, (40, 3))
    for axis in (0, 1, None):
        got = np.cumprod(ArrayFrame.of_numpy(spark, a), axis=axis)
        assert isinstance(got, ArrayFrame)
        np.testing.assert_allclose(got.to_numpy(), np.cumprod(a, axis=axis), rtol=1e-12)
