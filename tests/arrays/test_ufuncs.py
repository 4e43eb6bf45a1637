import itertools
import warnings

import numpy as np
import pytest

from gridloom.operators.frame import ArrayFrame, reset_stats, stats

F = np.array([[0.5, -1.0, np.nan], [2.25, np.inf, -0.0], [-3.5, 1e-3, 7.0], [0.1, -np.inf, 4.0]])
I = np.array([[100, -128, 5], [127, 0, -1], [3, 64, -77], [1, 2, 90]])


@pytest.fixture(scope="module")
def frames(spark):
    made = {d: ArrayFrame.of_numpy(spark, F.astype(d)) for d in ("float32", "float64")} | {d: ArrayFrame.of_numpy(spark, I.astype(d)) for d in ("int8", "int32", "int64", "uint8", "uint16")}
    for f in made.values():
        f.df.persist()
    return made


def same(got, want):
    assert isinstance(got, ArrayFrame) and got.shape == want.shape and got.dtype == want.dtype, (got, want.dtype)
    if want.dtype.kind == "f":
        np.testing.assert_allclose(got.to_numpy(), want, rtol=1e-6, atol=0)
    else:
        np.testing.assert_array_equal(got.to_numpy(), want)


@pytest.mark.parametrize("ufunc", [np.minimum, np.maximum, np.add, np.subtract, np.multiply, np.true_divide, np.less, np.greater_equal, np.equal, np.not_equal], ids=lambda u: u.__name__)
def test_binary(frames, ufunc):
    with np.errstate(all="ignore"):
        for d in ("float64", "float32", "int8", "int64", "uint16"):
            f, a = frames[d], (F if d[0] == "f" else I).astype(d)
            same(ufunc(f, f[1]), ufunc(a, a[1]))  # a row meets every row
            same(ufunc(f[:, :1], f), ufunc(a[:, :1], a))  # a column every column
            same(ufunc(f[2:3, 1:2], f[0]), ufunc(a[2:3, 1:2], a[0]))
            same(ufunc(f, 5), ufunc(a, 5))
            same(ufunc(3, f), ufunc(3, a))
        same(ufunc(frames["int8"], frames["float32"]), ufunc(I.astype("int8"), F.astype("float32")))
        same(ufunc(frames["uint8"], frames["int8"]), ufunc(I.astype("uint8"), I.astype("int8")))
        same(ufunc(frames["float64"], np.array([1.0, np.nan, 2.0])), ufunc(F, np.array([1.0, np.nan, 2.0])))


def test_outer_products_and_shapes(frames, spark):
    f = frames["float64"]
    same(f[:, :1] * f[2], F[:, :1] * F[2])
    same(f[:, 0].reshape(4, 1, 1) + f.reshape(1, 4, 3), F[:, 0].reshape(4, 1, 1) + F.reshape(1, 4, 3))
    same(f[1, 1] - f, F[1, 1] - F)
    with pytest.raises(ValueError):
        f + f[:, 0]
    empty = f[4:]
    same(empty + f[0], F[4:] + F[0])


@pytest.mark.parametrize("ufunc", [np.negative, np.absolute, np.square], ids=lambda u: u.__name__)
def test_integers_wrap(frames, ufunc):
    for d in ("int8", "int32", "int64", "uint8", "uint16"):
        same(ufunc(frames[d]), ufunc(I.astype(d)))


def test_extremes_of_int64(spark):
    x = np.array([np.iinfo("int64").min, np.iinfo("int64").max, -1, 3_037_000_500])
    f = ArrayFrame.of_numpy(spark, x)
    with np.errstate(all="ignore"):
        for got, want in ((f * f, x * x), (f + f, x + x), (-f, -x), (f - 1, x - 1), (abs(f), abs(x)), (f * 3, x * 3)):
            same(got, want)
    with pytest.raises(OverflowError):
        ArrayFrame.of_numpy(spark, x.astype("int8")) + 300


def test_operators_and_masks(frames):
    f, i = frames["float32"], frames["int32"]
    a, b = F.astype("float32"), I.astype("int32")
    with np.errstate(all="ignore"):
        same((f + 1) * 2 - f / 3, (a + 1) * 2 - a / 3)
        same(f > 0.1, a > 0.1)  # 0.1 in single precision
        same(1 - i, 1 - b)
        same(f**2, a**2)
    same(f[f > 0.1], a[a > 0.1])
    same(f[(f[:, 0] > 0) & ~(f[:, 2] >= 7)], a[(a[:, 0] > 0) & ~(a[:, 2] >= 7)])
    same(i[(i > 2) | (i == -1) ^ (i != i)], b[(b > 2) | (b == -1) ^ (b != b)])
    assert len({f, i}) == 2


def test_logarithms(spark):
    x = np.array([-2.0, -1.0, -0.5, 0.0, 3.0, np.nan, np.inf])
    f = ArrayFrame.of_numpy(spark, x)
    with np.errstate(all="ignore"):
        for ufunc in (np.log1p, np.log, np.log2, np.log10):
            np.testing.assert_allclose(ufunc(f).to_numpy(), ufunc(x), rtol=1e-12)


def test_initial_and_where(frames, spark):
    for d, axis in itertools.product(("float64", "int32"), (None, 0, 1)):
        f, a = frames[d], (F if d[0] == "f" else I).astype(d)
        for initial in (-500, 2, 900):
            for name in ("max", "min"):
                want = getattr(np, name)(a, axis=axis, initial=initial)
                np.testing.assert_array_equal(np.asarray(f.reduce(name, axis, initial=initial)), want)
                for mask in (a > 1, a > 10_000):
                    got = f.reduce(name, axis, where=ArrayFrame.of_numpy(spark, mask), initial=initial)
                    np.testing.assert_array_equal(np.asarray(got), getattr(np, name)(a, axis=axis, where=mask, initial=initial))
        for name in ("max", "min"):
            with pytest.raises(ValueError, match="identity"):
                f.reduce(name, axis, where=f > 1)
    assert np.isnan(np.asarray(frames["int32"].astype("float64").reduce("min", initial=np.nan)))


def test_degrees_of_freedom_are_warned_of(frames):
    with pytest.warns(RuntimeWarning, match="Degrees of freedom"):
        np.testing.assert_array_equal(np.asarray(frames["int32"].reduce("var", 0, ddof=4)), np.var(I, 0, ddof=4))
    with pytest.warns(RuntimeWarning, match="Degrees of freedom"):
        np.std(frames["float64"], axis=1, ddof=5)


def test_slices_of_nothing_but_nan_are_warned_of(spark):
    f = ArrayFrame.of_numpy(spark, np.array([[1.0, np.nan], [np.nan, np.nan]]))
    for name, words in (("nanmax", "All-NaN"), ("nanmin", "All-NaN"), ("nanmedian", "All-NaN"), ("nanmean", "Mean of empty")):
        with pytest.warns(RuntimeWarning, match=words):
            assert np.isnan(f.reduce(name, 1).to_numpy()).tolist() == [False, True]
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            f.reduce(name).to_numpy()


def test_typed_reads_and_stats(frames):
    reset_stats()
    assert frames["int8"].read_as("int8", 1).tolist() == I[1].tolist()
    with pytest.raises(TypeError):
        frames["int8"].read_as("int32")
    found = stats()
    assert (found["reads"], found["bytes"]) == (1, 3) and found["seconds"] > 0 and found["throughput"] > 0
