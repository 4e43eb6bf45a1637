import os

import duckdb
import pytest

from gridloom.plans.files import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def key(df):
    return sorted(tuple("nan" if isinstance(v, float) and v != v else "0.0" if isinstance(v, float) and v == 0 else str(v) for v in row) for row in df.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    want = duck.sql(ORACLES[name]).df()
    got, want = got[sorted(got.columns)], want[sorted(want.columns)]
    assert list(got.columns) == list(want.columns)
    assert key(got) == key(want)


def test_entry():
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", ["scan_npy_whole", "scan_zarr_whole", "scan_zarr_sharded_whole", "scan_zarr_fill_whole", "scan_hdf5_whole", "scan_hdf5_chunked_whole", "scan_hdf5_fill_whole"])
def test_files_hold_all_rows(spark, duck, name):
    assert QUERIES[name](spark, FOLDER).count() == 64 * duck.sql("select count(*) from embeddings").fetchall()[0][0]
