"""Queries whose cells do not fit 16 bits: quantities large enough, against the SQL."""

import os
import shutil

import duckdb
import numpy as np
import pytest

from gridloom.image import from_numpy, wide_enough
from gridloom.queries import QUERIES, SQL
from gridloom.sources.codec import StorageDescriptor, read_image, write_image

from .conftest import DATA
from .test_queries import plain

NAMES = ["codec_scaled", "source_scaled", "array_minus_packed", "assign_packed", "assign_at_accounts_packed", "blocked_dense_plus_packed", "blocked_reorient_flip_packed", "blocked_reorient_swap_packed", "blocked_reduce_packed_which_max_by_k", "blocked_reduce_packed_var_by_k", "reduce_packed_sum_by_k", "codec_packed_int16_big", "codec_sparse_uint16_little", "codec_layout", "image_from_bytes"]


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    folder = tmp_path_factory.mktemp("wide")
    for name in ("part", "customer"):
        shutil.copy(f"{DATA}/{name}.parquet", folder)
    c = duckdb.connect()
    c.execute(f"copy (select * replace (l_quantity * 5000 as l_quantity) from '{DATA}/lineitem.parquet') to '{folder}/lineitem.parquet'")
    for name in os.listdir(folder):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{folder}/{name}'")
    return str(folder), c


@pytest.mark.parametrize("name", NAMES)
def test_wide_cells(spark, wide, name):
    folder, duck = wide
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.execute(SQL[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in result.fetchall()), key=str)


def test_types_widen_only_where_needed(spark, tmp_path):
    assert [wide_enough("int8", 0, hi) for hi in (127, 128, 32767, 32768)] == ["int8", "int16", "int16", "int32"]
    assert wide_enough("uint8", 0, 510, 2.0) == "uint8" and wide_enough("int16", None, None) == "int16"
    with pytest.raises(ValueError, match="range"):
        wide_enough("int16", 0, 2**31)
    x = from_numpy(spark, np.array([1.0, 40_000.0]))
    assert x.as_packed("int16", 1.0, 0.0).as_dense().to_numpy().tolist() == [1, 32767]  # clamped, as asked
    assert x.as_packed("int16", 1.0, 0.0, widen=True).stored == "int32"
    assert x.as_packed("int16", 2.0, 0.0, widen=True).stored == "int16"
    d = StorageDescriptor("int16", slope=0.5, intercept=1.0)
    with pytest.raises(ValueError, match="range"):
        write_image(x, str(tmp_path / "a"), d)
    used = write_image(x, str(tmp_path / "a"), d, widen=True)
    assert used.type == "int32" and read_image(spark, str(tmp_path / "a"), used, (2,)).to_numpy().tolist() == [1, 40_000]
