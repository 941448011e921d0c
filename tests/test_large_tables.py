"""What larger tables brought up: cubes whose every cell is beyond 16 bits, and many grids, against the SQL."""

import duckdb
import numpy as np
import pytest
from pyspark import TaskContext

from gridloom.image import exact_scaling, from_numpy
from gridloom.queries import QUERIES, SQL

from .conftest import DATA
from .test_queries import plain

#: Queries of the packed cube.
PACKED = [
    "blocked_reorient_swap_packed",
    "assign_at_accounts_packed",
    "assign_packed",
    "blocked_dense_plus_packed",
    "blocked_reduce_packed_max_by_k",
    "blocked_reduce_packed_mean_by_k",
    "blocked_reduce_packed_min_by_k",
    "blocked_reduce_packed_sd_by_k",
    "blocked_reduce_packed_sum_by_k",
    "blocked_reduce_packed_var_by_k",
    "blocked_reduce_packed_which_max_by_k",
    "blocked_reduce_packed_which_min_by_k",
]
#: Queries of a grid for each customer.
GRIDS = [
    "geometry_accessors",
    "progress_bar",
    "geometry_precedence",
    "geometry_same",
    "geometry_setters",
    "geometry_inverse",
    "geometry_drop_axes",
    "geometry_permuted",
]


@pytest.fixture(scope="module")
def full(tmp_path_factory):
    """Lines that fill the cube, each cell with another quantity from 40,000 to 250,000, and new values for a third of the cells."""
    folder, c = tmp_path_factory.mktemp("full"), duckdb.connect()
    tables = {
        "part": "SELECT g::BIGINT AS p_partkey, (g + 1)::INTEGER AS p_size FROM range(50) AS t(g)",
        "lineitem": "SELECT (g % 50)::BIGINT AS l_partkey, ((g // 50) % 7 + 1)::INTEGER AS l_linenumber, (40000 + 50 * ((g * 1237) % 4201))::DOUBLE AS l_quantity, make_date(1995, (g // 350 + 1)::INTEGER, 15) AS l_shipdate FROM range(4200) AS t(g)",
        "customer": "SELECT g::BIGINT AS c_custkey, (g % 25)::INTEGER AS c_nationkey, (g * 37 % 9000)::DOUBLE AS c_acctbal FROM range(1400) AS t(g)",
    }
    for name, sql in tables.items():
        c.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet'")
        c.execute(f"CREATE VIEW {name} AS FROM '{folder}/{name}.parquet'")
    return str(folder), c


@pytest.fixture(scope="module")
def customers(tmp_path_factory):
    """Three copies of the customers with shifted keys, in one file."""
    folder, c = tmp_path_factory.mktemp("customers"), duckdb.connect()
    c.execute(f"COPY (SELECT x.* REPLACE (c_custkey + 1000003 * r AS c_custkey) FROM '{DATA}/customer.parquet' AS x, range(3) AS t(r)) TO '{folder}/customer.parquet'")
    c.execute(f"CREATE VIEW customer AS FROM '{folder}/customer.parquet'")
    return str(folder), c


def same_rows(rows, columns, duck, sql):
    result = duck.execute(sql)
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str) == sorted((tuple(plain(r[k]) for k in at) for r in result.fetchall()), key=str)


@pytest.mark.parametrize("name", PACKED)
def test_packed_cube_beyond_16_bits(spark, full, name):
    folder, duck = full
    df = QUERIES[name](spark, folder)
    same_rows(df.collect(), sorted(df.columns), duck, SQL[name])


def test_image_kinds_beyond_16_bits(spark, full):
    """Its SQL wants 16 bits and the exact total: the values have a common step."""
    folder, duck = full
    df = QUERIES["image_kinds"](spark, folder)
    same_rows(df.collect(), sorted(df.columns), duck, SQL["image_kinds"])


def test_exact_scaling(spark):
    packed = lambda *v: (lambda x: x.as_packed("int16", *exact_scaling(x, "int16")))(from_numpy(spark, np.array(v)))
    for v in ((3.0, -7.0), (40_000.0, 100_000.0, 99_999.0), (-6e9, 0.0, 6e5), (7e6, 7e6), (0.0, 65_535 * 12.0), (1.0 - 2**50, 2.0**50)):
        assert packed(*v).to_numpy().tolist() == list(v)
    assert packed(3.0, -7.0).slope == 1 and packed(3.0, -7.0).intercept == 0
    for v in ((0.0, 1.0, 65_536.0), (0.5, 1.0), (0.0, float("inf")), (0.0, 2.0**51)):
        with pytest.raises(ValueError, match="exactly"):
            packed(*v)


@pytest.mark.parametrize("name", GRIDS)
def test_grids_are_worked_on_by_all_cores(spark, customers, name):
    folder, duck = customers
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    rows = df.rdd.map(lambda r: (TaskContext.get().partitionId(), r)).collect()
    assert len({task for task, _ in rows}) >= spark.sparkContext.defaultParallelism
    same_rows([r for _, r in rows], columns, duck, SQL[name])
