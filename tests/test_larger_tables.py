"""Queries over tables whose keys and groups go beyond those of the test data, against DuckDB."""

import duckdb
import pytest
from test_oracles import plain

from tessera.plans import registry


@pytest.fixture
def larger(tmp_path, sf_dir):
    """A folder with the test data's orders, customers and parts, each `times` times with keys shifted by `step`."""

    def make(times: int, step: int) -> str:
        con = duckdb.connect()
        for t, keys in {"orders": ("o_orderkey", "o_custkey"), "customer": ("c_custkey",), "part": ("p_partkey",)}.items():
            moved = ", ".join(f"{k} + i * {step} AS {k}" for k in keys)
            con.execute(f"COPY (SELECT * REPLACE ({moved}) FROM '{sf_dir}/{t}.parquet', unnest(range({times})) r(i)) TO '{tmp_path}/{t}.parquet'")
        return str(tmp_path)

    return make


def check(spark, name, folder):
    df = registry.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for t in ("orders", "customer", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cursor = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted(repr(tuple(map(plain, r))) for r in cursor.fetchall())
    assert sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect()) == want


def test_keyed_files_of_many_groups(spark, larger):
    check(spark, "keyed_json_read_back", larger(25, 1000))  # more objects than tasks that write


def test_sample_ids_beyond_six_digits(spark, larger):
    check(spark, "sample_records", larger(2, 1_234_567))
