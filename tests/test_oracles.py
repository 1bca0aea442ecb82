"""Every query with an oracle, against DuckDB on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from dosepath.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool | str | datetime.date):
        return str(v)
    return repr(round(float(v), 6))


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def connected(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return connected(SF)


def same(spark, duck, name, sf):
    df = QUERIES[name](spark, sf)
    found = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert as_rows(df.columns, [tuple(r) for r in df.collect()]) == as_rows(found.columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    same(spark, duck, name, SF)


@pytest.mark.parametrize("name", ["dispensing_eras", "exposure_dedupe", "era_gap_merge", "era_gap_merge_raw", "era_gap_merge_hot", "restart_events", "lloyd_sweep"])
def test_query_of_repeated_starts_equals_oracle_on_more_rows(spark, name):
    """Rows that share person, ingredient and start are on the larger tables only."""
    same(spark, connected(SF.replace("0.001", "0.01")), name, SF.replace("0.001", "0.01"))


@pytest.mark.parametrize(("name", "person", "shift"), [("person_phenotypes", 11254, 33180), ("phenotype_counts", 11254, 33180), ("internal_indices", 11254, 33180), ("negative_controls", 14190, 265440)])
def test_phenotypes_of_slopes_on_the_threshold_equal_oracle(spark, tmp_path, name, person, shift):
    """A person of the larger tables under an id by which follow-up ends with a slope of exactly -0.1, among others."""
    con, sf = duckdb.connect(), SF.replace("0.001", "0.1")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    kept = {"orders": f"SELECT * REPLACE (o_custkey + {shift} AS o_custkey) FROM orders WHERE o_custkey BETWEEN {person - 20} AND {person + 20}"}
    kept["lineitem"] = f"SELECT lineitem.* FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey BETWEEN {person - 20} AND {person + 20}"
    kept["customer"] = f"SELECT * REPLACE (c_custkey + {shift} AS c_custkey) FROM customer"
    for t in TABLES:
        con.execute(f"COPY ({kept.get(t, f'SELECT * FROM {t}')}) TO '{tmp_path}/{t}.parquet'")
    same(spark, connected(tmp_path), name, str(tmp_path))


def test_flagship_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)
