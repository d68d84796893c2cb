"""Every query of the catalogue against its SQL, and known counts."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from clientela.plans.catalogue import QUERIES
from clientela.plans.oracles import ORACLES

from conftest import TESTDATA
from helpers import sort_rows, sorted_rows

SQL_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in Path(TESTDATA / "sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_names_and_types(spark, sf_dir, sql, name):
    got = QUERIES[name](spark, sf_dir)
    cursor = sql.execute(ORACLES[name])
    types = {column[0]: str(column[1]) for column in cursor.description}
    names = [column[0] for column in cursor.description]
    rows = cursor.fetchall()
    assert {c: SQL_TYPES[t] for c, t in got.dtypes} == types
    order = [names.index(c) for c in sorted(names)]
    want = sort_rows([tuple(row[i] for i in order) for row in rows])
    assert want and sorted_rows(got) == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["TYP_CAMP", "MIN_DATE", "MAX_DATE", "TOT_EVENTs", "TOT_CLIs"]
    assert df.count() == 6


FUNNEL_COUNTS = {"sf0.001": (56, 22, 3, 37), "sf0.01": (479, 208, 44, 275), "sf0.1": (5400, 2297, 565, 3019)}
MISSING_COUNTS = {"sf0.001": (77, 14, 0, 26), "sf0.01": (862, 164, 24, 254), "sf0.1": (8782, 1755, 263, 2497)}


@pytest.mark.parametrize("query,counts", [("funnel", FUNNEL_COUNTS), ("funnel_missing", MISSING_COUNTS)])
@pytest.mark.parametrize("sf", FUNNEL_COUNTS)
def test_funnel_counts(spark, sf, query, counts):
    funnel = QUERIES[query](spark, str(TESTDATA / sf))
    row = funnel.selectExpr(
        "count(*)", "count_if(OPENED)", "count_if(CLICKED)", "count_if(FAILED)"
    ).first()
    assert tuple(row) == counts[sf]
