"""All queries against their SQL on small tables full of gaps, copies and hot keys."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from clientela.plans.catalogue import QUERIES
from clientela.plans.oracles import ORACLES

from helpers import sort_rows, sorted_rows

# These rely on a promise that dirty data breaks.
NEEDS_CLEAN_IDS = {"funnel_unique_ids"}

SCHEMAS = {
    "region": {"r_regionkey": pa.int32(), "r_name": pa.string()},
    "nation": {"n_nationkey": pa.int32(), "n_name": pa.string(), "n_regionkey": pa.int32()},
    "customer": {"c_custkey": pa.int64(), "c_nationkey": pa.int32()},
    "part": {"p_partkey": pa.int64(), "p_brand": pa.string(), "p_type": pa.string()},
    "orders": {
        "o_orderkey": pa.int64(), "o_custkey": pa.int64(), "o_totalprice": pa.float64(),
        "o_orderdate": pa.timestamp("us"),
    },
    "lineitem": {"l_orderkey": pa.int64(), "l_partkey": pa.int64()},
    "events": {
        "event_id": pa.int64(), "ts": pa.timestamp("us"), "user_id": pa.int64(),
        "event_type": pa.string(), "props": pa.string(),
    },
}


def _tables(rng, n):
    """Columns of n rows (or fewer): values with gaps, a third of the rows on one key."""

    def gaps(values, share=0.05):
        return [None if rng.random() < share else v for v in values]

    def keys(high, size, hot=3):
        return gaps([hot if rng.random() < 0.33 else int(rng.integers(0, high)) for _ in range(size)])

    def picks(options, size):
        return gaps([options[i] for i in rng.integers(0, len(options), size)])

    def times(start, span, size, unit):
        return gaps([start + int(d) * unit for d in rng.integers(0, span, size)])

    few = min(n, 60)
    nations = min(n, 9)
    return {
        "region": {"r_regionkey": list(range(min(n, 3))), "r_name": ["AFRICA", None, "ASIA"][:n]},
        "nation": {
            "n_nationkey": list(range(nations)),
            "n_name": gaps([f"NATION_{i}" for i in range(nations)], 0.1),
            "n_regionkey": [i % 3 for i in range(nations)],
        },
        "customer": {
            "c_custkey": [int(k) for k in rng.integers(0, 80, few)],
            "c_nationkey": keys(9, few),
        },
        "part": {
            "p_partkey": gaps([int(k) for k in rng.integers(0, 14, few)]),
            "p_brand": picks(["A", "B", "C", "D"], few),
            "p_type": picks(["PROMO", 'a;b"c', " x\\y "], few),
        },
        "orders": {
            "o_orderkey": keys(n, n),
            "o_custkey": keys(25, n),
            "o_totalprice": gaps((rng.integers(1, 999999, n) / 100).tolist()),
            "o_orderdate": times(datetime(2019, 1, 1), 200, n, timedelta(days=1)),
        },
        "lineitem": {"l_orderkey": keys(40, n), "l_partkey": keys(14, n, hot=1)},
        "events": {
            "event_id": gaps([int(k) for k in rng.integers(0, max(n, 1), n)]),
            "ts": times(datetime(2024, 3, 9, 20), 10**6, n, timedelta(seconds=1)),
            "user_id": keys(5, n),
            "event_type": picks(["signup", "view", "click", "error", "purchase", "other"], n),
            "props": picks(['{"k": 3}', '{"k": 13}', '{"k": 24}', '{"k": 1}', "{}"], n),
        },
    }


@pytest.fixture(scope="module", params=[(1, 400), (2, 90), (3, 0)], ids=["dirty", "small", "empty"])
def star_dir(request, tmp_path_factory):
    seed, n = request.param
    folder = tmp_path_factory.mktemp(f"star{n}")
    for name, columns in _tables(np.random.default_rng(seed), n).items():
        arrays = {c: pa.array(v, SCHEMAS[name][c]) for c, v in columns.items()}
        pq.write_table(pa.table(arrays), folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def sql(star_dir):
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{star_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(ORACLES) - NEEDS_CLEAN_IDS))
def test_same_rows(spark, star_dir, sql, name):
    cursor = sql.execute(ORACLES[name])
    names = [column[0] for column in cursor.description]
    order = [names.index(c) for c in sorted(names)]
    want = sort_rows([tuple(row[i] for i in order) for row in cursor.fetchall()])
    got = sorted_rows(QUERIES[name](spark, star_dir))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, rel=1e-12, abs=0) if _numeric(w) else g == w


def _numeric(row):
    return all(isinstance(v, (int, float)) for v in row)
