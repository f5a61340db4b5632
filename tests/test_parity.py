"""Registered queries against their SQL in DuckDB. ``PARITY=all`` runs every pair."""

import math
import os

import pytest

from shelfmark.plans import indexed, stored
from shelfmark.plans.oracle import ORACLE as FIRST_SQL
from shelfmark.plans.queries import QUERIES as FIRST

ORACLE = {**FIRST_SQL, **stored.ORACLE, **indexed.ORACLE}
QUERIES = {**FIRST, **stored.QUERIES, **indexed.QUERIES}

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()
SOME = ["search_or_not", "canonical_prices", "page_shop_key", "new_keys_per_page", "merge_observations", "rate_limit_active",
        "plan_crawl", "fuse_boost", "repaired_prices", *stored.QUERIES, *indexed.QUERIES]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = pytest.importorskip("duckdb").connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 4) if math.isfinite(value) else None
    if value is None or isinstance(value, (bool, int, str)):
        return value
    return round(float(value), 4)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def test_names():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE) if os.environ.get("PARITY") == "all" else SOME)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())
