"""Every registered query runs, and gives the rows of its oracle SQL."""

import math
from collections import Counter

import duckdb
import pytest

from lodestone.plans.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in ORACLE_SQL:
        cursor = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        place = [names.index(c) for c in columns]
        want = Counter(tuple(plain(float(r[k]) if type(r[k]).__name__ == "Decimal" else r[k]) for k in place) for r in cursor.fetchall())
        assert rows == want
    else:
        assert rows
