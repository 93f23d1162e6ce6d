"""Every registered dataset query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from almanack.plans import operator_queries, queries, search_queries, source_queries  # noqa: F401  they register themselves
from almanack.plans import registry as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_same_rows(spark, sql, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    answer = sql.execute(plans.ORACLE[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == expected
