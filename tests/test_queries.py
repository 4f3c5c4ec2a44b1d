"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from trackloom.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    return v


def sorted_rows(names, rows):
    order = [names.index(n) for n in sorted(names)]
    return sorted(([plain(r[i]) for i in order] for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    relation = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(relation.columns, relation.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_module_without_the_text_operators(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


def test_other_session_zone(spark):
    """Nothing depends on the session's time zone."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    want = sorted(map(tuple, QUERIES["trips_closed"](spark, SF).collect()))
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/St_Johns")
        assert sorted(map(tuple, QUERIES["trips_closed"](spark, SF).collect())) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
