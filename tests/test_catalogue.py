"""Every registered query against its SQL, and independence from partitioning."""

import duckdb
import pandas as pd
import pytest

from latticework.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    from pathlib import Path

    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)
    return sorted((tuple(clean(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, db, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(db.sql(catalogue.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_same_under_other_partitions(spark, name):
    first = rows(catalogue.QUERIES[name](spark, SF).toPandas())
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert first and rows(catalogue.QUERIES[name](spark, SF).toPandas()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(catalogue.QUERIES) <= set(entry.queries())
