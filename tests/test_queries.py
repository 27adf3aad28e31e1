"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from folioqc.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def canonical(df):
    df = df[sorted(df.columns)]

    def show(v):
        if v is None or v is pd.NA or v != v:
            return "-"
        return f"{v + 0.0:.5f}" if isinstance(v, float) and math.isfinite(v) else str(v)

    return sorted(tuple(map(show, row)) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, db, name):
    got, want = catalog.QUERIES[name](spark, FOLDER).toPandas(), db.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_paragraphs_take_every_line(spark):
    pages = spark.createDataFrame([(1, 0, "\n".join(f"line {i}" for i in range(60))), (1, 1, "a\nb")], "job_id long, page_index int, text string")
    rows = catalog._paragraphs(pages).orderBy("page_index", "ord").collect()
    assert [r.text for r in rows] == [*(f"line {i}" for i in range(60)), "a", "b"]
    assert all(a.bbox.y1 <= b.bbox.y0 for a, b in zip(rows[:59], rows[1:60])) and rows[59].bbox.y1 <= 1
    assert (rows[61].bbox.y0, rows[61].bbox.y1) == (1 / 16.0, 1 / 16.0 + 0.05)
