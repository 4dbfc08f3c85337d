"""Every registered query runs on whole tables; those with SQL equal it."""

import os
from pathlib import Path

import pytest

from lingoweave.llm import queries

DATA = os.environ.get("LINGOWEAVE_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
COLUMNS = {"p2_found": ["ord", "defect"], "p3_found": ["ord", "segment_no", "lang"], "p4_found": ["first_ord", "copy_ord"], "p7_found": ["table_name", "ord"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, DATA)
    rows = df.collect()
    assert df.columns == COLUMNS.get(name, df.columns)
    if name in COLUMNS:
        assert len(rows) == len(set(rows)) and all(k == "bigint" or c in ("defect", "lang", "table_name") for c, k in df.dtypes)
    sql = queries.oracle_sql().get(name)
    if sql:
        import duckdb

        c = duckdb.connect()
        for p in Path(DATA).glob("*.parquet"):
            c.execute(f"create view {p.stem} as select * from '{p}'")
        rel = c.sql(sql)
        assert sorted(map(tuple, rows)) == sorted(rel.fetchall()) and list(rel.columns) == df.columns
