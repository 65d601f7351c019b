import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom.llm import queries

SMALL = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
COLUMNS = {
    "p1_found": ["id_a", "id_b"], "p2_found": ["entity_type", "cutoff", "id"], "p3_found": ["id_a", "id_b"], "p4_found": ["id"], "p5_found": ["id"], "p6_found": ["id_a", "id_b"], "p7_found": ["item_id", "doc_id"], "p8_found": ["source"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_rows_are_distinct_and_equal_the_sql(spark, name):
    df = entry.queries()[name](spark, SMALL)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    rows = [tuple(str(x) for x in r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    if name in queries.ORACLES:
        con = duckdb.connect()
        con.execute("set timezone='UTC'")
        for f in glob.glob(SMALL + "/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        found = con.sql(queries.ORACLES[name])
        assert sorted(found.columns) == sorted(df.columns)
        order = [found.columns.index(c) for c in df.columns]
        assert sorted(rows) == sorted(tuple(str(r[i]) for i in order) for r in found.fetchall())


def test_p8_equals_its_definition_with_characters_for_tokens(spark):
    con = duckdb.connect()
    sql = f"with d as (select source, sum(coalesce(n_chars, 0)) n from '{SMALL}/documents.parquet' where source is not null group by 1) select t.source from '{SMALL}/mix_targets.parquet' t left join d using (source) where coalesce(n, 0) * max_repeats < weight * (select sum(n) from d)"
    assert {r[0] for r in con.sql(sql).fetchall()} == {r[0] for r in entry.queries()["p8_found"](spark, SMALL).collect()}


def test_p7_equals_brute_force(spark):
    import re

    con = duckdb.connect()
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = {}
    for i, t in con.sql(f"select item_id, text from '{SMALL}/eval_items.parquet'").fetchall():
        w = words(t)
        for k in range(len(w) - 11):
            runs.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for d, t in con.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall():
        w = words(t)
        for k in range(len(w) - 11):
            want |= {(i, d) for i in runs.get(tuple(w[k : k + 12]), ())}
    assert want <= {tuple(r) for r in entry.queries()["p7_found"](spark, SMALL).collect()}
