import duckdb
import pytest

from memloom.llm.queries import ORACLES, QUERIES


def test_decoding_by_sql(spark, data):
    theirs = sorted(duckdb.sql(ORACLES["p6_decoded"].replace("documents", f"'{data}/documents.parquet'")).fetchall())
    assert sorted(tuple(r) for r in QUERIES["p6_decoded"](spark, data).collect()) == theirs


def test_terms_by_sql(spark, data):
    c = duckdb.connect()
    for t in ("memories", "qa_items"):
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    theirs = sorted(c.execute("select src_field, term, n_total, n_records, mark from (" + ORACLES["p1_found"] + ")").fetchall())
    ours = sorted(tuple(r) for r in QUERIES["p1_found"](spark, data).select("src_field", "term", "n_total", "n_records", "mark").collect())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, data, name):
    df = QUERIES[name](spark, data)
    want = {"p3_found": ["turn_id", "pii_type", "start_pos"], "p5_found": ["pair_table", "pair_id", "defect"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"], "p1_found": ["src_field", "term", "n_total", "n_records", "mark"]}
    assert df.columns == want.get(name, df.columns) and df.count() > 0
