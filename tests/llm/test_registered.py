"""The registered queries against DuckDB, and the pipeline."""

import sys
from pathlib import Path

import pytest

import corpus_pipeline
from conftest_llm import SF
from docloom.llm.queries import ORACLE, QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
from oracle_check import TABLES, digest  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    rows, cur = [tuple(r) for r in df.collect()], con.execute(ORACLE[name])
    columns, want = [c[0] for c in cur.description], cur.fetchall()
    assert rows and digest(df.columns, rows) == digest(columns, want)


def test_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))


def test_pipeline_stages(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == columns
        docs = corpus_pipeline.saved(out, "test")
        kept[name] = {r.doc_id for r in docs.collect()}
    ids = [kept[n] for n, _ in corpus_pipeline.STAGES]
    assert ids[0] > ids[1] >= ids[2] == ids[3] == ids[4] and len(ids[0]) < len(documents)
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id: list(r.ids) for r in docs.collect()}


def test_stages_take_nulls_repeats_clashing_columns_and_no_rows(spark, make):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, score string, ids string, spans string"
    rows = [(i, t, "en", None, 3, "r", "s", "i", "p") for i, t in [(1, None), (2, ""), (None, "Some usual words are here. They end."),
            (4, "mail a@b.co to them. It is a usual text."), (4, "mail a@b.co to them. It is a usual text."), (5, "w " * 50_000)]]
    for some in (rows, []):
        docs = make(some, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            got = out.collect()
            assert len(got) <= len(some) and (name == "pieces" or out.schema == docs.schema)
