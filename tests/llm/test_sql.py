"""Corpus operators that SQL can say, against their SQL in DuckDB."""

import duckdb
import pytest

from crosspanel.llm import queries
from tests.llm.helpers import documents
from tests.llm.test_simple_ops import rows

TABLES = "documents pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    check(con, name, rows(queries.QUERIES[name](spark, sf_dir)))


@pytest.mark.parametrize("name", ["op2_near_dup", "op5_suffix_dedup", "op8_decontaminate", "op11_spelling_variants"])
def test_awkward_texts_too(spark, tmp_path, name):
    documents(spark).where("text is null or length(text) < 50000").dropDuplicates(["doc_id"]).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "the lazy dog while the other dogs sleep near the old"), (2, "word"), (3, None), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    check(con, name, rows(queries.QUERIES[name](spark, str(tmp_path))))


def check(con, name, got):
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall()), key=key)
    assert not got or sorted(got[0]) == sorted(names)
    assert sorted((tuple(r[c] for c in sorted(names)) for r in got), key=key) == want
