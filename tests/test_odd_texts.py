"""Queries against their SQL on small tables with texts that the generated ones hold rarely."""

import duckdb
import pytest

import __spark_entry__ as entry


def both(spark, folder, name, tables):
    """The rows of a query and of its SQL over tables of a folder, as sorted tuples in the order of the query's columns."""
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


@pytest.mark.parametrize("title", ["Salt &amp; Pepper", "Salt &amp", "a &ampamp; b", "a &amp;lt; b", "&lt &gt; &quot &copy", "&am"])
def test_references_without_semicolon(spark, tmp_path, title):
    pages = spark.createDataFrame([(1, "u", f"<html><title>{title}</title><body>{title}<p>x</body></html>")], "page_id long, url string, html string")
    got, want = both(spark, tmp_path, "S08_visible_text", {"pages": pages})
    assert got == want and len(got) == 1


@pytest.mark.parametrize("text, ranking", [("die bestä sch", False), ("best", True), ("äbest of", False), ("the (best) one", True), ("not the best", False), ("nötnot äbest, most", True), ("“best”", True), ("最高", True), ("是best的", False)])
def test_rank_words_beside_other_letters(spark, tmp_path, text, ranking):
    turns = spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn int, role string, text string")
    got, want = both(spark, tmp_path, "Q02_ranking_intent", {"conversations": turns})
    assert got == want == [(1, 0, ranking)]


def test_chunks_of_odd_documents(spark, tmp_path):
    long = "# Head\n" + "One sentence \U0001f986 here. " * 90 + "\n\n| a | b |\n|---|---|\n| 1 | 2 |\n"
    texts = [(1, long), (1, "x" * 700), (1, long), (2, ""), (3, None), (None, "no id"), (None, None), (2**60 + 1, "\n"), (4, "\r\n\r\n" + long), (5, "")]
    documents = spark.createDataFrame([(i, t, "en", "s") for i, t in texts], "doc_id long, text string, lang string, source string")
    order = lambda rows: sorted(rows, key=str)
    documents.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["T08_chunk_invariant"]).fetchall()
    got = entry.queries()["T08_chunk_invariant"](spark, str(tmp_path))
    assert order(map(tuple, got.collect())) == order(want) and len(want) == len(texts)
    assert "Exchange" not in got._jdf.queryExecution().sparkPlan().toString()
    parts = entry.queries()["T08_chunks"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in parts} == {1, 4, 2**60 + 1, None} and sum(len(r.text) for r in parts) == sum(len(t or "") for _, t in texts)
