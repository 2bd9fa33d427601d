"""Queries next to their SQL on rows that the test tables hold seldom or not at all."""

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def both(spark, folder, name, table):
    """Sorted rows of a query and of its SQL over one table of the folder."""
    frame = QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(frame.columns)} from ({ORACLES[name]})").fetchall()
    return sorted((tuple(r) for r in frame.collect()), key=repr), sorted(want, key=repr)


def test_hint_context_of_empty_and_null_values(spark, tmp_path):
    rows = [(1, "a text", "en", "web"), (2, "", "en", "web"), (3, "a text", "", "web"), (4, "a text", "en", ""), (5, None, "en", "web"), (6, "b", None, "web"), (7, "b", "en", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = both(spark, tmp_path, "hint_context", "documents")
    assert got == want and len(got) == 7


# Titles are cut off at a length, at times inside an entity; ids cover the cases the queries tell apart by id.
CUT = ["&quot", "&quo", "&copy", "&middot", "&middo", "&amp", "&am", "&lt", "&nbsp", "&quot;", "&amp;", "AT&T", "&amp;quot", "&quotx y", "&ampx y"]


@pytest.fixture(scope="module")
def cut_titles(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    head = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{0}</title><script>var a=1&&b;</script></head><body>'
    body = '<nav><ul><li><a href="/a">a</a></li></ul></nav><article><h1>{0}</h1><p>{1}</p></article><footer>&copy; x &middot; y</footer></body></html>'
    pages = [(12 * i + r, f"https://e.org/{i}/{r}", (head + body).format(f"token = {cut}", "word " * (40 if r % 2 else 4))) for i, cut in enumerate(CUT) for r in range(12)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", ["html_main_content", "html_meta", "html_text", "join_fallback_capture", "thin_content_filter"])
def test_titles_cut_inside_an_entity(spark, cut_titles, name):
    got, want = both(spark, cut_titles, name, "pages")
    assert got == want and len(got) > 0
