"""Term dictionaries against the rule term by term; index files over versions; mixed manifests."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import canonicalize_terms
from corpusloom.operators import source_index as X
from corpusloom.operators import terms as TM
from corpusloom.sinks.index_files import IndexConflict, IndexFile
from corpusloom.sources import manifests as M


def test_dictionary_equals_the_rule(spark):
    rng = random.Random(6)
    parts = ["Api", "api", "open", "Kit", "GPT-4", "x.y", "C++", "a", "A a", "语 AI", "$5 b", "q\\E", "K", "no1", "ſo"]
    terms = [" ".join(rng.choices(parts, k=rng.choice([1, 1, 2, 3]))) for _ in range(60)] + [" ", "漢字", "42", None]
    case = lambda s: "".join(rng.choice([c.lower(), c.upper()]) for c in s)
    texts = [(k, rng.choice(["", " ", "é"]).join(case(rng.choice(parts)) + rng.choice([" ", "", "，", "-"]) for _ in range(12))) for k in range(80)] + [(900, None), (901, "")]
    frame = spark.createDataFrame(texts, "id int, text string")
    rule = frame.select("id", canonicalize_terms(F.col("text"), F.array(*[F.lit(t) for t in terms])).alias("text"))
    got = TM.canonicalized(frame, spark.createDataFrame(list(enumerate(terms)), "pos int, term string"), ["id"])
    assert dict(got.collect()) == dict(rule.collect())


def test_a_large_dictionary_only_shows_what_texts_may_hold(spark):
    terms = spark.range(100_000).select(F.col("id").alias("pos"), F.concat(F.lit("Term"), F.col("id"), F.lit(" Name")).alias("term"))
    texts = spark.createDataFrame([(1, "a TERM77 name, term99999 NAME and term5 other"), (2, "nothing")], "id int, text string")
    assert dict(TM.canonicalized(texts, terms, ["id"]).collect()) == {1: "a Term77 Name, Term99999 Name and term5 other", 2: "nothing"}
    assert [tuple(r) for r in TM.terms_in(texts, terms, ["id"]).collect()] == [(1, ["Term77 Name", "Term99999 Name"])]


def test_terms_that_begin_alike_meet_no_text_without_their_other_words(spark):
    terms = spark.range(1000).select(F.col("id").alias("pos"), F.concat(F.lit("Part RING No"), F.col("id")).alias("term"))
    texts = spark.createDataFrame([(1, "part ring no7, PART ring nO8; part ring"), (2, "part ring no1000")], "id int, text string")
    assert [tuple(r) for r in TM.terms_in(texts, terms, ["id"]).collect()] == [(1, ["Part RING No7", "Part RING No8"])]
    assert dict(TM.canonicalized(texts, terms, ["id"]).collect()) == {1: "Part RING No7, Part RING No8; part ring", 2: "part ring no1000"}


def test_terms_by_scope_and_of_many_lengths(spark):
    terms = spark.createDataFrame([(1, 0, "A b C d E"), (1, 1, "b c"), (2, 0, "Ab")], "g int, pos int, term string")
    texts = spark.createDataFrame([(1, 1, "a B c d e, B C"), (2, 2, "ab a b c d e"), (3, 3, "ab")], "id int, g int, text string")
    assert dict(TM.canonicalized(texts, terms, ["id"], scope=["g"]).select("id", "text").collect()) == {1: "A b c d E, b c", 2: "Ab a b c d e", 3: "ab"}


def test_no_dictionary_goes_through_the_driver(spark, tmp_path):
    """A term costs about 6 bytes in its file and far more as a row: Spark would take millions of them for a small side."""
    spark.range(500).selectExpr("id AS pos", "concat('Term', id, ' Name') AS term", "id % 5 AS g").write.parquet(f"{tmp_path}/terms")
    spark.range(500).selectExpr("id", "concat('a TERM', id, ' name') AS text", "id % 5 AS g").write.parquet(f"{tmp_path}/texts")
    terms, texts = spark.read.parquet(f"{tmp_path}/terms"), spark.read.parquet(f"{tmp_path}/texts")
    for scope in (None, ["g"]):
        found = TM.canonicalized(texts, terms, ["id"], scope=scope)
        assert {r["id"]: r["text"] for r in found.collect()} == {k: f"a Term{k} Name" for k in range(500)}
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


INCOMING = "seq bigint, link string, extractor string, product string, day string, obsolete array<string>"


def shown(index):
    return [r["value"] for r in index.lines().orderBy("line_number").collect()]


def test_index_versions_keep_what_was_written_by_hand(spark, tmp_path):
    index = IndexFile(spark, str(tmp_path / "index"))
    assert index.merge(spark.createDataFrame([(0, "https://e.org/a", "Web", "20240101__a.md", "2024-01-01", [])], INCOMING)) == 0
    assert shown(index) == [X.INDEX_TITLE, "", X.INDEX_HEADER, X.INDEX_SEPARATOR, "| https://e.org/a | Web | `20240101__a.md` | 2024-01-01 | 否 |"]
    # Somebody edits the file: marks a row, writes before, inside and after the table.
    lines = shown(index)
    lines[4] = lines[4].replace("否", "是")
    lines = lines[:1] + ["By hand"] + lines[1:] + ["| stray |", "| https://e.org/b | Web | `b.md` | 2023-01-01 | 否 |", "", "The end"]
    index.write(spark.createDataFrame(list(enumerate(lines)), "no int, value string"), ["no"], 1)
    with pytest.raises(IndexConflict):
        index.merge(spark.createDataFrame([], INCOMING), expected=0)
    rows = [
        (0, "https://e.org/a/", "Web2", "20240101__a.md", "2024-02-02", []), (1, "https://e.org/c", "Web", "c.md", "2024-02-02", ["b.md"]), (2, "https://e.org/d", "Web", "d.md", "2024-02-02", []),
    ]
    assert index.merge(spark.createDataFrame(rows, INCOMING), expected=1) == 2
    assert shown(index) == [
        X.INDEX_TITLE, "By hand", "", X.INDEX_HEADER, X.INDEX_SEPARATOR, "| https://e.org/a/ | Web2 | `20240101__a.md` | 2024-02-02 | 是 |", "| stray |",
        "| https://e.org/c | Web | `c.md` | 2024-02-02 | 否 |", "| https://e.org/d | Web | `d.md` | 2024-02-02 | 否 |", "", "The end",
    ]
    with pytest.raises(IndexConflict):
        index.write(spark.createDataFrame([(0, "x")], "no int, value string"), ["no"], 2)


def test_foreign_and_old_index_files(spark, tmp_path):
    row = spark.createDataFrame([(0, "https://e.org/n", "Web", "n.md", "2024-02-02", [])], INCOMING)
    new = "| https://e.org/n | Web | `n.md` | 2024-02-02 | 否 |"

    def given(name, lines):
        index = IndexFile(spark, str(tmp_path / name))
        index.write(spark.createDataFrame(list(enumerate(lines)), "no int, value string"), ["no"], 0)
        return index

    foreign = given("foreign", ["# My notes", "| a | b |"])
    with pytest.raises(Exception, match="not an index file"):
        foreign.merge(row)
    assert foreign.version() == 0
    bare = given("bare", [X.INDEX_TITLE, "only prose"])
    bare.merge(row)
    assert shown(bare) == [X.INDEX_TITLE, "only prose", "", X.INDEX_HEADER, X.INDEX_SEPARATOR, new]
    old = given("old", [X.INDEX_TITLE, "", "| 链接 | Extractor | 产物路径 | 日期 |", "|---|---|---|---|", "| https://e.org/o | Web | `o.md` | 2020-01-01 |"])
    old.merge(row)
    assert shown(old) == [X.INDEX_TITLE, "", X.INDEX_HEADER, X.INDEX_SEPARATOR, "| https://e.org/o | Web | `o.md` | 2020-01-01 | 否 |", new]


def test_a_hot_link_is_summed_not_paired(spark):
    index = spark.createDataFrame([(k, "https://e.org/hot", "W", f"p{k}.md", "d", "否") for k in range(300)] + [(300, "—", "W", "x.md", "d", "否")], "row_no bigint, link string, extractor string, product string, day string, read string")
    incoming = spark.createDataFrame([(k, "https://e.org/hot/", "W", f"p{k}.md" if k < 3 else "new.md", "d", ["x.md"] if k == 7 else []) for k in range(400)], INCOMING)
    got = {r.row_no: (r.links, r.products, r.first_seq) for r in X.match_summary(index, incoming).collect()}
    assert got == {k: (400, 1 if k < 3 else 0, 0) for k in range(300)} | {300: (0, 1, 7)}


def test_mixed_manifests(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "one.TXT").write_bytes("﻿# note\r\nsee https://e.org/1 and https://e.org/2\n\n".encode())
    (tmp_path / "a" / "two.jsonl").write_text('{"source":"https://e.org/3","tags":["x"]}\n\n{"name":"n"}\n[1]\noops')
    (tmp_path / "a" / "b" / "three.csv").write_text('name,source,tags\n"two\nlines",https://e.org/4,"a,b"\n,,\nlast,e.org/5,\n')
    (tmp_path / "bad.csv").write_text("url\nhttps://e.org/9\n")
    (tmp_path / "readme.md").write_text("https://e.org/9")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "_hidden.txt").write_text("https://e.org/9")
    items, bad = M.record_items(M.manifest_records(spark, str(tmp_path)))
    short = lambda f: f.rsplit("/", 1)[-1]
    assert sorted((short(r.file), r.line_number, r.source, r.name, r.tags) for r in items.collect()) == [
        ("one.TXT", 2, "https://e.org/1", "", []), ("one.TXT", 2, "https://e.org/2", "", []), ("three.csv", 2, "https://e.org/4", "two\nlines", ["a", "b"]),
        ("three.csv", 4, "e.org/5", "last", []), ("two.jsonl", 1, "https://e.org/3", "", ["x"]),
    ]
    assert sorted((short(r.file), r.line_number, r.reason) for r in bad.collect()) == [
        ("bad.csv", 1, "no_source_column"), ("readme.md", 0, "not_a_manifest"), ("two.jsonl", 3, "source_missing"), ("two.jsonl", 4, "source_missing"), ("two.jsonl", 5, "not_json"),
    ]
    (tmp_path / "none").mkdir()
    assert M.manifest_records(spark, str(tmp_path / "none")).collect() == []


def test_the_index_match_holds_every_pair(spark):
    index = spark.createDataFrame([(k, "https://e.org/hot" if k < 3 else "本地视频", "W", f"p{k}.md", "d", "否") for k in range(6)], "row_no bigint, link string, extractor string, product string, day string, read string")
    incoming = spark.createDataFrame([(k, "https://e.org/hot/" if k < 4 else "—", "W", f"p{k}.md", "d", ["p5.md", "p0.md"] if k == 9 else []) for k in range(10)], INCOMING)
    want = {(r, s) for r in range(3) for s in range(4)} | {(k, k) for k in range(6)} | {(5, 9), (0, 9)}
    got = [tuple(r) for r in X.match_rows(index, incoming).collect()]
    assert len(got) == len(want) and set(got) == want


def test_the_match_query_gives_pairs_of_all_pages(spark):
    from corpusloom.plans import registry

    rows = registry.queries()["join_index_match"](spark, "/root/testdata/sf0.001")
    assert rows.columns == ["row_no", "seq"]
    pages = {r.page_id for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    own = {p for p in pages if p % 6 == 0}
    assert own <= {r.row_no for r in rows.where("row_no = seq").collect()}
