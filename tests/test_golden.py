"""Small typed inputs with the results they must give."""

from pyspark.sql import functions as F

from corpusloom.functions import cues as Q
from corpusloom.functions import html as H
from corpusloom.functions import naming as N
from corpusloom.functions import pages as P
from corpusloom.functions import payloads as J
from corpusloom.functions import refs as R
from corpusloom.functions import routing as C
from corpusloom.functions import text as T
from corpusloom.functions import verdicts as V
from corpusloom.operators import edits as E
from corpusloom.operators import inventory as I
from corpusloom.operators import segments as S
from corpusloom.sources import captures as SC
from corpusloom.sources import manifests as M


def one(spark, expr, **values):
    """Value of a column expression over one row of named strings."""
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("v")).first()["v"]


def test_references_in_pasted_text(spark):
    text = "看 https://a.org/x。 BV1xx411c7mD，xBV1xx411c7mE https://a.org/x (HTTP://B.org/y) BV1xx411c7mD"
    assert one(spark, R.extract_references(F.col("t")), t=text) == ["https://a.org/x", "BV1xx411c7mD", "HTTP://B.org/y"]


def test_reference_normal_forms(spark):
    cases = {
        ' "https://e.org/a\\&b" ': "https://e.org/a&b",
        "BV1xx411c7mD": "https://www.bilibili.com/video/BV1xx411c7mD",
        "复制打开 https://v.douyin.com/Q7xShareIt0/ 看": "https://v.douyin.com/Q7xShareIt0/",
        "e.org/?a=1&amp;timestamp=2": "https://e.org/?a=1&timestamp=2",
    }
    for raw, want in cases.items():
        assert one(spark, R.normalize_reference(F.col("t")), t=raw) == want


def test_channel_precedence(spark):
    cases = [
        ("https://mp.weixin.qq.com/sph/abc", "deferred"),
        ("https://weixin.qq.com/sphere", "web"),
        ("https://x.douyin.com/1", "douyin"),
        ("https://www.youtube.com/slides.pdf", "document"),
        ("https://e.org/a%2Epdf", "document"),
        ("https://mp.weixin.qq.com/s/x", "wechat"),
        ("https://m.bilibili.com/video/BV1xx411c7mD", "bilibili"),
        ("https://www.xiaoyuzhoufm.com/episode/0123456789abcdef01234567", "xiaoyuzhou"),
        ("https://www.xiaoyuzhoufm.com/podcast/1", "web"),
        ("https://zhihu.com/question/12/answer/3", "zhihu_question"),
        ("HTTPS://E.org", "unsupported"),
        ("ftp://e.org", "unsupported"),
    ]
    df = spark.createDataFrame(cases, "ref string, want string")
    got = df.select("ref", "want", C.classify(F.col("ref")).alias("got")).collect()
    assert [(r["ref"], r["got"]) for r in got] == [(r["ref"], r["want"]) for r in got]
    assert one(spark, C.classify(F.col("p"), F.lit(True)), p="/data/Talk.MP4") == "local_media"


def test_link_and_product_keys(spark):
    assert one(spark, R.link_key(F.col("t")), t="HTTPS://U@Ex.org:80/Path//?Q=1#F") == "https://U@ex.org:80/Path?Q=1#F"
    assert one(spark, R.link_key(F.col("t")), t="—") == ""
    assert one(spark, R.product_key(F.col("t")), t=" `a\\|b.md` ") == "a|b.md"


def test_names(spark):
    assert one(spark, N.safe_title(F.col("t")), t='a/b:c  "d".') == 'a_b_c _d_'
    assert one(spark, N.safe_title(F.col("t")), t=" ..") == "untitled"
    long = one(spark, N.safe_title(F.col("t")), t="云" * 90)
    assert long == "云" * 45
    emoji = one(spark, N.safe_title(F.col("t")), t="a" * 135 + "😀b")
    assert emoji == "a" * 135


def test_text_normalisation(spark):
    got = one(spark, T.normalize_text(F.col("t"), F.array(F.lit("FDE"))), t="先看一下 f d e 再 继续 😊")
    assert got == "先看一下 FDE 再继续"
    assert one(spark, T.normalize_text(F.col("t"), F.array(F.lit("C++ $1"), F.lit("PyTorch"))), t="use c++ $1 and PYTORCH") == "use C++ $1 and PyTorch"


def test_hints(spark):
    notes = (
        "Mira｜7Labs 工程师\n阿木｜[Kite Deck](https://kite.example/a) and [Lantern](https://lantern.example)\n"
        "主播：陈一｜夜航\n12:40 Tensor 入门"
    )
    assert one(spark, T.hint_people(F.col("t")), t=notes) == ["Mira", "阿木", "陈一"]
    terms = one(spark, T.hint_terms(F.lit("Go 夜谈"), F.lit("夜航"), F.col("t")), t=notes)
    assert {"7Labs", "Kite Deck", "Lantern", "Tensor", "Go"} <= set(terms)


def test_chapter_lines(spark):
    notes = "\n- 02:05 first part\n- [10:30](https://e.org/x) 第二部分\n### 1:00:09 wrap-up\nno time here\n02:05 again"
    got = one(spark, T.chapter_lines(F.col("t")), t=notes)
    assert [tuple(r) for r in got] == [(125.0, "first part"), (630.0, "第二部分"), (3609.0, "wrap-up")]


def test_cues_and_windows(spark):
    vtt = "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n<c>Hello</c>\n\n00:00:02,000 --> 00:00:04.000 x\nworld &amp; more\n\n00:05.000 --> 00:06.000\nno hours"
    got = one(spark, Q.parse_cues(F.col("t")), t=vtt)
    assert [tuple(c) for c in got] == [(1.0, 2.0, "Hello"), (2.0, 4.0, "world & more")]
    windows = one(spark, Q.reading_windows(Q.parse_cues(F.col("t"))), t=vtt)
    assert [tuple(w) for w in windows] == [(1.0, 4.0, "Hello world & more")]


def test_language_choice(spark):
    pick = lambda *l: one(spark, Q.pick_language(F.array(*[F.lit(x) for x in l])))
    assert pick("fr", "en", "zh-CN") == "zh-CN"
    assert pick("fr", "EN-us") == "EN-us"
    assert pick("fr", "de") == "fr"


def test_segments_render(spark):
    rows = [(1, 0, 2.0, 20.0, "red"), (1, 1, 21.0, 55.0, "green"), (1, 2, 250.0, 300.0, "blue"), (1, 3, 310.0, 345.0, "grey")]
    segments = spark.createDataFrame(rows, "doc_id long, seg_no long, start double, end double, text string")
    md = S.render_segments(S.segment_windows(segments)).first()["markdown"]
    assert md == "### 00:00–05:00\n\nred\n\ngreen\n\nblue\n\n### 05:00–05:45\n\ngrey"


def test_chapters_render(spark):
    rows = [(1, 0, 3.0, 10.0, "hello"), (1, 1, 40.0, 60.0, "before"), (1, 2, 130.0, 140.0, "within one"), (1, 3, 700.0, 710.0, "within two")]
    segments = spark.createDataFrame(rows, "doc_id long, seg_no long, start double, end double, text string")
    chapters = spark.createDataFrame([(1, 125.0, "One", 0), (1, 630.0, "Two", 1)], "doc_id long, start double, title string, pos int")
    got = [r["block_md"] for r in S.render_chapters(segments, chapters).orderBy("block_no").collect()]
    assert got == ["### 00:00 开场\n\nhello\n\nbefore", "### 02:05 One\n\nwithin one", "### 10:30 Two\n\nwithin two"]


def test_first_chapter_within_a_second_loses_earlier_text(spark):
    segments = spark.createDataFrame([(1, 0, 0.0, 0.5, "early"), (1, 1, 5.0, 6.0, "late")], "doc_id long, seg_no long, start double, end double, text string")
    chapters = spark.createDataFrame([(1, 0.8, "One", 0)], "doc_id long, start double, title string, pos int")
    assert [r["block_md"] for r in S.render_chapters(segments, chapters).collect()] == ["### 00:00 One\n\nlate"]


def test_error_classes(spark):
    cls = lambda m: one(spark, V.error_class(F.col("m")), m=m)["code"]
    assert cls("HTTP 429") == "rate_limited" and cls("the author") == "auth_required" and cls("boom") == "failed"


def test_view_payload(spark):
    payload = '{"code":0,"data":{"title":"T","owner":{"name":"U"},"pages":[{"page":1,"duration":5},{"page":2,"part":"second","duration":9}]}}'
    got = one(spark, J.view_info(F.col("p"), F.lit("BV"), F.lit(2)), p=payload)
    assert (got["status"], got["title"], got["duration"]) == ("ok", "T - P2 second", 9)
    assert one(spark, J.view_info(F.col("p"), F.lit("BV"), F.lit(3)), p=payload)["status"] == "missing_part"
    assert one(spark, J.view_info(F.col("p"), F.lit("BV"), F.lit(1)), p='{"code":-1}')["status"] == "unavailable"


def test_candidate_priority(spark):
    lit = lambda *u: F.array(*[F.lit(x) for x in u])
    got = one(spark, J.merge_candidates(lit("https://d/1"), lit("blob:x", "/p.mp4"), lit("https://n/1", "https://d/1"), F.lit("https://www.douyin.com/video/7")))
    assert got["media_candidates"] == ["https://d/1", "https://www.douyin.com/p.mp4", "https://n/1"] and got["saw_blob"]


def test_page_markdown_and_code(spark):
    html = "<html><head><title>A</title></head><body><div class='content'>x</div><article><h1>T</h1><p>one <a href='/b'>two</a></p><ul><li>i</li><li>j</li></ul></article></body></html>"
    got = one(spark, P.main_content(F.col("h"), F.lit("https://e.org/a/")), h=html)
    assert got["markdown"] == "# T\n\none [two](https://e.org/b)\n\n- i\n- j"
    code = '<div id="js_content"><p>a</p><section class="code-snippet__fix"><pre data-lang="js"><code>counter(line\n  let x_y = 1;</code></pre></section></div>'
    assert one(spark, P.article_body(F.col("h")), h=code)["body_md"] == "a\n\n\n```js\n  let x_y = 1;\n```"


def test_episode_page(spark):
    html = '<title>Ep - Show | 小宇宙</title><script id="__NEXT_DATA__" type="application/json">{"a":[{"title":"x"},{"title":"Ep","eid":"9","duration":"1234","enclosure":{"url":"https://m/a.m4a"},"podcast":{"title":"夜航电台"}}]}</script>'
    df = spark.createDataFrame([(html, "https://www.xiaoyuzhoufm.com/episode/0123456789abcdef01234567")], "h string, u string")
    e = P.episode_pages(df, F.col("h"), F.col("u"), "e").first()["e"]
    assert (e["title"], e["podcast_title"], e["duration"], e["audio_url"], e["episode_id"]) == ("Ep", "夜航电台", 1234, "https://m/a.m4a", "9")


def test_entities_in_one_pass(spark):
    assert one(spark, H.visible_text(F.col("h")), h="<p>&amp;lt; &#20013;&#x6587; &copy 2 &am</p><script>x</script>") == "&lt; 中文 © 2 &am"


def test_text_manifest(spark, tmp_path):
    (tmp_path / "m.txt").write_bytes("﻿# no\nA https://a.org/1 和 https://a.org/2。\n\n例 https://a.org/1 https://a.org/3 BV1xx411c7mD\nexample.org/x\nprose only\n\x0bhttps://a.org/9\n".encode())
    items = M.text_items(M.numbered_lines(spark, str(tmp_path), ".txt")).orderBy("line_number", "pos").collect()
    assert [(r["line_number"], r["source"]) for r in items] == [
        (2, "https://a.org/1"), (2, "https://a.org/2"), (4, "https://a.org/3"), (4, "BV1xx411c7mD"), (5, "example.org/x"), (8, "https://a.org/9"),
    ]


def test_strict_json_manifest_names_the_line(spark, tmp_path):
    import pytest

    (tmp_path / "m.jsonl").write_text('{"source":"https://a.org","tags":["x"," y "]}\nnot json\n', encoding="utf-8")
    loose = M.load_manifests(spark, str(tmp_path), suffixes=("jsonl",), strict=False).collect()
    assert [(r["source"], r["tags"]) for r in loose] == [("https://a.org", ["x", "y"])]
    with pytest.raises(Exception, match="bad manifest line 2"):
        M.load_manifests(spark, str(tmp_path), suffixes=("jsonl",)).collect()


def test_csv_manifest_counts_records(spark, tmp_path):
    (tmp_path / "m.csv").write_text('source,name,tags\nhttps://a.org,"two\nlines","web,ai"\n,skipped,\nhttps://b.org,B,x;y\n', encoding="utf-8")
    rows = M.csv_items(spark, str(tmp_path)).orderBy("line_number").collect()
    assert [(r["line_number"], r["source"], r["tags"]) for r in rows] == [(2, "https://a.org", ["web", "ai"]), (4, "https://b.org", ["x", "y"])]


def test_corpus_and_status_files(spark, tmp_path):
    import json

    import pytest

    (tmp_path / "sources.md").write_text("# 转写链接记录\n", encoding="utf-8")
    (tmp_path / "20240101__a.md").write_text("# A\n", encoding="utf-8")
    (tmp_path / "20240102__中 文").mkdir()
    (tmp_path / "20240102__中 文" / "content.md").write_text("# B\n", encoding="utf-8")
    got = {(r["source"], r["title"]) for r in SC.corpus_files(spark, str(tmp_path)).collect()}
    assert got == {("20240101__a.md", "A"), ("20240102__中 文/content.md", "B")}
    status = tmp_path / "status.json"
    status.write_text(json.dumps({"entries": [{"source": "a"}, {"source": "a"}]}), encoding="utf-8")
    with pytest.raises(Exception, match="duplicate or invalid source"):
        SC.status_entries(spark, str(status)).collect()


def test_reply_shapes(spark):
    chat = '{"choices":[{"message":{"content":" {\\"edits\\":[]} "}}]}'
    parts = '{"choices":[{"message":{"content":[{"text":"a"},{"text":"b"}]}}]}'
    assert one(spark, J.chat_reply(F.col("p")), p=chat) == '{"edits":[]}'
    assert one(spark, J.chat_reply(F.col("p")), p=parts) == "ab"
    items = '{"output":[{"content":[{"type":"output_text","text":"x"},{"type":"other","text":"no"}]},{"content":[{"type":"text","text":"y"}]}]}'
    assert one(spark, J.responses_reply(F.col("p")), p=items) == "x\ny"
    assert one(spark, J.responses_reply(F.col("p")), p='{"output_text":" z "}') == "z"


def test_edit_warnings_cover_rejections_and_bad_replies(spark):
    segments = spark.createDataFrame([(1, 0, "one two three"), (2, 0, "text")], "w long, seg_no long, text string")
    replies = spark.createDataFrame(
        [(1, '{"edits":[{"id":0,"old":"two","new":"2"},{"id":5,"old":"a","new":"b"},{"id":0,"old":"one","new":"one"}]}'), (2, "{}")], "w long, reply string"
    )
    rows = E.explode_replies(replies)
    checked = E.mark_overlaps(E.validate(rows, segments, ["w"]), ["w"])
    got = {(r["w"], r["number"], r["reason"]) for r in E.warnings(checked, rows, ["w"]).collect()}
    assert got == {(1, 2, "id_outside_window"), (2, 0, "unusable_reply")}
    assert {r["new_text"] for r in E.apply_edits(segments, checked, ["w"]).collect()} == {"one 2 three", "text"}


def test_duplicate_entries_and_file_listing(spark, tmp_path):
    entries = spark.createDataFrame([("a",), ("a",), ("",), ("b",)], "source string")
    assert {r["source"] for r in I.duplicate_entries(entries).collect()} == {"a", ""}
    (tmp_path / "x.mp4").write_bytes(b"12345")
    row = SC.file_listing(spark, str(tmp_path)).first()
    assert row["path"].endswith("/x.mp4") and row["size"] == 5


def test_one_bad_page_costs_one_row(spark):
    deep, broken, good = "<p>" * 5000 + "x", "<![foo[ x ]]>", "<article><p>fine</p></article>"
    df = spark.createDataFrame([(k, h) for k, h in enumerate((deep, broken, good))], "k int, h string")
    rows = {r["k"]: r["m"] for r in df.select("k", P.main_content(F.col("h"), F.lit("")).alias("m")).collect()}
    assert rows[0]["markdown"] == "x" and rows[0]["error"] is None
    assert rows[1]["error"] and rows[1]["markdown"] is None
    assert rows[2]["markdown"] == "fine" and rows[2]["error"] is None


def test_csv_files_have_headers_of_their_own(spark, tmp_path):
    import pytest

    (tmp_path / "a.csv").write_text("source,name\nhttps://a.org,A\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("tags,name,source,more\nx,B,https://b.org,1\n", encoding="utf-8")
    rows = {(r["source"], r["name"], r["line_number"]) for r in M.csv_items(spark, str(tmp_path)).collect()}
    assert rows == {("https://a.org", "A", 2), ("https://b.org", "B", 2)}
    (tmp_path / "c.csv").write_text("name\nC\n", encoding="utf-8")
    with pytest.raises(Exception, match="needs a source column"):
        M.csv_items(spark, str(tmp_path)).collect()


def test_other_files_and_empty_manifests_are_errors(spark, tmp_path):
    import pytest

    (tmp_path / "m.txt").write_text("# nothing\n", encoding="utf-8")
    with pytest.raises(ValueError, match="no items"):
        M.load_manifests(spark, str(tmp_path))
    (tmp_path / "m.txt").write_text("https://a.org\n", encoding="utf-8")
    (tmp_path / "notes.md").write_text("x", encoding="utf-8")
    with pytest.raises(ValueError, match="not a manifest"):
        M.load_manifests(spark, str(tmp_path))


def test_index_files_keep_their_other_lines(spark, tmp_path):
    import pytest

    from corpusloom.operators import source_index as X

    table = [X.INDEX_HEADER, X.INDEX_SEPARATOR, "| https://a.org | Web | `a.md` | 2024-01-01 | 否 |"]
    (tmp_path / "i.md").write_text("\n".join([X.INDEX_TITLE, "", "my note", *table, "", "after"]) + "\n", encoding="utf-8")
    lines = M.numbered_lines(spark, str(tmp_path), ".md")
    kept = [r["value"] for r in SC.lines_around_index(lines).orderBy("line_number").collect()]
    assert kept == ["", "my note", "", "after"]
    assert [r["product"] for r in SC.source_index(spark, str(tmp_path)).collect()] == ["a.md"]
    (tmp_path / "j.md").write_text("# other\n", encoding="utf-8")
    with pytest.raises(Exception, match="not an index file"):
        SC.source_index(spark, str(tmp_path)).collect()


def test_fingerprints_agree(spark):
    from corpusloom.operators import tasks as K

    given = {"limit_seconds": 5, "asr_language": "中 \"x\"", "formats": ["md", "srt"], "keep_audio": True}
    columns = {"limit_seconds": F.lit(5), "asr_language": F.lit("中 \"x\""), "formats": F.array(F.lit("md"), F.lit("srt")), "keep_audio": F.lit(True)}
    assert one(spark, K.fingerprint_of(columns), x=1) == K.fingerprint({**given, "other": 1}) != K.fingerprint({})
