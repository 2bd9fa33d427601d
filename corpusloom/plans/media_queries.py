"""Captured payloads built from `orders`, `part` and `lineitem`, and the choices among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payloads as J
from ..functions import verdicts as V
from ..operators.media import pick_media
from ..operators.ordered import keep_first
from .registry import Tables, query

CAPTURES = """SELECT o_orderkey, CAST(o_orderkey AS STRING) AS k, o_orderkey % 3 + 1 AS part,
    CASE CAST(o_orderkey % 5 AS INT)
      WHEN 0 THEN '{"code":0,"data":{"title":"T' || CAST(o_orderkey AS STRING) || '","desc":" d ","owner":{"name":" O "},"pages":[{"page":1,"part":"A","duration":10},{"page":2,"part":"B","duration":20}]}}'
      WHEN 1 THEN '{"code":0,"data":{"title":"","duration":33,"desc":null}}'
      WHEN 2 THEN '{"code":-404,"message":"gone"}' WHEN 3 THEN 'not json' ELSE '{"code":0,"data":{"title":"no length"}}' END AS payload,
    '{"title":" F' || CAST(o_orderkey AS STRING) || '","channel":"C","duration":12.7,"description":"x"}' AS fallback FROM {orders}"""


@query("scan_capture_json", "SELECT o_orderkey, o_orderkey % 5 <> 3 AS is_json, CASE o_orderkey % 5 WHEN 2 THEN -404 WHEN 3 THEN -1 ELSE 0 END AS code FROM {orders}")
def scan_capture_json(t: Tables):
    rows = t.sql(CAPTURES).withColumn("v", F.try_parse_json("payload"))
    return rows.select(
        "o_orderkey", F.col("v").isNotNull().alias("is_json"), F.coalesce(F.try_variant_get("v", "$.code", "int"), F.lit(-1)).alias("code")
    )


_VIEW = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_orderkey % 3 = 2 THEN 'missing_part' ELSE 'ok' END
      WHEN 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'ok' ELSE 'missing_part' END ELSE 'unavailable' END AS status,
    CASE o_orderkey % 5 WHEN 0 THEN 'T' || o_orderkey || ' - P' || (o_orderkey % 3 + 1) || CASE o_orderkey % 3 WHEN 0 THEN ' A' ELSE ' B' END ELSE 'BV' || o_orderkey END AS title,
    CASE o_orderkey % 5 WHEN 0 THEN 'O' ELSE '' END AS uploader, CASE o_orderkey % 5 WHEN 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 10 ELSE 20 END ELSE 33 END AS duration FROM {orders}"""


@query("view_api_parse", f"""
  SELECT o_orderkey, status, CASE WHEN status = 'ok' THEN title ELSE '' END AS title, CASE WHEN status = 'ok' THEN uploader ELSE '' END AS uploader,
    CAST(CASE WHEN status = 'ok' THEN duration ELSE 0 END AS BIGINT) AS duration FROM ({_VIEW})""")
def view_api_parse(t: Tables):
    info = J.view_info(F.col("payload"), F.concat(F.lit("BV"), "k"), F.col("part"))
    rows = t.sql(CAPTURES).select("o_orderkey", info.alias("i"))
    text = lambda c: F.coalesce(F.col("i")[c], F.lit("")).alias(c)
    return rows.select("o_orderkey", "i.status", text("title"), text("uploader"), F.coalesce("i.duration", F.lit(0)).alias("duration"))


@query("view_with_fallback", f"""
  SELECT o_orderkey, CASE status WHEN 'ok' THEN 'view-api' WHEN 'unavailable' THEN 'fallback' ELSE 'error' END AS origin,
    CASE status WHEN 'ok' THEN title WHEN 'unavailable' THEN 'F' || o_orderkey ELSE '' END AS title,
    CAST(CASE status WHEN 'ok' THEN duration WHEN 'unavailable' THEN 12 ELSE 0 END AS BIGINT) AS duration,
    'https://www.bilibili.com/video/BV' || o_orderkey || '?p=' || (o_orderkey % 3 + 1) AS url FROM ({_VIEW})""")
def view_with_fallback(t: Tables):
    """The fallback serves unavailable views only; a missing part stays an error."""
    code = F.concat(F.lit("BV"), "k")
    rows = t.sql(CAPTURES).select(
        "o_orderkey",
        J.view_info(F.col("payload"), code, F.col("part")).alias("v"),
        J.fallback_info(F.col("fallback"), code).alias("f"),
        J.part_url(code, F.col("part")).alias("url"),
    )
    ok, gone = F.col("v")["status"] == "ok", F.col("v")["status"] == "unavailable"
    pick = lambda c, none: F.when(ok, F.col("v")[c]).when(gone, F.col("f")[c]).otherwise(none).alias(c)
    return rows.select(
        "o_orderkey", F.when(ok, "view-api").when(gone, "fallback").otherwise("error").alias("origin"),
        pick("title", F.lit("")), pick("duration", F.lit(0)), "url",
    )


PROBES = """SELECT p_partkey, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN '{"format":{"duration":"' || CAST(p_size AS STRING) || '.5"},"streams":[{"codec_type":"video"},{"codec_type":"audio"}]}'
    WHEN 1 THEN '{"format":{"duration":"N/A"},"streams":[{"codec_type":"video"}]}' WHEN 2 THEN '{}' ELSE 'broken' END AS payload FROM {part}"""


@query("scan_probe_json", """
  SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_size + 0.5 ELSE 0 END::DOUBLE AS duration, p_partkey % 4 = 0 AS has_audio, p_partkey % 4 IN (0, 1) AS has_video FROM {part}""")
def scan_probe_json(t: Tables):
    return t.sql(PROBES).select("p_partkey", J.probe_info(F.col("payload")).alias("i")).select("p_partkey", "i.*")


INFO = """SELECT o_orderkey, 'https://youtu.be/' || lpad(CAST(o_orderkey AS STRING), 11, 'v') AS url,
    '{"id":"' || CAST(o_orderkey AS STRING) || '",' || CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN '"_type":"playlist",' WHEN 1 THEN '"is_live":true,' WHEN 2 THEN '"live_status":"post_live",' ELSE '"live_status":"not_live",' END
    || '"title":"","uploader":null,"channel":"Ch","duration":61.5,"formats":[{"acodec":"none"},{"acodec":"mp4a"},{"vcodec":"avc"},{"acodec":"opus"}]}' AS payload FROM {orders}"""


@query("info_parse", """
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'not_single' WHEN 3 THEN 'ok' ELSE 'live' END AS status, CAST(o_orderkey AS VARCHAR) AS title, 'Ch' AS uploader,
    CAST(61.5 AS DOUBLE) AS duration, CAST(2 AS INT) AS audio_formats, 'https://www.youtube.com/watch?v=' || lpad(CAST(o_orderkey AS VARCHAR), 11, 'v') AS url FROM {orders}""")
def info_parse(t: Tables):
    rows = t.sql(INFO).select("o_orderkey", J.generic_info(F.col("payload"), F.col("url")).alias("i"))
    return rows.select("o_orderkey", "i.status", "i.title", "i.uploader", "i.duration", "i.audio_formats", "i.url")


@query("live_reject", "SELECT o_orderkey FROM {orders} WHERE o_orderkey % 4 IN (0, 3)")
def live_reject(t: Tables):
    i = F.from_json("payload", J.INFO_SCHEMA)
    return t.sql(INFO).where(~V.is_live(i["is_live"], i["live_status"])).select("o_orderkey")


DETAILS = """SELECT o_orderkey, CASE CAST(o_orderkey % 4 AS INT) WHEN 3 THEN '{"status":0}' ELSE '{"aweme_detail":{"aweme_id":"' || CAST(o_orderkey AS STRING) || '","desc":" D ","duration":'
    || CASE WHEN o_orderkey % 4 = 1 THEN '0' ELSE '377418' END || ',"author":{"nickname":"N"},"video":{"duration":5000,"play_addr":{"url_list":'
    || CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN '["https://v/1","ftp://no","https://v/1"]' WHEN 1 THEN '"https://v/one"' ELSE '{"main_url":"https://v/m","fallback_url":"https://v/f"}' END
    || '}},"music":{"play_url":{"url_list":["https://m/a"]}}}}' END AS payload FROM {orders}"""


@query("detail_parse", """
  SELECT o_orderkey, o_orderkey % 4 <> 3 AS found, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS video_id,
    CASE o_orderkey % 4 WHEN 3 THEN 0 WHEN 1 THEN 5 ELSE 377.418 END::DOUBLE AS duration,
    CASE o_orderkey % 4 WHEN 0 THEN 'https://v/1 https://m/a' WHEN 1 THEN 'https://v/one https://m/a' WHEN 2 THEN 'https://v/m https://v/f https://m/a' ELSE '' END AS candidates FROM {orders}""")
def detail_parse(t: Tables):
    rows = t.sql(DETAILS).select("o_orderkey", J.short_video_detail(F.col("payload")).alias("d"))
    return rows.select(
        "o_orderkey", F.col("d").isNotNull().alias("found"), F.coalesce("d.video_id", F.lit("")).alias("video_id"),
        F.coalesce("d.duration", F.lit(0.0)).alias("duration"), F.coalesce(F.array_join("d.media_candidates", " "), F.lit("")).alias("candidates"),
    )


RESPONSES = """SELECT o_orderkey, CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'https://cdn.e.org/a.mp4' WHEN 1 THEN 'https://cdn.e.org/a.m3u8' WHEN 2 THEN 'https://cdn.e.org/p'
    WHEN 3 THEN 'blob:https://e.org/1' WHEN 4 THEN 'https://v3.douyinvod.com/x' ELSE 'https://cdn.e.org/q' END AS url,
    CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'Video/mp4' WHEN 1 THEN 'application/x-mpegURL' ELSE 'text/html' END AS content_type,
    CASE WHEN o_orderkey % 5 = 0 THEN 'media' ELSE 'xhr' END AS resource_type FROM {orders}"""


@query("media_candidate_filter", f"""
  SELECT o_orderkey, url LIKE 'http%' AND NOT (contains(url, '.m3u8') OR contains(lower(content_type), 'mpegurl'))
    AND (resource_type = 'media' OR content_type = 'Video/mp4' OR regexp_matches(url, 'douyinvod|[.]mp4|[.]m4a|[.]mp3')) AS direct FROM ({RESPONSES})""")
def media_candidate_filter(t: Tables):
    direct = V.is_direct_media(F.col("url"), F.col("content_type"), F.col("resource_type"))
    return t.sql(RESPONSES).select("o_orderkey", direct.alias("direct"))


@query("candidate_merge", """
  SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'https://d/1 ' ELSE '' END || 'https://www.douyin.com/m/' || o_orderkey || '.mp4 https://n/9' AS candidates,
    CASE WHEN o_orderkey % 2 = 0 THEN 'https://d/1' ELSE 'https://www.douyin.com/m/' || o_orderkey || '.mp4' END AS media_url, o_orderkey % 3 = 0 AS saw_blob,
    CAST(7000000000 + o_orderkey AS VARCHAR) AS video_id, CAST(o_orderkey % 50 + 1.5 AS DOUBLE) AS duration FROM {orders}""")
def candidate_merge(t: Tables):
    key = F.col("o_orderkey")
    final = F.concat(F.lit("https://www.douyin.com/video/"), (key + 7000000000).cast("string"))
    detail = F.when(key % 2 == 0, F.array(F.lit("https://d/1"), F.lit("https://d/1")))
    player = F.struct(
        F.when(key % 3 == 0, F.lit("blob:https://x/1")).otherwise("").alias("current_src"),
        F.concat(F.lit("/m/"), key.cast("string"), F.lit(".mp4")).alias("src"),
        F.array(F.lit(" https://n/9 "), F.lit("")).alias("sources"),
        (key % 50 + 1.5).alias("duration"),
    )
    rows = t["orders"].select("o_orderkey", final.alias("final"), detail.alias("detail"), F.array(player).alias("videos"))
    network = F.array(F.lit("https://n/9"))
    merged = J.merge_candidates(F.col("detail"), J.page_media(F.col("videos")), network, F.col("final"))
    empty = F.lit("")
    snap = J.page_snapshot(empty, empty, empty, empty, F.col("final"), F.lit(0.0), F.col("videos"), empty)
    out = rows.select("o_orderkey", merged.alias("m"), snap.alias("s"))
    return out.select(
        "o_orderkey", F.array_join("m.media_candidates", " ").alias("candidates"), "m.media_url", "m.saw_blob", "s.video_id", "s.duration"
    )


@query("candidate_dedup", "SELECT l_partkey, l_suppkey, min(l_orderkey * 100 + l_linenumber) AS pos FROM {lineitem} GROUP BY l_partkey, l_suppkey")
def candidate_dedup(t: Tables):
    pos = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos")
    return keep_first(t["lineitem"].select("l_partkey", "l_suppkey", pos), ["l_partkey", "l_suppkey"], ["pos"])


CANDIDATES = """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS pos, 'https://m/' || CAST(l_partkey AS STRING) AS url,
    l_returnflag <> 'R' AS has_audio, CASE WHEN l_linestatus = 'F' THEN 0.25 ELSE l_quantity END AS actual, CAST(l_suppkey AS DOUBLE) AS expected FROM {lineitem}"""
_REASON = "CASE WHEN NOT has_audio THEN 'no_audio' WHEN actual <= 0.5 THEN 'bad_duration' WHEN expected >= 3 AND actual < expected * 0.5 THEN 'too_short' ELSE '' END"


@query("duration_check", f"""
  SELECT l_orderkey, pos, {_REASON} AS short_reason, CASE WHEN NOT has_audio THEN 'no_audio' WHEN actual <= 0.5 THEN 'bad_duration'
      WHEN expected >= 60 AND actual < expected * 0.9 THEN 'truncated' WHEN expected <> 0 AND abs(actual - expected) > greatest(30, expected * 0.1) THEN 'duration_differs' ELSE '' END AS episode_reason
  FROM ({CANDIDATES})""")
def duration_check(t: Tables):
    args = F.col("has_audio"), F.col("actual"), F.col("expected")
    return t.sql(CANDIDATES).select(
        "l_orderkey", "pos", V.short_video_check(*args)["reason"].alias("short_reason"), V.episode_audio_check(*args)["reason"].alias("episode_reason")
    )


@query("pick_media", f"""
  WITH r AS (SELECT *, {_REASON} AS reason FROM ({CANDIDATES})),
  c AS (SELECT l_orderkey, count(*) AS candidates, arg_min(url, pos) FILTER (WHERE reason = '') AS url, min(pos) FILTER (WHERE reason = '') AS pos FROM r GROUP BY l_orderkey),
  b AS (SELECT l_orderkey, pos, reason, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos DESC) AS n FROM r WHERE reason <> ''),
  e AS (SELECT l_orderkey, string_agg(reason, '；' ORDER BY pos) AS errors FROM b WHERE n <= 3 GROUP BY l_orderkey)
  SELECT c.l_orderkey, candidates, coalesce(url, '') AS media_url, coalesce(pos, -1) AS chosen_pos, CASE WHEN pos IS NULL THEN errors ELSE '' END AS last_errors FROM c LEFT JOIN e USING (l_orderkey)""")
def pick_media_query(t: Tables):
    return pick_media(t.sql(CANDIDATES), "l_orderkey")
