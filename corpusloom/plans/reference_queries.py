"""References, routing and manifests over `pages`, `part`, `orders` and `supplier`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import refs as R
from ..functions import routing as C
from ..operators.ordered import keep_first
from ..operators.tasks import fingerprint_of
from ..runtime import scratch_path
from ..sinks.documents import export_files
from ..sources import manifests as M
from . import duck as D
from .registry import Tables, query

# One text per page: own link, the next page's link in brackets, a code, a glued code, a repeat.
SHARED_TEXT = """
  SELECT a.page_id, '看看 ' || a.url || '， 还有（ ' || coalesce(b.url, 'HTTPS://Example.com/Last') || '）。 BV'
    || lpad(CAST(a.page_id AS STRING), 10, '0') || ' xBV' || lpad(CAST(a.page_id AS STRING), 10, '0') || ' '
    || a.url || '!? 完' AS text
  FROM {pages} a LEFT JOIN {pages} b ON b.page_id = a.page_id + 1"""
# One reference per page, and one per part in the forms of the twelve kinds of source.
ROUTED = """
  SELECT 'page' AS kind, page_id AS id, url AS raw FROM {pages}
  UNION ALL
  SELECT 'part' AS kind, p_partkey AS id, CASE CAST(p_partkey % 14 AS INT)
    WHEN 0 THEN 'https://channels.weixin.qq.com/platform/post/' || CAST(p_partkey AS STRING)
    WHEN 1 THEN 'https://weixin.qq.com/sph/A' || CAST(p_partkey AS STRING)
    WHEN 2 THEN 'https://v.douyin.com/a' || CAST(p_partkey AS STRING) || '/'
    WHEN 3 THEN 'https://www.douyin.com/video/' || CAST(7000000000 + p_partkey AS STRING)
    WHEN 4 THEN 'https://example.com/files/report' || CAST(p_partkey AS STRING) || '.PDF?dl=1'
    WHEN 5 THEN 'https://mp.weixin.qq.com/s/' || CAST(p_partkey AS STRING)
    WHEN 6 THEN 'BV' || lpad(CAST(p_partkey AS STRING), 10, '0')
    WHEN 7 THEN 'https://youtu.be/' || lpad(CAST(p_partkey AS STRING), 11, 'a')
    WHEN 8 THEN 'https://www.xiaoyuzhoufm.com/episode/' || lpad(CAST(p_partkey AS STRING), 24, '0')
    WHEN 9 THEN 'https://www.zhihu.com/question/' || CAST(p_partkey AS STRING) || '/answer/' || CAST(p_partkey * 7 AS STRING)
    WHEN 10 THEN 'https://www.xiaohongshu.com/explore/' || lpad(CAST(p_partkey AS STRING), 24, 'b')
    WHEN 11 THEN '复制打开 https://b23.tv/x' || CAST(p_partkey AS STRING) || '。 看视频'
    WHEN 12 THEN 'www.example' || CAST(p_partkey AS STRING) || '.org/a?x=1&amp;y=2'
    ELSE 'https://www.zhihu.com/people/' || CAST(p_partkey AS STRING) END AS raw
  FROM {part}"""
NORMALIZED = f"SELECT kind, id, raw, {D.normalized('raw')} AS reference FROM ({ROUTED})"


@query("ref_extract", f"""
  WITH t AS ({SHARED_TEXT}), m AS (
    SELECT page_id, regexp_extract_all(text, '(?i:https?://)[^\\s<>"'']+|\\bBV[0-9A-Za-z]{{10}}\\b') AS l FROM t),
  e AS (SELECT page_id, unnest(l) AS v, unnest(range(len(l))) AS i FROM m),
  c AS (SELECT page_id, i, CASE WHEN v ILIKE 'http%' THEN rtrim(v, '{D.PUNCTUATION}') ELSE v END AS v FROM e),
  d AS (SELECT page_id, v, min(i) AS i FROM c WHERE v <> '' GROUP BY page_id, v)
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS pos, v AS reference FROM d""")
def ref_extract(t: Tables):
    texts = t.sql(SHARED_TEXT)
    return texts.select("page_id", F.posexplode(R.extract_references(F.col("text"))).alias("pos", "reference"))


@query("ref_first_url", f"""
  SELECT page_id, rtrim(regexp_extract(text, '(?i)https?://[^\\s<>"'']+', 0), '{D.PUNCTUATION}') AS first_url
  FROM ({SHARED_TEXT})""")
def ref_first_url(t: Tables):
    return t.sql(SHARED_TEXT).select("page_id", R.first_url(F.col("text")).alias("first_url"))


@query("ref_dedup", f"""
  WITH t AS ({SHARED_TEXT}), m AS (
    SELECT page_id, regexp_extract_all(text, '(?i:https?://)[^\\s<>"'']+|\\bBV[0-9A-Za-z]{{10}}\\b') AS l FROM t),
  e AS (SELECT page_id, unnest(l) AS v, unnest(range(len(l))) AS i FROM m),
  c AS (SELECT page_id, i, CASE WHEN v ILIKE 'http%' THEN rtrim(v, '{D.PUNCTUATION}') ELSE v END AS v FROM e)
  SELECT v AS reference, min(page_id) AS page_id FROM c WHERE v <> '' GROUP BY v""")
def ref_dedup(t: Tables):
    found = t.sql(SHARED_TEXT).select(
        "page_id", F.posexplode(R.extract_references(F.col("text"))).alias("pos", "reference")
    )
    return keep_first(found, ["reference"], ["page_id", "pos"]).select("reference", "page_id")


PASTED = """SELECT page_id, CASE CAST(page_id % 4 AS INT) WHEN 0 THEN '  "' || url || '" '
    WHEN 1 THEN replace(url, '&', chr(92) || '&') WHEN 2 THEN replace(url, '&', '&amp;')
    ELSE replace(replace(url, 'https://', ''), 'http://', '') END AS raw FROM {pages}"""


@query("ref_normalize", f"""
  SELECT page_id, {D.normalized("trim(trim(trim(raw), '" + chr(34) + "'))")} AS reference FROM ({PASTED})""")
def ref_normalize(t: Tables):
    return t.sql(PASTED).select("page_id", R.normalize_reference(F.col("raw")).alias("reference"))


DOMAINS = """SELECT page_id, CASE CAST(page_id % 3 AS INT) WHEN 0 THEN regexp_replace(url, '^https?://', '')
    WHEN 1 THEN url ELSE 'see ' || url END AS line FROM {pages}"""


@query("ref_plain_domain", f"""
  SELECT page_id, regexp_full_match(line, '(www\\.)?([A-Za-z0-9-]+\\.)+[A-Za-z]{{2,63}}(:\\d+)?([/?#]\\S*)?') AS is_domain
  FROM ({DOMAINS})""")
def ref_plain_domain(t: Tables):
    return t.sql(DOMAINS).select("page_id", R.is_plain_domain(F.col("line")).alias("is_domain"))


TAGS = """SELECT p_partkey, CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN p_name || '; ' || p_type || ' ;;' || p_brand
    WHEN 1 THEN ' ' || p_brand || ' , ' || p_type || ',' ELSE '' END AS tags FROM {part}"""


@query("tags_parse", f"""
  SELECT p_partkey, array_to_string(list_filter(list_transform(
    CASE WHEN contains(tags, ';') THEN string_split(tags, ';') ELSE string_split(tags, ',') END,
    lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM ({TAGS})""")
def tags_parse(t: Tables):
    return t.sql(TAGS).select("p_partkey", F.array_join(R.parse_tags(F.col("tags")), "|").alias("tags"))


MESSY = """SELECT page_id, CASE CAST(page_id % 5 AS INT) WHEN 0 THEN upper(url) WHEN 1 THEN replace(url, '://', '://User:Pw@')
    WHEN 2 THEN replace(replace(url, '.com/', '.com:8080/'), '.org/', '.ORG:80/') WHEN 3 THEN 'not a url ' || url ELSE url || '/' END AS link
    FROM {pages}"""


@query("host_of", f"SELECT page_id, {D.host('link')} AS host FROM ({MESSY})")
def host_of(t: Tables):
    return t.sql(MESSY).select("page_id", R.host_of(F.col("link")).alias("host"))


@query("link_key", f"""
  WITH x AS (SELECT page_id, link, {D.authority('link')} AS au FROM ({MESSY}))
  SELECT page_id, CASE WHEN regexp_matches(link, '^(?i)https?://[^/?#]') THEN
      lower(regexp_extract(link, '^([A-Za-z]+):', 1)) || '://' || regexp_extract(au, '^.*@', 0)
      || lower(regexp_extract(regexp_replace(au, '^.*@', ''), '^[^:]*', 0))
      || regexp_extract(regexp_replace(au, '^.*@', ''), ':.*$', 0)
      || rtrim({D.path('link')}, '/') || regexp_extract(link, '[?#].*$', 0)
    ELSE rtrim(link, '/') END AS link_key FROM x""")
def link_key(t: Tables):
    return t.sql(MESSY).select("page_id", R.link_key(F.col("link")).alias("link_key"))


PRODUCTS = """SELECT p_partkey, CASE CAST(p_partkey % 2 AS INT) WHEN 0 THEN ' `' || p_name || chr(92) || '|' || p_type || '.md` '
    ELSE p_name || '/content.md' END AS cell FROM {part}"""


@query("product_key", f"""
  SELECT p_partkey, trim(replace(trim(trim(cell), '`'), chr(92) || '|', '|')) AS product_key FROM ({PRODUCTS})""")
def product_key(t: Tables):
    return t.sql(PRODUCTS).select("p_partkey", R.product_key(F.col("cell")).alias("product_key"))


@query("route_classify", f"SELECT kind, id, reference, {D.channel('reference')} AS channel FROM ({NORMALIZED})")
def route_classify(t: Tables):
    refs = t.sql(ROUTED).select("kind", "id", R.normalize_reference(F.col("raw")).alias("reference"))
    return C.with_channel(refs, "reference")


@query("source_stats", f"""
  SELECT {D.channel('reference')} AS channel, count(*) AS sources FROM ({NORMALIZED}) GROUP BY 1""")
def source_stats(t: Tables):
    refs = t.sql(ROUTED).select(R.normalize_reference(F.col("raw")).alias("reference"))
    return C.with_channel(refs, "reference").groupBy("channel").agg(F.count(F.lit(1)).alias("sources"))


# What each channel is expected to show: adapter, backend and number of steps; the last one is a caller's rule.
_SHOWN = """(VALUES ('deferred', 'DeferredMediaExtractor', '', 1), ('douyin', 'DouyinExtractor', '', 3), ('document', 'DocumentExtractor', '', 1),
    ('wechat', 'WeChatExtractor', '', 2), ('bilibili', 'BilibiliExtractor', '', 3), ('youtube', 'YouTubeExtractor', '', 2), ('xiaoyuzhou', 'XiaoyuzhouExtractor', '', 2),
    ('zhihu_question', 'ZhihuExtractor', '', 2), ('xiaohongshu', 'XiaohongshuExtractor', '', 1), ('web', 'GenericWebExtractor', '', 2), ('blog', 'BlogAdapter', 'renderer', 1))"""


@query("route_explain", f"""
  WITH c AS (SELECT kind, id, raw, reference, CASE WHEN {D.host('reference')} LIKE 'blog.%' THEN 'blog' ELSE {D.channel('reference')} END AS channel FROM ({NORMALIZED}))
  SELECT kind, id, reference AS normalized, channel,
    CASE WHEN raw LIKE 'http://%' OR raw LIKE 'https://%' THEN 'URL'
         WHEN contains(raw, 'http://') OR contains(raw, 'https://') THEN 'App 分享文本 / 含 URL 文本'
         WHEN raw LIKE 'BV%' THEN 'Bilibili BV 号' ELSE 'Content Reference' END AS input_kind,
    s.adapter, coalesce(s.backend, '') AS backend, CAST(s.steps AS INT) AS steps FROM c LEFT JOIN {_SHOWN} AS s(key, adapter, backend, steps) ON s.key = c.channel""")
def route_explain(t: Tables):
    blog = C.Channel(10, "blog", "Blogs", "BlogAdapter", lambda ref: ref.host.startswith("blog."), ("render the page",), backend="renderer")
    return C.explain_routes(t.sql(ROUTED), "raw", C.with_channels([blog])).select(
        "kind", "id", "normalized", "channel", "input_kind", "adapter", "backend", F.size("plan").alias("steps")
    )


@query("channel_rules", f"""
  SELECT kind, id, CASE WHEN {D.host('reference')} LIKE 'blog.%' THEN 'blog' ELSE {D.channel('reference')} END AS channel
  FROM ({NORMALIZED})""")
def channel_rules(t: Tables):
    from ..operators.hooks import route_with

    blog = C.Channel(10, "blog", "Blogs", "BlogAdapter", lambda ref: ref.host.startswith("blog."))
    refs = t.sql(ROUTED).select("kind", "id", R.normalize_reference(F.col("raw")).alias("reference"))
    return route_with(refs, "reference", [blog]).select("kind", "id", "channel")


TUBE = """SELECT o_orderkey, CASE CAST(o_orderkey % 7 AS INT)
    WHEN 0 THEN 'https://youtu.be/' || lpad(CAST(o_orderkey AS STRING), 11, 'x') || '?t=3'
    WHEN 1 THEN 'https://www.youtube.com/watch?list=a&v=' || lpad(CAST(o_orderkey AS STRING), 11, '_')
    WHEN 2 THEN 'https://m.youtube.com/shorts/' || lpad(CAST(o_orderkey AS STRING), 11, '-')
    WHEN 3 THEN 'https://www.youtube.com/embed/' || lpad(CAST(o_orderkey AS STRING), 11, 'e') || '/'
    WHEN 4 THEN 'https://www.youtube.com/playlist?list=' || CAST(o_orderkey AS STRING)
    WHEN 5 THEN 'https://www.youtube.com/live/' || lpad(CAST(o_orderkey AS STRING), 11, 'l') || '/more'
    ELSE 'https://video.example.com/watch?v=' || lpad(CAST(o_orderkey AS STRING), 11, 'x') END AS url FROM {orders}"""


@query("video_id_canonical", f"""
  WITH v AS (SELECT o_orderkey, CASE
      WHEN {D.host('url')} = 'youtu.be' THEN split_part(trim({D.path('url')}, '/'), '/', 1)
      WHEN {D.path('url')} = '/watch' THEN regexp_extract(url, '[?&]v=([^&#]+)', 1)
      WHEN regexp_full_match(trim({D.path('url')}, '/'), '(shorts|embed|live)/[^/]+') THEN split_part(trim({D.path('url')}, '/'), '/', 2)
      ELSE '' END AS id, {D.host('url')} AS h FROM ({TUBE}))
  SELECT o_orderkey, CASE WHEN (h = 'youtu.be' OR h LIKE '%youtube.com') AND regexp_full_match(id, '[A-Za-z0-9_-]{{11}}')
    THEN 'https://www.youtube.com/watch?v=' || id END AS canonical FROM v""")
def video_id_canonical(t: Tables):
    return t.sql(TUBE).select("o_orderkey", C.canonical_video_url(F.col("url")).alias("canonical"))


PARTS = """SELECT p_partkey, CASE CAST(p_partkey % 5 AS INT)
    WHEN 0 THEN 'BV' || lpad(CAST(p_partkey AS STRING), 10, 'z')
    WHEN 1 THEN 'https://www.bilibili.com/video/BV' || lpad(CAST(p_partkey AS STRING), 10, '1') || '/?spm=1&p=' || CAST(p_size AS STRING)
    WHEN 2 THEN 'https://www.bilibili.com/video/BV' || lpad(CAST(p_partkey AS STRING), 10, '2') || '?p=x'
    WHEN 3 THEN 'https://www.bilibili.com/video/BV' || lpad(CAST(p_partkey AS STRING), 10, '3') || '?p=0'
    ELSE 'https://www.bilibili.com/read/cv' || CAST(p_partkey AS STRING) END AS value FROM {part}"""


@query("video_part", f"""
  WITH v AS (SELECT p_partkey, regexp_extract(value, 'BV[0-9A-Za-z]{{10}}', 0) AS code,
      TRY_CAST(CASE WHEN regexp_extract(value, '[?&]p=([^&]+)', 1) = '' THEN '1' ELSE regexp_extract(value, '[?&]p=([^&]+)', 1) END AS BIGINT) AS part
    FROM ({PARTS}))
  SELECT p_partkey, CASE WHEN code <> '' AND part >= 1 THEN code END AS code,
    CASE WHEN code <> '' AND part >= 1 THEN part ELSE 0 END AS part,
    CASE WHEN code = '' THEN 'no_video_code' WHEN part IS NULL OR part < 1 THEN 'bad_part' ELSE '' END AS error FROM v""")
def video_part(t: Tables):
    return t.sql(PARTS).select("p_partkey", C.video_and_part(F.col("value")).alias("v")).select(
        "p_partkey", "v.code", F.coalesce("v.part", F.lit(0)).alias("part"), "v.error"
    )


@query("note_id", f"SELECT kind, id, regexp_extract({D.path('raw')}, '/(?:explore|discovery/item)/(\\w+)', 1) AS note_id FROM ({ROUTED})")
def note_id(t: Tables):
    return t.sql(ROUTED).select("kind", "id", C.note_id(F.col("raw")).alias("note_id"))


@query("episode_id", f"SELECT kind, id, regexp_extract({D.path('raw')}, '/episode/([0-9a-fA-F]{{24}})(?:/|$)', 1) AS episode_id FROM ({ROUTED})")
def episode_id(t: Tables):
    return t.sql(ROUTED).select("kind", "id", C.episode_id(F.col("raw")).alias("episode_id"))


@query("question_id", f"""
  SELECT kind, id, regexp_extract({D.path('raw')}, '/question/([0-9]+)', 1) AS question_id,
    CASE WHEN regexp_matches({D.path('raw')}, '/question/[0-9]+')
      THEN 'https://www.zhihu.com/question/' || regexp_extract({D.path('raw')}, '/question/([0-9]+)', 1) END AS question_url
  FROM ({ROUTED})""")
def question_id(t: Tables):
    raw = F.col("raw")
    return t.sql(ROUTED).select("kind", "id", C.question_id(raw).alias("question_id"), C.question_url(raw).alias("question_url"))


@query("short_video_id", f"SELECT kind, id, regexp_extract({D.path('raw')}, '/video/([0-9]+)', 1) AS video_id FROM ({ROUTED})")
def short_video_id(t: Tables):
    return t.sql(ROUTED).select("kind", "id", C.short_video_id(F.col("raw")).alias("video_id"))


@query("canonical_key", f"""
  WITH c AS (SELECT kind, id, reference, {D.channel('reference')} AS channel, regexp_extract(reference, '/(?:episode|explore|question)/(\\w+)', 1) AS sid FROM ({NORMALIZED}))
  SELECT kind, id, CASE WHEN sid <> '' THEN channel || ':' || sid ELSE reference END AS canonical_key FROM c""")
def canonical_key(t: Tables):
    refs = t.sql(ROUTED).select("kind", "id", R.normalize_reference(F.col("raw")).alias("reference"))
    ref = F.col("reference")
    sid = F.concat(C.episode_id(ref), C.note_id(ref), C.question_id(ref))
    return refs.select("kind", "id", R.canonical_key(C.classify(ref), sid, ref).alias("canonical_key"))


@query("task_identity", f"SELECT kind, id, sha256('ref:' || reference) AS task_key FROM ({NORMALIZED})")
def task_identity(t: Tables):
    return t.sql(ROUTED).select("kind", "id", R.task_key(R.normalize_reference(F.col("raw"))).alias("task_key"))


@query("config_fingerprint", """
  SELECT p_partkey, left(sha256('{' || CASE WHEN p_size % 2 = 0 THEN '' ELSE '"asr_language":"' || p_brand || '",' END
    || '"formats":["md","' || p_type || '"],"keep_audio":' || CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END || ',"limit_seconds":' || p_size || '}'), 16) AS config_fingerprint FROM {part}""")
def config_fingerprint(t: Tables):
    """One row of settings per part; what is null is not given, other columns do not matter."""
    size = F.col("p_size")
    settings = {
        "limit_seconds": size, "asr_language": F.when(size % 2 != 0, F.col("p_brand")), "formats": F.array(F.lit("md"), F.col("p_type")),
        "keep_audio": size > 25, "verbose": F.col("p_name"),
    }
    return t["part"].select("p_partkey", fingerprint_of(settings).alias("config_fingerprint"))


# ---- manifests: files written from `pages`, one folder per thousand pages, then scanned ----

_GROUP = "CAST(floor(page_id / 1000) AS BIGINT)"
TEXT_LINES = f"""SELECT {_GROUP} AS grp, page_id, CASE CAST(page_id % 5 AS INT) WHEN 0 THEN url WHEN 1 THEN '# ' || url
    WHEN 2 THEN '推荐 ' || url || '。 以及 ' || url || '?again=1 等' WHEN 3 THEN 'site' || CAST(page_id AS STRING) || '.example.org/x'
    ELSE 'only prose, no link' END AS value FROM {{pages}}"""
JSON_LINES = f"""SELECT {_GROUP} AS grp, page_id, CASE CAST(page_id % 4 AS INT)
    WHEN 0 THEN '{{"source":"' || url || '","name":" P' || CAST(page_id AS STRING) || ' ","tags":["a"," b ",""]}}'
    WHEN 1 THEN '{{"source":"' || url || '","tags":"x;y"}}' WHEN 2 THEN '{{"source":"  "}}' ELSE '{{broken' END AS value FROM {{pages}}"""
CSV_ROWS = f"""SELECT {_GROUP} AS grp, page_id, CASE WHEN page_id % 6 = 5 THEN '' ELSE url END AS source,
    'n,' || CAST(page_id AS STRING) AS name, 'web,ai' AS tags FROM {{pages}}"""


def _write_groups(t: Tables, sql: str, label: str, form: str, path: str | None = None) -> str:
    """One file per group, its rows in page order."""
    path = path or scratch_path(t.spark, label)
    rows = t.sql(sql).repartition("grp").sortWithinPartitions("grp", "page_id").drop("page_id")
    writer = rows.write.partitionBy("grp")
    writer.csv(path, header=True, escape='"') if form == "csv" else getattr(writer, form)(path)
    return path


def _group_of(file):
    return F.regexp_extract(file, r"grp=(\d+)", 1).cast("long").alias("grp")


def _numbered(sql: str, first: int = 1) -> str:
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY page_id) + {first - 1} AS BIGINT) AS line_number FROM ({sql})"


_TEXT_ITEMS = f"""
  WITH n AS ({_numbered(TEXT_LINES)}), r AS (
    SELECT grp, line_number, CASE WHEN value LIKE 'site%' THEN [value]
      ELSE list_transform(regexp_extract_all(value, 'https?://[^\\s<>"'']+'), lambda x: rtrim(x, '{D.PUNCTUATION}')) END AS refs
    FROM n WHERE value NOT LIKE '#%'),
  e AS (SELECT grp, line_number, unnest(refs) AS source FROM r)
  SELECT grp, min(line_number) AS line_number, source FROM e GROUP BY grp, source"""
_JSON_ITEMS = f"""
  SELECT grp, line_number, json_extract_string(value, '$.source') AS source, trim(coalesce(json_extract_string(value, '$.name'), '')) AS name,
    CASE WHEN contains(value, '"x;y"') THEN 'x|y' ELSE 'a|b' END AS tags
  FROM ({_numbered(JSON_LINES)}) WHERE value LIKE '{{"source":"http%'"""
_CSV_ITEMS = f"SELECT grp, line_number, source, name, 'web|ai' AS tags FROM ({_numbered(CSV_ROWS, 2)}) WHERE source <> ''"


@query("scan_text_manifest", _TEXT_ITEMS)
def scan_text_manifest(t: Tables):
    path = _write_groups(t, TEXT_LINES, "text-manifest", "text")
    items = M.text_items(M.numbered_lines(t.spark, path, ".txt"))
    return items.select(_group_of("file"), "line_number", "source")


@query("scan_jsonl_manifest", f"""{_JSON_ITEMS}
  UNION ALL SELECT grp, line_number, '' AS source, CASE WHEN value LIKE '{{broken' THEN 'not_json' ELSE 'source_missing' END AS name, '' AS tags
  FROM ({_numbered(JSON_LINES)}) WHERE value NOT LIKE '{{"source":"http%'""")
def scan_jsonl_manifest(t: Tables):
    path = _write_groups(t, JSON_LINES, "json-manifest", "text")
    items, bad = M.json_items(M.numbered_lines(t.spark, path, ".txt"))
    good = items.select(_group_of("file"), "line_number", "source", "name", F.array_join("tags", "|").alias("tags"))
    refused = bad.select(_group_of("file"), "line_number", F.lit("").alias("source"), F.col("reason").alias("name"), F.lit("").alias("tags"))
    return good.unionByName(refused)


@query("scan_csv_manifest", _CSV_ITEMS)
def scan_csv_manifest(t: Tables):
    path = _write_groups(t, CSV_ROWS, "csv-manifest", "csv")
    items = M.csv_items(t.spark, path)
    return items.select(_group_of("file"), "line_number", "source", "name", F.array_join("tags", "|").alias("tags"))


_GOOD_JSON = f"SELECT grp, page_id, source, name, tags FROM ({CSV_ROWS}) WHERE source <> ''"
_ALL_ITEMS = f"""
  SELECT 'txt' AS form, grp, line_number, source FROM ({_TEXT_ITEMS})
  UNION ALL SELECT 'json' AS form, grp, line_number, source FROM ({_numbered(_GOOD_JSON)})
  UNION ALL SELECT 'csv' AS form, grp, line_number, source FROM ({_CSV_ITEMS})"""


def _mixed_folder(t: Tables) -> str:
    """One root with text, JSON and CSV manifests below it."""
    root = scratch_path(t.spark, "mixed")
    for k, (sql, form) in enumerate(((TEXT_LINES, "text"), (_GOOD_JSON, "json"), (CSV_ROWS, "csv"))):
        _write_groups(t, sql, "", form, f"{root}/kind={k}")
    return root


@query("scan_manifest_dispatch", f"""
  SELECT form, grp, line_number, source, '' AS reason FROM ({_ALL_ITEMS})
  UNION ALL SELECT '' AS form, c_nationkey AS grp, 0 AS line_number, '' AS source, 'not_a_manifest' AS reason FROM {{customer}} GROUP BY c_nationkey
  UNION ALL SELECT 'csv' AS form, c_nationkey AS grp, 1 AS line_number, '' AS source, 'no_source_column' AS reason FROM {{customer}} GROUP BY c_nationkey
  UNION ALL SELECT 'jsonl' AS form, c_nationkey AS grp, count(*) AS line_number, '' AS source, 'not_json' AS reason FROM {{customer}} GROUP BY c_nationkey""")
def scan_manifest_dispatch(t: Tables):
    """One mixed folder in one scan: each file by its suffix, bad lines and foreign files named."""
    root = _mixed_folder(t)
    groups = t["customer"].groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    name = lambda suffix: F.concat(F.lit("kind=3/grp="), F.col("c_nationkey").cast("string"), F.lit(f"/x.{suffix}"))
    for suffix, text in (
        ("md", F.lit("https://e.org/")), ("csv", F.lit("url,name\nhttps://e.org/,x\n")),
        ("jsonl", F.concat(F.repeat(F.lit("\n"), (F.col("n") - 1).cast("int")), F.lit("{broken"))),
    ):
        export_files(groups.select(name(suffix).alias("name"), text.alias("text")), "name", "text", root)
    items, bad = M.record_items(M.manifest_records(t.spark, root))
    form = F.regexp_extract("file", r"\.(txt|jsonl|json|csv)$", 1).alias("form")
    return items.select(form, _group_of("file"), "line_number", "source", F.lit("").alias("reason")).unionByName(
        bad.select(form, _group_of("file"), "line_number", F.lit("").alias("source"), "reason")
    )


def _all_manifests(t: Tables):
    """A mixed folder through the splitting readers."""
    return M.load_manifests(t.spark, _mixed_folder(t))


@query("union_manifests", f"SELECT source, count(*) AS items FROM ({_ALL_ITEMS}) GROUP BY source")
def union_manifests(t: Tables):
    return _all_manifests(t).groupBy("source").agg(F.count(F.lit(1)).alias("items"))
