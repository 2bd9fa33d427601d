"""Publishing, the source index and the corpus inventory over `documents`, `pages` and `labels`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock as C
from ..functions import naming as N
from ..functions import text as T
from ..functions import verdicts as V
from ..operators import inventory as I
from ..operators import publish as P
from ..operators import source_index as X
from ..runtime import scratch_path
from ..sinks import documents as SD
from ..sinks.index_files import IndexFile
from ..sinks.published import PublishedTable
from ..sources import captures as SC
from ..sources.manifests import numbered_lines
from . import duck as D
from .registry import Tables, query

# Titles repeat: about eight captures each, some long enough to be cut to one stem.
CAPTURES = """SELECT doc_id AS seq, CASE WHEN doc_id % 4 = 0 THEN repeat('long title ', 15) || CAST(doc_id % 3 AS STRING) ELSE lang || ' ' || CAST(CAST(floor(doc_id / 8) AS BIGINT) AS STRING) END AS title,
    1704067200 + (doc_id * 7919) % 1000003 AS at_seconds, doc_id % 9 <> 1 AS ok FROM {documents}"""
BATCHES = 3
_DAY = "strftime(make_timestamp((at_seconds + 28800) * 1000000), '%Y%m%d')"
_NAMED = f"SELECT *, {_DAY} || '__' || rtrim(left(title, 137), ' .') AS name FROM ({CAPTURES})"


def _owned(which: str = "true") -> str:
    """(name, title) pairs of some captures with the owner of each name."""
    days = f"SELECT name, title, min(struct_pack(t := at_seconds, s := seq)) AS first, max(struct_pack(t := at_seconds, s := seq)) AS last, count(*) AS captures FROM ({_NAMED}) WHERE ok AND {which} GROUP BY name, title"
    return f"SELECT d.*, first_value(title) OVER (PARTITION BY name ORDER BY first, title) AS owner FROM ({days}) d"


def _current(which: str = "true") -> str:
    return f"SELECT title, arg_max(name, last) AS name, max(last) AS last FROM ({_owned(which)}) WHERE title = owner GROUP BY title"


_OWNED, _CURRENT = _owned(), _current()


def _captures(t: Tables):
    return t.sql(CAPTURES).withColumn("captured_at", F.timestamp_seconds("at_seconds"))


@query("capture_day", f"SELECT seq, strftime(make_timestamp((at_seconds + 28800) * 1000000), '%Y-%m-%d') AS day FROM ({CAPTURES})")
def capture_day(t: Tables):
    return _captures(t).select("seq", C.capture_day(F.col("captured_at")).cast("string").alias("day"))


@query("dirname", f"SELECT seq, name FROM ({_NAMED})")
def dirname(t: Tables):
    return _captures(t).select("seq", N.dated_name(F.col("title"), F.col("captured_at")).alias("name"))


@query("title_collision", f"SELECT name, title, owner, captures FROM ({_OWNED}) WHERE title <> owner")
def title_collision(t: Tables):
    return P.collisions(_captures(t))


@query("publish_latest", f"SELECT title, name, last.s AS seq FROM ({_CURRENT})")
def publish_latest(t: Tables):
    return P.publish_latest(_captures(t)).select("title", "name", "seq")


@query("publish_replaced", f"""
  SELECT o.title, o.name AS old_name, c.name AS new_name FROM ({_OWNED}) o JOIN ({_CURRENT}) c ON c.title = o.title WHERE o.title = o.owner AND o.name <> c.name""")
def publish_replaced(t: Tables):
    return P.replaced_paths(_captures(t))


LAYOUT = """SELECT p_partkey, 'n' || CAST(p_partkey AS STRING) AS name, p_size % 2 AS images, p_partkey % 3 AS attachments FROM {part}"""


@query("sink_layout", f"""
  SELECT p_partkey, name || CASE WHEN images > 0 OR attachments > 0 OR p_partkey % 5 = 0 THEN '/content.md' ELSE '.md' END AS path,
    CASE WHEN p_partkey % 5 = 0 THEN 'md,srt,txt' ELSE 'md' END AS formats FROM ({LAYOUT})""")
def sink_layout(t: Tables):
    asked = F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("srt"), F.lit("md"), F.lit("txt"), F.lit("srt"))).otherwise(F.array().cast("array<string>"))
    formats = N.output_formats(asked)
    path = N.output_path(F.col("name"), F.col("images"), F.col("attachments"), formats)
    return t.sql(LAYOUT).select("p_partkey", path.alias("path"), F.array_join(formats, ",").alias("formats"))



def _pairs():
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    return F.array(pair("来源", F.col("source")), pair("空", F.lit("")), pair("语言", F.col("lang")), pair("来源", F.col("lang")))


_META = "'> **来源**: ' || source || chr(10) || '> **语言**: ' || lang || chr(10) || '> **来源**: ' || lang"


@query("metadata_render", f"SELECT doc_id, {_META} AS lines FROM {{documents}}")
def metadata_render(t: Tables):
    return t["documents"].select("doc_id", F.array_join(T.metadata_lines(_pairs()), "\n").alias("lines"))


_MARKDOWN = f"""'# Doc ' || doc_id || chr(10) || {_META} || chr(10) || '>' || chr(10) || '> 原文链接: https://e.org/' || doc_id || chr(10) || chr(10) || '---' || chr(10) || chr(10)
    || trim(text, {D.SPACES}) || chr(10)"""


def _documents(t: Tables):
    title = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))
    link = F.concat(F.lit("https://e.org/"), F.col("doc_id").cast("string"))
    body = F.col("text")
    return t["documents"].select(
        "doc_id", title.alias("title"), T.document_markdown(title, _pairs(), link, body).alias("markdown"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("doc_id"), F.lit(5)).cast("int")).alias("capture_day"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
    )


@query("sink_markdown", f"SELECT 'd' || doc_id || '.md' AS path, CAST(DATE '2024-01-01' + CAST(doc_id % 5 AS INT) AS VARCHAR) AS day, {_MARKDOWN} AS markdown FROM {{documents}}")
def sink_markdown(t: Tables):
    path = scratch_path(t.spark, "markdown")
    SD.write_markdown(_documents(t).select("path", "capture_day", "markdown"), path)
    return t.spark.read.parquet(path).select("path", F.col("capture_day").cast("string").alias("day"), "markdown")


def _published(t: Tables) -> PublishedTable:
    """All captures merged in batches that cut across their times, so that early captures come late."""
    table = PublishedTable(t.spark, scratch_path(t.spark, "published"))
    for batch in range(BATCHES):
        table.merge(_captures(t).where(F.col("seq") % BATCHES == batch), batch)
    return table


_CAPTURE_COLUMNS = "seq bigint, title string, at_seconds bigint, ok boolean, captured_at timestamp"


@query("sink_publish", f"""
  SELECT c.title, c.name || '.md' AS path, last.s AS seq, strftime(make_timestamp((last.t + 28800) * 1000000), '%Y-%m-%d') AS day FROM ({_CURRENT}) c""")
def sink_publish(t: Tables):
    """Several batches give what one run over all captures gives."""
    rows = _published(t).read(_CAPTURE_COLUMNS)
    return rows.select("title", F.concat("name", F.lit(".md")).alias("path"), "seq", F.col("capture_day").cast("string").alias("day"))


@query("publish_collisions", f"SELECT name, title, owner, captures FROM ({_OWNED}) WHERE title <> owner")
def publish_collisions(t: Tables):
    """Refused titles by the ledger of all batches."""
    return _published(t).collisions()


@query("publish_batches", " UNION ALL ".join(f"""
  SELECT CAST({k} AS BIGINT) AS batch, o.title, o.name AS old_name, n.name AS new_name FROM ({_current(f"seq % {BATCHES} < {k}")}) o LEFT JOIN ({_current(f"seq % {BATCHES} <= {k}")}) n ON n.title = o.title
  WHERE n.name IS NULL OR n.name <> o.name""" for k in range(1, BATCHES)))
def publish_batches(t: Tables):
    """Paths that each batch made obsolete."""
    return _published(t).replaced().select("batch", "title", "old_name", "new_name")


@query("sink_txt", f"SELECT doc_id, rtrim(CASE WHEN doc_id % 2 = 0 THEN 'spoken ' || doc_id || chr(10) ELSE text END, {D.SPACES}) || chr(10) AS content FROM {{documents}}")
def sink_txt(t: Tables):
    spoken = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("spoken "), F.col("doc_id").cast("string"), F.lit("\n")))
    return t["documents"].select("doc_id", T.transcript_file(spoken, F.col("text")).alias("content"))


@query("sink_json_record", """
  SELECT p_partkey AS seq, '{"source_url":"https://e.org/' || p_partkey || '","source_id":"","source_type":"web","title":"标题 ' || p_name || '","captured_at":"2024-01-01T08:00:00+08:00","metadata":[["来源","'
    || p_brand || '"],["来源","' || p_type || '"]],"body_md":"b\\n' || p_name || '","attachments":[],"original_title":"","original_description":""}' AS record FROM {part}""")
def sink_json_record(t: Tables):
    pair = lambda c: F.struct(F.lit("来源").alias("k"), F.col(c).alias("v"))
    docs = t["part"].select(
        F.col("p_partkey").alias("seq"),
        F.concat(F.lit("https://e.org/"), F.col("p_partkey").cast("string")).alias("source_url"),
        F.lit("web").alias("source_type"),
        F.concat(F.lit("标题 "), "p_name").alias("title"),
        F.timestamp_seconds(F.lit(1_704_067_200)).alias("captured_at"),
        F.array(pair("p_brand"), pair("p_type")).alias("metadata"),
        F.concat(F.lit("b\n"), "p_name").alias("body_md"),
    )
    return SD.json_record(docs)


# ---- corpus folder: written from `customer`, then scanned ----

CORPUS = """SELECT CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN '20240101__a' || CAST(c_custkey AS STRING) || '.md' WHEN 1 THEN '20240102__b' || CAST(c_custkey AS STRING) || '/content.md'
    ELSE '20240103__c' || CAST(c_custkey AS STRING) || '/notes.md' END AS path, '# ' || c_name || chr(10) || 'body' AS content FROM {customer}"""


def _corpus(t: Tables):
    path = scratch_path(t.spark, "corpus")
    rows = t.sql(CORPUS)
    SD.export_files(rows, "path", "content", path)
    return SC.corpus_files(t.spark, path)


_SCANNED = "SELECT path AS source, regexp_extract(content, '^# (.*)', 1) AS title FROM (" + CORPUS + ") WHERE path NOT LIKE '%/notes.md'"


@query("scan_corpus", _SCANNED)
def scan_corpus(t: Tables):
    return _corpus(t).select("source", "title")


@query("inventory_sort", "SELECT p_name || ' ' || p_partkey || '.md' AS source FROM {part} ORDER BY source")
def inventory_sort(t: Tables):
    return t["part"].select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".md")).alias("source")).orderBy("source")


# ---- archive status: documents joined to their labels ----

SOURCES = "SELECT '2024' || lpad(CAST(doc_id % 9000 + 1000 AS STRING), 4, '0') || '__d' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '/content.md' END AS source, doc_id FROM {documents}"
ENTRIES = f"""SELECT s.source AS source, CASE WHEN l.quality = 1 THEN 'Refinement' ELSE 'DeepRead + Learning' END AS method,
    CASE WHEN l.toxic = 0 THEN 'r/' || CAST(l.doc_id AS STRING) ELSE '' END AS refinement, 'dr/' || CAST(l.doc_id AS STRING) AS deep_read,
    CASE WHEN l.doc_id % 3 = 0 THEN '' ELSE 'le/' || CAST(l.doc_id AS STRING) END AS learning FROM {{labels}} l JOIN ({SOURCES}) s ON s.doc_id = l.doc_id"""
_METHOD = "CASE WHEN method = 'Refinement' AND refinement <> '' THEN 'Refinement' WHEN method = 'DeepRead + Learning' AND deep_read <> '' AND learning <> '' THEN 'DeepRead + Learning' ELSE '未处理' END"
_INVENTORY = f"""SELECT s.source, {_METHOD} AS method, CASE WHEN {_METHOD} <> '未处理' THEN '是' ELSE '否' END AS read,
    coalesce(refinement, '') AS refinement, coalesce(deep_read, '') AS deep_read, coalesce(learning, '') AS learning FROM ({SOURCES}) s LEFT JOIN ({ENTRIES}) e USING (source)"""


def _inventory(t: Tables):
    return I.build(t.sql(SOURCES), t.sql(ENTRIES))


@query("join_status", _INVENTORY)
def join_status(t: Tables):
    return _inventory(t)


@query("processing_method", f"SELECT source, {_METHOD} AS method FROM ({ENTRIES})")
def processing_method(t: Tables):
    c = F.col
    method = V.processing_method(c("method"), c("refinement"), c("deep_read"), c("learning"))
    return t.sql(ENTRIES).select("source", method.alias("method"))


@query("processing_totals", f"""
  SELECT count(*) AS total, count(*) FILTER (WHERE method = 'DeepRead + Learning') AS learning, count(*) FILTER (WHERE method = 'Refinement') AS refinement,
    count(*) FILTER (WHERE read = '否') AS unread FROM ({_INVENTORY})""")
def processing_totals(t: Tables):
    return I.totals(_inventory(t))


_TOTALS_LINE = f"""SELECT '原稿 **' || count(*) || '** 篇；DeepRead + Learning **' || count(*) FILTER (WHERE method = 'DeepRead + Learning') || '** 篇；Refinement **'
    || count(*) FILTER (WHERE method = 'Refinement') || '** 篇；未精读 **' || count(*) FILTER (WHERE read = '否') || '** 篇。' AS line FROM ({_INVENTORY})"""


@query("sink_processing_report", f"""
  SELECT '| output/' || source || ' | ' || method || ' | ' || read || ' | ' || CASE method WHEN 'Refinement' THEN '[Refinement](' || refinement || ')'
    WHEN 'DeepRead + Learning' THEN '[DeepRead](' || deep_read || ') · [Learning](' || learning || ')' ELSE '—' END || ' |' AS line FROM ({_INVENTORY})
  UNION ALL {_TOTALS_LINE}""")
def sink_processing_report(t: Tables):
    inventory = _inventory(t)
    return I.report_rows(inventory).select("line").unionByName(I.report_totals(inventory))


@query("scan_status_manifest", f"SELECT source, method, refinement, deep_read, learning FROM ({ENTRIES})")
def scan_status_manifest(t: Tables):
    """One manifest file per thousand documents, written and scanned back."""
    path = scratch_path(t.spark, "status")
    number = F.regexp_extract("source", r"__d(\d+)", 1).cast("long")
    rows = t.sql(ENTRIES).withColumn("grp", F.floor(number / 1000).cast("long"))
    entry = F.struct("source", "method", "refinement", "deep_read", "learning")
    files = rows.groupBy("grp").agg(F.to_json(F.struct(F.collect_list(entry).alias("entries"))).alias("value"))
    files.repartition("grp").write.partitionBy("grp").text(path)
    return SC.status_entries(t.spark, path).select("source", "method", "refinement", "deep_read", "learning")


# ---- source index ----

INDEX = """SELECT page_id AS row_no, CASE WHEN page_id % 9 = 0 THEN '本地视频' ELSE url END AS link, 'GenericWebExtractor' AS extractor,
    '20240101__p' || CAST(page_id AS STRING) || '.md' AS product, '2024-01-01' AS day, CASE WHEN page_id % 3 = 0 THEN '是' ELSE '否' END AS read FROM {pages}"""
# Incoming rows: the same page again, the next page's product, repeats of one link, brand-new rows.
INCOMING = """SELECT page_id AS seq, CASE CAST(page_id % 6 AS INT) WHEN 5 THEN 'https://one.example.org/' WHEN 4 THEN 'https://new.example.org/' || CAST(page_id AS STRING) ELSE url || '/' END AS link,
    'WebV2' AS extractor, CASE CAST(page_id % 6 AS INT) WHEN 0 THEN '20240101__p' || CAST(page_id AS STRING) || '.md' WHEN 1 THEN '20240101__p' || CAST(page_id + 1 AS STRING) || '.md'
      WHEN 5 THEN '20240301__one' || CAST(page_id % 4 AS STRING) || '.md' ELSE '20240202__q' || CAST(page_id AS STRING) || '.md' END AS product, '2024-02-02' AS day,
    CASE WHEN page_id % 7 = 0 THEN '20240101__p' || CAST(page_id + 3 AS STRING) || '.md' ELSE '' END AS gone FROM {pages}"""


def _key(e: str) -> str:
    return f"CASE WHEN {e} IN ('', '—', '本地视频') THEN '' ELSE regexp_replace(split_part(split_part({e}, '#', 1), '?', 1), '/+$', '') || regexp_extract({e}, '[?#].*$', 0) END"


def _incoming(t: Tables):
    return t.sql(INCOMING).withColumn("obsolete", F.when(F.col("gone") != "", F.array("gone")).otherwise(F.array().cast("array<string>")))


_MATCH = f"""SELECT DISTINCT x.row_no, i.seq FROM (SELECT *, {_key('link')} AS lk FROM ({INDEX})) x JOIN (SELECT *, {_key('link')} AS lk FROM ({INCOMING})) i
    ON (i.lk <> '' AND i.lk = x.lk) OR i.product = x.product OR (i.gone <> '' AND i.gone = x.product)"""


@query("join_index_match", _MATCH)
def join_index_match(t: Tables):
    return X.match_rows(t.sql(INDEX), _incoming(t))


_SUMMARY = f"""
  WITH x AS (SELECT *, {_key('link')} AS lk FROM ({INDEX})), i AS (SELECT *, {_key('link')} AS lk FROM ({INCOMING})),
  p AS (SELECT product, seq FROM i UNION SELECT gone, seq FROM i WHERE gone <> ''),
  a AS (SELECT row_no, count(*) AS links, min(seq) AS first FROM x JOIN i ON i.lk = x.lk AND x.lk <> '' GROUP BY row_no),
  b AS (SELECT row_no, count(*) AS products, min(seq) AS first FROM x JOIN p ON p.product = x.product GROUP BY row_no)
  SELECT row_no, coalesce(links, 0) AS links, coalesce(products, 0) AS products, least(a.first, b.first) AS first_seq FROM a FULL JOIN b USING (row_no)"""


@query("index_match_summary", _SUMMARY)
def index_match_summary(t: Tables):
    return X.match_summary(t.sql(INDEX), _incoming(t))


_UPSERT = f"""
  WITH RECURSIVE i AS (SELECT *, {_key('link')} AS lk FROM ({INCOMING})),
  n AS (SELECT -row_no - 1 AS node, 0 AS kind, row_no AS place, -1 AS at, link, extractor, product, day, read, {_key('link')} AS lk FROM ({INDEX})
        UNION ALL SELECT seq, 1, seq, seq, link, extractor, product, day, '否', lk FROM i),
  ev AS (SELECT lk AS k, 'l' AS w, seq FROM i WHERE lk <> '' UNION ALL SELECT product, 'p', seq FROM i UNION ALL SELECT gone, 'p', seq FROM i WHERE gone <> ''),
  k AS (SELECT n.node, min(ev.seq) AS killer FROM n JOIN ev ON ev.seq > n.at AND ((ev.w = 'l' AND ev.k = n.lk AND n.lk <> '') OR (ev.w = 'p' AND ev.k = n.product)) GROUP BY n.node),
  t AS (SELECT n.*, k.killer FROM n LEFT JOIN k USING (node)),
  up AS (SELECT node AS leaf, kind, place, read, product, node, killer, true AS same FROM t WHERE node NOT IN (SELECT killer FROM t WHERE killer IS NOT NULL)
         UNION ALL SELECT up.leaf, up.kind, up.place, up.read, up.product, t.node, t.killer, up.same AND up.product = t.product FROM up JOIN t ON t.node = up.killer),
  r AS (SELECT node, arg_min(kind, struct_pack(a := kind, b := place)) AS row_kind, arg_min(place, struct_pack(a := kind, b := place)) AS row_no,
        arg_min(CASE WHEN kind = 0 AND same THEN read ELSE '否' END, struct_pack(a := kind, b := place)) AS read FROM up WHERE killer IS NULL GROUP BY node)
  SELECT r.row_kind, r.row_no, t.link, t.extractor, t.product, t.day, r.read FROM r JOIN t USING (node)"""


@query("index_upsert", _UPSERT)
def index_upsert(t: Tables):
    return X.upsert(t.sql(INDEX), _incoming(t))


_ROW = "'| ' || link || ' | ' || extractor || ' | `' || product || '` | ' || day || ' | ' || read || ' |'"
# What stands around the table, and a line inside it that is no row.
_BEFORE, _AFTER = (X.INDEX_TITLE, "", "Kept by hand."), ("closing note", "| not | a | table | row |", "")


def _lit_lines(values, at: int) -> str:
    return " UNION ALL ".join(f"SELECT {at} AS part, 0 AS kind, {k} AS no, '{v}' AS line" for k, v in enumerate(values))


@query("sink_source_index", f"""
  WITH l AS ({_lit_lines(_BEFORE, 0)} UNION ALL {_lit_lines((X.INDEX_HEADER, X.INDEX_SEPARATOR), 1)} UNION ALL {_lit_lines(_AFTER, 4)}
    UNION ALL SELECT 3, row_kind, row_no, {_ROW} FROM ({_UPSERT}))
  SELECT row_number() OVER (ORDER BY part, kind, no) AS line_number, line FROM l""")
def sink_source_index(t: Tables):
    """An index with lines written by hand, merged with all incoming rows and read back whole."""
    index = IndexFile(t.spark, scratch_path(t.spark, "index"))
    hand = t.spark.createDataFrame(
        [(part, k, v) for part, values in ((0, _BEFORE), (1, (X.INDEX_HEADER, X.INDEX_SEPARATOR)), (3, _AFTER)) for k, v in enumerate(values)],
        "part int, no bigint, value string",
    )
    rows = X.index_lines(t.sql(INDEX)).select(F.lit(2).alias("part"), F.col("row_no").alias("no"), F.col("line").alias("value"))
    index.write(hand.unionByName(rows), ["part", "no"], 0)
    index.merge(_incoming(t), expected=0)
    return index.lines().select("line_number", F.col("value").alias("line"))


@query("scan_source_index", f"""
  SELECT row_no // 500 AS grp, row_no % 500 AS row_no, link, product, day, CASE WHEN row_no // 500 % 2 = 1 THEN '否' ELSE read END AS read FROM ({INDEX})""")
def scan_source_index(t: Tables):
    """Index files of 500 rows, every second one in the old four-column form."""
    path = scratch_path(t.spark, "index-files")
    rows = t.sql(INDEX).withColumn("grp", F.floor(F.col("row_no") / 500).cast("long"))
    old = F.col("grp") % 2 == 1
    line = X.render_row(*[F.col(c) for c in ("link", "extractor", "product", "day", "read")])
    short = F.regexp_replace(line, r" \| [^|]* \|$", " |")
    body = rows.select("grp", (F.col("row_no") % 500 + 2).alias("at"), F.when(old, short).otherwise(line).alias("value"))
    head = F.when(old, F.lit("| 链接 | Extractor | 产物路径 | 日期 |")).otherwise(F.lit(X.INDEX_HEADER))
    ruler = F.when(old, F.lit("|---|---|---|---|")).otherwise(F.lit(X.INDEX_SEPARATOR))
    files = rows.select("grp").distinct()
    extra = files.select("grp", F.explode(F.array(
        F.struct(F.lit(-1).cast("long").alias("at"), F.lit(X.INDEX_TITLE).alias("value")),
        F.struct(F.lit(0).cast("long").alias("at"), head.alias("value")),
        F.struct(F.lit(1).cast("long").alias("at"), ruler.alias("value")),
        F.struct(F.lit(9999).cast("long").alias("at"), F.lit("closing note").alias("value")),
        F.struct(F.lit(10000).cast("long").alias("at"), F.lit("| not | a | table | row |").alias("value")),
    )).alias("x")).select("grp", "x.at", "x.value")
    every = body.unionByName(extra).repartition("grp").sortWithinPartitions("grp", "at").drop("at")
    every.write.partitionBy("grp").text(path)
    parsed = SC.parse_index(numbered_lines(t.spark, path, ".txt"))
    return parsed.select(F.regexp_extract("file", r"grp=(\d+)", 1).cast("long").alias("grp"), "row_no", "link", "product", "day", "read")


OLD_ROWS = f"""SELECT doc_id AS row_no, 'https://e.org/' || CAST(doc_id AS STRING) AS link, 'Web' AS extractor, '`' || source || '`' AS product, '1999-01-01' AS day FROM ({SOURCES}) WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id + 1000000000 AS row_no, 'https://e.org/later' AS link, 'Web' AS extractor, source AS product, '2000-01-01' AS day FROM ({SOURCES}) WHERE doc_id % 6 = 0"""
_SYNCED = f"""
  WITH o AS (SELECT trim(product, '`') AS source, arg_max(link, row_no) AS link, arg_max(extractor, row_no) AS extractor, arg_max(day, row_no) AS day FROM ({OLD_ROWS}) GROUP BY 1)
  SELECT i.source, coalesce(o.link, CASE WHEN i.source LIKE '%/content.md' THEN '本地视频' ELSE '—' END) AS link,
    coalesce(o.extractor, CASE WHEN i.source LIKE '%/content.md' THEN 'LocalMediaExtractor' ELSE 'UnindexedSource' END) AS extractor,
    coalesce(o.day, i.source[1:4] || '-' || i.source[5:6] || '-' || i.source[7:8]) AS day, i.read FROM ({_INVENTORY}) i LEFT JOIN o USING (source)"""


@query("join_index_existing", _SYNCED)
def join_index_existing(t: Tables):
    return I.index_rows(_inventory(t), t.sql(OLD_ROWS))


@query("index_rows_rendered", f"SELECT source, '| ' || link || ' | ' || extractor || ' | `' || source || '` | ' || day || ' | ' || read || ' |' AS line FROM ({_SYNCED})")
def index_rows_rendered(t: Tables):
    return I.index_line(I.index_rows(_inventory(t), t.sql(OLD_ROWS)))
