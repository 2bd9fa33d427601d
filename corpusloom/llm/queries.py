"""Queries of the training-data operators over the test tables, with their DuckDB checks where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_pii")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from . import pii

    found = pii.personal_data(table(spark, folder, "documents"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*pii.BASE_KINDS))
    joined = lambda part: F.array_join(F.transform(part, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in pii.KINDS],
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


@query("op8_bpe")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from .bpe_words import encode_texts

    coded = encode_texts(table(spark, folder, "documents"), vocabulary())
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op4_quality")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from . import quality

    return quality.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from . import toxicity

    return toxicity.graded(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_block_search")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from .block_search import nearest

    found = nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op6_hamming_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from .hamming_dedup import near_duplicates

    return near_duplicates(table(spark, folder, "embeddings"))


@query("op7_bag_minhash")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from .bag_minhash import near_duplicates

    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


_MIX_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as source, len(regexp_extract_all(text, '[^ \t-\r]+')) as n_tokens,
    ('0x' || substr(md5(coalesce(source, '') || '|' || coalesce(cast(doc_id as varchar), 'null')), 1, 15))::bigint as place
  from documents),
s as (select source, sum(n_tokens)::bigint as tokens from d group by source having sum(n_tokens) > 0),
tot as (select sum(tokens)::bigint as total, count(*) as n, min(tokens) as least from s),
p as (select s.source, s.tokens, s.tokens / tot.total as p from s, tot),
grid as (
  select k, ln(sum(pow(p, k / 4096))) - (k / 4096) * sum(pow(p, k / 4096) * ln(p)) / sum(pow(p, k / 4096)) as h,
    pow(min(p), k / 4096 - 1) / sum(pow(p, k / 4096)) as r
  from p, range(0, 4097) as g(k) group by k),
base as (select coalesce(max(k) filter (h >= 0.98 * ln(n) - 1e-12), 0) as k from grid, tot),
pick as (
  select case when (select r from grid where grid.k = base.k) <= 2 + 1e-12 then base.k
    else coalesce((select min(g.k) from grid g, base b where g.k > b.k and g.r <= 2 + 1e-12), 4096) end as k
  from base),
q as (
  select p.source, tokens, round(pow(p, k / 4096) / (select sum(pow(p, k / 4096)) from p, pick) * total)::bigint as quota
  from p, pick, tot),
m as (select source, quota // tokens as passes, quota % tokens as rest, cast(ceil(tokens / 65536) as bigint) as blocks from q),
r as (select d.*, passes, rest, place % blocks as block from d join m using (source)),
b as (
  select source, block, passes, rest, sum(n_tokens) as n,
    ('0x' || substr(md5(source || '|' || block || '|' || passes), 1, 15))::bigint as turn
  from r group by source, block, passes, rest),
c as (select *, sum(n) over (partition by source order by turn, block) as upto from b),
e as (
  select r.doc_id, r.source, r.n_tokens, r.block, r.passes, r.rest, c.upto, c.n,
    sum(r.n_tokens) over (partition by r.source, r.block order by r.place) as within
  from r join c on r.source = c.source and r.block = c.block)
select doc_id, source, n_tokens, block,
  passes + case when upto - n >= rest then 0 when upto <= rest then 1 when within <= rest - upto + n then 1 else 0 end as copies
from e
"""


@query("op2_mixing", _MIX_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from . import mixing

    light = mixing.light_rows(table(spark, folder, "documents"))
    found = mixing.plan(light)
    rows = light.select("doc_id", "source", F.col("tokens").alias("n_tokens"))
    if found is None:
        return rows.withColumns({"block": F.lit(0).cast("long"), "copies": F.lit(0).cast("long")})
    return mixing.with_copies(rows, found).withColumnsRenamed({"__block": "block", "__copies": "copies"})


_LINE_SQL = r"""
with l as (
  select doc_id, unnest(range(0, len(parts))) as line, unnest(parts) as line_text
  from (select doc_id, string_split(text, chr(10)) as parts from documents where text is not null)),
w as (
  select doc_id, line, unnest(list_distinct(regexp_extract_all(line_text, '[^ \t-\r]+'))) as word from l),
f as (select word, count(*) as n from w group by word),
o as (
  select doc_id, line, word, count(*) over (partition by doc_id, line) as size,
    row_number() over (partition by doc_id, line order by f.n, word) as pos
  from w join f using (word)),
pre as (select * from o where pos <= size - ceil(0.8 * size - 1e-9) + 1),
cand as (
  select distinct a.doc_id, a.line, a.size, b.doc_id as e_doc, b.line as e_line, b.size as e_size
  from pre a join pre b on a.word = b.word and (b.doc_id < a.doc_id or (b.doc_id = a.doc_id and b.line < a.line))
    and b.size >= 0.8 * a.size - 1e-9 and a.size >= 0.8 * b.size - 1e-9),
sim as (
  select c.doc_id, c.line from cand c
    join w x on x.doc_id = c.doc_id and x.line = c.line
    join w y on y.doc_id = c.e_doc and y.line = c.e_line and y.word = x.word
  group by c.doc_id, c.line, c.size, c.e_doc, c.e_line, c.e_size
  having 9 * count(*) >= 4 * (c.size + c.e_size)),
gone as (select distinct doc_id, line from sim)
select d.doc_id, len(string_split(d.text, chr(10)))::bigint as n_lines, coalesce(g.n, 0)::bigint as n_removed,
  sha256(coalesce(k.kept, '')) as kept_sha256
from documents d
  left join (select doc_id, count(*) as n from gone group by doc_id) g using (doc_id)
  left join (
    select l.doc_id, string_agg(line_text, chr(10) order by line) as kept
    from l anti join gone using (doc_id, line) group by l.doc_id) k using (doc_id)
"""


@query("op1_line_dedup", _LINE_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from . import line_dedup

    docs = table(spark, folder, "documents").select("doc_id", "text")
    left = line_dedup.kept_lines(docs, line_dedup.removed_lines(docs))
    return left.select(
        "doc_id", F.col("__lines").cast("long").alias("n_lines"), F.col("__gone").cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


_REPEAT_SQL = r"""
with w as (
  select doc_id, coalesce(regexp_extract_all(text, '[^ \t-\r]+'), []) as words from documents),
p as (select doc_id, words, len(words) as n_words from w),
s as (select doc_id, words, unnest(range(1, n_words - 11)) as pos from p where n_words >= 13),
h as (select doc_id, pos, md5(array_to_string(words[pos:pos + 12], ' ')) as win from s),
f as (select win, min(doc_id) as first_doc from h group by win having count(*) > 1),
c as (select distinct doc_id, pos + k as pos from h join f using (win), range(0, 13) as r(k) where doc_id > first_doc),
u as (select doc_id, unnest(words) as word, unnest(range(1, n_words + 1)) as pos from p)
select p.doc_id, p.n_words::bigint as n_words, count(c.pos)::bigint as n_removed,
  sha256(coalesce(string_agg(case when c.pos is null then u.word end, ' ' order by u.pos), '')) as kept_sha256
from p left join u on u.doc_id = p.doc_id left join c on c.doc_id = u.doc_id and c.pos = u.pos
group by p.doc_id, p.n_words
"""


@query("op10_recompression", _REPEAT_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from .recompression import without_repeats

    return without_repeats(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


_MIDDLE_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (
  select doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as units, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
    ('0x' || h[25:32])::bigint as h4 from d),
c as (
  select *, len(units)::bigint as n, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain'
    when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
k as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from c),
p as (
  select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:n], '') as suffix from k)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256
from p
"""


@query("op12_fill_middle", _MIDDLE_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from .fill_middle import fill_in_middle, restored

    made = fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


_SUFFIX_SQL = r"""
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select r, doc_id, x, (length(x) // 2)::bigint as n from d),
b as (select r, n, blk, substr(x, 512 * blk + 1, 912) as part from (select r, n, x, unnest(range(0, n // 256 + 1)) as blk from w where n >= 200)),
s as (select r, n, blk, part, unnest(range(0, 256)) as k from b),
h as (select r, 256 * blk + k as pos, md5(substr(part, 2 * k + 1, 400)) as win from s where 256 * blk + k <= n - 200),
g as (select r, pos from h qualify count(*) over (partition by win) > 1),
e as (select r, pos, case when pos - lag(pos) over (partition by r order by pos) <= 200 then 0 else 1 end as fresh from g),
u as (select r, pos, sum(fresh) over (partition by r order by pos) as run from e),
m as (select r, run, min(pos) as a, max(pos) + 200 as b from u group by r, run),
l as (select r, list(a order by a) as starts, list(b order by a) as ends, sum(b - a)::bigint as lost, count(*) as spans from m group by r)
select w.doc_id, w.n as n_bytes, coalesce(lost, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
  sha256(unhex(case when lost is null then x else array_to_string(list_transform(range(0, len(starts) + 1), lambda k: substr(x, coalesce(2 * ends[k], 0) + 1, coalesce(2 * starts[k + 1], 2 * n) - coalesce(2 * ends[k], 0))), '') end)) as kept_sha256
from w left join l using (r)
"""


@query("op11_suffix_dedup", _SUFFIX_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from .suffix_dedup import without_repeats

    return without_repeats(table(spark, folder, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


_NEGATIVES_SQL = r"""
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as code
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, a.label as own, b.vec_id, b.label, list_dot_product(a.code, b.code)::bigint as score
  from r a join r b on a.vec_id <> b.vec_id and len(a.code) = len(b.code) where a.vec_id % 100 = 0),
p as (
  select anchor_id, own, vec_id as positive_id, score as positive_score from s where label = own
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id, positive_score,
  score as negative_score
from p join s using (anchor_id) where label <> p.own and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 5
"""


@query("op13_hard_negatives", _NEGATIVES_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)
