"""Distributed operators against plain Python on random data, with tiny blocks and hot keys."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import answers as A
from corpusloom.operators import edits as E
from corpusloom.operators import ordered as O
from corpusloom.operators import publish as P
from corpusloom.operators import segments as S
from corpusloom.operators import source_index as X
from corpusloom.operators import tasks as K


def hot(rng, n):
    """Group numbers where one group holds over a third of the rows."""
    return [0 if rng.random() < 0.4 else rng.choice([None, *range(1, 9)]) for _ in range(n)]


@pytest.fixture
def rows():
    rng = random.Random(5)
    groups = hot(rng, 400)
    return [(g, i * 3, rng.choice("aab")) for i, g in enumerate(groups)]


def test_row_numbers_cross_blocks(spark, rows):
    df = spark.createDataFrame(rows, "g int, p long, k string")
    got = {(r["g"], r["p"]): r["n"] for r in O.with_row_number(df, ["g"], ["p"], O.block_of(F.col("p"), 50), "n").collect()}
    seen, want = {}, {}
    for g, p, _ in rows:
        seen[g] = seen.get(g, 0) + 1
        want[(g, p)] = seen[g]
    assert got == want


def test_runs_and_neighbours_cross_blocks(spark, rows):
    df = spark.createDataFrame(rows, "g int, p long, k string")
    got = {(r["g"], r["p"]): r["s"] for r in O.with_runs(df, ["g"], "p", F.col("k"), "s", rows=40).collect()}
    last, want = {}, {}
    for g, p, k in rows:
        if g not in last or last[g][0] != k:
            last[g] = (k, p)
        want[(g, p)] = last[g][1]
    assert got == want
    for after in (False, True):
        near = O.with_neighbour(df, ["g"], "p", O.block_of(F.col("p"), 40), F.col("k"), "x", after=after)
        line = {}
        for g, p, k in rows:
            line.setdefault(g, []).append((p, k))
        expect = {}
        for g, items in line.items():
            for i, (p, _) in enumerate(items):
                j = i + (1 if after else -1)
                expect[(g, p)] = items[j][1] if 0 <= j < len(items) else None
        assert {(r["g"], r["p"]): r["x"] for r in near.collect()} == expect


def sequential_windows(segments, w):
    out, key = [], None
    for no, start, end, text in segments:
        if not text.strip():
            continue
        k = int(max(0.0, start) // w)
        if k != key:
            out.append([no, k * w, end, [text.strip()]])
            key = k
        else:
            out[-1][2] = max(out[-1][2], end)
            out[-1][3].append(text.strip())
    total = max((e for _, _, e, t in segments if t.strip()), default=0)
    return {(f, float(s), min(total, max(min(s + w, total), e)), "\n\n".join(t)) for f, s, e, t in out}


def test_segment_windows_out_of_order_starts(spark):
    rng = random.Random(7)
    docs, flat = {}, []
    for d in range(4):
        for i in range(120 if d == 0 else 30):
            s = float(rng.randrange(0, 900))
            row = (i, s, s + rng.randrange(1, 40), rng.choice([" x ", "y", "  "]) + ("" if rng.random() < 0.2 else str(i)))
            docs.setdefault(d, []).append(row)
            flat.append((d, *row))
    df = spark.createDataFrame(flat, "doc_id long, seg_no long, start double, end double, text string")
    got = S.segment_windows(df, 100, block_rows=16).collect()
    for d, items in docs.items():
        mine = {(r["first_seg"], r["window_start"], r["window_end"], r["text"]) for r in got if r["doc_id"] == d}
        assert mine == sequential_windows(items, 100)


def test_text_parts_rejoin(spark):
    df = spark.createDataFrame([(1, i, f"t{i}") for i in range(25)], "doc_id long, seg_no long, text string")
    parts = S.transcript_text(df, part_rows=10).orderBy("part_no").collect()
    assert [r["part_no"] for r in parts] == [0, 1, 2]
    assert "\n\n".join(r["text"] for r in parts) == "\n\n".join(f"t{i}" for i in range(25))


def key(link):
    return "" if link in ("", "—") else link.rstrip("/")


def one_by_one(index, incoming):
    """The index as a list, updated by one incoming row after the other."""
    table = [dict(r, place=(0, r["row_no"])) for r in index]
    for new in incoming:
        hits = [
            r for r in table
            if (key(new["link"]) and key(r["link"]) == key(new["link"])) or r["product"] == new["product"] or r["product"] in new["obsolete"]
        ]
        fresh = dict(link=new["link"], product=new["product"], read="否", place=(1, new["seq"]))
        if not hits:
            table.append(fresh)
            continue
        front = hits[0]
        fresh["place"] = front["place"]
        if front["product"] == new["product"]:
            fresh["read"] = front["read"]
        table[table.index(front)] = fresh
        for r in hits[1:]:
            table.remove(r)
    return [(r["place"], r["link"], r["product"], r["read"]) for r in table]


@pytest.mark.parametrize("seed", range(4))
def test_index_upsert_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    links = [f"https://e.org/{i}" for i in range(12)] + ["—"]
    index = []
    for i in range(12):
        index.append(dict(row_no=i, link=links[i] if rng.random() < 0.8 else "—", extractor="W", product=f"p{i}", day="d", read=rng.choice("是否")))
    incoming = []
    for seq in range(40):
        link = links[0] if rng.random() < 0.35 else rng.choice(links)
        gone = [f"p{rng.randrange(20)}"] if rng.random() < 0.3 else []
        incoming.append(dict(seq=seq, link=link + ("/" if link != "—" and rng.random() < 0.3 else ""), extractor="W", product=f"p{rng.randrange(20)}", day="d", obsolete=gone))
    old = spark.createDataFrame(index, "row_no long, link string, extractor string, product string, day string, read string")
    new = spark.createDataFrame(incoming, "seq long, link string, extractor string, product string, day string, obsolete array<string>")
    got = [((r["row_kind"], r["row_no"]), r["link"], r["product"], r["read"]) for r in X.upsert(old, new).orderBy("row_kind", "row_no").collect()]
    assert got == one_by_one(index, incoming)


def brute_edits(source, edits):
    """Accepted edits and the patched text of one segment."""
    spans = []
    for n, old, new in edits:
        if not old.strip() or not new.strip() or old == new or old == source or source.count(old) != 1:
            continue
        if len(new) >= len(source) or len(new) > max(24, 4 * len(old)):
            continue
        at = source.find(old)
        spans.append((n, at, at + len(old), new))
    bad = {a[0] for a in spans for b in spans if a[0] != b[0] and max(a[1], b[1]) < min(a[2], b[2])}
    text = source
    for n, s, e, new in sorted((x for x in spans if x[0] not in bad), key=lambda x: -x[1]):
        text = text[:s] + new + text[e:]
    return {x[0] for x in spans} - bad, text


def test_edits_against_brute_force(spark):
    import json

    rng = random.Random(3)
    segments, replies, want = [], [], {}
    for d in range(25):
        source = "".join(rng.choice("abcdef ") for _ in range(30))
        edits = []
        for n in range(1, 9):
            i = rng.randrange(0, 27)
            edits.append((n, source[i : i + rng.randrange(1, 6)], rng.choice(["X", "YY", " ", "abc"])))
        segments.append((d, 0, source))
        replies.append((d, "noise ```json\n" + json.dumps({"edits": [{"id": 0, "old": o, "new": w} for _, o, w in edits]}) + "\n```"))
        want[d] = brute_edits(source, edits)
    seg = spark.createDataFrame(segments, "w long, seg_no long, text string")
    rep = E.explode_replies(spark.createDataFrame(replies, "w long, reply string"))
    marked = E.mark_overlaps(E.validate(rep, seg, ["w"]), ["w"])
    texts = {r["w"]: r["new_text"] for r in E.apply_edits(seg, marked, ["w"]).collect()}
    good = {}
    for r in marked.where("reason = ''").collect():
        good.setdefault(r["w"], set()).add(r["number"])
    assert {d: (good.get(d, set()), texts[d]) for d in want} == want


SPELLED = re.compile(r"(?<![A-Za-z0-9])(?:[A-Za-z](?:\s+|[.·、]\s*)){1,7}[A-Za-z](?![A-Za-z0-9])")


def plain_normalize(text):
    text = text.replace("\xa0", " ").strip()
    text = re.sub("[🎼😊😄😁😂😅😆😢😭😔😞😡😠😱😰😨🤢🤧😷🤒🤕]+", "", text)
    text = re.sub(r"[\t\r\n ]+", " ", text)
    text = SPELLED.sub(lambda m: "".join(re.findall("[A-Za-z]", m.group(0))).upper(), text)
    text = re.sub(r"(?<=[㐀-鿿])\s+(?=[㐀-鿿])", "", text)
    text = re.sub(r"\s+([，。！？；：、,.!?;:])", r"\1", text)
    text = re.sub(r"([（(【\[])\s+", r"\1", text)
    return re.sub(r"\s+([）)】\]])", r"\1", text).strip()


def test_text_normalisation_on_documents_and_noise(spark):
    rng = random.Random(1)
    alphabet = "ab C.·、 　中文\t\n\xa0😊()【】,。1é"
    noise = [(i, "".join(rng.choice(alphabet) for _ in range(60))) for i in range(300)]
    docs = [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(noise + docs, "id long, text string")
    got = {r["id"]: r["n"] for r in df.select("id", T.normalize_text(F.col("text")).alias("n")).collect()}
    assert got == {i: plain_normalize(t) for i, t in noise + docs}


def test_publish_one_by_one(spark):
    rng = random.Random(9)
    titles = ["t" * 150 + "a", "t" * 150 + "b", "other", "x"]
    rows = [(i, rng.choice(titles), 1704067200 + i * 20000, rng.random() < 0.8) for i in range(60)]
    held, refused = {}, 0
    for seq, title, at, ok in rows:
        if not ok:
            continue
        day = (at + 28800) // 86400
        stem = (day, title[:137])
        if held.get(stem, (title,))[0] != title:
            refused += 1
            continue
        held = {s: v for s, v in held.items() if v[0] != title}
        held[stem] = (title, seq)
    df = spark.createDataFrame(rows, "seq long, title string, at long, ok boolean").withColumn("captured_at", F.timestamp_seconds("at"))
    got = {(r["title"], r["seq"]) for r in P.publish_latest(df).collect()}
    assert got == set(held.values())
    assert sum(r["captures"] for r in P.collisions(df).collect()) == refused


def test_completeness_one_by_one(spark):
    rng = random.Random(2)
    snaps, answers, want = [], [], {}
    for q in range(30):
        pool, expected, found, stable, before, end = rng.randrange(1, 8), rng.choice([None, 3, 9]), set(), 0, -1, None
        for r in range(12):
            snaps.append((q, r, "T", "", expected))
            shown = {f"a{rng.randrange(pool)}" for _ in range(2)}
            answers += [(q, r, i, a) for i, a in enumerate(sorted(shown))]
            if end is not None:
                continue
            found |= shown
            if len(found) >= 6:
                end = (r, "max_answers", len(found))
                continue
            stable, before = (stable + 1, before) if len(found) == before else (0, len(found))
            if expected is not None and len(found) >= expected:
                end = (r, "expected", len(found))
            elif stable >= 5:
                end = (r, "stable", len(found))
        want[q] = end or (11, "exhausted", len(found))
    s = spark.createDataFrame(snaps, "question_id long, round int, title string, detail_md string, expected int")
    a = spark.createDataFrame(answers, "question_id long, round int, pos long, answer_id string")
    got = {r["question_id"]: (r["last_round"], r["stop_reason"], r["answers_found"]) for r in A.completeness(s, a, 6).collect()}
    assert got == want


def test_registration_keeps_first_and_ids(spark):
    items = spark.createDataFrame(
        [(0, "https://a.org", "A"), (1, "https://b.org", "B"), (2, ' "https://a.org" ', "again")], "pos long, source string, name string"
    ).withColumn("tags", F.array().cast("array<string>"))
    first = K.register(K.identify(items, "f"))
    again = K.register(K.identify(items.unionByName(items.limit(1).withColumns({"source": F.lit("https://c.org"), "pos": F.lit(9).cast("long")})), "f"), first)
    assert [(r["task_id"], r["raw_source"], r["name"]) for r in again.orderBy("task_id").collect()] == [
        (1, "https://a.org", "A"), (2, "https://b.org", "B"), (3, "https://c.org", "A"),
    ]
    assert K.ids_of(K.identify(items, "f"), again).count() == 2
