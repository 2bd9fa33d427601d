"""Ordered operators over blocks against plain Python, with groups that span many blocks and null groups."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ordered as O
from corpusloom.operators import segments as S


def segment_rows(seed, n=400):
    rng = random.Random(seed)
    rows, clock = [], {}
    for doc in (1, 2, None, 4):
        at = 0.0
        for k in range(n if doc == 1 else rng.randint(1, 60)):
            at += rng.choice([0, 1, 5, 40, 400])
            rows.append((doc, k, at, at + rng.randint(0, 30), rng.choice(["", "  ", " a ", "b", "c d"])))
    return rows


SEGMENTS = "doc_id bigint, seg_no bigint, start double, end double, text string"


def docs_of(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("block_rows,part_rows", [(4, 3), (16, 64), (1 << 16, 1 << 16)])
def test_segment_windows(spark, block_rows, part_rows):
    rows = segment_rows(block_rows)
    want = []
    for doc, own in docs_of(rows).items():
        live = [(k, max(0, int(a // 300)), e, t.strip()) for _, k, a, e, t in own if t.strip()]
        total, runs = max((e for _, _, e, _ in live), default=None), []
        for k, slot, e, t in live:
            if runs and runs[-1][0][1] == slot:
                runs[-1].append((k, slot, e, t))
            else:
                runs.append([(k, slot, e, t)])
        for run in runs:
            parts = {}
            for item in run:
                parts.setdefault((item[0] - run[0][0]) // part_rows, []).append(item)
            for no, part in parts.items():
                low = run[0][1] * 300.0
                end = min(total, max(min(low + 300, total), max(x[2] for x in part)))
                want.append((doc, run[0][0], no, low, end, len(part), "\n\n".join(x[3] for x in part)))
    got = S.segment_windows(spark.createDataFrame(rows, SEGMENTS), block_rows=block_rows, part_rows=part_rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_segment_windows_move_texts_once(spark):
    """Only pieces across block boundaries are dealt out a second time."""
    frame = spark.createDataFrame(segment_rows(3), SEGMENTS).repartition(2)
    plan = S.segment_windows(frame)._jdf.queryExecution().executedPlan().toString()
    texts = [line for line in plan.split("\n") if "Exchange hashpartitioning(__key" in line]
    assert texts and not any("doc_id" in line and "seg_no" in line for line in texts)


def test_neighbours_and_contexts(spark):
    rows = [r for r in segment_rows(5) if r[0] is not None]
    frame = spark.createDataFrame(rows, SEGMENTS)
    texts = {(d, k): t for d, k, _, _, t in rows}
    for block in (1, 2, 7, 1 << 16):
        got = S.with_neighbours(frame, block_rows=block).select("doc_id", "seg_no", "text_before", "text_after").collect()
        assert sorted(map(tuple, got)) == sorted((d, k, texts.get((d, k - 1), ""), texts.get((d, k + 1), "")) for d, k in texts)
    gaps = [r for r in rows if r[1] % 5 != 2]
    for size in (1, 3, 8):
        got = S.context_windows(spark.createDataFrame(gaps, SEGMENTS), size).collect()
        blocks = {}
        for d, k, _, _, t in gaps:
            blocks.setdefault((d, k // size), []).append((k, t))
        want = sorted(
            (d, w, sorted(own), max(blocks[d, w - 1])[1] if (d, w - 1) in blocks else "", min(blocks[d, w + 1])[1] if (d, w + 1) in blocks else "")
            for (d, w), own in blocks.items()
        )
        assert sorted((r.doc_id, r.window_no, [tuple(x) for x in r.targets], r.context_before, r.context_after) for r in got) == want


def test_chapters_as_of(spark):
    """Segments of one long document, some at chapter starts and before the first chapter."""
    rng = random.Random(2)
    starts = sorted(rng.sample(range(100, 60_000), 50))
    chapters = [(1, float(a), float(b), f"c{a}") for a, b in zip(starts, [*starts[1:], 60_000])] + [(2, 0.0, 50.0, "only")]
    rows = [(1, k, float(m - 1), float(m + 1), "x") for k, m in enumerate([rng.randrange(0, 70_000) for _ in range(900)] + starts)]
    rows += [(2, 0, 10.0, 20.0, "x"), (2, 1, 40.0, 60.0, "x"), (3, 0, 1.0, 2.0, "x"), (1, 5000, None, 3.0, "x")]
    got = S.segments_in_chapters(spark.createDataFrame(rows, SEGMENTS), spark.createDataFrame(chapters, "doc_id bigint, start double, end double, title string"))
    middle = lambda r: None if r[2] is None else (r[2] + r[3]) / 2
    want = [(r[0], r[1], c[1], c[3]) for r in rows for c in chapters if middle(r) is not None and c[0] == r[0] and c[1] <= middle(r) < c[2]]
    assert sorted(map(tuple, got.select("doc_id", "seg_no", "chapter_start", "chapter_title").collect())) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_as_of_ties_and_nulls(spark):
    rows = spark.createDataFrame([(g, k) for g in (1, None) for k in range(0, 40)] + [(1, None), (9, 3)], "g int, at int")
    marks = spark.createDataFrame([(g, m, f"m{m}") for g in (1, None) for m in (3, 4, 17, 38)] + [(7, 0, "far")], "g int, m int, v string")
    for size in (1, 5, 100):
        got = O.as_of(rows, marks, ["g"], F.col("at"), "m", lambda p: O.block_of(p, size), "mark").select("g", "at", "mark.v").collect()
        last = lambda at: next((f"m{m}" for m in (38, 17, 4, 3) if at is not None and m <= at), None)
        assert sorted(map(tuple, got), key=str) == sorted([(g, k, last(k)) for g in (1, None) for k in range(40)] + [(1, None, None), (9, 3, None)], key=str)
