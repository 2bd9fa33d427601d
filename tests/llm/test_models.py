import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import boosting, quality, toxicity
from corpusloom.llm.arrays import Texts
from corpusloom.llm.queries import op4, op9

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas().set_index("doc_id")


def test_quality_on_held_out_labels(spark, labels):
    found = op4(spark, FOLDER).toPandas().set_index("doc_id")
    assert len(found) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.3)).all()
    held = found.join(labels, how="inner")
    held = held[held.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert held[held.quality == 1].predicted.mean() > 0.98  # clean documents stay


def test_toxicity_on_held_out_labels(spark, labels):
    found = op9(spark, FOLDER).toPandas().set_index("doc_id")
    both = found.join(labels.rename(columns={"toxic": "truth"}), how="inner")
    held = both[both.held_out]
    assert held[held.truth == 0].toxic.mean() < 0.02
    assert held[held.truth == 1].severity.mean() > held[held.truth == 0].severity.mean() + 0.3
    assert found.severity.between(0, 3).all()
    assert held[held.truth == 1].toxic.mean() > 0.9


def plain_statistics(text):
    """The statistics of one text, character by character; those outside ASCII count as bytes."""
    raw = (text or "").encode()
    n = len(raw)
    size = max(n, 1)
    upper = [65 <= b <= 90 or (k > 0 and raw[k - 1] == 0xC3 and 0x80 <= b <= 0x9E) for k, b in enumerate(raw)]
    lower = [97 <= b <= 122 or (k > 0 and raw[k - 1] == 0xC3 and b >= 0x9F) for k, b in enumerate(raw)]
    marks = [any(b in m for m in quality._CLASSES.values()) for b in raw]
    out = [math.log1p(n), sum(upper) / size, sum(lower) / size, sum(b >= 128 for b in raw) / size]
    out += [sum(b in m for b in raw) / size for m in quality._CLASSES.values()]
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    own = [raw[a:b] for a, b in words]
    nw = max(len(own), 1)
    sizes = [len(w) for w in own]
    mean = sum(sizes) / nw
    count = Counter(own)
    share = lambda ok: sum(map(ok, words)) / nw
    inside = lambda mask, w: sum(mask[w[0] : w[1]])
    out += [
        math.log1p(len(own)), mean, math.sqrt(max(sum(x * x for x in sizes) / nw - mean**2, 0)), math.log1p(max(sizes, default=0)),
        share(lambda w: w[1] - w[0] <= 3), share(lambda w: w[1] - w[0] >= 12), share(lambda w: upper[w[0]]),
        share(lambda w: not inside(lower, w) and inside(upper, w) > 1), share(lambda w: inside(marks, w) == w[1] - w[0]), share(lambda w: inside(marks, w) >= 2),
        sum(a == b for a, b in zip(own, own[1:])) / nw, len(count) / nw, len(count) / math.sqrt(nw), max(count.values(), default=0) / nw,
    ]
    lines, at = [], 0
    for line in raw.split(b"\n"):
        if line:
            lines.append((at, at + len(line)))
        at += len(line) + 1
    nl = max(len(lines), 1)
    over = lambda mask, limit: sum(inside(mask, x) / (x[1] - x[0]) > limit for x in lines) / nl
    return [*out, math.log1p(len(lines)), nw / nl, 1 - len({raw[a:b] for a, b in lines}) / nl, over(marks, 0.12), over(upper, 0.5)]


def walk(forest, row):
    total = forest.start
    for f, c, v in zip(forest.feature, forest.cut, forest.value):
        node = 0
        for _ in range(forest.depth):
            node = 2 * node + (2 if row[f[node]] > c[node] else 1)
        total += v[node - (2**forest.depth - 1)]
    return 1 / (1 + math.exp(-min(30, max(-30, total))))


def test_quality_query_matches_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    forest = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for text in [*list(texts.values())[:50], "", "É à\nÉ à\n\n!!", "\t"]:
        got = quality.statistics(Texts(pa.array([text])))[0]
        assert np.allclose(got, plain_statistics(text), atol=1e-9)
    for r in op4(spark, folder).collect():
        assert abs(r["score"] - walk(forest, plain_statistics(texts[r["doc_id"]]))) < 1e-6
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3)


def test_forest_equals_a_walk_through_each_tree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    forest = boosting.fit(x, y, trees=20)
    assert np.allclose(forest.score(x), [walk(forest, row) for row in x])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95


def test_ordinal_recovers_ordered_grades():
    rng = np.random.default_rng(2)
    n, d = 3000, 12
    has = rng.random((n, d)) < 0.2
    y = (has[:, :4].sum(axis=1) > 0).astype(float)
    doc, slot = np.nonzero(has)
    model = toxicity.fit(doc, slot, np.ones(len(doc), int), np.full(n, d), y)
    assert (np.diff(model.cuts) > 0).all()
    rows, col = toxicity._lookup(model.slots, slot)
    p, severity = model.expected(model.margins(n, doc[rows], col))
    assert ((p >= 0.5) == y).mean() > 0.98
    assert np.corrcoef(severity, has[:, :4].sum(axis=1))[0, 1] > 0.9


def test_odd_rows(spark, make_docs):
    docs = make_docs([(1, "good words here"), (1, "good words here"), (2, None), (3, ""), (None, "moron"), (4, "word " * 200_000), (5, "\n\n\n")])
    few = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    empty = few.limit(0)
    for label in (few, empty):
        scored = quality.scored(docs, label).collect()
        graded = toxicity.graded(docs, label).collect()
        assert len(scored) == len(graded) == 7
        assert all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in quality.scored(docs, empty).collect()}) == 1
    assert all(r["severity"] == 0 and r["toxic"] == 0 for r in toxicity.graded(docs, empty).collect())
    assert quality.scored(make_docs([]), few).collect() == [] and toxicity.graded(make_docs([]), few).collect() == []
    kept = quality.score(docs, boosting.fit(np.zeros((0, 1)), np.zeros(0)), name="__s")
    assert kept.columns == [*docs.columns, "__s"]
    with pytest.raises(ValueError):
        quality.score(docs, boosting.fit(np.zeros((0, 1)), np.zeros(0)), name="score")
