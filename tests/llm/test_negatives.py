import math
import random

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from corpusloom.llm import hard_negatives as hn

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    *[T.StructField(n, T.StringType()) for n in ("id", "dim", "code", "norm", "angle", "rank", "targets", "row")],
])


def table(spark, rows):
    return spark.createDataFrame([(*r, *"x" * 8) for r in rows], SCHEMA).repartition(3)


def found(spark, rows):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hn.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, label).collect())


def brute(rows):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        entry = (label, [float(np.float32(x)) for x in v])
        kept[i] = min(kept.get(i, entry), entry)
    codes = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in kept.items()}
    out = []
    for a, (own, x) in codes.items():
        if a % 10:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, label) for i, (label, y) in codes.items() if i != a and len(y) == len(x))
        for ps, p in [(-s, i) for s, i, label in scored if label == own][:5]:
            fit = [(-s, i) for s, i, label in scored if label != own and 80 * ps <= -100 * s <= 100 * ps][:5]
            out += [(a, p, rank, i, ps, s) for rank, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def made(seed, n=300, dim=6, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = []
    for i in range(n):
        v = (centres[i % 5] + rng.normal(size=dim) * 0.4).tolist()
        rows.append((i, v, int(rng.integers(labels)) if i % 3 else 0))
    return rows


def test_matches_brute_force(spark, monkeypatch):
    for seed, blocks in ((1, None), (2, 400)):
        if blocks:
            monkeypatch.setattr(hn, "ANCHOR_BYTES", blocks)
            monkeypatch.setattr(hn, "ROW_BYTES", 4 * blocks)
            monkeypatch.setattr(hn, "WINDOW", 8)
        rows = made(seed)
        answer = brute(rows)
        assert len(answer) > 50 and found(spark, rows) == answer


def test_odd_rows(spark):
    rows = made(3, n=60, dim=3)
    rows += [
        (100, None, 1), (110, [1.0, None, 2.0], 1), (120, [float("nan"), 0.0, 1.0], 2), (130, [float("inf"), 0.0, 1.0], 2), (140, [], 2), (150, [1.0, 2.0, 3.0], None),
        (None, [1.0, 2.0, 3.0], 1), (160, [0.0, 0.0, 0.0], 1), (161, [0.0, 0.0, 0.0], 2), (170, [1.0, 2.0], 1), (171, [1.0, 2.0], 2), (172, [1.0, 2.0], 1),
        (180, [-1.0, -1.0, -1.0], 9), (181, [1.0, 1.0, 1.0], 9), (20, [9.0, 9.0, 9.0], 0), (20, [9.0, 9.0, 9.0], 0),
    ] + [(200 + k, [0.5, 0.25, 0.125], k % 3) for k in range(40)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(10, [1.0], 1)]) == []
    assert found(spark, [(10, [1e30], 1), (11, [2.0], 1), (12, [1.0], 2)]) == []


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 5), st.sampled_from([1, 40, 5000]))
def test_bounds_hold(seed, dim, size):
    """Every score lies within the bounds of its window, for equal, opposite and zero vectors too."""
    rng = np.random.default_rng(seed)
    codes = rng.integers(-size, size + 1, (50, dim)).astype(np.int32)
    codes[:3], codes[3:5] = codes[5], -codes[5]
    codes[6] = 0
    norm, angle = hn.angles(codes, hn.references_of(codes[rng.permutation(50)[:20]], 6))
    rows = hn.Rows(np.arange(50), np.zeros(50, np.int64), codes, norm, angle, window=4)
    for i in range(50):
        low, high = rows.bounds(norm[i], angle[i])
        at, scores = rows.scores(codes[i], norm[i], np.arange(len(low)))
        assert (scores == codes.astype(np.int64)[rows.ids[at]] @ codes[i].astype(np.int64)).all()
        assert (low[at // 4] <= scores).all() and (scores <= high[at // 4]).all()


def test_large_scores_are_exact():
    codes = np.array([[2**30, 1, 0], [2**30, -1, 3], [3, 5, 2**20]], np.int32)
    norm, angle = hn.angles(codes, np.eye(3))
    rows = hn.Rows(np.arange(3), np.zeros(3, np.int64), codes, norm, angle)
    at, scores = rows.scores(codes[0], norm[0], np.array([0]))
    assert dict(zip(rows.ids[at].tolist(), scores.tolist())) == {0: 2**60 + 1, 1: 2**60 - 1, 2: 3 * 2**30 + 5}
    assert hn.band(np.array([7, -5, 0]), 80, 100)[0].tolist() == [6, -4, 0] and hn.band(np.array([7, -5, 0]), 80, 100)[1].tolist() == [7, -5, 0]


def test_windows_are_skipped():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 16)) * 300
    codes = np.concatenate([c + rng.normal(size=(200, 16)) * 8 for c in centres]).astype(np.int32)
    norm, angle = hn.angles(codes, hn.references_of(codes[:: 16]))
    rows = hn.Rows(np.arange(1600), np.repeat(np.arange(8), 200), codes, norm, angle)
    _, high = rows.bounds(norm[0], angle[0])
    assert (high >= 0.8 * norm[0] ** 2).mean() < 0.3
