"""Hard negatives by angular triangle filtering.

For every anchor the nearest rows of its own label are positives; for each of them the nearest rows of other
labels whose score lies between a share of the positive's score and that score are its hard negatives. Scores
are integer inner products of components floor(256 x).

1. A bounded sample gives reference directions. Every row is stored with its integer components, its norm and
   its angles to the references.
2. Anchors meet all rows in blocks of bounded size, one pair of blocks a group. Inside a block, rows are sorted
   by nearest reference and angle to it and cut into windows of a few rows, so a window has narrow ranges of
   angles and norms.
3. For anchor a, window W and any reference r the triangle inequality on the sphere keeps the angle between a
   and each row of W within [|angle(a, r) - angle(W, r)|, angle(a, r) + angle(W, r)], reflected at pi. The best
   of these over all references gives an interval of the cosine, times the norms an interval of the score,
   rounded outwards past every rounding error.
4. Only windows whose interval overlaps what an anchor still looks for are scored, in exact integers: for
   positives, more than its fifth best so far; for negatives, the bands below its positives.
5. The blocks' best are ranked per anchor, again with a limit before the exchange.

The filter only skips, so results are exact whatever the references are. Products are computed on doubles where
norms prove that every sum stays below 2**53, else on 64-bit integers.

Defined cases: rows with a null id, a null label, a null vector or a null or non-finite component take no part;
nor do rows whose integer components have a squared norm of 2**62 or more, whose scores could pass 64 bits; zero
vectors do take part, an empty one does not; an id that repeats keeps its least row; only vectors of equal length
meet; ties go to the smaller id; a positive without a negative in its band gives no row; extra columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..runtime import materialize
from .vectors import matrix

REFERENCES = 24
SAMPLE_ROWS = 4096
SCALE = 256
# Bytes of integer components in a block of anchors and in one of rows.
ANCHOR_BYTES, ROW_BYTES = 1 << 20, 8 << 20
WINDOW = 64
# Angles of doubles come out within 1e-7 where the cosine is near 1, and far closer elsewhere.
ANGLE_SLACK = 1e-6


def angles(x: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to unit directions; a zero vector is put at right angles."""
    x = x.astype(float)
    norm = np.sqrt((x * x).sum(axis=1))
    cosine = x @ references.T / np.where(norm == 0, 1, norm)[:, None]
    return norm, np.arccos(np.clip(cosine, -1, 1))


def references_of(sample: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit directions spread over the sample: each next one is farthest from those before it."""
    x = sample.astype(float)
    norm = np.sqrt((x * x).sum(axis=1))
    x = x[norm > 0] / norm[norm > 0][:, None]
    if not len(x):
        return np.eye(1, sample.shape[1])
    picked = [0]
    near = x @ x[0]
    while len(picked) < min(count, len(x)):
        nxt = int(near.argmin())
        if near[nxt] > 1 - 1e-12:
            break
        picked.append(nxt)
        near = np.maximum(near, x @ x[nxt])
    return x[picked]


class Rows:
    """A block of rows in windows of neighbouring angles, with the ranges that bound every score of a window."""

    def __init__(self, ids, labels, codes, norms, angle, window: int = WINDOW):
        nearest = angle.argmin(axis=1)
        order = np.lexsort((ids, angle[np.arange(len(ids)), nearest], nearest))
        self.ids, self.labels, self.codes, self.norms = ids[order], labels[order], codes[order], norms[order]
        angle = angle[order]
        self.starts = np.arange(0, len(ids), window)
        self.ends = np.append(self.starts[1:], len(ids))
        self.low, self.high = (f.reduceat(angle, self.starts, axis=0) for f in (np.minimum, np.maximum))
        self.least, self.most = (f.reduceat(self.norms, self.starts) for f in (np.minimum, np.maximum))

    def bounds(self, norm: float, angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that a row of each window can have with one anchor."""
        near = np.maximum(self.low - angle, angle - self.high).max(axis=1) - ANGLE_SLACK
        far = np.minimum(angle + self.high, 2 * np.pi - angle - self.low).min(axis=1) + ANGLE_SLACK
        top, bottom = np.cos(np.clip(near, 0, np.pi)), np.cos(np.clip(far, 0, np.pi))
        slack = 1e-9 * norm * self.most + 1
        high = norm * top * np.where(top >= 0, self.most, self.least)
        low = norm * bottom * np.where(bottom >= 0, self.least, self.most)
        return np.floor(low - slack), np.ceil(high + slack)

    def scores(self, code: np.ndarray, norm: float, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, exact scores) of all rows of these windows."""
        size = self.ends[windows] - self.starts[windows]
        rows = np.repeat(self.starts[windows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        exact = np.float64 if norm * self.most.max(initial=0) < 2.0**52 else np.int64
        return rows, (self.codes[rows].astype(exact) @ code.astype(exact)).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties by smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def nearest_same(rows: Rows, anchor: int, label: int, code, norm, angle, k: int) -> list[tuple[int, int]]:
    """(id, score) of an anchor's k best rows of its label; windows are scored from the most promising on."""
    _, high = rows.bounds(norm, angle)
    order = np.argsort(-high, kind="stable")
    ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, step = 0, 4
    while at < len(order):
        if len(scores) == k and high[order[at]] < scores[-1]:
            break
        found, own = rows.scores(code, norm, order[at : at + step])
        fit = (rows.labels[found] == label) & (rows.ids[found] != anchor)
        ids, scores = np.concatenate([ids, rows.ids[found[fit]]]), np.concatenate([scores, own[fit]])
        keep = best(scores, ids, k)
        ids, scores = ids[keep], scores[keep]
        at, step = at + step, step * 2
    return list(zip(ids.tolist(), scores.tolist()))


def band(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole scores n with low * p <= 100 n <= high * p."""
    exact = [(-(-low * p // 100), high * p // 100) for p in positive.tolist()]
    return np.array([a for a, _ in exact], np.int64), np.array([b for _, b in exact], np.int64)


def negatives_below(rows: Rows, label: int, code, norm, angle, positives: np.ndarray, k: int, low: int, high: int) -> list[tuple[int, int, int]]:
    """(number of the positive, id, score): the k best rows of other labels in the band of each positive."""
    floor, top = band(positives, low, high)
    open_ = np.flatnonzero(floor <= top)
    if not len(open_):
        return []
    least, most = rows.bounds(norm, angle)
    wanted = np.zeros(len(least), bool)
    for p in open_:
        wanted |= (most >= floor[p]) & (least <= top[p])
    found, scores = rows.scores(code, norm, np.flatnonzero(wanted))
    fit = (rows.labels[found] != label) & (scores >= floor[open_].min()) & (scores <= top[open_].max())
    ids, scores = rows.ids[found[fit]], scores[fit]
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    out = []
    for p in open_.tolist():
        at = int(np.searchsorted(-scores, -top[p], side="left"))
        for i, s in zip(ids[at : at + k].tolist(), scores[at : at + k].tolist()):
            if s >= floor[p]:
                out.append((p, i, s))
    return out


def prepared(df: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(id, label, dim, code) of the rows that take part, code holding the whole components."""
    rows = df.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.floor(x * SCALE).cast("double") * F.floor(x * SCALE).cast("double"))
    small = F.forall("v", lambda x: F.abs(x) < F.lit(float(1 << 31) / SCALE)) & (square < F.lit(float(1 << 62)))
    kept = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.coalesce(fine, F.lit(False))).where(small)
    one = kept.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row"))
    code = F.transform(F.col("row.v"), lambda x: F.floor(x * SCALE).cast("int"))
    return one.select("id", F.col("row.label").alias("label"), F.size("row.v").alias("dim"), code.alias("code"))


def _with_angles(rows: DataFrame) -> DataFrame:
    """Adds norm and angles to the references of the row's length."""
    picked = rows.where(F.col("id").isNotNull()).orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS).select("dim", "code").toArrow()
    dims = picked.column("dim").to_numpy()
    directions = {}
    for dim in np.unique(dims).tolist():
        directions[dim] = references_of(matrix(picked.filter(pa.array(dims == dim)).column("code"), dim))
    shared = rows.sparkSession.sparkContext.broadcast(directions)

    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                # A length that the sample lacks gets an axis.
                norm, angle = angles(matrix(part.column("code"), dim), shared.value.get(dim, np.eye(1, dim)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(norm), pa.ListArray.from_arrays(pa.array(np.arange(len(norm) + 1, dtype=np.int32) * angle.shape[1]), pa.array(angle.ravel()))],
                    names=[*part.schema.names, "norm", "angle"],
                )

    return rows.mapInArrow(run, "id bigint, label bigint, dim int, code array<int>, norm double, angle array<double>")


def _met(rows: DataFrame, anchors: DataFrame, group: list[str], work, schema: str) -> DataFrame:
    """Anchors against all rows of their group, in pairs of blocks: `work(anchor columns, Rows)` gives a table."""
    side = rows.groupBy(*group).agg(F.count("id").alias("n_r"))
    asked = anchors.groupBy(*group).agg(F.count("id").alias("n_a"))
    blocks = side.join(asked, group).select(
        *group, F.ceil(F.col("n_a") * F.col("dim") * 4 / ANCHOR_BYTES).cast("int").alias("a_blocks"), F.ceil(F.col("n_r") * F.col("dim") * 4 / ROW_BYTES).cast("int").alias("r_blocks")
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = anchors.join(blocks, group).withColumns({"ab": own("a_blocks"), "rb": every("r_blocks")}).drop("a_blocks", "r_blocks")
    right = rows.join(blocks, group).withColumns({"ab": every("a_blocks"), "rb": own("r_blocks")}).drop("a_blocks", "r_blocks")
    keys = [*group, "ab", "rb"]

    def pair(a: pa.Table, r: pa.Table) -> pa.Table:
        if not a.num_rows or not r.num_rows:
            return work(a, None)
        dim, width = r.column("dim")[0].as_py(), len(r.column("angle")[0])
        held = Rows(
            r.column("id").to_numpy(), r.column("label").to_numpy(), matrix(r.column("code"), dim), r.column("norm").to_numpy(), matrix(r.column("angle"), width)
        )
        return work(a, held)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pair, schema)


def _each_anchor(a: pa.Table):
    dim, width = a.column("dim")[0].as_py(), len(a.column("angle")[0])
    return zip(a.column("id").to_pylist(), a.column("label").to_pylist(), matrix(a.column("code"), dim), a.column("norm").to_pylist(), matrix(a.column("angle"), width))


def positives(rows: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): each anchor's k best rows of its own label."""
    names = ["anchor_id", "positive_id", "positive_score"]

    def work(a: pa.Table, held: Rows | None) -> pa.Table:
        found = [] if held is None else [(i, j, s) for i, label, code, norm, angle in _each_anchor(a) for j, s in nearest_same(held, i, label, code, norm, angle, k)]
        return pa.table([pa.array([x[n] for x in found], pa.int64()) for n in range(3)], names=names)

    found = _met(rows, anchors, ["dim", "label"], work, ", ".join(f"{n} bigint" for n in names))
    order = W.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    return found.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k).drop("__rank")


def hard_negatives(
    df: DataFrame, is_anchor: Column, label: Column, key: str = "vec_id", vector: str = "embedding",
    positives_each: int = 5, negatives_each: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), scores in the band of `low` to `high` percent.

    `is_anchor` and `label` are written over the columns of `df`.
    """
    rows = materialize(_with_angles(prepared(df, key, vector, label)), "angled-rows")
    chosen = df.where(is_anchor).select(F.col(key).cast("long").alias("id")).distinct()
    anchors = materialize(rows.join(chosen, "id", "left_semi"), "anchors")
    found = materialize(positives(rows, anchors, positives_each), "positives")
    targets = found.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("targets"))
    names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]

    def work(a: pa.Table, held: Rows | None) -> pa.Table:
        out = []
        if held is not None:
            for (i, own, code, norm, angle), asked in zip(_each_anchor(a), a.column("targets").to_pylist()):
                scores = np.array([x["positive_score"] for x in asked], np.int64)
                for p, j, s in negatives_below(held, own, code, norm, angle, scores, negatives_each, low, high):
                    out.append((i, asked[p]["positive_id"], j, asked[p]["positive_score"], s))
        return pa.table([pa.array([x[n] for x in out], pa.int64()) for n in range(5)], names=names)

    met = _met(rows, anchors.join(targets, "id"), ["dim"], work, ", ".join(f"{n} bigint" for n in names))
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives_each)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
