"""Toxicity: cumulative-link ordinal regression on sparse text features.

A text has a severity grade from 0 (clean) to `grades`. The model has one weight vector w shared by all
thresholds and ordered thresholds t1 < t2 < ..: P(grade >= k) = sigmoid(w.x - tk). Its output is the
expected severity, the sum of these probabilities, and `toxic` where P(grade >= 1) is at least one half.

Features are the distinct words of a text and their beginnings of 4, 5 and 6 bytes, lower-cased and
hashed; of these the ones whose presence differs most between the two labels are kept. Training labels
are 0 or 1; labelled toxic texts are graded by how many distinct indicative features they hold, in equal parts. Everything is fitted on a sample of at most about `SAMPLE_ROWS` labelled rows.

Defined cases: a null text counts as empty; a text without words scores the intercept alone; each row
gives one row; without labels of both classes nothing is toxic and the severity is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import Texts, _BYTES, range_hashes, separators, slices
from .labelled import SAMPLE_ROWS, held_out, training_labels

SLOT_BITS = 22
BEGINNINGS = (4, 5, 6)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# A word is a run of ASCII letters and digits and of bytes beyond ASCII.
_NOT_WORD = separators(b for b in range(128) if not chr(b).isalnum())


@dataclass(frozen=True)
class Ordinal:
    slots: np.ndarray  # sorted feature slots
    weights: np.ndarray
    cuts: np.ndarray  # ordered thresholds, one per grade

    def margins(self, n: int, doc: np.ndarray, feature: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=self.weights[feature], minlength=n)

    def expected(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(grade >= 1), expected severity)."""
        if not len(self.cuts):
            return np.zeros(len(margins)), np.zeros(len(margins))
        above = 1 / (1 + np.exp(-np.clip(margins[:, None] - self.cuts, -40, 40)))
        return above[:, 0], above.sum(axis=1)


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, slot, count) of each distinct feature of each text, and the words per text."""
    lowered = Texts.__new__(Texts)
    lowered.bytes, lowered.offsets, lowered.n = _LOWER[texts.bytes], texts.offsets, texts.n
    doc, starts, ends = lowered.pieces(_NOT_WORD)
    values = _BYTES[lowered.bytes]
    docs, slots = [doc], [range_hashes(values, starts, ends)]
    for k in BEGINNINGS:
        long = ends - starts > k
        docs.append(doc[long])
        slots.append(range_hashes(values, starts[long], starts[long] + k) ^ np.uint64(k))
    mask = np.uint64((1 << SLOT_BITS) - 1)
    packed = (np.concatenate(docs).astype(np.uint64) << np.uint64(SLOT_BITS)) | (np.concatenate(slots) & mask)
    distinct, counts = np.unique(packed, return_counts=True)
    return (distinct >> np.uint64(SLOT_BITS)).astype(np.int64), (distinct & mask).astype(np.int64), counts, np.bincount(doc, minlength=texts.n)


def _select(doc: np.ndarray, slot: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Slots whose presence depends most on the label (chi-square with one degree of freedom)."""
    found, index = np.unique(slot, return_inverse=True)
    in_toxic = np.bincount(index, weights=y[doc], minlength=len(found))
    seen = np.bincount(index, minlength=len(found)).astype(float)
    n, p = len(y), y.mean()
    chi = (in_toxic - seen * p) ** 2 / np.maximum(seen * p * (1 - p) * (1 - seen / (n + 1)), 1e-9)
    strong = np.flatnonzero((chi > 12) & (seen >= 3))
    return np.sort(found[strong[np.argsort(-chi[strong], kind="stable")[:most]]])


def _lookup(slots: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(slots, slot), max(0, len(slots) - 1))
    known = slots[at] == slot if len(slots) else np.zeros(len(slot), bool)
    return np.flatnonzero(known), at[known]


def fit(doc: np.ndarray, slot: np.ndarray, count: np.ndarray, n_words: np.ndarray, y: np.ndarray, grades: int = 3, most: int = 8192, steps: int = 400, ridge: float = 2e-5) -> Ordinal:
    """Model of labelled texts; feature arrays as `features` returns them."""
    if not len(y) or y.min() == y.max():
        return Ordinal(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    slots = _select(doc, slot, y, most)
    rows, col = _lookup(slots, slot)
    doc, count = doc[rows], count[rows]
    n, d = len(y), len(slots)
    base = y.mean()
    lift = (np.bincount(col, weights=y[doc], minlength=d) + base) / (np.bincount(col, minlength=d) + 1) > 2 * base
    signs = np.bincount(doc, weights=lift[col].astype(float), minlength=n)
    grade = np.zeros(n, int)
    toxic = np.flatnonzero(y == 1)
    grade[toxic[np.argsort(signs[toxic], kind="stable")]] = 1 + np.arange(len(toxic)) * grades // len(toxic)
    above = (grade[:, None] > np.arange(grades)).astype(float)
    # Parameters: weights, first threshold, logarithms of the gaps to the next ones. Adam steps.
    x = np.concatenate([np.zeros(d), [2.0], np.full(grades - 1, 0.0)])
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, gaps = x[:d], np.exp(x[d + 1 :])
        cuts = x[d] + np.concatenate([[0], np.cumsum(gaps)])
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, weights=w[col], minlength=n)[:, None] - cuts, -40, 40)))
        # Likelihood of the grade as a difference of neighbouring probabilities.
        top, bottom = np.ones(n), np.zeros(n)
        has = grade > 0
        top[has] = p[np.flatnonzero(has), grade[has] - 1]
        more = grade < grades
        bottom[more] = p[np.flatnonzero(more), grade[more]]
        like = np.maximum(top - bottom, 1e-12)
        slope_top, slope_bottom = top * (1 - top) / like, bottom * (1 - bottom) / like
        by_margin = -(slope_top - slope_bottom) / n
        g_cut = np.zeros(grades)
        np.add.at(g_cut, grade[has] - 1, slope_top[has] / n)
        np.add.at(g_cut, grade[more], -slope_bottom[more] / n)
        later = g_cut[::-1].cumsum()[::-1]
        g = np.concatenate([np.bincount(col, weights=by_margin[doc], minlength=d) + ridge * w, [later[0]], later[1:] * gaps])
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        x = x - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Ordinal(slots, x[:d], x[d] + np.concatenate([[0], np.cumsum(np.exp(x[d + 1 :]))]))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Ordinal:
    """Model of the labelled sample: about `rows` ids at most; only their features come to the driver.

    Features are first counted per label in Spark, so that the driver gets the candidate slots and, per
    sampled text, only those of its features that are candidates.
    """
    wanted = F.broadcast(training_labels(labels, key, label, rows))
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(wanted, "key")

    def run(batches):
        for part in slices(batches, "text"):
            doc, slot, count, n_words = features(Texts(part.column("text")))
            cut = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = lambda v, kind: pa.ListArray.from_arrays(pa.array(cut), pa.array(v, kind))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("label"), pa.array(n_words, pa.int64()), lists(slot, pa.int32()), lists(count, pa.int32())],
                names=["key", "label", "n_words", "slots", "counts"],
            )

    kind = known.schema["key"].dataType.simpleString()
    found = known.mapInArrow(run, f"key {kind}, label int, n_words bigint, slots array<int>, counts array<int>")
    sample = found.groupBy("key").agg(F.min(F.struct("label", "n_words", "slots", "counts")).alias("r")).select("key", "r.*")
    sample = sample.persist()
    try:
        n, toxic = sample.agg(F.count("key"), F.sum("label")).first()
        if not n or not toxic or toxic == n:
            return Ordinal(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        each = sample.select("label", F.explode("slots").alias("slot")).groupBy("slot").agg(F.sum("label").alias("a"), F.count("slot").alias("c"))
        p = toxic / n
        chi = F.pow(F.col("a") - F.col("c") * p, 2) / (F.col("c") * p * (1 - p))
        candidates = each.where((F.col("c") >= 3) & (chi > 12)).orderBy(chi.desc(), "slot").limit(1 << 14).select("slot").toPandas()["slot"].to_numpy(np.int32)
        rows_ = _kept(sample, np.sort(candidates)).toPandas().sort_values("key")
    finally:
        sample.unpersist()
    sizes = rows_["slots"].map(len).to_numpy()
    doc = np.repeat(np.arange(len(rows_)), sizes)
    flat = lambda c: np.concatenate(rows_[c].to_list()) if sizes.sum() else np.zeros(0, np.int64)
    return fit(doc, flat("slots"), flat("counts"), rows_["n_words"].to_numpy(), rows_["label"].to_numpy(float))


def _kept(sample: DataFrame, slots: np.ndarray) -> DataFrame:
    """The sampled texts with those of their features that are in `slots`."""

    def run(batches):
        for b in batches:
            lists = [b.column("slots"), b.column("counts")]
            cut = np.concatenate([[0], np.cumsum([len(x) for x in lists[0]])])
            flat = [np.asarray(x.flatten()) for x in lists]
            keep, _ = _lookup(slots, flat[0])
            ends = np.searchsorted(keep, cut).astype(np.int32)
            out = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[keep], pa.int32())) for x in flat]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("label"), b.column("n_words"), *out], names=b.schema.names)

    return sample.mapInArrow(run, sample.schema)


def severities(docs: DataFrame, model: Ordinal, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, toxic_probability, severity (0 to the number of grades) and toxic (0 or 1) of every text."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for part in slices(batches, "text"):
            doc, slot, _, _ = features(Texts(part.column("text")))
            rows, col = _lookup(model.slots, slot)
            p, severity = model.expected(model.margins(part.num_rows, doc[rows], col))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(p), pa.array(severity), pa.array((p >= 0.5).astype(np.int32))], names=["key", "toxic_probability", "severity", "toxic"]
            )

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, toxic_probability double, severity double, toxic int").withColumnRenamed("key", key)


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = severities(docs, train(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "toxic_probability", "severity", "toxic")
