"""Quality classifier: boosted trees over statistics of a document's text.

Statistics are computed from whole texts in vectorised form; labels, language, source and id are never
inputs. The forest is fitted on the driver from at most about `SAMPLE_ROWS` labelled rows that are not
held out, and travels to the tasks as a few arrays.

Defined cases: a null text counts as empty; an empty text is scored like any other (its statistics are
zeros); each row gives one row; without labels of both classes the score is the same for every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import boosting
from .arrays import Texts, bounds_of, counts_of, range_hashes, slices, _BYTES
from .labelled import SAMPLE_ROWS, held_out, training_labels

_CLASSES = {
    "digit": b"0123456789", "stop": b".", "comma": b",", "bang": b"!?", "bar": b"|", "hash": b"#", "money": b"$%&*",
    "quote": b"\"'", "bracket": b"()[]{}<>", "other": b"+-/:;=@\\^_`~",
}


def _share(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def statistics(texts: Texts) -> np.ndarray:
    """One row of numbers per text."""
    data, off, n = texts.bytes, texts.offsets, texts.n
    size = np.maximum(np.diff(off), 1).astype(float)
    after_c3 = np.zeros(len(data), bool)
    after_c3[1:] = data[:-1] == 0xC3
    upper = ((data >= 65) & (data <= 90)) | (after_c3 & (data >= 0x80) & (data <= 0x9E))
    lower = ((data >= 97) & (data <= 122)) | (after_c3 & (data >= 0x9F))
    columns = [np.log1p(np.diff(off)), _share(upper, off) / size, _share(lower, off) / size, _share(data >= 128, off) / size]
    marks = np.zeros(len(data), bool)
    for members in _CLASSES.values():
        table = np.zeros(256, bool)
        table[list(members)] = True
        here = table[data]
        marks |= here
        columns.append(_share(here, off) / size)

    doc, starts, ends, hashes = texts.words()
    words = counts_of(doc, n)
    at, nw = bounds_of(doc, n), np.maximum(words, 1).astype(float)
    length = (ends - starts).astype(float)
    low_sum, mark_sum, up_sum = (np.concatenate([[0], np.cumsum(m)]) for m in (lower, marks, upper))
    no_lower = (low_sum[ends] == low_sum[starts]) & (up_sum[ends] - up_sum[starts] > 1)
    lone_mark = (mark_sum[ends] - mark_sum[starts]) == ends - starts
    many_marks = (mark_sum[ends] - mark_sum[starts]) >= 2
    mean = np.bincount(doc, weights=length, minlength=n) / nw
    spread = np.sqrt(np.maximum(np.bincount(doc, weights=length**2, minlength=n) / nw - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    again = np.zeros(len(doc), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((hashes, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    heads = np.flatnonzero(fresh)
    run = np.diff(np.append(heads, len(order)))
    most = np.zeros(n)
    np.maximum.at(most, doc[order][heads], run)
    distinct = np.bincount(doc[order][heads], minlength=n)
    by_doc = lambda mask: _share(mask, at) / nw
    columns += [
        np.log1p(words), mean, spread, np.log1p(longest), by_doc(length <= 3), by_doc(length >= 12), by_doc(upper[starts]) if len(doc) else np.zeros(n),
        by_doc(no_lower), by_doc(lone_mark), by_doc(many_marks), by_doc(again), distinct / nw, distinct / np.sqrt(nw), most / nw,
    ]

    line_doc, line_start, line_end = texts.lines()
    filled = line_end > line_start
    line_doc, line_start, line_end = line_doc[filled], line_start[filled], line_end[filled]
    nl = np.maximum(counts_of(line_doc, n), 1).astype(float)
    line_hash = range_hashes(_BYTES[data], line_start, line_end)
    order = np.lexsort((line_hash, line_doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (line_hash[order][1:] != line_hash[order][:-1]) | (line_doc[order][1:] != line_doc[order][:-1])
    line_at = bounds_of(line_doc, n)
    line_size = np.maximum(line_end - line_start, 1)
    odd = (mark_sum[line_end] - mark_sum[line_start]) / line_size > 0.12
    loud = (up_sum[line_end] - up_sum[line_start]) / line_size > 0.5
    columns += [
        np.log1p(counts_of(line_doc, n)), nw / nl, 1 - np.bincount(line_doc[order][fresh], minlength=n) / nl,
        _share(odd, line_at) / nl, _share(loud, line_at) / nl,
    ]
    return np.nan_to_num(np.stack(columns, axis=1))


def _features(df: DataFrame) -> DataFrame:
    """(key, label, x) of each row of (key, label, text)."""

    def run(batches):
        for part in slices(batches, "text"):
            x = statistics(Texts(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["key", "label", "x"])

    kind = df.schema["key"].dataType.simpleString()
    return df.mapInArrow(run, f"key {kind}, label int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> boosting.Forest:
    """Forest of the labelled sample: about `rows` ids at most, so the joined side and the result are bounded."""
    wanted = F.broadcast(training_labels(labels, key, label, rows))
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(wanted, "key")
    sample = _features(known).groupBy("key").agg(F.min("label").alias("label"), F.min("x").alias("x")).toPandas().sort_values("key")
    if not len(sample):
        return boosting.fit(np.zeros((0, 1)), np.zeros(0))
    return boosting.fit(np.stack(sample["x"].to_list()), sample["label"].to_numpy(float))


def score(docs: DataFrame, forest: boosting.Forest, text: str = "text", name: str = "score") -> DataFrame:
    """The rows of `docs`, all columns kept, with the score in `name` (which must be a new name)."""
    if name in docs.columns:
        raise ValueError(f"column {name} exists already")

    def run(batches):
        for part in slices(batches, text):
            found = forest.score(statistics(Texts(part.column(text))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], names=[*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    forest = train(docs, labels)
    return score(docs.select("doc_id", "text"), forest).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
