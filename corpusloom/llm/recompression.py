"""Repeated word windows by recompression.

A word is removed if a window of 13 consecutive words that covers it also starts in a document with a
smaller id; windows are judged on the input.

1. A text is rewritten in rounds. The first names runs of one word, the others name pairs: each round
   colours symbols by a hash of their name and joins a symbol of the first colour with a following one of
   the second. Names are hashes of what they stand for, so they are the same in every text without any
   table of names. With each symbol goes its support, the words that alone decide that it is there.
2. Every window is represented by the highest, longest symbol whose support lies inside it. That choice
   depends on the window's words alone, so equal windows anywhere have equal symbols at equal places.
   Neighbouring windows mostly share a symbol and form one record: symbol, hash of all its words, document.
3. Records meet on their symbol. Records with equal words as one in a smaller document are covered whole.
   A symbol that stands in different surroundings leaves its first records open.
4. Only the windows of open records are compared one by one, by the 64-bit hash of their words within
   that of their symbol.
5. Covered windows are united per document and the words are removed.

Long repeats thus cost a few records instead of all their windows, and no window is left out.

Defined cases: a null text has no words; a null id neither covers nor is covered; rows with one id count as
one document when ids are compared, and each is reduced on its own; texts shorter than a window stay as
they are; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..runtime import materialize
from .arrays import Texts, bounds_of, mix, range_hashes, slices
from .sides import BROADCAST_ENTRIES

WINDOW = 13
PAIR_ROUNDS = 3
_U = np.uint64
_FAR = 1 << 40
_NONE = _U(0xFFFFFFFFFFFFFFFF)


class Symbols:
    """Symbols of one slice, in order: text, name, words [start, end) and support [low, high)."""

    def __init__(self, doc, name, start, end, low, high):
        self.doc, self.name, self.start, self.end, self.low, self.high = doc, name, start, end, low, high

    def _neighbours(self):
        n = len(self.doc)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:] = self.doc[1:] == self.doc[:-1]
        after[:-1] = before[1:]
        return before, after

    def runs(self) -> Symbols:
        """Each run of one symbol becomes a symbol; to know its ends, its neighbours must be seen."""
        n = len(self.doc)
        head = np.ones(n, bool)
        head[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(head)
        last = np.append(first[1:], n) - 1
        before, after = self._neighbours()
        low = np.where(before[first], self.low[np.maximum(first - 1, 0)], -_FAR)
        high = np.where(after[last], self.high[np.minimum(last + 1, n - 1)], _FAR)
        count = (last - first + 1).astype(np.uint64)
        name = np.where(count > 1, mix(self.name[first] ^ (count * _U(0xD1B54A32D192ED03))), self.name[first])
        return Symbols(self.doc[first], name, self.start[first], self.end[last], low, high)

    def pairs(self, turn: int) -> Symbols:
        """Neighbours of first and second colour become one symbol."""
        n = len(self.doc)
        second = mix(self.name + _U(turn * 0x9E3779B97F4A7C15 % (1 << 64))) & _U(1) == 1
        before, after = self._neighbours()
        joined = np.zeros(n, bool)  # with the symbol after it
        joined[:-1] = ~second[:-1] & second[1:] & after[:-1]
        taken = np.zeros(n, bool)
        taken[1:] = joined[:-1]
        at = np.flatnonzero(~taken)
        to = at + joined[at]
        nxt, prv = np.minimum(at + 1, n - 1), np.maximum(at - 1, 0)
        pair = joined[at]
        # A symbol left alone is so because of the neighbour it did not join.
        high = np.where(pair | second[at], self.high[to], np.where(after[at], np.maximum(self.high[at], self.high[nxt]), _FAR))
        low = np.where(pair | ~second[at], self.low[at], np.where(before[at], np.minimum(self.low[at], self.low[prv]), -_FAR))
        name = np.where(pair, mix(mix(self.name[at] + _U(turn)) * _U(3) + self.name[to]), self.name[at])
        return Symbols(self.doc[at], name, self.start[at], self.end[to], low, high)


def levels(doc: np.ndarray, words: np.ndarray) -> list[Symbols]:
    """Words, runs and the pair rounds, lowest first."""
    at = np.arange(len(doc))
    found = [Symbols(doc, words, at, at + 1, at, at + 1)]
    found.append(found[0].runs())
    for turn in range(1, PAIR_ROUNDS + 1):
        found.append(found[-1].pairs(turn))
    return found


def records(doc: np.ndarray, words: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, symbol) of the records; `ends` has the end of each word's text."""
    n = len(words)
    valid = np.flatnonzero(np.arange(n) + window <= ends)
    where, symbol = np.full(n, -1), np.zeros(n, np.uint64)
    left = valid
    for level, s in reversed(list(enumerate(levels(doc, words)))):
        if not len(left):
            break
        key, low, high = np.full(n + window, _NONE), np.zeros(n + window, np.int64), np.zeros(n + window, np.int64)
        order = np.minimum(s.end - s.start, 63).astype(np.uint64)
        key[s.start] = ((_U(63) - order) << _U(58)) | (mix(s.name) >> _U(6))
        low[s.start], high[s.start] = s.low, s.high
        best, at = np.full(len(left), _NONE), np.full(len(left), -1)
        whole = len(left) == n - window + 1 and len(left) > 0
        for o in range(window):
            place = slice(o, o + len(left)) if whole else left + o
            k = key[place]
            better = (k < best) & (low[place] >= left) & (high[place] <= left + window)
            best = np.where(better, k, best)
            at = np.where(better, left + o, at)
        done = at >= 0
        name = np.zeros(n + window, np.uint64)
        name[s.start] = s.name
        where[left[done]] = at[done] * 8 + level
        symbol[left[done]] = mix(name[at[done]] + _U(level * 0xA24BAED4963EE407 % (1 << 64)))
        left = left[~done]
    if not len(valid):
        return valid, valid, symbol[:0]
    head = np.ones(len(valid), bool)
    head[1:] = (valid[1:] != valid[:-1] + 1) | (where[valid[1:]] != where[valid[:-1]])
    first = np.flatnonzero(head)
    return valid[first], np.diff(np.append(first, len(valid))), symbol[valid[first]]


def _words(part: pa.RecordBatch):
    texts = Texts(part.column("text"))
    doc, _, _, words = texts.words()
    at = bounds_of(doc, texts.n)
    return texts, doc, words, at


_ROW = "symbol bigint, content bigint, id bigint, doc_hash bigint, place int, n int, more binary"
_NAMES = ["symbol", "content", "id", "doc_hash", "place", "n", "more"]


def _records(docs: DataFrame, window: int) -> DataFrame:
    """Windows place .. place + n - 1 of a document; `more` has the other places of the same content in it."""

    def run(batches):
        for part in slices(batches, "text"):
            _, doc, words, at = _words(part)
            first, n, symbol = records(doc, words, at[1:][doc], window)
            if not len(first):
                continue
            content = range_hashes(words, first, first + n + window - 1)
            order = np.lexsort((first, content, symbol, doc[first]))
            first, n, symbol, content = first[order], n[order], symbol[order], content[order]
            own = doc[first]
            fresh = np.ones(len(first), bool)
            fresh[1:] = (own[1:] != own[:-1]) | (symbol[1:] != symbol[:-1]) | (content[1:] != content[:-1])
            head = np.flatnonzero(fresh)
            end = np.append(head[1:], len(first))
            place = (first - at[own]).astype("<i4")
            more: list = [None] * len(head)
            for k in np.flatnonzero(end - head > 1).tolist():
                more[k] = place[head[k] + 1 : end[k]].tobytes()
            texts_of = pa.array(own[head])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(symbol[head].view(np.int64)), pa.array(content[head].view(np.int64)), part.column("id").take(texts_of), part.column("doc_hash").take(texts_of),
                    pa.array(place[head]), pa.array(n[head].astype(np.int32)), pa.array(more, pa.binary()),
                ],
                names=_NAMES,
            )

    return docs.mapInArrow(run, _ROW)


def _open_windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Rows as of `_records` with one per window of the open records (n is 1)."""
    side = wanted.groupBy("id", "doc_hash").agg(F.collect_list(F.struct("place", "n", "symbol", "more")).alias("open"))

    def run(batches):
        for part in slices(batches, "text"):
            _, _, words, at = _words(part)
            entries = part.column("open")
            flat = entries.flatten()
            owner = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(entries.offsets)))
            place, n, symbol = (np.asarray(flat.field(k)).astype(np.int64) for k in range(3))
            shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(place, n) + shift
            record = np.repeat(np.arange(len(n)), n)
            owner, symbol = owner[record], symbol[record]
            others = flat.field(3).to_pylist()
            more = [o and (np.frombuffer(o, "<i4") + k).astype("<i4").tobytes() for o, k in zip([others[r] for r in record.tolist()], shift.tolist())]
            content = range_hashes(words, at[owner] + start, at[owner] + start + window)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(symbol), pa.array(content.view(np.int64)), part.column("id").take(pa.array(owner)), part.column("doc_hash").take(pa.array(owner)),
                    pa.array(start.astype(np.int32)), pa.array(np.ones(len(start), np.int32)), pa.array(more, pa.binary()),
                ],
                names=_NAMES,
            )

    joined = docs.join(side, ["id", "doc_hash"]).select("id", "doc_hash", "text", "open")
    return joined.mapInArrow(run, _ROW)


def _hashed(rows: DataFrame, key: str, text: str, repeated: DataFrame) -> DataFrame:
    """Adds `__id`, `__hash`: the hash tells the texts of a repeated id apart and is 0, which costs nothing to ship, where the id alone does."""
    rows = rows.withColumn("__id", F.col(key).cast("long"))
    n = repeated.count()
    if n > BROADCAST_ENTRIES:
        return rows.withColumn("__hash", F.xxhash64(text))
    if not n:
        return rows.withColumn("__hash", F.lit(0).cast("long"))
    again = repeated.select(F.col("id").alias("__again"))
    joined = rows.join(F.broadcast(again), F.col("__id") == F.col("__again"), "left")
    return joined.withColumn("__hash", F.when(F.col("__again").isNotNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))).drop("__again")


def _repeated_ids(docs: DataFrame, key: str) -> DataFrame:
    """The ids that more than one row has; null ids take no part."""
    ids = docs.select(F.col(key).cast("long").alias("id")).where(F.col("id").isNotNull())
    return materialize(ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("id"), "repeated-ids")


def covered_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, repeated: DataFrame | None = None) -> DataFrame:
    """(id, doc_hash, ranges): word ranges [start, end) of each document that are covered, as 32-bit pairs; ids and hashes as of `_hashed`."""
    repeated = _repeated_ids(docs, key) if repeated is None else repeated
    named = _hashed(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", repeated)
    source = named.select(F.col("__id").alias("id"), F.col("__hash").alias("doc_hash"), "text").where(F.col("id").isNotNull() & F.col("text").isNotNull())
    # One exchange: records of a symbol come together; those of equal content are neighbours in it.
    found = _records(source, window).repartition("symbol")
    same, about = W.partitionBy("symbol", "content"), W.partitionBy("symbol")
    judged = found.withColumn("earliest", F.min("id").over(same)).withColumns({"low": F.min("content").over(about), "high": F.max("content").over(about)})
    state = materialize(
        judged.where((F.col("id") > F.col("earliest")) | (F.col("low") != F.col("high")))
        .select("symbol", "id", "doc_hash", "place", "n", "more", (F.col("id") > F.col("earliest")).alias("covered")),
        "records",
    )
    windows = _open_windows(source, state.where(~F.col("covered")), window)
    single = windows.withColumn("earliest", F.min("id").over(same)).where(F.col("id") > F.col("earliest"))
    spot = ["id", "doc_hash", "place", "n", "more"]
    gone = state.where("covered").select(*spot).unionByName(single.select(*spot))
    lists = gone.groupBy("id", "doc_hash").agg(F.collect_list(F.struct("place", "n", "more")).alias("parts"))

    def unite(batches):
        for b in batches:
            out = []
            for own in b.column("parts"):
                flat = own.values
                start, n = (np.asarray(flat.field(k)).astype(np.int64) for k in range(2))
                others = [(np.frombuffer(o, "<i4").astype(np.int64), c) for o, c in zip(flat.field(2).to_pylist(), n.tolist()) if o]
                start = np.concatenate([start, *[o for o, _ in others]])
                n = np.concatenate([n, *[np.full(len(o), c) for o, c in others]])
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate(start[order] + n[order] + window - 1)
                head = np.ones(len(start), bool)
                head[1:] = start[1:] > end[:-1]
                first = np.flatnonzero(head)
                out.append(np.stack([start[first], end[np.append(first[1:], len(start)) - 1]], axis=1).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("doc_hash"), pa.array(out, pa.binary())], names=["id", "doc_hash", "ranges"])

    return materialize(lists.mapInArrow(unite, "id bigint, doc_hash bigint, ranges binary"), "ranges")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept, kept_sha256) of every row; kept joins the left words by single spaces."""
    repeated = _repeated_ids(docs, key)
    side = covered_ranges(docs, key, text, window, repeated).toDF("__id", "__hash", "ranges")
    rows = _hashed(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", repeated)
    joined = rows.join(side, ["__id", "__hash"], "left").select("key", "text", "ranges")
    kind = dict(rows.dtypes)["key"]

    def run(batches):
        for part in slices(batches, "text"):
            texts = Texts(part.column("text"))
            doc, starts, ends, _ = texts.words()
            at = bounds_of(doc, texts.n)
            raw = texts.bytes.tobytes()
            counts, lost, kept, sums = [], [], [], []
            for k, ranges in enumerate(part.column("ranges").to_pylist()):
                a, b = at[k], at[k + 1]
                keep = np.ones(b - a, bool)
                for x, y in np.frombuffer(ranges or b"", "<i4").reshape(-1, 2).tolist():
                    keep[x:y] = False
                own = b" ".join([raw[s:e] for s, e in zip(starts[a:b][keep].tolist(), ends[a:b][keep].tolist())])
                counts.append(int(b - a)), lost.append(int(b - a - keep.sum())), kept.append(own), sums.append(hashlib.sha256(own).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sums, pa.string())],
                names=["key", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    return joined.mapInArrow(run, f"key {kind}, n_words bigint, n_removed bigint, kept string, kept_sha256 string").withColumnRenamed("key", key)
