"""Line deduplication by an exact set-similarity join.

A line is the set of its words. A line goes if an earlier one, by (document id, line number), has a Jaccard
similarity of at least `similarity`; lines are judged on the input, not on what is left.

1. Word counts of the whole corpus go into a table of a fixed number of slots. It only orders words by
   rarity, so slots shared by several words cost speed, never results.
2. Every line's words are ordered by rarity. Equal sets form one class, whose first line stands for it.
3. Two sets can only be similar if they share a word among the first s - ceil(t s) + 1 of each (prefix
   filter). First lines meet on these words, and length, the positions of the shared word, and parity
   maps of the sets (64 bits, 128 for large sets) bound the overlap from above; pairs that cannot reach
   the threshold go.
4. One earlier line is enough to remove a line, so pairs are no result. In rounds, each line that is still
   asking takes the earliest lines it may resemble, a few per word and more with every round, and is verified
   against them on the full sets. A line that found one asks no more, but stays as what others may resemble.
   Lines ask until they have met all they may resemble: nothing is left out, and a large group of near copies
   costs each of its lines about one comparison.

Words that stand in very many lines get their lines cut into blocks (see bundles); whether a word may be
one of them is known from the slot counts, so only those few are counted exactly.

Defined cases: lines without words never match and stay; a null text stays null; rows with a null id stay
as they are; rows of a repeated id are decided line number by line number and are not earlier than each
other at the same number; a document left without words although it had some is dropped by `deduplicated`;
extra columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialize
from .arrays import Texts, bounds_of, mix, range_hashes, slices, spans_to_list
from .bundles import bundles, in_blocks
from .sides import narrow_side

SIMILARITY = 0.8
SLOT_BITS = 20
SLOT_BLOCK = 1 << 14
# A word counted more often than this may have a long list of lines; those lists are counted and cut.
LONG_LIST = 4096
# Fewer lines than this, their numbers fit a 64-bit sort key beside rarity and the low 36 bits of a word.
PACKED_LINES = 1 << 20
# Sets of so many words have a parity map of 128 bits: one of 64 tells sets of more than a hundred words hardly apart.
WIDE_MAP = 48
# A line meets so many of the lines it may resemble per word in the first round, and times as many in each next one.
FIRST_ROUND, NEXT_ROUND = 8, 64
_U = np.uint64
_LOW36 = _U((1 << 36) - 1)


def _packed_counts(counts: np.ndarray) -> bytes:
    """Counts by byte places, so that the places most counts do not use cost nothing."""
    return zlib.compress(np.ascontiguousarray(counts.view(np.uint8).reshape(-1, 8).T), 1)


def _counts_of(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T).view(np.int64)[:, 0]


def word_slots(docs: DataFrame) -> np.ndarray:
    """Counts of words per slot over the whole corpus; 2**SLOT_BITS numbers whatever the corpus.

    Tasks give their counts in blocks of slots, which are added up block by block.
    """
    kind = "block int, counts binary"

    def rows(blocks):
        for k, counts in blocks:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed_counts(counts)], pa.binary())], names=["block", "counts"])

    def count(batches):
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for part in slices(batches, "text"):
            np.add.at(total, (Texts(part.column("text")).words()[3] >> _U(64 - SLOT_BITS)).astype(np.int64), 1)
        yield from rows((k, own) for k, own in enumerate(total.reshape(-1, SLOT_BLOCK)) if own.any())

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column("block").to_pylist(), batch.column("counts")):
                total[k] = total.get(k, 0) + _counts_of(packed.as_buffer())
        yield from rows(total.items())

    found = docs.select("text").mapInArrow(count, kind).repartition("block").mapInArrow(add, kind).toArrow()
    counts = np.zeros(1 << SLOT_BITS, np.int64).reshape(-1, SLOT_BLOCK)
    for k, packed in zip(found.column("block").to_pylist(), found.column("counts").to_pylist()):
        counts[k] = _counts_of(packed)
    return counts.reshape(-1)


def line_sets(texts: Texts, rarity: np.ndarray, packed: int = PACKED_LINES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, line number, offsets, words) of the lines that have words; words by rarity, low 36 bits and value, without repeats.

    The order is the same for all slices: the prefix filter and the hashes of the sets need one order of the words.
    """
    _, starts, _, words = texts.words()
    line_doc, line_start, _ = texts.lines()
    line = np.searchsorted(line_start, starts, side="right") - 1
    number = np.arange(len(line_doc)) - bounds_of(line_doc, texts.n)[:-1][line_doc]
    used, local = np.unique(line, return_inverse=True)
    key = (local.astype(np.uint64) << _U(44)) | (rarity[(words >> _U(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64) << _U(36)) | (words & _LOW36)
    order = np.argsort(key, kind="stable")
    key, words, local = key[order], words[order], local[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    if len(used) >= packed or ((words[1:] != words[:-1]) & ~fresh[1:]).any():
        order = np.lexsort((words, words & _LOW36, rarity[(words >> _U(64 - SLOT_BITS)).astype(np.int64)], local))
        words, local = words[order], local[order]
        fresh[1:] = (words[1:] != words[:-1]) | (local[1:] != local[:-1])
    words, local = words[fresh], local[fresh]
    return line_doc[used], number[used], np.searchsorted(local, np.arange(len(used) + 1)), words


def prefix_length(size: np.ndarray, similarity: float) -> np.ndarray:
    return size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1


def _lines(docs: DataFrame, counts: np.ndarray, similarity: float) -> DataFrame:
    """One row per line with words: rid, id, doc_hash, line, h1, h2 (the set), size, parity (map of the words), half, prefix.

    `half` is the map of the words with one more bit set, in sets of WIDE_MAP words or more: with it, the map has 128 bits.
    """
    # Shared as a broadcast variable of fixed size: one byte for the order, one for long lists, per slot.
    rarity = np.minimum(255, np.floor(10 * np.log2(counts + 1))).astype(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast((rarity, counts > LONG_LIST))
    packed = PACKED_LINES

    def run(batches):
        rarity, long = shared.value
        rid = TaskContext.get().partitionId() << 36
        for part in slices(batches, "text"):
            doc, number, at, words = line_sets(Texts(part.column("text")), rarity, packed)
            if not len(doc):
                continue
            size = np.diff(at)
            bit = _U(1) << (words & _U(63))
            parity = np.bitwise_xor.reduceat(bit, at[:-1])
            half = np.where(size >= WIDE_MAP, np.bitwise_xor.reduceat(np.where((words >> _U(6)) & _U(1) == 1, bit, _U(0)), at[:-1]), _U(0))
            length = prefix_length(size, similarity)
            total = np.concatenate([[0], np.cumsum(length)])
            own = np.arange(total[-1]) - np.repeat(total[:-1], length) + np.repeat(at[:-1], length)
            token = ((words[own] >> _U(8)) & _U(0x7FFFFFFF)).astype(np.int64)
            token = np.where(long[(words[own] >> _U(64 - SLOT_BITS)).astype(np.int64)], -1 - token, token).astype(np.int32)
            ids, hashes = part.column("id").take(pa.array(doc)), part.column("doc_hash").take(pa.array(doc))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rid + np.arange(len(doc))), ids, hashes, pa.array(number.astype(np.int32)),
                    pa.array(range_hashes(words, at[:-1], at[1:]).view(np.int64)), pa.array(range_hashes(mix(words), at[:-1], at[1:], base=0xD6E8FEB86659FD93).view(np.int64)),
                    pa.array(size.astype(np.int32)), pa.array(parity.view(np.int64)), pa.array(half.view(np.int64)), spans_to_list(token, total, pa.int32()),
                ],
                names=["rid", "id", "doc_hash", "line", "h1", "h2", "size", "parity", "half", "prefix"],
            )
            rid += len(doc)

    return docs.mapInArrow(run, "rid bigint, id bigint, doc_hash bigint, line int, h1 bigint, h2 bigint, size int, parity bigint, half bigint, prefix array<int>")


class _Asking:
    """The lists of one bundle: rows by list and size, and what may be similar in them."""

    def __init__(self, table: pa.Table, starts: np.ndarray, similarity: float):
        n = table.num_rows
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        zero = np.zeros(n, np.int32)
        own = {c: table.column(c).to_numpy(zero_copy_only=False) if c in table.column_names else zero for c in ("rid", "high", "low", "span", "parity", "half", "side", "left", "right", "token")}
        size, pos = own["span"] >> 32, own["span"] & 0xFFFFFFFF
        order = np.lexsort((size, owner))
        self.rid, self.side, self.token = (own[c][order] for c in ("rid", "side", "token"))
        self.asks = table.column("asks").to_numpy(zero_copy_only=False)[order] if "asks" in table.column_names else np.ones(n, bool)
        # Places of lines that are told apart by their number.
        self.high, self.low = (own["high"][order], own["low"][order]) if "low" in table.column_names else (zero, self.rid)
        self.size = size[order]
        self.parity, self.half = (own[c][order].view(np.uint64) for c in ("parity", "half"))
        self.room = self.size - pos[order]
        self.apart = (own["left"] != own["right"])[order]
        self.turn = np.empty(n, np.int64)  # places in order of time
        self.turn[np.lexsort((self.low, self.high))] = np.arange(n)
        self.ratio, self.n = similarity / (1 + similarity), n
        # A row only meets those of its list that follow and are not too long for it.
        key = owner[order] * (int(self.size.max()) + 1) + self.size
        longest = np.minimum(np.floor(self.size / similarity + 1e-9).astype(np.int64), int(self.size.max()))
        self.more = np.searchsorted(key, key - self.size + longest, side="right") - np.arange(n) - 1

    def alike(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that may be similar; lines of one place are not earlier than each other."""
        both = self.size[i] + self.size[j]
        needed = np.ceil(self.ratio * both - 1e-9)
        ok = np.minimum(self.room[i], self.room[j]) >= needed
        i, j, both, needed = i[ok], j[ok], both[ok], needed[ok]
        ok = both - np.bitwise_count(self.parity[i] ^ self.parity[j]) >= 2 * needed
        i, j, both, needed = i[ok], j[ok], both[ok], needed[ok]
        # The two halves of the wide map, where both sets have one.
        one, whole = self.half[i] ^ self.half[j], self.parity[i] ^ self.parity[j]
        odd = np.bitwise_count(one).astype(np.int64) + np.bitwise_count(one ^ whole)
        ok = (np.minimum(self.size[i], self.size[j]) < WIDE_MAP) | (both - odd >= 2 * needed)
        i, j = i[ok], j[ok]
        ok = ~(self.apart[i] & (self.side[i] == self.side[j])) & ((self.high[i] != self.high[j]) | (self.low[i] != self.low[j]))
        return i[ok], j[ok]

    def found(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(a, b) with b the low-th to (high - 1)-th earliest that an asking a may resemble in a list; those who have more, and the lists."""
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def first(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The earliest high + 1 of each a, with their ranks."""
            order = np.lexsort((self.turn[b], a))
            a, b = a[order], b[order]
            head = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
            rank = np.arange(len(a)) - np.repeat(head, np.diff(np.append(head, len(a))))
            keep = rank <= high
            return a[keep], b[keep], rank[keep]

        total = np.concatenate([[0], np.cumsum(self.more)])
        at, held, n_held = 0, [], 0
        while at < self.n:
            to = max(at + 1, int(np.searchsorted(total, total[at] + (1 << 17), side="right")) - 1)
            count = self.more[at:to]
            if count.any():
                i = np.repeat(np.arange(at, to), count)
                i, j = self.alike(i, np.arange(count.sum()) - np.repeat(total[at:to] - total[at], count) + i + 1)
                later = self.turn[i] > self.turn[j]
                own = np.stack([np.where(later, i, j), np.where(later, j, i)])
                own = own[:, self.asks[own[0]]]
                held.append(own)
                n_held += own.shape[1]
                if n_held > 1 << 20:
                    own = np.concatenate(held, axis=1)
                    held = [np.stack(first(own[0], own[1])[:2])]
                    n_held = 0
            at = to
        if held:
            own = np.concatenate(held, axis=1)
            a, b = own[0], own[1]
        a, b, rank = first(a, b)
        keep = (rank >= low) & (rank < high)
        over = a[rank == high]
        return self.rid[a[keep]], self.rid[b[keep]], self.rid[over], self.token[over]


def _candidates(first: DataFrame, asking: DataFrame | None, low: int, high: int, similarity: float) -> DataFrame:
    """(a, b, token): earlier lines b that the asking lines a may resemble; b is null where a has more than it was given in a list.

    `asking` has those rows of the last round whose a still asks; without it all lines do.
    """
    # One row per line and word is all that travels here, so it has as few columns as there can be.
    line = ["rid", *(c for c in ("high", "low") if c in first.columns), "parity", "half"]
    each = F.posexplode("prefix").alias("pos", "token")
    span = F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("span")
    if asking is None:
        places = first.select(*line, "size", each).select("token", span, *line)
    else:
        # Only the lists that a line still asks in.
        asks = narrow_side(materialize(asking.select(F.col("a").alias("rid"), F.lit(True).alias("asks")).distinct(), "asking-lines"))
        wanted = materialize(asking.select("token").distinct(), "asked-lists")
        marked = first.join(asks, "rid", "left").select(*line, "size", each, F.coalesce("asks", F.lit(False)).alias("asks"))
        places = marked.select("token", span, *line, "asks").join(narrow_side(wanted), "token", "left_semi")
    few = places.where(F.col("token") >= 0)
    many = in_blocks(places.where(F.col("token") < 0), ["token"], "rid", rows=2048)

    def run(batches, group):
        for table, starts in bundles(batches, group, 50_000):
            a, b, more, token = _Asking(table, starts, similarity).found(low, high)
            if len(a):
                a, b = np.unique(np.stack([a, b]), axis=1)
            if len(a) or len(more):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([a, more])), pa.concat_arrays([pa.array(b), pa.nulls(len(more), pa.int64())]),
                        pa.concat_arrays([pa.nulls(len(a), pa.int32()), pa.array(token.astype(np.int32))]),
                    ],
                    names=["a", "b", "token"],
                )

    def met(lists: DataFrame, group: list[str]) -> DataFrame:
        return lists.repartition(*group).sortWithinPartitions(*group).mapInArrow(lambda batches: run(batches, group), "a bigint, b bigint, token int")

    return met(few, ["token"]).unionByName(met(many, ["token", "left", "right"])).distinct()


def _word_sets(docs: DataFrame, wanted: DataFrame, unique: bool) -> DataFrame:
    """(rid, words) of the wanted lines (rid, id, doc_hash, line); rows of one id, if ids are not `unique`, may give a line twice."""
    lists = narrow_side(materialize(wanted.groupBy("id", "doc_hash").agg(F.collect_list(F.struct("line", "rid")).alias("lines")), "wanted-lines"), F.size("lines"))
    flat = np.zeros(1 << SLOT_BITS, np.uint8)

    def run(batches):
        for part in slices(batches, "text"):
            doc, number, at, words = line_sets(Texts(part.column("text")), flat)
            place = {(d, k): p for p, (d, k) in enumerate(zip(doc.tolist(), number.tolist()))}
            picked = [(x["rid"], place[d, x["line"]]) for d, own in enumerate(part.column("lines").to_pylist()) for x in own if (d, x["line"]) in place]
            rows = np.array([p for _, p in picked], np.int64)
            size = np.diff(at)[rows]
            total = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            own = np.arange(total[-1]) - np.repeat(total[:-1], size) + np.repeat(at[:-1][rows], size)
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in picked], pa.int64()), spans_to_list(words.view(np.int64)[own], total, pa.int64())], names=["rid", "words"])

    found = docs.join(lists, ["id", "doc_hash"]).select("text", "lines").mapInArrow(run, "rid bigint, words array<bigint>")
    return found if unique else found.groupBy("rid").agg(F.min("words").alias("words"))


def _placed(first: DataFrame, unique: bool) -> DataFrame:
    """Lines numbered in order of document and line: by `rid`, or, where ids repeat or range too far for that, by (high, low).

    Lines of one place, which only a repeated id has, keep a `rid` of their own.
    """
    least, most, lines = first.agg(F.min("id"), F.max("id"), F.max("line")).first()
    if least is None or (most - least + 1) * (lines + 1) >= 1 << 62:
        return first.withColumns({"high": F.col("id"), "low": F.col("line").cast("long")})
    place = (F.col("id") - F.lit(least)) * F.lit(lines + 1) + F.col("line")
    return first.withColumn("rid" if unique else "low", place)


def _similar(source: DataFrame, found: DataFrame, first: DataFrame, similarity: float, unique: bool) -> DataFrame:
    """The rids a of the pairs (a, b) whose full sets are similar."""
    met = found.select(F.col("a").alias("rid")).unionByName(found.select(F.col("b").alias("rid"))).distinct()
    sets = materialize(_word_sets(source, first.join(met, "rid", "left_semi").select("rid", "id", "doc_hash", "line"), unique), "line-words")
    side = lambda c: sets.select(F.col("rid").alias(c), F.col("words").alias(f"w_{c}"))
    shared, total = F.size(F.array_intersect("w_a", "w_b")), F.size("w_a") + F.size("w_b")
    both = found.join(side("a"), "a").join(side("b"), "b")
    return both.where(shared >= F.lit(similarity / (1 + similarity)) * total - 1e-9).select(F.col("a").alias("rid")).distinct()


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, doc_hash, lines): the numbers of the removed lines, from 0, of each document that loses any."""
    source = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("doc_hash"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    lines = materialize(_lines(source, word_slots(source), similarity), "lines")
    # One row for each set: its first line, and whether others have it too.
    row = F.struct("id", "line", "rid", "doc_hash", "size", "parity", "half", "prefix")
    classes = lines.groupBy("h1", "h2").agg(F.min(row).alias("f"), F.count(F.lit(1)).alias("n"))
    kept = [F.when(F.col("n") > 1, F.col(c)).alias(c) for c in ("h1", "h2")]
    repeated = docs.groupBy(F.col(key).cast("long").alias("id")).count().where(F.col("id").isNotNull() & (F.col("count") > 1))
    unique = repeated.isEmpty()
    first = _placed(materialize(classes.select(*kept, "f.*"), "line-classes"), unique)
    shared = first.where(F.col("h1").isNotNull()).select("h1", "h2", F.struct("id", "line").alias("f"))
    gone = lines.select("h1", "h2", "id", "doc_hash", "line").join(shared, ["h1", "h2"]).where(F.struct("id", "line") > F.col("f")).select("id", "doc_hash", "line")
    asking, low, high = None, 0, FIRST_ROUND
    while True:
        found = materialize(_candidates(first, asking, low, high, similarity), "line-candidates")
        pairs_ = found.where(F.col("b").isNotNull()).select("a", "b")
        decided = materialize(_similar(source, pairs_, first, similarity, unique), "similar-lines")
        gone = gone.unionByName(first.join(decided, "rid", "left_semi").select("id", "doc_hash", "line"))
        asking = materialize(found.where(F.col("b").isNull()).select("a", "token").join(decided.withColumnRenamed("rid", "a"), "a", "left_anti"), "asking-lines")
        if asking.isEmpty():
            break
        low, high = high, high * NEXT_ROUND
    return gone.groupBy("id", "doc_hash").agg(F.collect_set("line").alias("lines"))


def kept_lines(docs: DataFrame, gone: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` with the removed lines taken out of `text`, and `__lines`, `__gone`: how many there were and went."""
    side = narrow_side(materialize(gone.toDF("__id", "__hash", "__numbers"), "removed-lines"), F.size("__numbers"))
    joined = docs.join(side, (F.col(key).cast("long") == F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left")
    parts = F.split(F.col(text), "\n", -1)
    lost = F.coalesce(F.size("__numbers"), F.lit(0))
    rest = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__numbers")))
    left = F.when(lost == 0, F.col(text)).otherwise(F.array_join(F.transform(rest, lambda k: F.get(F.col("__parts"), k)), "\n"))
    return (
        joined.withColumn("__parts", parts).withColumn("__lines", F.when(F.col(text).isNull(), 0).otherwise(F.size("__parts")))
        .withColumn("__gone", lost).withColumn(text, left).select(*docs.columns, "__lines", "__gone")
    )


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with the lines that are left; those of which no word is left are dropped."""
    left = kept_lines(docs, removed_lines(docs, similarity=similarity))
    return left.where((F.col("__gone") == 0) | F.col("text").rlike(r"[^ \t-\r]")).select(*docs.columns)
