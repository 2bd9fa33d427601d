"""Removal of every byte that lies in a repeated string of `length` bytes, by range-partitioned suffixes.

A string repeats if it starts at another place of any document, the same one included. All starts of such
strings are suffixes that agree with another one in their first `length` bytes. Sorting every suffix of a
corpus would copy it `length` times, so suffixes are taken together in runs and sorted in two steps:

1. Each start is named by a lead: the least hash among the grams of `gram` bytes inside its string. Equal
   strings have equal leads, and consecutive starts mostly share one; such a run of starts is one suffix record,
   about one for every 70 bytes. Its tokens are the lead, two hashes of the whole run, and a salt.
2. A sample of documents gives splitters, and records are range-partitioned by their leading tokens. The salt
   lets a run that stands in a third of all documents lie in several buckets.
3. Every bucket is sorted by multikey quicksort: by one token at a time, going on only inside groups that
   still tie. A record that agrees with its neighbour in all tokens is covered whole. A lead with a single
   record cannot repeat and goes. Leads with different runs stay open, one record for each run; so do the first
   and the last lead of a bucket, which may go on across its boundaries.
4. Open records fetch their bytes and come together by lead, those of neighbouring buckets included. Their
   suffixes are sorted by multikey quicksort on words of eight bytes, and those that agree with a neighbour in
   all `length` bytes are covered.
5. Covered stretches are united per document and cut out.

Leads of very common grams would bring together many different runs. Grams that lead `HOT_RUNS` different runs
in the sample are ranked behind all others: a string is led by one of them only if it holds nothing else, so its
run is the same wherever it stands. The rule changes which gram leads, for all documents alike, never a result.

Only the whole-run comparison of step 3 takes hashes for equal: 64 bits by powers modulo 2**64 and 62 bits
modulo two primes, which no structure of the text can fool together.

Defined cases: a null text is empty; texts shorter than `length` stay whole; every row counts as a document,
whatever its id, so rows that repeat cover each other, and null ids take part; extra columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialize
from .arrays import Texts, counts_of, give_back, powers, mix, slices
from .bundles import bundles

LENGTH = 200
GRAM = 64
# Documents from which splitters and common leads are taken: at least this many, and some for each partition.
SAMPLE_DOCS = 2048
SAMPLE_RUNS = 4096  # of one sampled document
HOT_RUNS = 16
# A longer run of starts with one lead (periodic text) is cut; a bucket is meant to hold so many records.
RUN_STARTS = 512
BUCKET_RECORDS = 400_000
_U = np.uint64
_BASE = 0xA0761D6478BD642F
# Primes below 2**31 and bases for them.
_PRIMES = ((2147483647, 1103515245), (2147483629, 1664525007))
_BYTES = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)


def multikey_order(n: int, depth: int, token) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of n items of `depth` tokens, and with how many tokens each agrees with the one before it.

    `token(d, items)` gives the d-th tokens of some items. A level sorts inside the groups that tie so far and
    drops every item that no longer ties, so tokens are only read where they decide.
    """
    order = np.arange(n)
    common = np.zeros(n, np.int64)
    places, group = np.arange(n), np.zeros(n, np.int64)
    for d in range(depth):
        if not len(places):
            break
        values = token(d, order[places])
        turn = np.lexsort((values, group))
        order[places] = order[places][turn]
        values = values[turn]
        tie = np.zeros(len(places), bool)
        tie[1:] = (group[1:] == group[:-1]) & (values[1:] == values[:-1])
        common[places[tie]] = d + 1
        member = tie.copy()
        member[:-1] |= tie[1:]
        group = np.cumsum(~tie)[member]
        places = places[member]
    return order, common


_POWERS: dict[int, np.ndarray] = {}


def _prime_powers(base: int, prime: int, n: int) -> np.ndarray:
    """The first n powers modulo a prime below 2**31; those of ordinary slices are kept."""
    own = _POWERS.get(base)
    if own is None or len(own) < n:
        own = np.ones(-(-n // (1 << 16)) << 16, np.int64)
        have = 1
        while have < len(own):
            step = min(have, len(own) - have)
            own[have : have + step] = own[:step] * pow(base, have, prime) % prime
            have += step
        if len(own) <= 1 << 21:
            _POWERS[base] = own
    return own[:n]


class RunHashes:
    """Hashes of byte ranges of one buffer: 64 bits modulo 2**64, and 62 bits modulo two primes."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.up, self.down = powers(_BASE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[raw] * self.up[:n], out=self.sums[1:])
        self.raw = raw

    def grams(self, gram: int) -> np.ndarray:
        """Hash of the gram at every place that has one."""
        m = len(self.raw) - gram + 1
        return mix((self.sums[gram:] - self.sums[:m]) * self.down[:m]) if m > 0 else np.zeros(0, np.uint64)

    def runs(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        long = mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _U(0xD1B54A32D192ED03))
        other = np.zeros(len(start), np.int64)
        for prime, base in _PRIMES:
            power = _prime_powers(base, prime, len(self.raw) + 1)
            sums = np.zeros(len(self.raw) + 1, np.int64)
            at, carry = 0, 0
            while at < len(self.raw):  # sums of products below 2**39 stay below 2**63 for so many bytes
                to = min(at + (1 << 23), len(self.raw))
                sums[at + 1 : to + 1] = carry + np.cumsum((self.raw[at:to].astype(np.int64) + 1) * power[at:to])
                carry = int(sums[to]) % prime
                at = to
            # Powers of the inverse bring a range to the front.
            down = _prime_powers(pow(base, -1, prime), prime, len(self.raw) + 1)
            other = (other << 31) | ((sums[end] - sums[start]) % prime * down[start] % prime)
        return long, other


def _leads(texts: Texts, length: int, gram: int, hot: tuple[np.ndarray, np.ndarray]):
    """Runs of starts that share a lead: text number, first start, number of starts, lead, whether the lead stands in it more than once."""
    hashes = RunHashes(texts.bytes)
    width = length - gram + 1
    lengths = np.diff(texts.offsets)
    starts_of = np.maximum(lengths - length + 1, 0)
    total = int(starts_of.sum())
    empty = np.zeros(0, np.int64)
    if not total:
        return hashes, empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, bool)
    value = hashes.grams(gram) >> _U(1)
    marks, common = hot
    if len(common):
        maybe = np.flatnonzero(marks[(value & _U(0xFFFF)).astype(np.int64)])
        value[maybe[np.isin(value[maybe], common)]] |= _U(1 << 63)
    # Least value of each window of `width` grams: running minima from both sides of blocks of that size.
    top = _U(0xFFFFFFFFFFFFFFFF)
    blocks = np.concatenate([value, np.full(-len(value) % width + width, top)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: len(value) - width + 1], ahead[width - 1 : len(value)])
    doc = np.repeat(np.arange(texts.n), starts_of)
    start = np.arange(total) - np.repeat(np.cumsum(starts_of) - starts_of, starts_of) + texts.offsets[:-1][doc]
    lead = least[start]
    head = np.ones(total, bool)
    head[1:] = (lead[1:] != lead[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(head)
    n = np.diff(np.append(first, total))
    if (n > RUN_STARTS).any():
        pieces = -(-n // RUN_STARTS)
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        rest = np.repeat(n, pieces) - piece * RUN_STARTS
        first, n = np.repeat(first, pieces) + piece * RUN_STARTS, np.minimum(rest, RUN_STARTS)
    # The lead stands once in a run if its first place seen from the first start is its last seen from the last one.
    again = np.zeros(len(first), bool)
    again[n > width] = True
    span = np.arange(width)
    for at in range(0, len(first), 2048):
        part = slice(at, at + 2048)
        a, b = start[first[part]], start[first[part]] + n[part] - 1
        from_left = a + (value[a[:, None] + span] == lead[first[part]][:, None]).argmax(axis=1)
        from_right = b + width - 1 - (value[(b + width - 1)[:, None] - span] == lead[first[part]][:, None]).argmax(axis=1)
        again[part] |= from_left != from_right
    return hashes, doc[first], start[first], n, lead[first], again


_RECORD = "lead bigint, run1 bigint, run2 bigint, id {kind}, doc_hash bigint, place int, n int, again boolean"
_FIELDS = ["lead", "run1", "run2", "id", "doc_hash", "place", "n", "again"]


def _record_batch(part: pa.RecordBatch, length: int, gram: int, hot, most: int = 0) -> tuple[list[pa.Array], list[np.ndarray]]:
    texts = Texts(part.column("text"))
    hashes, doc, start, n, lead, again = _leads(texts, length, gram, hot)
    if most and len(doc):
        count = counts_of(doc, texts.n)
        rank = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
        keep = rank % (-(-count // most))[doc] == 0
        doc, start, n, lead, again = doc[keep], start[keep], n[keep], lead[keep], again[keep]
    run1, run2 = hashes.runs(start, start + n + length - 1)
    owner = pa.array(doc)
    doc_hash = part.column("doc_hash").take(owner)
    place = start - texts.offsets[:-1][doc]
    salt = mix(doc_hash.to_numpy().view(np.uint64) + place.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    arrays = [
        pa.array(lead.view(np.int64)), pa.array(run1.view(np.int64)), pa.array(run2), part.column("id").take(owner), doc_hash,
        pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(again),
    ]
    return arrays, [lead, run1, run2.view(np.uint64), salt]


def _hot_marks(common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    marks = np.zeros(1 << 16, bool)
    marks[(common & _U(0xFFFF)).astype(np.int64)] = True
    return marks, common


def _sampled(source: DataFrame, length: int, gram: int, docs: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Common leads, and splitters as rows of tokens (lead, two run hashes, salt), from at most about `docs` documents."""
    count = source.count()
    share = max(1, count // docs)
    kind = source.schema["id"].dataType.simpleString()

    def run(batches, hot=_hot_marks(np.zeros(0, np.uint64))):
        for part in slices(batches, "text"):
            _, tokens = _record_batch(part, length, gram, hot, SAMPLE_RUNS)
            if len(tokens[0]):
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)) for t in tokens], names=["a", "b", "c", "d"])

    picked = source.where(F.pmod(F.xxhash64("doc_hash", "id"), F.lit(share)) == 0)
    found = picked.mapInArrow(run, "a bigint, b bigint, c bigint, d bigint").toArrow()
    tokens = [found.column(c).to_numpy().view(np.uint64) for c in "abcd"]
    n = found.num_rows
    order, agree = multikey_order(n, 4, lambda d, items: tokens[d][items])
    own = tokens[0][order]
    fresh = agree < 3  # another run of this lead, or another lead
    leads, runs = np.unique(own[fresh], return_counts=True)
    common = leads[runs >= max(HOT_RUNS, n // (8 * parts))]
    parts = max(parts, n * share // BUCKET_RECORDS)
    # The splitters follow the leads as they will be: strings led by a common gram mostly get another one.
    keep = order[~np.isin(own, common)]
    at = keep[np.linspace(0, len(keep), parts + 1).astype(np.int64)[1:-1]] if len(keep) else keep
    return common, np.unique(np.stack([t[at] for t in tokens], axis=1), axis=0)


def buckets(tokens: list[np.ndarray], splitters: np.ndarray) -> np.ndarray:
    """Number of splitters that are not greater than each row of tokens, in their order."""
    low = np.searchsorted(splitters[:, 0], tokens[0], side="left")
    high = np.searchsorted(splitters[:, 0], tokens[0], side="right")
    found = low.copy()
    tied = np.flatnonzero(high > low)
    while len(tied):
        at = splitters[found[tied]]
        below, level = np.zeros(len(tied), bool), np.ones(len(tied), bool)
        for d, t in enumerate(tokens):
            below |= level & (at[:, d] < t[tied])
            level &= at[:, d] == t[tied]
        passed = below | level
        found[tied[passed]] += 1
        tied = tied[passed]
        tied = tied[found[tied] < high[tied]]
    return found


def _judged(records: DataFrame, kind: str) -> DataFrame:
    """Rows (lead, id, doc_hash, place, n, covered, open) of each bucket: what repeats whole, and one record for each run of an open lead."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        held.clear()
        tokens = [table.column(c).to_numpy().view(np.uint64) for c in ("lead", "run1", "run2")]
        size = table.num_rows
        order, agree = multikey_order(size, 3, lambda d, items: tokens[d][items])
        lead = tokens[0][order]
        follows, repeats = agree >= 1, agree >= 3
        edge = (lead == lead[0]) | (lead == lead[-1])
        covered = repeats.copy()
        covered[:-1] |= repeats[1:]
        group = np.cumsum(~follows) - 1
        runs = np.bincount(group, weights=~repeats)
        again = np.bincount(group, weights=table.column("again").to_numpy(zero_copy_only=False)[order]) > 0
        open_ = ~repeats & (edge | (runs > 1)[group] | again[group])
        keep = np.flatnonzero(covered | open_)
        for at in range(0, len(keep), 1 << 16):
            own = keep[at : at + (1 << 16)]
            rows = table.take(pa.array(order[own]))
            for batch in rows.select(["lead", "id", "doc_hash", "place", "n"]).append_column("covered", pa.array(covered[own])).append_column("open", pa.array(open_[own])).combine_chunks().to_batches():
                yield batch
        del table, tokens
        give_back()

    return records.mapInArrow(run, f"lead bigint, id {kind}, doc_hash bigint, place int, n int, covered boolean, open boolean")


def _open_bytes(source: DataFrame, wanted: DataFrame, length: int, kind: str) -> DataFrame:
    """(lead, id, doc_hash, place, bytes) of the open records."""
    lists = wanted.groupBy(F.col("id").alias("__id"), F.col("doc_hash").alias("__hash")).agg(F.collect_list(F.struct("lead", "place", "n")).alias("open"))

    def run(batches):
        for part in slices(batches, "text"):
            texts = Texts(part.column("text"))
            entries = part.column("open")
            flat = entries.flatten()
            owner = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(entries.offsets)))
            lead, place, n = (np.asarray(flat.field(k)) for k in range(3))
            start = texts.offsets[:-1][owner] + place
            raw = texts.bytes.tobytes()
            own = [raw[s : s + m + length - 1] for s, m in zip(start.tolist(), n.tolist())]
            at = pa.array(owner)
            for k in range(0, len(own), 1 << 14):
                some = slice(k, k + (1 << 14))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lead[some]), part.column("id").take(at[some]), part.column("doc_hash").take(at[some]), pa.array(place[some]), pa.array(own[some], pa.binary())],
                    names=["lead", "id", "doc_hash", "place", "bytes"],
                )

    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("doc_hash") == F.col("__hash"))
    # Rows that repeat give their records twice, which is what they are.
    return source.join(lists, same).select("id", "doc_hash", "text", "open").mapInArrow(run, f"lead bigint, id {kind}, doc_hash bigint, place int, bytes binary")


def repeated_starts(raw: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Which of these starts have a string of `length` bytes that stands at another of them: a suffix sort by words."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.ndarray(shape=(len(raw) + 1,), dtype=">u8", buffer=padded, strides=(1,))
    offsets = [min(8 * d, length - 8) for d in range(-(-length // 8))] if length >= 8 else []
    if offsets:
        order, agree = multikey_order(len(start), len(offsets), lambda d, items: words[start[items] + offsets[d]].astype(np.uint64))
    else:
        order, agree = multikey_order(len(start), length, lambda d, items: raw[start[items] + d])
    tie = agree >= (len(offsets) or length)
    tie[:-1] |= tie[1:]
    found = np.zeros(len(start), bool)
    found[order[tie]] = True
    return found


def _open_ranges(records: DataFrame, length: int, kind: str) -> DataFrame:
    """(id, doc_hash, start, end) of what repeats in the open records."""

    def run(batches):
        for table, _ in bundles(batches, ["lead"], 4096):
            column = table.column("bytes").combine_chunks().cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            n = np.diff(offsets) - length + 1
            record = np.repeat(np.arange(len(n)), n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = np.flatnonzero(repeated_starts(raw, offsets[:-1][record] + inner, length))
            if not len(hit):
                continue
            head = np.ones(len(hit), bool)
            head[1:] = (hit[1:] != hit[:-1] + 1) | (record[hit[1:]] != record[hit[:-1]])
            first = np.flatnonzero(head)
            last = np.append(first[1:], len(hit)) - 1
            owner = pa.array(record[hit[first]])
            place = table.column("place").take(owner).to_numpy().astype(np.int64)
            out = pa.table(
                [table.column("id").take(owner), table.column("doc_hash").take(owner), pa.array((place + inner[hit[first]]).astype(np.int32)), pa.array((place + inner[hit[last]] + length).astype(np.int32))],
                names=["id", "doc_hash", "start", "end"],
            )
            yield from out.combine_chunks().to_batches()

    return records.repartition("lead").sortWithinPartitions("lead").mapInArrow(run, f"id {kind}, doc_hash bigint, start int, end int")


def united(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows (start, end) of the maximal stretches that these ranges cover; ranges that touch are one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    head = np.ones(len(start), bool)
    head[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(head)
    return np.stack([start[first], end[np.append(first[1:], len(start)) - 1]], axis=1)


def repeated_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """(id, doc_hash, ranges): byte ranges [start, end) of each document that repeat, as 32-bit pairs in order."""
    if length < 2:
        raise ValueError("strings of two bytes or more")
    gram = gram or max(1, min(GRAM, length // 2))
    source = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("doc_hash"), F.col(text).cast("string").alias("text"))
    long = source.where(F.octet_length("text") >= length)
    kind = source.schema["id"].dataType.simpleString()
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    common, splitters = _sampled(long, length, gram, max(SAMPLE_DOCS, 16 * parts), parts)
    shared = spark.sparkContext.broadcast((_hot_marks(common), splitters))

    def run(batches):
        hot, splitters = shared.value
        for part in slices(batches, "text"):
            arrays, tokens = _record_batch(part, length, gram, hot)
            if len(tokens[0]):
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(buckets(tokens, splitters).astype(np.int32))], names=[*_FIELDS, "bucket"])

    records = long.mapInArrow(run, _RECORD.format(kind=kind) + ", bucket int").repartitionById(len(splitters) + 1, F.col("bucket"))
    judged = materialize(_judged(records.drop("bucket"), kind), "suffix-records")
    opened = _open_bytes(long, judged.where("open"), length, kind)
    single = _open_ranges(opened, length, kind)
    whole = judged.where("covered").select("id", "doc_hash", F.col("place").alias("start"), (F.col("place") + F.col("n") + (length - 1)).alias("end"))
    lists = whole.unionByName(single).groupBy("id", "doc_hash").agg(F.collect_set(F.struct("start", "end")).alias("parts"))

    def unite(batches):
        for b in batches:
            out = [united(*(np.asarray(own.values.field(k)).astype(np.int64) for k in range(2))).astype("<i4").tobytes() for own in b.column("parts")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("doc_hash"), pa.array(out, pa.binary())], names=["id", "doc_hash", "ranges"])

    return materialize(lists.mapInArrow(unite, f"id {kind}, doc_hash bigint, ranges binary"), "suffix-ranges")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept, kept_sha256) of every row; kept are the bytes that are left."""
    side = repeated_ranges(docs, key, text, length).toDF("__id", "__hash", "ranges")
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    joined = rows.join(side, F.col("key").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left").select("key", "text", "ranges")
    kind = dict(rows.dtypes)["key"]

    def run(batches):
        for part in slices(batches, "text"):
            texts = Texts(part.column("text"))
            raw = texts.bytes.tobytes()
            size, lost, spans, kept, sums = np.diff(texts.offsets), [], [], [], []
            for k, ranges in enumerate(part.column("ranges").to_pylist()):
                at, end = int(texts.offsets[k]), int(texts.offsets[k + 1])
                gone = np.frombuffer(ranges or b"", "<i4").reshape(-1, 2).tolist()
                edges = [0, *[x for pair in gone for x in pair], end - at]
                own = b"".join([raw[at + x : at + y] for x, y in zip(edges[::2], edges[1::2])])
                lost.append(end - at - len(own)), spans.append(len(gone)), kept.append(own), sums.append(hashlib.sha256(own).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(size.astype(np.int64)), pa.array(lost, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(sums, pa.string())],
                names=["key", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return joined.mapInArrow(run, f"key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string").withColumnRenamed("key", key)
