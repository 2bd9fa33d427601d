"""Near-duplicate documents by weighted minwise hashing of shingle multisets.

A text is the multiset of its runs of five words; a text of one to four words has its whole word run as
the only one. Similarity is weighted Jaccard: sum of the smaller over sum of the larger counts.

Signatures follow hierarchical Poisson processes over discretised weights. The weight axis of a shingle is
cut into [0, 1), [1, 2), [2, 4), [4, 8) and so on; on each part runs a Poisson process in time with a rate
of its length, whose points carry a place on the part and a signature component. A point counts if its
place lies below the shingle's weight, so texts share exactly the points below the smaller weight, and a
component's earliest point agrees with a probability equal to the weighted Jaccard similarity. Points are
drawn in order of time and a process stops once it is later than every component's earliest point, so a
long text costs little more than one draw per shingle.

Signatures are banded. Texts that meet in a band are first compared with the smallest id of the bucket,
then with the few of other components that look most alike by signature. Buckets that still hold several
components are dealt out in pairs of blocks, with the multisets, and all their pairs that look alike are
compared there; only links come out, no pairs. Every comparison is exact on the shingle multisets. Members
of one component are not compared again, which keeps large groups of copies short. Equal texts form one
class before all this and are compared once.

Result: one row per id with class_id, the smallest id of its component.

Defined cases: a null text counts as empty; a text without words is linked to nothing; an id that repeats
joins the classes of all its texts and gives one row; rows with a null id are left out of the result;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialize
from .arrays import Texts, bounds_of, mix, range_hashes, slices, spans_to_list
from .bundles import bundles, pairs
from .components import components
from .sides import narrow_side

WORDS, SIMILARITY = 5, 0.8
COMPONENTS, BANDS = 64, 16
# Pairs whose signatures agree in a smaller share of the components are not compared: at a similarity of
# 0.8 this lies more than five standard deviations below the mean.
LOOKS_ALIKE = 0.53
# Texts of other components that each text is compared with in a round, the most alike first.
NEIGHBOURS = 4
# Members per block where the rest of a bucket is compared; a block holds their multisets.
BLOCK_ROWS = 256
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def shingles(texts: Texts, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every shingle occurrence, ordered by text."""
    doc, _, _, hashes = texts.words()
    at = bounds_of(doc, texts.n)
    size = np.diff(at)
    count = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    owner = np.repeat(np.arange(texts.n), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + at[:-1][owner]
    return owner, range_hashes(hashes, start, np.minimum(start + k, at[1:][owner]), base=0xD6E8FEB86659FD93)


def bag(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, count) of the distinct shingles of each text, ordered."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(fresh)
    return owner[first], hashes[first], np.diff(np.append(first, len(owner)))


def signatures(owner: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n: int, m: int = COMPONENTS) -> np.ndarray:
    """(n, m) 32-bit signatures of weighted sets with integer weights; all ones where a text has no shingle."""
    levels = np.frexp(np.maximum(weight - 1, 0).astype(float))[1] + 1  # bit length of weight - 1, plus one
    unit = np.repeat(np.arange(len(owner)), levels)
    level = np.arange(len(unit)) - np.repeat(np.cumsum(levels) - levels, levels)
    doc, w = owner[unit], weight[unit]
    seed = mix(hashes[unit] ^ ((level.astype(np.uint64) + _U(1)) * _GOLD))
    width = np.where(level > 0, 2.0 ** (level - 1), 1.0)
    low = np.where(level > 0, width, 0.0)
    best = np.full(n * m, np.inf)
    time = np.zeros(len(unit))
    step = 0
    while len(doc):
        step += 1
        draw = mix(seed + np.array([step], np.uint64) * _GOLD)
        uniform = ((draw >> _U(11)).astype(float) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / (width * m)
        other = mix(draw ^ _U(0xA5A5A5A5A5A5A5A5))
        place = low + np.floor((other >> _U(40)).astype(float) * 2.0**-24 * width)
        component = (other & _U(0xFFFFFFFF)) % _U(m)
        counts = place < w
        np.minimum.at(best, doc[counts] * m + component[counts].astype(np.int64), time[counts])
        alive = time < best.reshape(n, m).max(axis=1)[doc]
        seed, time, doc, w, width, low = (x[alive] for x in (seed, time, doc, w, width, low))
    return (mix(best.view(np.uint64)) & _U(0xFFFFFFFF)).astype(np.uint32).reshape(n, m)


def _text_hashes(texts: Texts) -> pa.Array:
    raw = [hashlib.blake2b(texts.bytes[a:b], digest_size=16).digest() for a, b in zip(texts.offsets[:-1], texts.offsets[1:])]
    return pa.array(raw, pa.binary())


def _signed(docs: DataFrame) -> DataFrame:
    """(id, text_hash, n, sig, bands) of every text with an id."""

    def run(batches):
        for part in slices(batches, "text"):
            texts = Texts(part.column("text"))
            owner, hashes = shingles(texts)
            sig = signatures(*bag(owner, hashes), texts.n)
            per = COMPONENTS // BANDS
            band = range_hashes(sig.reshape(-1).astype(np.uint64) + _U(1), np.arange(0, sig.size, per), np.arange(per, sig.size + 1, per))
            band = mix(band + np.tile(np.arange(BANDS, dtype=np.uint64), texts.n) * _GOLD)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"), _text_hashes(texts), pa.array(np.bincount(owner, minlength=texts.n), pa.int64()),
                    pa.array([s.tobytes() for s in sig], pa.binary()),
                    spans_to_list(band.view(np.int64), np.arange(0, len(band) + 1, BANDS), pa.int64()),
                ],
                names=["id", "text_hash", "n", "sig", "bands"],
            )

    kind = dict(docs.dtypes)["id"]
    return docs.mapInArrow(run, f"id {kind}, text_hash binary, n bigint, sig binary, bands array<bigint>")


def _multisets(docs: DataFrame) -> DataFrame:
    """(text_hash, bag): the shingles as a set in which the k-th occurrence of a shingle is an element of its own."""

    def run(batches):
        for part in slices(batches, "text"):
            texts = Texts(part.column("text"))
            owner, hashes, count = bag(*shingles(texts))
            turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            doc = np.repeat(owner, count)
            each = mix(np.repeat(hashes, count) + turn.astype(np.uint64) * _GOLD)
            yield pa.RecordBatch.from_arrays([_text_hashes(texts), spans_to_list(each.view(np.int64), bounds_of(doc, texts.n), pa.int64())], names=["text_hash", "bag"])

    return docs.mapInArrow(run, "text_hash binary, bag array<bigint>")


def _verified(candidates: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Candidates (a, b) with `linked`: whether their multisets are similar enough."""
    side = lambda c: bags.select(F.col("id").alias(c), F.col("bag").alias(f"bag_{c}"))
    both = candidates.join(side("b"), "b").join(side("a"), "a")
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    union = F.size("bag_a") + F.size("bag_b") - shared
    return both.select("a", "b", (shared >= F.lit(similarity) * union - 1e-9).alias("linked"))


def _open(members: DataFrame, rows: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """Members of buckets with several components, in pairs of blocks, with what `rows` holds by id.

    The members of a bucket's largest component need not meet each other. Their blocks (numbered -1, -2, ...)
    only meet those of the other members (0, 1, ...), and those meet among themselves; so a bucket that is
    settled but for a few members is copied about once, whatever its size.
    """
    bucket = ["band", "key"]
    each = members.join(labels, "id", "left").select(*bucket, "id", F.coalesce("component", "id").alias("label"))
    parts = each.groupBy(*bucket, "label").agg(F.count("id").alias("n"))
    shapes = parts.groupBy(*bucket).agg(
        F.max_by("label", F.struct("n", "label")).alias("base"), F.max("n").alias("n_base"), (F.sum("n") - F.max("n")).alias("n_other")
    ).where(F.col("n_other") > 0)
    count = lambda n: F.ceil(F.col(n) / size).cast("int")
    shapes = shapes.select(*bucket, "base", count("n_base").alias("b_blocks"), count("n_other").alias("o_blocks"))
    cut = each.join(shapes, bucket).join(rows, "id")
    is_base = F.col("label") == F.col("base")
    own = lambda n: F.pmod(F.xxhash64(F.lit(7), "id"), F.col(n)).cast("int")
    side = F.when(is_base, -1 - own("b_blocks")).otherwise(own("o_blocks"))
    pair = lambda x, y: F.struct(F.least(x, y).alias("left"), F.greatest(x, y).alias("right"))
    others = F.sequence(F.lit(0), F.col("o_blocks") - 1)
    met = F.when(is_base, others).otherwise(F.concat(F.sequence(F.lit(-1), -F.col("b_blocks")), others))
    placed = cut.withColumn("side", side).withColumn("__met", F.explode(met)).withColumn("__pair", pair(F.col("side"), F.col("__met")))
    return placed.withColumns({c: F.col("__pair")[c] for c in ("left", "right")}).drop("__met", "__pair", "base", "b_blocks", "o_blocks")


_GROUP = ["band", "key", "left", "right"]


def _look_alike(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, share of equal components) of the rows of different components that look alike in this band first."""
    n, per = table.num_rows, COMPONENTS // BANDS
    label, band, side = (table.column(c).to_numpy() for c in ("label", "band", "side"))
    apart = table.column("left").to_numpy() != table.column("right").to_numpy()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(n, COMPONENTS)
    found = [np.zeros((3, 0))]
    for i, j in pairs(starts, n, 1 << 17):
        ok = (label[i] != label[j]) & ~(apart[i] & (side[i] == side[j]))
        i, j = i[ok], j[ok]
        same = sig[i] == sig[j]
        share = same.mean(axis=1)
        first = same.reshape(len(i), BANDS, per).all(axis=2).argmax(axis=1)
        keep = (share >= LOOKS_ALIKE) & (first == band[i])
        found.append(np.stack([i[keep], j[keep], share[keep]]))
    i, j, share = np.concatenate(found, axis=1)
    return i.astype(np.int64), j.astype(np.int64), share


def _neighbours(members: DataFrame, signed: DataFrame, labels: DataFrame) -> DataFrame:
    """Candidate pairs (a, b), a > b: for each row and bucket the most alike rows of other components."""
    kind = dict(members.dtypes)["id"]

    def run(batches):
        for table, starts in bundles(batches, _GROUP, 20_000):
            ids = table.column("id").to_numpy()
            i, j, share = _look_alike(table, starts)
            i, j, share = np.append(i, j), np.append(j, i), np.append(share, share)
            order = np.lexsort((-share, i))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1])[: len(i)])
            rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
            i, j = i[rank < NEIGHBOURS], j[rank < NEIGHBOURS]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[i], ids[j])), pa.array(np.minimum(ids[i], ids[j]))], names=["a", "b"])

    rows = _open(members, signed.select("id", "sig"), labels, 1024)
    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _remaining_links(members: DataFrame, signed: DataFrame, labels: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the components of a bucket, enough to join all that any link joins."""
    kind = dict(members.dtypes)["id"]

    def run(batches):
        for table, starts in bundles(batches, _GROUP, 2000):
            ids, label = table.column("id").to_numpy(), table.column("label").to_numpy()
            i, j, share = _look_alike(table, starts)
            order = np.argsort(-share, kind="stable")
            root: dict = {}

            def find(x):
                while (up := root.get(x, x)) != x:
                    root[x] = root.get(up, up)
                    x = up
                return x

            column, sets, out = table.column("bag").combine_chunks(), {}, []
            for x, y in zip(i[order].tolist(), j[order].tolist()):
                a, b = find(label[x]), find(label[y])
                if a == b:
                    continue
                for r in (x, y):
                    if r not in sets:
                        sets[r] = set(column[r].values.to_pylist())
                p, q = sets[x], sets[y]
                if min(len(p), len(q)) < similarity * max(len(p), len(q)) - 1e-9:
                    continue
                shared = len(p & q)
                if shared >= similarity * (len(p) + len(q) - shared) - 1e-9:
                    root[max(a, b)] = min(a, b)
                    out.append((int(ids[x]), int(ids[y])))
            yield pa.RecordBatch.from_arrays([pa.array([max(p) for p in out], pa.int64()), pa.array([min(p) for p in out], pa.int64())], names=["a", "b"])

    rows = _open(members, signed.select("id", "sig").join(bags, "id"), labels, BLOCK_ROWS)
    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(key, class_id) of every id."""
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull())
    every = materialize(_signed(source), "signatures")
    # Equal texts: one class. Texts without words stay apart.
    worded = every.where(F.col("n") > 0)
    classes = worded.groupBy("text_hash").agg(F.min("id").alias("rep"))
    members = materialize(worded.select("id", "text_hash").join(classes, "text_hash").select("id", "rep").distinct(), "members")
    # Texts are compared under numbers of their own, since an id may stand for several; from here on to the links, id is that number.
    first = worded.join(classes, "text_hash").where(F.col("id") == F.col("rep")).groupBy("text_hash").agg(F.min(F.struct("rep", "sig", "bands")).alias("r"))
    signed = materialize(first.select(F.monotonically_increasing_id().alias("id"), "text_hash", "r.rep", "r.sig", "r.bands"), "representatives")
    bucketed = signed.select("id", F.posexplode("bands").alias("band", "key"))
    shared = bucketed.groupBy("band", "key").agg(F.count("id").alias("n"), F.min("id").alias("leader")).where(F.col("n") > 1)
    met = materialize(bucketed.join(shared.drop("n"), ["band", "key"]), "buckets")
    wanted = materialize(signed.select("id", "rep", "text_hash").join(met.select("id").distinct(), "id", "left_semi"), "compared-texts")
    owners = narrow_side(materialize(wanted.select(F.col("rep").alias("id")).distinct(), "compared-ids"))
    each = _multisets(source.join(owners, "id", "left_semi")).groupBy("text_hash").agg(F.min("bag").alias("bag"))
    bags = materialize(each.join(wanted.select("id", "text_hash"), "text_hash").select("id", "bag"), "multisets")
    stars = met.where(F.col("id") != F.col("leader")).select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    tested = materialize(_verified(stars, bags, similarity), "compared")
    links = tested.where("linked").select("a", "b")
    met = met.select("band", "key", "id")
    labels = components(links)
    near = materialize(_neighbours(met, signed, labels).join(tested.select("a", "b"), ["a", "b"], "left_anti"), "candidates")
    more = materialize(_verified(near, bags, similarity).where("linked").select("a", "b"), "links")
    known = lambda: labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
    if not more.isEmpty():
        labels = components(known().unionByName(more))
    rest = materialize(_remaining_links(met, signed, labels, bags, similarity), "links")
    own = members.where(F.col("id") != F.col("rep")).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    rep = lambda c: wanted.select(F.col("id").alias(c), F.col("rep").alias(f"rep_{c}"))
    between = known().unionByName(rest).join(rep("a"), "a").join(rep("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    whole = components(between.unionByName(own))
    return (
        every.select("id").distinct().join(whole, "id", "left")
        .select(F.col("id").alias(key), F.coalesce("component", "id").alias("class_id"))
    )


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its class; of a repeated id one row stays. Null ids stay."""
    found = near_duplicates(docs, similarity=similarity)
    gone = narrow_side(materialize(found.where(F.col("doc_id") != F.col("class_id")).select("doc_id"), "removed-ids"))
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = materialize(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if twice.isEmpty():
        return kept
    side = narrow_side(twice)
    return kept.join(side, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(side, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns))
