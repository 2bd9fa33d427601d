"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

1. Equal vectors form one class; its smallest id stands for it.
2. Rotations are learned by iterative quantisation on a bounded hash sample of the classes: rotate, take
   signs, rotate towards the signs, repeat. Signs under a rotation are a binary code. Vectors are not
   centred, so that the share of differing bits follows the angle wherever the data lie. Vectors of more than
   64 components are turned inside a random 64-dimensional subspace, another one for every rotation: angles are
   kept there on average, wherever a pair differs, and no direction is left out of all tables.
3. Every code is cut into substrings, each the key of one Hamming table. The substring length grows with
   the logarithm of the number of classes, which keeps tables' buckets small, and the number of rotations
   follows from it so that a pair at the threshold meets in some table with probability `recall`.
4. Members of a bucket whose whole codes are near enough are compared by cosine on the original vectors
   in double precision. A pair counts in the first table in which it meets, so nothing is counted twice.
5. Links are counted per class on the spot; for components only a forest of each bundle's links travels.

Large buckets are cut into blocks (see bundles). Recall is measured in the tests against brute force.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different length do not link; an id that repeats keeps its least vector and gives one row; a
null id gives one row without links and component; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialize
from .arrays import mix
from .bundles import bundles, forest, in_blocks, pairs
from .components import components
from .vectors import exact_products, matrix, prepared

SAMPLE_ROWS = 10_000
BUCKET_ROWS = 32
MOST_BITS = 64


def learn_rotation(sample: np.ndarray, dim: int, seed: int, rounds: int = 25) -> np.ndarray:
    """(dim, bits) projection: a random subspace if there are more than 64 components, then ITQ inside it."""
    bits = min(dim, MOST_BITS)
    rng = np.random.default_rng([dim, seed])
    base = np.eye(dim)
    if dim > bits:
        base = np.linalg.qr(rng.normal(size=(dim, bits)))[0]
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    if len(sample):
        flat = sample @ base
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
            turn = (u @ w).T
    return base @ turn


class Tables:
    """The learned rotations of each vector length and the cut of their codes into table keys."""

    def __init__(self, sample: dict[int, np.ndarray], n: int, threshold: float, recall: float):
        flip = math.acos(threshold) / math.pi
        self.width = max(4, math.ceil(math.log2(max(n, 1) / BUCKET_ROWS + 1)))
        self.sample, self.recall, self.flip = sample, recall, flip
        self.rotations: dict[int, list[np.ndarray]] = {}

    def shape(self, dim: int) -> tuple[int, int, int]:
        """(bits per key, keys per rotation, rotations)."""
        bits = min(dim, MOST_BITS)
        width = min(self.width, bits)
        meet = (1 - self.flip) ** width
        tables = math.ceil(math.log(1 - self.recall) / math.log(1 - meet))
        per = max(1, bits // width)
        return width, per, math.ceil(tables / per)

    def rotation(self, dim: int) -> list[np.ndarray]:
        if dim not in self.rotations:
            rows = self.sample.get(dim, np.zeros((0, dim)))
            self.rotations[dim] = [learn_rotation(rows, dim, s) for s in range(self.shape(dim)[2])]
        return self.rotations[dim]

    def bound(self, dim: int) -> int:
        """Differing bits of all codes up to which a pair is compared: a pair at the threshold practically never has more."""
        bits = self.shape(dim)[2] * min(dim, MOST_BITS)
        return bits if bits < 128 else int(bits * self.flip + 6 * math.sqrt(bits * self.flip * (1 - self.flip))) + 1

    def fitted(self) -> Tables:
        for dim in self.sample:
            self.rotation(dim)
        self.sample = {}
        return self

    def codes(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, rotations) codes as 64-bit integers and (rows, tables) keys."""
        dim = v.shape[1]
        width, per, _ = self.shape(dim)
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        codes = []
        for turn in self.rotation(dim):
            bits = (unit @ turn >= 0).astype(np.uint64)
            codes.append((bits << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64))
        code = np.stack(codes, axis=1)
        mask = np.uint64((1 << width) - 1) if width < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)
        parts = [(code >> np.uint64(k * width)) & mask for k in range(per)]
        keys = np.stack(parts, axis=2).reshape(len(v), -1)
        return code, mix(keys * np.uint64(0x9E3779B97F4A7C15) + np.arange(keys.shape[1], dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def links(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Rows (a, b, n) from classes (id, dim, v, size): where b is null, a has n links more; else a and b are joined."""
    classes = materialize(classes, "vector-classes")
    n = classes.count()
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    picked = classes.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("dim", "v").toPandas()
    sample = {int(d): (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(np.stack(g["v"].to_list()).astype(float)) for d, g in picked.groupby("dim")}
    shared = classes.sparkSession.sparkContext.broadcast(Tables(sample, n, threshold, recall).fitted())

    def code(batches):
        tables = shared.value
        for b in batches:
            dims = np.asarray(b.column("dim"))
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                codes, keys = tables.codes(matrix(part.column("v"), dim).astype(float))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))],
                    names=[*part.schema.names, "codes", "keys"],
                )

    vector = dict(classes.dtypes)["v"]
    kind = dict(classes.dtypes)["id"]
    coded = materialize(classes.mapInArrow(code, f"id {kind}, dim int, v {vector}, size bigint, codes binary, keys array<bigint>"), "codes")
    members = in_blocks(coded.select("dim", "id", F.posexplode("keys").alias("table", "key")), ["dim", "table", "key"], "id")
    group = ["dim", "table", "key", "left", "right"]
    rows = members.join(coded.select("id", "v", "size", "codes"), "id").repartition(*group).sortWithinPartitions(*group)

    def compare(batches):
        for table, starts in bundles(batches, group, 20_000):
            dims = table.column("dim").to_numpy()
            cuts = np.flatnonzero(np.diff(dims[starts])) + 1
            for own in np.split(starts, cuts):
                if not len(own):
                    continue
                end = table.num_rows if own[-1] == starts[-1] else int(starts[np.searchsorted(starts, own[-1]) + 1])
                yield from _compare(table.slice(int(own[0]), end - int(own[0])), own - own[0], shared.value, threshold, kind)

    return rows.mapInArrow(compare, f"a {kind}, b {kind}, n bigint")


def _compare(table: pa.Table, starts: np.ndarray, tables: Tables, threshold: float, kind: str):
    dim = table.column("dim")[0].as_py()
    n = table.num_rows
    ids, size, number, side = (table.column(c).to_numpy() for c in ("id", "size", "table", "side"))
    apart = table.column("left").to_numpy() != table.column("right").to_numpy()
    v = matrix(table.column("v"), dim).astype(float)
    v_norm = np.sqrt((v * v).sum(axis=1))
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint64).reshape(n, -1)
    width, per, turns = tables.shape(dim)
    most = tables.bound(dim)
    mask = np.uint64((1 << width) - 1) if width < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)
    found_i, found_j = [], []
    for i, j in pairs(starts, n):
        ok = ~(apart[i] & (side[i] == side[j]))
        i, j = i[ok], j[ok]
        differ = np.zeros(len(i), np.int64)
        for t in range(turns):
            differ += np.bitwise_count(codes[i, t] ^ codes[j, t])
        near = differ <= most
        i, j = i[near], j[near]
        for at in range(0, len(i), 50_000):
            x, y = i[at : at + 50_000], j[at : at + 50_000]
            close = exact_products(v[x], v[y]) / (v_norm[x] * v_norm[y]) >= threshold
            x, y = x[close], y[close]
            first = np.full(len(x), -1)
            for t in range(turns * per):
                turn, k = divmod(t, per)
                same = ((codes[x, turn] ^ codes[y, turn]) >> np.uint64(k * width)) & mask == 0
                first[(first < 0) & same] = t
            here = first == number[x]
            found_i.append(x[here])
            found_j.append(y[here])
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_i, found_j))
    if not len(i):
        return
    count = np.bincount(i, weights=size[j], minlength=n) + np.bincount(j, weights=size[i], minlength=n)
    has = np.flatnonzero(count)
    child, root = forest(i, j, n)
    a = np.concatenate([ids[has], ids[child]])
    b = np.concatenate([np.zeros(len(has), ids.dtype), ids[root]])
    void = np.arange(len(a)) < len(has)
    amount = np.concatenate([count[has].astype(np.int64), np.zeros(len(child), np.int64)])
    types = {"bigint": pa.int64(), "int": pa.int32()}
    yield pa.RecordBatch.from_arrays([pa.array(a, types[kind]), pa.array(b, types[kind], mask=void), pa.array(amount)], names=["a", "b", "n"])


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, recall: float = 0.998) -> DataFrame:
    """(id, n_links, component_id, kept) of every id: vectors at or above the cosine threshold are linked."""
    rows = materialize(prepared(df, key, vector), "vectors")
    classes = rows.groupBy("dim", "v").agg(F.min("id").alias("rep"), F.count("id").alias("size"))
    members = rows.join(classes, ["dim", "v"]).select("id", "rep", "size")
    found = materialize(links(classes.select(F.col("rep").alias("id"), "dim", "v", "size"), threshold, recall), "vector-links")
    more = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    whole = components(found.where(F.col("b").isNotNull())).select(F.col("id").alias("rep"), "component")
    each = members.join(more, "rep", "left").join(whole, "rep", "left").select(
        "id", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    everyone = df.select(F.col(key).alias("id")).distinct()
    return everyone.join(each, "id", "left").select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").cast("long").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
