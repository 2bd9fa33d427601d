"""Whole groups from key-sorted Arrow batches, and the pairs inside them, without one call per group.

Groups that may be large are first cut into blocks: each pair of blocks of one group becomes a group of
its own, so a group holds at most two blocks whatever the data are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import give_back

BLOCK_ROWS = 1024


def in_blocks(df: DataFrame, group: list[str], member: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of groups of two members or more with `left`, `right` and `side`.

    A group of n members has ceil(n / rows) blocks; a row comes once for every pair of blocks that has
    its own. `side` is the row's block: where left differs from right, only pairs across the sides count.
    """
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    cut = df.join(sizes, group).withColumn("__b", F.ceil(F.col("__n") / rows).cast("int"))
    side = F.pmod(F.xxhash64(F.lit(7), member), F.col("__b")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("__b") - 1))
    return (
        cut.withColumn("side", side).withColumn("__o", other)
        .withColumn("left", F.least("side", "__o")).withColumn("right", F.greatest("side", "__o"))
        .drop("__n", "__b", "__o")
    )


def heads(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a group begins."""
    change = np.zeros(table.num_rows, bool)
    if len(change):
        change[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def bundles(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 100_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, group starts): runs of whole groups of about `rows` rows. The input is sorted by integer keys."""
    try:
        yield from _bundles(batches, keys, rows)
    finally:
        give_back()


def _bundles(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            starts = heads(table, keys)
            last = int(starts[-1])
            if last:
                yield table.slice(0, last), starts[:-1]
            held = table.slice(last).combine_chunks().to_batches()
            n -= last
    if held:
        table = pa.Table.from_batches(held)
        yield table, heads(table, keys)


def pairs(starts: np.ndarray, n: int, limit: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j), i < j, of rows of one group, about `limit` at a time."""
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    more = ends - np.arange(n) - 1
    total = np.concatenate([[0], np.cumsum(more)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        count = more[at:to]
        if count.sum():
            i = np.repeat(np.arange(at, to), count)
            j = np.arange(count.sum()) - np.repeat(total[at:to] - total[at], count) + i + 1
            yield i, j
        at = to


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, root) of every row that a link joins to a smaller row: fewer links with the same components."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            moved = np.flatnonzero(label != np.arange(n))
            return moved, label[moved]
