"""Ordered operators over long groups: numbering, neighbours, runs, text parts.

A plain window puts a whole group in one task. Here a group is cut into blocks along its
order; each block is its own window partition, and a small table with one row per block
carries what the blocks before it add up to. A group that holds a third of all rows is
spread like any other data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK_ROWS = 1 << 16
# A text is joined in parts of at most this many rows, so that no cell is unbounded.
PART_ROWS = 1 << 16
_BLK, _KEY = "__block", "__key"


def block_of(position: Column, rows: int = BLOCK_ROWS) -> Column:
    """Block number of an integer position."""
    return F.floor(position / F.lit(rows)).cast("long")


def _keyed(df: DataFrame, group: list[str], block: Column) -> DataFrame:
    """Adds the block and one key column for window and carry join, so that both use one exchange.

    The key is a struct: it is never null itself, and equal nulls inside it are equal, so rows with null
    group values are kept without a null-safe join, which would deal the rows out once more.
    """
    return df.withColumn(_BLK, block).withColumn(_KEY, F.struct(*group, _BLK))


def _attach(df: DataFrame, carry: DataFrame) -> DataFrame:
    """Join a carry table of one row per key."""
    return df.join(carry, _KEY).drop(_KEY, _BLK)


def with_row_number(
    df: DataFrame, group: list[str], order: list, block: Column, name: str
) -> DataFrame:
    """1-based number of each row in its group; `block` must not decrease along the order."""
    cut = _keyed(df, group, block)
    sizes = cut.groupBy(*group, _BLK).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(
        W.partitionBy(*group).orderBy(_BLK).rowsBetween(W.unboundedPreceding, -1)
    )
    carry = sizes.select(F.struct(*group, _BLK).alias(_KEY), F.coalesce(before, F.lit(0)).alias("__before"))
    local = F.row_number().over(W.partitionBy(_KEY).orderBy(*order))
    return (
        _attach(cut.withColumn("__local", local), carry)
        .withColumn(name, (F.col("__local") + F.col("__before")).cast("long"))
        .drop("__local", "__before")
    )


def with_neighbour(
    df: DataFrame, group: list[str], order: str, block: Column, value: Column, name: str, *, after: bool
) -> DataFrame:
    """Value of the next (`after`) or previous row of the group, null at its end."""
    cut = _keyed(df, group, block).withColumn("__v", F.struct(value.alias("v")))
    edge = (F.min_by if after else F.max_by)("__v", order)
    edges = cut.groupBy(*group, _BLK).agg(edge.alias("__edge"))
    shift = F.lead if after else F.lag
    carry = edges.select(
        F.struct(*group, _BLK).alias(_KEY), shift("__edge").over(W.partitionBy(*group).orderBy(_BLK)).alias("__carry")
    )
    local = shift("__v").over(W.partitionBy(_KEY).orderBy(order))
    return (
        _attach(cut.withColumn("__local", local), carry)
        .withColumn(name, F.coalesce("__local", "__carry")["v"])
        .drop("__v", "__local", "__carry")
    )


def run_edges(df: DataFrame, group: list[str], position: str, key: Column, rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block: `__carry`, where the run that its first row belongs to began, and `__goes_on`, whether its last run does.

    Reads the group, the position and what `key` needs, nothing else.
    """
    inside = W.partitionBy(_KEY).orderBy(position)
    marked = _keyed(df.select(*group, position, F.struct(key.alias("k")).alias("__k")), group, block_of(F.col(position), rows))
    before = F.lag("__k").over(inside)
    marked = marked.withColumn("__change", F.when(before.isNotNull() & (before != F.col("__k")), F.col(position)))
    # Grouped by the window's own key, so the rows are not dealt out again.
    edges = marked.groupBy(_KEY).agg(
        F.min_by("__k", position).alias("__head"),
        F.max_by("__k", position).alias("__tail"),
        F.min(position).alias("__at"),
        F.max("__change").alias("__last"),
    ).select(_KEY, *[F.col(_KEY)[c].alias(c) for c in (*group, _BLK)], "__head", "__tail", "__at", "__last")
    along = W.partitionBy(*group).orderBy(_BLK)
    tail = F.lag("__tail").over(along)
    edges = edges.withColumn(
        "__edge", F.when(tail.isNull() | (tail != F.col("__head")), F.col("__at"))
    ).withColumn("__last", F.coalesce("__last", "__edge"))
    older = F.last("__last", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))
    goes_on = F.coalesce(F.lead("__head").over(along) == F.col("__tail"), F.lit(False))
    return edges.select(_KEY, F.coalesce(F.col("__edge"), older).alias("__carry"), goes_on.alias("__goes_on"), F.col("__last").alias("__last"))


def with_runs(
    df: DataFrame, group: list[str], position: str, key: Column, name: str, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Position of the first row of the run of equal `key` values each row belongs to."""
    carry = run_edges(df, group, position, key, rows).select(_KEY, "__carry")
    return _attach(local_runs(df, group, position, key, rows), carry).withColumn(name, F.coalesce("__run", "__carry")).drop("__run", "__carry")


def local_runs(df: DataFrame, group: list[str], position: str, key: Column, rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds `__key`, the block, and `__run`: where the row's run began, if that is a change inside its block."""
    inside = W.partitionBy(_KEY).orderBy(position)
    cut = _keyed(df, group, block_of(F.col(position), rows)).withColumn("__k", F.struct(key.alias("k")))
    before = F.lag("__k").over(inside)
    changed = cut.withColumn("__change", F.when(before.isNotNull() & (before != F.col("__k")), F.col(position)))
    running = F.max("__change").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    return changed.withColumn("__run", running).drop("__k", "__change")


def as_of(df: DataFrame, marks: DataFrame, group: list[str], at: Column, mark_at: str, block, name: str) -> DataFrame:
    """Adds `name`: the struct of the last mark of the group whose `mark_at` is not after the row's `at`, or null.

    Rows and marks are put together along the order, cut into blocks (`block` maps a place to a block number),
    and each row takes the last mark before it in its block; a block's first rows take the one value carried
    from the blocks before. Rows travel once, and no row meets more than one mark. Rows without a place get null.
    """
    value = F.struct(*marks.columns)
    flat = lambda rows, place: _keyed(rows.withColumn("__at", place), group, block(F.col("__at")))
    left = flat(df, at).withColumn("__side", F.lit(1)).withColumn("__mark", F.lit(None).cast(marks.select(value.alias("m")).schema["m"].dataType))
    right = flat(marks.select(*group, mark_at, value.alias("__mark")), F.col(mark_at)).where(F.col("__at").isNotNull()).withColumn("__side", F.lit(0))
    both = left.unionByName(right.select(*group, _BLK, _KEY, "__at", "__side", "__mark"), allowMissingColumns=True)
    order = W.partitionBy(_KEY).orderBy("__at", "__side")
    local = F.last("__mark", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    tails = right.groupBy(*group, _BLK).agg(F.max_by("__mark", "__at").alias("__tail"))
    blocks = left.select(*group, _BLK).distinct().withColumn("__tail", F.lit(None).cast(tails.schema["__tail"].dataType)).unionByName(tails)
    one = blocks.groupBy(*group, _BLK).agg(F.max_by("__tail", F.col("__tail").isNotNull()).alias("__tail"))
    carried = F.last("__tail", ignorenulls=True).over(W.partitionBy(*group).orderBy(_BLK).rowsBetween(W.unboundedPreceding, -1))
    carry = one.select(F.struct(*group, _BLK).alias(_KEY), carried.alias("__carry"))
    found = _attach(both.withColumn("__local", local).where(F.col("__side") == 1), carry)
    usable = F.when(F.col("__at").isNotNull(), F.coalesce("__local", "__carry"))
    return found.withColumn(name, usable).select(*df.columns, name)


def ordered_text(position: str, text: Column, sep: str) -> Column:
    """Aggregate: the texts of a bounded group joined in order of `position`."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), text.alias("t"))))
    return F.array_join(F.transform(pairs, lambda p: p["t"]), sep)


def part_of(position: Column, first: Column, rows: int = PART_ROWS) -> Column:
    """Part number of a row within its text; almost every text has the single part 0."""
    return F.floor((position - first) / F.lit(rows)).cast("long")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order, by a pre-aggregated minimum instead of a window."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    picked = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in (*order, *rest)]).select(*df.columns)
