"""Join sides of a checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# At most this many entries of a few numbers each are broadcast; a larger side is joined by an exchange.
BROADCAST_ENTRIES = 1_000_000


def narrow_side(df: DataFrame, entries: Column | None = None, most: int = BROADCAST_ENTRIES) -> DataFrame:
    """A written table marked for broadcast if it has at most `most` entries: its rows, or what `entries` adds up to per row."""
    total = F.count(F.lit(1)) if entries is None else F.count(F.lit(1)) + F.coalesce(F.sum(entries), F.lit(0))
    return F.broadcast(df) if df.agg(total).first()[0] <= most else df
