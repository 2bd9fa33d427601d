"""Bounded samples of labelled rows for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Bound of every training sample, in labelled rows. A larger label table is thinned by a hash of the id.
SAMPLE_ROWS = 20_000
_SPACE = 1 << 30


def held_out(key: Column) -> Column:
    """True for the fifth of the ids kept away from training; a null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, key: str, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(key, label) of about `rows` labelled ids that are not held out; one label per id (the least)."""
    known = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
        .where(F.col("key").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("key")))
        .groupBy("key").agg(F.min("label").alias("label"))
    )
    n = known.count()
    if n <= rows:
        return known
    return known.where(F.pmod(F.xxhash64("key"), F.lit(_SPACE)) < F.lit(int(_SPACE * rows / n)))
