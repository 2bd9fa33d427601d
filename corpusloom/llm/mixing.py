"""Temperature mixing of sources, realised as block permutations within a token budget.

1. Every source has a share p of the tokens; its weight is p**a, normalised. The exponent a lies on a grid
   of 1/4096 from 0 (all sources alike) to 1 (as they are).
2. The largest exponent whose weights reach the target entropy is searched by bisection; if a source would
   then be repeated more often than allowed, the smallest larger exponent that keeps the limit is taken.
   Both measures fall as the exponent grows. One aggregate over the source table tries fifteen exponents,
   that is four halvings, so there are three passes for each target.
3. Weight times budget is a source's quota of tokens: whole passes over the source, and a rest.
4. A source is cut into blocks by a hash of its documents. The rest is filled in a pseudo-random order
   of the blocks; the block in which it ends is cut by document hash, never exceeding the quota.

All decisions are columns of narrow tables keyed by source or by block, so texts need not be exchanged.
Running totals go over groups of blocks first and over the blocks of one group then.

Defined cases: a null source is the source ''; a null text has no tokens; documents without tokens follow
their block; a null id hashes like the word null; repeated rows are decided alike; sources without tokens
are left out once; extra columns are kept. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..runtime import materialize
from .sides import narrow_side

GRID = 4096
ENTROPY, REPEATS = 0.98, 2.0
BLOCK_TOKENS = 1 << 16
_GROUP = 1 << 20


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def _number(text: Column) -> Column:
    """The first 60 bits of the MD5 sum."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def place(source: Column, key: Column) -> Column:
    """Position of a document in its source's hash order."""
    return _number(F.concat_ws("|", source, F.coalesce(key.cast("string"), F.lit("null"))))


@dataclass(frozen=True)
class Mix:
    exponent: float
    sources: DataFrame  # source, tokens, quota, passes, rest, blocks
    ends: DataFrame  # source, block, whole, cut: blocks of the partial pass


def _exponent(shares: DataFrame, n: int, smallest: float, repeats_at_one: float, entropy: float, repeats: float) -> int:
    """Grid number of the exponent."""

    def measures(numbers: list[int]) -> dict[int, tuple[float, float]]:
        p = F.col("p")
        row = shares.agg(*[x for k in numbers for x in (F.sum(F.pow(p, F.lit(k / GRID))), F.sum(F.pow(p, F.lit(k / GRID)) * F.log(p)))]).first()
        found = {}
        for at, k in enumerate(numbers):
            total, logs = row[2 * at], row[2 * at + 1]
            a = k / GRID
            found[k] = (math.log(total) - a * logs / total, repeats_at_one * smallest ** (a - 1) / total)
        return found

    def last_true(low: int, high: int, holds) -> int:
        """Largest number in [low, high) from which on `holds` fails; holds(low) is true, holds(high) false."""
        while high - low > 1:
            step = max(1, (high - low) // 16)
            tried = list(range(low + step, high, step))
            at = measures(tried)
            good = [k for k in tried if holds(at[k])]
            low = max([low, *good])
            high = min([high, *[k for k in tried if k > low]])
        return low

    enough = lambda m: m[0] >= entropy * math.log(n) - 1e-12
    too_often = lambda m: m[1] > repeats + 1e-12
    ends = measures([0, GRID])
    chosen = GRID if enough(ends[GRID]) else 0 if not enough(ends[0]) else last_true(0, GRID, enough)
    if chosen < GRID and too_often(measures([chosen])[chosen]):
        chosen = GRID if too_often(ends[GRID]) else last_true(chosen, GRID, too_often) + 1
    return chosen


def plan(light: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, block_tokens: int = BLOCK_TOKENS) -> Mix | None:
    """Mixing plan of (source, place, tokens); None if there are no tokens. The budget is all tokens by default."""
    sizes = materialize(light.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "sources")
    n, total, least = sizes.agg(F.count("source"), F.sum("tokens"), F.min("tokens")).first()
    if not n:
        return None
    budget = total if budget is None else budget
    shares = sizes.withColumn("p", F.col("tokens") / F.lit(total))
    k = _exponent(shares, n, least / total, budget / total, entropy, repeats)
    norm = shares.agg(F.sum(F.pow("p", F.lit(k / GRID)))).first()[0]
    quota = F.round(F.pow("p", F.lit(k / GRID)) / F.lit(norm) * F.lit(budget)).cast("long")
    sources = materialize(
        shares.withColumn("quota", quota).select(
            "source", "tokens", "quota", F.expr("quota div tokens").alias("passes"), F.expr("quota % tokens").alias("rest"),
            F.ceil(F.col("tokens") / block_tokens).cast("long").alias("blocks"),
        ),
        "mix",
    )
    rows = light.join(narrow_side(sources.select("source", "passes", "rest", "blocks")), "source").withColumn("block", F.col("place") % F.col("blocks"))
    # Order of the blocks in the partial pass, in groups of neighbours so that no running total is long.
    blocks = rows.groupBy("source", "block", "passes", "rest").agg(F.sum("tokens").alias("n")).withColumn("turn", _number(F.concat_ws("|", "source", "block", "passes")))
    blocks = materialize(blocks.withColumn("part", F.shiftright("turn", 48)), "mix-blocks")
    parts = blocks.groupBy("source", "part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("n").over(W.partitionBy("source", "part").orderBy("turn", "block").rowsBetween(W.unboundedPreceding, W.currentRow))
    done = blocks.withColumn("upto", inside).join(parts.select("source", "part", before.alias("before")), ["source", "part"]).withColumn("upto", F.col("upto") + F.col("before"))
    ends = materialize(
        done.where(F.col("upto") - F.col("n") < F.col("rest"))
        .select("source", "block", (F.col("upto") <= F.col("rest")).alias("whole"), (F.col("rest") - F.col("upto") + F.col("n")).alias("left")),
        "mix-ends",
    )
    # In the one block per source where the rest ends: the last place that still fits.
    last = rows.join(narrow_side(ends.where(~F.col("whole")).select("source", "block", "left")), ["source", "block"])
    along = W.partitionBy("source", "block").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    fits = last.groupBy("source", "block", "left", "place").agg(F.sum("tokens").alias("n")).withColumn("upto", F.sum("n").over(along)).where(F.col("upto") <= F.col("left"))
    cut = fits.groupBy("source", "block").agg(F.max("place").alias("cut"))
    return Mix(k / GRID, sources, materialize(ends.join(cut, ["source", "block"], "left").select("source", "block", "whole", F.coalesce("cut", F.lit(-1)).alias("cut")), "mix-cuts"))


def with_copies(docs: DataFrame, mix: Mix, source: str = "source", key: str = "doc_id") -> DataFrame:
    """The rows of `docs` with `__block` and `__copies`, how often each is taken."""
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    side = narrow_side(mix.sources.select(F.col("source").alias("__source"), "passes", "blocks").toDF("__source", "__passes", "__blocks"))
    ends = narrow_side(mix.ends.toDF("__s", "__b", "__whole", "__cut"))
    placed = docs.withColumn("__name", name).withColumn("__place", place(F.col("__name"), F.col(key)))
    known = placed.join(side, placed["__name"] == side["__source"]).withColumn("__block", F.col("__place") % F.col("__blocks"))
    full = known.join(ends, (F.col("__name") == F.col("__s")) & (F.col("__block") == F.col("__b")), "left")
    more = F.coalesce((F.col("__whole") | (F.col("__place") <= F.col("__cut"))).cast("long"), F.lit(0))
    return full.withColumn("__copies", F.col("__passes") + more).select(*docs.columns, "__block", "__copies")


def light_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, place, tokens) of every document, written once."""
    name = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return materialize(docs.select("doc_id", name.alias("source"), place(name, F.col("doc_id")).alias("place"), token_count(F.col("text")).alias("tokens")), "tokens")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, same columns; a document taken several times comes as so many rows."""
    found = plan(light_rows(docs), **options)
    if found is None:
        return docs.limit(0)
    often = with_copies(docs, found).where(F.col("__copies") > 0)
    return often.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
