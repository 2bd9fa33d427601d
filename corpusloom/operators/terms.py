"""Exact spellings from large term dictionaries: phrases are found by hashed words before any pattern runs.

`functions.text.canonicalize_terms` tries every term on every text. Here texts and terms meet on whole
runs of words first, so a text only sees the few terms whose words it holds in a row, whatever the size of the dictionary. The
rule that puts the spellings in is the same one, so results are equal. Dictionaries and hits are as long as their tables,
whose files tell Spark far too small a size, so they are joined by an exchange and never sent through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.strings import let, strip, text_or_empty
from ..functions.text import canonicalize_terms


# The characters beyond ASCII that patterns without case take for a Latin letter, and those letters.
_OTHER_CASE, _LATIN = "\u017f\u0131\u0130\u212a", "siik"


def _words(text: Column) -> Column:
    """Runs of letters and digits, case folded as the patterns do. A hit of a term begins and ends with whole runs."""
    return F.regexp_extract_all(F.lower(F.translate(text, _OTHER_CASE, _LATIN)), F.lit("[a-z0-9]+"), F.lit(0))


def _runs(text: Column, lengths: Column) -> Column:
    """Hashes of the runs of neighbouring words that have one of the lengths."""
    none = F.array().cast("array<bigint>")
    of_length = lambda words, n: F.when(
        F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda k: F.xxhash64(F.slice(words, k, n)))
    ).otherwise(none)
    return let(_words(text), lambda words: F.array_distinct(F.flatten(F.transform(lengths, lambda n: of_length(words, n)))))


def term_keys(terms: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, pos, term, words, run): each usable term with its number of words and the hash of them all."""
    clean = terms.select(*scope, "pos", strip(text_or_empty(F.col("term"))).alias("term")).where(F.col("term").rlike("[A-Za-z]"))
    firsts = clean.groupBy(*scope, "term").agg(F.min("pos").alias("pos")).withColumn("__w", _words(F.col("term")))
    return firsts.select(*scope, "pos", "term", F.size("__w").alias("words"), F.xxhash64("__w").alias("run"))


def terms_in(texts: DataFrame, terms: DataFrame, key: list[str], text: str = "text", scope: list[str] | None = None) -> DataFrame:
    """(key, terms): per text the dictionary terms it may hold, in dictionary order.

    `terms` has pos and term, and the columns of `scope` if each group of texts has a dictionary of its own. A
    text meets a term only if it holds all words of it in a row, so terms that begin alike cost nothing more.
    """
    scope = scope or []
    keyed = term_keys(terms, scope)
    lengths = F.sort_array(F.collect_set("words"))
    if scope:
        sized = texts.join(keyed.groupBy(*scope).agg(lengths.alias("__lengths")).hint("merge"), scope)
    else:
        sized = texts.withColumn("__lengths", keyed.agg(lengths).scalar())
    rows = sized.select(*key, *[c for c in scope if c not in key], F.explode(_runs(text_or_empty(F.col(text)), F.col("__lengths"))).alias("run"))
    met = rows.join(keyed.hint("merge"), [*scope, "run"]).select(*key, F.struct("pos", "term").alias("__t"))
    return met.groupBy(*key).agg(F.sort_array(F.collect_set("__t")).alias("__t")).select(*key, F.transform("__t", lambda t: t["term"]).alias("terms"))


def canonicalized(texts: DataFrame, terms: DataFrame, key: list[str], text: str = "text", scope: list[str] | None = None) -> DataFrame:
    """The texts with every whole-word hit of a dictionary term in its exact spelling; `key` names a row."""
    found = terms_in(texts, terms, key, text, scope)
    joined = texts.join(found.hint("merge"), key, "left")
    return joined.withColumn(text, F.when(F.col("terms").isNull(), F.col(text)).otherwise(canonicalize_terms(F.col(text), F.col("terms")))).select(*texts.columns)
