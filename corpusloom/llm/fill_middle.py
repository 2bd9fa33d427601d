"""Fill-in-the-middle form of documents: two cuts at line ends, parts reordered around sentinels.

A text is cut into n units, its lines with their line feeds. Hashes of the document id choose the two cuts,
whether the text is transformed at all, and the order of its parts (see `draws`).

The cuts are numbers of units; where such a unit ends in the text is a select query, answered on words of
eight bytes (SWAR) over a whole slice of texts at a time:

1. The UTF-8 bytes are viewed as uint64. Plain arithmetic sets the high bit of each byte of a word that ends
   a unit: zero bytes of word ^ 0x0A0A... are found exactly, without carries between bytes.
2. bitwise_count gives the unit ends of each word, their running sum is searched for the word that holds the
   k-th one, and inside that word the lowest marks are cleared until the k-th is left; its place is the count
   of the bits below it.
3. Code points up to a place are counted alike: bytes that do not continue a character, whole words from the
   running sum and the last word masked.

Work and memory follow the slice, not the number of its lines, and no list of lines is ever made.

Defined cases: a null text is empty and stays plain; texts that hold a sentinel stay plain; a text without a
line feed is one unit; a null id is drawn as an empty one; each row is treated on its own, so equal rows give
equal results; extra columns are kept by `fill_in_middle`; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .arrays import Texts, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
_U = np.uint64
_LOW, _HIGH, _FEEDS = _U(0x7F7F7F7F7F7F7F7F), _U(0x8080808080808080), _U(0x0A0A0A0A0A0A0A0A)


def as_words(raw: np.ndarray) -> np.ndarray:
    """Bytes as little-endian words, the last one filled up with continuation bytes, which mark nothing."""
    whole = np.full(-(-len(raw) // 8) * 8, 0x80, np.uint8)
    whole[: len(raw)] = raw
    return whole.view("<u8")


def feed_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is a line feed."""
    other = words ^ _FEEDS
    return ~(((other & _LOW) + _LOW) | other | _LOW)


def start_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that begins a code point."""
    return (~words | (words << _U(1))) & _HIGH


class Marks:
    """Rank and select over the marked bytes of a buffer."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), dtype=np.int64, out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before byte number `at`."""
        word = at >> 3
        below = (_U(1) << ((at & 7) << 3).astype(np.uint64)) - _U(1)
        own = np.append(self.marks, _U(0))[word] & below
        return self.before[word] + np.bitwise_count(own)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte number of the k-th marked byte, counted from 0."""
        word = np.searchsorted(self.before, k, side="right") - 1
        own, skip = self.marks[word].copy(), k - self.before[word]
        for turn in range(7):
            more = skip > turn
            if not more.any():
                break
            own[more] &= own[more] - _U(1)
        return word * 8 + (np.bitwise_count((own & (~own + _U(1))) - _U(1)) >> 3)


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four whole numbers below 2**32 from the hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cut(texts: Texts, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Units of each text, and bytes and code points before its first and its second cut."""
    words = as_words(texts.bytes)
    feeds, starts = Marks(feed_marks(words)), Marks(start_marks(words))
    begin, end = texts.offsets[:-1], texts.offsets[1:]
    done = feeds.rank(begin)
    inner = feeds.rank(end) - done
    filled = end > begin
    open_end = filled.copy()
    open_end[filled] = texts.bytes[end[filled] - 1] != 0x0A
    units = inner + open_end
    places, chars = [], []
    first, second = h1 % (units + 1), h2 % (units + 1)
    for taken in (np.minimum(first, second), np.maximum(first, second)):
        at = np.where(taken > inner, end, begin)
        by_feed = (taken > 0) & (taken <= inner)
        at[by_feed] = feeds.select(done[by_feed] + taken[by_feed] - 1) + 1
        places.append(at - begin)
        chars.append(starts.rank(at) - starts.rank(begin))
    return units, places[0], places[1], chars[0], chars[1]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 100, spm_rate: int = 50, seed: int = SEED) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output): percentages `rate` of transformed texts and, of those, `spm_rate` with the suffix first."""
    kind = dict(docs.dtypes)[key]
    h = draws(F.col("key"), seed)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    holds = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | holds | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    drawn = rows.select("key", "text", h[0].alias("h1"), h[1].alias("h2"), form.alias("form"))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches):
        for part in slices(batches, "text"):
            texts = Texts(part.column("text"))
            units, a, b, before, until = cut(texts, part.column("h1").to_numpy(), part.column("h2").to_numpy())
            raw, forms, out = texts.bytes.tobytes(), part.column("form").to_pylist(), []
            for k, (x, y, form) in enumerate(zip(a.tolist(), b.tolist(), forms)):
                own = raw[texts.offsets[k] : texts.offsets[k + 1]]
                if form == "plain":
                    out.append(own)
                elif form == "psm":
                    out.append(b"".join((p, own[:x], s, own[y:], m, own[x:y])))
                else:
                    out.append(b"".join((s, own[y:], p, own[:x], m, own[x:y])))
            no = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"), pa.array(units.astype(np.int64)), part.column("form"), pa.array(before.astype(np.int64), mask=no),
                    pa.array((until - before).astype(np.int64), mask=no), pa.array(out, pa.binary()).cast(pa.string()),
                ],
                names=["key", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    found = drawn.mapInArrow(run, f"key {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return found.withColumnRenamed("key", key)


def restored(output: Column, form: Column) -> Column:
    """The text from its transformed form; a transformed text holds each sentinel once."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))
