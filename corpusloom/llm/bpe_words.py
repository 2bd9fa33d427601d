"""Byte-pair encoding through a table of distinct words.

1. Texts are split into words in Spark, one bounded chunk of texts at a time; the chunk keeps
   its distinct words and, per text, the positions of its words in that list.
2. The distinct words of all chunks meet in an exchange on the word. Equal words stand next to
   each other there, so each distinct word of the corpus is encoded once.
3. The ids go back to their chunk, packed into one row per chunk and bounded range of words, are joined by
   position, and decoded through the id-to-piece list.

The shuffle carries distinct words per chunk and positions, never one row per word occurrence, and
nothing is broadcast; every executor must be able to open the vocabulary file at the given path.

Defined cases: a null text is encoded as the empty text; every row gives one row, repeated ids and
repeated texts included; a null id stays null; other columns are not carried along.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .arrays import give_back, slices

CHUNK_BYTES = 12 << 20


def _ranges(kind: str, limit: int = 0x530) -> str:
    """Class members of a Unicode category among the code points below `limit` and their lower-case forms."""
    letters = {x for c in range(limit) for x in chr(c) + chr(c).lower()}
    return "".join(re.escape(x) for x in sorted(letters) if unicodedata.category(x)[0] == kind)


# Texts of these code points only, on which Python's and the tokenizer library's Unicode tables agree.
_PLAIN = re.compile(r"[\x00-\u052f\u2010-\u2027\u202a-\u202e\u2030-\u205e\u20a0-\u20bf\u2190-\u21ff]*")
_L, _N = _ranges("L"), _ranges("N")
_SPLIT = re.compile(rf"[{_L}]+|'(?:[stmd]|re|ve|ll)|[{_N}]|[^\t-\r \x85\xa0{_L}{_N}]+")


class Codec:
    """A vocabulary file of the word-end kind: special strings, merges, ids and pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.path, self.end = path, model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        self.ranks = {tuple(pair): k for k, pair in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.pieces = {i: p for p, i in self.vocab.items()} | {i: p for p, i in self.special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        # For the library's own splitting, which needs no merges: they would fill as much memory again.
        self._rules = json.dumps(data | {"added_tokens": [], "post_processor": None, "model": model | {"vocab": {}, "merges": [], "unk_token": None}})
        self._library = None

    def _plain_words(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text) and unicodedata.is_normalized("NFC", text):
            # Letter by letter: no rule for a sigma at a word's end.
            return _SPLIT.findall(text.replace("Σ", "σ").lower())
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._rules)
        text = self._library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        """Words in order; a special string counts as one word."""
        if "<|" not in text:
            return self._plain_words(text)
        parts = self.special_split.split(text)
        return [w for k, p in enumerate(parts) for w in ([p] if k % 2 else self._plain_words(p))]

    def encode(self, word: str) -> list[int]:
        """Ids of one word: the pair of lowest rank, leftmost first, is merged until none is left."""
        if word in self.special:
            return [self.special[word]]
        parts: list = [self.letters[b] for b in word.encode("utf-8")]
        parts[-1] += self.end
        whole = self.vocab.get("".join(parts)) if len(parts) == 1 else None
        if whole is not None:
            return [whole]
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or ranks.get((parts[i], parts[j])) != rank:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [self.vocab[p] for p in parts if p is not None]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _chunks(batches: Iterator[pa.RecordBatch], path: str, text: str, limit: int) -> Iterator[tuple[int, pa.RecordBatch, Iterator[list[str]]]]:
    """(chunk number, rows, words of each text). Numbers follow the partition and the order in it."""
    split = codec(path).words
    number = TaskContext.get().partitionId() << 20
    for part in slices(batches, text, limit):
        yield number, part, (split(v.as_py() or "") for v in part.column(text))
        number += 1


def _digest(words: list[str], texts: int) -> str:
    """What a chunk is, to see that two readings of the input cut it alike."""
    return hashlib.blake2b("\0".join(words).encode() + str(texts).encode(), digest_size=12).hexdigest()


def _pack(flat: np.ndarray) -> bytes:
    """Positions, byte by byte of all numbers, compressed."""
    return zstandard.compress(flat.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _coded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches with the ids of their column `word`; a word that equals the one before it is not encoded again."""
    encode, last, ids = codec(path).encode, None, None
    try:
        for batch in batches:
            out = []
            for word in batch.column(batch.schema.get_field_index("word")).to_pylist():
                if word != last:
                    last, ids = word, np.asarray(encode(word), "<u4").tobytes()
                out.append(ids)
            yield batch, out
    finally:
        give_back()


def encode_words(df: DataFrame, path: str) -> DataFrame:
    """The distinct-word table: one row (word, ids) per distinct value of column `word`."""

    def run(batches):
        for batch, ids in _coded(batches, path):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, "ids"])

    schema = StructType([*df.schema.fields, StructField("ids", BinaryType())])
    return df.repartition("word").sortWithinPartitions("word").mapInArrow(run, schema)


# Words of a range held until they are packed by chunk.
PACKED_WORDS = 1 << 19


def _packed_words(df: DataFrame, path: str) -> DataFrame:
    """(chunk, places, sizes, ids): the same table for words (chunk, place, word), packed; each distinct word is encoded once."""

    def pack(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        chunk, place, size, flat = (np.concatenate([h[k] for h in held]) for k in range(4))
        order = np.lexsort((place, chunk))
        begin = np.cumsum(size) - size
        chunk, place, size, begin = chunk[order], place[order], size[order], begin[order]
        flat = flat[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
        first = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
        last = np.append(first[1:], len(chunk))
        at = np.append(0, np.cumsum(size))
        gaps = lambda x: np.diff(x, prepend=0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(chunk[first]), pa.array([_pack(gaps(place[a:b])) for a, b in zip(first, last)], pa.binary()),
                pa.array([_pack(size[a:b]) for a, b in zip(first, last)], pa.binary()), pa.array([_pack(flat[at[a] : at[b]]) for a, b in zip(first, last)], pa.binary()),
            ],
            names=["chunk", "places", "sizes", "ids"],
        )

    def run(batches):
        held, n = [], 0
        for batch, ids in _coded(batches, path):
            if not batch.num_rows:
                continue
            size = np.array([len(x) for x in ids], np.int32) // 4
            # Copies: a view would hold the batch with its words.
            held.append((batch.column("chunk").to_numpy().copy(), batch.column("place").to_numpy().copy(), size, np.frombuffer(b"".join(ids), "<u4")))
            n += batch.num_rows
            if n >= PACKED_WORDS:
                yield pack(held)
                held, n = [], 0
        if held:
            yield pack(held)

    return df.repartition("word").sortWithinPartitions("word").mapInArrow(run, "chunk bigint, places binary, sizes binary, ids binary")


def encode_texts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", chunk_bytes: int | None = None) -> DataFrame:
    """One row per text: key, ids (binary, little-endian 32-bit) and the decoded text (UTF-8 bytes).

    A task holds a chunk of about `chunk_bytes` of text; smaller chunks need less memory and a larger exchange.
    """
    limit = chunk_bytes or CHUNK_BYTES
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = source.schema["key"].dataType.simpleString()

    def requests(batches):
        for number, part, split in _chunks(batches, path, "text", limit):
            seen: set[str] = set()
            for found in split:
                seen.update(found)
            words = sorted(seen)
            words.append(_digest(words, part.num_rows))
            for at in range(0, len(words), 50_000):
                own = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(own), pa.int64()), pa.array(range(at, at + len(own)), pa.int32()), pa.array(own, pa.string())],
                    names=["chunk", "place", "word"],
                )

    def positions(batches):
        for number, part, split in _chunks(batches, path, "text", limit):
            index: defaultdict[str, int] = defaultdict()
            index.default_factory = index.__len__
            places = [np.array(list(map(index.__getitem__, found)), np.uint32) for found in split]
            sizes = [len(p) for p in places]
            flat = np.concatenate(places)
            # Frequent words get small numbers, which compress better; `order` leads from them to the sorted words.
            by_count = np.argsort(-np.bincount(flat, minlength=len(index)), kind="stable")
            rank = np.empty(len(index), np.uint32)
            rank[by_count] = np.arange(len(index), dtype=np.uint32)
            words = list(index)
            place = np.empty(len(words), np.uint32)
            place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words), dtype=np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([_digest(sorted(words), part.num_rows)]),
                    pa.array([part.column("key").to_pylist()], pa.list_(part.column("key").type)),
                    pa.array([sizes], pa.list_(pa.int64())),
                    pa.array([_pack(rank[flat])], pa.binary()),
                    pa.array([_pack(place[by_count])], pa.binary()),
                ],
                names=["chunk", "digest", "keys", "sizes", "places", "order"],
            )

    table = _packed_words(source.mapInArrow(requests, "chunk bigint, place int, word string"), path)
    texts = source.mapInArrow(positions, f"chunk bigint, digest string, keys array<{key_type}>, sizes array<bigint>, places binary, order binary")

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        return _join(left, right, path)

    return texts.groupBy("chunk").cogroup(table.groupBy("chunk")).applyInArrow(join, f"key {key_type}, ids binary, decoded binary").withColumnRenamed("key", key)


def _join(texts: pa.Table, table: pa.Table, path: str) -> pa.Table:
    """Ids of a chunk's words joined to its texts by position."""
    own = codec(path)
    row = texts.to_pylist()[0] if texts.num_rows else {"keys": [], "sizes": []}
    keys, encoded, decoded = row["keys"], [], []
    if texts.num_rows:
        packed = lambda name: [_unpack(x) for x in table.column(name).to_pylist()]
        place = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(x.astype(np.int64)) for x in packed("places")]])
        size = np.concatenate([np.zeros(0, np.int64), *[x.astype(np.int64) for x in packed("sizes")]])
        raw = b"".join([x.tobytes() for x in packed("ids")])
        ids: list = [None] * len(place)
        begin = (np.cumsum(size) - size) * 4
        for k, a, b in zip(place.tolist(), begin.tolist(), (begin + size * 4).tolist()):
            ids[k] = raw[a:b]
        if not ids or ids[-1] != np.asarray(own.encode(row["digest"]), "<u4").tobytes():
            raise RuntimeError("a chunk of texts differs between two readings of the input; write the input to a table first")
        order = _unpack(row["order"]).tolist()
        ids = [ids[i] for i in order]
        pieces = own.pieces
        shown = [" ".join([pieces[i] for i in np.frombuffer(x, "<u4").tolist()]).encode() for x in ids]
        at, flat = 0, _unpack(row["places"])
        for size in row["sizes"]:
            places = flat[at : at + size].tolist()
            at += size
            encoded.append(b"".join(map(ids.__getitem__, places)))
            decoded.append(b" ".join(map(shown.__getitem__, places)))
    kind = texts.schema.field("keys").type.value_type
    give_back()
    return pa.table([pa.array(keys, kind), pa.array(encoded, pa.binary()), pa.array(decoded, pa.binary())], names=["key", "ids", "decoded"])
