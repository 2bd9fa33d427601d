import hashlib
import json
import unicodedata

import numpy as np
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import bpe_words
from corpusloom.llm.queries import op8, vocabulary

LIBRARY = Tokenizer.from_file(vocabulary())


def mine(text):
    codec = bpe_words.codec(vocabulary())
    return [i for w in codec.words(text) for i in codec.encode(w)]


def theirs(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=800, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    assert mine(text) == theirs(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["Hello", "'s", "'LL", " ", " ", " ", "<|endoftext|>", "<|EndOfText|>", "<|", "é", "é", "Σ", "ΑΣ", "İ", "ß", "12", "²", "!!", "漢字", "👩‍👧", "\x1c", "\x85", "aaaa"]), max_size=10))
def test_joined_pieces(parts):
    text = "".join(parts)
    assert mine(text) == theirs(text)


def test_every_letter_up_to_the_supplementary_planes():
    for c in range(0x20, 0x3000):
        if unicodedata.category(chr(c)) != "Cs":
            text = f"a{chr(c)}B {chr(c)}"
            assert mine(text) == theirs(text), hex(c)


def test_long_word_is_fast():
    assert mine("ab" * 100_000) == theirs("ab" * 100_000)


def test_rows(make_docs, spark, monkeypatch):
    monkeypatch.setattr(bpe_words, "CHUNK_BYTES", 1000)
    texts = ["Hello world", "Hello world", None, "", "the " * 60_000, "<|startoftext|> x", " \n "]
    docs = make_docs([*[(k // 2, t) for k, t in enumerate(texts)], (None, "a b")])
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, bytes(r["ids"]), bytes(r["decoded"])) for r in bpe_words.encode_texts(docs, vocabulary()).collect())
    want = []
    for i, t in [*[(k // 2, t) for k, t in enumerate(texts)], (-1, "a b")]:
        ids = theirs(t or "")
        want.append((i, np.asarray(ids, "<u4").tobytes(), LIBRARY.decode(ids, skip_special_tokens=False).encode()))
    assert found == sorted(want)
    assert bpe_words.encode_texts(make_docs([]), vocabulary()).collect() == []


def test_each_distinct_word_is_encoded_once(spark):
    words = spark.createDataFrame([("hello",), ("hello",), ("<|endoftext|>",), ("naïve",)], "word string")
    rows = bpe_words.encode_words(words, vocabulary()).collect()
    codec = bpe_words.codec(vocabulary())
    assert sorted((r["word"], bytes(r["ids"])) for r in rows) == sorted((w, np.asarray(codec.encode(w), "<u4").tobytes()) for w in ("hello", "hello", "<|endoftext|>", "naïve"))
    assert json.load(open(vocabulary()))["decoder"] is None


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in op8(spark, folder).collect():
        ids = theirs(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
