import hashlib
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from corpusloom.llm import recompression
from corpusloom.llm.arrays import Texts
import pyarrow as pa


def brute(rows, window=13):
    """(removed words per row) by a table of all windows."""
    split = [(i, [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in (t or "")).split(" ") if w]) for i, t in rows]
    first = {}
    for i, words in split:
        for k in range(len(words) - window + 1 if i is not None else 0):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        keep = [True] * len(words)
        for k in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        left = [w for w, ok in zip(words, keep) if ok]
        out.append((i, len(words), len(words) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def found(docs):
    return sorted((tuple(r) for r in recompression.without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def random_rows(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = []
        while len(words) < rng.choice([5, 13, 40, 90]):
            kind = rng.random()
            if rows and kind < 0.5:
                own = rng.choice(rows)[1].split()
                at = rng.randrange(len(own))
                words += own[at : at + rng.randint(5, 40)]
            elif kind < 0.7:
                words += [rng.choice("ab")] * rng.randint(1, 30)
            else:
                words += rng.choices("abcdefgh", k=rng.randint(1, 20))
        rows.append((rng.randrange(3 * n), " ".join(words)))
    return rows


def test_random_texts_match_brute_force(make_docs):
    for seed in (1, 2):
        rows = random_rows(seed)
        assert found(make_docs(rows)) == brute(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("aabc"), min_size=13, max_size=40), st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_equal_windows_have_equal_symbols(middle, left, right):
    """Each window of a passage is represented alike whatever stands around it."""

    def symbols(words):
        texts = Texts(pa.array([" ".join(words)]))
        doc, _, _, hashes = texts.words()
        first, n, symbol = recompression.records(doc, hashes, np.full(len(hashes), len(hashes)))
        return {int(f) + k: int(s) for f, c, s in zip(first, n, symbol) for k in range(c)}

    alone, inside = symbols(middle), symbols(left + middle + right)
    assert len(inside) == len(left + middle + right) - 12
    assert all(inside[len(left) + k] == s for k, s in alone.items())


def test_odd_rows(make_docs):
    base = " ".join(f"w{k}" for k in range(30))
    rows = [
        (3, base), (3, base), (5, base), (7, "x " + base + "\ty"), (None, base), (8, None), (9, ""), (10, "w1 w2"), (11, " \n\t"),
        (12, "z " * 50_000), (13, "z " * 14), (14, "w1 w2 " * 13), (2, " ".join(f"w{k}" for k in range(12))),
    ]
    assert found(make_docs(rows)) == brute(rows)
    assert found(make_docs([])) == []


def regular_words():
    """Pairs of words that powers modulo 2**64 cannot tell apart: built by the Thue-Morse rule, and the complement."""
    swap = str.maketrans("ab", "ba")
    for length in (1024, 65_536):
        word = "a"
        while len(word) < length:
            word += word.translate(swap)
        yield word, word.translate(swap)


def test_long_words_of_a_regular_build(make_docs):
    for a, b in regular_words():
        lead = " ".join(f"w{k}" for k in range(12))
        rows = [(1, f"{lead} {a}"), (2, f"{lead} {b}"), (3, f"{lead} {b}")]
        assert found(make_docs(rows)) == brute(rows)
