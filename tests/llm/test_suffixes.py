import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from corpusloom.llm import suffix_dedup
from corpusloom.llm.arrays import Texts


def brute(rows, length):
    """(id, bytes, removed, spans, digest) by a table of all strings."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, own in raw:
        for k in range(len(own) - length + 1):
            seen[own[k : k + length]] = seen.get(own[k : k + length], 0) + 1
    out = []
    for i, own in raw:
        gone = np.zeros(len(own) + 1, bool)
        for k in range(len(own) - length + 1):
            if seen[own[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        left = bytes(b for b, g in zip(own, gone) if not g)
        out.append((i, len(own), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def found(docs, length):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r) for r in suffix_dedup.without_repeats(docs, length=length).select(*names).collect()), key=str)


def random_rows(seed, n=40, pieces=(5, 60)):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = ""
        while len(text) < rng.choice([3, 40, 200, 600]):
            kind = rng.random()
            if rows and kind < 0.5:
                own = rng.choice(rows)[1]
                at = rng.randrange(len(own))
                text += own[at : at + rng.randint(*pieces)]
            elif kind < 0.65:
                text += rng.choice(["a", "ab", "xyz"]) * rng.randint(1, 40)
            else:
                text += "".join(rng.choices("abcdé 漢\n", k=rng.randint(1, 40)))
        rows.append((rng.randrange(3 * n), text))
    return rows


@pytest.mark.parametrize("length", [2, 12, 30, 33])
def test_random_texts_match_brute_force(make_docs, length):
    rows = random_rows(length)
    assert found(make_docs(rows), length) == brute(rows, length)


def test_production_length(make_docs):
    rows = random_rows(5, n=60, pieces=(100, 500))
    assert found(make_docs(rows), 200) == brute(rows, 200)


def test_buckets_and_common_leads(spark, make_docs, monkeypatch):
    """Groups over several buckets, a line in many surroundings, and a lead that is ranked behind."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_RECORDS", 50)
    monkeypatch.setattr(suffix_dedup, "RUN_STARTS", 16)
    rng = random.Random(3)
    noise = lambda k: "".join(rng.choices("abcdefghij ", k=k))
    line, copy = noise(70), noise(300)
    rows = [(k, noise(rng.randint(20, 90)) + line + noise(rng.randint(20, 90))) for k in range(60)]
    rows += [(100 + k, copy + noise(30)) for k in range(40)] + [(200 + k, copy) for k in range(40)]
    rows += [(300, "z" * 1000), (301, "q" * 5000 + noise(9)), (302, "ab" * 700), (303, noise(40) + "ab" * 30)]
    assert found(make_docs(rows), 100) == brute(rows, 100)


def test_odd_rows(make_docs):
    base = "".join(chr(97 + (k * k) % 23) for k in range(450))
    rows = [
        (3, base), (3, base), (5, "x" + base[:250]), (None, base[100:320]), (None, None), (8, None), (9, ""), (10, "short"),
        (11, "é" * 150), (12, "y" * 100_000), (13, "y" * 199), (14, "漢" * 66 + "ab"),
    ]
    assert found(make_docs(rows), 200) == brute(rows, 200)
    assert found(make_docs([]), 200) == []
    once = [(1, "".join(chr(97 + (k * 7 + k * k * 3) % 26) for k in range(13)) * 3)]
    assert found(make_docs(once), 20) == brute(once, 20)


def test_structured_texts(make_docs):
    """Strings of the Thue-Morse rule collide under powers modulo 2**64; they are no repeats."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, "p" * 250 + word[:2048] + "q" * 10), (2, "r" * 199 + other[:2048] + "s")]
    assert found(make_docs(rows), 200) == brute(rows, 200)
    start, end = np.array([0]), np.array([2048])
    one, two = (suffix_dedup.RunHashes(np.frombuffer(w.encode(), np.uint8)).runs(start, end) for w in (word, other))
    assert one[1] != two[1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.integers(0, 1)), max_size=40))
def test_multikey_order(rows):
    columns = [np.array([r[d] for r in rows], np.uint64) for d in range(3)]
    order, agree = suffix_dedup.multikey_order(len(rows), 3, lambda d, items: columns[d][items])
    done = [rows[k] for k in order.tolist()]
    assert done == sorted(rows)
    for a, b, n in zip(done, done[1:], agree[1:].tolist()):
        assert a[:n] == b[:n] and (n == 3 or a[n] != b[n])


def test_buckets_follow_all_tokens():
    rng = np.random.default_rng(0)
    splitters = np.unique(rng.integers(0, 3, (9, 4)).astype(np.uint64), axis=0)
    tokens = [rng.integers(0, 3, 500).astype(np.uint64) for _ in range(4)]
    slow = [sum(tuple(s) <= tuple(t) for s in splitters.tolist()) for t in zip(*(t.tolist() for t in tokens))]
    assert suffix_dedup.buckets(tokens, splitters).tolist() == slow


def test_equal_strings_have_equal_leads():
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab", k=300)) + "k" * 40 for _ in range(30)]
    texts += [t[50:200] for t in texts]
    part = Texts(pa.array(texts))
    _, doc, start, n, lead, _ = suffix_dedup._leads(part, 60, 8, suffix_dedup._hot_marks(np.zeros(0, np.uint64)))
    raw, named = part.bytes.tobytes(), {}
    for s, m, x in zip(start.tolist(), n.tolist(), lead.tolist()):
        for k in range(s, s + m):
            assert named.setdefault(raw[k : k + 60], x) == x
    assert n.sum() == sum(max(0, len(t) - 59) for t in texts)
