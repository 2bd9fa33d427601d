import random
from collections import Counter

import numpy as np

from corpusloom.llm import bag_minhash
from corpusloom.llm.queries import op7

LETTERS = [f"w{k}" for k in range(400)]


def bags(texts):
    found = {}
    for key, text in texts:
        w = (text or "").split()
        found[key] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    return found


def classes(texts, similarity=0.8):
    """All pairs by brute force."""
    own = bags(texts)
    label = {k: k for k in own}
    keys = sorted(own)
    linked = []
    for x, a in enumerate(keys):
        for b in keys[:x]:
            shared = sum((own[a] & own[b]).values())
            total = sum(own[a].values()) + sum(own[b].values()) - shared
            if total and shared >= similarity * total - 1e-9:
                linked.append((a, b))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def near_copies(seed, groups=12, each=9, words=120):
    rng = random.Random(seed)
    texts, key = [], 0
    for _ in range(groups):
        base = rng.choices(LETTERS, k=words)
        for _ in range(each):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                own[rng.randrange(words)] = rng.choice(LETTERS)
            texts.append((key, " ".join(own)))
            key += 1
    return texts


def test_classes_match_brute_force(make_docs, monkeypatch):
    real = bag_minhash._open
    monkeypatch.setattr(bag_minhash, "_open", lambda members, rows, labels, size: real(members, rows, labels, 4))
    texts = near_copies(1)
    found = {r["doc_id"]: r["class_id"] for r in bag_minhash.near_duplicates(make_docs(texts)).collect()}
    assert found == classes(texts)


def test_signatures_are_unbiased_for_weighted_similarity():
    rng = np.random.default_rng(5)
    total, exact = [], []
    for _ in range(60):
        weight = rng.integers(0, 40, size=(2, 30))
        rows = [np.flatnonzero(w) for w in weight]
        hashes = rng.integers(0, 1 << 62, 30).astype(np.uint64)
        sig = bag_minhash.signatures(np.repeat([0, 1], [len(r) for r in rows]), np.concatenate([hashes[r] for r in rows]), np.concatenate([weight[k][r] for k, r in enumerate(rows)]), 2, 256)
        total.append((sig[0] == sig[1]).mean())
        exact.append(np.minimum(*weight).sum() / np.maximum(*weight).sum())
    assert abs(np.mean(total) - np.mean(exact)) < 0.01
    assert np.abs(np.array(total) - exact).max() < 0.15


def test_odd_rows(make_docs):
    base = " ".join(LETTERS[:50])
    rows = [(1, base), (1, base), (2, base), (3, None), (4, ""), (5, " \n"), (None, base), (6, "one two"), (7, "one  two"), (8, "x " * 100_000), (9, "x " * 99_000), (10, "x " * 50_000)]
    found = {r["doc_id"]: r["class_id"] for r in bag_minhash.near_duplicates(make_docs(rows)).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10}
    kept = sorted((r["doc_id"] or 0) for r in bag_minhash.one_of_each(make_docs(rows)).collect())
    assert kept == [0, 1, 3, 4, 5, 6, 8, 10]
    assert bag_minhash.near_duplicates(make_docs([])).collect() == []
    assert bag_minhash.one_of_each(make_docs([])).columns == make_docs([]).columns


def test_a_repeated_id_joins_its_texts(make_docs):
    a, b = " ".join(LETTERS[:50]), " ".join(LETTERS[100:150])
    found = {r["doc_id"]: r["class_id"] for r in bag_minhash.near_duplicates(make_docs([(5, a), (5, b), (6, a), (7, b), (8, "alone")])).collect()}
    assert found == {5: 5, 6: 5, 7: 5, 8: 8}


def test_near_copies_of_all_texts_of_a_repeated_id(make_docs):
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(6):
        low = 10 * k
        for turn in range(3):
            base = rng.choices(LETTERS, k=100)
            near = list(base)
            near[50] = "other"
            # The near copy of each of the three texts, one of them with a smaller id.
            rows += [(low + 5, " ".join(base)), (low + (4, 6, 7)[turn], " ".join(near))]
        want |= {low + d: low + 4 for d in (4, 5, 6, 7)}
    found = {r["doc_id"]: r["class_id"] for r in bag_minhash.near_duplicates(make_docs(rows)).collect()}
    assert found == want


def test_query_matches_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert {r["doc_id"]: r["class_id"] for r in op7(spark, folder).collect()} == classes(texts)


def test_long_words_of_a_regular_build(make_docs):
    """Thue-Morse words and their complements are different words."""
    from test_recompression import regular_words

    for a, b in regular_words():
        found = {r["doc_id"]: r["class_id"] for r in bag_minhash.near_duplicates(make_docs([(1, a), (2, b), (3, a)])).collect()}
        assert found == {1: 1, 2: 2, 3: 1}
