import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import block_search, hamming_dedup
from corpusloom.llm.queries import op5, op6

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, n long"
ODD = [None, [], [0.0] * 8, [1.0] * 7 + [None], [1.0] * 7 + [float("nan")], [1.0] * 7 + [float("inf")]]


def make(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "y", 1) for i, v in rows], SCHEMA).repartition(3)


def clusters(seed, n=300, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim))
    return [(int(i), (centres[i % 30] + rng.normal(size=dim) * rng.choice([0, 0.05, 0.2, 0.6])).astype(np.float32).tolist()) for i in range(n)]


def test_search_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(block_search, "QUERY_BLOCK", 16)
    monkeypatch.setattr(block_search, "CANDIDATE_BLOCK", 64)
    rows = clusters(1)
    rows += [(1000 + k, rows[0][1]) for k in range(60)]  # ties
    bad = [(2000 + 20 * k, v) for k, v in enumerate(ODD)] + [(None, [1.0] * 8), (5, rows[5][1])]
    other = [(3000 + 20 * k, [1.0, float(k)]) for k in range(3)]  # another length, fewer candidates than asked for
    found = block_search.nearest(make(spark, rows + bad + other), F.col("vec_id") % 20 == 0, k=20).toPandas()
    for group, dim in ((rows, 8), (other, 2)):
        ids = np.array([i for i, _ in group])
        x = np.array([v for _, v in group], dtype=float)
        for q in np.flatnonzero(ids % 20 == 0):
            score = (x * x[q]).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if j != q][:20]
            own = found[found.query_id == ids[q]].sort_values("rank")
            assert own.id.tolist() == ids[order].tolist() and np.array_equal(own.score.to_numpy(), score[order])
    assert not set(found.query_id) & {i for i, _ in bad if i != 5}
    assert block_search.nearest(make(spark, []), F.col("vec_id") % 20 == 0).collect() == []


def truth(rows, threshold=0.9):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = ids.copy()
    while True:
        new = np.array([min([label[k], *label[near[k]]]) for k in range(len(ids))])
        if (new == label).all():
            return {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(axis=1), label)}
        label = new


def test_hamming_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hamming_dedup, "in_blocks", lambda df, group, member: __import__("corpusloom.llm.bundles", fromlist=["in_blocks"]).in_blocks(df, group, member, rows=20))
    rows = clusters(2, dim=32)
    rows += [(1000 + k, rows[0][1]) for k in range(40)]
    bad = [(2000 + k, v) for k, v in enumerate(ODD)]
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in hamming_dedup.near_duplicates(make(spark, rows + bad + [(5, rows[5][1])])).collect()}
    want = truth(rows)
    assert len(found) == len(rows) + len(bad)
    links, hits = sum(n for n, _ in want.values()), sum(found[i][0] for i in want)
    assert 0.97 * links <= hits <= links
    assert all(found[i][0] <= want[i][0] for i in want)
    assert sum(found[i][1] == want[i][1] for i in want) >= 0.97 * len(want)
    assert all(found[i] == (0, i, True) for i, _ in bad)
    assert hamming_dedup.near_duplicates(make(spark, [])).collect() == []
    assert [tuple(r) for r in hamming_dedup.near_duplicates(make(spark, [(None, [1.0, 2.0])])).collect()] == [(None, 0, None, True)]


@pytest.mark.parametrize("dim", [64, 128, 384, 768])
@pytest.mark.parametrize("difference", ["strong", "weak"])
def test_recall_at_the_threshold(dim, difference):
    """Pairs at the threshold on skewed data, differing anywhere, in the strongest directions, or in the weakest."""
    rng = np.random.default_rng(dim)
    n = 500
    spread = 1 / np.arange(1, dim + 1) ** 0.7
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit((rng.normal(size=(n, dim)) * spread) @ turn)
    where = {"anywhere": np.ones(dim), "strong": np.arange(dim) < max(4, dim // 8), "weak": np.arange(dim) >= dim - dim // 2}[difference]
    y = (rng.normal(size=(n, dim)) * where) @ turn
    y = unit(y - (x * y).sum(axis=1, keepdims=True) * x)
    y = 0.9 * x + np.sqrt(1 - 0.81) * y
    tables = hamming_dedup.Tables({dim: x}, 1_000_000, 0.9, 0.998)
    (code_x, key_x), (code_y, key_y) = tables.codes(x), tables.codes(y)
    met = (key_x == key_y).any(axis=1) & (np.bitwise_count(code_x ^ code_y).sum(axis=1) <= tables.bound(dim))
    assert met.mean() >= 0.97


def test_queries(spark):
    found = op5(spark, "/root/testdata/sf0.001").toPandas()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert found.groupby("query_id").size().eq(min(20, len(rows) - 1)).all()
    assert set(found.query_id) == {i for i, _ in rows if i % 20 == 0}
    want = truth(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op6(spark, "/root/testdata/sf0.001").collect()} == want
