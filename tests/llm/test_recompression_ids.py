"""Texts of an id that only one row has are named by the id alone; hashes are shipped for repeated ids only."""

from corpusloom.llm import recompression

SAME = " ".join(f"w{k}" for k in range(20))


def test_hashes_only_where_an_id_is_repeated(make_docs, monkeypatch):
    single = make_docs([(1, SAME), (2, f"a {SAME}"), (3, f"b c {SAME}"), (None, SAME), (4, None)])
    assert {(r["id"], r["doc_hash"]) for r in recompression.covered_ranges(single).collect()} == {(2, 0), (3, 0)}
    rows = [(1, SAME), (2, f"a {SAME}"), (3, f"b c {SAME}"), (3, f"d {SAME} e"), (3, "f"), (None, SAME), (None, "x")]
    want = sorted([(1, 0), (2, 20), (3, 20), (3, 20), (3, 0), (-1, 0), (-1, 0)])
    for most in (recompression.BROADCAST_ENTRIES, 0):
        monkeypatch.setattr(recompression, "BROADCAST_ENTRIES", most)
        docs = make_docs(rows)
        assert {r["id"]: r["doc_hash"] != 0 for r in recompression.covered_ranges(docs).collect()} == {2: most == 0, 3: True}
        got = recompression.without_repeats(docs).select("doc_id", "n_removed").collect()
        assert sorted((-1 if r[0] is None else r[0], r[1]) for r in got) == want
