"""A corpus folder is listed and read by the executors."""

import os

from corpusloom.sources import captures as SC


def test_the_driver_holds_no_file_of_a_corpus(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SC, "_TEXT_BYTES", 40, raising=False)
    monkeypatch.setattr(SC, "_NAMES", 3, raising=False)
    root = tmp_path / "a corpus+%41"
    files = {
        "20240101__a b.md": "# A\nbody", "50%25 +x.md": "no title", "中.md": "# 中\r\n", "sources.md": "# index", "_hidden.md": "# h", ".dot.md": "# d",
        "empty.md": "", "other.txt": "# t", "d1/content.md": "# D1", "d 2+%20/content.md": "# D2", "d1/notes.md": "# n", "d3/deep/content.md": "# deep",
        "d4/other.md": "# o", "e.md/content.md": "# E", "_d/content.md": "# u", "f/content.md/x.md": "# x", "g/content.md": "",
    } | {f"n{k}.md": f"# title {k}\n" + "x" * k for k in range(30)}
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode())
    want = {"20240101__a b.md": "A", "50%25 +x.md": "", "中.md": "中", "d1/content.md": "D1", "d 2+%20/content.md": "D2", "e.md/content.md": "E"}
    want |= {f"n{k}.md": f"title {k}" for k in range(30)}
    for path in (str(root), f"{root}/", f"file://{root}"):
        found = SC.corpus_files(spark, path)
        rows = found.collect()
        assert {r["source"]: r["title"] for r in rows} == want and len(rows) == len(want)
        assert all(r["markdown"] == files[r["source"]] for r in rows)
        assert found.inputFiles() == []


def test_an_odd_name_costs_no_other_file(spark, tmp_path):
    for name in (b"\xff.md", b"a.md"):
        with open(os.path.join(os.fsencode(tmp_path), name), "wb") as file:
            file.write(b"# t\n")
    assert SC.corpus_files(spark, str(tmp_path)).where("title = 't'").count() == 2
