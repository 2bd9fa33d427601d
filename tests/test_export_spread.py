"""Exports of small tables use all cores."""

from corpusloom.sinks import documents as SD


def test_one_partition_is_dealt_out_before_files_are_written(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(SD, "spread", lambda df: seen.append(df.rdd.getNumPartitions()) or df.repartition(4), raising=False)
    rows = spark.createDataFrame([(f"d{k % 3}/f{k}.md", f"text {k}") for k in range(40)], "path string, content string").coalesce(1)
    SD.export_files(rows, "path", "content", str(tmp_path / "out"))
    assert seen == [1]
    files = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*.md")}
    assert files == {f"d{k % 3}/f{k}.md": f"text {k}" for k in range(40)}
