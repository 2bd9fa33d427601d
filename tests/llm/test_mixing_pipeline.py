import hashlib
import math

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from corpusloom.llm import mixing, quality, queries
from test_minhash import classes
from test_models import plain_statistics, walk

FOLDER = "/root/testdata/sf0.001"


def rows_of(sizes, words=20):
    """Documents of `words` words: sizes maps source to how many."""
    out, key = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            out.append((key, " ".join(f"w{key}_{k}" for k in range(words)), source))
            key += 1
    return out


@pytest.mark.parametrize("entropy, repeats", [(0.98, 50.0), (0.9, 2.0), (1.0, 3.0)])
def test_exponent_is_the_best_on_the_grid(make_docs, entropy, repeats):
    sizes = {"big": 400, "mid": 60, "small": 12, "": 5}
    found = mixing.plan(mixing.light_rows(make_docs(rows_of(sizes))), entropy=entropy, repeats=repeats, block_tokens=200)
    total = sum(sizes.values())

    def measure(k):
        w = [(n / total) ** (k / mixing.GRID) for n in sizes.values()]
        w = [x / sum(w) for x in w]
        return -sum(x * math.log(x) for x in w), max(x * total / n for x, n in zip(w, sizes.values()))

    enough = [k for k in range(mixing.GRID + 1) if measure(k)[0] >= entropy * math.log(len(sizes)) - 1e-12]
    want = max(enough, default=0)
    if measure(want)[1] > repeats + 1e-12:
        want = min(k for k in range(want, mixing.GRID + 1) if measure(k)[1] <= repeats + 1e-12)
    assert found.exponent == want / mixing.GRID


def test_quotas_are_met(make_docs):
    sizes = {"big": 400, "mid": 60, "small": 12}
    docs = make_docs(rows_of(sizes))
    plan = mixing.plan(mixing.light_rows(docs), entropy=0.95, repeats=4.0, block_tokens=300)
    quota = {r["source"]: r["quota"] for r in plan.sources.collect()}
    taken, often = dict.fromkeys(sizes, 0), {}
    for r in mixing.with_copies(docs, plan).collect():
        taken[r["source"]] += 20 * r["__copies"]
        often.setdefault(r["source"], set()).add(r["__copies"])
    assert all(quota[s] - 20 < taken[s] <= quota[s] for s in sizes)
    assert all(max(x) - min(x) <= 1 for x in often.values())  # whole passes and one partial pass


def test_odd_rows(make_docs):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (None, "d e", None), (4, "f " * 100_000, "y"), (5, "", "never")]
    docs = make_docs(rows)
    light = mixing.light_rows(docs)
    plan = mixing.plan(light, repeats=5.0)
    found = [(r["doc_id"], r["source"], r["__copies"]) for r in mixing.with_copies(docs, plan).collect()]
    assert len([r for r in found if r[0] == 1]) == 2 and len({r for r in found if r[0] == 1}) == 1
    assert not [r for r in found if r[1] == "never"]
    assert mixing.mixed(docs, repeats=5.0).columns == docs.columns
    assert mixing.mixed(make_docs([])).collect() == []
    assert mixing.mixed(make_docs([(1, "", "x")])).collect() == []


def by_sql(name, docs):
    """Rows of an operator's SQL over some documents."""
    link = duckdb.connect()
    link.register("documents", docs)
    return link.execute(queries.ORACLES[name]).fetchdf()


def test_run_stage_by_stage(spark):
    """Every stage of run() recomputed from its predecessor's rows: by plain Python, by SQL, by the tokenizer library."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, FOLDER), name)
        results[name] = before.toPandas(), docs.toPandas()
        if name != "bpe_encoding":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    plain = lambda frame: sorted(map(tuple, frame.astype(object).where(frame.notna(), None).to_numpy().tolist()), key=str)

    before, after = results["quality_classifier"]
    forest = quality.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = before[[walk(forest, plain_statistics(t)) >= 0.3 for t in before.text]]
    assert 0 < len(after) < len(before) and plain(after) == plain(good)

    before, after = results["line_dedup"]
    sql = by_sql("op1_line_dedup", before).set_index("doc_id")
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    stays = {d for d in before.doc_id if sql.n_removed[d] == 0 or sql.kept_sha256[d] in set(map(digest, after.text))}
    assert {d: digest(t) for d, t in zip(after.doc_id, after.text)} == {d: sql.kept_sha256[d] for d in stays}
    assert (after.n_chars == after.text.str.len()).all() and sql.n_removed.sum() > 0

    before, after = results["minhash_near_dedup"]
    label = classes(list(zip(before.doc_id, before.text)))
    assert plain(after) == plain(before[before.doc_id.isin(set(label.values()))])

    before, after = results["source_mixing"]
    copies = by_sql("op2_mixing", before).set_index("doc_id").copies
    assert plain(after) == plain(before.loc[before.index.repeat([copies[d] for d in before.doc_id])])

    before, after = results["bpe_encoding"]
    library = Tokenizer.from_file(queries.vocabulary())
    library.no_truncation(), library.no_padding()
    want = []
    for d, t in zip(before.doc_id, before.text):
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = np.asarray(ids, "<u4").tobytes()
        want.append((d, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert plain(after[columns]) == sorted(want, key=str)
    assert plain(corpus_pipeline.run(spark, FOLDER).select(columns).toPandas()) == sorted(want, key=str)


def test_run_on_odd_tables(spark, make_docs, tmp_path):
    """Null ids and texts, repeated rows, empty and long texts, clashing columns, and no rows at all."""
    rows = [(1, "good words here and there"), (1, "good words here and there"), (None, "a text of no number"), (2, None), (3, ""), (4, "long words " * 20_000), (5, "\n\n")]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", make_docs(rows)), ("none", make_docs([]))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    # Equal texts are one; texts without words are in no class, and mixing drops what has no token to give.
    assert {r["doc_id"] for r in found} <= {1, 2, 3, 4, 5, None} and {1, 4, None} <= {r["doc_id"] for r in found}
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in found)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_line_stage_drops_emptied_documents(spark, make_docs):
    docs = make_docs([(1, "a b c d e\nf g h"), (2, "a b c d e"), (3, "q\na b c d e"), (4, "")])
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_stage(spark, docs, FOLDER).collect()}
    assert left == {1: ("a b c d e\nf g h", 15), 3: ("q", 1), 4: ("", 0)}
