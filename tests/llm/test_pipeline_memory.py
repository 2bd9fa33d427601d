import pyarrow as pa
import pytest

import corpus_pipeline
from corpusloom.llm import bpe_words
from corpusloom.llm.queries import vocabulary
from corpusloom.runtime import BATCH_SETTING

FOLDER = "/root/testdata/sf0.001"


def batch_sizes(docs):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    return [r["n"] for r in docs.mapInArrow(run, "n bigint").collect()]


@pytest.fixture
def unset(spark):
    spark.conf.unset(BATCH_SETTING)
    yield
    spark.conf.unset(BATCH_SETTING)


def test_texts_go_to_python_in_bounded_batches(spark, unset):
    docs = spark.range(0, 6000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 200) AS text")
    coded = corpus_pipeline.encoding_stage(spark, docs, FOLDER)
    assert max(batch_sizes(docs)) < corpus_pipeline.BATCH_BYTES + 10_000
    assert coded.where("n_tokens = 400").count() == 6000
    # A batch is one chunk: none is cut again.
    assert corpus_pipeline.BATCH_BYTES < corpus_pipeline.CHUNK_BYTES


def test_a_session_keeps_its_own_batch_size(spark, unset):
    spark.conf.set(BATCH_SETTING, "1m")
    corpus_pipeline.run(spark, FOLDER)
    assert spark.conf.get(BATCH_SETTING) == "1m"


def test_run_takes_its_batch_size_back(spark, unset):
    corpus_pipeline.run(spark, FOLDER)
    assert spark.conf.get(BATCH_SETTING, None) is None


def test_the_library_splits_without_a_second_vocabulary():
    own = bpe_words.Codec(vocabulary())
    assert own.words("漢字 ABC") == ["漢字", "abc"]
    assert own._library.get_vocab_size() == 0
