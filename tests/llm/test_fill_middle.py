import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import fill_middle as fm
from corpusloom.llm.arrays import Texts


def brute(key, text, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return key, n, "plain", None, None, text, text
    if h4 % 100 < spm_rate:
        return key, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return key, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def found(docs, **options):
    made = fm.fill_in_middle(docs, **options).withColumn("back", fm.restored(F.col("output"), F.col("form")))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    return sorted((tuple(r) for r in made.collect()), key=str)


ROWS = [
    (1, "one\ntwo\nthree"), (2, "é\n漢字\n\n\n😀 end\n"), (3, ""), (4, None), (None, "a\nb\nc\nd"), (5, "no feed"), (6, "\n"), (7, "\n\n\n"),
    (8, "holds <S> itself\nx"), (9, "<P"), (10, "S>\n<\n<M\n>"), (11, "\r\nx\r\n\x0b\n"), (12, "y" * 200_000 + "\n" + "é\n" * 50_000), (13, "x\n" * 100_001),
    (5, "no feed"), (5, "other\ntext\n"), (-14, "\x00\x0a\x7f\x0a\x0b\n\x09"), (15, "<M\n><P\n>"),
] + [(k, "line é\n" * (k % 13) + "tail" * (k % 2)) for k in range(100, 160)]


def test_rows_match_brute_force(make_docs):
    assert found(make_docs(ROWS)) == sorted((brute(*r) for r in ROWS), key=str)
    assert found(make_docs([])) == []


def test_rates(make_docs):
    for rate, spm in ((0, 50), (40, 100), (70, 0)):
        assert found(make_docs(ROWS), rate=rate, spm_rate=spm) == sorted((brute(*r, rate, spm) for r in ROWS), key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\n\x0b\x09é漢😀\x8a"), max_size=30), min_size=1, max_size=8), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts(texts, h1, h2):
    n, a, b, before, until = fm.cut(Texts(pa.array(texts)), np.full(len(texts), h1), np.full(len(texts), h2))
    for k, text in enumerate(texts):
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        x, y = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        left, right = "".join(units[:x]), "".join(units[:y])
        assert (n[k], before[k], until[k]) == (len(units), len(left), len(right))
        assert (a[k], b[k]) == (len(left.encode()), len(right.encode()))


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=80))
def test_rank_and_select(raw):
    values = np.frombuffer(raw, np.uint8)
    marks = fm.Marks(fm.feed_marks(fm.as_words(values)))
    places = np.flatnonzero(values == 10)
    assert marks.select(np.arange(len(places))).tolist() == places.tolist()
    assert marks.rank(np.arange(len(raw) + 1)).tolist() == [raw[:k].count(10) for k in range(len(raw) + 1)]
