import random
import re

from corpusloom.llm import line_dedup

WORDS = [f"t{k}" for k in range(60)]


def brute(rows):
    """Removed (id, line) by comparing every line with all earlier ones."""
    lines = sorted({(i, k, frozenset(x.split())) for i, t in rows if i is not None for k, x in enumerate((t or "").split("\n"))}, key=lambda x: x[:2])
    gone = set()
    for n, (i, k, own) in enumerate(lines):
        if own and any(s and len(own & s) >= 0.8 * len(own | s) - 1e-9 for j, m, s in lines[:n] if (j, m) < (i, k)):
            gone.add((i, k))
    return gone


def found(docs):
    return {(r["id"], k) for r in line_dedup.removed_lines(docs).collect() for k in r["lines"]}


def random_rows(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(1, 6)):
            if rows and rng.random() < 0.4:
                own = rng.choice(rng.choice(rows)[1].split("\n")).split()
                for _ in range(rng.choice([0, 1, 1, 2, 4])):
                    own.insert(rng.randint(0, len(own)), rng.choice(WORDS))
            else:
                own = rng.choices(WORDS, k=rng.choice([0, 1, 2, 4, 5, 9, 10, 20]))
            lines.append(" ".join(own))
        rows.append((i, "\n".join(lines)))
    return rows


def test_removed_lines_match_brute_force(make_docs):
    rows = random_rows(1)
    assert found(make_docs(rows)) == brute(rows)


def test_long_lists_are_cut_into_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "LONG_LIST", 0)
    real = line_dedup.in_blocks
    monkeypatch.setattr(line_dedup, "in_blocks", lambda df, group, member, rows: real(df, group, member, rows=5))
    rows = random_rows(2)
    assert found(make_docs(rows)) == brute(rows)


def test_one_order_of_words_on_both_paths(make_docs, monkeypatch):
    # The long document is a slice of its own with more lines than fit the sort key; the short ones stay below.
    monkeypatch.setattr(line_dedup, "PACKED_LINES", 500)
    rng = random.Random(3)
    lines = [rng.sample(WORDS, rng.choice([3, 5, 9, 10, 12])) for _ in range(60)]
    near = [" ".join([*x[1:], "new"] if k % 3 == 0 else x[::-1]) for k, x in enumerate(lines)]
    filler = [f"f{k}" + "y" * 1000 for k in range(600)]
    rows = [(1, "\n".join(filler + [" ".join(x) for x in lines])), *((10 + k, x) for k, x in enumerate(near))]
    assert found(make_docs(rows)) == brute(rows)


def test_words_with_equal_low_bits_keep_the_order():
    import numpy as np

    class Made:
        """One text whose lines hold the given word hashes."""

        n = 1

        def __init__(self, lines):
            self.hashes = [np.array(x, np.uint64) for x in lines]

        def words(self):
            line = np.repeat(np.arange(len(self.hashes)), [len(x) for x in self.hashes])
            return np.zeros(len(line), int), line * 100 + 1, line * 100 + 2, np.concatenate(self.hashes)

        def lines(self):
            starts = np.arange(len(self.hashes)) * 100
            return np.zeros(len(starts), int), starts, starts + 99

    rarity = np.zeros(1 << line_dedup.SLOT_BITS, np.uint8)
    common = [(9 << 40) | 5, (3 << 40) | 7, (8 << 40) | 6]
    # The last line has two words that agree in the low 36 bits, so its whole slice is sorted the long way.
    alone, beside = Made([common]), Made([common, [(1 << 50) | 4, (2 << 50) | 4, (1 << 50) | 4]])
    first = line_dedup.line_sets(alone, rarity)[3]
    _, number, at, words = line_dedup.line_sets(beside, rarity)
    assert number.tolist() == [0, 1] and at.tolist() == [0, 3, 5]
    assert words[:3].tolist() == first.tolist()
    assert line_dedup.line_sets(beside, rarity, 0)[3].tolist() == words.tolist()


def test_odd_rows(make_docs):
    long = "\n".join(f"a{k} b{k}" for k in range(20_000))
    rows = [(1, "x y z\n\nx y z"), (1, "x y z\n\nx y z"), (2, None), (3, ""), (4, "x y z"), (None, "x y z"), (5, long), (6, long), (7, "new\r\nx  y z\n")]
    docs = make_docs(rows)
    gone = line_dedup.removed_lines(docs)
    left = line_dedup.kept_lines(docs, gone)
    texts = sorted(((r["doc_id"] or 0), r["text"] if r["text"] is not None else "null", r["__lines"], r["__gone"]) for r in left.collect())
    assert texts == [
        (0, "x y z", 1, 0), (1, "x y z\n", 3, 1), (1, "x y z\n", 3, 1), (2, "null", 0, 0), (3, "", 1, 0), (4, "", 1, 1),
        (5, long, 20_000, 0), (6, "", 20_000, 20_000), (7, "new\r\n", 3, 1),
    ]
    kept = line_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 1, 2, 3, 5, 7]
    assert line_dedup.deduplicated(make_docs([])).collect() == []


def test_prefix_length_is_never_too_short():
    import numpy as np

    for s in range(1, 200):
        p = int(line_dedup.prefix_length(np.array([s]), 0.8)[0])
        # A set that shares none of the p rarest words shares s - p at most, too few for any partner.
        assert s - p < 0.8 * s and p >= 1


def test_long_words_of_a_regular_build(make_docs):
    from test_recompression import regular_words

    for a, b in regular_words():
        rows = [(1, a), (2, b), (3, f"{a}\nx {a}")]
        gone = {r["id"]: sorted(r["lines"]) for r in line_dedup.removed_lines(make_docs(rows)).collect()}
        assert gone == {3: [0]}


def test_rounds_end_at_the_first_similar_line(make_docs, monkeypatch):
    """Few lines a round, and lines that resemble none of the earliest ones."""
    monkeypatch.setattr(line_dedup, "FIRST_ROUND", 1)
    monkeypatch.setattr(line_dedup, "NEXT_ROUND", 2)
    rng = random.Random(7)
    rows = random_rows(5, n=30)
    for group in range(2):
        base = [f"g{group}w{k}" for k in range(14)]
        for k in range(40):
            own = list(base)
            for _ in range(rng.choice([1, 2, 2, 3])):
                own[rng.randrange(1, 14)] = f"r{rng.randrange(30)}"
            rows.append((1000 + 50 * group + k, " ".join(own)))
    assert found(make_docs(rows)) == brute(rows)


def test_large_sets_that_differ_are_not_compared_in_full(spark, make_docs, monkeypatch):
    """Lines of 150 words that share a few: a parity map of 64 bits lets most of their pairs through."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join(rng.sample(words, 150))) for k in range(60)]
    near = rows[7][1].split()
    rows.append((60, " ".join(near[:145] + ["other"])))
    asked, real = [], line_dedup._similar
    monkeypatch.setattr(line_dedup, "_similar", lambda source, found, *rest: asked.append(found.count()) or real(source, found, *rest))
    gone = {r["id"]: sorted(r["lines"]) for r in line_dedup.removed_lines(make_docs(rows)).collect()}
    assert gone == {60: [0]}
    assert sum(asked) <= 20


def test_slot_counts_are_added_up_in_blocks(spark, make_docs):
    """Every word is counted, and tasks send blocks of slots, not a row for each slot."""
    import numpy as np
    import pyarrow as pa

    from corpusloom.llm.arrays import Texts

    texts = [" ".join(f"w{k % (7 + i)}" for k in range(3000)) + f" only{i}" for i in range(40)] + [None, ""]
    docs = make_docs(list(enumerate(texts))).repartition(3)
    words = Texts(pa.array(texts)).words()[3]
    want = np.bincount((words >> np.uint64(64 - line_dedup.SLOT_BITS)).astype(np.int64), minlength=1 << line_dedup.SLOT_BITS)
    assert (line_dedup.word_slots(docs) == want).all()
    assert (line_dedup._counts_of(line_dedup._packed_counts(want << 33)) == want << 33).all()
    assert len(line_dedup._packed_counts(np.ones(1 << 14, np.int64))) < 1 << 11


def test_narrow_rows_meet_in_the_lists(spark, make_docs, monkeypatch):
    """With ids that do not repeat a row of a list has five columns: word, size and position, number, and the two maps."""
    seen, real = [], line_dedup._candidates

    def spied(*given):
        df = real(*given)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        seen.append(sorted(len(x.split(",")) for x in re.findall(r"MapInArrow \S+?\((.*?)\)#", plan)))
        return df

    monkeypatch.setattr(line_dedup, "_candidates", spied)
    rows = random_rows(9, n=20)
    assert found(make_docs(rows)) == brute(rows)
    # Lists that may be long carry their blocks beside.
    assert seen[0] == [5, 8]


def test_repeated_and_distant_ids(make_docs):
    """Lines of one place are no earlier than each other; ids of the whole range keep their order."""
    base = [f"a{k}" for k in range(10)]
    near = lambda k: " ".join(base[:9] + [f"n{k}"])
    repeated = [(5, near(1)), (5, near(2)), (3, "x y"), (9, near(3)), (9, "x y")]
    assert found(make_docs(repeated)) == {(9, 0)}
    rows = [(3 - (1 << 62), near(1)), ((1 << 62) - 5, near(2)), (0, near(3) + "\n" + near(4)), (7, "p q")]
    assert found(make_docs(rows)) == brute(rows) == {((1 << 62) - 5, 0), (0, 0), (0, 1)}
