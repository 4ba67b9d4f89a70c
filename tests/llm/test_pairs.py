"""The operators on pairs and on two tokenizers: against brute force on nulls, empty and long texts, ties, repeated rows."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import alignment, negatives, ngramjoin
from tests.conftest import SMALL
from tests.llm import brute


def order(found):
    return sorted(found, key=repr)


def rows_of(df):
    return order(tuple(r) for r in df.collect())


def copies(draw, words: list[str], count: int, edits: int) -> list[str]:
    """Near copies of a text, each with up to so many words changed."""
    out = []
    for i in range(count):
        own = list(words)
        for at in draw.sample(range(len(own)), draw.randint(0, edits)):
            own[at] = f"x{draw.randint(0, 9)}_{i % 7}"
        out.append(" ".join(own))
    return out


def test_similar_documents(docs, rows, none):
    got = rows_of(ngramjoin.similar_documents(docs))
    assert got == order(brute.similar([r[:2] for r in rows]))
    assert ngramjoin.similar_documents(none).count() == 0


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (3, 60), (1, 100)])
def test_similar_documents_in_large_groups(spark, size, percent):
    """Groups of near copies of which many, few or no pairs are similar, and a passage that all texts share."""
    draw = random.Random(size)
    prose = lambda n: [f"w{draw.randint(0, 5000)}" for _ in range(n)]
    passage, texts = prose(30), []
    for edits in (1, 4, 9, 25):
        texts += copies(draw, prose(90), 45, edits)
    texts += copies(draw, prose(8), 30, 2) + [" ".join(prose(draw.randint(5, 60)) + passage) for _ in range(60)]
    texts += [" ".join(prose(6000))] + copies(draw, prose(700), 8, 12)
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3]), (3, None)]
    rows = [(900 - i, t) for i, t in enumerate(texts[::5])] + rows  # copies before the least key of their set
    got = rows_of(ngramjoin.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=size, percent=percent))
    assert got == order(brute.similar(rows, size, percent))


def test_similar_documents_without_links(spark):
    rows = [(i, " ".join(f"d{i}_{k}" for k in range(20))) for i in range(30)] + [(40, None), (41, " "), (42, "one two")]
    got = rows_of(ngramjoin.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == order(brute.similar(rows))


@pytest.mark.parametrize("percent", [50, 85, 90, 100])
def test_prefixes_of_similar_sets_meet(percent):
    draw = random.Random(percent)
    for _ in range(3000):
        n = draw.randint(1, 40)
        a = set(range(n))
        b = set(draw.sample(sorted(a), draw.randint(max(1, n - 6), n))) | {100 + k for k in range(draw.randint(0, 5))}
        if 100 * len(a & b) < percent * len(a | b):
            continue
        ranks = {x: draw.random() for x in a | b}
        first = [sorted(s, key=ranks.get)[: ngramjoin.prefix_length(len(s), percent)] for s in (a, b)]
        assert set(first[0]) & set(first[1])


@pytest.mark.parametrize("percent", [50, 85, 100])
def test_fine_shapes_lose_no_similar_sets(percent):
    draw = np.random.default_rng(percent)
    for n in (1, 2, 7, 60, 900, 5000):
        for _ in range(40):
            own = np.unique(draw.integers(0, 1 << 64, n, dtype=np.uint64))
            left = own[draw.random(len(own)) > draw.random() * (1 - percent / 100)]
            other = np.unique(np.concatenate([left, draw.integers(0, 1 << 64, draw.integers(0, 1 + n // 9), dtype=np.uint64)]))
            if len(other) and ngramjoin.similar(own.tobytes(), other.tobytes(), percent):
                assert ngramjoin.fine_alike(ngramjoin.fine_shape(own), ngramjoin.fine_shape(other), percent)
    crowded = np.arange(2000, dtype=np.uint64)  # a slice holds more than a byte says
    assert ngramjoin.fine_shape(crowded) == b"" and ngramjoin.fine_alike(b"", ngramjoin.fine_shape(own), percent)


def test_long_sets_that_share_a_passage_do_not_travel(spark, monkeypatch):
    """Sixteen slices can't tell long sets apart; their fine shapes do."""
    draw = np.random.default_rng(1)
    passage = draw.integers(0, 1 << 64, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([passage, draw.integers(0, 1 << 64, 3000, dtype=np.uint64)])) for _ in range(12)]
    sets.append(np.unique(np.concatenate([sets[0][60:], draw.integers(0, 1 << 64, 50, dtype=np.uint64)])))
    table = lambda values: spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "node long, value binary")
    pairs = spark.createDataFrame(list(itertools.combinations(range(len(sets)), 2)), "a long, b long")
    told, compared = [], ngramjoin.compared
    monkeypatch.setattr(ngramjoin, "compared", lambda pairs, *rest, **few: told.append(pairs.count()) or compared(pairs, *rest, **few))
    found = ngramjoin.verified(pairs, table(map(ngramjoin.fine_shape, sets)), table(s.tobytes() for s in sets), 85)
    assert rows_of(found) == [(0, 12)] and told == [78, 1]


def test_the_driver_holds_no_filter_of_grams(spark, monkeypatch):
    """What the driver sends to all tasks from its own memory stays at 8 MB, and few tables of it: the rest is in the shared folder."""
    sent = []
    whole = type(spark.sparkContext).broadcast

    def broadcast(self, value):
        sent.append(len(value))
        return whole(self, value)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    draw = random.Random(12)
    base = [[f"w{draw.randint(0, 900)}" for _ in range(60)] for _ in range(6)]
    rows = [(i, " ".join([*base[i % 6], f"end{i}"])) for i in range(60)]
    got = ngramjoin.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {(r["doc_id"], r["component"]) for r in got.collect()} == {(i, i % 6) for i in range(60)}
    # counters, documents to fetch; pairs that go to all tasks need no filter before them
    assert max(sent) <= 1 << ngramjoin.COUNTERS and len(sent) == 2
    # the same when they are too many for that
    monkeypatch.setattr(ngramjoin, "BROADCAST_ROWS", 0)
    got = ngramjoin.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {(r["doc_id"], r["component"]) for r in got.collect()} == {(i, i % 6) for i in range(60)}


def test_sets_are_cut_and_shaped_in_one_step_of_python(spark):
    """Steps behind one another in a stage have a worker each; and a set that several tasks hold is one node."""
    own = np.sort(np.random.default_rng(2).integers(0, 1 << 64, 90, dtype=np.uint64)).tobytes()
    sets = spark.createDataFrame([(1, 5, 90, own), (2, 5, 90, own), (3, 6, 90, own), (1, 5, 90, own)], "mark long, node long, n long, grams binary").repartition(4)
    classes = spark.sparkContext.broadcast(bytes(1 << ngramjoin.COUNTERS))
    shaped = ngramjoin.prefixes(sets, spark.createDataFrame([(1,), (3,)], "mark long"), 85, classes)
    assert shaped._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    once = ngramjoin.only_once(ngramjoin.written(shaped.withColumn("row", F.monotonically_increasing_id()), "prefixes"))
    assert sorted(r["node"] for r in once.collect()) == [5, 6]


VECTORS = "vec_id long, embedding array<double>, label int, score string, id string"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, c, "extra", "extra") for k, c, v in rows], VECTORS).repartition(5)


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(negatives, "HELD", 200)
    monkeypatch.setattr(negatives, "AT_ONCE", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    draw = random.Random(5)
    rows = [(i, draw.randint(0, 3), [draw.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(6)]) for i in range(0, 700, 4)]
    rows += [(i, 1, [0.5] * 6) for i in range(1001, 1040)]  # many equal vectors
    rows += [(100, 2, [0.1] * 6), (100, 1, [0.2] * 6), (200, None, [0.5] * 6), (900, 3, None), (1100, 2, [float("nan")] * 6)]
    rows += [(1200, 2, [None, 1.0]), (1300, 2, [float("inf")]), (1400, 2, []), (1500, 2, [1.0]), (None, 2, [1.0] * 6), rows[0], rows[0]]
    rows += [(1600, 9, [1.0] * 6), (1700, 0, [0.0] * 6)]
    got = rows_of(negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 100 == 0))
    assert got == order(brute.hard_negatives(rows)) and got
    none = vectors(spark, rows).filter("false")
    assert negatives.hard_negatives(none, F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(vectors(spark, rows), F.lit(False)).count() == 0


def test_hard_negatives_of_large_components(spark):
    draw = random.Random(6)
    rows = [(i, i % 3, [draw.uniform(-1, 1) * 2.0**22 for _ in range(3)]) for i in range(0, 400, 10)]
    got = rows_of(negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 100 == 0))
    assert got == order(brute.hard_negatives(rows)) and got
    a = np.array([[1 << 62, 1 << 62]])
    assert negatives.scores(a, a).tolist() == [[(1 << 63) - 1]] and negatives.scores(a, -a).tolist() == [[-(1 << 63)]]


@pytest.fixture(scope="module")
def vocabularies():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


TEXTS = [
    "one two  three\n\nfour\t five <|endoftext|> it's we'll 'tis 12,345.67 naïve", " leading", "trailing ", " ", "\n", "  ", "a", "'s",
    "日本語のテキスト。これは空白がありません、そして長い文です。" * 40, "a▁b", "ﬁ ① Ａ é ́x", "<s> </s> <0x41> <unk>", "x\x00y\x1cz \x1c q", "…" * 30,
    "semi;colon,and.no-space(anywhere)in!this?long_text" * 20, "word " * 300, " no break 　 wide", "😀 😀👍🏽 emoji",
    "don't  stop\r\nnow 'm 're x'sy z" * 9, "Ünïcödé " * 40,
]


def test_alignment(spark, rows, docs, none, vocabularies):
    more = [(2000 + i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (2000, TEXTS[0])]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    every = every.withColumns({c: F.lit("extra") for c in ("row", "doc", "n_a", "part", "link", "times")})
    got = rows_of(alignment.aligned(every, *vocabularies))
    assert got == order(brute.alignment([r[:2] for r in rows] + more, *vocabularies))
    assert alignment.aligned(none, *vocabularies).count() == 0


def test_texts_are_encoded_once(spark, vocabularies, tmp_path):
    """Links are counted, then looked up, from what was written of the texts; they are not read a second time."""
    given = [(i, t) for i, t in enumerate(TEXTS)] + [(5, None), (None, "")]
    spark.createDataFrame(given, "doc_id long, text string").write.parquet(str(tmp_path / "texts"))
    got = alignment.aligned(spark.read.parquet(str(tmp_path / "texts")), *vocabularies)
    assert got.inputFiles() and not any(str(tmp_path) in f for f in got.inputFiles())
    assert rows_of(got) == order(brute.alignment(given, *vocabularies))


def test_alignment_of_byte_ranges(spark, rows, vocabularies, monkeypatch):
    """Ranges of a few bytes, so that most texts are composed from many fragments, and id pairs in several parts."""
    monkeypatch.setattr(alignment, "PAIRS", 1500)
    given = [r[:2] for r in rows[:45]] + [(2000 + i, t) for i, t in enumerate(TEXTS)]
    got = rows_of(alignment.aligned(spark.createDataFrame(given, "doc_id long, text string"), *vocabularies, size=40, fan=3))
    assert got == order(brute.alignment(given, *vocabularies))


def test_fragments_compose_in_any_order(vocabularies):
    own = alignment.Tokenizers(*vocabularies)
    for text in TEXTS:
        text = " " + text
        ids, others = own.a_part(text), own.b_part(text)
        ends = [np.cumsum([len(x) for x in part]) for part in ([own.a_bytes[i] for i in ids], [own.b_bytes[i] for i in others])]
        if not len(ids) or ends[0][-1] != ends[1][-1]:
            continue
        draw, numbers = random.Random(len(text)), [np.array(v) for v in (ids, others)]
        whole = alignment.grouped(alignment.Tokens(numbers[0], ends[0], numbers[1], ends[1]))
        for _ in range(8):
            # each vocabulary is cut anywhere, the other elsewhere
            cuts = [[0, *sorted(draw.choices(range(len(n) + 1), k=4)), len(n)] for n in numbers]
            parts = [
                alignment.Fragment.of(alignment.Tokens(numbers[0][a:x], ends[0][a:x], numbers[1][b:y], ends[1][b:y]))
                for (a, x), (b, y) in zip(itertools.pairwise(cuts[0]), itertools.pairwise(cuts[1]), strict=True)
            ]
            while len(parts) > 1:
                k = draw.randrange(len(parts) - 1)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            found = parts[0].whole()
            assert found.text == whole.text and found.links.tolist() == whole.links.tolist()


def test_cuts_part_both_vocabularies(vocabularies):
    own = alignment.Tokenizers(*vocabularies)
    assert own.parts_at_spaces
    for text in TEXTS:
        text = " " + text
        for at in range(1, len(text), 3):
            i, j = own.cut_a(text, at), own.cut_b(text, at)
            if i < len(text):
                assert own.a_part(text[:i]) + own.a_part(text[i:]) == own.a_part(text)
            if j < len(text):
                assert own.b_part(text[:j]) + own.b_part(text[j:]) == own.b_part(text)


def test_queries_on_pairs(spark, vocabularies):
    from granary.llm.queries import QUERIES

    given = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op11_ngram_jaccard_join"](spark, SMALL)) == order(brute.similar(given))
    assert rows_of(QUERIES["op13_token_alignment"](spark, SMALL)) == order(brute.alignment(given, *vocabularies))
