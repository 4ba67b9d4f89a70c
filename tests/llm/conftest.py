from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as columns that a caller may have.
CLASHES = ["n_words", "kept", "fingerprint", "component", "shard", "start", "similarity", "_text", "_key", "mark", "value", "m", "line", "node", "_words"]


def tricky() -> list[tuple]:
    """Nulls in every column, empty and blank texts, one-word texts, ties, repeated rows and ids, a long text."""
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["Über", "naïve", "日本", "the", "The"]
    prose = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    base, passage, line = prose(60), prose(30), "A line that many documents share"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " end", "en", "a"), (4, base.upper(), "en", "b"),
        (5, None, "en", "a"), (6, "", "de", "b"), (7, " \n\t ", None, "b"), (8, "word", "en", None), (9, "word", "en", None),
        (None, base, None, None), (None, None, None, None), (10, prose(40) + " " + passage + " " + prose(40), "en", "a"),
        (11, passage + " " + prose(20), "en", "a"), (12, prose(20) + " " + passage, "en", "a"), (12, "another text of the same id", "en", "a"),
        (13, f"{line}\n  {line.upper()}\t\nshort\n\n{prose(12)}", "en", "b"), (14, f"short\n{line}\n{prose(12)}\n{line}", "en", "b"),
        (15, " ".join([prose(6)] * 12), "en", "a"), (16, "a " * 50, "en", "a"), (17, prose(9000), "fr", "c"),
        (18, " ".join(f"{w}%&$" for w in prose(30).split()), "en", "a"), (19, "  two  spaces \n and more  " + prose(12), "en", "a"),
    ]
    rows += [(i, prose(draw.randint(12, 80)), draw.choice(["en", "de"]), draw.choice("abc")) for i in range(30, 90)]
    return rows


@pytest.fixture(scope="session")
def rows(spark) -> list[tuple]:
    own = [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in tricky()]
    given = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    return own + [(r["doc_id"] + 1000, r["text"], r["lang"], r["source"], r["n_chars"]) for r in given[:60]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows in several partitions, with extra columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, DOCS).repartition(3).withColumns({c: F.lit(f"extra {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("false")


@pytest.fixture(scope="session")
def vocabulary() -> str:
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
