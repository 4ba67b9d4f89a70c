"""The registered queries on a whole folder of the given tables: against their SQL, or against brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from granary.llm import pii
from granary.llm.queries import EXAMPLE_KEY, QUERIES, SQL
from granary.llm.tokens import Encoder
from tests.conftest import MEDIUM, SMALL
from tests.llm import brute
from tools.check_queries import compare


def run(spark, name, folder=SMALL):
    return QUERIES[name](spark, folder).toPandas()


@pytest.fixture(scope="module")
def given(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def items(spark):
    return [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]


def test_all_are_registered():
    numbers = Counter(int(n.split("_")[0][2:]) for n in QUERIES)
    assert numbers == Counter(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    ok, note = compare(spark, SMALL, name)
    assert ok, note


def test_op2_finds_every_hit(spark, given, items):
    found = {(r.doc_id, r.item_id): r.similarity for r in run(spark, "op2_decontamination").itertuples()}
    assert found == pytest.approx(brute.hits(given, items), abs=1e-6)


def test_op3(spark, given):
    got = run(spark, "op3_simhash_near_duplicates")
    assert sorted(got.itertuples(index=False, name=None)) == sorted(brute.components(given))


def test_op4(spark, given, vocabulary):
    got = run(spark, "op4_token_files").sort_values("doc_id").itertuples(index=False, name=None)
    library, start = Encoder(vocabulary).library, 0
    for row, (doc, text) in zip(got, sorted(given), strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert row == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op5(spark, given):
    got = {r.doc_id: r for r in run(spark, "op5_pseudonyms").itertuples()}
    permutation = pii.Permutation(EXAMPLE_KEY)
    for doc, text in given:
        new, spans = pii.pseudonymise(text, permutation)
        assert (got[doc].text, got[doc].n_pii) == (new, len(spans))
    assert any(r.n_pii for r in got.values()) and len(got) == len(given)


def packed(got, given, vocabulary):
    library = Encoder(vocabulary).library
    tokens = {doc: np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4") for doc, text in given}
    assert set(got["doc_id"]) == set(tokens)
    for doc, own in got.sort_values("start").groupby("doc_id"):
        assert own["start"].tolist() == (own["length"].cumsum() - own["length"]).tolist()
        assert own["length"].sum() == len(tokens[doc]) and set(own["doc_tokens"]) == {len(tokens[doc])}
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(tokens[doc][r.start : r.start + r.length].tobytes())
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == (own["length"].cumsum() - own["length"]).tolist() and own["length"].sum() <= 2048


def test_op6(spark, given, vocabulary):
    got = run(spark, "op6_packed_sequences")
    packed(got, given, vocabulary)
    assert got["length"].sum() > 0.97 * 2048 * got["sequence_id"].nunique()


def test_op9(spark):
    got = run(spark, "op9_quality_classifier", MEDIUM)
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.7)).all()
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").toPandas().merge(got[got["held_out"]], on="doc_id")
    assert (labels["quality"] == labels["predicted"]).mean() > 0.9


def test_op10(spark, given):
    got = run(spark, "op10_stratified_shards").set_index("doc_id")
    assert len(got) == len(given) and set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()
    for doc, text in given:
        data = (text or "").encode()
        assert (got.loc[doc, "size"], got.loc[doc, "text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and list(sizes.index) == list(range(16))
    assert all(sorted(own["slot"]) == list(range(len(own))) for _, own in got.groupby("shard"))


def test_pipeline_equals_brute_force(spark, given, items, vocabulary):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    kept = {r[0] for r in db.execute(f"SELECT doc_id FROM ({SQL['op1_quality_rules']}) WHERE kept").fetchall()}
    docs = brute.left_lines([r for r in given if r[0] in kept])
    stay = {component for _, _, component in brute.components([(d, t) for d, *_, t in docs])}
    docs = [(d, t) for d, *_, t in docs if d in stay]
    hit = {doc for (doc, _), v in brute.hits(docs, items).items()}
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    packed(got, [(d, t) for d, t in docs if d not in hit], vocabulary)


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        digest = lambda df: {(r["doc_id"], hashlib.md5(r["text"].encode()).digest()) for r in df.collect()}
        assert digest(out) != digest(docs), name
        assert stage(spark, docs.filter("false"), SMALL).count() == 0
