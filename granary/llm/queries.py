"""The registered queries of this subpackage: each operator on its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import (
    alignment,
    classifier,
    decontamination,
    lines,
    neardup,
    negatives,
    ngramjoin,
    packing,
    pii,
    quality,
    sharding,
    substrings,
    tokenfiles,
)
from granary.llm.oracles import SQL  # noqa: F401
from granary.llm.store import written


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang", "source")
    metrics = written(quality.with_metrics(quality.with_counts(docs)).drop("text"), "metrics")
    return quality.judged(metrics, quality.corpus_limits(metrics)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op3_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, folder)).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizers lie on every machine; their path is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    manifest = tokenfiles.write_tokens(documents(spark, folder), vocabulary(), end_id=0)
    return tokenfiles.read_tokens(manifest)


#: Stands in for the secret key that a caller passes.
EXAMPLE_KEY = b"an example; pass your own secret"


def op5_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.with_pseudonyms(documents(spark, folder).select("doc_id", "text"), EXAMPLE_KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct("pii.kind")), ",")
    return found.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), kinds.alias("kinds"))


def op6_packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.token_pieces(documents(spark, folder), vocabulary(), length=2048, end_id=1), length=2048)


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = lines.drop_repeated_lines(documents(spark, folder).select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_passage_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = substrings.drop_repeated_passages(documents(spark, folder).select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(~held_out)
    docs = documents(spark, folder).select("doc_id", "text")
    scored = classifier.with_score(docs, classifier.train(docs, labels))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op10_stratified_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder).select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("text_crc32"),
    )
    return sharding.interleave(rows, shards=16, ties=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def op11_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngramjoin.similar_documents(documents(spark, folder), size=4, percent=85).withColumnRenamed("component", "component_id")


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0, scale=256, low=30, high=90)


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned(documents(spark, folder), vocabulary(), vocabulary("piece_bpe_32k.model"))


QUERIES = {
    name: function for name, function in sorted(globals().items()) if name.startswith("op") and callable(function)
}
