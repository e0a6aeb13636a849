"""Queries over the whole tables, one or two for each operator of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, language_id, language_model, license_scan, media, mixing, neighbours, ngram_join, quotes, sentencepiece_bpe, sharding, spelling, toxicity
from .common import held_out, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = ngram_join.join(table(spark, sf_dir, "documents"), n=3, similarity=(90, 100))
    return out.select("doc_id", "n_shingles", "component_id")


def op3_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With how many other documents each one links: every link is verified."""
    out, _ = ngram_join.join(table(spark, sf_dir, "documents"), n=3, similarity=(90, 100), every=True)
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.predict(docs, language_id.fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.to_media(table(spark, sf_dir, "documents")))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def tokenizer_file(name: str = "piece_bpe_32k.model") -> str:
    """Where the public tokenizers' package has a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file())


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.log_scores(table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        *(op1_sharding, op2_mixing, op3_ngram_join, op3_ngram_links, op4_language_id, op5_quotes, op6_media, op7_neighbours),
        *(op8_toxicity, op9_sentencepiece, op10_language_model, op11_license_scan, op12_spelling, op13_conversation_trie),
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.ORACLE,
        "op3_ngram_join": ngram_join.ORACLE,
        "op5_quotes": quotes.ORACLE,
        "op11_license_scan": license_scan.ORACLE,
        "op12_spelling": spelling.ORACLE,
        "op13_conversation_trie": conversation_trie.ORACLE,
    }
