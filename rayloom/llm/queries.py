"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, codes, embeddings, lines, minhash, mixing, pieces, quality, repeats, resample, sharding, tokens, toxicity
from .common import read
from .oracles import ORACLES  # noqa: F401


def op1_shard_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard_documents(read(spark, d, "documents"))


def op2_bpe(spark: SparkSession, d: str) -> DataFrame:
    out = bpe.encode(read(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])
    return out.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_token_files(spark: SparkSession, d: str) -> DataFrame:
    out = tokens.tokenize_to_files(spark, read(spark, d, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumnRenamed("key", "doc_id")


def op4_mix_sources(spark: SparkSession, d: str) -> DataFrame:
    out = mixing.mix(read(spark, d, "documents").select("doc_id", "source", "text"), "doc_id", "source", mixing.n_words(F.col("text")))
    return out.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op5_embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = embeddings.near_vectors(read(spark, d, "embeddings").select("vec_id", "embedding"))
    return out.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("key") == F.col("component"), F.col("first")).alias("kept"))


def op6_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.train(docs, read(spark, d, "labels")), ["doc_id"])
    return out.select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").select("page_id", lines.host_of(F.col("url")).alias("host"), lines.html_lines(F.col("html")).alias("text"))
    out = lines.line_dedup(pages, F.col("host"))
    return out.select("page_id", "host", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_minhash(spark: SparkSession, d: str) -> DataFrame:
    out = minhash.near_duplicates(read(spark, d, "documents").select("doc_id", "text"), length=4)
    return out.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("key") == F.col("component"), F.col("first")).alias("kept"))


def op9_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    out = quality.quality_rules(read(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[f"quality.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op10_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = repeats.remove_repeats(read(spark, d, "documents").select("doc_id", "text"), ["doc_id"])
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "shares_passage")


def op11_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    out = pieces.encode(read(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_vector_codes(spark: SparkSession, d: str) -> DataFrame:
    out = codes.compress(read(spark, d, "embeddings").select("vec_id", "embedding", "label"), "vec_id", "embedding", "label")
    # a code has a byte a part, so its hexadecimal digits stand two by two
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def op13_resample(spark: SparkSession, d: str) -> DataFrame:
    out = resample.resample(read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "benchmark").select("text"))
    return out.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline  # stands at the top of the repository and imports this subpackage

    return corpus_pipeline.run(spark, d)


QUERIES = {f.__name__: f for f in (op1_shard_shuffle, op2_bpe, op3_token_files, op4_mix_sources, op5_embedding_dedup, op6_toxicity, op7_line_dedup, op8_minhash, op9_quality_rules, op10_suffix_dedup, op11_sentencepiece, op12_vector_codes, op13_resample, pipeline)}
