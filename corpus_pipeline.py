"""A corpus pipeline of five stages: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before it kept, and
returns a DataFrame, which `run` writes and reads again as the next one's `docs`. All but the
last return the columns of `documents`; `n_chars` follows the text.

Defined results: a null or empty text fails the quality rules and goes there. A null doc_id is an id
like any other, a null source a source of its own. Rows that repeat as a whole pass the rules and line
dedup each, and of them one stays after near-dedup. A text that loses all its lines goes with them. Texts are
taken whole at any length. From an empty table every stage makes an empty one. Columns besides those of
`documents` are left behind by the first stage, whatever they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom.llm import bpe, lines, minhash, mixing, quality
from rayloom.llm.common import cut, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.passing(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; a document of nothing but such lines goes with them."""
    out = lines.line_dedup(docs.select(*COLUMNS), F.col("source"))
    left = (F.col("line_dedup.n_dropped") == 0) | (F.col("line_dedup.n_lines") > F.col("line_dedup.n_dropped"))
    return out.where(left).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    rows = docs.select(*COLUMNS)
    digest = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    found = minhash.near_duplicates(rows, "doc_id", "text", length=5).where("first").select(F.col("key").alias("__key"), F.col("md5").alias("__md5"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__key")) & (digest == F.col("__md5")), "left_semi")
    if not rows.groupBy("doc_id", digest.alias("d")).count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])  # rows that repeat as a whole
    return out.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources' words come near their targets."""
    out = mixing.mix(docs.select(*COLUMNS), "doc_id", "source", mixing.n_words(F.col("text")))
    return mixing.repeat_rows(out, F.col("mix.times")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the text that they decode to by digest."""
    out = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id", "source"])
    return out.select("doc_id", "source", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: SQL cannot express near-dedup and BPE; tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
