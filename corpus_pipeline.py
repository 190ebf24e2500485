"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, folder) and works on all rows its predecessor
kept. Stages are written as Parquet and reread, so a lost executor costs no
more than the stage that runs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlife.llm import byte_bpe, language_id, mixing, secret_scan, simhash
from ledgerlife.llm.common import free, stored, table

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: SQL can't express the trained, hashed and tokenising stages; they are tested against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is recognised, with the language found as ``lang``."""
    model = language_id.fit(docs)
    aside = {c: n for c in docs.columns if c.lower() in ("language", "probability", "recognised") for n in free(docs.columns, f"_{c}")}
    found = language_id.identify(docs.withColumnsRenamed(aside), model, host_col="source").filter("recognised")
    return found.select(*(F.col("language").alias("lang") if c == "lang" else F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near-duplicates: fingerprints of three-word shingles within two bits."""
    return simhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with their secrets masked."""
    return secret_scan.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's cut is shortened."""
    return mixing.mix(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def encode_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document that the mix holds, decoded again as a check."""
    slim = docs.select("doc_id", "lang", "source", "text")
    decoded = byte_bpe.encode(slim, BYTE_BPE, public_tokenizers.PATTERN, decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return decoded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """Apply all stages to the documents of a folder."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
