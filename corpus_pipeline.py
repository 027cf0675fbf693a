"""Corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``. Nulls, empty texts and repeated rows go through each stage as its operator states.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import byte_bpe, decontamination, line_dedup, quality, simhash
from kinmatch.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, rules)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that repeat or (from 16 characters on) nearly do the first stays; documents of which nothing is left go. n_chars follows the text."""
    return line_dedup.deduplicate(docs, exact_chars=1).withColumn("n_chars", F.length("text").cast("long"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one row stays, that of the smallest id; one without an id if a group has no other.

    Groups are of fingerprints, not of ids: rows that share an id or have none are told apart by their texts. Of rows of
    one id and fingerprint one stays, the same on every run unless they are equal throughout.
    """
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("text"))
    prints = simhash.with_fingerprints(whole, "print").withColumn("hash", F.xxhash64("row"))
    rows = stored(prints.select("id", "print", "hash"))
    component = simhash.print_components(rows.select("print").distinct())
    order = F.struct(F.col("id").isNull().alias("none"), "id", "print", "hash")
    first = rows.join(component, F.col("print") == F.col("node"), "left").groupBy(F.coalesce("component", "print")).agg(F.min(order).alias("first"))
    stay = first.select("first.print", "first.hash")
    return prints.join(stay, ["print", "hash"], "left_semi").dropDuplicates(["print", "hash"]).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an occurrence of a benchmark window go; null texts have none and stay."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), clean=True)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document left."""
    return byte_bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontaminate),
    ("byte-level bpe", byte_bpe_stage),
]

#: The learned rules, the fingerprints and the token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared checkpoint folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs)
    return docs
