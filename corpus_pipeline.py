"""A corpus pipeline over `documents`: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.llm import bpe, exact, mixing, simhash, toxicity
from sparkveil.llm.common import free_name, shared_folder, stored, table
from sparkveil.llm.queries import mixing_model, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go; the rest stays as it is."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.where(F.col(scored.columns[-2]) < 0.5).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the smallest id stays."""
    return exact.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 over five-word shingles the smallest id stays."""
    return simhash.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of rarer languages are repeated until the languages meet their weights."""
    return mixing.repeated(docs, mixing_model(spark, sf_dir, docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with a mark for texts that come back unchanged.

    Columns of `docs` that are named like ours keep their names; ours get a trailing underscore.
    """
    rest = [c for c in docs.columns if c != "text"]
    digest, ids, n_tokens, same = (free_name(docs, c) for c in ("text_sha256", "ids", "n_tokens", "round_trip"))
    rows = docs.withColumn(digest, F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256))
    back = bpe.encode(rows, tokenizer_path(), into=ids, unchanged=same)
    return back.select(*(F.col(f"`{c}`") for c in rest), digest, ids, F.size(ids).cast("long").alias(n_tokens), same)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

#: SQL has no segment scan, fingerprint link or merge encoder; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
