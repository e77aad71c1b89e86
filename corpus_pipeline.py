"""The text pipeline: toxic documents go, repeated lines go, one document of each near-duplicate group stays,
documents with benchmark passages go, and what is left is encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricelens.llm import byte_bpe, decontamination, line_dedup, simhash, toxicity
from pricelens.llm.common import written
from pricelens.llm.queries import RANKS, table, vocabulary

#: No SQL: the toxicity model is learned, and near duplicates and tokens have no SQL form.
ORACLE_SQL = None


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id and text, with all other columns in one, where no name can meet those that a stage adds."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("_")).alias("_own"))


def _wide(narrow: DataFrame, columns: list[str]) -> DataFrame:
    return narrow.select([F.col(c) if c in ("doc_id", "text") else F.col("_own")[c].alias(c) for c in columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _wide(toxicity.scores(_narrow(docs), model).where("predicted = 0"), docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with lines of other documents dropped from their texts and n_chars counted again."""
    out = _wide(line_dedup.without_repeated_lines(_narrow(docs)), docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of fingerprints linked within two bits (three-word shingles)."""
    return simhash.first_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' own columns, token ids, their number, and whether the ids decode to the text. Own columns named
    like one of these three are replaced."""
    ranks, pattern = vocabulary(RANKS), public_tokenizers.PATTERN
    out = byte_bpe.encode_and_decode(_narrow(docs), ranks, pattern)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    new = [F.col("ids"), F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip")]
    own = [c for c in docs.columns if c not in ("ids", "n_tokens", "round_trip")]
    return out.select([F.col(c) if c in ("doc_id", "text") else F.col("_own")[c].alias(c) for c in own] + new)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash", first_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("byte_bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; between stages the documents are a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
