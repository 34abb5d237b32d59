"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again before the next.

Quality rules, quality classifier, SimHash near-dedup and benchmark decontamination each drop documents and return the
columns they were given; best-fit packing returns the packed pieces of what is left, with their token ids.  SQL cannot
express suffix arrays, EM or a tokenizer, so ORACLE_SQL is None and tests/llm hold the stages against brute-force versions.

Defined cases: a null or empty text fails the quality rules; rows without an id and rows that share one are judged by
their texts, each on its own; repeated rows end as one; an empty table runs through to an empty result; other columns are
carried as far as packing, which does not read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orthospark.llm import decontaminate, near_copies, packing, repetition, weak_labels
from orthospark.llm.common import written

ORACLE_SQL = None
#: Most documents in a sequence: a limit that binds where texts are short.
SEQUENCE_DOCUMENTS = 128
#: Words that each of a worker's two stores of encoded words keeps: workers also hold what earlier stages left.
KEPT_WORDS = 100_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule or repeat themselves too much."""
    return repetition.keep(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the scorer calls junk or toxic; it is fitted to this stage's own input."""
    return weak_labels.keep(docs, weak_labels.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word Jaccard similarity of 0.8 at least, proposed by fingerprints): the one with the smallest id."""
    return near_copies.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a verbatim benchmark passage."""
    return decontaminate.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of at most SEQUENCE_DOCUMENTS documents; a row a piece, with its ids."""
    return packing.pack(packing.pieces(docs, kept_words=KEPT_WORDS), documents=SEQUENCE_DOCUMENTS)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
