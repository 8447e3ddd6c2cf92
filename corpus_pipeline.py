"""A training corpus in five stages; each is written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.llm import decontamination, jaccard_join, line_dedup, mixing, toxicity
from tallyroom.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies share 80 of 100 shingles of five words; the query op10_jaccard_join has its own contract (4 and 85).
SHINGLE_WORDS, PERCENT = 5, 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects by their language's threshold go."""
    scored = toxicity.classify_toxicity(docs, _table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where("NOT rejected").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are deleted; a document that loses all its words goes, n_chars is that of what stays."""
    clean = line_dedup.dedup_lines(docs)
    left = clean.where("n_deleted = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    return left.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect, the document with the smallest id stays; links as in SHINGLE_WORDS and PERCENT."""
    return jaccard_join.one_of_each_group(docs, size=SHINGLE_WORDS, percent=PERCENT).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others, what occurs in the benchmark is cut."""
    clean = decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with what the mix takes of them: the text ``full`` times, and the spans of words in ``once_more``."""
    return mixing.mix(docs, keep=COLUMNS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing", mix_sources),
]
#: SQL can't score a trained network: the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
