"""The training-text pipeline: quality rules, near-dedup, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns the rows of ``documents`` that it keeps, in whole, and leaves
null, empty, very long and repeated rows, null ids and empty tables to its operator, whose docstring says what
becomes of them; other columns go along. The last one writes token files and returns what it reads back from them. ``run`` writes every stage's rows
to the shared folder and hands the next one a scan of them, so a lost executor costs no finished stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planloom.llm import decontaminate, mixing, quality, simhash, token_output
from planloom.llm.common import materialize
from planloom.llm.queries import table, tokenizer_path

#: The most repeated source is passed so many times; the largest source once, so no document is left out.
MAX_PASSES = 1.5
#: Less than the operator's default: the stage follows others in the same executors.
CACHE_WORDS = 250_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document with the smallest id stays: SimHash finds links, texts decide, an exact join adds what fingerprints miss."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the smaller sources are repeated towards equal weights."""
    return mixing.mix(docs, max_passes=MAX_PASSES)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids in ascending document order, read back."""
    return token_output.encode_and_read_back(docs, tokenizer_path(), cache_words=CACHE_WORDS)


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("decontamination", decontamination), ("source mixing", source_mixing), ("token files", token_files)]

#: Fingerprints, hashed n-grams and tokenizers have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
