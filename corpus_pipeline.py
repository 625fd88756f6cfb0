"""Corpus pipeline: quality rules, line dedup, near-dedup by fingerprints, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All
but the last return the columns of documents; n_chars follows the text. The last adds size, source_size, target, repeats
and taken, and leaves out documents that the mix takes no time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pregonero.llm import decontamination, line_dedup, mixing, near_copies, quality_rules, simhash
from pregonero.llm.store import columns_clear_of, stage, table
from pregonero.session import drop_dir, work_dir


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, rejected documents go."""
    return _recounted(quality_rules.clean(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go, and documents of which nothing is left."""
    return _recounted(line_dedup.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: SimHash fingerprints over five-word shingles that differ in 3 or fewer bits.

    Texts with a similarity of 0.8 differ in about 10 bits, beyond what fingerprints can be searched for, so groups of a Jaccard
    similarity of 0.8 or more are found by minimum hashes first. Line dedup has cut what near copies share out of the later
    ones, so these are told by the whole texts in documents as well. Doing this first, SimHash only ever takes more.
    """
    below = work_dir(spark, "near")
    left = near_copies.keep_one(docs, shingle=5, similarity=0.8, earlier=table(spark, sf_dir, "documents"), below=below)
    kept = simhash.keep_one(left, shingle=5, radius=3)  # has written what it needs of these rows
    drop_dir(spark, below)
    return kept


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words of a benchmark item in a row go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of repeats."""
    repeats = columns_clear_of(docs, "repeats")["repeats"]
    return mixing.mix(docs, keep_columns=True).filter(F.col(repeats) > 0)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", contamination),
    ("mixing", mixture),
]

#: Fingerprints and alignment are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
