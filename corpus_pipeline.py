"""The corpus pipeline: toxicity, near duplicates, benchmark passages, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the
shared folder and read again as the next one's documents. All but the last return the columns of
the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestegg.llm.common import fresh, held_out, labelled_documents, read_table, stage
from nestegg.llm.decontaminate import decontaminate
from nestegg.llm.mixing import mix, taken_words
from nestegg.llm.secret_scan import learn_network, redact
from nestegg.llm.simhash import deduplicate
from nestegg.llm.toxicity import SAMPLE_ROWS, learn_lexicon, with_toxicity

TOXIC_FROM = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    labels = read_table(spark, sf_dir, "labels").filter(~held_out("doc_id", 5, 0))
    lexicon = learn_lexicon(labelled_documents(docs, labels, "toxic", SAMPLE_ROWS))
    score = fresh(docs, "score")
    return with_toxicity(docs, lexicon, score).filter(F.col(score) < TOXIC_FROM).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 2 or fewer fingerprint bits, the one with the smallest id stays."""
    return deduplicate(docs, shingle=3, radius=2)


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Occurrences of benchmark phrases are removed from the texts."""
    return with_length(decontaminate(docs, read_table(spark, sf_dir, "benchmark")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Findings are replaced by a mark."""
    return with_length(redact(docs, learn_network(docs)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of what is left: words taken of each document."""
    return taken_words(mix(docs, weights=[3, 1, 2], share=1.5, max_repeat=2))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scan),
    ("mixing", mixing),
]

#: SQL can't express the fingerprints, the trained models or the permutations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
