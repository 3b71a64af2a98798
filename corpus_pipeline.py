"""From raw documents to packed sequences: five stages over the corpus.

Every stage reads all that its predecessor kept, as Parquet, and its decisions
take effect: what it rejects is gone for the next.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrica.llm import jaccard, lines, packing, quality, secret_scan
from dendrica.llm.common import load, owned, passing, release, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy keeps."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line stays where it, or one within an edit, stands first; near copies that would lose their lines to an earlier document go whole, and so does a document that loses all its lines."""
    return _counted(lines.dedup_originals(docs).where("text IS NULL OR text <> ''"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates, of the texts that line dedup leaves."""
    return docs.join(_copies(docs), "doc_id", "left_anti").select(docs.columns).dropDuplicates(["doc_id", "text"])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    return _counted(secret_scan.redacted(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, neighbours along the curve together."""
    return packing.pack(docs)


def _stage(function):
    """The stage, which first deletes what the stages before it left in the shared folder: docs is what the last of them wrote."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(__name__, docs)
        with owned(__name__):
            return function(spark, docs, sf_dir)

    return run


STAGES = [(f.__name__, _stage(f)) for f in (quality_rules, line_dedup, near_duplicates, secrets, packed)]


def _copies(docs: DataFrame) -> DataFrame:
    """doc_id of near duplicates but the least of each group: five-word shingles, similarity 0.8 or more."""
    kind = jaccard.classes(docs.select("doc_id", "text"), size=5, percent=80)
    return kind.where("component_id <> doc_id").select("doc_id").distinct()


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs, folder = load(spark, sf_dir, "documents"), f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        passing(spark, folder)
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near duplicates, tokens and the curve are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
