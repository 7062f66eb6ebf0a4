"""A training-corpus pipeline of five stages; each is one operator of the llm subpackage with production parameters.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, is written as Parquet and read again for the next one.
All but the last return the columns of documents, for the rows they keep. An empty table stays empty in every stage. Null
texts have no language and go in the first stage; later stages take them as empty. All stages decide row by row, also where an
id is null or occurs more than once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import decontaminate, exact_dedup, jaccard, language, mixing
from marketloom.llm.common import numbered, read, written

#: Least posterior of the predicted language for a document to stay.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a clear language; those without letters or with a score below LEAST_SCORE go. All rows with a lang are learned from; those without are judged like all."""
    model = language.train(docs)
    marked = language.identify(docs.withColumnsRenamed({c: f"c_{c}" for c in docs.columns}), model, "c_text")
    kept = marked.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(f"`c_{c}`").alias(c) for c in docs.columns])


def _one_of_each(docs: DataFrame, groups: Callable[[DataFrame], DataFrame], group: Column) -> DataFrame:
    """Of the rows of ``docs`` that share a ``group`` in groups(docs), whose doc_id is a row number, the one with the smallest id (null last) and number."""
    numbers = numbered(docs, "_row")
    found = groups(numbers.withColumn("doc_id", F.col("_row"))).select(F.col("doc_id").alias("_row"), group.alias("_group"))
    ids = numbers.select("_row", F.col("doc_id").alias("_id"))
    first = found.join(ids, "_row").groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("first"))
    return numbers.join(first.select(F.col("first.row").alias("_row")), "_row", "left_semi").drop("_row")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that with the smallest id (null last), of each group of equal texts; of rows equal in both, any one."""
    return _one_of_each(docs, exact_dedup.exact_dedup, F.col("keep_id"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that with the smallest id (null last), of each group linked at five-word shingles and 0.8 or more. Texts without words are linked with nothing and stay."""
    return _one_of_each(docs, lambda d: jaccard.similar_classes(d, width=5, percent=80), F.col("component_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows in whose text no benchmark item was found, whatever their ids."""
    numbers = numbered(docs, "_row")
    hits = decontaminate.contaminated(numbers.withColumn("doc_id", F.col("_row")), read(spark, sf_dir, "benchmark"))
    return numbers.join(hits.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").drop("_row")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the words the mix takes of each."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "copies", "taken")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language models and latent retrieval have no SQL form; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None
