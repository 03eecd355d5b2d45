"""From documents to packed token sequences, a stage for each step.

Every stage takes any documents table: null and empty texts, repeated rows, null ids and
further columns pass as the operators' docstrings say. A stage that changes texts sets
`n_chars` anew, where there is such a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import langid, near, packing, pii, repeats
from leafmill.llm.common import documents, every_column, fresh, shared_dir, written

#: A posterior below this names no language; with few languages only texts that fit several alike fall under it.
LEAST_SCORE = 0.3


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with no language to name, go; without any label to learn from, only the former."""
    model = langid.learned(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    found = langid.predicted(docs, model, lang, score)
    return found.where((F.col(lang) != langid.UND) & (F.col(score) >= LEAST_SCORE)).select(every_column(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: one document of each group stays."""
    return near.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 50 words that an earlier document holds go."""
    return _measured(repeats.cut_texts(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets."""
    name = fresh(docs, "pii")
    found = pii.with_spans(docs, name)
    return _measured(found.withColumn("text", pii.redacted(F.col("text"), F.col(f"{name}.all")))).select(every_column(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids."""
    return packing.packed(docs)


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("pii", personal_data),
    ("best_fit_packing", sequences),
]
#: Tokenizers and the language model are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each result written and read again."""
    docs, folder = documents(spark, sf_dir), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"{folder}/{k}-{name}")
    return docs
