"""A training-corpus pipeline: each stage takes the documents its predecessor kept.

All stages take null ids, texts, languages and sources, empty and very long texts; null texts count as empty. Rows that share an id, or
everything, are documents of their own, of which near-dedup keeps one and the others keep or drop each alike. Extra columns are carried along, whatever their names.
An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailwarden.llm.common import table, written
from mailwarden.llm.decontamination import uncontaminated
from mailwarden.llm.line_dedup import dedup_lines
from mailwarden.llm.mixing import mixed_documents
from mailwarden.llm.near_dedup import one_of_each_class
from mailwarden.llm.quality import accepted, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from labels outside the held-out fold."""
    return accepted(docs, train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more stay in the first of them only. A document may end up empty; it keeps its row.

    n_chars, where there is one, follows the text.
    """
    out = dedup_lines(docs, min_docs=10, keep_first=True).select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with how many it takes (repeats counted) and their source's target."""
    return mixed_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("source mix", source_mix),
]

#: The stages learn, hash and sample; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
