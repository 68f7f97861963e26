"""A training corpus from raw documents: five stages, each applied to all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import core, decontam, jaccard, langid, packing
from pairloom.llm import lines as line_templates

#: Texts of which the best language holds less than this share of the n-grams are rejected.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; a missing label gets the predicted one.

    Null, empty and letterless texts go, and so does all if no row has a label.
    """
    core.release()
    model = langid.train(docs)
    found = langid.predict(docs, model)
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes recurring lines out; a document that had nothing else goes.  Null and empty texts stay."""
    core.release()
    done = line_templates.drop_lines(docs).filter((F.col("n_dropped") == 0) | (F.col("text") != ""))
    return done.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, as do all without words."""
    core.release()
    return jaccard.keep_one(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; others stay, whatever their key."""
    core.release()
    return decontam.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; null and empty texts have their end id."""
    core.release()
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pack", pack),
]

#: Language models, tokenizers and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet and read again."""
    docs = core.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = core.keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
