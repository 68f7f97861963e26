"""The four raw files of the corpus, read into two common schemas: cleaned, deduplicated, filtered by length and scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..operators import curation
from . import readers

JOB_COLUMNS = ["source_dataset", "source_id", "job_title", "description", "occupation_group", "source_category", "quality_score", "word_count", "job_type", "location", "organization", "page_url"]
RESUME_COLUMNS = ["source_dataset", "source_id", "resume_text", "resume_group", "source_category", "quality_score", "word_count"]


def scored(df: DataFrame, text: str, kind: str, order: str) -> DataFrame:
    """``df`` with its text cleaned, one row of each text (the first by ``order``), word_count in bounds, quality_score."""
    least, target, most = C.QUALITY[kind]
    markers = C.CV_MARKERS if kind == "cv" else C.JD_MARKERS
    cleaned = curation.deduplicate(df.withColumn(text, T.clean_text(F.col(text), compose=True)), text, order)
    kept = cleaned.withColumn("word_count", T.word_count(F.col(text))).filter(F.col("word_count").between(least, most))
    return kept.withColumn("quality_score", curation.quality_score(F.col(text), target, most, markers))


def _read(spark: SparkSession, path: str, columns: dict[str, str], source: str) -> DataFrame:
    df = readers.read_csv(spark, path, list(columns.values())).toDF(*columns)
    return readers.with_row_index(df, "_row").withColumn("source_dataset", F.lit(source))


def _said(name: str) -> Column:
    """A value as text; a missing one is the word nan, as in the files that went before."""
    return F.coalesce(F.col(name), F.lit("nan"))


def monster_jobs(spark: SparkSession, path: str) -> DataFrame:
    """JOB_COLUMNS; the group follows from title, sector and the first 1,500 characters of the description."""
    names = {"source_id": "uniq_id", "job_title": "job_title", "description": "job_description", "source_category": "sector"} | {c: c for c in JOB_COLUMNS[-4:]}
    df = _read(spark, path, names, "monster_com-job_sample.csv")
    about = F.concat_ws(" ", _said("job_title"), _said("source_category"), F.substring(_said("description"), 1, 1500))
    df = df.withColumn("occupation_group", curation.job_group(about)).withColumn("source_category", F.coalesce("source_category", F.lit("Unknown")))
    return scored(df, "description", "jd", "_row").select(JOB_COLUMNS)


def title_jobs(spark: SparkSession, path: str) -> DataFrame:
    """JOB_COLUMNS; all of one group, the title is the category; what the file lacks is empty text.

    The file's first column, the row's number, has no name of its own; readers call it _c0.
    """
    names = {"source_id": "_c0", "job_title": "Job Title", "description": "Job Description"}
    df = _read(spark, path, names, "job_title_des.csv").withColumn("occupation_group", F.lit("Technology")).withColumn("source_category", F.col("job_title"))
    df = df.withColumns({c: F.lit("") for c in JOB_COLUMNS[-4:]})
    return scored(df, "description", "title_jd", "_row").select(JOB_COLUMNS)


def resumes(spark: SparkSession, path: str) -> DataFrame:
    """RESUME_COLUMNS; the group is the category in title case, Unknown where it is missing."""
    df = _read(spark, path, {"source_id": "ID", "resume_text": "Resume_str", "source_category": "Category"}, "Resume.csv")
    df = df.withColumn("resume_group", T.title_label(F.coalesce("source_category", F.lit("Unknown"))))
    return scored(df, "resume_text", "cv", "_row").select(RESUME_COLUMNS)


def labelled_resumes(spark: SparkSession, path: str) -> DataFrame:
    """RESUME_COLUMNS; ids are the numbers of the rows, the group follows from the label."""
    df = _read(spark, path, {"resume_text": "Resume", "source_category": "Label"}, "Resume data.csv").withColumn("source_id", F.col("_row").cast("string"))
    df = df.withColumn("resume_group", curation.resume_group(F.coalesce("source_category", F.lit("Unknown"))))
    return scored(df, "resume_text", "cv", "_row").select(RESUME_COLUMNS)
