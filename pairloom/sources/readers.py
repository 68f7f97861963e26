"""Readers: CSV tables with column aliases, single text files, adapters of raw tables to one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Column names under which source files hold a field, in order of preference.
CV_ALIASES = {"text": ["Resume_str", "Resume", "resume", "text"], "id": ["ID", "id", "resume_id"], "label": ["Category", "Label", "category", "label"]}
JD_ALIASES = {"text": ["job_description", "Job Description", "description", "text"], "id": ["uniq_id", "id", "H1"], "label": ["job_title", "Job Title", "title"]}


def first_existing_column(df: DataFrame, names: list[str], required: bool = True) -> str | None:
    """The first of ``names`` that ``df`` has, by exact spelling; ValueError if a required one is missing."""
    found = next((n for n in names if n in df.columns), None)
    if found is None and required:
        raise ValueError(f"no column of {names} among {df.columns}")
    return found


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, infer: bool = False) -> DataFrame:
    """A CSV with a header, quoted fields of several lines and doubled quotes; all columns are strings, or of the type their values have."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", infer).csv(path)
    return df.select(*(F.col(f"`{c}`") for c in columns)) if columns else df


def with_row_index(df: DataFrame, name: str) -> DataFrame:
    """Numbers the rows of a scan from 0 in their order, with the row counts of its tasks, not in one task.

    ``df`` must be a plain scan, whose tasks hold the same rows each time.  The counts are one row per task.
    """
    low = F.lit((1 << 33) - 1)
    placed = df.withColumn("_at", F.monotonically_increasing_id())
    task = F.shiftright("_at", 33).cast("int")
    counts = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("_task", "n")).alias("all"))
    base = F.aggregate(F.filter("all", lambda x: x["_task"] < task), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return placed.crossJoin(F.broadcast(counts)).withColumn(name, base + F.col("_at").bitwiseAND(low)).drop("_at", "all")


def optional(df: DataFrame, name: str, default: Column) -> Column:
    """A column, or the default where the table has none of that name or a row has no value."""
    return F.coalesce(F.col(f"`{name}`"), default) if name in df.columns else default


def _load(spark: SparkSession, path: str, aliases: dict, key: str, label: str, prefix: str, limit: int | None) -> DataFrame:
    df = read_csv(spark, path)
    text, ident, name = (first_existing_column(df, aliases[k], k == "text") for k in ("text", "id", "label"))
    col = lambda c: F.col(f"`{c}`")
    kept = df.select(col(text).alias("text"), *([col(ident).alias("id")] if ident else []), *([col(name).alias("label")] if name else []))
    if ident is None or limit is not None:
        kept = with_row_index(kept, "_row")
    if limit is not None:
        kept = kept.filter(F.col("_row") < limit)
    ids = F.coalesce(F.col("id"), F.lit("nan")) if ident else F.concat(F.lit(prefix), F.col("_row").cast("string"))
    return kept.select(ids.alias(key), T.clean_text(F.coalesce("text", F.lit("nan")), compose=True).alias("text"), (F.col("label") if name else F.lit(None).cast("string")).alias(label))


def load_resumes(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(cv_id, text, category) of a CSV; ``limit`` keeps its first rows.

    A null text or id is the word nan, as in the files that went before; without an id column, ids are
    cv_ and the row's number; without a label column, categories are null.
    """
    return _load(spark, path, CV_ALIASES, "cv_id", "category", "cv_", limit)


def load_jobs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(jd_id, text, job_title) of a CSV, as load_resumes."""
    return _load(spark, path, JD_ALIASES, "jd_id", "job_title", "jd_", limit)


def load_text_files(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, text, source_path): one document per file; its key is the file's name without its last suffix."""
    df = spark.read.text(path, wholetext=True).withColumn("source_path", F.col("_metadata.file_path"))
    stem = F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    return df.select(F.url_decode(stem).alias(key), T.clean_text(F.col("value"), compose=True).alias("text"), "source_path")


def load_pdf_files(spark: SparkSession, path: str, key: str, pages) -> DataFrame:
    """(key, text) of PDF files; ``pages(bytes)`` gives the texts of a file's pages (no PDF library is bundled)."""

    def run(frames):
        for f in frames:
            f["text"] = ["\n".join(pages(bytes(x))) for x in f["content"]]
            yield f[["path", "text"]]

    df = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    return df.select(stem.alias(key), T.clean_text(F.col("text"), compose=True).alias("text"))
