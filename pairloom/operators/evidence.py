"""Views of sectioned documents, and requirements matched with evidence and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from .extraction import YEARS, important_tokens, sections, years


def _view(names: list[str]) -> Column:
    """The contents of these sections in their order, joined by newlines; empty without any."""
    rows = F.array_sort(F.filter("parts", lambda x: x["section"].isin(names)))
    return F.regexp_replace(F.array_join(F.transform(rows, lambda x: x["content"]), "\n"), "^\\s+|\\s+$", "")


def _parts(df: DataFrame, key: str, text: str, headings: dict) -> DataFrame:
    parts = sections(df.select(key, text), key, text, headings).groupBy(key).agg(F.collect_list(F.struct("ord", "section", "content")).alias("parts"))
    return df.select(key, text).join(parts, key, "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<struct<ord:int,section:string,content:string>>")))


def cv_views(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, relevant, skills_experience, experience_projects) of candidate documents.

    A document without relevant sections has its cleaned text there, and the other views fall back to that.
    """
    own = _parts(df, key, text, C.CV_HEADINGS).select(key, text, *(F.nullif(_view(names), F.lit("")).alias(v) for v, names in C.CV_VIEWS.items()))
    own = own.withColumn("relevant", F.coalesce("relevant", T.clean_text(F.col(text))))
    return own.select(key, text, "relevant", *(F.coalesce(v, "relevant").alias(v) for v in ("skills_experience", "experience_projects")))


def scoring_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, scoring_text) of requirement texts: all sections but the offer, or the cleaned text."""
    own = _parts(df, key, text, C.JD_HEADINGS)
    return own.select(key, F.coalesce(F.nullif(_view(C.JD_VIEW), F.lit("")), T.clean_text(F.col(text))).alias("scoring_text"))


def evidence_sentence(text: Column, tokens: Column) -> Column:
    """The first sentence that holds most of the distinct tokens, at most 500 characters; empty if none holds any."""
    own = F.array_distinct(tokens)

    def step(best, sentence):
        norm = T.normalize_for_matching(sentence)
        n = F.size(F.filter(own, lambda t: F.contains(norm, t)))
        return F.when(n > best["n"], F.struct(n.alias("n"), sentence.alias("s"))).otherwise(best)

    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("s"))
    return F.substring(F.aggregate(T.sentence_split(text), start, step, lambda best: best["s"]), 1, 500)


def match_with_evidence(pairs: DataFrame, requirement: str, text: str, skills_experience: str = "skills_experience", relevant: str = "relevant") -> DataFrame:
    """Adds status, match_score, evidence and confidence to rows of a requirement and a candidate document's views.

    A requirement with years compares them with the highest number of years in the document; another counts its
    tokens that the document contains.  One without tokens is unknown with confidence 0.
    """
    pool = T.normalize_for_matching(F.concat_ws("\n", F.coalesce(skills_experience, F.lit("")), F.coalesce(relevant, F.lit("")), F.coalesce(text, F.lit(""))))
    norm = T.normalize_for_matching(F.col(requirement))
    best = F.coalesce(F.array_max(F.transform(F.regexp_extract_all("pool", F.lit(YEARS), F.lit(1)), lambda x: x.try_cast("long"))), F.lit(0))
    out = pairs.withColumn("pool", pool).withColumn("tokens", important_tokens(F.col(requirement))).withColumn("needed", years(norm)).withColumn("best", best)
    out = out.withColumn("found", F.filter("tokens", lambda t: F.contains(F.col("pool"), t))).withColumn("total", F.size("tokens")).withColumn("matched", F.size("found"))
    by_years = F.when(F.col("best") >= F.col("needed"), "yes").when(F.col("best") >= F.greatest(F.lit(1), F.col("needed") - 1), "partial").otherwise("no")
    by_tokens = F.when(F.col("total") == 0, "unknown").when(4 * F.col("matched") >= 3 * F.col("total"), "yes").when(20 * F.col("matched") >= 7 * F.col("total"), "partial").otherwise("no")
    out = out.withColumn("status", F.when(F.col("needed").isNotNull(), by_years).otherwise(by_tokens))
    share = F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(0.0)
    status = F.col("status")
    sure = F.when(F.col("needed").isNotNull(), F.when(status == "yes", 0.9).when(status == "partial", 0.7).otherwise(0.8)).when(status == "unknown", 0.0).when(status == "no", 1 - share).otherwise(share)
    words = F.when(F.col("needed").isNotNull(), F.array(F.col("best").cast("string"))).otherwise(F.col("found"))
    shown = F.when(status.isin("yes", "partial"), evidence_sentence(F.col(text), words)).otherwise("")
    out = out.withColumn("match_score", F.when(status == "yes", 1.0).when(status == "partial", 0.5).otherwise(0.0)).withColumn("evidence", shown).withColumn("confidence", F.round(sure, 6))
    return out.drop("pool", "tokens", "needed", "best", "found", "total", "matched")


def explanation(matches: DataFrame, *keys: str) -> DataFrame:
    """(keys, yes, partial, total): how many requirements are met, for the explanation of a score."""
    return matches.groupBy(*keys).agg(F.count_if(F.col("status") == "yes").alias("yes"), F.count_if(F.col("status") == "partial").alias("partial"), F.count("*").alias("total"))
