"""Candidate pairs for labelling, a model's labels, and the choice of pairs to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores as S
from .curation import seeded
from .judge import ask

MAX_CHARS = 5500
#: The empty columns of a labelling table and their types.
LABEL_COLUMNS = {
    "llm_fit_score": "double", "llm_fit_category": "string", "llm_missing_requirements": "string", "llm_explanation": "string", "human_reviewed": "boolean",
    "human_score": "double", "human_category": "string", "human_notes": "string", "final_label_score": "double", "final_label_category": "string",
}


def prompt(cv: Column, jd: Column, most: int = MAX_CHARS) -> Column:
    """Asks for a label as JSON; each text is cut to ``most`` characters."""
    ask = "Judge how well the résumé fits the job. Reply with one JSON object: score (0 to 100), fit_category, missing_requirements (a list) and short_explanation (one sentence)."
    cut = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, most)
    return F.concat(F.lit(ask + "\n\nJob:\n"), cut(jd), F.lit("\n\nRésumé:\n"), cut(cv))


def parsed(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds llm_fit_score, llm_fit_category, llm_missing_requirements, llm_explanation and error.

    A reply without braces is a poor fit of score 0 that explains itself; one with braces but no whole JSON
    object has nulls and an error.  The model's own category goes before the band of its score.
    """
    text = F.coalesce(reply, F.lit(""))
    fields = F.try_variant_get(F.try_parse_json(S.json_object(text)), "$", "map<string,variant>")
    bare = ~text.rlike(r"(?s)\{.*\}")
    get = lambda name: F.try_element_at(F.col("_f"), F.lit(name))
    has = lambda name: F.map_contains_key(F.col("_f"), name)
    out = replies.withColumn("_f", fields).withColumn("_bare", bare)
    score = S.clamp_score(F.try_variant_get(F.when(has("score"), get("score")).otherwise(get("fit_score")), "$", "string"))
    own = F.nullif(F.try_variant_get(get("fit_category"), "$", "string"), F.lit(""))
    said = F.when(has("short_explanation"), get("short_explanation")).otherwise(get("explanation"))
    some = F.col("_f").isNotNull()
    out = out.withColumn("llm_fit_score", F.when(some, score).when(F.col("_bare"), 0.0))
    out = out.withColumn("llm_fit_category", F.when(some, F.coalesce(own, S.gap_band(F.col("llm_fit_score")))).when(F.col("_bare"), "poor fit"))
    out = out.withColumn("llm_missing_requirements", F.when(some, F.coalesce(S.list_text(get("missing_requirements")), F.lit(""))).when(F.col("_bare"), ""))
    out = out.withColumn("llm_explanation", F.when(some, F.substring(F.coalesce(S.list_text(said), F.lit("")), 1, 1000)).when(F.col("_bare"), F.substring(text, 1, 500)))
    return out.withColumn("error", F.when(~some & ~F.col("_bare"), F.concat(F.lit("no JSON in the reply: "), F.substring(text, 1, 500)))).drop("_f", "_bare")


def label(pairs: DataFrame, cvs: DataFrame, jds: DataFrame, cv_key: str, jd_key: str, cv_text: str, jd_text: str, client, **how) -> DataFrame:
    """``pairs`` with the model's labels in their llm_ columns and ``error``; ``how`` goes to :func:`.judge.ask`.

    Pairs that share both texts are asked once; a pair without one of its documents is asked with an empty text.
    """
    keys = [cv_key, jd_key]
    texts = pairs.select(keys).distinct().join(cvs.select(cv_key, F.col(cv_text).alias("_cv")), cv_key, "left").join(jds.select(jd_key, F.col(jd_text).alias("_jd")), jd_key, "left")
    asked = ask(texts.select(*keys, prompt(F.col("_cv"), F.col("_jd")).alias("_prompt")), keys, "_prompt", client, **how)
    told = parsed(asked.withColumnRenamed("error", "_failed"))
    # a call that failed has no label: its reply is null, which is not a reply that explains itself
    failed = F.col("_failed").isNotNull()
    names = ["llm_fit_score", "llm_fit_category", "llm_missing_requirements", "llm_explanation"]
    told = told.select(*keys, *(F.when(~failed, F.col(c)).alias(c) for c in names), F.coalesce("_failed", "error").alias("error"))
    return pairs.drop(*names, "error").join(told, keys, "left")


def surrogate_ids(df: DataFrame, name: str, prefix: str, *order: str) -> DataFrame:
    """Adds ``prefix_00001``, ... in this order; for tables of the size a person looks at."""
    return df.withColumn(name, F.format_string(f"{prefix}_%05d", F.row_number().over(W.orderBy(*order))))


def candidate_pairs(pairs: DataFrame, jds: DataFrame, jd_key: str = "jd_id", n_jds: int = 50, per_jd: int = 20) -> DataFrame:
    """The pairs of the first ``n_jds`` of the chosen requirement texts, at most ``per_jd`` each, with empty label columns.

    Pairs stand by pair_type and selection_rank, and carry ids cand_00001, ... in the order of text, type and rank.
    """
    own = pairs.join(jds.select(jd_key).distinct().orderBy(jd_key).limit(n_jds), jd_key, "left_semi")
    rank = F.row_number().over(W.partitionBy(jd_key).orderBy("pair_type", "selection_rank"))
    kept = own.withColumn("_rn", rank).filter(F.col("_rn") <= per_jd).drop("_rn")
    named = surrogate_ids(kept, "candidate_pair_id", "cand", jd_key, "pair_type", "selection_rank").withColumnRenamed("pair_type", "candidate_bucket")
    return named.select("*", *(F.lit(None).cast(t).alias(c) for c, t in LABEL_COLUMNS.items()))


def choose_pairs(pairs: DataFrame, n: int, mode: str, keys: tuple[str, str], pair_type: str | None = None, jds: DataFrame | None = None, seed: int = 42, score: str = "final_score") -> DataFrame:
    """n pairs of a type and of given requirement texts: ``random``, ``highest``, ``mixed`` over types, or ``first``."""
    if pair_type is not None:
        pairs = pairs.filter(F.col("pair_type") == pair_type)
    if jds is not None:
        pairs = pairs.join(jds.select(keys[0]).distinct(), keys[0], "left_semi")
    shuffled = [seeded(seed, *keys), *keys]
    if mode == "random":
        return pairs.orderBy(*shuffled).limit(n)
    if mode == "highest":
        return pairs.orderBy(F.col(score).desc_nulls_last(), *keys).limit(n)
    if mode == "first":
        return pairs.orderBy(*keys).limit(n)
    if mode != "mixed":
        raise ValueError(f"unknown mode {mode}")
    types = pairs.agg(F.greatest(F.lit(1), F.floor(F.least(F.lit(n), F.count("*")) / F.greatest(F.lit(1), F.count_distinct("pair_type")))).alias("_each"))
    ranked = pairs.withColumn("_rn", F.row_number().over(W.partitionBy("pair_type").orderBy(*shuffled))).crossJoin(F.broadcast(types)).withColumn("_own", F.col("_rn") <= F.col("_each"))
    return ranked.orderBy(F.desc("_own"), F.when(F.col("_own"), F.col("pair_type")), F.when(F.col("_own"), F.col("_rn")), *shuffled).limit(n).drop("_rn", "_each", "_own")


def errors(df: DataFrame, column: str = "method_errors") -> DataFrame:
    """(rows_with_error): rows whose error text is not blank."""
    return df.agg(F.count_if(F.trim(F.coalesce(column, F.lit(""))) != "").alias("rows_with_error"))
