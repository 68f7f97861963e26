"""Curation: quality scores, grouping, deduplication and diverse selection."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T


def quality_score(text: Column, target: int, most: int, markers: list[str]) -> Column:
    """0.45 length, 0.25 markers, 0.20 variety, 0.10 structure; 0 without words."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z0-9+#.]+"), F.lit(0))
    n = F.size(words)
    low = F.lower(text)
    unique = F.size(F.array_distinct(F.transform(words, F.lower))) / n
    found = sum((F.contains(low, F.lit(m)).cast("int") for m in markers), F.lit(0))
    marks = F.char_length(F.regexp_replace(text, "[^\\n•]", "")) + F.size(F.split(text, "- ")) - 1
    length = F.when(n <= target, n / target).otherwise(F.greatest(F.lit(0.0), 1 - (n - target) / F.lit(most)))
    score = 0.45 * length + 0.25 * F.least(F.lit(1.0), found / 5) + 0.20 * F.least(F.lit(1.0), 2 * unique) + 0.10 * F.least(F.lit(1.0), marks / 12)
    return F.when(n == 0, 0.0).otherwise(F.round(score, 6))


def deduplicate(df: DataFrame, text: str, order: str) -> DataFrame:
    """The first row of each non-empty normalised text: of equal orders the smallest row, nulls last.

    Texts are normalised and hashed once, and one aggregate finds the first rows; nothing is joined.
    """
    hashed = F.sha2(T.normalize_key(F.col(text)).cast("binary"), 256)
    empty = hashlib.sha256(b"").hexdigest()
    row = F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("order"), F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns))).alias("row"))
    first = df.select(hashed.alias("key"), row.alias("r")).filter(F.col("key") != empty).groupBy("key").agg(F.min("r").alias("r"))
    return first.select(*(F.col(f"r.row.c{i}").alias(c) for i, c in enumerate(df.columns)))


def _quotas(sizes: DataFrame, n: int, cap: Column, order: list[Column]) -> DataFrame:
    """Adds ``_quota``: how many rows each group gives if groups take turns until n rows are taken or all have given ``cap``.

    Full rounds are found by filling the groups to a common level; what is left of n goes to the first groups, in
    this order, that have more.  It works on the small table of groups (``_size`` rows each).
    """
    most = sizes.withColumn("_most", F.least(F.col("_size"), cap.cast("long")))
    up = W.orderBy("_most", *order).rowsBetween(W.unboundedPreceding, -1)
    level = most.select("_most", F.coalesce(F.sum("_most").over(up), F.lit(0)).alias("_under"), F.coalesce(F.count("*").over(up), F.lit(0)).alias("_passed"), F.count("*").over(W.partitionBy()).alias("_all"))
    level = level.withColumn("_left", F.col("_all") - F.col("_passed")).filter(F.col("_under") + F.col("_most") * F.col("_left") >= n)
    full = level.agg(F.min(F.struct("_passed", F.floor((F.lit(n) - F.col("_under")) / F.col("_left")).alias("level")))["level"].alias("_level"))
    filled = most.crossJoin(F.broadcast(full)).withColumn("_quota", F.least(F.col("_most"), F.coalesce("_level", "_most")))
    more = F.col("_most") > F.col("_quota")
    turn = F.sum(more.cast("int")).over(W.orderBy(*order))
    left = F.lit(n) - F.sum("_quota").over(W.partitionBy())
    return filled.withColumn("_quota", F.col("_quota") + F.when(more & (turn <= left), 1).otherwise(0)).drop("_most", "_level")


def _in_turn(df: DataFrame, n: int, group: str, order: list[Column], group_order: list[Column], cap: Column) -> DataFrame:
    """The rows within their group's quota, with ``_turn``, ``_size`` and ``_groups``; group_order is over ``_group`` and ``_size``.

    Each task keeps the first n rows of its part of a group, so that a large group is not sorted in one task.
    """
    sizes = df.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_size")).withColumn("_groups", F.count("*").over(W.partitionBy()))
    quotas = _quotas(sizes, n, cap, group_order)
    parts = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith("map"))), F.lit(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    some = df.withColumn("_part", parts).withColumn("_turn", F.row_number().over(W.partitionBy(group, "_part").orderBy(*order))).filter(F.col("_turn") <= n).drop("_part")
    some = some.withColumn("_turn", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return some.join(quotas, F.col(group).eqNullSafe(F.col("_group"))).drop("_group").filter(F.col("_turn") <= F.col("_quota"))


def select_diverse(df: DataFrame, n: int, group: str, quality: str, key: str) -> DataFrame:
    """n rows by rounds over groups (larger groups first), best quality first, at most a cap each; filled up by quality.

    Adds ``selection_note``: how rows were chosen, or that there were no more than n.  Rows without a group are a
    group of their own, the last of its size.
    """
    names = [c for c in df.columns if c != "selection_note"]
    df = df.select(*(F.col(f"`{c}`") for c in names))
    cap = F.greatest(F.lit(1), F.ceil(F.lit(n) / F.col("_groups")) * 2)
    best = [F.desc(quality), F.asc(key)]
    chosen = _in_turn(df, n, group, best, [F.desc(F.least("_size", F.lit(n))), F.col("_group").asc_nulls_last()], cap)
    taken = chosen.agg(F.count("*").alias("_taken"))
    # caps may leave places: of the best n rows of all, some are not chosen yet (n are enough, as at most n are chosen)
    spare = df.orderBy(*best).limit(2 * n).join(chosen.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    spare = spare.withColumn("_place", F.row_number().over(W.orderBy(*best))).crossJoin(F.broadcast(taken)).filter(F.col("_place") <= n - F.col("_taken"))
    total = df.agg(F.count("*").alias("_total"))
    note = F.when(F.col("_total") <= n, "all_available_unique_rows_below_target").otherwise(f"quality_ranked_balanced_by_{group}")
    both = chosen.select(names).unionByName(spare.select(names)).crossJoin(F.broadcast(total))
    return both.withColumn("selection_note", note).select(*names, "selection_note")


def round_robin(df: DataFrame, n: int, group: str, order: list[Column]) -> DataFrame:
    """n rows by rounds over groups in alphabetical order, those without a group first."""
    return _in_turn(df, n, group, order, [F.col("_group").asc_nulls_first()], F.col("_size")).select(df.columns)


def sample_diverse(df: DataFrame, n: int, group: str, key: str, seed: int = 42) -> DataFrame:
    """n random rows by rounds over groups in random order: both orders follow from the seed, key and group."""
    by_group = [F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("_group").cast("string"), F.lit(""))).cast("binary")), F.col("_group").asc_nulls_first()]
    return _in_turn(df, n, group, [seeded(seed, key), F.asc(key)], by_group, F.col("_size")).select(df.columns)


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n random rows of the table, by the seeded order of their keys; all of them if there are fewer."""
    return df.orderBy(seeded(seed, key), key).limit(n)


def seeded(seed: int, *keys: str) -> Column:
    """A reproducible random order: the md5 of seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)).cast("binary"))


def job_group(text: Column) -> Column:
    return T.first_rule(T.normalize_key(text), C.JOB_GROUPS, "Other")


def resume_group(label: Column) -> Column:
    return T.first_rule(T.normalize_key(F.regexp_replace(label, "_", " ")), C.RESUME_GROUPS, "Other Technology")


def _names(names: list[str]) -> Column:
    return F.array(*(F.lit(n) for n in names))


def likely_groups(title: Column, group: Column) -> Column:
    """The résumé groups that suit a job, in order: by words of the title for technology, else by its group."""

    def by_title(low: Column) -> Column:
        tech = F.when(F.lit(False), _names(C.TECH_DEFAULT))
        for words, names in C.TECH_TITLES:
            tech = tech.when(T.contains_any(low, words), _names(names))
        return tech.otherwise(_names(C.TECH_DEFAULT))

    tech = T.once(F.lower(F.coalesce(title, F.lit(""))), by_title)
    other = F.when(F.lit(False), _names(C.POOL_DEFAULT))
    for name, names in C.GROUP_POOLS.items():
        other = other.when(group == name, _names(names))
    return F.when(group == "Technology", tech).otherwise(other.otherwise(_names(C.POOL_DEFAULT)))


def medium_groups(group: Column) -> Column:
    """The résumé groups of the medium pool."""
    return F.when(group == "Technology", _names(C.MEDIUM_TECH)).otherwise(_names(C.MEDIUM_OTHER))


def group_pool(jd: DataFrame, cv: DataFrame, groups: str, jd_key: str, cv_key: str, cv_group: str) -> DataFrame:
    """(jd, cv): candidates whose group is in the list of the requirement text; all of them if no group has any."""
    names = jd.select(jd_key, F.explode(F.array_distinct(groups)).alias("_g"))
    side = cv.select(cv_key, F.col(cv_group).alias("_g"))
    found = names.join(cv.select(F.col(cv_group).alias("_g")).distinct(), "_g", "left_semi")
    without = jd.select(jd_key).join(found.select(jd_key).distinct(), jd_key, "left_anti")
    return found.join(side, "_g").select(jd_key, cv_key).unionByName(without.crossJoin(cv.select(cv_key)))


#: Candidates of one group that one part of a pool join holds, and the requirement texts that they meet there.
POOL_ROWS, POOL_TEXTS = 100_000, 256
_NO_GROUP = "\u0000"


def pool_names(jd: DataFrame, cv: DataFrame, jd_key: str, likely: str, medium: str, cv_group: str) -> DataFrame:
    """(_jd, _l, _m): the groups of a requirement text's likely and medium pools, as in :func:`candidate_pools`."""
    there = cv.agg(F.collect_set(group_name(cv_group)).alias("_there"))  # the names of groups, not their rows
    own = lambda c: F.array_intersect(F.coalesce(F.col(c), F.array().cast("array<string>")), F.array_except("_there", F.array(F.lit(_NO_GROUP))))
    asked = jd.select(F.col(jd_key).alias("_jd"), likely, medium).dropDuplicates(["_jd"]).crossJoin(F.broadcast(there))
    asked = asked.withColumn("_l", F.when(F.size(own(likely)) > 0, own(likely)).otherwise(F.col("_there")))
    asked = asked.withColumn("_m", F.when(F.size(own(medium)) > 0, own(medium)).otherwise(F.col("_l")))
    return asked.select("_jd", "_l", "_m")


def group_name(cv_group: str) -> Column:
    """The group as :func:`pool_names` calls it."""
    return F.coalesce(F.col(cv_group), F.lit(_NO_GROUP))


def candidate_pools(jd: DataFrame, cv: DataFrame, jd_key: str, cv_key: str, likely: str, medium: str, cv_group: str) -> DataFrame:
    """(jd, cv, likely, medium): the candidates in a requirement text's likely pool, its medium pool, or both.

    ``likely`` and ``medium`` are columns of group names.  A pool holds the candidates of those of its groups that there are.
    Where there are none, the likely pool holds all candidates, and the medium pool is the likely one.  Candidates
    without a group are only among all of them.  Rows that share a key count once.

    Pools are joined by group.  A group of many candidates is dealt to parts of about POOL_ROWS by the candidates'
    hash, and the texts that ask for it meet each part, so that no task holds a group.  Texts are dealt to shares of about POOL_TEXTS
    by their hash, and a part goes to each share: small inputs make many pairs, which no single task should make.
    """
    side = cv.select(F.col(cv_key).alias("_cv"), group_name(cv_group).alias("_g")).distinct()
    sizes = side.groupBy("_g").agg(F.ceil(F.count("*") / POOL_ROWS).cast("int").alias("_parts"))
    asked = pool_names(jd, cv, jd_key, likely, medium, cv_group)
    names = asked.select("_jd", "_l", "_m", F.explode(F.array_union("_l", "_m")).alias("_g"))
    shares = max(1, -(-jd.count() // POOL_TEXTS))
    tasks = int(jd.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = names.join(sizes, "_g").select("_jd", "_g", F.array_contains("_l", F.col("_g")).alias("likely"), F.array_contains("_m", F.col("_g")).alias("medium"), F.pmod(F.xxhash64("_jd"), F.lit(shares)).alias("_share"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    dealt = side.join(sizes, "_g").select("_cv", "_g", F.pmod(F.xxhash64("_cv"), F.col("_parts")).cast("int").alias("_part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shares - 1).cast("bigint"))).alias("_share"))
    spread = ["_share", "_part", "_g"]
    met = blocks.repartition(tasks, *spread).join(dealt.repartition(tasks, *spread).hint("merge"), spread).groupBy("_jd", "_cv").agg(F.max("likely").alias("likely"), F.max("medium").alias("medium"))
    return met.select(F.col("_jd").alias(jd_key), F.col("_cv").alias(cv_key), "likely", "medium")
