"""Pools, ranks, pair building, matrices and requirement rows against brute force, on small tables with awkward rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import curation, documents, evaluation, evidence, matching, matrices, ranks, requirement_rows


def test_order_statistics(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKETS", 4)
    r = random.Random(3)
    x = [r.choice([0.0, 0.0, 1.5, r.random() * 1e6, -r.random()]) for _ in range(501)] + [None, float("nan")]
    df = spark.createDataFrame([(v, 7.0, None) for v in x], "x double, same double, none double")
    got = {q.name: q for q in ranks.order_statistics(df, ["x", "same", "none"], [0.0, 0.1, 0.5, 0.75, 1.0]).collect()}
    real = [v for v in x if v is not None and v == v]
    assert [got["x"][f"q{i}"] for i in range(5)] == pytest.approx(list(np.quantile(real, [0, 0.1, 0.5, 0.75, 1])))
    assert (got["x"].n, got["x"].low, got["x"].high) == (501, min(real), max(real))
    assert got["same"].q2 == 7.0 and got["none"].n == 0 and got["none"].q1 is None
    assert ranks.order_statistics(df.limit(0), ["x"], [0.5]).collect()[0].n == 0


def test_describe_computes_its_input_once(spark):
    """Moments and quantiles follow from one table of distinct values (F9)."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    values = [(i % 5, float(i % 7) if i % 3 else None, 1e9 + i % 2) for i in range(300)] + [(None, float("nan"), 1e9)]
    df = spark.createDataFrame(values, "a long, b double, c double")
    out = {r.name: r for r in evaluation.describe(df.mapInArrow(counted, df.schema), "a", "b", "c").collect()}
    assert read.value == 301
    for k, name in enumerate("abc"):
        real = np.array([v[k] for v in values if v[k] is not None and v[k] == v[k]], float)
        got = out[name]
        assert (got.n, got.min, got["max"]) == (len(real), real.min(), real.max())
        assert (got["mean"], got["std"], got.p25, got.p50, got.p75) == pytest.approx((real.mean(), real.std(ddof=1), *np.quantile(real, [0.25, 0.5, 0.75])), rel=1e-9)


def test_describe_of_several_columns(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (4, 8.0)], "a long, b double")
    out = {r.name: r for r in evaluation.describe(df, "a", "b").collect()}
    assert (out["a"].n, out["a"].p50, out["a"].p25, out["a"]["max"]) == (3, 2.0, 1.5, 4.0)
    assert (out["b"].n, out["b"]["mean"], out["b"].p75) == (2, 5.0, 6.5)


def test_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKETS", 3)
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), k, r.choice([None, 0.0, 1.0, r.random()])) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    got = {(x.g, x.k): x["rank"] for x in ranks.ranked(df, ["g"], "v", "k").collect()}
    for g in ("a", "b", None):
        some = sorted((v, k) for x, k, v in rows if x == g and v is not None)
        assert [got[g, k] for _, k in some] == list(range(1, len(some) + 1))
        assert all(got[x, k] is None for x, k, v in rows if x == g and v is None)


def brute_pairs(rows, seed, n):
    """rows: (jd, cv, score, likely, medium)"""
    out = set()
    for jd in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == jd]
        used: set = set()
        best = lambda pool: sorted((r for r in pool if r[1] not in used), key=lambda r: (-r[2], r[1]))

        def take(kind, chosen):
            for i, r in enumerate(chosen):
                out.add((jd, r[1], r[2], kind, i + 1))
                used.add(r[1])  # noqa: B023

        take("likely_good", best([r for r in own if r[3]])[:n])
        middle = best([r for r in own if r[4]])
        start = min(len(middle) - 1, max(n, len(middle) // 3)) if middle else 0
        take("medium", middle[start : start + n])
        take("hard_negative", best([r for r in own if not r[3]])[:n])
        rest = [r for r in own if not r[3] and r[1] not in used]
        take("random_negative", sorted(rest, key=lambda r: (hashlib.md5(f"{seed}|{jd}|{r[1]}".encode()).hexdigest(), r[1]))[:n])
    return out


@pytest.mark.parametrize("kind", ["spread", "ties", "few"])
def test_build_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(ranks, "BUCKETS", 5)
    r = random.Random(kind)
    size = {"spread": 200, "ties": 120, "few": 9}[kind]
    score = {"spread": lambda: r.random(), "ties": lambda: r.choice([0.0, 0.0, 0.5]), "few": lambda: r.choice([0.1, 0.2])}[kind]
    rows = [(j, c, score(), r.random() < 0.3, r.random() < (0.5 if j % 3 else 0.02)) for j in range(8) for c in range(size) if r.random() < 0.9]
    got = matching.build_pairs(spark.createDataFrame(rows, "jd long, cv long, score double, likely boolean, medium boolean").withColumn("s", F.lit(1)), "jd", "cv", 7, 5).collect()
    assert {(x.jd, x.cv, x.score, x.pair_type, x.selection_rank) for x in got} == brute_pairs(rows, 7, 5)
    assert len(got) == len({(x.jd, x.cv) for x in got})


def test_candidate_pools(spark, monkeypatch):
    monkeypatch.setattr(curation, "POOL_ROWS", 3)
    cv = [(i, g) for i, g in enumerate(["a"] * 20 + ["b"] * 4 + [None] * 3 + ["c"])]
    jd = [(1, ["a", "x"], ["b"]), (2, ["x"], ["y"]), (3, ["b", "b"], ["x"]), (4, None, ["c"]), (5, [], None)]
    got: dict = {}
    df = curation.candidate_pools(spark.createDataFrame(jd, "jd long, l array<string>, m array<string>"), spark.createDataFrame([*cv, cv[0]], "cv long, g string"), "jd", "cv", "l", "m", "g")
    for r in df.collect():
        assert (r.jd, r.cv) not in got
        got[r.jd, r.cv] = (r.likely, r.medium)
    there = {"a", "b", "c"}
    expected = {}
    for j, likely, medium in jd:
        likely, medium = set(likely or ()) & there, set(medium or ()) & there
        for c, g in cv:
            in_likely = g in likely if likely else True
            in_medium = g in medium if medium else in_likely
            if in_likely or in_medium:
                expected[j, c] = (in_likely, in_medium)
    assert got == expected
    assert curation.candidate_pools(spark.createDataFrame(jd, "jd long, l array<string>, m array<string>"), spark.createDataFrame([], "cv long, g string"), "jd", "cv", "l", "m", "g").count() == 0


@pytest.mark.parametrize("block", [3, 1024])
def test_matrices_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(matrices, "BLOCK", block)
    texts = [(1, "abc"), (2, "ABC abc"), (3, ""), (4, None), (5, "zzz é"), (6, "bca"), (7, "x")]
    df = spark.createDataFrame(texts, "k long, text string")
    left = matrices.embed(df, ["k"], "text", matrices.letters)
    right = matrices.embed(df.withColumnRenamed("k", "j"), ["j"], "text", matrices.letters, batch=2)
    v = {r.k: np.array(r.vector) for r in left.collect()}
    got = {(r.k, r.j): r.score for r in matrices.embedding_matrix(left, right, "k", "j").collect()}
    assert got == {(a, b): pytest.approx(100 * float(v[a] @ v[b]), abs=1e-4) for a in v for b in v}
    top = {}
    for r in matrices.embedding_matrix(left, right, "k", "j", top=2).collect():
        top.setdefault(r.k, []).append((r["rank"], r.j))
    assert {k: [j for _, j in sorted(x)] for k, x in top.items()} == {a: [b for _, b in sorted((-round(100 * float(v[a] @ v[b]), 4), b) for b in v)[:2]] for a in v}
    assert matrices.embedding_matrix(left.limit(0), right, "k", "j").count() == 0


def test_encoder_sees_prefix_and_cut_text(spark):
    seen = []

    def lengths(texts):
        return np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "abcdef"), (2, None)], "k long, text string")
    out = {r.k: r.vector for r in matrices.embed(df, ["k"], "text", lengths, model="e5", requirement=True, most=3).collect()}
    for k, n in ((1, len("query: abc")), (2, len("query: "))):
        assert out[k] == pytest.approx([n / np.hypot(n, 1), 1 / np.hypot(n, 1)])
    assert not seen


def test_section_matrix_without_vectors(spark):
    kinds = "k long, must_have array<double>, experience array<double>, responsibility array<double>, nice_to_have array<double>, domain array<double>"
    a = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0], None, [0.0, 1.0], [1.0, 0.0]), (2, None, None, None, None, None)], kinds)
    b = spark.createDataFrame([(9, [1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [0.0, -1.0], [1.0, 0.0])], kinds.replace("k long", "j long"))
    got = {r.k: r.score for r in matrices.section_matrix(a, b, "k", "j").collect()}
    assert got == {1: pytest.approx(45 + 20 / 2 + 0 + 0 + 10), 2: 0.0}


CV = "Ana\nSkills\nPython, SQL; javascript. C++ 3+ years\nExperience\nBuilt data pipelines in python.\nLed a team for 7 years.\nEducation\nKTU"
JD = "Requirements\nMust know python and sql\nAt least 5 years of experience\n10+ years of Java required\nand or the\nNice to have\nSpark and Kafka pipelines skills"


@pytest.mark.parametrize("size", [150, 8 << 20])
def test_requirement_rows_equal_the_matching_of_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(requirement_rows, "AUTOMATON_BYTES", size)
    monkeypatch.setattr(requirement_rows, "_KNOWN", 1)
    cvs = documents.cv_documents(spark.createDataFrame([(1, CV), (2, ""), (3, None), (4, "sql " * 3000 + "\npython and sql. spark"), (5, "ﬁve 5 years\npython sql")], "cv long, text string"), "cv", "text")
    jds = documents.jd_documents(spark.createDataFrame([(1, JD), (2, ""), (3, "Python needed. 2 years")], "jd long, text string").withColumn("ord", F.lit(0)), "jd", "text")
    views = cvs.select("cv", "text", *(documents.section(v).alias(v) for v in ("relevant", "skills_experience"))).cache()
    req = documents.requirement_table(jds, "jd").cache()
    pairs = views.select("cv").crossJoin(jds.select("jd"))
    pairs = pairs.unionByName(pairs.limit(2)).withColumn("status", F.lit("x"))
    names = ["cv", "jd", "requirement_id", "status", "match_score", "evidence", "confidence"]
    got = requirement_rows.requirement_rows(pairs, views, req, "cv", "jd", "text")
    old = evidence.match_with_evidence(pairs.select("cv", "jd").distinct().join(views, "cv").join(req, "jd"), "requirement", "text")
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, old.select(names).collect()))
    assert {r.status for r in got.collect()} == {"yes", "partial", "no", "unknown"}
    out = {(r.cv, r.jd): r for r in requirement_rows.requirement_match(pairs, got, "cv", "jd").collect()}
    assert len(out) == 15 and out[1, 2].requirement_score == 0 and out[1, 2].explanation.endswith(" 0 extracted requirements.")
    assert requirement_rows.requirement_rows(pairs.limit(0), views, req, "cv", "jd", "text").count() == 0
    assert requirement_rows.requirement_rows(pairs, views, req.limit(0), "cv", "jd", "text").count() == 0


def test_documents_compose_and_section(spark):
    row = documents.cv_documents(spark.createDataFrame([(1, "Summary\nﬁne work\nSkills:\nsql", "x")], "k long, text string, more string"), "k", "text").collect()[0]
    assert row.text == "Summary\nfine work\nSkills:\nsql" and row.more == "x"
    assert row.sections["summary"].startswith("fine work") and row.sections["relevant"].startswith("fine work")
    both = documents.jd_documents(spark.createDataFrame([(1, JD), (1, JD), (2, None)], "k long, text string"), "k", "text").collect()
    assert Counter((r.k, len(r.requirements)) for r in both) == {(1, 5): 2, (2, 0): 1}
    assert [r.requirement_type for r in both[0].requirements][-1] == "nice_to_have" or not both[0].requirements


def test_blocks_are_not_copied(spark):
    """Blocks of both sides meet without being sent once for each block of the other side (F3, F10)."""
    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(7)] + [(7, None)], "a long, embedding array<double>")
    out = matrices.embedding_scores(df, df.withColumnRenamed("a", "b"))
    physical = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "MapInArrow" in physical and "hashpartitioning" not in physical
    got = {(r.a, r.b): r.score for r in out.collect()}
    assert len(got) == 64 and got[0, 1] == 1.0 and got[3, 6] == 1.0
