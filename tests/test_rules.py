"""Rules on literal rows: replies, Unicode, null groups, ties, evidence and calibrators."""

import pytest
from pyspark.sql import functions as F

from pairloom.functions import scores as S
from pairloom.functions import text as T
from pairloom.operators import calibration, curation, evidence, judge, labelling, methods
from pairloom.sources import config


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", make(F.col("v")).alias("o")).collect()
    return [r.o for r in sorted(rows, key=lambda r: r.i)]


def test_json_objects(spark):
    good = {'{"a":1}': '{"a":1}', ' {"a":{"b":[1]}} ': ' {"a":{"b":[1]}} ', 'so: {"a":1} done': '{"a":1}', '{"a":1} and more': '{"a":1}'}
    bad = ['{"a": 1, "b": "cut of', '{oops} {"a": 1}', "{broken", "none", "", None, '{"a":1} {"b":2}', '{"a":1},{"b":2}', '{"a":1}] x}', '{"a":1}} x', "[1]", "5"]
    assert column(spark, [*good, *bad], S.json_object) == [*good.values(), *[None] * len(bad)]


def test_judge_replies(spark):
    replies = [('{"final_score": 80, "explanation": "cut of', None), ('{oops} {"final_score": 80}', None), ('{"final_score": 80}', None), (None, "timeout")]
    out = judge.parsed(spark.createDataFrame([(i, *r) for i, r in enumerate(replies)], "i int, reply string, error string")).orderBy("i").collect()
    assert [r.final_score for r in out] == [None, None, 0.8, None]
    assert [bool(r.error) for r in out] == [True, True, False, True] and out[3].error == "timeout"


def test_compatibility_characters(spark):
    words = ["ﬁle ½ Ｃ＋＋", "ｎｏｄｅ．ｊｓ", "école", "㎏ ①", None]
    assert column(spark, words, lambda c: T.clean_text(c, compose=True)) == ["file 1⁄2 C++", "node.js", "école", "kg 1", ""]


def test_labels(spark):
    assert column(spark, [0.0, 20.0, 20.5, 60.0, 80.0, 80.01, None, float("nan")], S.category_text, "double") == ["poor fit", "poor fit", "weak fit", "possible fit", "good fit", "strong fit", "", ""]
    assert column(spark, [None, 41.0], S.label_name, "double") == [None, "possible fit"]


def test_rows_without_a_group_stay(spark):
    df = spark.createDataFrame([(i, g, i % 7) for i, g in enumerate(["a"] * 6 + [None] * 5 + ["b"] * 2)], "id int, g string, q int")
    out = curation.select_diverse(df, 13, "g", "q", "id").collect()
    assert len(out) == 13 and sum(r.g is None for r in out) == 5
    assert {r.g for r in curation.select_diverse(df, 3, "g", "q", "id").collect()} == {"a", "b", None}


def test_deduplication_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, "A  b!", "x"), (1, "a b", "w"), (None, "c", "y"), (None, "C.", "z"), (3, "C", "v"), (4, " ! ", "u"), (5, None, "t")], "id int, text string, first string")
    assert {(r.id, r.text) for r in curation.deduplicate(df, "text", "id").collect()} == {(1, "A  b!"), (3, "C"), (None, "C.")}


def test_evidence(spark):
    cv = "Wrote c++ and node.js services. Spark in 6 years of practice!\nLikes tea"
    rows = [("c++ node.js", "yes", "Wrote c++ and node.js services.", 1.0), ("spark java", "partial", "Spark in 6 years of practice!", 0.5), ("cobol", "no", "", 1.0), ("and the", "unknown", "", 0.0), ("5+ years", "yes", "Spark in 6 years of practice!", 0.9), ("7 years", "partial", "Spark in 6 years of practice!", 0.7), ("9 metų", "no", "", 0.8)]
    df = spark.createDataFrame([(i, r[0], cv, None, None) for i, r in enumerate(rows)], "i int, req string, cv string, skills_experience string, relevant string")
    out = evidence.match_with_evidence(df, "req", "cv").orderBy("i").collect()
    assert [(r.req, r.status, r.evidence, r.confidence) for r in out] == rows
    counts = evidence.explanation(evidence.match_with_evidence(df, "req", "cv").withColumn("k", F.lit(1)), "k").first()
    assert (counts.yes, counts.partial, counts.total) == (2, 2, 7)


def test_views_of_documents_without_sections(spark):
    df = spark.createDataFrame([(1, "only  text"), (2, "Education\nschool"), (3, "Skills:\nsql\nProjects\nmill\nExperience\nten"), (4, None)], "id int, t string")
    out = {r.id: (r.relevant, r.skills_experience, r.experience_projects) for r in evidence.cv_views(df, "id", "t").collect()}
    assert out == {1: ("only text",) * 3, 2: ("Education\nschool",) * 3, 3: ("sql\nmill\nten", "sql\nmill\nten", "mill\nten"), 4: ("", "", "")}


def test_calibrators(spark):
    fitted = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.2, 0.9, None)], "s double")
    asked = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.2, 0.5, 0.9, 2.0, None)], "s double")
    out = {r.s: r.calibrated for r in calibration.QuantileCalibrator().fit(fitted, "s").predict(asked, "s").collect()}
    assert out == {0.0: 0.0, 0.1: 0.25, 0.2: 0.75, 0.5: 0.75, 0.9: 1.0, 2.0: 1.0, None: None}
    assert {r.calibrated for r in calibration.IdentityCalibrator().fit(fitted, "s").predict(asked, "s").collect()} == {0.0, 0.1, 0.2, 0.5, 0.9, 1.0, None}
    with pytest.raises(ValueError):
        calibration.QuantileCalibrator().predict(asked, "s")
    with pytest.raises(ValueError):
        calibration.QuantileCalibrator().fit(fitted.limit(0), "s")


def test_choice_of_pairs(spark):
    pairs = spark.createDataFrame([(j, c, "ab"[c % 2], float(c)) for j in range(4) for c in range(5)], "jd_id int, cv_id int, pair_type string, final_score double")
    pick = lambda mode, **k: labelling.choose_pairs(pairs, 6, mode, ("jd_id", "cv_id"), **k).collect()
    assert [r.final_score for r in pick("highest")] == [4.0] * 4 + [3.0] * 2 and {r.pair_type for r in pick("random", pair_type="a")} == {"a"}
    assert [r.pair_type for r in pick("mixed")] == ["a"] * 3 + ["b"] * 3
    assert {r.jd_id for r in pick("first", jds=spark.createDataFrame([(2,)], "jd_id int"))} == {2}
    assert labelling.errors(spark.createDataFrame([("x",), (" ",), (None,)], "method_errors string")).first()[0] == 1
    with pytest.raises(ValueError):
        pick("other")


def test_weights_and_folders(tmp_path):
    (tmp_path / "w.yaml").write_text("# weights\nweights:\n  must_have: 3\n  domain: 1.0  # rest\n")
    assert config.load_weights(str(tmp_path / "w.yaml")) == {"must_have": 0.75, "domain": 0.25}
    (tmp_path / "w.yaml").write_text("a: 1\n- b\n")
    with pytest.raises(ValueError):
        config.load_weights(str(tmp_path / "w.yaml"))
    assert config.Paths("s3://b/").results == "s3://b/datasets/results"


def test_registry_and_prefixes(spark):
    assert list(methods.registry({"llm": None, "sbert": None, "tfidf": None})) == ["tfidf", "sbert"]
    assert "llm" in methods.registry({"llm": None}, with_judge=True)
    with pytest.raises(ValueError):
        methods.registry({"other": None})
    assert column(spark, ["x", None], lambda c: methods.prefixed(c, "e5", True)) == ["query: x", "query: "]


def test_rules_read_a_text_once(spark):
    """A rule's text is normalised once and not once for each keyword (F1, F2, F3)."""
    df = spark.createDataFrame([("Data engineer, SQL",), ("nothing",), (None,)], "t string")
    made = df.select(curation.resume_group(F.col("t")).alias("r"), curation.job_group(F.col("t")).alias("j"))
    tree = made._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("lower(") == 2
    assert made.collect()[1] == made.collect()[2] == ("Other Technology", "Other")
