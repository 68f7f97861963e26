"""Readers, writers and the judge on small files."""

import pytest
from pyspark.sql import functions as F

from pairloom.operators import judge, methods
from pairloom.sources import readers, writers


def test_csv_round_trip_and_aliases(spark, tmp_path):
    texts = ['a "quoted" word', "two\nlines, one comma", None, "last  one"]
    df = spark.createDataFrame(list(enumerate(texts)), "ID long, Resume_str string").coalesce(1)
    writers.write_csv(df, str(tmp_path / "a"))
    out = {r.cv_id: (r.text, r.category) for r in readers.load_resumes(spark, str(tmp_path / "a")).collect()}
    assert out["0"] == ('a "quoted" word', None) and out["1"][0] == "two\nlines, one comma" and out["3"][0] == "last one"
    with pytest.raises(ValueError):
        readers.load_jobs(spark, str(tmp_path / "a"))


def test_missing_ids_and_limit(spark, tmp_path):
    for part in ("a", "b", "c"):
        (tmp_path / f"{part}.csv").write_text("job_title,description\n" + "".join(f"{part}{i},text {part}{i}\n" for i in range(4)))
    out = readers.load_jobs(spark, str(tmp_path)).collect()
    assert sorted(r.jd_id for r in out) == sorted(f"jd_{i}" for i in range(12)) and {r.job_title for r in out} == {f"{p}{i}" for p in "abc" for i in range(4)}
    assert {r.jd_id for r in readers.load_jobs(spark, str(tmp_path), 5).collect()} == {f"jd_{i}" for i in range(5)}


def test_text_files(spark, tmp_path):
    (tmp_path / "my file.v2.txt").write_text("one\n\n\n\ntwo ")
    r = readers.load_text_files(spark, str(tmp_path), "cv_id").collect()
    assert [(x.cv_id, x.text) for x in r] == [("my file.v2", "one\n\ntwo")]


def test_pdf_pages_are_joined(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"p1|p2")
    assert [(r.cv_id, r.text) for r in readers.load_pdf_files(spark, str(tmp_path), "cv_id", lambda b: b.decode().split("|")).collect()] == [("x", "p1\np2")]


def test_judge(spark):
    df = spark.createDataFrame([(1, "cv", "jd"), (2, "bad", "jd"), (3, None, None)], "k long, cv string, jd string")

    def client(text):
        if "bad" in text:
            raise RuntimeError("down")
        return 'Sure: {"final_score": "80", "domain_context_alignment": 0.5, "explanation": "ok"}'

    out = {r.k: r for r in judge.parsed(judge.ask(df.withColumn("p", judge.prompt(F.col("cv"), F.col("jd"))), ["k"], "p", client)).collect()}
    assert out[1].final_score == 0.8 and out[1].domain_context_alignment == 0.5 and out[1].nice_to_have_coverage == 0 and out[1].explanation == "ok"
    assert out[2].final_score is None and out[2].error == "down" and out[3].final_score == 0.8


def test_failed_method_is_an_error_text(spark):
    pairs = spark.createDataFrame([(1, 2)], "cv long, jd long")
    out = methods.score_all(pairs, {"tfidf": lambda p: p.withColumn("score", F.lit(0.5)), "llm": methods.supervised}, "cv", "jd").collect()
    assert out[0].tfidf_score == 50.0 and out[0].llm_score is None and out[0].method_errors == "llm: no trained model" and out[0].final_score == 50.0


def test_report_and_methods_on_disk(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "g string")
    assert writers.markdown([writers.count_lines(df, "g", "Groups")], "Report") == "# Report\n\n## Groups\n\n- b: 2\n- : 1\n- a: 1\n"
    writers.write_by_method(df.withColumn("method", F.lit("tfidf")), str(tmp_path / "m"))
    assert (tmp_path / "m" / "method=tfidf").is_dir()
