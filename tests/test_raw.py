"""The four raw files on small tables, and the p-value of a rank correlation."""

import csv

import pytest
from pyspark.sql import functions as F

from pairloom.operators import evaluation
from pairloom.sources import raw

LONG = " ".join(f"skills{i}" for i in range(200))


def write(path, head, *rows):
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([head, *rows])
    return str(path)


def test_monster_jobs(spark, tmp_path):
    head = ["page_url", "uniq_id", "job_title", "job_description", "sector", "job_type", "location", "organization", "extra"]
    p = write(tmp_path / "a.csv", head, ["u", "1", "Nurse", LONG, "", "full", "x", "y", "z"], ["u", "2", "Nurse", LONG.upper(), "Care", "", "", "", ""], ["u", "3", "Dev", "too short", "", "", "", "", ""], ["", "4", "Dev", "", "", "", "", "", ""])
    out = raw.monster_jobs(spark, p)
    assert out.columns == raw.JOB_COLUMNS
    (r,) = out.collect()
    assert (r.source_id, r.occupation_group, r.source_category, r.word_count, r.job_type, r.page_url) == ("1", "Healthcare", "Unknown", 200, "full", "u") and r.quality_score > 0


def test_title_jobs(spark, tmp_path):
    p = write(tmp_path / "a.csv", ["", "Job Title", "Job Description"], ["7", "Flutter Developer", LONG], ["8", "Other", "short"])
    (r,) = raw.title_jobs(spark, p).collect()
    assert (r.source_id, r.job_title, r.source_category, r.occupation_group, r.location) == ("7", "Flutter Developer", "Flutter Developer", "Technology", "")


def test_resumes(spark, tmp_path):
    p = write(tmp_path / "a.csv", ["ID", "Resume_str", "Resume_html", "Category"], ["5", LONG, "<p>", "INFORMATION-TECHNOLOGY"], ["6", LONG + " more", "", ""])
    assert {(r.source_id, r.resume_group) for r in raw.resumes(spark, p).collect()} == {("5", "Information Technology"), ("6", "Unknown")}
    p = write(tmp_path / "b.csv", ["Resume", "Label"], ["short", "x"], [LONG, "Java_Developer"])
    out = raw.labelled_resumes(spark, p)
    assert out.columns == raw.RESUME_COLUMNS and [(r.source_id, r.source_category) for r in out.collect()] == [("1", "Java_Developer")]


@pytest.mark.parametrize(("rho", "n", "p"), [(0.5, 10, 0.14111328125), (-0.3, 25, 0.145113081), (0.9, 4, 0.1), (0.01, 1000, 0.752123841), (1.0, 9, 0.0), (0.0, 9, 1.0), (0.4, 2, 1.0), (float("nan"), 9, 1.0)])
def test_p_value(spark, rho, n, p):
    got = spark.createDataFrame([(rho, n)], "rho double, n long").select(evaluation.correlation_p_value(F.col("rho"), F.col("n")).alias("p")).collect()[0].p
    assert got == pytest.approx(p, abs=1e-9)
