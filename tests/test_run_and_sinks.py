"""Errors of pairs, listed tf-idf, diverse selection, the remote judge, spreadsheets and the whole run, on small tables."""

import http.server
import json
import math
import threading
import time
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import curation, evaluation, judge, labelling, matching, matrices, methods, run
from pairloom.sources import excel, readers, writers


def test_errors_of_pairs(spark):
    pairs = spark.createDataFrame([(i, j) for i in range(6) for j in range(5)], "cv long, jd long")

    def fragile(p):
        def score(rows):
            if (rows["cv"] == 3).any():
                raise ValueError("three is bad")
            return rows["cv"] / 10

        return methods.guarded(p, ["cv", "jd"], score)

    def partly(p):
        docs = spark.createDataFrame([(1, 0.5), (2, None), (1, 0.5)], "cv long, x double")
        found = methods.looked_up(p, docs, "cv", ["x"], "document")
        return methods.guarded(found, ["cv", "jd"], lambda rows: rows["x"])

    some = lambda p: p.filter("jd <> 4").withColumn("score", F.lit(1.0))
    out = {(r.cv, r.jd): r for r in methods.score_all(pairs.union(pairs), {"tfidf": fragile, "sbert": partly, "section": some, "gte": methods.supervised}, "cv", "jd").collect()}
    assert len(out) == 30
    for (cv, jd), r in out.items():
        errors = ["tfidf: three is bad"] * (cv == 3) + ["gte: no trained model"] + ([] if cv in (1, 2) else [f"sbert: no document {cv}"]) + ["section: no result"] * (jd == 4)
        assert r.method_errors == "; ".join(errors)
        assert r.tfidf_score == (None if cv == 3 else 10.0 * cv) and r.sbert_score == (50.0 if cv == 1 else None)
        known = [x for x in (r.tfidf_score, r.sbert_score, r.section_score) if x is not None]
        assert r.final_score == pytest.approx(sum(known) / len(known) if known else 0.0, abs=1e-4)


def brute_tfidf(a, b, most):
    import re

    def terms(t):
        w = [x for x in re.findall(r"\w{2,}", (t or "").lower()) if x != "the"]
        return Counter(w + [f"{x} {y}" for x, y in zip(w, w[1:], strict=False)])

    x, y = terms(a), terms(b)
    kept = sorted(set(x) | set(y), key=lambda t: (-x[t] - y[t], t))[:most]
    idf = {t: 1.0 if x[t] and y[t] else math.log(1.5) + 1 for t in kept}
    u, v = (np.array([c[t] * idf[t] for t in kept]) for c in (x, y))
    norm = np.linalg.norm(u) * np.linalg.norm(v) if kept else 0
    return float(u @ v / norm) if norm else 0.0


@pytest.mark.parametrize("most", [3, 7, 20_000])
def test_tfidf_of_listed_pairs(spark, most):
    cv = {1: "big red dog and the big cat", 2: "", 3: None, 4: "nothing shared here", 5: "the the", 6: "dog dog dog cat cat fish red red red red"}
    jd = {1: "red dog barks at big cat", 2: " ", 3: "dog cat"}
    pairs = [(i, j) for i in (*cv, 9) for j in (*jd, 9)]
    frames = [spark.createDataFrame(list(d.items()), f"{k} long, text string") for d, k in ((cv, "cv"), (jd, "jd"))]
    got = {(r.cv, r.jd): r.tfidf_score for r in matching.tfidf_listed(spark.createDataFrame(pairs + pairs[:2], "cv long, jd long"), *frames, "cv", "jd", "text", ["the"], most).collect()}
    assert got == {(i, j): pytest.approx(brute_tfidf(cv.get(i), jd.get(j), most), abs=1e-6) for i, j in pairs}


def brute_diverse(rows, n):
    """Turn by turn over groups, as the definition says; rows: (key, group, quality)"""
    if len(rows) <= n:
        return {r[0] for r in rows}
    groups = {}
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (-min(len(groups[g]), n), g is None, str(g)))
    cap = max(1, math.ceil(n / len(groups)) * 2)
    chosen, turn = [], 0
    while len(chosen) < n and any(turn < min(len(groups[g]), cap) for g in order):
        chosen += [groups[g][turn] for g in order if turn < min(len(groups[g]), cap)][: n - len(chosen)]
        turn += 1
    rest = sorted((r for r in rows if r not in chosen), key=lambda r: (-r[2], r[0]))
    return {r[0] for r in chosen + rest[: n - len(chosen)]}


@pytest.mark.parametrize("n", [1, 7, 20, 45, 60, 100])
def test_select_diverse_against_turns(spark, n):
    rows = [(k, g, float((k * 37) % 11)) for k, g in enumerate(["a"] * 40 + ["b"] * 3 + ["c"] * 9 + [None] * 5 + ["d"])]
    out = curation.select_diverse(spark.createDataFrame(rows, "k long, g string, q double").withColumn("selection_note", F.lit("old")), n, "g", "q", "k").collect()
    assert {r.k for r in out} == brute_diverse(rows, n) and len(out) == min(n, len(rows))
    assert {r.selection_note for r in out} == {"all_available_unique_rows_below_target" if n >= len(rows) else "quality_ranked_balanced_by_g"}


def test_sample_diverse(spark):
    df = spark.createDataFrame([(k, "abc"[k % 3] if k % 10 else None) for k in range(60)], "k long, g string")
    one = [{r.k for r in curation.sample_diverse(df, 10, "g", "k", s).collect()} for s in (1, 1, 2)]
    assert one[0] == one[1] != one[2] and all(len(x) == 10 for x in one)
    by_group = Counter("abc"[k % 3] if k % 10 else None for k in one[0])
    assert max(by_group.values()) - min(by_group.values()) <= 1 and len(by_group) == 4
    assert curation.sample_diverse(df, 100, "g", "k").count() == 60 and curation.sample_diverse(df.limit(0), 5, "g", "k").count() == 0
    assert len({r.k for r in curation.sample(df, 5, "k", 3).collect()}) == 5


def test_spearman_without_variation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "x double, y double")
    assert evaluation.spearman(df, "x", "y").collect()[0] == (0.0, 1.0)
    assert evaluation.spearman(df.limit(0), "x", "y").collect()[0] == (0.0, 1.0)
    r = evaluation.spearman(spark.createDataFrame([(float(i), float((i * 7) % 10)) for i in range(10)], "x double, y double"), "x", "y").collect()[0]
    assert 0 < r.p_value < 1


def test_judged_and_disagreements(spark):
    pred = spark.createDataFrame([(1, 0.9), (2, 0.1)], "k long, s double")
    with pytest.raises(ValueError, match="no prediction"):
        evaluation.judged(pred, spark.createDataFrame([(7, 3)], "k long, human_label int"), ["k"])
    both = evaluation.judged(pred, spark.createDataFrame([(1, 3, 0.2), (2, 0, 0.2)], "k long, human_label int, human_score double"), ["k"])
    assert [r.k for r in evaluation.largest_disagreements(both, "s", ["k"], 1).collect()] == [1]
    assert {r.k: round(r.absolute_error, 6) for r in evaluation.largest_disagreements(both.drop("human_score"), "s", ["k"]).collect()} == {1: 0.1, 2: 0.1}


class Stub(http.server.BaseHTTPRequestHandler):
    """A model server that fails, delays and cuts its first answer to some prompts."""

    seen: Counter = Counter()
    lock = threading.Lock()
    now = most = 0

    def do_POST(self):
        prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["prompt"]
        with Stub.lock:
            Stub.seen[prompt] += 1
            n, Stub.now = Stub.seen[prompt], Stub.now + 1
            Stub.most = max(Stub.most, Stub.now)
        time.sleep(0.02)
        with Stub.lock:
            Stub.now -= 1
        if "always" in prompt or "fails" in prompt and n == 1:
            self.send_error(503)
            return
        body = json.dumps({"response": json.dumps({"score": 70, "short_explanation": prompt[-5:]})}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body[: len(body) // 2] if "cut" in prompt and n == 1 else body)

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    Stub.seen, Stub.most = Counter(), 0
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/api/generate"
    s.shutdown()


def test_judge_asks_each_prompt_once(spark, tmp_path, server):
    rows = [(i, t) for i, t in enumerate(["plain 1", "fails 2", "cut 3", "always 4", None, "plain 1", *(f"more {k}" for k in range(20))])]
    df = spark.createDataFrame(rows, "k long, p string")
    client = judge.HttpClient("m", server, timeout=5)
    ask = lambda: {r.k: r for r in judge.ask(df, ["k"], "p", client, log=str(tmp_path / "log"), workers=3, attempts=3, wait=0.01, partitions=2).collect()}
    one = ask()
    assert len(one) == len(rows) and one[4].error == "no prompt" and "503" in one[3].error and one[3].reply is None
    assert all(one[k].error is None and json.loads(one[k].reply)["score"] == 70 for k in one if k not in (3, 4))
    assert Stub.seen["plain 1"] == 1 and Stub.seen["fails 2"] == 2 and Stub.seen["cut 3"] == 2 and Stub.seen["always 4"] == 3
    assert Stub.most <= 6
    two = ask()  # replies are in the log; only the failed prompt is asked again
    assert {k: r.reply for k, r in two.items()} == {k: r.reply for k, r in one.items()}
    assert sum(Stub.seen.values()) == 1 + 2 + 2 + 6 + 20


def test_labelling_run(spark, server):
    pairs = spark.createDataFrame([(j, c, "likely_good", c) for j in range(3) for c in range(4)], "jd_id long, cv_id long, pair_type string, selection_rank int")
    jds, cvs = spark.createDataFrame([(0, "job"), (1, "always"), (2, None)], "jd_id long, jd_text string"), spark.createDataFrame([(0, "one"), (1, "fails"), (2, "")], "cv_id long, cv_text string")
    listed = labelling.candidate_pairs(pairs, jds)
    out = labelling.label(listed, cvs, jds, "cv_id", "jd_id", "cv_text", "jd_text", judge.HttpClient("m", server, timeout=5), workers=2, attempts=2, wait=0.01).collect()
    assert len(out) == 12 and set(labelling.LABEL_COLUMNS) <= set(out[0].asDict())
    for r in out:
        assert (r.llm_fit_score, r.llm_fit_category) == ((None, None) if r.jd_id == 1 else (70.0, "good fit"))
        assert (r.error is None) == (r.jd_id != 1) and r.candidate_pair_id.startswith("cand_")


def test_spreadsheet(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else i / 4, f"a <b> & \"c\" é {i}\x01", i % 2 == 0) for i in range(50)] + [(99, float("nan"), None, None)]
    path = tmp_path / "out.xlsx"
    for _ in range(2):
        excel.write_sheet(spark.createDataFrame(rows, "k long, x double, t string, b boolean").orderBy("k"), str(path), "scores & more")
    assert [p.name for p in tmp_path.iterdir()] == ["out.xlsx"]
    with zipfile.ZipFile(path) as z:
        tree = ET.fromstring(z.read("xl/worksheets/sheet1.xml"))
        assert 'name="scores &amp; more"' in z.read("xl/workbook.xml").decode() and len(z.namelist()) == 5
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    got = [["".join(c.itertext()) for c in r] for r in tree.iter(f"{space}row")]
    assert got[0] == ["k", "x", "t", "b"]
    assert got[1:] == [[str(k), "" if x is None or x != x else repr(x), "" if t is None else t.replace("\x01", ""), "" if b is None else str(int(b))] for k, x, t, b in rows]
    with pytest.raises(Exception, match="at most 32767"):
        excel.write_sheet(spark.createDataFrame([("x" * 40_000,)], "t string"), str(tmp_path / "long.xlsx"))
    assert [p.name for p in tmp_path.iterdir()] == ["out.xlsx"]


def test_score_summary(spark):
    df = spark.createDataFrame([(1.0, None, "good", ""), (3.0, 2.0, "bad", "x: y"), (5.0, 4.0, "good", None)], "a double, b double, label string, err string")
    text = writers.markdown(writers.score_summary(df, ["a", "b", "a"][:2], "label", "err"), "Run")
    assert "- good: 2" in text and "| a | 3 | 3.0000 | 2.0000 | 1.0000 | 2.0000 | 3.0000 | 4.0000 | 5.0000 |" in text and "| b | 2 |" in text and "- x: y: 1" in text


def test_readers_compose_and_infer(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,Resume_str\n5,ﬁne\n", encoding="utf-8")
    assert [(r.cv_id, r.text) for r in readers.load_resumes(spark, str(tmp_path / "a.csv")).collect()] == [("5", "fine")]
    assert dict(readers.read_csv(spark, str(tmp_path / "a.csv"), infer=True).dtypes)["ID"] == "int"
    df = spark.createDataFrame([(None,), ("x",)], "a string")
    assert [tuple(r) for r in df.select(readers.optional(df, "a", F.lit("d")), readers.optional(df, "b", F.lit("d"))).collect()] == [("d", "d"), ("x", "d")]


def test_whole_run(spark):
    cvs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("Skills\npython sql data\nExperience\n5 years", "Data and Database"), ("sales manager", "Sales"), ("", None), (None, "Sales"), ("python developer", "Software Development")])], "cv_id long, text string, resume_group string")
    jds = spark.createDataFrame([(1, "Requirements\npython and sql required\n3 years", "data analyst", "Technology"), (2, "", None, "Sales")], "jd_id long, text string, job_title string, occupation_group string")

    def broken(texts):
        if any("sales" in t for t in texts):
            raise ValueError("no such text")
        return matrices.letters(texts)

    out = {(r.cv_id, r.jd_id): r for r in run.match_run(cvs, jds, ["the"], {"sbert": matrices.letters}, matrices.letters, n=2).collect()}
    assert len(out) == 10 and out[0, 1].pair_type == "likely_good" and out[0, 1].requirement_score > out[1, 1].requirement_score
    assert out[0, 1].tfidf_score > 0 and all(out[k, 2].tfidf_score == 0 for k in range(5)) and {r.method_errors for r in out.values()} == {""}
    with pytest.raises(Exception, match="no such text"):
        matrices.embed(cvs, ["cv_id"], "text", broken).collect()


def test_methods_are_planned_apart(spark):
    """The plan of the wide table has no method's own joins, rows are kept in packed batches, and sentences are normalised once (F1)."""
    from pairloom.operators import extraction, settle

    pairs = spark.createDataFrame([(i, j) for i in range(3) for j in range(2)], "cv long, jd long")
    found = lambda p: p.join(p.groupBy("cv").agg(F.sum("jd").alias("own_sum")), "cv").select("cv", "jd", (F.col("own_sum") / 10).alias("score"))
    out = methods.score_all(pairs, {"tfidf": found, "sbert": found}, "cv", "jd")
    assert "own_sum" not in out._jdf.queryExecution().toString()
    assert {r.tfidf_score for r in out.collect()} == {10.0}
    rows = spark.createDataFrame([(1, "x", 0.5, True), (None, None, None, None), (2, "", -1.0, False)], "a long, b string, c double, d boolean")
    kept = settle.packed(rows)
    assert kept.schema == rows.schema and sorted(map(str, kept.collect())) == sorted(map(str, rows.collect()))
    assert settle.packed(rows.filter("a > 5")).count() == 0
    like = rows.select(extraction.is_requirement_like(F.col("b"), F.lit("must_have")).alias("o"))
    assert like._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
