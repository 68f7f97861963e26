"""The ten operators and the pipeline against brute force, on a small table with awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.llm import chat, core, decontam, digest, jaccard, langid, lm, packing, pii, queries, store, tokens
from pairloom.llm import lines as line_templates

SF = "/root/testdata/sf0.001"
ODD = [
    (9001, None), (9002, ""), (9003, "one two"), (9004, "one two"), (9005, "   \n\t "), (9006, "word " * 9000), (9007, "é" * 3 + " 12 $%"), (9008, "!!! 123"),
    (9009, "mail bob at acme dot com or a@b.co, host 10.0.0.1:8080, +1 (988) 555-2485, 4111 1111 1111 1111"), (9009, "repeated key"), (None, "a row without key"), (9010, "<|endoftext|> it's ΑΣ x²"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of the smallest scale, odd rows, and columns whose names clash with inner ones."""
    real = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in ODD], real.schema)
    return real.unionByName(odd).withColumn("key", F.lit("k")).withColumn("sig", F.lit(1)).withColumn("c0", F.lit(2)).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def words(t):
    return (t or "").encode().lower().split()


def test_near_components(docs, rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                root[find(a)] = find(b)
    groups: dict = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    expected = Counter((k, len(sets[i]), least[find(i)] if sets[i] else k) for i, (k, _) in enumerate(rows))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_components(docs).collect())
    assert got == expected


def test_near_components_of_split_clusters(docs, monkeypatch):
    one = sorted(map(str, jaccard.near_components(docs).collect()))
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 2000)
    assert sorted(map(str, jaccard.near_components(docs).collect())) == one


def test_language(docs):
    model = langid.train(docs.filter(~core.held(F.col("doc_id"), 3, 1)))
    out = langid.predict(docs, model, ["doc_id", "lang", "text"]).collect()
    real = [r for r in out if r.doc_id is not None and r.doc_id < 9000]
    assert sum(r.lang == r.lang_pred for r in real) >= 0.97 * len(real)
    for r in out:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.text is None or not re.search(r"[^\W\d_]", r.text))
    assert langid.predict(docs.limit(0), langid.train(docs.limit(0))).count() == 0


def test_language_of_held_out_rows(spark):
    """Rows that were not learned from: 0.97 of their labels are found."""
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null")
    held = core.held(F.col("doc_id"), 3, 1)
    out = langid.predict(real.filter(held), langid.train(real.filter(~held)), ["doc_id", "lang"]).collect()
    some = [r for r in out if r.lang_pred != langid.UNKNOWN]
    assert len(some) >= 250 and sum(r.lang == r.lang_pred for r in some) >= 0.97 * len(some)


def library_ids(t):
    return np.array([*tokens.encoder().whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


def test_token_ids(rows):
    assert list(tokens.encoded(pa.array([t for _, t in rows], pa.string()))) == [library_ids(t) for _, t in rows]


def test_packing(docs, rows):
    out = packing.pack(docs, 512).collect()
    expected = Counter()
    for k, t in rows:
        x = library_ids(t)
        for i, s in enumerate(range(0, len(x), 2048)):
            expected[(k, i, s // 4, len(x[s : s + 2048]) // 4, zlib.crc32(x[s : s + 2048]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    places: dict = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 512
    assert len(places) <= 1.02 * sum(r.length for r in out) / 512 + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_store_round_trip(spark, docs, rows):
    path = core.new_path(spark, "test")
    store.write_store(docs, path)
    start, expected = 0, []
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        n = len(library_ids(t)) // 4
        expected.append((k, n))
    got = sorted(store.read_index(spark, path).collect(), key=lambda r: r.start)
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in got] == [k for k, _ in expected]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((k, len(library_ids(t)) // 4, zlib.crc32(library_ids(t))) for k, t in rows)
    assert Counter((r.doc_id, bytes(r.ids)) for r in store.read_documents(spark, path).collect()) == Counter((k, library_ids(t)) for k, t in rows)
    assert len(store.store_root(spark, path)) == 32
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_lm_base(docs, rows):
    model, counts = lm.train(docs.filter(~core.held(F.col("doc_id"), 7, 2)))
    train = [t for k, t in rows if zlib.crc32(str(k if k is not None else "").encode()) % 7 != 2]
    c = Counter(w for t in train for w in words(t))
    n, v = sum(c.values()) + len(train), len(c) + 1
    expected = Counter()
    for k, t in rows:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)) + math.log10((len(train) + 1) / (n + v + 1))
        expected[(k, len(words(t)) + 1, 1 + sum(c[w] > 0 for w in words(t)), n, round(base, 4))] += 1
    out = lm.score(docs, model, counts).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == expected
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


@pytest.mark.parametrize("size", [30_000, 4 << 20])
def test_lm_counts_all_pairs(docs, rows, monkeypatch, size):
    """Every word and pair of the training texts counts, in few parts and slices and in many."""
    held = core.held(F.col("doc_id"), 7, 2)
    monkeypatch.setattr(lm, "PART_TEXT", size)
    monkeypatch.setattr(lm, "SLICE_TEXT", size)
    out = lm.score(docs, *lm.train(docs.filter(~held))).collect()
    train = [words(t) for k, t in rows if zlib.crc32(str(k if k is not None else "").encode()) % 7 != 2]
    one, two = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(t, t[1:]))  # noqa: B905
    total = sum(one.values()) + len(train) + len(one) + 2

    def quantised(c):
        level = math.floor(math.log(c) / math.log(1.5) + 1e-9) if c else -1
        return 1.0 if level == 0 else 1.5**level * 1.25 if c else 0.0

    expected: dict = {}
    for k, t in rows:
        w, s = words(t), math.log10((quantised(len(train)) + 1) / total)
        for i, x in enumerate(w):
            p = (quantised(one[x]) + 1) / total
            h = quantised(one[w[i - 1]]) if i else 0
            j = quantised(two[w[i - 1], x]) if i else 0
            s += math.log10(0.5 * j / max(h, j) + 0.5 * p if h else p)
        expected.setdefault((k, len(w) + 1), []).append(s)
    # members of the filter that were never added make a word likelier, a few in a thousand
    close = [min(abs(r.score - s) for s in expected[r.doc_id, r.n_tokens]) / r.n_tokens for r in out]
    assert sum(x < 0.02 for x in close) >= 0.95 * len(close)


def test_log_frequency_filter():
    f = lm.LogFrequencyFilter(1 << 20)
    grams, counts = core._stream(1, 500), np.arange(1, 501)
    f.add(grams, counts)
    assert (np.abs(np.log(f.count(grams) / counts)) < math.log(1.6)).mean() > 0.97
    assert (f.count(core._stream(2, 500)) > 0).mean() < 0.05


def test_fingerprints(docs, rows):
    out = digest.fingerprints(docs).collect()
    order = sorted(((k, t or "", t is not None) for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    expected = Counter()
    for i, (k, t, _) in enumerate(order):
        cut, after = len(t) // 4, order[(i + 1) % len(order)][1]
        expected[(k, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest(), digest.digest(t.encode()))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in out) == expected
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    alone = digest.fingerprints(docs.filter("doc_id = 5")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_lines(spark, docs, monkeypatch):
    shared = "this licence line number {} stands in many documents of ours"
    rows = [(i, f"first {i} line of its own text\n{shared.format(i)}\nlast words of document {i * 7} here\nshort {i}", i) for i in range(8)]
    rows += [(100 + i, "copied text has three\nlines that are the same in\nevery single copy of it", 1) for i in range(5)] + [(200, None, 1), (201, "", 1)]
    df = spark.createDataFrame([(i, t.replace("first", "abcdefgh"[n % 8]) if t and i < 8 else t, n) for i, t, n in rows], "doc_id long, text string, member int")
    out = {r.doc_id: r for r in line_templates.drop_lines(df).collect()}
    assert "licence" in out[0].text and all("licence" not in out[i].text for i in range(1, 8))
    assert all(out[100 + i].n_dropped == 0 for i in range(5))
    assert out[200].text is None and out[201].text == "" and len(out) == len(rows)
    kept = line_templates.drop_lines(df.withColumn("n_lines", F.lit("own")))
    assert sorted(kept.columns) == sorted([*df.columns, "n_lines", "n_dropped"]) and kept.count() == len(rows)
    monkeypatch.setattr(line_templates, "SENT", 0)
    assert {r.doc_id: r.text for r in line_templates.drop_lines(df).collect()} == {k: r.text for k, r in out.items()}


def test_lines_count_documents(spark):
    """Blocks of lines, paragraphs between blank lines and passages of two documents go; those of copies stay."""
    own = lambda i: "\n".join(" ".join(hashlib.md5(f"{i} {k} {j}".encode()).hexdigest()[:6].translate({48 + d: 103 + d for d in range(10)}) for j in range(9)) for k in range(6))
    block = "permission is granted to any person\nwithout limits of any sort to use\nsubject to the terms that follow here\nprovided as it stands without warranty"
    alone = "a paragraph of its own between blank lines"
    two = "this passage stands in just two of them"
    texts = {i: f"{own(i)}\n{block}\n{own(i + 50)}\n\n{alone}\n\n" + (two if i < 2 else "") for i in range(4)}
    texts |= {10 + i: own(99) + f"\ncopy {i}" for i in range(5)} | {20 + i: own(98) for i in range(3)}
    out = {r.doc_id: r for r in line_templates.drop_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert out[0].n_dropped == 0 and out[0].text == texts[0]
    for i in (1, 2, 3):
        assert out[i].text == f"{own(i)}\n{own(i + 50)}\n\n" + ("\n" if i > 1 else "")
    assert all(out[k].n_dropped == 0 for k in texts if k >= 10)


def test_templates_of_one_leaf(spark):
    names = ["".join(chr(97 + (i * 7 + j) % 26) for j in range(5)) for i in range(8)]
    rows = [(i * 2 + k, f"own {names[i]} opening words {i} here\nthe log entry {what} by user {n} on this host\nown {names[-i]} closing words") for i, n in enumerate(names) for k, what in enumerate(("opened", "closed"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dropped = {r.doc_id: r.n_dropped for r in line_templates.drop_lines(df).collect()}
    assert all(dropped[k] >= 1 for k in range(2, 16)) and len(dropped) == 16


@pytest.mark.parametrize("share", [0.2, 0.5, 0.7, 0.85, 0.95])
@pytest.mark.parametrize("n", [2, 12, 60])
def test_shared_blocks_of_half_alike_documents(spark, share, n):
    """A block that documents share goes from all but the first, whatever part of them it is, unless they are near copies."""
    import random

    r = random.Random(n)
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    line = lambda: " ".join(name() for _ in range(9))
    block = [line() for _ in range(round(60 * share))]
    rows = [(i, "\n".join([*block, *(line() for _ in range(60 - len(block)))])) for i in range(n)]
    sets = [{tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for _, t in rows[:2]]
    copies = 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1])
    assert copies == (share == 0.95)
    out = {x.doc_id: x.n_dropped for x in line_templates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: 0 if copies or i == 0 else len(block) for i in range(n)}


@pytest.mark.parametrize("slot", [20_000, 2])
@pytest.mark.parametrize("seed", [5, 6])
def test_lines_against_brute_force(spark, monkeypatch, slot, seed):
    """Templates as components of all pairs of lines of a leaf that differ at few enough words."""
    import random

    monkeypatch.setattr(line_templates, "SLOT_LINES", slot)
    monkeypatch.setattr(line_templates, "HUB_TEXTS", slot)
    r = random.Random(seed)
    name = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    bases = [[name() for _ in range(n)] for n in (4, 5, 7, 10, 13, 20, 33, 60) for _ in range(3)]
    for b in bases[1::3]:
        b[:3] = bases[bases.index(b) - 1][:3]  # two templates in one leaf
    texts = {}
    for i in range(60):
        lines = []
        for b in r.sample(bases, 5):
            w = list(b)
            for p in r.sample(range(3, len(w)), min(len(w) - 3, r.randint(0, line_templates.allowed(len(w)) // 2 + 1))):
                w[p] = name() if r.random() < 0.7 else f"{name()}{i}"
            lines.append(" ".join(w))
        lines += [" ".join(name() for _ in range(9)) for _ in range(6)]
        texts[i] = "\n".join(lines)
    flat = [(i, n, ["#" if re.search("[0-9]", x) else x for x in t.split()]) for i, text in texts.items() for n, t in enumerate(text.split("\n"))]
    root = list(range(len(flat)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(flat)):
        for y in range(x):
            a, b = flat[x][2], flat[y][2]
            if len(a) == len(b) and a[:3] == b[:3] and sum(p != q for p, q in zip(a, b, strict=True)) <= 0.3 * len(a) + 1e-9:
                root[find(x)] = find(y)
    first: dict = {}
    for x, (i, _, _) in enumerate(flat):
        first[find(x)] = min(first.get(find(x), i), i)
    expected = {i: "\n".join(t for n, t in enumerate(text.split("\n")) if first[find(i * 11 + n)] == i) for i, text in texts.items()}
    out = {x.doc_id: x.text for x in line_templates.drop_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert out == expected
    assert sum(len(t.split("\n")) for t in expected.values()) < 0.7 * len(flat)


def test_variable_words_are_one_template(spark):
    """A template whose variable word is another in each line is one template all the same."""
    names = ["".join(chr(97 + (i * 7 + j) % 26) for j in range(5)) for i in range(10)]
    df = spark.createDataFrame([(i, f"the log entry opened by user {n} on this host") for i, n in enumerate(names)], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_templates.drop_lines(df).collect()} == {i: int(i > 0) for i in range(10)}


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def rule_ok(kind, m):
    d = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def test_pii(spark, docs):
    more = ["a@b.co_x@y.com 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255", "4111 1111 1111 1111-4111111111111111 +1+12345678901", "\x01a@b.c\x01", "1234567890" * 300]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(9100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    added = {}
    for r in pii.find(df).collect():
        t = r.text or ""
        for k in pii.KINDS:
            assert [(x.s, x.e) for x in r.pii[k]] == [m.span() for m in re.finditer(RULES[k], t) if rule_ok(k, m[0])]
        if r.pii["added"]:
            added[t[:20]] = [t[x.s : x.e] for x in r.pii["added"]]
    assert added[ODD[8][1][:20]] == ["bob at acme dot com", "10.0.0.1:8080"]
    clean = [r.text for r in pii.redact(df.filter("doc_id = 9009")).collect()]
    assert any("[EMAIL]" in x and "[CARD]" in x and "4111" not in x for x in clean)


def test_pii_of_many_spans(spark, monkeypatch, tmp_path):
    """Thousands of spans in one text, at any size of its chunks; secrets are among the query's spans."""
    text = " ".join(f"u{i}@h{i}.org 10.0.{i % 250}.{i % 199}:80 call +1 415 555 {i:04d} mail bob{i} at acme dot com é" for i in range(700))
    df = spark.createDataFrame([(1, text), (2, "x 10.0.0.1:8080 y"), (3, ""), (4, None)], "doc_id long, text string")
    one = {r.doc_id: r.pii for r in pii.find(df).collect()}
    for k in pii.KINDS:
        assert [(x.s, x.e) for x in one[1][k]] == [m.span() for m in re.finditer(RULES[k], text) if rule_ok(k, m[0])]
    assert len(one[1]["added"]) >= 700 and all("at acme dot com" in text[x.s : x.e] for x in one[1]["added"] if x.k == 0)
    monkeypatch.setattr(pii, "_CHUNK", 4)
    assert {r.doc_id: r.pii for r in pii.find(df).collect()} == one
    secret = 'token = "' + "0a1B2c3D4e" * 4 + '"'
    spark.createDataFrame([(1, f"say {secret} to me@x.org", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    r = queries.op4_pii_boosting(spark, str(tmp_path)).collect()[0]
    assert r.spans == "email:58:66,secret:13:53" and (r.n_secret, r.n_found, r.n_email) == (1, 2, 1)


def test_pii_generators_are_not_narrowed(spark):
    """The test that spares texts without candidates holds wherever the pattern matches, and ports extend addresses."""
    texts = ["bob at acme.com", "bob at acme (dot) com", "bob at acme[dot]com", "bob (at) acme.com", "a@b dot c", "1.2.3.4:80", "fe80:0:0:1:2:3:4:5", "4111/1111/1111/1111", "(988) 555-2485", "token = " + "ab12" * 8]
    kinds = [0, 0, 0, 0, 0, 1, 1, 2, 3, 4]
    df = spark.createDataFrame(list(zip(kinds, texts, strict=True)), "k int, text string")
    for r in df.select("k", "text", *(F.size(pii._matches(F.col("text"), pii.WIDE[x], pii.WIDE_NEEDS[x])).alias(x) for x in pii.ALL)).collect():
        assert r[pii.ALL[r.k]] >= 1, r
    said = "mail bob at acme.com, server 10.0.0.1:8080 here, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""
    own = spark.createDataFrame([(said, 5, 6, 7)], "text string, pii int, taken int, more int")
    r = pii.find(own, into="spans").first()
    assert (r.pii, r.taken, r.more) == (5, 6, 7) and [(pii.ALL[x.k], said[x.s : x.e]) for x in r.spans.added] == [("email", "bob at acme.com"), ("ip", "10.0.0.1:8080"), ("secret", said[-41:-1])]
    assert pii.redact(own).first().asDict() == {"text": 'mail [EMAIL], server [IP] here, token = "[SECRET]"', "pii": 5, "taken": 6, "more": 7}


def test_pii_on_other_templates(spark):
    """Precision and recall of the added spans on sentences that training does not have."""
    import random

    r = random.Random(23)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: r.choice(["maria", "jon.smith", "k_lee", "anna", "rob42"])
    host = lambda: r.choice(["example", "mail6", "corp-net", "uni"])

    def card():
        body = r.choice("345") + d(14)
        s = sum(int(c) if i % 2 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(body)))
        return body + str(-s % 10)

    yes = {
        0: [lambda: (f"you can write to {{}} today", f"{name()} at {host()} dot com"), lambda: ("my mail is {} ok", f"{name()}[at]{host()}.org"), lambda: ("or contact {} please", f"{name()} (at) {host()} (dot) net")],
        1: [lambda: ("it runs on host {} now", f"10.{r.randint(0, 255)}.0.{r.randint(1, 250)}:{r.randint(1000, 9999)}"), lambda: ("our ip {} changed", ":".join(f"{r.randint(4096, 65535):x}" for _ in range(8)))],
        2: [lambda: ("charge my card {} again", "/".join((lambda x: [x[i : i + 4] for i in range(0, 16, 4)])(card()))), lambda: ("pay with {} then", ".".join((lambda x: [x[i : i + 4] for i in range(0, 16, 4)])(card())))],
        3: [lambda: ("please call {} soon", f"({d(3)}) {d(3)}-{d(4)}"), lambda: ("my mobile {} rings", f"{d(3)}-{d(3)}-{d(4)}"), lambda: ("fax 00{} works", None)],
        4: [lambda: ("export API_KEY={} and go", "".join(r.choice("abcdefXYZ0123456789") for _ in range(32))), lambda: ("his password: {} leaked", "".join(r.choice("abcdefgh0123456789") for _ in range(24)))],
    }
    no = [lambda: f"we met at {host()} dot something else", lambda: f"build {r.randint(1, 9)}.{r.randint(300, 999)}.{r.randint(0, 9)}.{r.randint(0, 9)} is out", lambda: f"on {d(4)}-{d(2)}-{d(2)} it rained", lambda: f"a sum of {d(9)} units", lambda: "the Donaudampfschifffahrtsgesellschaft came", lambda: f"part no {d(14)} shipped"]
    rows = []
    for _ in range(40):
        for k, makers in yes.items():
            for make in makers:
                shape, span = make()
                if span:
                    rows.append((shape.format(span), k, shape.index("{}"), shape.index("{}") + len(span)))
        rows += [(make(), -1, 0, 0) for make in no]
    got = pii.find(spark.createDataFrame(rows, "text string, k int, s int, e int")).collect()
    for k, kind in enumerate(pii.ALL):
        right = sum(any((x.k, x.s, x.e) == (k, r.s, r.e) for x in r.pii.added) for r in got if r.k == k)
        given = sum(x.k == k for r in got for x in r.pii.added)
        want = sum(r.k == k for r in got)
        print(kind, "recall", right / want, "precision", right / max(1, given))
        assert right >= 0.9 * want and right >= 0.9 * given, kind


def test_chat(spark):
    said = '{"tool_calls":[{"id":"b","name":"add","arguments":{"y":2,"x":{"q":1,"a":[1.5,null]}},"depends_on":["a"]},{"id":"a","name":"add","arguments":{"x":1}},{"id":"c","name":"add","arguments":{},"depends_on":["d"]},{"id":"d","name":"add","arguments":{"x":"s"},"depends_on":["c"]}]}'
    df = spark.createDataFrame([(1, 0, "assistant", said), (1, 1, "tool", '{"call_id":"a","content":3}'), (2, 0, "user", None), (None, 1, "user", "x"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    out = {r.call_id: r for r in chat.format_calls(df, {"add": {"x": ("integer", True), "y": ("integer", False)}}).collect()}
    assert (out["a"].level, out["b"].level, out["c"].level, out["d"].level) == (0, 1, None, None)
    assert out["a"].valid and not any(out[k].valid for k in "bcd") and not out["call_2_0"].valid
    assert out["b"].json.startswith('{"arguments":{"x":{"a":[1.5,null],"q":1},"y":2}') and '"result":3' in out["a"].json
    assert out["call_3_0"].content == '{"text":"yo"}'
    assert chat.format_calls(df.limit(0)).count() == 0


def test_chat_levels_of_long_chains(spark):
    """Levels go on as long as a round settles calls, and calls on a cycle stay without one."""
    rows = [(1, f"c{i}", [f"c{i - 1}", "c0"] if i else []) for i in range(12)] + [(2, "x", ["y"]), (2, "y", ["x"]), (2, "z", ["y"])]
    out = chat.levels(spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>"))
    assert {(r.conv_id, r.call_id): r.level for r in out.collect()} == {(1, f"c{i}"): i for i in range(12)} | {(2, k): None for k in "xyz"}


def test_chat_levels_against_brute_force(spark):
    import random

    r = random.Random(11)
    rows = []
    for conv in range(30):
        n = r.randint(1, 25)
        for i in range(n):
            deps = r.sample(range(n), min(n, r.choice([0, 1, 1, 1, 2, 3]))) if conv % 3 == 0 else r.sample(range(i), min(i, r.choice([0, 1, 1, 1, 2, 3])))
            rows.append((conv, f"c{i}", [f"c{d}" for d in deps] + (["none"] if r.random() < 0.2 else [])))
    rows += [(None, "c0", ["c0"]), (1, None, ["c0"])]
    edges = {(c, k): {(c, d) for d in deps if d != "none"} for c, k, deps in rows if c is not None and k is not None}
    level: dict = {}
    while new := {k: 1 + max((level[d] for d in v), default=-1) for k, v in edges.items() if k not in level and all(d in level for d in v)}:
        level |= new
    out = chat.levels(spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>")).collect()
    assert {(x.conv_id, x.call_id): x.level for x in out} == {k: level.get(k) for k in edges} | {(None, "c0"): 0, (1, None): 0}
    assert max(level.values()) > 6 and len(level) < len(edges)


def test_schemas(spark):
    schema = {
        "type": "object", "required": ["a"], "additionalProperties": False,
        "properties": {"a": {"type": "integer", "minimum": 1, "maximum": 5}, "b": {"enum": ["x", 2]}, "c": {"type": "array", "items": {"type": "object", "properties": {"d": {"type": "string", "minLength": 2}}, "required": ["d"]}}},
    }
    good = ['{"a":1}', '{"a":5,"b":"x"}', '{"a":2,"b":2}', '{"a":3,"c":[]}', '{"c":[{"d":"xy","e":1}],"a":3}']
    bad = ["{", "[]", "{}", '{"a":0}', '{"a":6}', '{"a":"1"}', '{"a":1,"b":"y"}', '{"a":1,"z":1}', '{"a":1,"c":[{"d":"x"}]}', '{"a":1,"c":[{}]}', '{"a":1,"c":{}}', None]
    df = spark.createDataFrame([("f", x) for x in good + bad] + [("g", good[0]), (None, good[0])], "name string, arguments string")
    assert [x.valid for x in chat.validate(df, {"f": schema}).collect()] == [True] * len(good) + [False] * (len(bad) + 2)


def test_decontamination(spark, docs, rows, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").union(spark.createDataFrame([(900, None), (901, ""), (902, "one two")], "item_id long, text string"))
    alnum = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows: dict = {}
    for r in bench.collect():
        w = alnum.findall((r.text or "").encode().lower())
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(r.item_id))
    expected = Counter()
    for k, t in rows:
        w = alnum.findall((t or "").encode().lower())
        hit, items = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    items |= windows[tuple(w[i : i + n])]
        expected[(k, len(w), len(hit), tuple(sorted(items)))] += 1
    count = lambda df: Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in df.collect())
    assert count(decontam.decontaminate(docs, bench)) == expected
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 1500)
    assert count(decontam.decontaminate(docs, bench)) == expected


def test_decontamination_of_repeated_keys(spark, monkeypatch):
    """Rows that share a key, or have none, keep their own hits, in one block as in many."""
    items = [(i, " ".join(f"item{i}word{j}" for j in range(12))) for i in range(4)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [("x y " + items[i][1] + " z") for i in range(4)] + ["x y z " + "w " * 11]
    df = spark.createDataFrame([(k, t) for k in (7, None) for t in texts], "doc_id long, text string")
    expected = Counter((k, (str(i),) if i < 4 else (), 12 if i < 4 else 0, 3 if i < 4 else 0) for k in (7, None) for i in range(5))
    for words in (1000, 20):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", words)
        assert Counter((r.doc_id, tuple(r["items"]), r.n_hit, r.n_near) for r in decontam.decontaminate(df, bench, slack=1).collect()) == expected
        assert sorted(str(r.doc_id) for r in decontam.clean_rows(df, bench).collect()) == ["7", "None"]


def test_proximity(spark, monkeypatch):
    import random

    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(14)]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(0, 60))) for _ in range(60)]
    items = [" ".join(r.choices(vocabulary, k=n)) for n in (5, 4, 6, 3, 5, 8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    count = Counter(" ".join(texts).split())
    windows = {tuple(x[k : k + 5]) for x in map(str.split, items) for k in range(max(1, len(x) - 4))}
    for slack in (1, 3):
        expected = {}
        for i, t in enumerate(texts):
            w, n = t.split(), 0
            for x in windows:
                o = min(range(len(x)), key=lambda j: (count[x[j]], j))
                n += any(w[p] == x[o] and set(x) <= set(w[max(0, p - o - slack) : max(0, p - o + len(x) + slack)]) for p in range(len(w)))
            expected[i] = n
        for words in (1000, 6):
            monkeypatch.setattr(decontam, "BLOCK_WORDS", words)
            got = {x.doc_id: x.n_near for x in decontam.decontaminate(docs, bench, window=5, slack=slack).collect()}
            assert got == expected and sum(got.values()) > 20


def test_pipeline(spark):
    import corpus_pipeline

    docs = core.documents(spark, SF)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = core.keep(stage(spark, docs, SF), "test")
        assert out.columns == docs.columns, name
        assert 0.6 * docs.count() <= out.count() <= docs.count(), name
        docs = out
    near = jaccard.near_components(docs).collect()
    assert len({r.component_id for r in near}) == len(near)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.select("doc_id").distinct().count() == docs.count()


def test_likeness_against_brute_force(docs, rows):
    """Likeness from the hex digits alone: steps between lengths and quartiles, a checksum, at most FAR."""
    steps = {0: 0, 1: 1, 2: 2, 3: 6}

    def like(x, y):
        if x == y:
            return 1.0
        bits = lambda s: [int(s[4 + 2 * i : 6 + 2 * i], 16) >> k & 3 for i in range(32) for k in (0, 2, 4, 6)]
        far = sum(steps[abs(a - b)] for a, b in zip(bits(x), bits(y), strict=True)) + max(0, abs(int(x[:2], 16) - int(y[:2], 16)) - 1) + (x[2:4] != y[2:4])
        return max(0.0, 1 - far / 200)

    own = {t or "": digest.digest((t or "").encode()) for _, t in rows}
    order = [t or "" for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))]
    expected = Counter()
    for i, t in enumerate(order):
        cut, after = len(t) // 4, order[(i + 1) % len(order)]
        edited = digest.digest((t[: len(t) - cut] + after[:cut]).encode())
        expected[(own[t], edited, round(like(own[t], edited), 9), round(like(own[t], own[after]), 9))] += 1
    out = digest.fingerprints(docs).collect()
    assert Counter((r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in out) == expected


def test_empty_tables(spark, docs):
    """No row in, none out, and the columns stay."""
    none = docs.limit(0)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    path = core.new_path(spark, "empty")
    store.write_store(none, path)
    made = [
        jaccard.near_components(none), pii.find(none), pii.redact(none), store.read_index(spark, path), lm.score(none, *lm.train(none)), digest.fingerprints(none),
        line_templates.drop_lines(none), decontam.decontaminate(none, bench), decontam.clean_rows(none, bench), jaccard.keep_one(none),
    ]
    assert all(df.count() == 0 for df in made)
    clean = decontam.decontaminate(docs, bench.limit(0)).agg(F.sum("n_hit"), F.sum("n_near")).first()
    assert tuple(clean) == (0, 0)
    untrained = lm.score(docs, *lm.train(none)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.base_score) for r in untrained)


def test_rows_that_share_a_key(spark):
    """Of rows with one key, or none, each goes by its own text."""
    text = "alpha beta gamma delta epsilon zeta eta theta"
    df = spark.createDataFrame([(1, text), (1, "quite another text of some seven words"), (2, text), (None, text), (None, "words that stand only here and nowhere else")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text[:5]) for r in jaccard.keep_one(df).collect()) == [("1", "alpha"), ("1", "quite"), ("None", "words")]


@pytest.mark.parametrize("cross", [False, True])
def test_sketches_lose_no_link_and_part_chains(cross):
    r = np.random.default_rng(1)
    draw = lambda n: r.integers(0, 1 << 63, n, dtype=np.uint64)
    sets = []
    for n in (1, 2, 5, 60, 63, 64, 65, 130, 300, 1000):
        base = draw(n)
        sets += [np.unique(np.concatenate([base[int(n * 0.3 * r.random()) :], draw(int(r.integers(0, n // 8 + 1)))])) for _ in range(8)]
    passage = draw(40)
    chained = len(sets)
    sets += [np.unique(np.concatenate([passage, draw(400)])) for _ in range(30)]  # a shared passage and no near duplicates
    sigs, n, side = np.array([jaccard.signature(x) for x in sets], np.uint64).view(np.int64), np.array([len(x) for x in sets]), r.integers(0, 2, len(sets))
    root = {x: x for x in sigs.tolist()}
    for a, b in jaccard._alike(sigs, side, n, [jaccard.sketch(x) for x in sets], 80, cross):
        old, new = root[a], root[b]
        root = {k: new if v == old else v for k, v in root.items()}
    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 80 * (n[i] + n[j] - c) and (not cross or side[i] != side[j]):
                assert root[sigs[i]] == root[sigs[j]]
    assert all(root[x] == x for x in sigs[chained:].tolist())
