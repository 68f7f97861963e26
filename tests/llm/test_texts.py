"""Transducer, fill-in-the-middle and phrases against the library and brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm import bpe, core, fim, phrases, queries

ALPHABET = ["'", "s", "re", "'ll", "'t", " ", "  ", "\n", "\t", "a", "B", "é", "漢", "1", "٣", "!", "-", "--", "<|endoftext|>", "<|endof", " ", "\x85", "🙂", "ᲊ", "\x00", "\x1c", "ſ", "ve", "'D", "$"]
ODD = [(1, None, "en"), (2, "", "en"), (3, "it's <P> here", "en"), (4, "x", None), (5, "a. b; a b", None), (6, "漢字 🙂 é", "de"), (6, "漢字 🙂 é", "de"), (None, "no key at all", "de"), (7, "long " * 40_000, "en"), (8, "w" * 300_000, "en")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    return real.unionByName(odd).withColumn("key", F.lit("k")).withColumn("n", F.lit(2)).withColumn("word", F.lit("w")).cache()


def texts(seed, rows, most):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, most))) for _ in range(rows)]


def test_ids_of_many_texts(library):
    enc = bpe.encoder()
    made = texts(1, 4000, 30) + ["a  <|endoftext|>  b", "", "'s", "''s", " 's", "\n's"]
    raw = [t.encode() for t in made]
    flat, ends = enc.rows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]))
    got = [flat[a:z].tolist() for a, z in zip(ends, ends[1:], strict=False)]
    assert got == [x.ids for x in library.encode_batch(made, add_special_tokens=False)]


LONG = ["a" * 5000 + "'s" + "-" * 3000 + "'s x", "漢字" * 3000, " " * 4000 + "x", "=" * 2000 + "'re", "\n" * 3000, "ÃÂ" * 3000, "<|endoftext|>" * 400, "e" * 20_000]


@pytest.mark.parametrize(("step", "limit"), [(50, 100), (333, 500), (1000, 300)])
def test_ids_of_a_text_in_parts(library, step, limit):
    r = random.Random(step)
    for t in [*texts(2, 20, 2000), *LONG, "".join(r.choice("ab-=' ") for _ in range(9000)), "".join(r.choice("etaoinshrdlu") for _ in range(30_000))]:
        got = [int(i) for part in bpe.encoder().stream(bpe.characters(np.frombuffer(t.encode(), np.uint8), step), limit) for i in part]
        assert got == library.encode(t, add_special_tokens=False).ids


def test_lookahead_is_enough_and_bounds_the_state():
    merges = bpe.Merges()
    ahead = merges.lookahead()
    r = random.Random(4)
    byte_id = merges.byte_id
    for letters in ("ab", "-=", "etaoinshr", "ÃÂ", " -", "the of and"):
        data = "".join(r.choice(letters) for _ in range(3000)).encode()
        whole = merges.merge([byte_id[b] for b in data])
        run, got = bpe.Transducer(merges, ahead, stride=7), []
        for b in data:
            got += run.push(bytes([b]))
            assert len(run.rest) <= ahead + 7 + max(map(len, merges.bytes_of.values()))
        assert got + run.finish() == whole


def test_decoding_by_parts_of_characters(library):
    r = random.Random(5)
    dec = bpe.decoder()
    for _ in range(500):
        ids = [r.randrange(50_257) for _ in range(20)]
        assert dec.text([dec.bytes_(np.array([i]))[0].tobytes() for i in ids]) == library.decode(ids, skip_special_tokens=False)


def test_op11(spark, docs, library, monkeypatch):
    out = bpe.decode(bpe.encode(docs), text="back")
    assert out.columns == [c if c != "text" else "back" for c in docs.columns]
    pairs = Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert Counter((r.doc_id, r.back) for r in out.collect()) == pairs
    ids = {r.text: r.ids for r in bpe.encode(docs.withColumn("t", F.col("text")), "t").collect()}
    assert all(v == library.encode(t or "", add_special_tokens=False).ids for t, v in ids.items())
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([50_256, 99_999, -3, 15],), ([None, 15],)], "ids array<int>")
    assert [r.text for r in bpe.decode(odd).collect()] == ["", "", "<|endoftext|>0", "0"]
    with pytest.raises(ValueError, match="already"):
        bpe.encode(docs, ids="key")


def middle(key, text):
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    x = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(m in t for m in fim.MARKS) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, t
    if h[3] % 100 < 20:
        return key, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return key, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_op12(docs):
    expected = Counter(middle(r.doc_id, r.text) for r in docs.collect())
    made = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = made.collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == expected
    assert Counter((r.doc_id, r.back) for r in got) == Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="output column"):
        fim.transform(docs, key="n")


@pytest.mark.parametrize("size", [1, 3, 64, 4096])
def test_chunks_at_every_size(size, monkeypatch):
    monkeypatch.setattr(core, "SLICE_BYTES", 50 * size)
    r = random.Random(size)
    made = ["".join(r.choice(["a", "bc", "Z", " ", "é", "漢", "\n", "1", "🙂", "longword"]) for _ in range(r.choice([0, 1, 5, 60, 400]))) for _ in range(100)]
    raw = [t.encode() for t in made]
    offs = np.cumsum([0] + [len(x) for x in raw])
    chunks = fim.Chunks(np.frombuffer(b"".join(raw), np.uint8), offs, size)
    for i, t in enumerate(made):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        assert chunks.count()[i] == len(units)
        for rank in {0, len(units), r.randint(0, len(units))}:
            head = "".join(units[:rank])
            assert chunks.place(i, rank) == (offs[i] + len(head.encode()), len(head))


def brute_phrases(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    kept = {g: a for g, a in f.items() if a >= least and len(g[1]) > 1}
    around = Counter()
    for (lang, p), a in kept.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                around[lang, p[i : i + k]] = max(around[lang, p[i : i + k]], a)
    out = {}
    for (lang, p), a in kept.items():
        if around[lang, p] and 100 * around[lang, p] >= 80 * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return Counter((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


@pytest.fixture(scope="module")
def phrase_docs(spark, docs):
    r = random.Random(9)
    words = ["the", "of", "A", "a", "new", "york", "city", "hall", "und", "é", "x-y"]
    made = [(1000 + i, "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", "\n", " ,"]) for _ in range(r.randint(0, 400))), r.choice(["en", "de", None, "und"])) for i in range(60)]
    made += [(2000, "the the the the the " * 400, "en"), (2001, "new york city hall " * 300, "de")]
    return docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(made, "doc_id long, text string, lang string")).cache()


def same_phrases(docs, least=30, top=2000):
    got = Counter((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(docs, least=least, top=top).collect())
    assert got == brute_phrases([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], least, top)
    return got


def test_op13(phrase_docs):
    assert len(same_phrases(phrase_docs)) > 100
    same_phrases(phrase_docs, least=3, top=50)
    assert phrases.collocations(phrase_docs.limit(0)).count() == 0


@pytest.mark.parametrize(("name", "value"), [("LISTED", 12), ("LISTED", 0), ("HOT", 7), ("BUCKET_WORDS", 300), ("RUN", 11), ("PENDING", 5), ("SLICE", 1000)])
def test_phrases_do_not_depend_on_sizes(phrase_docs, monkeypatch, name, value):
    assert hasattr(phrases, name)
    monkeypatch.setattr(phrases, name, value)
    same_phrases(phrase_docs, least=10)


def test_queries_of_the_three(spark):
    for name in ("op11_bpe_transducer", "op12_fill_in_middle", "op13_phrase_mining"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0
