"""Collocated phrases by pivot partitioning: each phrase is counted where its rarest word lives.

Words that occur often enough are numbered from the most frequent on.  Around each word of a text (the *pivot*) the
text is rewritten to the run of up to three words on either side that are more frequent, and that fragment goes to a
bucket of the pivot.  A phrase is counted only from the fragment of its rarest word (of equal words, the leftmost), so
every occurrence is counted once and all occurrences of a phrase meet in the bucket of its pivot.  Fragments are
rewritten, made distinct and packed by bucket before they are sent; a pivot with many occurrences is split among buckets by
the hash of the fragment, and what its parts count is summed afterwards.

The numbers of the ``LISTED`` most frequent words are broadcast (16 MB at most).  Where more words are frequent, the others are
rarer than all listed ones; they are ordered by their 63-bit hash and travel as such.  Words are told
apart by that hash, from the language on: two words of a corpus of a billion frequent ones share it with a chance of 5 %.

Rows: a null text is empty, a null language is ``und``, repeated rows count again, an empty table gives an empty
table, other columns are not looked at.  A piece or a word may be as long as a text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import core
from .core import U64

UNKNOWN = "und"
LEAST, LONGEST = 30, 4
#: Words with a number; it takes 20 bits, so that three fit a 64-bit key.
LISTED = (1 << 20) - 1
#: Words of text that one bucket stands for, and occurrences of a pivot above which it is split.
BUCKET_WORDS, HOT = 1 << 20, 1 << 18
#: Bytes of text rewritten at once.
SLICE = 4 << 20
#: Rows of a bucket above which equal fragments are put together while it is read.
PENDING = 1 << 20
#: Words whose fragments are made at once.
RUN = 1 << 20
_REACH = LONGEST - 1
_WIDTH = 2 * _REACH + 1
_LOW63 = U64((1 << 63) - 1)
_FAR = U64(1 << 63)

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"]] = _BREAK[10:14] = True
_WORD = ~_BREAK
_WORD[[32, 9]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = core._stream(71, _WIDTH) | U64(1)


def _language(lang: str) -> np.uint64:
    return U64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _parts(data: np.ndarray, limit: int):
    """A long text in parts cut before characters that are in no word."""
    at = 0
    while at < len(data):
        end = at + limit
        while end < len(data):
            gap = np.flatnonzero(~_WORD[data[end : end + limit]])
            if len(gap):
                end += int(gap[0])
                break
            end += limit
        yield data[at:end]
        at = end


def _hashed(data: np.ndarray, offs: np.ndarray, langs: np.ndarray):
    """Of the words of some texts: starts, ends, texts, and 63-bit hashes that depend on the text's language."""
    first, stop, rows = core.word_spans(data, offs, _WORD)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(rows))
    with np.errstate(over="ignore"):
        h = core.mix64(core.span_hashes(data, first, stop) + langs[text]) & _LOW63
    return first, stop, text, h


def _slices(batch):
    """Runs of texts: bytes, offsets, code of each text's language, the languages' seeds and names.

    Long texts come in parts; the last two values tell that a part follows another one, and that no other follows.
    """
    lang = pc.fill_null(batch.column("lang"), UNKNOWN).dictionary_encode()
    names = lang.dictionary.to_pylist()
    seeds, code = np.array([_language(x) for x in names], U64), lang.indices.to_numpy()
    for a, z, data, offs in core.text_slices(batch.column("text"), SLICE):
        if len(data) > 2 * SLICE:
            parts = list(_parts(data, SLICE))
            for k, part in enumerate(parts):
                yield part, np.array([0, len(part)]), code[a:z], seeds, names, k > 0, k == len(parts) - 1
        else:
            yield data, offs, code[a:z], seeds, names, False, True


def _gathered(data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The spans' bytes as strings, A-Z lower-cased."""
    size = stop - first
    ends = np.concatenate(([0], np.cumsum(size)))
    flat = _LOWER[data[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)).cast(pa.string())


def _count_words(batches):
    """Rows (lang, word, h, n); a row without a word holds all occurrences of its language."""
    for b in batches:
        for data, offs, code, seeds, names, _, _ in _slices(b):
            first, stop, text, h = _hashed(data, offs, seeds[code])
            if not len(h):
                continue
            one, at, n = np.unique(h, return_index=True, return_counts=True)
            of = code[text[at]]
            each = np.bincount(code[text], minlength=len(names))
            seen = np.flatnonzero(each)
            words = pa.concat_arrays([_gathered(data, first[at], stop[at]), pa.nulls(len(seen), pa.string())])
            lang = pa.array(names, pa.string()).take(pa.array(np.concatenate((of, seen))))
            h_all = np.concatenate((one.astype(np.int64), np.zeros(len(seen), np.int64)))
            yield pa.RecordBatch.from_arrays([lang, words, pa.array(h_all), pa.array(np.concatenate((n, each[seen])).astype(np.int64))], ["lang", "word", "h", "n"])


class Numbers:
    """Numbers of the listed words by hash, from 1 on, and into how many parts a pivot is split."""

    def __init__(self, h: np.ndarray, n: np.ndarray, complete: bool):
        order = np.lexsort((h, -n))
        self.hash_of = h[order].astype(U64)  # by number
        by_hash = np.argsort(self.hash_of)
        self.sorted, self.number = self.hash_of[by_hash], (by_hash + 1).astype(np.uint32)
        self.parts = np.minimum(1 + n[order] // HOT, 1 << 30).astype(np.uint32)
        self.complete = complete

    def of(self, h: np.ndarray) -> np.ndarray:
        """Numbers; words that are not listed get 0 where all frequent ones are, and else their hash, above all numbers."""
        rest = np.zeros(len(h), U64) if self.complete else h | _FAR
        if not len(self.sorted):
            return rest
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.number[at].astype(U64), rest)

    def split(self, pivot: np.ndarray) -> np.ndarray:
        """Parts of each pivot; one that is not listed occurs at most as often as the last listed one."""
        if not len(self.parts):
            return np.ones(len(pivot), np.int64)
        return self.parts[np.where(pivot >= _FAR, len(self.parts) - 1, pivot.astype(np.int64) - 1)].astype(np.int64)

    def hashes(self, numbers: np.ndarray) -> np.ndarray:
        far = numbers >= _FAR
        near = self.hash_of[np.where(far, 0, numbers.astype(np.int64) - 1)] if len(self.hash_of) else numbers
        return np.where(far, numbers & _LOW63, near).astype(np.int64)


def fragments(number: np.ndarray, linked: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Seven columns for each pivot: up to three words before it, the pivot, up to three after it; 0 where the run has ended.

    ``number`` holds the words of some texts (0: not frequent), ``linked`` tells that a word follows the one before in
    its piece.  Pivots are the words at the places from ``lo`` to ``hi``; those without neighbours are left out.
    """
    m = len(number)
    out = np.zeros((m, _WIDTH), U64)
    out[:, _REACH] = number
    on = number != 0
    for d in range(1, _REACH + 1):  # before: strictly more frequent
        on[:d] = False
        on[d:] &= linked[1 : max(1, m - d + 1)] & (number[:-d] != 0) & (number[:-d] < number[d:])
        out[d:, _REACH - d] = np.where(on[d:], number[:-d], 0)
    on = number != 0
    for d in range(1, _REACH + 1):  # after: as frequent or more
        on[max(0, m - d) :] = False
        on[:-d] &= linked[d:] & (number[d:] != 0) & (number[d:] <= number[:-d])
        out[:-d, _REACH + d] = np.where(on[:-d], number[d:], 0)
    out = out[lo:hi]
    return out[(out[:, _REACH - 1] != 0) | (out[:, _REACH + 1] != 0)]


def _summed(rows: np.ndarray, n: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that are equal and neighbours in this order, put together; and where each one stood first."""
    rows, n = rows[order], n[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return rows[at], np.add.reduceat(n, at) if len(at) else n, order[at]


def _packed(rows: np.ndarray, n: np.ndarray, wide: bool) -> bytes:
    """Rows and counts by column and byte, squeezed."""
    kind = "<u8" if wide else "<u4"
    planes = [np.ascontiguousarray(c, kind).view(np.uint8).reshape(len(rows), -1).T.tobytes() for c in rows.T]
    planes.append(np.ascontiguousarray(n, "<u8").view(np.uint8).reshape(len(rows), 8).T.tobytes())
    return pa.Codec("zstd", compression_level=1).compress(b"".join(planes), asbytes=True)


def _unpacked(blob: bytes, rows: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    size, kind = (8, "<u8") if wide else (4, "<u4")
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob, rows * (_WIDTH * size + 8)), np.uint8)
    out = np.empty((rows, _WIDTH), kind)
    for k in range(_WIDTH):
        out[:, k] = np.ascontiguousarray(raw[k * size * rows : (k + 1) * size * rows].reshape(size, rows).T).view(kind)[:, 0]
    return out, np.ascontiguousarray(raw[_WIDTH * size * rows :].reshape(8, rows).T).view("<i8")[:, 0]


def _mixed(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), U64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            h += rows[:, k] * _SEEDS[k]
    return core.mix64(h)


def _sent(rows: np.ndarray, numbers: Numbers, buckets: int):
    """Fragments made distinct and packed by bucket: (bucket, wide, rows, blob)."""
    h, pivot = _mixed(rows), rows[:, _REACH]
    with np.errstate(over="ignore"):
        part = h % numbers.split(pivot).astype(U64)
        bucket = core.mix64(pivot * _SEEDS[0] + part * _SEEDS[1]) % U64(buckets)
    place = bucket * U64(2) + (pivot >= _FAR).astype(U64)
    rows, n, first = _summed(rows, np.ones(len(rows), np.int64), np.lexsort((h, place)))
    place = place[first]
    cut = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(place)).tolist()
    for a, z in zip(cut, cut[1:], strict=False):
        wide = bool(place[a] & U64(1))
        yield int(place[a] >> U64(1)), wide, z - a, _packed(rows[a:z], n[a:z], wide)


def _rewrite(sent: Broadcast, buckets: int):
    """Texts to packed fragments."""

    def run(batches):
        numbers = sent.value
        for b in batches:
            out, number, linked = [], [], []
            ended = False  # a piece ended after the last word of the part before
            for data, offs, code, seeds, _, more, last in _slices(b):
                first, _, text, h = _hashed(data, offs, seeds[code])
                breaks = np.concatenate(([0], np.cumsum(_BREAK[data])))
                link = np.zeros(len(h), bool)
                if len(h):
                    link[1:] = (text[1:] == text[:-1]) & (breaks[first[1:]] == breaks[first[:-1]])
                    link[0] = more and not ended and breaks[first[0]] == 0
                    ended = bool(breaks[-1] > breaks[first[-1]])
                else:
                    ended = more and ended or bool(breaks[-1])
                number.append(numbers.of(h))
                linked.append(link)
                if not last:
                    continue
                number, linked = np.concatenate(number), np.concatenate(linked)
                for at in range(0, len(number), RUN):  # a run of words, with three more on either side
                    a = max(0, at - _REACH)
                    z = min(len(number), at + RUN + _REACH)
                    rows = fragments(number[a:z], linked[a:z], at - a, min(at + RUN, len(number)) - a)
                    if len(rows):
                        out += _sent(rows, numbers, buckets)
                number, linked, ended = [], [], False
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["bucket", "wide", "rows", "blob"])

    return run


def _order(rows: np.ndarray) -> np.ndarray:
    """An order in which equal rows are neighbours."""
    if rows.dtype.itemsize == 8:
        return np.lexsort(rows.T)
    key = np.zeros(len(rows), U64)
    for k in range(min(3, rows.shape[1])):
        key = key << U64(20) | rows[:, k].astype(U64)
    return np.argsort(key) if rows.shape[1] < 4 else np.lexsort((*rows[:, 3:].T, key))


def count_phrases(rows: np.ndarray, n: np.ndarray):
    """For each length, the phrases of these fragments that hold the pivot, and how often they occur."""
    for size in range(2, LONGEST + 1):
        parts, counts = [], []
        for before in range(size):
            lo, hi = _REACH - before, _REACH - before + size
            has = (rows[:, lo] != 0) & (rows[:, hi - 1] != 0)
            parts.append(rows[has, lo:hi])
            counts.append(n[has])
        parts, counts = np.concatenate(parts), np.concatenate(counts)
        yield _summed(parts, counts, _order(parts))[:2]


def _mine(sent: Broadcast, least: int):
    """Packed fragments to phrases: those of pivots that are not split are whole, and kept where they are frequent."""

    def run(batches):
        numbers = sent.value
        held: dict[bool, tuple[list, list]] = {False: ([], []), True: ([], [])}
        size, bound = 0, PENDING
        for b in batches:
            for wide, rows, blob in zip(*(b.column(c).to_pylist() for c in ("wide", "rows", "blob")), strict=True):
                got, n = _unpacked(blob, rows, wide)
                held[wide][0].append(got)
                held[wide][1].append(n)
                size += rows
                if size > bound:
                    for rs, ns in held.values():
                        if rs:
                            r, n, _ = _summed(np.concatenate(rs), np.concatenate(ns), _order(np.concatenate(rs)))
                            rs[:], ns[:] = [r], [n]
                    size = sum(len(x) for rs, _ in held.values() for x in rs)
                    bound = max(PENDING, 2 * size)
        for rs, ns in held.values():
            if not rs:
                continue
            rows, n = np.concatenate(rs), np.concatenate(ns)
            rs.clear()
            ns.clear()
            for grams, f in count_phrases(rows, n):
                whole = numbers.split(grams.max(axis=1)) == 1 if len(grams) else np.zeros(0, bool)
                keep = ~whole | (f >= least)
                grams, f, whole = grams[keep], f[keep], whole[keep]
                flat = numbers.hashes(grams.ravel())
                for a in range(0, len(f), 10_000):
                    z = min(a + 10_000, len(f))
                    width = grams.shape[1]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (z - a + 1) * width, width, dtype=np.int32)), pa.array(flat[a * width : z * width], pa.int64()))
                    yield pa.RecordBatch.from_arrays([lists, pa.array(f[a:z], pa.int64()), pa.array(whole[a:z])], ["gram", "a", "whole"])

    return run


def _listed(words: DataFrame) -> Numbers:
    """The most frequent words' numbers; what reaches the driver is bounded by LISTED rows."""
    narrow = words.select("h", "n")
    top = core.most_frequent(narrow, LISTED, "h")
    got = top.toArrow()
    return Numbers(got.column("h").to_numpy(), got.column("n").to_numpy(), complete=top is narrow)


def candidates(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Phrases of 2 to 4 words with at least ``least`` occurrences, and the number of words of each language.

    The first table holds lang, gram (the words' hashes), words, f (occurrences of each word) and a (of the phrase).
    """
    spark = docs.sparkSession
    core.prepare(spark)
    texts = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counted = texts.mapInArrow(core.tidy(_count_words), "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))
    counted = core.keep(counted.filter(F.col("word").isNull() | (F.col("n") >= least)), "words")
    words, totals = counted.filter("word is not null"), counted.filter("word is null").select("lang", "n")
    sent = core.send(spark, _listed(words))
    total = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = max(core.tasks(spark), -(-total // BUCKET_WORDS))
    packed = texts.mapInArrow(core.tidy(_rewrite(sent, buckets)), "bucket int, wide boolean, rows long, blob binary")
    mined = core.keep(packed.repartitionById(buckets, F.col("bucket")).mapInArrow(core.tidy(_mine(sent, least)), "gram array<long>, a long, whole boolean"), "mined")
    summed = mined.filter(~F.col("whole")).groupBy("gram").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    grams = mined.filter("whole").select("gram", "a").unionByName(summed)
    each = grams.select("gram", "a", F.posexplode("gram").alias("at", "h")).join(words.select("h", "lang", "word", F.col("n").alias("f")), "h")
    found = each.groupBy("gram").agg(F.first("a").alias("a"), F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word", "f"))).alias("w"))
    return core.keep(found.select("lang", "gram", F.col("w")["word"].alias("words"), F.col("w")["f"].alias("f"), "a"), "phrases"), totals


def _inner(gram):
    """All shorter runs of at least two words of a phrase, with their place."""
    size = F.size(gram)
    runs = F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(0), size - n), lambda at: F.struct(n.alias("n"), at.alias("at"), F.slice(gram, at + 1, n).alias("run"))))
    return F.explode(F.flatten(runs))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is that of its weakest cut, ``floor(2000000 * a / (l + r))``; of equal ones the first counts.  A
    phrase goes where a longer one around it has at least 80 % of its occurrences.  Order: score and a descending,
    phrase by its UTF-8 bytes.
    """
    spark = docs.sparkSession
    found, totals = candidates(docs, text, lang, least)
    inner = found.filter(F.size("gram") > 2).select("gram", "a", _inner(F.col("gram")).alias("i")).select("gram", F.col("a").alias("longer"), "i.*")
    counts = found.select(F.col("gram").alias("run"), F.col("a").alias("of"))
    known = inner.join(counts, "run").groupBy("gram").agg(*(F.max(F.when((F.col("n") == n) & (F.col("at") == at), F.col("of"))).alias(f"f{n}{at}") for n, at in ((2, 0), (2, 1), (2, 2), (3, 0), (3, 1))))
    around = inner.groupBy("run").agg(F.max("longer").alias("around")).withColumnRenamed("run", "gram")
    full = found.join(around, "gram", "left").filter(F.col("around").isNull() | (_wide(F.col("around")) * 100 < _wide(F.col("a")) * 80)).join(known, "gram", "left")
    f, size = F.col("f"), F.size("gram")
    first, last = f[0], F.element_at(f, -1)

    def cut(k, left, right):
        return F.struct(_div(_wide(F.col("a")) * 2000000, _wide(left) + _wide(right)).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    pair = cut(1, first, last)
    three = F.least(cut(1, first, F.col("f21")), cut(2, F.col("f20"), last))
    four = F.least(cut(1, first, F.col("f31")), cut(2, F.col("f20"), F.col("f22")), cut(3, F.col("f30"), last))
    best = F.when(size == 2, pair).when(size == 3, three).otherwise(four)
    scored = full.select("lang", F.array_join("words", " ").alias("phrase"), "a", best.alias("cut"), F.pmod(F.xxhash64("gram"), F.lit(core.tasks(spark))).alias("part"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "part")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = scored.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _wide(x):
    return x.cast("decimal(19,0)")


def _div(a, b):
    """The whole part of a quotient of decimals that are not negative, exactly."""
    return F.call_function("div", a, b)
