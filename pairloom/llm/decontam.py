"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores, for segments of SEGMENT bytes of text each, the postings of all their tokens: sorted term
hashes, their counts, and the positions of each term, which run through the segment's documents.  It does not
depend on the benchmark and is stored once, whatever is looked up in it.  ``search`` sums the frequencies of
the benchmark's terms over all segments, then looks every benchmark window up in every segment: the positions
of its rarest term, less that term's offset, are candidate starts; the offset-adjusted lists of the other
terms are intersected with them in order of rarity.  What is left are exact phrases.  With ``slack`` it also
counts proximity matches: windows all of whose terms stand, in any order, within the window's place and
``slack`` words on both sides of it, for some occurrence of the rarest term.

Benchmark texts are sent to all tasks in blocks of about BLOCK_WORDS words (more items: more blocks, each
looked up in the stored index), so no broadcast grows with the benchmark.  The blocks' results are put together
by the documents' places in the index.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core
from .core import U64

WINDOW, SEGMENT = 10, 1 << 18
BLOCK_WORDS = 2_000_000


class Phrases:
    """Distinct windows of some benchmark items, as rows of term numbers (-1 beyond a shorter window)."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        ids = [i for i, _ in items]
        column = pa.array([t for _, t in items], pa.string())
        owner, spans, words = [], [], []
        base = 0
        for at, _, data, offs in core.text_slices(column, core.WORK_BYTES):
            w, rows = core.word_hashes(data, offs, core.ALNUM_BYTES)
            words.append(w)
            for r in range(len(rows) - 1):
                a, b = int(rows[r]), int(rows[r + 1])
                for s in range(a, max(a + (b > a), b - window + 1)):
                    owner.append(at + r)
                    spans.append((base + s, min(window, b - a)))
            base += len(w)
        w = np.concatenate(words) if words else np.zeros(0, U64)
        self.terms, number = np.unique(w, return_inverse=True)
        table = np.full((len(spans), window), -1, np.int64)
        for i, (s, m) in enumerate(spans):
            table[i, :m] = number[s : s + m]
        self.windows, which = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, np.int64))
        pairs = np.unique(np.stack([which.ravel(), np.array(owner, np.int64)], 1), axis=0) if len(table) else np.zeros((0, 2), np.int64)
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.owner = pairs[:, 1]
        self.ids = ids
        with np.errstate(over="ignore"):  # a name of each window, the same in every block
            w = np.where(self.windows >= 0, self.terms[self.windows] if len(self.terms) else U64(0), U64(0))
            self.names = core.signed(core.mix64((w * core._stream(17, window)).sum(1, dtype=U64))).tolist()

    def postings(self, terms: np.ndarray, counts: np.ndarray, where: np.ndarray):
        """A segment's postings of the terms of these phrases: (term number, count), and positions in that order."""
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1) if len(terms) else np.zeros(0, np.int64)
        own = np.flatnonzero(terms[at] == self.terms) if len(terms) else at
        begin = np.cumsum(counts) - counts
        n = counts[at[own]] if len(own) else np.zeros(0, np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat((begin[at[own]] if len(own) else n) - (ends - n), n) + np.arange(total)
        return own, n, where[take]


_SEGMENT = "segment long, keys array<{kind}>, starts binary, terms binary, counts binary, positions binary"


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments of the index: (segment, keys, starts, terms, counts, positions)."""
    core.prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            out = []
            for at, end, data, offs in core.text_slices(b.column("text"), SEGMENT):
                w, rows = core.word_hashes(data, offs, core.ALNUM_BYTES)
                where = np.argsort(w, kind="stable")
                terms, counts = np.unique(w, return_counts=True)
                out.append((number, b.column("key").slice(at, end - at).to_pylist(), rows.astype(np.int64).tobytes(), terms.tobytes(), squeeze.compress(counts.astype("<u4").tobytes()), squeeze.compress(where.astype("<u4").tobytes())))
                number += 1
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.list_(b.column("key").type), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["segment", "keys", "starts", "terms", "counts", "positions"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(core.tidy(run), _SEGMENT.format(kind=kind))


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u4").astype(np.int64)


def frequencies(index: DataFrame, phrases, n: int) -> np.ndarray:
    """Occurrences of each of the n terms of ``phrases`` (a broadcast :class:`Phrases`) over all segments."""

    def run(batches):
        p = phrases.value
        total = np.zeros(n, np.int64)
        for b in batches:
            for t, c in zip(b.column("terms").to_pylist(), b.column("counts").to_pylist(), strict=True):
                t = np.frombuffer(t, U64)
                if len(t):
                    at = np.minimum(np.searchsorted(t, p.terms), len(t) - 1)
                    total += np.where(t[at] == p.terms, _unpacked(c)[at], 0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["term", "n"])

    out = np.zeros(n, np.int64)
    for r in index.select("terms", "counts").mapInArrow(core.tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r[0]] = r[1]
    return out


def _candidates(p: Phrases, frequency: np.ndarray, terms: np.ndarray, counts: np.ndarray, where: np.ndarray):
    """(window, start) for all occurrences of each window's rarest term, and the windows' offsets by rarity."""
    first = np.zeros(len(p.terms) + 1, np.int64)
    first[terms + 1] = counts
    first = np.cumsum(first)
    rarity = np.argsort(np.where(p.windows >= 0, frequency[p.windows], np.iinfo(np.int64).max), axis=1, kind="stable")
    rarest = np.take_along_axis(p.windows, rarity[:, :1], 1)[:, 0]
    have = first[rarest + 1] - first[rarest]
    window = np.repeat(np.arange(len(rarest)), have)
    ends = np.cumsum(have)
    at = where[np.repeat(first[rarest] - (ends - have), have) + np.arange(ends[-1] if len(ends) else 0)]
    return window, at - rarity[window, 0], rarity


_FOUND = "segment long, row int, key {kind}, n_words long, n_hit long, items array<string>, spans array<long>, near array<long>"


def _search(phrases, frequency, slack: int, block: int):
    def run(batches):
        p, f = phrases.value, frequency.value
        size = p.windows.shape[1]
        length = (p.windows >= 0).sum(1)
        for b in batches:
            out = []
            for segment, keys, starts, terms, counts, positions in zip(*(b.column(c).to_pylist() for c in ("segment", "keys", "starts", "terms", "counts", "positions")), strict=True):
                rows = np.frombuffer(starts, np.int64)
                terms, counts, where = p.postings(np.frombuffer(terms, U64), _unpacked(counts), _unpacked(positions))
                held = np.full(rows[-1] + size + 2 * slack, -1, np.int32)  # the postings by position
                held[where] = np.repeat(terms, counts)
                window, start, rarity = _candidates(p, f, terms, counts, where)
                row = np.searchsorted(rows, start + rarity[window, 0], "right") - 1
                near = _near(p, window, start, row, held, rows, length, slack) if slack else np.zeros((0, 2), np.int64)
                ok = (start >= rows[row]) & (start + length[window] <= rows[row + 1])
                window, start, row = window[ok], start[ok], row[ok]
                for k in range(1, size):
                    term = p.windows[window, rarity[window, k]]
                    ok = (term < 0) | (held[start + np.where(term < 0, 0, rarity[window, k])] == term)
                    window, start, row = window[ok], start[ok], row[ok]
                cover = np.zeros(rows[-1] + size + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + length[window], -1)
                hit = np.concatenate(([0], np.cumsum(np.cumsum(cover[: rows[-1]]) > 0)))
                n_hit = hit[rows[1:]] - hit[rows[:-1]]
                items: dict[int, set] = {}
                for r, w in np.unique(np.stack([row, window], 1), axis=0).tolist() if len(row) else []:
                    items.setdefault(r, set()).update(p.owner[p.first[w] : p.first[w + 1]].tolist())
                spans: dict[int, list] = {}
                for r, s, e in zip(row.tolist(), start.tolist(), (start + length[window]).tolist(), strict=True):
                    spans.setdefault(r, []).append((s - int(rows[r]), e - int(rows[r])))
                close: dict[int, list] = {}
                for r, w in near.tolist():
                    close.setdefault(r, []).append(p.names[w])
                for i, k in enumerate(keys):
                    if not block or i in items or i in close:  # later blocks give only what they find
                        names = sorted({str(p.ids[o]) for o in items.get(i, ())})
                        out.append((segment, i, k, int(rows[i + 1] - rows[i]), int(n_hit[i]), names, _merged(spans.get(i, [])), close.get(i, [])))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            types = [pa.int64(), pa.int32(), b.column("keys").type.value_type, pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["segment", "row", "key", "n_words", "n_hit", "items", "spans", "near"])

    return run


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """Flat starts and ends of the union of spans."""
    out: list[int] = []
    for s, e in sorted(set(spans)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _near(p, window, start, row, held, rows, length, slack: int) -> np.ndarray:
    """Distinct (row, window) all of whose terms stand within its place and ``slack`` words beside it."""
    low = np.maximum(rows[row], start - slack)
    high = np.minimum(rows[row + 1], start + length[window] + slack)
    ok = np.ones(len(window), bool)
    reach = np.arange(p.windows.shape[1] + 2 * slack)
    for a in range(0, len(window), 50_000):
        part = slice(a, a + 50_000)
        at = low[part, None] + reach
        there = np.where(at < high[part, None], held[np.minimum(at, len(held) - 1)], -2)
        for k in range(p.windows.shape[1]):
            term = p.windows[window[part], k]
            ok[part] &= (term < 0) | (there == term[:, None]).any(1)
    return np.unique(np.stack([row[ok], window[ok]], 1), axis=0)


def search(index: DataFrame, benchmark: DataFrame, item: str = "item_id", item_text: str = "text", window: int = WINDOW, slack: int = 0) -> DataFrame:
    """(segment, row, key, n_words, n_hit, items, spans, n_near) of every document of a stored index."""
    spark = index.sparkSession
    core.prepare(spark)
    kind = index.schema["keys"].dataType.elementType.simpleString()
    texts = core.keep(benchmark.select(F.col(item).alias("i"), F.col(item_text).alias("t")).distinct(), "items")
    words = texts.agg(F.sum(F.length("t") / 2)).first()[0] or 0
    blocks = max(1, math.ceil(words / BLOCK_WORDS))
    found = []
    for k in range(blocks):
        own = texts.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else texts
        p = Phrases([(r[0], r[1]) for r in own.orderBy("i", "t").collect()], window)
        shared = core.send(spark, p)
        f = core.send(spark, frequencies(index, shared, len(p.terms)))
        one = index.mapInArrow(core.tidy(_search(shared, f, slack, k)), _FOUND.format(kind=kind))
        found.append(core.keep(one, "block") if blocks > 1 else one)
    columns = ["segment", "row", "key", "n_words", "n_hit", "items", "spans"]
    if blocks == 1:
        return found[0].select(*columns, F.size("near").cast("long").alias("n_near"))
    every = reduce(DataFrame.union, found).groupBy("segment", "row", "key", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.collect_list("spans").alias("all"), F.size(F.array_distinct(F.flatten(F.collect_list("near")))).cast("long").alias("n_near")
    )
    pairs = "array_sort(flatten(transform(filter(all, s -> size(s) > 0), s -> transform(sequence(0, size(s) - 1, 2), i -> struct(s[i] as a, s[i + 1] as b)))))"
    merged = f"aggregate({pairs}, cast(array() as array<bigint>), (o, x) -> if(size(o) > 0 and x.a <= o[size(o) - 1], concat(slice(o, 1, size(o) - 1), array(greatest(o[size(o) - 1], x.b))), concat(o, array(x.a, x.b))))"
    every = every.withColumn("spans", F.expr(merged))
    return every.withColumn("n_hit", F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (s, x) -> s + x)")).select(*columns, "n_near")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, slack: int = 0) -> DataFrame:
    """Per row of ``docs``: key, n_words, n_hit, items (ids as sorted strings), spans (word ranges), n_near.

    A word is hit inside any occurrence of a window of ``window`` consecutive item words (an item of fewer
    is one window).  ``n_near`` counts the distinct windows with a proximity match (exact ones are some of
    them; 0 without ``slack``); of terms equally frequent the first in the window is the rarest.  Null or
    wordless texts have no words; null or wordless items no windows; repeated items and equal ids count once.
    Repeated rows and null keys of ``docs`` each get a row of their own.
    """
    index = core.keep(build_index(docs, key, text), "index", packed=True)
    return search(index, benchmark, item, item_text, window, slack).drop("segment", "row").withColumnRenamed("key", key)


def clean_rows(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark passage stands.

    A row goes by its key and text, so others that share its key, null ones too, stay if they are clean.
    """
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    named = texts.select(F.struct("key", F.sha2("text", 256).alias("digest")).alias("name"), "text")
    bad = decontaminate(named, benchmark, "name", "text", **options).filter("n_hit > 0").select(F.col("name.key").alias("bad_key"), F.col("name.digest").alias("bad_digest")).distinct()
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    k, t = (f"c{docs.columns.index(x)}" for x in (key, text))
    return inner.join(bad, F.col(k).eqNullSafe(F.col("bad_key")) & (F.sha2(F.col(t), 256) == F.col("bad_digest")), "left_anti").toDF(*docs.columns)
