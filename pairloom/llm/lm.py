"""Language-model scoring with a log-frequency Bloom filter.

Counting: words and pairs of neighbouring words are 64-bit hashes; each training task sums its own counts,
then one exchange of packed lists brings every n-gram to its part, a range of hashes.  A part holds the exact
counts of its words and a filter of all its n-grams with quantised counts: a count c is level
``1 + floor(log_BASE(c))`` and the items (n-gram, 1) ... (n-gram, level) are members.  A count is read back by
probing level after level until one is missing.  The filter has ITEM_BITS bits for each item, so it grows with
the corpus: there are more parts, not larger ones.

Scoring: a filter that grows cannot be sent whole to all workers.  Each slice of texts asks every part for its
distinct n-grams in one packed list, the worker that has the part probes it, and the levels come back in the
order in which they were asked.

Model: P(w | h) is ``0.5 c(h w) / c(h) + 0.5 u(w)`` after a word h that the filter holds, else u(w), with
``u(w) = (c(w) + 1) / (N + V + 1)`` and counts read from the filter.  The base score reads the exact counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import core
from .core import U64

ITEM_BITS, PROBES, BASE = 16, 4, 1.5
#: Bytes of text of a slice, and of training text for each part of the model.
SLICE_TEXT, PART_TEXT = 4 << 20, 16 << 20
#: Entries that a counting task holds before it gives them out.
HELD = 2_000_000
LEVELS = 64


class LogFrequencyFilter:
    """Bloom filter of (n-gram, level)."""

    def __init__(self, bits: int, field: np.ndarray | None = None):
        self.bits = bits
        self.field = np.zeros(-(-bits // 8), np.uint8) if field is None else field

    def _places(self, grams: np.ndarray, level: int) -> Iterator[np.ndarray]:
        h = core.mix64(grams ^ U64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        g = (h >> U64(32)) | U64(1)
        for k in range(PROBES):
            yield ((h + U64(k) * g) % U64(self.bits)).astype(np.int64)

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        level = levels_of(counts)
        flags = np.unpackbits(self.field, bitorder="little").astype(bool)
        for j in range(1, int(level.max(initial=0)) + 1):
            for p in self._places(grams[level >= j], j):
                flags[p] = True
        self.field = np.packbits(flags, bitorder="little")

    def level(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams), np.uint8)
        left = np.arange(len(grams))
        for j in range(1, LEVELS):
            left = self._held(grams, left, j)
            if not len(left):
                break
            out[left] = j
        return out

    def _held(self, grams: np.ndarray, left: np.ndarray, level: int) -> np.ndarray:
        ok = np.ones(len(left), bool)
        for p in self._places(grams[left], level):
            ok &= (self.field[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        return left[ok]

    def count(self, grams: np.ndarray) -> np.ndarray:
        """Estimated counts: the middle of the level's range, 0 for no member."""
        return ESTIMATE[self.level(grams)]


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


ESTIMATE = np.array([0.0, 1.0, *(BASE ** (j - 1) * (1 + BASE) / 2 for j in range(2, LEVELS + 1))])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return core.mix64(a * core._STEP + b + U64(77))


def _followers(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Indices of the words that have a word before them in their row."""
    after = np.ones(len(w), bool)
    after[rows[:-1][rows[:-1] < len(w)]] = False
    return np.flatnonzero(after)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_TEXT bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= SLICE_TEXT:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size or any(b.num_rows for b in held):
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()[:1]


def _cuts(sorted_hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's range begins in sorted hashes (one more entry than parts)."""
    part = ((sorted_hashes >> U64(32)) * U64(parts)) >> U64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=U64))


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h = np.concatenate([np.zeros(0, U64), *(x for x, _ in held)])
    c = np.concatenate([np.zeros(0, np.int64), *(x for _, x in held)])
    u, back = np.unique(h, return_inverse=True)
    return u, np.bincount(back, weights=c, minlength=len(u)).astype(np.int64)


_COUNTED = "part int, words binary, times binary, pairs binary, pair_times binary"


def _counts(parts: int):
    def run(batches):
        words: list[tuple[np.ndarray, np.ndarray]] = []
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out():
            (w, c), (p, q) = _merged(words), _merged(pairs)
            at, to = _cuts(w, parts), _cuts(p, parts)
            some = [k for k in range(parts) if at[k] < at[k + 1] or to[k] < to[k + 1]]
            blob = lambda x, cut, kind: pa.array([x[cut[k] : cut[k + 1]].astype(kind).tobytes() for k in some], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), blob(w, at, U64), blob(c, at, "<u4"), blob(p, to, U64), blob(q, to, "<u4")], ["part", "words", "times", "pairs", "pair_times"])

        for b in _runs(batches):
            for _, _, data, offs in core.text_slices(b.column("text"), SLICE_TEXT):
                w, rows = core.word_hashes(data, offs)
                q = _followers(w, rows)
                words.append(np.unique(w, return_counts=True))
                pairs.append(np.unique(_pair(w[q - 1], w[q]), return_counts=True))
                size += len(words[-1][0]) + len(pairs[-1][0])
                if size >= HELD:
                    yield out()
                    words, pairs, size = [], [], 0
        if size:
            yield out()

    return run


def _read(b: pa.RecordBatch, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) if x.is_valid and len(x.as_buffer()) else np.zeros(0, kind) for x in b.column(name)]


_PART = "part int, tokens long, words binary, counts binary, bits long, field binary"


def _part(batches):
    """Sums the lists of one part and builds its filter."""
    now, words, pairs = None, [], []

    def done():
        (w, c), (p, q) = _merged(words), _merged(pairs)
        items = int(levels_of(c).sum() + levels_of(q).sum())
        made = LogFrequencyFilter(max(64, -(-items * ITEM_BITS // 8) * 8))
        made.add(np.concatenate([w, p]), np.concatenate([c, q]))
        row = [[now], [int(c.sum())], [w.tobytes()], [c.astype("<i8").tobytes()], [made.bits], [made.field.tobytes()]]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["part", "tokens", "words", "counts", "bits", "field"])

    for b in batches:
        rows = zip(b.column("part").to_pylist(), _read(b, "words", U64), _read(b, "times", "<u4"), _read(b, "pairs", U64), _read(b, "pair_times", "<u4"), strict=True)
        for part, w, c, p, q in rows:
            if part != now:
                if now is not None:
                    yield done()
                now, words, pairs = part, [], []
            words.append((w, c.astype(np.int64)))
            pairs.append((p, q.astype(np.int64)))
    if now is not None:
        yield done()


@dataclass(frozen=True)
class Model:
    """What is known of the training texts as a whole; their counts are in the table of parts."""

    parts: int
    tokens: int
    distinct: int
    texts: int


def train(docs: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The model and the table of its parts (exact counts of words, filter of all n-grams).

    Every row counts, repeated ones each time; a null text is its end alone.  Counts are sums, so nothing
    depends on the order of rows or of equal counts.  An empty table gives a model without parts' rows.
    """
    spark = docs.sparkSession
    core.prepare(spark)
    texts, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    parts = max(core.tasks(spark), -(-size // PART_TEXT))
    counted = docs.select(F.col(text).alias("text")).mapInArrow(core.tidy(_counts(parts)), _COUNTED)
    table = core.keep(counted.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(core.tidy(_part), _PART), "parts", packed=True)
    tokens, distinct = table.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum(F.octet_length("words") / 8), F.lit(0))).first()
    return Model(parts, int(tokens) + texts, int(distinct) + (texts > 0), texts), table


def _asked(data: np.ndarray, offs: np.ndarray):
    """Words and pairs of a slice: all, and the distinct ones in order."""
    w, rows = core.word_hashes(data, offs)
    q = _followers(w, rows)
    u, back = np.unique(w, return_inverse=True)
    p, pback = np.unique(_pair(w[q - 1], w[q]), return_inverse=True)
    return rows, u, back, p, pback, q


_ASKED = "part int, slice long, words binary, pairs binary"


def _numbered(batches):
    """(number, rows, bytes, offsets) of the slices of a task; equal slices have one number, a hash of their texts."""
    for b in _runs(batches):
        for at, end, data, offs in core.text_slices(b.column("text"), SLICE_TEXT):
            number = xxhash.xxh3_64_intdigest(np.ascontiguousarray(data), xxhash.xxh3_64_intdigest(offs.tobytes()))
            yield number - (1 << 63), b.slice(at, end - at), data, offs


def _ask(parts: int):
    def run(batches):
        for number, _, data, offs in _numbered(batches):
            _, u, _, p, _, _ = _asked(data, offs)
            at, to = _cuts(u, parts), _cuts(p, parts)
            some = [k for k in range(parts) if at[k] < at[k + 1] or to[k] < to[k + 1]]
            blob = lambda x, cut, some=some: pa.array([x[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([number] * len(some), pa.int64()), blob(u, at), blob(p, to)], ["part", "slice", "words", "pairs"])

    return run


_FOUND = "slice long, part int, counts binary, levels binary, pair_levels binary"


def _answer(batches):
    """Exact counts and levels for the lists that a part is asked; the part's own row comes before them."""
    now, have, exact, made = None, np.zeros(0, U64), np.zeros(0, np.int64), None
    squeeze = zstandard.ZstdCompressor(level=1)
    for b in batches:
        out = []
        rows = zip(b.column("part").to_pylist(), b.column("slice").to_pylist(), _read(b, "words", U64), _read(b, "pairs", U64), _read(b, "counts", "<i8"), b.column("bits").to_pylist(), _read(b, "field", np.uint8), strict=True)
        for part, number, words, pairs, counts, bits, field in rows:
            if number is None:
                now, have, exact, made = part, words, counts, LogFrequencyFilter(bits, field)
                continue
            if part != now:
                now, have, exact, made = part, np.zeros(0, U64), np.zeros(0, np.int64), LogFrequencyFilter(64)
            c = np.zeros(len(words), np.int64)
            if len(have):
                at = np.minimum(np.searchsorted(have, words), len(have) - 1)
                c = np.where(have[at] == words, exact[at], 0)
            out.append((number, part, *(squeeze.compress(x.tobytes()) for x in (c, made.level(words), made.level(pairs)))))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], ["slice", "part", "counts", "levels", "pair_levels"])


def _texts(batches):
    """The slices themselves, squeezed: (slice, keys and learned as an Arrow stream, texts)."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for number, b, _, _ in _numbered(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema) as w:
            w.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([squeeze.compress(sink.getvalue().to_pybytes())], pa.binary())], ["slice", "body"])


def _scores(model: Model, names: list[str]):
    total = model.tokens + model.distinct + 1.0
    end = float(ESTIMATE[levels_of(np.array([model.texts]))][0]) if model.texts else 0.0

    def rows(b, found):
        learned = pc.fill_null(b.column("learned"), False).to_numpy(zero_copy_only=False)
        ((_, _, data, offs),) = core.text_slices(b.column("text"), 1 << 62)
        w_rows, u, back, p, pback, q = _asked(data, offs)
        get = lambda k, kind: np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(found[part][k]) for part in sorted(found)), kind)
        exact, level, pair_level = get(0, "<i8"), get(1, np.uint8), get(2, np.uint8)
        if len(exact) != len(u) or len(level) != len(u) or len(pair_level) != len(p):
            raise ValueError("the documents gave other rows, or another order, when they were read again; store them first")
        n = len(w_rows) - 1
        guess, joint = ESTIMATE[level], ESTIMATE[pair_level]
        prob = ((guess + 1) / total)[back]
        before, both = guess[back[q - 1]], joint[pback]
        ok = before > 0
        prob[q[ok]] = 0.5 * both[ok] / np.maximum(before[ok], both[ok]) + 0.5 * prob[q[ok]]
        sums = lambda x, r=w_rows: (lambda t: t[r[1:]] - t[r[:-1]])(np.concatenate(([0], np.cumsum(x))))
        c = exact[back]
        size = np.diff(w_rows) + 1
        known = sums(c > 0).astype(np.int64) + (model.texts > 0)
        base = sums(np.log10(c + 1.0)) + math.log10(model.texts + 1) - size * math.log10(total)
        score = sums(np.log10(prob)) + math.log10((end + 1) / total)
        # pairs that training texts hold besides the text's own occurrences
        owner = np.repeat(np.arange(n), np.diff(w_rows))[q]
        order = np.lexsort((pback, owner))
        o, k = owner[order], pback[order]
        new = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (k[1:] != k[:-1])))) if len(o) else np.zeros(0, np.int64)
        own = np.diff(np.append(new, len(o)))
        other = joint[k[new]] - np.where(learned[o[new]], own, 0) >= 0.5
        pairs = np.bincount(o[new], minlength=n)
        share = np.bincount(o[new], weights=other, minlength=n) / np.maximum(1, pairs)
        made = [b.column("key"), *(pa.array(x) for x in (size, known, np.full(n, model.tokens, np.int64), base, score, share))]
        return pa.RecordBatch.from_arrays(made, names)

    def run(batches):
        now, found = None, {}
        for b in batches:
            for number, body, part, *lists in zip(*(b.column(x).to_pylist() for x in ("slice", "body", "part", "counts", "levels", "pair_levels")), strict=True):
                if number != now:
                    now, found = number, {}
                if body is None:
                    found[part] = lists
                else:
                    for own in pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)):
                        yield rows(own, found)

    return run


def score(docs: DataFrame, model: Model, parts: DataFrame, key: str = "doc_id", text: str = "text", learned: Column | None = None) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score, seen_elsewhere) per row of ``docs``.

    ``seen_elsewhere`` is the share of the text's distinct pairs of neighbouring words that the training texts
    hold, without the text's own occurrences where ``learned`` says that it is one of them (0 without pairs).
    A null text is its end token alone; repeated rows each have a row; a model of no texts knows nothing.
    ``docs`` is read twice and must give the same rows in the same order, as a stored table does (else an error).
    """
    spark = docs.sparkSession
    core.prepare(spark)
    kind = docs.schema[key].dataType.simpleString()
    inner = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.lit(False) if learned is None else learned).alias("learned"))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    asked = inner.mapInArrow(core.tidy(_ask(model.parts)), _ASKED).select("part", "slice", "words", "pairs", none("counts", "binary"), none("bits", "long"), none("field", "binary"))
    own = parts.select("part", none("slice", "long"), "words", none("pairs", "binary"), "counts", "bits", "field")
    both = own.union(asked).repartitionById(model.parts, "part").sortWithinPartitions("part", F.col("slice").asc_nulls_first())
    found = both.mapInArrow(core.tidy(_answer), _FOUND).select("slice", none("body", "binary"), "part", "counts", "levels", "pair_levels")
    texts = inner.mapInArrow(core.tidy(_texts), "slice long, body binary").select("slice", "body", none("part", "int"), none("counts", "binary"), none("levels", "binary"), none("pair_levels", "binary"))
    back = texts.union(found).repartition("slice").sortWithinPartitions("slice", F.col("part").asc_nulls_last())
    names = [key, "n_tokens", "n_known", "train_tokens", "base_score", "score", "seen_elsewhere"]
    return back.mapInArrow(core.tidy(_scores(model, names)), f"`{key}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, seen_elsewhere double")
