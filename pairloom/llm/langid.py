"""Language identification by language-bitmask n-gram filters.

Training counts the byte 4-grams of lower-cased labelled texts.  A language holds an n-gram if its rate
there is at least RATIO of the highest rate in any language.  The filter is a bit-sliced Bloom filter:
an array of 64-bit words, one bit per language (a further array for each further 64 languages); AND-ing
the words at an n-gram's PROBES places returns every language that holds it (false positives apart).  It has
SLOTS slots for each n-gram learned.  Training texts are a bounded sample, and so are their n-grams.  For a text each language's hits are counted, and
corrected by that language's false-positive rate, which follows from its share of set bits:
``(hits - n * fp) / (1 - fp)``.  The language with most corrected hits wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core
from .core import U64

RATIO, LEAST, PROBES = 0.5, 5, 3
#: Labelled rows a language is learned from, at most (those with the smallest hash of their key).
SAMPLE = 3000
#: Slots of the filter for each n-gram.
SLOTS = 8
UNKNOWN = "und"


def _grams(column: pa.Array):
    """(first row, row starts among the grams, grams as uint32) by slices; grams do not cross rows."""
    for at, _, data, offs in core.text_slices(pc.utf8_lower(pc.fill_null(column, "")), core.WORK_BYTES):
        n = len(data)
        if n < 4:
            yield at, np.zeros(len(offs), np.int64), np.zeros(0, np.uint32)
            continue
        d = np.where(core.SPACE[data], 32, data).astype(np.uint32)
        g = d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)
        inside = np.zeros(n, bool)
        inside[: n - 3] = True
        for k in (1, 2, 3):
            e = offs[1:-1] - k
            inside[e[e >= 0]] = False
        inside &= np.arange(n) < n - 3
        before = np.concatenate(([0], np.cumsum(inside)))
        yield at, before[offs], g[inside[: n - 3]]


def _places(grams: np.ndarray, slots: int) -> list[np.ndarray]:
    h = core.mix64(grams.astype(U64) + U64(0x51ED270B))
    g = core.mix64(h) | U64(1)
    return [((h + U64(k) * g) & U64(slots - 1)).astype(np.int64) for k in range(PROBES)]


class Filter:
    """The learned filter: sorted languages, slots and each language's false-positive rate."""

    def __init__(self, languages: list[str], grams: np.ndarray, holder: np.ndarray):
        """``holder`` gives the number of the language that holds the n-gram beside it."""
        self.languages = languages
        self.size = 1 << max(10, (SLOTS * len(np.unique(grams)) - 1).bit_length())
        self.slots = np.zeros((-(-len(languages) // 64), self.size), U64)
        for p in _places(grams, self.size):
            np.bitwise_or.at(self.slots, (holder >> 6, p), U64(1) << (holder & 63).astype(U64))
        self.fp = np.array([float((self._bits(self.slots[k >> 6], k)).mean()) ** PROBES for k in range(len(languages))])

    @staticmethod
    def _bits(masks: np.ndarray, k: int) -> np.ndarray:
        return masks >> U64(k & 63) & U64(1)

    def hits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each row, and its hits by language."""
        n = np.zeros(len(column), np.int64)
        out = np.zeros((len(column), len(self.languages)), np.int64)
        for at, rows, grams in _grams(column):
            z = len(rows) - 1
            n[at : at + z] = np.diff(rows)
            places = _places(grams, self.size)
            for k in range(len(self.languages)):
                if k % 64 == 0:
                    got = np.bitwise_and.reduce([self.slots[k >> 6, p] for p in places])
                total = np.concatenate(([0], np.cumsum(self._bits(got, k), dtype=np.int64)))
                out[at : at + z, k] = total[rows[1:]] - total[rows[:-1]]
        return n, out


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE) -> Filter:
    """Learns from rows with a label and text: about ``sample`` rows a label, chosen by the hash of their key.

    Repeated rows count as often as they are there, rows without a key have one hash together, and an empty
    table learns no language.  An n-gram that several languages hold equally often is held by all of them.
    """
    spark = docs.sparkSession
    core.prepare(spark)
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    total = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    languages = sorted(total)
    if not languages:
        return Filter([], np.zeros(0, np.uint32), np.zeros(0, np.int64))
    # a share of each label's rows by the hash of their key: about ``sample`` rows, all of them where fewer
    share = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(min(1.0, sample / total[k])))))
    chosen = rows.filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_003)) < F.try_element_at(share, F.col(label)) * 1_000_003)

    def count(batches):
        for b in batches:
            names = b.column("label").to_pylist()
            for name in sorted(set(names)):
                own = b.column("text").filter(pc.equal(b.column("label"), name))
                got = [g for _, _, g in _grams(own)]
                g, c = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(c.astype(np.int64))], ["label", "gram", "n"])

    counted = chosen.select(F.col(label).alias("label"), F.col(text).alias("text")).mapInArrow(core.tidy(count), "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    counted = core.keep(counted, "grams")
    sums = {r[0]: r[1] for r in counted.groupBy("label").agg(F.sum("n")).collect()}
    rate = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(float(sums.get(k, 0) or 1)))))
    rated = counted.withColumn("rate", F.col("n") / F.try_element_at(rate, F.col("label")))
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"), F.sum("n").alias("all")).filter(F.col("all") >= LEAST)
    number = F.create_map(*(x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))))
    held = rated.join(best, "gram").filter(F.col("rate") >= RATIO * F.col("best")).select("gram", F.try_element_at(number, F.col("label")).alias("holder")).toArrow()
    core.drop_kept(counted)
    return Filter(languages, held.column("gram").to_numpy().astype(np.uint32), held.column("holder").to_numpy().astype(np.int64))


def predict(docs: DataFrame, model: Filter, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred and score.

    Columns of ``docs`` with these two names are replaced.  The score is the share of the text's n-grams that the predicted language holds (0 to 1).  A text that
    is null or has no letter is ``und`` with score 0; one too short for an n-gram, or without hits, gets
    the first language with score 0 (``und`` if none was learned).  Ties go to the first language.
    """
    spark = docs.sparkSession
    core.prepare(spark)
    shared = core.send(spark, model)
    keep = keep if keep is not None else [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join([*(f"`k{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "lang_pred string, score double"])
    sent = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    at = f"k{keep.index(text)}" if text in keep else "t"  # the text is sent once
    if at == "t":
        sent.append(F.col(text).alias("t"))

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for b in batches:
            texts = b.column(at)
            n, hits = m.hits(texts)
            if len(m.languages):
                good = np.maximum(0, (hits - n[:, None] * m.fp) / (1 - m.fp))
                best = good.argmax(1)
                score = np.minimum(1.0, good[np.arange(len(n)), best] / np.maximum(1, n))
            else:
                best, score = np.zeros(len(n), np.int64), np.zeros(len(n))
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            pred = names[np.where(lettered, best, len(names) - 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(f"k{i}") for i in range(len(keep))), pa.array(pred.tolist(), pa.string()), pa.array(np.where(lettered, score, 0.0))], [*(f"k{i}" for i in range(len(keep))), "lang_pred", "score"])

    out = docs.select(*sent).mapInArrow(core.tidy(run), schema)
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
