"""Best-fit packing of documents into sequences by exact-complement hashing.

Documents become pieces of at most ``limit`` tokens.  Only the counts of each length reach the driver
(at most ``limit`` numbers, whatever the corpus).  There whole runs of equal bins are planned: the
longest piece left is taken, its gap is looked up in the index of single lengths, of sums of two and
of sums of three lengths, and as many bins as the counts allow take that exact filling.  Where no
exact filling is available the gap takes the longest piece that fits (best fit) and what is left of
it is looked up again.  Each run uses up a length, so the plan stays a few thousand rows, too.

Pieces find their place by their number among the pieces of their length: a binary search in the
broadcast plan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import core, tokens


def _single(have: np.ndarray, gap: int) -> list[int] | None:
    return [gap] if have[gap] else None


def _double(have: np.ndarray, gap: int) -> list[int] | None:
    """The two lengths with this sum of which the longer is longest."""
    low = np.arange(1, gap // 2 + 1)
    if not len(low):
        return None
    ok = (have[low] > 0) & (have[gap - low] > 0)
    if gap % 2 == 0 and have[gap // 2] < 2:
        ok[-1] = False
    at = int(np.argmax(ok))
    return [gap - int(low[at]), int(low[at])] if ok[at] else None


def _triple(have: np.ndarray, gap: int) -> list[int] | None:
    for a in np.flatnonzero(have[1 : gap - 1])[::-1] + 1:
        if 3 * a < gap:
            return None
        have[a] -= 1
        rest = _double(have, gap - int(a))
        have[a] += 1
        if rest:
            return [int(a), *rest]
    return None


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Runs of equal bins, (lengths, number of bins), using each length as often as ``counts`` says."""
    have = np.array(counts, np.int64)
    limit = len(have) - 1
    out = []
    top = limit
    while True:
        while top > 0 and not have[top]:
            top -= 1
        if not top:
            return out
        own = [top]
        have[top] -= 1
        gap = limit - top
        while gap:
            exact = _single(have, gap) or _double(have, gap) or _triple(have, gap)
            fits = np.flatnonzero(have[1 : gap + 1])
            if exact is None and not len(fits):
                break
            for x in exact or [int(fits[-1]) + 1]:
                own.append(x)
                have[x] -= 1
                gap -= x
        kinds, uses = np.unique(own, return_counts=True)
        more = int((have[kinds] // uses).min())
        have[kinds] -= uses * more
        out.append((own, more + 1))


def _segments(runs: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first number, sequence of the first, offset), sorted."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for own, n in runs:
        offset = 0
        for x in own:
            rows.append((x, used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + n
            offset += x
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _cut(limit: int, name: str, columns):
    def run(batches):
        part = TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, np.int64)
        for b in batches:
            rows = []
            for i, ids in zip(b.column("key").to_pylist(), tokens.encoded(b.column("text"), name), strict=True):
                n = len(ids) // 4
                for k in range(0, n, limit):
                    m = min(limit, n - k)
                    rows.append((i, k // limit, k, m, tokens.crc(ids[4 * k : 4 * (k + m)]), part, int(seen[m])))
                    seen[m] += 1
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [b.column("key").type, pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()], strict=True)], columns
            )

    return run


def pack(docs: DataFrame, limit: int = 4096, vocabulary: str = tokens.VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty and still have their end id, so every row of ``docs`` (repeated ones too) has at
    least one piece.  An empty table packs into no sequence.
    """
    spark = docs.sparkSession
    core.prepare(spark)
    kind = docs.schema[key].dataType.simpleString()
    columns = ["key", "piece", "start", "length", "ids_crc32", "part", "own"]
    cut = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        core.tidy(_cut(limit, vocabulary, columns), remember=True), f"key {kind}, piece int, start long, length long, ids_crc32 long, part int, own long"
    )
    cut = core.keep(cut, "pieces")
    per = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    bases = core.keep(per.select("length", "part", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"), "n"), "bases")
    counts = np.zeros(limit + 1, np.int64)
    for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r[0]] = r[1]
    table = spark.sparkContext.broadcast(_segments(plan(counts)))
    wide = np.int64(1 << 50)

    def place(batches):
        seg = table.value
        keys = seg[:, 0] * wide + seg[:, 1] if len(seg) else np.zeros(0, np.int64)
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            at = np.searchsorted(keys, length * wide + number, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in columns[:5]), pa.array(seg[at, 2] + number - seg[at, 1]), pa.array(seg[at, 3])], [*columns[:5], "sequence_id", "offset"]
            )

    placed = cut.join(bases.select("length", "part", "base").hint("merge"), ["length", "part"]).select(*columns[:5], (F.col("base") + F.col("own")).alias("number"))
    return placed.mapInArrow(place, f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("key", key)
