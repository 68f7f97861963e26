"""Quartile bucket digests of documents and their comparison.

Within a window of five bytes six byte triplets are hashed to 128 buckets.  A digest is two hex digits of
the text's length on a logarithmic scale, two of a checksum of the counts' quartiles, then two bits per
bucket: the quartile its count lies in.  Two digests differ by the steps between their lengths and
between the quartiles of each bucket (three steps count six); likeness is ``max(0, 1 - difference / FAR)``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import core

BUCKETS, FAR = 128, 200.0
_TRIPLET = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4)]
_MIX = [(core._stream(100 + 3 * i + j, 256) >> np.uint64(57)).astype(np.uint8) for i in range(6) for j in range(3)]
_STEPS = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]])


def digest(data: bytes) -> str:
    """The digest of a UTF-8 text; texts under three bytes have empty buckets and differ by length and content."""
    d = np.frombuffer(data, np.uint8)
    n = len(d)
    counts = np.zeros(BUCKETS, np.int64)
    if n >= 5:
        part = [d[k : n - 4 + k] for k in range(5)]
        for i, (a, b, c) in enumerate(_TRIPLET):
            h = _MIX[3 * i][part[a]] ^ _MIX[3 * i + 1][part[b]] ^ _MIX[3 * i + 2][part[c]]
            counts += np.bincount(h, minlength=BUCKETS)
    elif n >= 3:
        for k in range(n - 2):
            counts[_MIX[0][d[k]] ^ _MIX[1][d[k + 1]] ^ _MIX[2][d[k + 2]]] += 1
    s = np.sort(counts)
    q1, q2, q3 = s[BUCKETS // 4 - 1], s[BUCKETS // 2 - 1], s[3 * BUCKETS // 4 - 1]
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(255, round(math.log(n + 1) / math.log(1.1)))
    check = hashlib.sha256(f"{n if n < 5 else 0}:{data[:4].hex() if n < 5 else ''}:{q1 * 100 // max(1, q3)}:{q2 * 100 // max(1, q3)}".encode()).hexdigest()[:2]
    packed = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    return f"{length:02x}{check}{packed.astype(np.uint8).tobytes().hex()}"


def _codes(x: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(x), np.uint8)
    body = raw[2:]
    return int(raw[0]), np.stack([body & 3, body >> 2 & 3, body >> 4 & 3, body >> 6 & 3], 1).ravel()


def likeness(x: str, y: str) -> float:
    """1 for equal digests, falling to 0 at a difference of FAR."""
    if x == y:
        return 1.0
    (n, a), (m, b) = _codes(x), _codes(y)
    far = int(_STEPS[a, b].sum()) + max(0, abs(n - m) - 1) + (x[2:4] != y[2:4])
    return max(0.0, 1.0 - far / FAR)


_OUT = "key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, head string, head_print string, tail string, rows long"


def _row(text: str, mark: str, after: str, after_mark: str) -> tuple:
    cut = len(text) // 4
    edited = (text[: len(text) - cut] + after[:cut]).encode()
    edited_mark = digest(edited) if cut else mark
    return len(text), hashlib.sha256(edited).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, after_mark)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of every text (null: empty), of its edited text, and their likeness to each other and the next.

    Documents stand in ascending key order (null keys first, equal keys by text); each row's follower is the
    next one, the last row's the first, a single row's itself.  Texts are sorted into ranges of keys, so a
    follower is the next row of the task; only the last row of a task meets the first of the next one by a
    join of one row per task.  A range of keys that is too large for a task spills in Spark's sort and
    streams through Python.
    """
    spark = docs.sparkSession
    core.prepare(spark)
    kind = docs.schema[key].dataType.simpleString()
    names = [x.strip().split(" ")[0] for x in _OUT.format(kind="x").split(",")]

    def run(batches):
        part = TaskContext.get().partitionId()
        before, head, n = None, None, 0
        for b in batches:
            out = []
            for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                t = t or ""
                mark = digest(t.encode())
                if before is None:
                    head = (t, mark)
                else:
                    out.append((before[0], *_row(before[1], before[2], t, mark), None, None, None, None, None))
                before = (k, t, mark)
                n += 1
            yield batch(out, b.column("key").type)
            kt = b.column("key").type
        if before is not None:
            yield batch([(before[0], None, None, None, None, None, None, part, head[0], head[1], before[1], n)], kt)

    def batch(rows, kt):
        types = [kt, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int32(), *[pa.string()] * 3, pa.int64()]
        cols = list(zip(*rows, strict=True)) or [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    sorted_ = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartitionByRange(core.tasks(spark), "key").sortWithinPartitions("key", "text")
    made = core.keep(sorted_.mapInArrow(core.tidy(run), _OUT.format(kind=kind)), "digests")
    ends = made.filter("part is not null")
    order = W.orderBy("part")  # one narrow row per task
    places = ends.select("part").withColumn("follower", F.coalesce(F.lead("part").over(order), F.first("part").over(order)))
    heads = ends.select(F.col("part").alias("follower"), F.col("head").alias("after"), F.col("head_print").alias("after_print"))
    last = ends.select("part", "key", "tail").join(places, "part").join(heads, "follower").select("key", "tail", "after", "after_print")

    def close(batches):
        for b in batches:
            rows = [(k, *_row(t, digest(t.encode()), a, m)) for k, t, a, m in zip(*(b.column(c).to_pylist() for c in ("key", "tail", "after", "after_print")), strict=True)]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = [b.column("key").type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names[:7])

    out = made.filter("part is null").select(*names[:7]).union(last.mapInArrow(core.tidy(close), ", ".join(_OUT.format(kind=kind).split(", ")[:7])))
    return out.withColumnRenamed("key", key)
