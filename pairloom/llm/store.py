"""Content-addressed store of token ids.

Layout of a store folder (all Parquet):

* ``chunks``: digest (SHA-256 of the ids' little-endian unsigned 32-bit bytes), n, payload.  The payload is
  zstd over unsigned 16-bit (or, where ids need it, 32-bit) ids, told by the first byte.  Each digest is
  stored once.
* ``recipes``: one row per document in ascending key order: key, start, n_tokens, chunk digests, Merkle
  root of the digests.
* ``manifest``: one row per recipe part: first key, documents, ids, Merkle root of the parts' roots.

Chunks are cut where a rolling hash over the last WINDOW ids has its low bits zero, so equal runs of ids
in different documents give equal chunks whatever precedes them.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import core, tokens
from .core import U64

WINDOW, MASK, LEAST, MOST = 16, 1023, 256, 8192
_GEAR = U64(0x9E3779B97F4A7C15)


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id sequence."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    with np.errstate(over="ignore"):
        x = core.mix64(ids.astype(U64) + _GEAR)
        total = np.concatenate((np.zeros(1, U64), np.cumsum(x)))
        h = core.mix64(total[WINDOW:] - total[:-WINDOW])  # sum over the last ids: rolling
    marks = np.flatnonzero((h & U64(MASK)) == 0) + WINDOW
    out, last = [], 0
    for m in marks.tolist():
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST:
            out.append(m)
            last = m
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def merkle_root(digests: list[bytes]) -> bytes:
    """Root of the binary hash tree over the digests (an odd one is carried up)."""
    if not digests:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\0" + d).digest() for d in digests]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def pack_ids(raw: bytes, squeeze=None) -> bytes:
    ids = np.frombuffer(raw, "<u4")
    small = not len(ids) or int(ids.max()) < 65536
    body = (squeeze or zstandard.ZstdCompressor(level=1, write_content_size=True)).compress(ids.astype("<u2").tobytes() if small else raw)
    return (b"\2" if small else b"\4") + body


def unpack_ids(payload: bytes) -> bytes:
    raw = zstandard.ZstdDecompressor().decompress(payload[1:])
    return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if payload[:1] == b"\2" else raw


def _gf_times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def _zero_operators() -> list[list[int]]:
    """The linear maps on a CRC-32 state of 2**k zero bytes."""
    one = [0xEDB88320, *(1 << i for i in range(31))]
    square = lambda m: [_gf_times(m, m[i]) for i in range(32)]
    m = square(square(square(one)))
    out = []
    for _ in range(48):
        out.append(m)
        m = square(m)
    return out


_ZEROS = _zero_operators()


def crc_join(first: int, second: int, n: int) -> int:
    """CRC-32 of two byte strings put together; the second has n bytes."""
    k = 0
    while n:
        if n & 1:
            first = _gf_times(_ZEROS[k], first)
        n >>= 1
        k += 1
    return first ^ second


def write_store(docs: DataFrame, path: str, vocabulary: str = tokens.VOCABULARY, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every whole text (null: empty), ends it with id 1, and writes the store.

    Repeated rows are documents of their own, next to each other; null keys come first.
    """
    spark = docs.sparkSession
    core.prepare(spark)
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches):
        part = TaskContext.get().partitionId()
        seen: set[bytes] = set()
        squeeze = zstandard.ZstdCompressor(level=1, write_content_size=True)
        row = 0
        for b in batches:
            out: list[tuple] = []
            for k, raw in zip(b.column("key").to_pylist(), tokens.encoded(b.column("text"), vocabulary), strict=True):
                ids = np.frombuffer(raw, "<u4")
                digests, last = [], 0
                for e in cut_points(ids):
                    piece = raw[4 * last : 4 * e]
                    last = e
                    d = hashlib.sha256(piece).digest()
                    digests.append(d)
                    if d not in seen:
                        if len(seen) < 1_000_000:
                            seen.add(d)
                        out.append((None, None, None, None, None, d, len(piece) // 4, pack_ids(piece, squeeze)))
                out.append((k, part, row, len(ids), digests, merkle_root(digests), None, None))
                row += 1
            for at in range(0, len(out), 4096):
                c = list(zip(*out[at : at + 4096], strict=True))
                types = [b.column("key").type, pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], ["key", "part", "own", "n_tokens", "digests", "digest", "n", "payload"])

    both = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        core.tidy(cut, remember=True), f"key {kind}, part int, own long, n_tokens long, digests array<binary>, digest binary, n long, payload binary"
    )
    # one pass over the texts: chunks go out by digest, recipes by the hash of their place
    where = F.when(F.col("payload").isNotNull(), F.col("digest")).otherwise(F.concat_ws(":", "part", "own").cast("binary"))
    spread = both.repartition(where).sortWithinPartitions("digest")

    def once(batches):
        last = None
        for b in batches:
            stay = []
            for d, p in zip(b.column("digest").to_pylist(), b.column("payload").is_valid().to_pylist(), strict=True):
                stay.append(not p or d != last)
                if p:
                    last = d
            yield b.filter(pa.array(stay))

    staged = f"{path}/staged"
    spread.mapInArrow(core.tidy(once), both.schema).withColumn("of", F.when(F.col("payload").isNotNull(), "chunks").otherwise("recipes")).write.partitionBy("of").option("compression", "zstd").parquet(staged)
    jvm = spark.sparkContext._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(f"{staged}/of=chunks"), jvm.org.apache.hadoop.fs.Path(f"{path}/chunks")
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old):
        fs.rename(old, new)
    else:
        spark.createDataFrame([], "digest binary, n long, payload binary").write.parquet(f"{path}/chunks")
    recipe = f"key {kind}, part int, own long, n_tokens long, digests array<binary>, digest binary"
    if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{staged}/of=recipes")):
        recipes = spark.read.schema(recipe).parquet(f"{staged}/of=recipes")
    else:
        recipes = spark.createDataFrame([], recipe)
    ordered = core.keep(recipes.repartitionByRange(core.tasks(spark), "key", "part", "own").sortWithinPartitions("key", "part", "own").withColumn("piece", F.spark_partition_id()).withColumn("line", F.monotonically_increasing_id()), "recipes")
    sums = ordered.groupBy("piece").agg(F.sum("n_tokens").alias("n")).select("piece", F.coalesce(F.sum("n").over(W.orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n_tokens").over(W.partitionBy("piece").orderBy("line").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    final = ordered.withColumn("within", within).join(F.broadcast(sums), "piece").select("piece", "line", "key", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "digests", F.col("digest").alias("root"))
    final.sortWithinPartitions("line").write.option("compression", "zstd").parquet(f"{path}/recipes")
    core.drop_kept(ordered)
    core.remove(spark, staged)
    _manifest(spark, path)


def _manifest(spark: SparkSession, path: str) -> None:
    def roots(batches):
        now, held = None, []

        def out(piece, rows):
            return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([sum(r[1] for r in rows)], pa.int64()), pa.array([merkle_root([r[0] for r in rows])], pa.binary())], ["piece", "documents", "ids", "root"])

        for b in batches:
            for p, r, n in zip(*(b.column(c).to_pylist() for c in ("piece", "root", "n_tokens")), strict=True):
                if p != now:
                    if held:
                        yield out(now, held)
                    now, held = p, []
                held.append((r, n))
        if held:
            yield out(now, held)

    rows = spark.read.parquet(f"{path}/recipes").select("piece", "line", "root", "n_tokens").repartition("piece").sortWithinPartitions("piece", "line")
    rows.mapInArrow(core.tidy(roots), "piece int, documents long, ids long, root binary").write.parquet(f"{path}/manifest")


def store_root(spark: SparkSession, path: str) -> bytes:
    """The Merkle root of the whole store, from the manifest's rows (one per part)."""
    return merkle_root([r[0] for r in spark.read.parquet(f"{path}/manifest").orderBy("piece").select("root").collect()])


def _facts(batches):
    """Reads chunks back: their real digest, length and CRC-32."""
    for b in batches:
        rows = [unpack_ids(p.as_buffer().to_pybytes()) for p in b.column("payload")]
        yield pa.RecordBatch.from_arrays(
            [b.column("digest"), pa.array([hashlib.sha256(x).digest() == d for x, d in zip(rows, b.column("digest").to_pylist(), strict=True)]), pa.array([len(x) // 4 for x in rows], pa.int64()), pa.array([zlib.crc32(x) for x in rows], pa.int64())],
            ["digest", "sound", "n", "crc"],
        )


def _rebuild(batches):
    for b in batches:
        out = []
        for k, start, n, root, parts in zip(*(b.column(c).to_pylist() for c in ("key", "start", "n_tokens", "root", "parts")), strict=True):
            parts = sorted(parts, key=lambda p: p["at"])
            total, c = 0, 0
            for p in parts:
                c = crc_join(c, p["crc"], 4 * p["n"])
                total += p["n"]
            if total != n or not all(p["sound"] for p in parts) or merkle_root([p["digest"] for p in parts]) != root:
                raise ValueError(f"document {k} does not come back from the store")
            out.append((k, start, total, c))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [b.column("key").type, *[pa.int64()] * 3], strict=True)], ["key", "start", "n_tokens", "ids_crc32"])


def read_index(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, from the files.

    Every chunk is read, checked against its address and summed up once; a document's CRC-32 is had from
    those of its chunks in order, and its recipe is checked against its Merkle root, so no payload moves.
    """
    core.prepare(spark)
    facts = spark.read.parquet(f"{path}/chunks").select("digest", "payload").mapInArrow(core.tidy(_facts), "digest binary, sound boolean, n long, crc long")
    recipes = spark.read.parquet(f"{path}/recipes")
    steps = recipes.select("line", F.posexplode("digests").alias("at", "digest"))
    parts = steps.join(facts, "digest", "left").groupBy("line").agg(F.collect_list(F.struct("at", "digest", F.coalesce("sound", F.lit(False)).alias("sound"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc"))).alias("parts"))
    kind = recipes.schema["key"].dataType.simpleString()
    whole = recipes.join(parts, "line", "left").select("key", "start", "n_tokens", "root", F.coalesce("parts", F.expr("cast(array() as array<struct<at:int,digest:binary,sound:boolean,n:bigint,crc:bigint>>)")).alias("parts"))
    return whole.mapInArrow(core.tidy(_rebuild), f"key {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", key)


def read_documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, ids as little-endian unsigned 32-bit bytes) of each document."""
    core.prepare(spark)
    steps = spark.read.parquet(f"{path}/recipes").select("line", "key", "start", F.posexplode_outer("digests").alias("at", "digest"))
    parts = steps.join(spark.read.parquet(f"{path}/chunks").select("digest", "payload"), "digest", "left").groupBy("line", "key", "start").agg(F.sort_array(F.collect_list(F.struct("at", "payload"))).alias("parts"))

    def whole(batches):
        for b in batches:
            ids = [b"".join(unpack_ids(p["payload"]) for p in parts) for parts in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("start"), pa.array(ids, pa.binary())], ["key", "start", "ids"])

    kind = parts.schema["key"].dataType.simpleString()
    return parts.select("key", "start", "parts").mapInArrow(core.tidy(whole), f"key {kind}, start long, ids binary").withColumnRenamed("key", key)
