"""Shared pieces: vectorised word hashing over Arrow buffers, shared-folder tables, broadcasts.

Python stages of this subpackage work on whole Arrow columns.  Words are found and hashed with a
handful of NumPy passes over the bytes of many texts at once, so no Python object is made per word.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: Bytes of text that are looked at at once where each byte takes tens of bytes of arrays, so that a worker stays small.
WORK_BYTES = 1 << 18
U64 = np.uint64
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# ---------------------------------------------------------------- hashing
def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _stream(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(U64(seed) + np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


_BYTE = _stream(11, 256)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_STEP = U64(0xD6E8FEB86659FD93)
_BACK = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_LEN = U64(0xA0761D6478BD642F)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: bytes of a word: anything but ASCII white space
WORD_BYTES = ~SPACE
#: bytes of an alphanumeric word: a-z (and A-Z before lower-casing), digits, all non-ASCII
ALNUM_BYTES = np.zeros(256, bool)
ALNUM_BYTES[48:58] = ALNUM_BYTES[65:91] = ALNUM_BYTES[97:123] = True
ALNUM_BYTES[128:] = True

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(19, (n - 1).bit_length())
        steps = np.full(size, base, U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * SLICE_BYTES:
            _powers[name] = have
    return have[:n]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def word_spans(data: np.ndarray, offs: np.ndarray, kind: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (one more entry than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = np.frombuffer(data.tobytes().translate(kind.tobytes()), bool)
    start, stop = word.copy(), word.copy()
    np.greater(word[1:], word[:-1], out=start[1:])
    np.greater(word[:-1], word[1:], out=stop[:-1])
    begin, end = offs[offs < n], offs[offs > 0] - 1  # words end with their row
    start[begin], stop[end] = word[begin], word[end]
    first = np.flatnonzero(start)
    return first, np.flatnonzero(stop) + 1, np.searchsorted(first, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray, kind: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z as a-z) and for each row the index of its first word.

    A word's hash is a polynomial of its bytes modulo 2**64, had from prefix sums, then finalised
    together with its length.
    """
    first, stop, rows = word_spans(data, offs, kind)
    return span_hashes(data, first, stop), rows


def span_hashes(data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The hashes of words given by their starts and ends."""
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U64)
        terms = np.take(_BYTE, data, mode="wrap")  # a quicker look-up than by index
        terms *= _power(_STEP, "step", n)
        np.cumsum(terms, out=total[1:])
        h = (total[stop] - total[first]) * _power(_BACK, "back", n)[first]
        return mix64(h + (stop - first).astype(U64) * _LEN)


def gram_hashes(words: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """Hashes of all runs of n consecutive words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        h = np.full(m, U64(seed) * _LEN, U64)
        for k in range(n):
            h *= _STEP
            h += words[k : k + m]
        return mix64(h)


def short_hash(words: np.ndarray) -> int:
    """Hash of a whole sequence of fewer words than a shingle has."""
    return int(gram_hashes(words, len(words), 1000 + len(words))[0])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, U64).view(np.int64)


# ---------------------------------------------------------------- session and shared tables
_made: list[tuple[SparkSession, str]] = []
#: Rows and bytes of one Arrow batch, so that a worker's memory does not grow with the length of texts.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package where they run beside the driver, and keeps Arrow batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", ""), os.environ.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of this machine only where that is unset and Spark runs in one process."""
    prepare(spark)
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/pairloom-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


#: Sizes of Parquet's row groups and pages are looked at after few rows, as a row may hold a megabyte.
SMALL_PAGES = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "2", "parquet.page.size.row.check.max": "1000", "parquet.block.size.row.check.min": "8"}


def keep(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage and survives lost executors.

    ``packed`` tables hold squeezed or random bytes and are not compressed again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**SMALL_PAGES).option("compression", "uncompressed" if packed else "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(df: DataFrame) -> None:
    """Removes the folder of a kept table that is no longer read."""
    for f in df.inputFiles()[:1]:
        remove(df.sparkSession, f.rsplit("/", 1)[0])


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # noqa: BLE001, S112  the session may be gone
            continue


_sent: list[Broadcast] = []


def send(spark: SparkSession, value) -> Broadcast:
    """A broadcast that :func:`release` frees later."""
    _sent.append(spark.sparkContext.broadcast(value))
    return _sent[-1]


def release() -> None:
    """Frees the executors' copies of all broadcasts sent so far; one that is still used is sent again."""
    while _sent:
        try:
            _sent.pop().unpersist()
        except Exception:  # noqa: BLE001, S112  its session may be gone
            continue


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def most_frequent(counted: DataFrame, most: int, name: str = "token") -> DataFrame:
    """About ``most`` rows of the largest ``n``: no global sort is needed.

    The histogram that sets the bound has one row for each distinct n.  Of the rows of the last n that does not
    fit whole, a share by the hash of ``name`` is taken.
    """
    sizes = counted.groupBy("n").agg(F.count("*").alias("rows")).toArrow()
    n, rows = sizes.column("n").to_numpy(), sizes.column("rows").to_numpy()
    order = np.argsort(-n)
    fits = int((np.cumsum(rows[order]) <= most).sum())
    if fits == len(n):
        return counted
    last, of = int(n[order][fits]), int(rows[order][fits])
    share = int(1_000_003 * (most - int(rows[order][:fits].sum())) / of)
    return counted.filter((F.col("n") > last) | (F.col("n") == last) & (F.pmod(F.xxhash64(name), F.lit(1_000_003)) < share))


def held(key, modulus: int, remainder: int):
    """crc32 of the key as text has this remainder."""
    return F.coalesce(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus == remainder, F.lit(False))


#: What a worker remembers from one task to the next.
_remembered: list[dict] = []


def forget() -> None:
    """Drops what this worker remembers from tasks of another kind."""
    for x in _remembered:
        x.clear()


def tidy(run, remember: bool = False):
    """``run`` of mapInArrow, after which the worker, which lives on, gives its free memory back.

    Idle workers are reused, so what earlier tasks remember (a tokenizer and the pieces it has seen) is dropped unless
    ``remember`` says that these tasks need it.
    """

    def out(batches):
        if not remember:
            forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
