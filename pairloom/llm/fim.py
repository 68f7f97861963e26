"""Fill-in-the-middle: texts cut at two units drawn from their key, and put together in another order.

A unit is a run of the letters A-Z and a-z, or any other single character.  Whether a unit starts at a character
can be told from that character and the one before it, so a text falls into chunks that overlap by one byte, in which starts are
counted independently.  Prefix sums over the chunks tell which chunk holds a cut's rank, and only those chunks
are looked at again.  A long text is counted a mebibyte at a time; no list of its units is made.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import core

#: Bytes of a chunk.
CHUNK = 4096
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _starts(data: np.ndarray, lo: int, hi: int, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of [lo, hi) start a unit and which start a character; it reads one byte before ``lo``.

    ``edges`` are the places within [lo, hi) at which a text starts.
    """
    part = data[lo:hi]
    letter = _LETTER[part]
    before = np.empty(hi - lo, bool)
    before[1:] = letter[:-1]
    before[0] = lo > 0 and _LETTER[data[lo - 1]]
    before[edges - lo] = False
    character = part & 0xC0 != 0x80
    return character & ~(letter & before), character


class Chunks:
    """The chunks of some texts, given as bytes and offsets from 0, with their counts' prefix sums."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, size: int = CHUNK):
        self.data, self.offs = data, offs
        length = np.diff(offs)
        each = -(-length // size)
        self.row = np.concatenate(([0], np.cumsum(each)))  # the first chunk of each text
        within = np.arange(self.row[-1]) - np.repeat(self.row[:-1], each)
        self.lo = np.repeat(offs[:-1], each) + size * within
        self.hi = np.minimum(self.lo + size, np.repeat(offs[1:], each))
        units, characters = np.zeros(len(self.lo), np.int64), np.zeros(len(self.lo), np.int64)
        at = 0
        while at < len(self.lo):  # runs of chunks of about a slice of bytes
            end = max(at + 1, int(np.searchsorted(self.lo, self.lo[at] + core.SLICE_BYTES)))
            lo, hi = int(self.lo[at]), int(self.hi[end - 1])
            flags = _starts(data, lo, hi, offs[np.searchsorted(offs, lo) : np.searchsorted(offs, hi)])
            for out, flag in zip((units, characters), flags, strict=True):
                out[at:end] = np.add.reduceat(flag.astype(np.int64), self.lo[at:end] - lo)
            at = end
        self.units, self.characters = np.concatenate(([0], np.cumsum(units))), np.concatenate(([0], np.cumsum(characters)))

    def count(self) -> np.ndarray:
        """Units of each text."""
        return self.units[self.row[1:]] - self.units[self.row[:-1]]

    def place(self, text: int, rank: int) -> tuple[int, int]:
        """The byte at which the unit of this rank (from 0) starts, and the characters of the text before it."""
        first, end = int(self.row[text]), int(self.row[text + 1])
        total = int(self.units[first]) + rank
        if total >= self.units[end]:
            return int(self.offs[text + 1]), int(self.characters[end] - self.characters[first])
        chunk = int(np.searchsorted(self.units, total, "right")) - 1  # the last one with at most so many before it
        lo, hi = int(self.lo[chunk]), int(self.hi[chunk])
        flags, character = _starts(self.data, lo, hi, np.array([lo] if chunk == first else [], np.int64))
        at = int(np.flatnonzero(flags)[total - int(self.units[chunk])])
        return lo + at, int(self.characters[chunk] - self.characters[first]) + int(np.count_nonzero(character[:at]))


def _draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a key; a null key counts as empty."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hexed, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Per row: the key, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), and output.

    A text stays plain where it is null or empty (then the output is empty), where it holds one of the marks, and for
    the share of keys from ``plain_from`` per cent on; ``spm_below`` per cent of the others put the suffix first.
    Rows with one key and text give the same row; an empty table gives an empty table; other columns are not looked at.
    The key must not have the name of an output column.
    """
    spark = docs.sparkSession
    core.prepare(spark)
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "n", "form", "prefix_chars", "middle_chars", "output"]
    if key in names[1:]:
        raise ValueError(f"the key is named like an output column: {key}")
    tags = [m.encode() for m in marks]

    def run(batches):
        for b in batches:
            draws = [b.column(f"h{k}").to_numpy() for k in range(4)]
            n_all, forms, before, middle, out = [], [], [], [], []
            for first, end, data, offs in core.text_slices(b.column("text")):
                chunks = Chunks(data, offs)
                counts = chunks.count()
                n_all.append(counts)
                for i in range(end - first):
                    h1, h2, h3, h4 = (int(d[first + i]) for d in draws)
                    whole = data[offs[i] : offs[i + 1]].tobytes()
                    if not whole or h3 % 100 >= plain_from or any(t in whole for t in tags):
                        made = ("plain", None, None, whole)
                    else:
                        n = int(counts[i]) + 1
                        (x, x_chars), (y, y_chars) = (chunks.place(i, r) for r in sorted((h1 % n, h2 % n)))
                        x, y = x - int(offs[i]), y - int(offs[i])
                        if h4 % 100 < spm_below:
                            made = ("spm", x_chars, y_chars - x_chars, b"".join((tags[1], whole[y:], tags[0], whole[:x], tags[2], whole[x:y])))
                        else:
                            made = ("psm", x_chars, y_chars - x_chars, b"".join((tags[0], whole[:x], tags[1], whole[y:], tags[2], whole[x:y])))
                    for column, value in zip((forms, before, middle, out), made, strict=True):
                        column.append(value)
            n = np.concatenate(n_all) if n_all else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.string())], names
            )

    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(_draws(F.col(key), seed))))
    made = plain.mapInArrow(core.tidy(run), f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("key", key)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from an output and its form; a text that held a mark is plain, so the marks tell its parts."""
    parts = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
