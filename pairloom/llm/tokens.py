"""Token ids of whole texts, exactly as the tokenizers library gives them, with each word encoded once.

The vocabularies used here lower-case, cut texts by a fixed pattern and never join tokens across a cut,
so the ids of a text are the ids of its pieces.  Texts of ASCII and Latin-1 letters are cut and looked
up by columns; pieces that a worker has not seen go to the library's model.  Other texts go word by
word (the pattern never crosses white space), and words outside Latin-1, or texts in which a special
token could occur, through the library's whole pipeline.
"""

from __future__ import annotations

import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex

from . import core
from .core import U64

VOCABULARY = "word_bpe_49k.json"
END = 1
KNOWN_WORDS = 100_000

#: The pre-tokenizer's pattern (fixed values of the public vocabulary file).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Byte classes: 0 white space, 1 letter, 2 digit, 3 other, 4 left to the word-by-word path.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[0xC3] = 1
_CLASS[48:58] = 2
_CLASS[[28, 29, 30, 31]] = _CLASS[128:0xC3] = _CLASS[0xC4:] = 4
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_SUFFIX = np.zeros(256, bool)
_SUFFIX[list(b"strvmldSTRVMLD")] = True
_HASH = core._stream(29, 256)


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, name: str = VOCABULARY):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.table = _Table()
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.specials = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]

    def _packed(self, ids) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        if max(text) > "ÿ" or "\x85" in text or "\xa0" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._packed(self.whole.encode(text, add_special_tokens=False).ids)
        out = []
        for piece in PIECE.findall(text.lower()):
            got = self.pieces.get(piece)
            if got is None:
                got = self._packed([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))])
                self.pieces[piece] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """Ids of one UTF-8 text, word by word."""
        if any(s in text for s in self.specials):
            return self._packed(self.whole.encode(text.decode("utf-8"), add_special_tokens=False).ids)
        out = []
        for w in text.split():
            got = self.words.get(w)
            if got is None:
                got = self.words[w] = self._word(w)
            out.append(got)
        if len(self.words) > KNOWN_WORDS:  # frequent words come early, so the older half stays
            self.words = dict(islice(self.words.items(), KNOWN_WORDS // 2))
        if len(self.pieces) > KNOWN_WORDS:
            self.pieces = dict(islice(self.pieces.items(), KNOWN_WORDS // 2))
        return b"".join(out)

    def encode_rows(self, data: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """Ids of many texts, given as bytes and offsets from 0: pieces are cut, hashed and looked up by columns."""
        n, rows = len(data), len(offs) - 1
        if not n:
            return [b""] * rows
        kind = _CLASS[data]
        low = _LOW[data]
        after = np.zeros(n, bool)  # the second byte of a two-byte Latin-1 letter
        after[1:] = data[:-1] == 0xC3
        second = data[after]
        kind[after] = np.where((second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7), 1, 4)
        low[after] = np.where((second <= 0x9E) & (second != 0x97), second + 0x20, second)
        quote = np.flatnonzero(data[:-1] == 0x27)
        odd = np.flatnonzero(kind == 4)
        odd = np.concatenate((odd, quote[_SUFFIX[data[quote + 1]]], np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))))
        slow = set((np.searchsorted(offs, odd, "right") - 1).tolist())
        edge = np.ones(n + 1, bool)
        edge[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        edge[offs] = True
        at = np.flatnonzero(edge)
        first, stop = at[:-1], at[1:]
        real = kind[first] != 0
        first, stop = first[real], stop[real]
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, U64)
            np.cumsum(_HASH[low] * core._power(core._STEP, "step", n), out=total[1:])
            h = (total[stop] - total[first]) * core._power(core._BACK, "back", n)[first]
            h = core.mix64(h + (stop - first).astype(U64) * core._LEN) | U64(1)
        value = self.table.find(h)
        miss = np.flatnonzero(value < 0)
        if len(miss):
            new, one = np.unique(h[miss], return_index=True)
            one = miss[one]
            view = low.tobytes()
            model, letters, ids, counts = self.model, self.letters, [], []
            for a, b in zip(first[one].tolist(), stop[one].tolist(), strict=True):
                got = [t.id for t in model.tokenize(view[a:b].decode("latin-1").translate(letters))]
                ids += got
                counts.append(len(got))
            self.table.add(new, ids, counts)
            value[miss] = self.table.find(h[miss])
        length = self.table.count[value]
        ends = np.concatenate(([0], np.cumsum(length)))
        flat = self.table.ids[np.repeat(self.table.start[value] - ends[:-1], length) + np.arange(ends[-1])]
        cuts = ends[np.searchsorted(first, offs)].tolist()
        self.table.trim()
        return [self.encode(data[offs[i] : offs[i + 1]].tobytes()) if i in slow else flat[cuts[i] : cuts[i + 1]].tobytes() for i in range(rows)]


class _Table:
    """Ids by 64-bit hash, in flat arrays with open addressing, at most half full.

    It grows as long as one slice of text needs; between slices more than MOST pieces are cut to the older half.
    """

    SLOTS, MOST = 1 << 18, 700_000

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self._slots(self.SLOTS)
        self.keys, self.n = np.zeros(1 << 16, U64), 0
        self.start, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, "<u4"), 0

    def _slots(self, n: int) -> None:
        self.last = n - 1
        self.key, self.slot_value = np.zeros(n, U64), np.zeros(n, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        slot = (keys >> U64(20)).astype(np.int64) & self.last
        while len(left):
            got = self.key[slot]
            hit = got == keys
            out[left[hit]] = self.slot_value[slot[hit]]
            on = ~hit & (got != 0)
            left, keys, slot = left[on], keys[on], slot[on] + 1 & self.last
        return out

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot = (keys >> U64(20)).astype(np.int64) & self.last
        while len(keys):
            free = np.flatnonzero(self.key[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.key[slot[put]], self.slot_value[slot[put]] = keys[put], values[put]
            on = np.ones(len(keys), bool)
            on[put] = False
            keys, values, slot = keys[on], values[on], slot[on] + 1 & self.last

    def add(self, keys: np.ndarray, ids: list[int], counts: list[int]) -> None:
        m, z = self.n + len(keys), self.used + len(ids)
        for name in ("keys", "start", "count"):
            x = getattr(self, name)
            if len(x) < m:
                setattr(self, name, np.concatenate((x, np.zeros(max(m, 2 * len(x)) - len(x), x.dtype))))
        if len(self.ids) < z:
            self.ids = np.concatenate((self.ids, np.zeros(max(z, 2 * len(self.ids)) - len(self.ids), "<u4")))
        c = np.array(counts, np.int64)
        self.keys[self.n : m], self.count[self.n : m] = keys, c
        self.start[self.n : m] = self.used + np.cumsum(c) - c
        self.ids[self.used : z] = ids
        if 2 * m > self.last:
            self._slots(1 << (4 * m).bit_length())
            self._place(self.keys[:m], np.arange(m, dtype=np.int32))
        else:
            self._place(keys, np.arange(self.n, m, dtype=np.int32))
        self.n, self.used = m, z

    def trim(self) -> None:
        if self.n > self.MOST:
            half = self.MOST // 2
            keys, counts = self.keys[:half].copy(), self.count[:half].copy()
            ids = self.ids[: int(counts.sum())].copy()
            self.clear()
            self.add(keys, ids, counts)


_encoders: dict[str, Encoder] = {}
core._remembered.append(_encoders)


def encoder(name: str = VOCABULARY) -> Encoder:
    """The encoder of this worker process; it outlives a task, until one comes that does not ``remember``."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def encoded(column: pa.Array, name: str = VOCABULARY, end: int | None = END):
    """For each row the packed ids of its text, with the end id; a null text is empty."""
    enc = encoder(name)
    tail = b"" if end is None else np.array([end], "<u4").tobytes()
    for _, _, data, offs in core.text_slices(column, core.WORK_BYTES):
        if len(data) > 2 * core.SLICE_BYTES:  # one very long text, part by part
            yield b"".join(enc.encode_rows(x, np.array([0, len(x)]))[0] for x in _parts(data)) + tail
        else:
            for ids in enc.encode_rows(data, offs):
                yield ids + tail


def _parts(data: np.ndarray, limit: int = core.SLICE_BYTES):
    """A long text cut before white space, which no token crosses."""
    at = 0
    while at < len(data):
        end = at + limit
        while end < len(data):
            space = np.flatnonzero(core.SPACE[data[end : end + limit]])
            if len(space):
                end += int(space[0])
                break
            end += limit
        yield data[at:end]
        at = end


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
