"""Byte-level BPE as a transducer with bounded lookahead, and decoding as a byte-to-text state machine.

Encoding has two machines.  The *cutter* reads characters and cuts pieces (words with a space before them,
numbers, marks, white space, contractions); every cut is decided by few characters after it (a contraction, a special token).  The
*transducer* reads the bytes of a piece and gives out tokens as soon as no further byte can change them.  How many
bytes that takes follows from the merge list alone (:meth:`Merges.lookahead`), so both keep a bounded amount
of text, however long a piece or a text is.  Whole columns are cut at once by NumPy, and what the transducer gave
for a piece is remembered, within bounds, by the piece's 64-bit hash.

Tables: a null text is empty, an empty text has no ids, repeated rows repeat, an empty table gives an empty table,
other columns pass through unchanged.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core, tokens
from .core import U64

VOCABULARY = "byte_bpe_50k.json"
#: Bytes that the transducer gathers beyond its lookahead before it merges.
STRIDE = 4096
#: Tokens turned into bytes at once when decoding.
DECODED = 1 << 18


class Merges:
    """A vocabulary file's merge list over byte tokens."""

    def __init__(self, name: str = VOCABULARY):
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            made = json.load(f)
        vocab = made["model"]["vocab"]
        byte_of = {c: b for b, c in tokens._byte_letters().items()}
        self.special = {t["content"].encode(): t["id"] for t in made["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.byte_id = [vocab[c] for _, c in sorted(tokens._byte_letters().items())]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in made["model"]["merges"]]
        #: (left id, right id) -> (rank, id of both together)
        self.rule = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}

    def lookahead(self) -> int:
        """Bytes before the end of what was read within which tokens may still change.

        Compare the merges of a text and of the same text read further.  Up to some boundary both are alike, at
        first up to the end of the shorter one.  A rule moves that boundary only by joining a token that ends there with
        one that starts there in one of the two: it then lies before the left part.  Within one rule, merges go from
        left to right, so a rule moves it at most once; and the next rule that moves it has a higher rank, and its right part starts
        with the left part of the rule before.  The heaviest such chain, weighed by the bytes of left parts,
        bounds how far the boundary can go.
        """
        heaviest: dict[bytes, int] = {}
        most = 0
        for a, b in self.rule:  # in order of rank
            left, right = self.bytes_of[a], self.bytes_of[b]
            chain = len(left) + max((heaviest.get(right[:k], 0) for k in range(1, len(right) + 1)), default=0)
            heaviest[left] = max(heaviest.get(left, 0), chain)
            most = max(most, chain)
        return most

    def merge(self, ids: list[int]) -> list[int]:
        """Applies the rules in order of rank, each from left to right."""
        rule = self.rule
        if len(ids) <= 24:
            while len(ids) > 1:
                best, at = None, -1
                for k in range(len(ids) - 1):
                    got = rule.get((ids[k], ids[k + 1]))
                    if got is not None and (best is None or got < best):
                        best, at = got, k
                if best is None:
                    break
                ids[at : at + 2] = [best[1]]
            return ids
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(*rule[p], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rule]
        heapify(heap)
        end = len(ids)
        while heap:
            rank, both, k = heappop(heap)
            n = after[k]
            if ids[k] < 0 or n >= end or rule.get((ids[k], ids[n])) != (rank, both):
                continue  # one of the two has been joined to another since
            ids[k], ids[n] = both, -1
            after[k] = after[n]
            if after[k] < end:
                before[after[k]] = k
                if (got := rule.get((both, ids[after[k]]))) is not None:
                    heappush(heap, (*got, k))
            if before[k] >= 0 and (got := rule.get((ids[before[k]], both))) is not None:
                heappush(heap, (*got, before[k]))
        return [x for x in ids if x >= 0]


class Transducer:
    """Bytes of one piece in, tokens out once they are stable; it keeps less than ``lookahead + stride`` bytes, a token and what was pushed last."""

    def __init__(self, merges: Merges, lookahead: int, stride: int = STRIDE):
        self.merges, self.ahead, self.window = merges, lookahead, lookahead + stride
        self.rest = b""

    def push(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.window):
            self.rest += data[at : at + self.window]
            if len(self.rest) < self.window:
                break
            got, used = self._merged(), 0
            stable = len(self.rest) - self.ahead
            for i in got:
                size = len(self.merges.bytes_of[i])
                if used + size > stable:
                    break
                used += size
                out.append(i)
            self.rest = self.rest[used:]
        return out

    def finish(self) -> list[int]:
        got, self.rest = self._merged(), b""
        return got

    def _merged(self) -> list[int]:
        byte_id = self.merges.byte_id
        return self.merges.merge([byte_id[b] for b in self.rest])


_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE, _LETTER, _NUMBER, _OTHER, _ASK = range(5)


def _classes() -> np.ndarray:
    """Classes of all code points; those that Python's tables do not know are asked of the library when they occur."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    found = (unicodedata.category(chr(c)) for c in range(0x110000))
    out = np.fromiter((_ASK if g == "Cn" else kinds.get(g[0], _OTHER) for g in found), np.uint8, 0x110000)
    out[_SPACES] = _SPACE
    return out


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them; one for each worker process."""

    def __init__(self, name: str = VOCABULARY):
        self.name = name
        self.merges = Merges(name)
        self.ahead = self.merges.lookahead()
        #: bytes after a cut that can decide it: a special token, or three characters of a contraction
        self.hold = max([len(s) for s in self.merges.special] + [0]) + 16
        self.kind = _classes()
        self.table = tokens._Table()

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        got = self.kind[points]
        if (got == _ASK).any():
            from tokenizers import Tokenizer

            pieces = Tokenizer.from_file(public_tokenizers.path(self.name)).pre_tokenizer.pre_tokenize_str
            for c in np.unique(points[got == _ASK]).tolist():
                joins = [k for k, x in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")) if len(pieces(x + chr(c))) == 1]
                self.kind[c] = joins[0] if joins else _SPACE
            got = self.kind[points]
        return got

    def cuts(self, data: np.ndarray, offs: np.ndarray, inside: bool = False) -> np.ndarray:
        """Byte places at which pieces of these texts start; ``inside`` tells that the first text starts within a piece."""
        raw = data.tobytes()
        ascii_only = not (data & 0x80).any()
        points = data if ascii_only else np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
        n = len(points)
        if ascii_only:
            place = None
        else:
            place = np.zeros(n + 1, np.int64)
            np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=place[1:])
        edge = np.zeros(n + 2, bool)
        edge[offs if place is None else np.searchsorted(place, offs)] = True
        whole = []
        for s in self.merges.special:
            at = raw.find(s)
            while at >= 0:
                row = int(np.searchsorted(offs, at, "right"))
                if at + len(s) <= offs[row]:
                    whole.append((at, at + len(s)) if place is None else tuple(np.searchsorted(place, (at, at + len(s))).tolist()))
                    at = raw.find(s, at + len(s))
                else:
                    at = raw.find(s, at + 1)
        for a, b in whole:
            edge[[a, b]] = True
        edge[n] = True
        kind = self._kinds(points)
        start = edge[:n].copy()
        start[0] = True
        start[1:] |= kind[1:] != kind[:-1]
        space = kind == _SPACE
        last = np.zeros(n, bool)  # white space right before something else is cut off; a space joins what follows
        last[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
        start |= last
        start[np.flatnonzero(last & (points == 32)) + 1] = False
        if inside:
            start[0] = False
        quote = np.flatnonzero((points[:-1] == 39) & start[:-1] & ~edge[1:n])
        if len(quote):
            one = points[quote + 1]
            two = np.where(edge[quote + 2], 0, points[np.minimum(quote + 2, n - 1)])
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for at, more in ((quote[short], 2), (quote[long], 3)):
                start[at + 1] = False
                then = at + more
                start[then[then < n]] = True
        for a, b in whole:
            start[a + 1 : b] = False
        at = np.flatnonzero(start)
        return at if place is None else place[at]

    def _ids(self, data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each piece has."""
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, U64)
            np.cumsum(tokens._HASH[data] * core._power(core._STEP, "step", len(data)), out=total[1:])
            h = (total[stop] - total[first]) * core._power(core._BACK, "back", len(data))[first]
            h = core.mix64(h + (stop - first).astype(U64) * core._LEN) | U64(1)
        value = self.table.find(h)
        miss = np.flatnonzero(value < 0)
        if len(miss):
            new, one = np.unique(h[miss], return_index=True)
            one = miss[one]
            raw, ids, counts = data.tobytes(), [], []
            run = Transducer(self.merges, self.ahead)
            for a, b in zip(first[one].tolist(), stop[one].tolist(), strict=True):
                piece = raw[a:b]
                whole = self.merges.special.get(piece)
                got = [whole] if whole is not None else run.push(piece) + run.finish()
                ids += got
                counts.append(len(got))
            self.table.add(new, ids, counts)
            value[miss] = self.table.find(h[miss])
        length = self.table.count[value]
        ends = np.concatenate(([0], np.cumsum(length)))
        flat = self.table.ids[np.repeat(self.table.start[value] - ends[:-1], length) + np.arange(ends[-1])]
        self.table.trim()
        return flat, ends

    def rows(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts, one after the other, and where each text's ids end (one more entry than texts)."""
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(offs), np.int64)
        first = self.cuts(data, offs)
        flat, ends = self._ids(data, first, np.append(first[1:], len(data)))
        return flat, ends[np.searchsorted(first, offs)]

    def stream(self, parts: Iterator[bytes], limit: int = core.SLICE_BYTES) -> Iterator[np.ndarray]:
        """Ids of one text that comes in parts cut at characters; it keeps a part, and of a longer piece only unstable bytes."""
        rest, run = b"", None
        for part in parts:
            rest += part
            if not rest:
                continue
            data = np.frombuffer(rest, np.uint8)
            sure = len(rest) - self.hold
            first = self.cuts(data, np.array([0, len(rest)]), run is not None)
            first = first[first <= sure]
            if run is not None and len(first):  # the long piece ends
                yield np.array(run.push(rest[: first[0]]) + run.finish(), "<u4")
                run = None
            if run is None and len(first) > 1:
                yield self._ids(data[first[0] : first[-1]], first[:-1] - first[0], first[1:] - first[0])[0]
            rest = rest[first[-1] :] if len(first) else rest
            if len(rest) > limit + self.hold:  # a piece longer than a part: its bytes go to the transducer
                cut = len(rest) - self.hold
                while rest[cut] & 0xC0 == 0x80:
                    cut -= 1
                run = run or Transducer(self.merges, self.ahead)
                yield np.array(run.push(rest[:cut]), "<u4")
                rest = rest[cut:]
        if rest:
            data = np.frombuffer(rest, np.uint8)
            first = self.cuts(data, np.array([0, len(rest)]), run is not None)
            if run is not None:
                end = int(first[0]) if len(first) else len(rest)
                yield np.array(run.push(rest[:end]) + run.finish(), "<u4")
                data, first = data[end:], first - end
            if len(first):
                yield self._ids(data, first, np.append(first[1:], len(data)))[0]


def characters(data: np.ndarray, limit: int = core.SLICE_BYTES) -> Iterator[bytes]:
    """A long text in parts cut between characters."""
    at = 0
    while at < len(data):
        end = min(at + limit, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        yield data[at:end].tobytes()
        at = end


_encoders: dict[str, Encoder] = {}


def encoder(name: str = VOCABULARY) -> Encoder:
    """The encoder of this worker process; it outlives a task."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def _replaced(schema: T.StructType, old: str, new: T.StructField) -> T.StructType:
    if old not in schema.names:
        raise ValueError(f"no column {old}")
    if new.name != old and new.name in schema.names:
        raise ValueError(f"there is a column {new.name} already")
    return T.StructType([new if f.name == old else f for f in schema.fields])


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", name: str = VOCABULARY) -> DataFrame:
    """The table with the column ``ids`` (array of int) in place of the column ``text``; null gives an empty array."""
    core.prepare(docs.sparkSession)
    at = docs.columns.index(text) if text in docs.columns else -1
    schema = _replaced(docs.schema, text, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False))

    def run(batches):
        enc = encoder(name)
        for b in batches:
            flats, sizes = [], []
            for _, _, data, offs in core.text_slices(b.column(at)):
                if len(data) > 2 * core.SLICE_BYTES:  # one very long text
                    parts = list(enc.stream(characters(data)))
                    flats += parts
                    sizes.append(np.array([sum(map(len, parts))]))
                else:
                    flat, ends = enc.rows(data, offs)
                    flats.append(flat)
                    sizes.append(np.diff(ends))
            flat = np.concatenate(flats).astype("<i4", copy=False) if flats else np.zeros(0, "<i4")
            ends = np.concatenate(([0], *map(np.cumsum, [np.concatenate(sizes)] if sizes else []))).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([column if k == at else b.column(k) for k in range(b.num_columns)], schema.names)

    return docs.mapInArrow(core.tidy(run), schema)


class Decoder:
    """Tokens to text: a token's bytes go to a state machine that gives out characters once they are whole.

    Bytes that are no UTF-8 give U+FFFD, one for each longest start of a character, and ids that the vocabulary lacks give nothing.
    """

    def __init__(self, name: str = VOCABULARY):
        bytes_of = Merges(name).bytes_of
        size = max(bytes_of) + 2  # the last entry stands for ids that are not known
        of = [bytes_of.get(i, b"") for i in range(size)]
        self.length = np.array([len(x) for x in of], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(of), np.uint8)
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def bytes_(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of these tokens, and where each token's bytes end."""
        ids = np.where((ids < 0) | (ids >= len(self.length)), len(self.length) - 1, ids)
        length = self.length[ids]
        ends = np.concatenate(([0], np.cumsum(length)))
        return self.flat[np.repeat(self.start[ids] - ends[:-1], length) + np.arange(ends[-1])], ends

    def text(self, parts: Iterator[bytes]) -> str:
        self.machine.reset()
        return "".join([self.machine.decode(p) for p in parts] + [self.machine.decode(b"", True)])


_decoders: dict[str, Decoder] = {}


def decoder(name: str = VOCABULARY) -> Decoder:
    if name not in _decoders:
        _decoders[name] = Decoder(name)
    return _decoders[name]


def decode(tokens_: DataFrame, ids: str = "ids", text: str = "text", name: str = VOCABULARY) -> DataFrame:
    """The table with the column ``text`` in place of the column ``ids``; null and empty arrays give an empty text."""
    core.prepare(tokens_.sparkSession)
    at = tokens_.columns.index(ids) if ids in tokens_.columns else -1
    schema = _replaced(tokens_.schema, ids, T.StructField(text, T.StringType(), False))

    def run(batches):
        dec = decoder(name)
        for b in batches:
            lists = b.column(at)
            lists = pa.ListArray.from_arrays(pa.array([0], pa.int32()), pa.array([], pa.int32())) if not len(lists) else lists
            length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(pc.list_flatten(lists), -1).to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(length)))
            out, row = [], 0
            while row < len(length):
                more = max(row + 1, int(np.searchsorted(ends, ends[row] + DECODED, "right")) - 1)
                if more == row + 1:  # perhaps a long one: by parts
                    spans = range(int(ends[row]), int(ends[more]), DECODED)
                    out.append(dec.text(dec.bytes_(flat[a : min(a + DECODED, ends[more])])[0].tobytes() for a in spans))
                else:
                    data, at_byte = dec.bytes_(flat[ends[row] : ends[more]])
                    raw, cut = data.tobytes(), at_byte[ends[row : more + 1] - ends[row]].tolist()
                    out += [dec.text([raw[a:z]]) for a, z in zip(cut, cut[1:], strict=False)]
                row = more
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else b.column(k) for k in range(b.num_columns)], schema.names)

    return tokens_.mapInArrow(core.tidy(run), schema)


def ids_text(ids):
    """The ids in decimal, joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
