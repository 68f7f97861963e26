"""Line deduplication by a log-template tree.

Every line of at least LEAST words walks a tree of fixed depth: its number of words, then its LEAD first
words, where words with a digit stand for any value.  Within a leaf, lines that agree at SIMILAR or more of
their positions are one template.  Lines of n words may differ at ``floor((1 - SIMILAR) * n)`` positions, so
if the positions behind the lead are cut into one part more than that, two such lines have a part in common.
Lines are therefore compared, word by word, only with those of their leaf that share a part.  In each group
of a shared part a line is linked with every leader with which it agrees; one that agrees with none becomes a leader and is
linked with all earlier lines that agree with it.  A part that more than SLOT_LINES lines share is divided by the words
outside it: these are cut again into one piece more than may differ, so that agreeing lines still meet.
Templates are the components of these links (two lines that agree, neither of them a leader of a group, may have
their link only through others).  A leaf of up to LEAF_LINES lines is sent whole, each line once; a larger one is dealt
out by its parts, a line to each of them.  Nothing is sampled, and no size changes the rule.

A template recurs if it stands in two or more different documents, wherever it stands there.  Copies and
near copies of a document count as one: texts whose five-word shingles have a Jaccard similarity of 0.8 or more are
joined to groups.  Candidates share one of BANDS bands of ROWS minima with the group's first text, and each such
pair is verified on its whole sets, so texts that only share boilerplate stay different documents (of two texts with
similarity 0.8 about two in a thousand share no band).  So a document's lines do not recur because it was copied.  Recurring
templates are dropped from all documents but the first (the smallest key) that holds them.  Whether there are
two needs no count: the smallest and the largest group differ.

Lines end at newlines.  Shorter lines are never dropped.  Null texts stay null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core, jaccard
from .core import U64

LEAST, LEAD, SIMILAR = 4, 3, 0.7
SHINGLE, BANDS, ROWS, COPY = 5, 16, 4, 80
#: Lines that share a part above which they are divided further, and near copies that are verified in one task.
SLOT_LINES, HUB_TEXTS = 20_000, 20_000
#: Lines of a leaf, and bytes of their words, up to which one task looks at the whole leaf; bytes and rows that it makes of them at once.
LEAF_LINES, LEAF_BYTES = 1_000, 4 << 20
_MADE_BYTES, _MADE_ROWS = 2 << 20, 1 << 12
#: Recurring lines that may be sent to every task (a hash and a key each); more go by an exchange.
SENT = 2_000_000
#: Hashes that a task remembers so as not to give the same row twice; more only cost rows.
REMEMBERED = 1_000_000
#: Lines of a group up to which all its pairs are compared at once.
TOGETHER = 16
_ANY = U64(0x5F3759DF5F3759DF)
_SEEDS = core._stream(61, BANDS * ROWS)


def parse(data: np.ndarray, offs: np.ndarray):
    """Lines of many texts: (row, line number, words, leaf, member, (words, begin)) for every line, blank ones too; (exact words, rows)."""
    first, stop, rows = core.word_spans(data, offs)
    exact = core.span_hashes(data, first, stop)
    words = exact.copy()
    digits = np.flatnonzero(data - np.uint8(48) < 10)
    words[np.searchsorted(first, digits, "right") - 1] = _ANY
    newlines = np.flatnonzero(data == 10)
    base = np.searchsorted(newlines, offs[:-1])
    count = np.searchsorted(newlines, offs[1:]) - base + 1  # lines of each row
    ends = np.cumsum(count)
    row = np.repeat(np.arange(len(count)), count)
    number = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
    owner = np.repeat(np.arange(len(count)), np.diff(rows))
    before = np.cumsum(np.bincount(np.searchsorted(first, newlines), minlength=len(first) + 1))[: len(first)]  # newlines before each word
    line = (ends - count - base)[owner] + before
    size = np.bincount(line, minlength=len(row))
    begin = np.cumsum(size) - size
    at = np.arange(len(words)) - begin[line]
    with np.errstate(over="ignore"):
        placed = core.mix64(words + at.astype(U64) * U64(0x9E3779B97F4A7C15))
        total = np.concatenate((np.zeros(1, U64), np.cumsum(placed)))
        member = core.mix64(total[begin + size] - total[begin] + size.astype(U64))
        lead = np.minimum(size, LEAD)
        leaf = core.mix64(total[begin + lead] - total[begin] + size.astype(U64) * U64(0xD1B54A32D192ED03))
    return (row, number, size, leaf, member, (words, begin)), (exact, rows)


def _bands(words: np.ndarray, first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """BANDS hashes of each of the texts ``rows``: of minima of its shingles (a shorter text is one shingle)."""
    grams = core.gram_hashes(words, SHINGLE)
    out = np.zeros((len(rows), BANDS), U64)
    size = np.diff(first)[rows]
    long = np.flatnonzero(size >= SHINGLE)
    for i in np.flatnonzero((size > 0) & (size < SHINGLE)).tolist():
        r = rows[i]
        out[i] = core.mix64(_SEEDS[:BANDS] ^ U64(core.short_hash(words[first[r] : first[r + 1]])))
    if len(long):
        begin = first[:-1][rows[long]]
        # runs [begin, begin + size - 4) of the shingles, those across texts left out
        edges = np.stack([begin, begin + size[long] - SHINGLE + 1], 1).ravel()
        padded = np.append(grams, U64(0))
        mixed = np.empty_like(padded)
        for band in range(BANDS):
            with np.errstate(over="ignore"):
                h = np.zeros(len(long), U64)
                for k in range(ROWS):
                    np.bitwise_xor(padded, _SEEDS[band * ROWS + k], out=mixed)
                    np.multiply(mixed, core._LEN, out=mixed)
                    h = core.mix64(h * core._STEP + np.minimum.reduceat(mixed, edges)[::2])
            out[long, band] = h
    return out


_PARSED = "key {kind}, whole long, leaf long, member long, bands array<long>"


def _lines(batches):
    """Lines, and for each text with such lines its bands (leaf and member null)."""
    for b in batches:
        for at, end, data, offs in core.text_slices(b.column("text"), core.WORK_BYTES):
            (row, _, size, leaf, member, _), (words, first) = parse(data, offs)
            pick = np.flatnonzero(size >= LEAST)
            if not len(pick):
                continue
            key = b.column("key").slice(at, end - at)
            whole = b.column("whole").slice(at, end - at)
            own = pa.array(row[pick])
            yield pa.RecordBatch.from_arrays([key.take(own), whole.take(own), *(pa.array(core.signed(x[pick])) for x in (leaf, member)), pa.nulls(len(pick), pa.list_(pa.int64()))], ["key", "whole", "leaf", "member", "bands"])
            texts = np.unique(row[pick])
            n = len(texts)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(core.signed(_bands(words, first, texts).ravel())))
            yield pa.RecordBatch.from_arrays([pa.nulls(n, key.type), whole.take(pa.array(texts)), *[pa.nulls(n, pa.int64())] * 2, bands], ["key", "whole", "leaf", "member", "bands"])


def _sets(wanted):
    """(whole, tokens): the sorted shingle hashes of wanted texts."""

    def run(batches):
        bits = np.frombuffer(wanted.value, np.uint8)
        seen: set[int] = set()
        for b in batches:
            whole = b.column("whole").to_numpy()
            x = whole.view(U64) % U64(jaccard.FILTER_BITS)
            mine = (bits[(x >> U64(3)).astype(np.int64)] >> (x & U64(7)).astype(np.uint8) & 1) > 0
            mine &= np.fromiter((w not in seen for w in whole.tolist()), bool, len(whole))
            pick = np.flatnonzero(mine)
            if len(seen) < REMEMBERED:
                seen.update(whole[pick].tolist())
            texts = b.column("text").take(pa.array(pick))
            blobs = [t.tobytes() for t in jaccard.shingle_sets(texts, SHINGLE)]
            yield pa.RecordBatch.from_arrays([pa.array(whole[pick]), pa.array(blobs, pa.binary())], ["whole", "tokens"])

    return run


def _verified(batches):
    """Links (a, b) of hubs and texts whose sets are alike; rows sorted by hub and part, the hub's own set first."""
    now, base = None, np.zeros(0, U64)
    for b in batches:
        out = []
        for hub, part, side, whole, raw in zip(*(b.column(c).to_pylist() for c in ("hub", "part", "side", "whole", "tokens")), strict=True):
            x = np.frombuffer(raw, U64)
            if side == 0:
                now, base = (hub, part), x
            elif now == (hub, part) and len(base) and len(x):
                common = int((base[np.minimum(np.searchsorted(base, x), len(base) - 1)] == x).sum())
                if 100 * common >= COPY * (len(base) + len(x) - common):
                    out.append((hub, whole))
        cols = list(zip(*out, strict=True)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])


def _groups(parsed: DataFrame, texts: DataFrame) -> DataFrame:
    """(whole, group) of the texts that have near copies: ``group`` is the smallest hash of its texts."""
    spark = parsed.sparkSession
    # the hash of a band holds its number; both sides of the join read one exchange
    bands = parsed.filter("bands is not null").select("whole", "bands").dropDuplicates(["whole"]).select("whole", F.explode("bands").alias("value")).repartition("value")
    least = bands.groupBy("value").agg(F.min("whole").alias("hub"), F.max("whole").alias("last")).filter("hub < last").drop("last")
    pairs = core.keep(bands.join(least, "value").filter("whole <> hub").select("hub", "whole").distinct(), "near")
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_TEXTS).cast("int").alias("parts"))
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("hub").alias("whole"))
    others = pairs.join(parts, "hub").select("hub", F.pmod(F.xxhash64("whole"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), "whole")
    placed = hubs.union(others)
    wanted = core.send(spark, jaccard.filter_bits(placed.select(F.col("whole").alias("sig")).distinct()))
    sets = texts.select("whole", "text").mapInArrow(core.tidy(_sets(wanted)), "whole long, tokens binary").groupBy("whole").agg(F.first("tokens").alias("tokens"))
    dealt = placed.join(sets.hint("merge"), "whole").repartition("hub", "part").sortWithinPartitions("hub", "part", "side", "whole")
    edges = dealt.select("hub", "part", "side", "whole", "tokens").mapInArrow(core.tidy(_verified), "a long, b long")
    return jaccard.components(edges).select(F.col("node").alias("whole"), F.col("component").alias("group"))


def _words(wanted):
    """The words of the lines of wanted leaves: (member, leaf, words)."""

    def run(batches):
        bits = np.frombuffer(wanted.value, np.uint8)
        seen: set[int] = set()
        for b in batches:
            out = []
            for _, _, data, offs in core.text_slices(b.column("text"), core.WORK_BYTES):
                _, _, size, leaf, member, (words, begin) = parse(data, offs)[0]
                x = leaf % U64(jaccard.FILTER_BITS)
                pick = np.flatnonzero((size >= LEAST) & ((bits[(x >> U64(3)).astype(np.int64)] >> (x & U64(7)).astype(np.uint8) & 1) > 0))
                for i, m in zip(pick.tolist(), core.signed(member[pick]).tolist(), strict=True):
                    if m not in seen:
                        if len(seen) < REMEMBERED:
                            seen.add(m)
                        out.append((m, int(leaf[i].view(np.int64)), words[begin[i] : begin[i] + size[i]].tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.binary()], strict=True)], ["member", "leaf", "words"])

    return run


def allowed(n: int) -> int:
    """Positions at which two lines of n words of one template may differ."""
    return int((1 - SIMILAR) * n + 1e-9)


def _cut(w: np.ndarray, leaf) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of a line begin and end, and their hashes, which hold the leaf, the part's number and its words.

    ``w`` may be a table of lines of one length, with a column of leaves.
    """
    n = w.shape[-1]
    k = allowed(n) + 1
    cut = LEAD + np.arange(k + 1) * (n - LEAD) // k
    with np.errstate(over="ignore"):
        total = np.zeros((*w.shape[:-1], n + 1), U64)
        np.cumsum(core.mix64(w + np.arange(n, dtype=U64) * core._STEP), -1, out=total[..., 1:])
        return cut, core.mix64(total[..., cut[1:]] - total[..., cut[:-1]] + np.int64(leaf).view(U64) + np.arange(1, k + 1, dtype=U64) * core._LEN)


def _parts(batches):
    """(part, member) for the parts of each line."""
    for b in batches:
        parts, owners = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for m, leaf, raw in zip(*(b.column(c).to_pylist() for c in ("member", "leaf", "words")), strict=True):
            h = _cut(np.frombuffer(raw, U64), leaf)[1]
            parts.append(h)
            owners.append(np.full(len(h), m))
        yield pa.RecordBatch.from_arrays([pa.array(core.signed(np.concatenate(parts))), pa.array(np.concatenate(owners))], ["part", "member"])


def _slots(batches):
    """(slot, member, words): a line in the group of its part; where the part has many lines, in those of pieces of its other words.

    Lines whose other words are no more than may differ all agree, so their group stays whole.
    """
    for b in batches:
        few = pa.array(b.column("n").to_numpy() <= SLOT_LINES)
        cold, hot = b.filter(few), b.filter(pc.invert(few))
        yield pa.RecordBatch.from_arrays([cold.column(c) for c in ("part", "member", "words")], ["slot", "member", "words"])
        out = []
        for part, member, leaf, raw in zip(*(hot.column(c).to_pylist() for c in ("part", "member", "leaf", "words")), strict=True):
            w = np.frombuffer(raw, U64)
            may = allowed(len(w))
            cut, parts = _cut(w, leaf)
            i = int(np.flatnonzero(core.signed(parts) == part)[0])
            rest = np.concatenate((w[LEAD : cut[i]], w[cut[i + 1] :]))
            if len(rest) <= may:
                out.append((part, member, raw))
                continue
            with np.errstate(over="ignore"):
                total = np.concatenate((np.zeros(1, U64), np.cumsum(core.mix64(rest + np.arange(len(rest), dtype=U64) * core._STEP))))
                at = np.arange(may + 2) * len(rest) // (may + 1)
                pieces = core.mix64(total[at[1:]] - total[at[:-1]] + np.int64(part).view(U64) + np.arange(1, may + 2, dtype=U64) * core._LEN)
            out += [(x, member, raw) for x in core.signed(pieces).tolist()]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.binary()], strict=True)], ["slot", "member", "words"])


def _flat(raw: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all lines, and where each line's begin and how many they are."""
    offs = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    return np.frombuffer(raw.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(U64), (offs[:-1] - offs[0]) // 8, np.diff(offs) // 8


def _shared(b: pa.RecordBatch):
    """(slot, member, words) of whole leaves: their lines in the groups of all parts that two or more share, sorted as for :func:`_alike`."""
    member, raw = b.column("member"), b.column("words")
    flat, begin, size = _flat(raw)
    leaf, names = b.column("leaf").to_numpy(), member.to_numpy()
    slot, owner = [], []
    for n in np.unique(size).tolist():
        mine, step = np.flatnonzero(size == n), max(1, (1 << 18) // n)
        for x in range(0, len(mine), step):
            own = mine[x : x + step]
            parts = _cut(flat[begin[own][:, None] + np.arange(n)], leaf[own][:, None])[1]
            slot.append(parts.ravel())
            owner.append(np.repeat(own, parts.shape[1]))
    slot, owner = core.signed(np.concatenate(slot)), np.concatenate(owner)
    order = np.lexsort((names[owner], size[owner], slot))
    slot, owner = slot[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
    many = np.diff(np.append(first, len(slot)))
    pick = np.repeat(many > 1, many)
    slot, owner = slot[pick], owner[pick]
    upto, at = np.cumsum(size[owner] * 8), 0
    while at < len(slot):
        most = (upto[at - 1] if at else 0) + _MADE_BYTES
        end = max(at + 1, min(at + _MADE_ROWS, int(np.searchsorted(upto, most, "right"))))
        own = pa.array(owner[at:end])
        yield pa.RecordBatch.from_arrays([pa.array(slot[at:end]), member.take(own), raw.take(own)], ["slot", "member", "words"])
        at = end


def _leaf_slots(batches):
    """:func:`_shared` for lines sorted by leaf: the last leaf of a batch waits for the next."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        leaf = b.column("leaf").to_numpy()
        last = int(np.searchsorted(leaf, leaf[-1]))
        if last:
            yield from _shared(b.slice(0, last))
        held = b.slice(last)
    if held is not None:
        yield from _shared(held)


class _Lines:
    """Lines of one length with their names, for comparing another with all of them."""

    def __init__(self, size: int):
        self.table, self.names = np.zeros((4, size), U64), []

    def alike(self, w: np.ndarray) -> list[int]:
        n = len(self.names)
        return [self.names[i] for i in np.flatnonzero((self.table[:n] != w).sum(1) <= allowed(len(w))).tolist()] if n else []

    def add(self, name: int, w: np.ndarray) -> None:
        if len(self.names) == len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[len(self.names)] = w
        self.names.append(name)


def _small(b: pa.RecordBatch) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links of the groups of at most TOGETHER lines that begin and end in the batch, and which rows are theirs."""
    slot, member, raw = (b.column(c) for c in ("slot", "member", "words"))
    slot, rows = slot.to_numpy(), len(slot)
    small = np.zeros(rows, bool)
    if rows < 3:
        return [], small
    flat, begin, size = _flat(raw)
    first = np.flatnonzero(np.concatenate(([True], (slot[1:] != slot[:-1]) | (size[1:] != size[:-1]))))
    many = np.diff(np.append(first, rows))
    inside = many <= TOGETHER
    inside[[0, -1]] = False  # these may go on in the batches beside
    small[np.repeat(inside, many)] = True
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(2, TOGETHER + 1):
        at = first[inside & (many == k)][:, None]
        i, j = np.triu_indices(k, 1)
        left.append((at + i).ravel())
        right.append((at + j).ravel())
    left, right = np.concatenate(left), np.concatenate(right)
    agree = np.zeros(len(left), bool)
    for n in np.unique(size[left]).tolist():
        mine, step = np.flatnonzero(size[left] == n), max(1, (1 << 18) // n)
        for x in range(0, len(mine), step):
            own = mine[x : x + step]
            p, q = (begin[side[own]][:, None] + np.arange(n) for side in (left, right))
            agree[own] = (flat[p] != flat[q]).sum(1) <= allowed(n)
    left, right = left[agree], right[agree]
    order = np.lexsort((left, right))
    earlier: dict[int, list[int]] = {}
    for i, j in zip(left[order].tolist(), right[order].tolist(), strict=True):
        earlier.setdefault(j, []).append(i)
    names, follows, out = member.to_pylist(), set(), []
    for j, found in earlier.items():
        leaders = [i for i in found if i not in follows]
        if leaders:
            follows.add(j)
        out += [(names[i], names[j]) for i in leaders or found]
    return out, small


def _alike(batches):
    """Links (a, b) of the lines of each slot: of a line with all leaders that it agrees with, and of a new leader with all lines before it.

    Small groups that lie inside a batch are compared together; others line by line, with what is known of the group.
    """
    now, size = None, 0
    for b in batches:
        linked, small = _small(b)
        out = linked
        rest = b.filter(pa.array(~small))
        for slot, member, raw in zip(*(rest.column(c).to_pylist() for c in ("slot", "member", "words")), strict=True):
            w = np.frombuffer(raw, U64)
            if slot != now or size != len(w):
                now, size = slot, len(w)
                leaders, others = _Lines(size), _Lines(size)
            found = leaders.alike(w)
            if found:
                others.add(member, w)
            else:
                found = others.alike(w)
                leaders.add(member, w)
            out += [(x, member) for x in found]
        cols = list(zip(*out, strict=True)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])


def _within(batches):
    """Links of the lines of whole leaves, sorted by leaf."""
    yield from _alike(_leaf_slots(batches))


def _by_part(words: DataFrame) -> DataFrame:
    """Links of lines of large leaves, each sent to all parts that it shares."""
    parts = core.keep(words.mapInArrow(core.tidy(_parts), "part long, member long"), "line-parts")
    shared = parts.groupBy("part").agg(F.count("*").alias("n")).filter("n > 1")
    met = parts.join(shared, "part").join(words.hint("merge"), "member").select("part", "n", "member", "leaf", "words").mapInArrow(core.tidy(_slots), "slot long, member long, words binary")
    dealt = met.repartition("slot").sortWithinPartitions("slot", F.octet_length("words"), "member")
    return dealt.mapInArrow(core.tidy(_alike), "a long, b long")


def _links(words: DataFrame) -> DataFrame:
    """(a, b): the lines that agree, of lines (member, leaf, words)."""
    sizes = words.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.octet_length("words")).alias("bytes"))
    large = core.keep(sizes.filter((F.col("n") > min(LEAF_LINES, SLOT_LINES)) | (F.col("bytes") > LEAF_BYTES)).select("leaf"), "large-leaves")
    some = bool(large.take(1))
    small = words.join(large, "leaf", "left_anti") if some else words
    links = small.select("leaf", "member", "words").repartition("leaf").sortWithinPartitions("leaf").mapInArrow(core.tidy(_within), "a long, b long")
    return links.union(_by_part(core.keep(words.join(large, "leaf", "left_semi"), "large-words"))) if some else links


def recurring(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(member, template, first): the lines of recurring templates and the smallest key that holds each."""
    spark = docs.sparkSession
    core.prepare(spark)
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("whole"))
    parsed = core.keep(texts.mapInArrow(core.tidy(_lines), _PARSED.format(kind=kind)), "parsed")
    group = core.keep(_groups(parsed, texts), "groups")
    span = [F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first")]
    held = parsed.filter("member is not null").select("key", "whole", "leaf", "member")
    named = held.join(group.hint("merge"), "whole", "left").withColumn("low", F.coalesce("group", "whole"))
    heads = core.keep(named.groupBy("leaf", "member").agg(F.min("low").alias("low"), F.max("low").alias("high"), F.min("key").alias("first")), "heads")
    leaves = heads.groupBy("leaf").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("member").alias("one"), F.max("member").alias("other")).filter("low < high")
    leaves = core.keep(leaves.select("leaf", F.expr("one < other").alias("mixed")), "leaves")
    mixed = leaves.filter("mixed").select(F.col("leaf").alias("sig"))
    wanted = core.send(spark, jaccard.filter_bits(mixed))
    # lines of leaves that hold different lines, with all their words
    words = texts.select("text").mapInArrow(core.tidy(_words(wanted)), "member long, leaf long, words binary").groupBy("member", "leaf").agg(F.first("words").alias("words"))
    words = core.keep(words.join(mixed.select(F.col("sig").alias("leaf")), "leaf", "left_semi"), "words")
    links = core.keep(_links(words), "links")
    template = jaccard.components(links).select(F.col("node").alias("member"), F.col("component").alias("template"))
    core.drop_kept(parsed)
    busy = heads.join(leaves.select("leaf"), "leaf", "left_semi").join(template.hint("merge"), "member", "left").withColumn("template", F.coalesce("template", "member"))
    busy = core.keep(busy, "busy")
    core.drop_kept(heads)
    found = busy.groupBy("template").agg(*span).filter("low < high").select("template", "first")
    return core.keep(busy.select("member", "template").join(found, "template"), "recurring")


def _strip(columns, at, schema, drop):
    """Rewrites texts; ``drop(batch, row, number, member)`` tells which lines go."""

    def run(batches):
        for b in batches:
            texts = b.column(at)
            lines, gone, new = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), {}
            for a, e, data, offs in core.text_slices(texts, core.WORK_BYTES):
                row, number, size, _, member, _ = parse(data, offs)[0]
                away = np.flatnonzero((size >= LEAST) & drop(b, row + a, number, member))
                per: dict[int, set] = {}
                for r, k in zip(row[away].tolist(), number[away].tolist(), strict=True):
                    per.setdefault(r, set()).add(k)
                lines[a:e] = np.bincount(row, minlength=e - a)
                for r, g in per.items():
                    gone[a + r] = len(g)
                    new[a + r] = "\n".join(x for k, x in enumerate(texts[a + r].as_py().split("\n")) if k not in g)
            if new:
                changed = np.zeros(len(texts), bool)
                changed[list(new)] = True
                texts = pc.replace_with_mask(texts, pa.array(changed), pa.array([new[r] for r in sorted(new)], texts.type))
            cols = [texts if i == at else b.column(i) for i in range(columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines), pa.array(gone)], schema)

    return run


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with recurring lines taken out of the text, and the columns n_lines and n_dropped (in place of such columns of its own).

    Every row stays, also when all its lines went (its text is then empty); a null text has one line and is
    null.  Rows of the first key that holds a template keep it.  Null keys never are the first.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    gone = recurring(docs, key, text)
    names = docs.columns
    at = names.index(text)
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    fields = [f"c{i}" for i in range(len(names))]
    k = fields[names.index(key)]
    ki = names.index(key)
    schema = ", ".join([*(f"{f} {x.dataType.simpleString()}" for f, x in zip(fields, docs.schema, strict=True)), "n_lines long, n_dropped long"])
    out_names = [*fields, "n_lines", "n_dropped"]
    if gone.count() <= SENT:
        table = gone.toArrow()
        order = np.argsort(table.column("member").to_numpy())
        first = table.column("first").to_pylist()
        shared = core.send(spark, (table.column("member").to_numpy()[order], [first[i] for i in order.tolist()]))

        def drop(b, row, number, member):
            members, firsts = shared.value
            out = np.zeros(len(row), bool)
            if len(members):
                m = core.signed(member)
                p = np.minimum(np.searchsorted(members, m), len(members) - 1)
                keys = b.column(ki).to_pylist()
                for i in np.flatnonzero(members[p] == m).tolist():
                    out[i] = keys[row[i]] != firsts[p[i]]
            return out

        done = inner.mapInArrow(core.tidy(_strip(len(names), at, out_names, drop)), schema)
    else:
        ct = f"c{at}"

        def where(batches):
            for b in batches:
                for a, e, data, offs in core.text_slices(b.column("text"), core.WORK_BYTES):
                    row, number, size, _, member, _ = parse(data, offs)[0]
                    pick = np.flatnonzero(size >= LEAST)
                    yield pa.RecordBatch.from_arrays([b.column("key").slice(a, e - a).take(pa.array(row[pick])), b.column("whole").slice(a, e - a).take(pa.array(row[pick])), pa.array(core.signed(member[pick]))], ["key", "whole", "member"])

        whole = F.xxhash64(F.coalesce(F.col(k).cast("string"), F.lit("")), F.col(ct))
        kind = docs.schema[key].dataType.simpleString()
        hits = inner.select(F.col(k).alias("key"), whole.alias("whole"), F.col(ct).alias("text")).mapInArrow(where, f"key {kind}, whole long, member long").join(gone, "member").filter(~F.col("key").eqNullSafe(F.col("first")))
        lists = hits.groupBy("whole").agg(F.collect_set("member").alias("members"))
        joined = inner.withColumn("whole", whole).join(lists, "whole", "left").select(*fields, "members")
        mi = len(fields)

        def drop(b, row, number, member):
            held = b.column(mi).to_pylist()
            m = core.signed(member).tolist()
            sets = [set(x) if x else None for x in held]
            return np.array([sets[r] is not None and x in sets[r] for r, x in zip(row.tolist(), m, strict=True)], bool)

        done = joined.mapInArrow(core.tidy(_strip(len(names), at, out_names, drop)), schema)
    return done.toDF(*names, "n_lines", "n_dropped")
