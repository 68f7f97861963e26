"""N-gram Jaccard join by filtering under several global token orders.

A document's set holds the hashes of its distinct shingles.  Under any global order of the tokens,
two sets with Jaccard at least t share a token among the first ``n - ceil(t * n) + 1`` of each.  A
pair is therefore a candidate only if it shares prefix tokens under *every* one of several orders:

* order 1 (with the shorter prefix for the smaller set of a pair) ranks frequent tokens last (ties and all other tokens by hash), so that passages common to
  many documents stay out of the prefixes.  Its postings are exchanged in packed blocks and grouped
  by token;
* orders 2 and 3 rank by re-seeded hashes.

The filters of the three orders are intersected pair by pair; only pairs that share a prefix token under each
of them have their sets intersected exactly.

Documents with equal sets are one node from the start, so groups of exact copies cost one node.
Posting lists of order 1 are not expanded into pairs: each joins its members, in order of
set size, to their neighbours, which is enough to tell clusters, the components of the candidate graph.  Any two candidates of order 1 are in one
cluster.

Most clusters are chains of texts that share a rare passage and are no near duplicates, and their sets would be most of what is
sent.  So clusters are first refined by *sketches*, about one or two bits for each token: bit ``token mod bits`` is the parity of the
tokens there, so two sketches differ in at most as many bits as the sets do in tokens, and a pair whose sketches differ in
more bits than a link allows is none.  The components of the pairs left are the clusters whose sets are sent.  No link is lost.

A cluster's sets are sent to one task (a large cluster is split to blocks of BLOCK_BYTES and
BLOCK_SETS at most, each pair of blocks a task), which intersects the three filters of every pair and the sets
of the pairs left in memory, skips pairs that verified links have already joined, and returns a spanning
forest of the links.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core
from .core import U64

#: Shingles that occur this often in one block of BLOCK shingles are counted for the frequency order.
LOCAL_COUNT = 2
BLOCK = 8_000_000
#: Postings that a task packs at a time, and sets that it remembers so as not to send them twice.
PACKED, REMEMBERED = 500_000, 200_000
#: The frequency order knows at most so many of the most frequent shingles (16 bytes each, broadcast).
KNOWN = 1 << 21
#: Bits of the filter that spares most documents without candidates from being sent again.
FILTER_BITS = 1 << 24
#: Marks postings beyond the prefix of the smaller set of a pair.
PROBE = np.uint32(1 << 31)
#: Most bits of a sketch.
SKETCH_BITS = 1 << 16
#: Bytes and number of the sets (or sketches) of a block of a large cluster.
BLOCK_BYTES, BLOCK_SETS = 32 << 20, 20_000


def prefix_length(n: np.ndarray | int, percent: int):
    return n - (n * percent + 99) // 100 + 1


def index_length(n: int, percent: int) -> int:
    """Prefix of the smaller set of a pair: it alone has this many tokens less than any link can lack."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def shingle_sets(column: pa.Array, size: int):
    """For each row its sorted distinct shingle hashes (empty without words)."""
    for _, _, data, offs in core.text_slices(column, core.WORK_BYTES):
        words, rows = core.word_hashes(data, offs)
        grams = core.gram_hashes(words, size)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            if b - a >= size:
                x = np.sort(grams[a : b - size + 1])
                yield x[np.concatenate(([True], x[1:] != x[:-1]))]
            elif b > a:
                yield np.array([core.short_hash(words[a:b])], U64)
            else:
                yield np.zeros(0, U64)


def signature(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), len(tokens))


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens by their low bits, of 64 bits or the power of two from their number on, SKETCH_BITS at most."""
    bits = min(SKETCH_BITS, max(64, 1 << (len(tokens) - 1).bit_length()))
    return np.packbits(np.bincount((tokens & U64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _frequent(size: int):
    def run(batches):
        held, count = [], 0

        def out():
            x, c = np.unique(np.concatenate(held), return_counts=True)
            some = c >= LOCAL_COUNT
            return pa.RecordBatch.from_arrays([pa.array(core.signed(x[some])), pa.array(c[some].astype(np.int64))], ["token", "n"])

        for b in batches:
            for s in shingle_sets(b.column("text"), size):
                held.append(s)
                count += len(s)
                if count >= BLOCK:
                    yield out()
                    held, count = [], 0
        if held:
            yield out()

    return run


def _order(tokens: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The tokens in order 1: those of unknown frequency by hash, then known ones by count and hash."""
    if not len(known):
        return tokens
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    hit = known[at] == tokens
    if not hit.any():
        return tokens
    c = np.where(hit, counts[at], 0)
    return tokens[np.lexsort((tokens, c))]


def _postings(size: int, percent: int, blocks: int, table):
    def run(batches):
        known, counts = table.value
        sigs, sizes, toks = [], [], []
        rows, seen = 0, set()

        def out():
            lens = np.array([len(t) for t in toks])
            t = np.concatenate(toks)
            s = np.repeat(np.array(sigs, U64), lens)
            n = np.concatenate(sizes)
            block = ((t >> U64(32)) * U64(blocks)) >> U64(32)
            o = np.argsort(block, kind="stable")
            ids, first = np.unique(block[o], return_index=True)
            cut = [*first.tolist(), len(o)]
            parts = [o[a:b] for a, b in zip(cut, cut[1:], strict=False)]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids.astype(np.int32)), pa.array([t[p].tobytes() for p in parts]), pa.array([s[p].tobytes() for p in parts]), pa.array([n[p].tobytes() for p in parts])],
                ["block", "tokens", "sigs", "sizes"],
            )

        for b in batches:
            for x in shingle_sets(b.column("text"), size):
                if not len(x) or (g := signature(x)) in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(g)
                p = int(prefix_length(len(x), percent))
                sigs.append(g)
                own = np.full(p, len(x), np.uint32)
                own[index_length(len(x), percent) :] |= PROBE
                sizes.append(own)
                toks.append(_order(x, known, counts)[:p])
                rows += p
                if rows >= PACKED:
                    yield out()
                    sigs, sizes, toks, rows = [], [], [], 0
        if toks:
            yield out()

    return run


def _lists(percent: int):
    """Groups a block's postings by token; gives pairs (a, b) that join the members of every list.

    A list is sorted by set size.  Of two candidates the smaller one has the token in its short (index)
    prefix, so every member is joined to the index member before it, if their sizes allow a link.  If they
    do for an earlier index member, they do for all between, so its candidates are all joined.
    """

    def run(batches):
        got: dict[int, list] = {}
        for b in batches:
            for k, t, s, n in zip(b.column("block").to_pylist(), b.column("tokens"), b.column("sigs"), b.column("sizes"), strict=True):
                got.setdefault(k, []).append((np.frombuffer(t.as_buffer(), U64), np.frombuffer(s.as_buffer(), U64), np.frombuffer(n.as_buffer(), np.uint32)))
        for k in list(got):
            t, s, n = (np.concatenate(x) for x in zip(*got.pop(k), strict=True))
            probe, n = n >= PROBE, (n & ~PROBE).astype(np.int64)
            o = np.lexsort((s, n, t))
            t, s, n, probe = t[o], s[o], n[o], probe[o]
            at = np.maximum.accumulate(np.where(probe, -1, np.arange(len(t))))[:-1]
            pair = (at >= 0) & (t[at] == t[1:]) & (s[at] != s[1:]) & (100 * n[at] >= percent * n[1:])
            a, b = s[at[pair]], s[1:][pair]
            if len(a):
                o = np.lexsort((b, a))
                a, b = a[o], b[o]
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(core.signed(a[new])), pa.array(core.signed(b[new]))], ["a", "b"])

    return run


def _filter_bits(batches):
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for b in batches:
        x = b.column("sig").to_numpy().view(U64) % U64(FILTER_BITS)
        np.bitwise_or.at(bits, (x >> U64(3)).astype(np.int64), (np.uint8(1) << (x & U64(7)).astype(np.uint8)))
    if bits.any():
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], ["bits"])


def filter_bits(hashes: DataFrame) -> bytes:
    """FILTER_BITS bits, those of the hashes ``sig`` set: a bounded filter that spares most rows without one."""
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in hashes.select("sig").coalesce(16).mapInArrow(_filter_bits, "bits binary").toLocalIterator():
        bits |= np.frombuffer(zlib.decompress(r[0]), np.uint8)
    return bits.tobytes()


def _sets(size: int, wanted):
    def run(batches):
        bits = np.frombuffer(wanted.value, np.uint8)
        seen = set()
        for b in batches:
            sig, blob, held = [], [], 0
            for x in shingle_sets(b.column("text"), size):
                if not len(x):
                    continue
                g = signature(x)
                h = g % FILTER_BITS
                if g in seen or not bits[h >> 3] >> (h & 7) & 1:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(g)
                sig.append(g)
                blob.append(x.tobytes())
                held += x.nbytes
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(core.signed(np.array(sig, U64))), pa.array(blob, pa.binary())], ["sig", "tokens"])
                    sig, blob, held = [], [], 0
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(core.signed(np.array(sig, U64))), pa.array(blob, pa.binary())], ["sig", "tokens"])

    return run


class _Lists:
    """Posting lists of the token sets of one task, for counting what a set has in common with all others."""

    def __init__(self, sets: list[np.ndarray]):
        n = np.array([len(x) for x in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable").astype(np.int32)
        tokens = tokens[order]
        new = np.concatenate(([True], tokens[1:] != tokens[:-1]))
        del tokens
        self.number = np.empty(len(order), np.int32)
        self.number[order] = np.cumsum(new, dtype=np.int32) - 1
        self.first = np.append(np.flatnonzero(new), len(order))
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), n)[order]
        self.at = np.concatenate(([0], np.cumsum(n)))
        self.m = len(sets)

    def common(self, i: int) -> np.ndarray:
        t = self.number[self.at[i] : self.at[i + 1]]
        out = np.zeros(self.m, np.int64)
        have = self.first[t + 1] - self.first[t]
        ends = np.cumsum(have)
        cut = 0
        while cut < len(t):  # some million entries at a time
            end = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + 4_000_000, "right")))
            h = have[cut:end]
            e = np.cumsum(h)
            out += np.bincount(self.owner[np.repeat(self.first[t[cut:end]] - (e - h), h) + np.arange(e[-1])], minlength=self.m)
            cut = end
        return out


def _prefixes(sets: list[np.ndarray], percent: int, seed: int) -> _Lists:
    """Lists of the prefixes under the order of re-seeded hashes."""
    salt = U64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    out = []
    for x in sets:
        h = core.mix64(x ^ salt)
        p = int(prefix_length(len(x), percent))
        out.append(np.partition(h, p - 1)[:p] if p < len(h) else h)
    return _Lists(out)


def _alike(sigs: np.ndarray, side: np.ndarray, n: np.ndarray, sketches: list[bytes], percent: int, cross: bool):
    """Edges that join what pairs of sketches that can belong to a link join; of two blocks (``cross``) only pairs of different sides count."""
    o = np.lexsort((sigs, n))
    sigs, side, n, sketches = sigs[o], side[o], n[o], [sketches[i] for i in o.tolist()]
    width = np.array([len(x) // 8 for x in sketches])  # grows with n
    first = np.searchsorted(width, np.unique(width)).tolist()
    last = [*first[1:], len(n)]
    words = {int(width[a]): np.frombuffer(b"".join(sketches[a:b]), U64).reshape(b - a, -1) for a, b in zip(first, last, strict=True)}
    start = {int(width[a]): a for a in first}
    folded = {w: words[2 * w][:, :w] ^ words[2 * w][:, w:] for w in words if 2 * w in words}
    end = np.searchsorted(n, 100 * n // percent, "right").tolist()  # sizes up to there can link; they are of the same width or twice as wide
    root = np.arange(len(n))
    out = []
    for i, (w, upto) in enumerate(zip(width.tolist(), end, strict=True)):
        for at, m in ((start[w], words[w]), (start.get(2 * w), folded.get(w))):
            if m is None or upto <= max(at, i + 1):
                continue
            lo = max(at, i + 1)
            j = np.arange(lo, min(upto, at + len(m)))
            ok = root[j] != root[i]
            if cross:
                ok &= side[j] != side[i]
            j = j[ok]
            if not len(j):
                continue
            both = n[i] + n[j]
            apart = both - 2 * (-(-percent * both // (100 + percent)))
            j = j[np.bitwise_count(m[j - at] ^ words[w][i - start[w]]).sum(axis=1, dtype=np.int64) <= apart]
            if len(j):
                met, at_first = np.unique(root[j], return_index=True)
                out += [(int(sigs[i]), int(x)) for x in sigs[j[at_first]]]
                root[np.isin(root, met)] = root[i]
    return out


def _refined(percent: int):
    """Edges of the pairs of a task's sketches that can belong to a link; rows come sorted by their task's name."""
    names = ("cluster", "i", "j", "sig", "side", "n", "sketch")

    def run(batches):
        def done(held):
            sig, side, n, sketches = zip(*held, strict=True)
            links = _alike(np.array(sig), np.array(side), np.array(n), list(sketches), percent, name[1] != name[2]) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

        name, held = None, []
        for b in batches:
            for c, i, j, *row in zip(*(b.column(k).to_pylist() for k in names), strict=True):
                if (c, i, j) != name:
                    if held:
                        yield done(held)
                    name, held = (c, i, j), []
                held.append(row)
        if held:
            yield done(held)

    return run


def _placed(own: DataFrame, size) -> DataFrame:
    """Rows of clusters dealt to tasks (cluster, i, j): a cluster of blocks of bounded ``size`` has one for each pair of its blocks."""
    parts = own.groupBy("cluster").agg(F.greatest(F.ceil(F.sum(size) / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("parts"))
    dealt = own.join(parts.hint("merge"), "cluster").withColumn("own", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(*own.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))


def _joined(sigs: list[int], side: np.ndarray, sets: list[np.ndarray], percent: int, cross: bool, known: np.ndarray, counts: np.ndarray):
    """Links that join the sets of a cluster; of two blocks (``cross``) only pairs of different sides count."""
    n = np.array([len(x) for x in sets])
    root = np.arange(len(sets))
    first = _Lists([_order(x, known, counts)[: int(prefix_length(len(x), percent))] for x in sets])
    filters = [first, _prefixes(sets, percent, 2), _prefixes(sets, percent, 3)]
    whole = _Lists(sets)
    out = []
    for i in range(len(sets)):
        ok = (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & (root != root[i])
        if cross:
            ok &= side != side[i]
        ok[: i + 1] = False
        for f in filters:
            if ok.any():
                ok &= f.common(i) > 0
        if not ok.any():
            continue
        common = whole.common(i)
        for j in np.flatnonzero(ok & (100 * common >= percent * (n + n[i] - common))).tolist():
            if root[j] != root[i]:
                out.append((sigs[i], sigs[j]))
                root[root == root[j]] = root[i]
    return out


def _clusters(percent: int, table):
    """Verifies clusters; rows come sorted by their task's name."""

    def run(batches):
        known, counts = table.value

        def done(held):
            sigs = [h[0] for h in held]
            side = np.array([h[1] for h in held])
            cross = bool(held[0][3])
            links = _joined(sigs, side, [h[2] for h in held], percent, cross, known, counts) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

        name, held = None, []
        for b in batches:
            for c, i, j, side, sig, tokens in zip(*(b.column(k).to_pylist() for k in ("cluster", "i", "j", "side", "sig", "tokens")), strict=True):
                if (c, i, j) != name:
                    if held:
                        yield done(held)
                    name, held = (c, i, j), []
                if not held or held[-1][:2] != (sig, side):  # equal sets of several scan tasks
                    held.append((sig, side, np.frombuffer(tokens, U64), i != j))
        if held:
            yield done(held)

    return run


def _contract(batches):
    """A spanning star forest of the edges of one partition: fewer rows, the same components."""
    root: dict[int, int] = {}

    def find(x):
        r = x
        while root.setdefault(r, r) != r:
            r = root[r]
        while root[x] != r:
            root[x], x = r, root[x]
        return r

    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = [x for x in root if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array([find(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], ["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reached.

    Each round every node points to the smallest node beside it (or itself), and on to where that points; edges between what their
    ends point to go to the next round, so a round works on what the one before left of the graph and not on all nodes.
    The smallest node of a component points to itself and stays.  Pointers are then followed from the last round
    back to the first.  Tables of a round go to the shared folder.
    """
    edges = core.keep(edges.select("a", "b").mapInArrow(core.tidy(_contract), "a long, b long"), "edges")
    pointers = []
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        beside = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to"))
        beside = core.keep(beside, "beside")
        on = beside.select(F.col("node").alias("to"), F.col("to").alias("component"))
        pointers.append(core.keep(beside.join(on, "to").select("node", "component"), "labels"))
        core.drop_kept(beside)
        ends = [pointers[-1].select(F.col("node").alias(x), F.col("component").alias(f"_{x}")) for x in ("a", "b")]
        left = edges.join(ends[0], "a").join(ends[1], "b").filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        left = core.keep(left.mapInArrow(core.tidy(_contract), "a long, b long").distinct(), "edges")
        core.drop_kept(edges)
        edges = left
        if left.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    labels = pointers.pop()
    while pointers:  # a node whose pointer is in no later edge has arrived
        own, later = pointers.pop(), labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = core.keep(own.join(later, "component", "left").select("node", F.coalesce("further", "component").alias("component")), "labels")
    return labels


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) per row of ``docs``.

    Words are runs of bytes other than ASCII white space with A-Z lower-cased; shingles are ``size``
    consecutive words (a shorter text is one shingle).  Rows link when
    ``100 * |A & B| >= percent * |A | B|``.  Null or blank texts have no shingles and are alone.
    ``component_id`` is the smallest key reached over links.  Repeated rows stay repeated; a null key
    takes part and never is the smallest unless its group has no other.
    """
    spark = docs.sparkSession
    core.prepare(spark)
    texts = docs.select(F.col(text).alias("text"))
    counted = core.keep(texts.mapInArrow(core.tidy(_frequent(size)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "counted")
    counts = core.most_frequent(counted, KNOWN).toArrow()
    core.drop_kept(counted)
    known = counts.column("token").to_numpy().view(U64)
    order = np.argsort(known)
    table = core.send(spark, (known[order], counts.column("n").to_numpy()[order]))

    def rows(batches):
        for b in batches:
            n, sig, bits = [], [], []
            for x in shingle_sets(b.column("text"), size):
                n.append(len(x))
                sig.append(signature(x) if len(x) else 0)
                bits.append(sketch(x) if len(x) else None)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int64()), pa.array(core.signed(np.array(sig, U64))), pa.array(bits, pa.binary())], ["key", "n_shingles", "sig", "sketch"])

    kind = docs.schema[key].dataType.simpleString()
    nodes = core.keep(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(core.tidy(rows), f"key {kind}, n_shingles long, sig long, sketch binary"), "nodes")
    shingles = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    blocks = max(core.tasks(spark), math.ceil(shingles * (101 - percent) / 100 / 1_000_000))
    postings = texts.mapInArrow(core.tidy(_postings(size, percent, blocks, table)), "block int, tokens binary, sigs binary, sizes binary")
    found = core.keep(postings.repartitionById(blocks, "block").mapInArrow(core.tidy(_lists(percent)), "a long, b long").distinct(), "pairs")
    chained = components(found).select(F.col("node").alias("sig"), F.col("component").alias("cluster"))
    sketched = nodes.filter("n_shingles > 0").select("sig", F.col("n_shingles").alias("n"), "sketch").join(chained.hint("merge"), "sig").dropDuplicates(["sig"])
    near = _placed(core.keep(sketched, "sketched"), F.octet_length("sketch")).repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    near = near.select("cluster", "i", "j", "side", "sig", "n", "sketch").mapInArrow(core.tidy(_refined(percent)), "a long, b long")
    cluster = components(core.keep(near, "near")).select(F.col("node").alias("sig"), F.col("component").alias("cluster"))
    wanted = core.send(spark, filter_bits(cluster))
    own = nodes.filter("n_shingles > 0").groupBy("sig").agg(F.max("n_shingles").alias("n")).join(cluster.hint("merge"), "sig")
    placed = _placed(own, F.col("n") * 8).select("sig", "cluster", "i", "j", "side")
    dealt = texts.mapInArrow(core.tidy(_sets(size, wanted)), "sig long, tokens binary").join(core.keep(placed, "placed").hint("merge"), "sig")
    links = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side", "sig").mapInArrow(core.tidy(_clusters(percent, table)), "a long, b long")
    labels = components(core.keep(links, "links"))
    named = nodes.filter("n_shingles > 0").join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("key", "sig", F.coalesce("component", "sig").alias("component"))
    least = named.groupBy("component").agg(F.min("key").alias("component_id"))
    heads = named.select("sig", "component").distinct().join(least, "component").select("sig", "component_id")
    out = nodes.join(heads, "sig", "left")
    return out.select(F.col("key").alias(key), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest key.

    Rows without words stay.  Of rows that share a key the one with the smallest hash of its text comes first,
    and of rows that repeat both one stays.  A row with a null key stays if its group has no key at all.
    """
    digest = lambda t: F.unhex(F.sha2(F.coalesce(t, F.lit("")), 256))
    name = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), digest(F.col(text)).alias("digest"))
    near = near_components(docs.select(name.alias("name"), F.col(text).alias("text")), "name", "text", **options)
    # key and digest as one column: texts are sent once, for the join and for what repeats
    whole = lambda k, d: F.sha2(F.concat(F.when(k.isNull(), "-").otherwise(F.concat(F.lit("+"), k.cast("string"))).cast("binary"), d), 256)
    stay = near.filter("component_id = name").select(whole(F.col("name.key"), F.col("name.digest")).alias("stay")).distinct()
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    k, t = (f"c{docs.columns.index(x)}" for x in (key, text))
    named = inner.withColumn("stay", whole(F.col(k), digest(F.col(t)))).withColumn("none", F.col(t).isNull())
    return named.join(stay.hint("merge"), "stay", "left_semi").dropDuplicates(["stay", "none"]).drop("stay", "none").toDF(*docs.columns)
