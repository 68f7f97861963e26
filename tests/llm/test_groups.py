"""Groups of lines that are compared at once, and how much text is looked at at once."""

import numpy as np
import pyarrow as pa
import pytest

from pairloom.llm import core, jaccard, langid, lines, tokens


def slots(seed):
    """Lines of many slots, sorted by slot: most slots have few lines, some more than are compared together."""
    r = np.random.default_rng(seed)
    out = []
    for s in range(300):
        k, n = int(r.choice([1, 2, 3, 5, 16, 17, 40])), int(r.choice([4, 7, 10, 20]))
        base = r.integers(0, 3, n)
        for _ in range(k):
            out.append((s, len(out), np.where(r.random(n) < 0.25, r.integers(0, 5, n), base).astype(np.uint64)))
    return out


def one_by_one(rows):
    out, group = [], {}
    for s, m, w in rows:
        leaders, others = group.setdefault(s, ([], []))
        alike = lambda x: [a for a, v in x if (v != w).sum() <= lines.allowed(len(w))]  # noqa: B023, E731
        found = alike(leaders)
        if not found:
            found = alike(others)
            leaders.append((m, w))
        else:
            others.append((m, w))
        out += [(a, m) for a in found]
    return sorted(out)


@pytest.mark.parametrize("step", [1, 2, 7, 100, 10_000])
def test_links_of_small_groups_equal_those_line_by_line(step):
    rows = slots(step)
    whole = pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows]), pa.array([x[2].tobytes() for x in rows], pa.binary())], ["slot", "member", "words"])
    got = [tuple(x.values()) for b in lines._alike(whole.slice(i, step) for i in range(0, len(rows), step)) for x in b.to_pylist()]
    assert sorted(got) == one_by_one(rows)


def test_small_groups_inside_a_batch_are_compared_together(monkeypatch):
    """op8: only the groups at the edges of a batch and large ones are gone through line by line."""
    made = []
    real = lines._Lines
    monkeypatch.setattr(lines, "_Lines", lambda size: made.append(size) or real(size))
    rows = [(s, 2 * s + k, np.full(5, s, np.uint64)) for s in range(50) for k in range(2)]
    b = pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows]), pa.array([x[2].tobytes() for x in rows], pa.binary())], ["slot", "member", "words"])
    assert sum(x.num_rows for x in lines._alike([b])) == 50
    assert len(made) == 4


def template_lines():
    """(member, leaf, words) of lines of several lengths and leaves, most with lines alike."""
    rng = np.random.default_rng(11)
    out = []
    for leaf in range(-20, 20):
        n = int(rng.integers(4, 40))
        base = rng.integers(0, 1 << 60, n).astype(np.uint64)
        for _ in range(int(rng.integers(1, 30))):
            w = base.copy()
            for i in rng.integers(3, n, int(rng.integers(0, n))) if rng.random() < 0.8 else range(3, n):
                w[i] = rng.integers(0, 4)
            out.append((len(out) * 7919 % 10007, leaf, w))
    return out


@pytest.mark.parametrize(("step", "made"), [(1, (1, 1)), (7, (4096, 64)), (10_000, (2 << 20, 1 << 12))])
def test_whole_leaves_meet_in_all_shared_parts(monkeypatch, step, made):
    """op8: groups made where the whole leaf is are those that its parts make by an exchange."""
    rows = template_lines()
    dealt = {}
    for m, leaf, w in rows:
        for p in core.signed(lines._cut(w, leaf)[1]).tolist():
            dealt.setdefault(p, []).append((len(w), m, w.tobytes()))
    expected = [(p, m, w) for p in sorted(dealt) if len(dealt[p]) > 1 for _, m, w in sorted(dealt[p])]
    rows.sort(key=lambda x: x[1])
    b = pa.RecordBatch.from_arrays([pa.array([x[1] for x in rows]), pa.array([x[0] for x in rows]), pa.array([x[2].tobytes() for x in rows], pa.binary())], ["leaf", "member", "words"])
    for name, n in zip(("_MADE_BYTES", "_MADE_ROWS"), made, strict=True):
        monkeypatch.setattr(lines, name, n)
    got = [tuple(x.values()) for x in lines._leaf_slots(b.slice(i, step) for i in range(0, len(rows), step)) for x in x.to_pylist()]
    assert sorted(got) == sorted(expected) and len(expected) > 1000
    leaf_of = {m: leaf for m, leaf, _ in rows}
    runs = {}
    for at, (p, m, _) in enumerate(got):
        runs.setdefault((p, leaf_of[m]), []).append((at, m))
    assert all([m for _, m in r] == [m for q, m, _ in expected if q == p] and r[-1][0] - r[0][0] == len(r) - 1 for (p, _), r in runs.items())


@pytest.mark.parametrize(("most", "bytes_"), [(1_000, 4 << 20), (8, 4 << 20), (1_000, 2_000), (0, 0)])
def test_lines_of_small_leaves_are_sent_once(spark, monkeypatch, most, bytes_):
    """op8: only lines of large leaves go to their parts by an exchange; links are the same wherever the bound lies."""
    rows = template_lines()
    expected = set()
    dealt = {}
    for m, leaf, w in rows:
        for p in core.signed(lines._cut(w, leaf)[1]).tolist():
            dealt.setdefault(p, []).append((len(w), m, w))
    for p, found in dealt.items():
        expected |= set(one_by_one([(p, m, w) for _, m, w in sorted(found, key=lambda x: x[:2])]))
    sent = []
    real = lines._by_part
    monkeypatch.setattr(lines, "_by_part", lambda words: sent.append(words.select("leaf").distinct().count()) or real(words))
    monkeypatch.setattr(lines, "LEAF_LINES", most)
    monkeypatch.setattr(lines, "LEAF_BYTES", bytes_)
    core.prepare(spark)
    words = spark.createDataFrame([(m, leaf, w.tobytes()) for m, leaf, w in rows], "member long, leaf long, words binary")
    links = lines._links(words)
    assert {tuple(r) for r in links.collect()} == expected and len(expected) > 100
    leaves = {}
    for _, leaf, w in rows:
        leaves.setdefault(leaf, []).append(w.nbytes)
    large = sum(len(x) > most or sum(x) > bytes_ for x in leaves.values())
    assert sent == ([large] if large else [])


@pytest.mark.parametrize("kind", [core.WORD_BYTES, core.ALNUM_BYTES])
def test_words_end_with_their_row(kind):
    column = pa.array(["", "a\n", "\n", "b c1 É 漢", None, "d", "e\tf ", "", "g"])
    ((_, _, data, offs),) = core.text_slices(column)
    first, stop, rows = core.word_spans(data, offs, kind)
    expected = []
    for t in column.to_pylist():
        word = "".join(chr(x) if kind[x] else " " for x in (t or "").encode())
        expected.append([w.encode("latin-1") for w in word.split(" ") if w])
    raw = data.tobytes()
    assert [[raw[first[i] : stop[i]] for i in range(rows[r], rows[r + 1])] for r in range(len(column))] == expected


def test_stages_look_at_bounded_pieces_of_text(monkeypatch):
    """pipeline: a worker's arrays follow WORK_BYTES and not the batch, of which each byte would take tens of bytes."""
    sizes = []
    real = core.text_slices

    def seen(*args):
        for x in real(*args):
            sizes.append(len(x[2]))
            yield x

    monkeypatch.setattr(core, "text_slices", seen)
    column = pa.array(["some words of a text that a stage reads " * 25] * 3000)
    b = pa.RecordBatch.from_arrays([pa.array(range(len(column))), pa.array(range(len(column))), column], ["key", "whole", "text"])
    model = langid.Filter(["a", "b"], np.arange(4000, dtype=np.uint32), np.arange(4000) % 2)
    n, _ = model.hits(column)
    assert n.tolist() == [25 * 40 - 3] * len(column)
    list(lines._lines([b]))
    list(jaccard.shingle_sets(column, 5))
    list(tokens.encoded(column))
    assert sum(sizes) == 4 * 3000 * 1000 and max(sizes) <= 1 << 18


def test_tasks_of_another_kind_forget_the_tokenizer():
    """pipeline: idle workers are reused, so a tokenizer that pack left in them would stay through all later stages."""
    tokens.encoder()
    assert list(core.tidy(iter, remember=True)([1, 2])) == [1, 2] and tokens._encoders
    assert list(core.tidy(iter)([1, 2])) == [1, 2] and not tokens._encoders
