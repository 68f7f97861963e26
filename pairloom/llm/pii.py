"""Personal data by boosted trees over candidate spans, in DataFrame expressions only.

Base rules find e-mail addresses, IPv4 addresses, card numbers and phone numbers, leftmost and without
overlap within a kind; those spans always stay.  Generators with high recall then propose further
spans (written-out addresses, addresses with ports, other separators, long tokens that may be secrets), which
overlap base spans and proposals of other kinds.  Boosted regression trees score each proposal from its format
and the words before it.  Added are the ones that reach a calibrated threshold and overlap no better proposal
and no base span, other than one of their kind that they extend.

The trees are fitted by :func:`train` on a bounded, generated set of labelled examples; features of the
examples are computed by the same expressions as those of documents, and the trees become one SQL
expression.  Nothing but built-in functions touches documents.

Positions come from marking matches and summing the lengths of the parts between marks, chunk by chunk, and overlaps are
looked up by halving in sorted spans, so a text's cost is about linear in it and in its spans.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
#: The kinds of proposals; the last has no base rule.
ALL = [*KINDS, "secret"]
MARK, OTHER = "\u0001", "\u0002"

#: The base patterns; possessive and anchored so that long runs are scanned once (same matches).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Patterns of the proposals.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?(?:@|[(\[]at[)\]])\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?|(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){3,7}:?[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){11,21}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+|00|\()?[0-9](?:[\x20().\/-]{0,2}[0-9]){6,14}(?![0-9])",
    "secret": r"(?<![0-9A-Za-z+\/_-])[A-Za-z0-9+\/_-]{16,}+",
}
#: A text without a match of these has no match of the pattern above.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WIDE_NEEDS = {"secret": r"[A-Za-z0-9+\/_-]{16}", "email": r"@|[(\[]at[)\]]|\x20at\x20", "ip": r"[0-9]\.[0-9]|:[0-9a-fA-F]{0,4}:", "card": r"(?:[0-9][\x20._/-]{0,2}){12}", "phone": r"(?:[0-9][\x20().\/-]{0,2}){7}"}
#: Words that announce a kind.
WORDS = {"email": r"mail|write to|contact", "ip": r"\bip\b|host|server|addr", "card": r"card|visa|pay|account", "phone": r"phone|call|\btel|mobile|fax", "secret": r"(?:token|secret|passw(?:or)?d|api[ _-]?key|access[ _-]?key|bearer)[\"']?\s*[:=]?\s*[\"']?$"}

_SPAN = "array<struct<s:bigint,e:bigint,m:string,b:string,a:string>>"
#: Parts of a text between marks that are gone through together; an even number, so that matches stay the odd ones.
_CHUNK = 256
#: Characters before a span that its features look at.
_BEFORE = 24


def _let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated once."""
    return F.transform(F.array(x), f)[0]


def _matches(text: Column, pattern: str, needs: str, context: bool = False) -> Column:
    """Array of (s, e, m, b, a) of the matches: code points, end exclusive; with ``context`` the characters before and after.

    The parts between marks are gone through in chunks whose starts are summed first, so that no list grows with
    the whole text while it is copied.
    """
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), F.lit(f"({pattern})"), F.lit(f"{MARK}$1{MARK}"))
    none = F.array().cast(_SPAN)
    tail = lambda before, x: F.right(F.concat(before, x), F.lit(_BEFORE)) if context else F.lit("")
    heads = "array<struct<p:bigint,t:string,k:int>>"

    def head(a, c):
        joined = lambda j: F.struct((a["p"] + F.char_length(j)).alias("p"), tail(a["t"], j).alias("t"), (a["k"] + 1).alias("k"), F.concat(a["o"], F.array(F.struct(a["p"].alias("p"), a["t"].alias("t"), a["k"].alias("k")))).alias("o"))
        return _let(F.array_join(c, ""), joined)

    def spans(parts):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _CHUNK).cast("int")), lambda i: F.slice(parts, i * _CHUNK + 1, F.lit(_CHUNK)))
        zero = F.struct(F.lit(0).cast("long").alias("p"), F.lit("").alias("t"), F.lit(0).alias("k"), F.array().cast(heads).alias("o"))

        def after(k, i):
            follows = lambda n: F.coalesce(F.get(parts, k * _CHUNK + i + n), F.lit(""))
            return F.substring(F.when(follows(1) == "", follows(2)).otherwise(follows(1)), 1, 1) if context else F.lit("")

        def inner(c, h):
            def step(a, x):
                e = a["p"] + F.char_length(x)
                one = F.struct(a["p"].alias("s"), e.alias("e"), x.alias("m"), a["t"].alias("b"), after(h["k"], a["i"]).alias("a"))
                return F.struct(e.alias("p"), (a["i"] + 1).alias("i"), tail(a["t"], x).alias("t"), F.when(a["i"] % 2 == 1, F.concat(a["o"], F.array(one))).otherwise(a["o"]).alias("o"))

            return F.aggregate(c, F.struct(h["p"].alias("p"), F.lit(0).alias("i"), h["t"].alias("t"), none.alias("o")), step, lambda a: a["o"])

        return _let(chunks, lambda cs: F.flatten(F.zip_with(cs, F.aggregate(cs, zero, head, lambda a: a["o"]), inner)))

    return F.when(text.rlike(needs), _let(F.split(marked, MARK), spans)).otherwise(none)


def _count(spans: Column, test) -> Column:
    """How many elements at the start of a sorted array pass a test that no later one passes after one fails; by halving."""
    n = F.size(spans)

    def step(a, _):
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        above = F.struct((middle + 1).alias("lo"), a["hi"].alias("hi"))
        return F.when(a["lo"] >= a["hi"], a).when(test(F.get(spans, middle)), above).otherwise(F.struct(a["lo"].alias("lo"), middle.alias("hi")))

    return F.aggregate(F.sequence(F.lit(0), F.floor(F.log2(n + 1)).cast("int")), F.struct(F.lit(0).alias("lo"), n.alias("hi")), step, lambda a: a["lo"])


def _touching(spans: Column, x: Column) -> Column:
    """Those of sorted spans without overlap that overlap x; a few spans are left as they are, to be tested one by one."""
    first = _count(spans, lambda y: y["e"] <= x["s"])
    return F.when(F.size(spans) <= 16, spans).otherwise(_let(first, lambda i: F.slice(spans, i + 1, _count(spans, lambda y: y["s"] < x["e"]) - i)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def step(s, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return s + F.when(i % 2 == 1, twice).otherwise(d)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0).otherwise(False)


def _base_ok(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "")), lambda p: (F.char_length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    n = F.char_length(_digits(m))
    return n.between(16, 19) & _luhn(_digits(m)) if kind == "card" else n.between(8, 15)


def base_spans(text: Column, kind: str) -> Column:
    """The base rule's spans of a kind; matches that fail its test are dropped."""
    return F.filter(_matches(text, BASE[kind], NEEDS[kind]), lambda x: _base_ok(kind, x["m"]))


FEATURES = ["kind", "digits", "chars", "gaps", "luhn", "lead", "word", "letters", "octets", "glued", "zone"]


def _features(kind: str, x: Column) -> Column:
    m = x["m"]
    d = _digits(m)
    before, after = F.lower(x["b"]), x["a"]
    flag = lambda c: F.when(c, 1).otherwise(0)
    return F.struct(
        F.lit(ALL.index(kind)).alias("kind"),
        F.char_length(d).alias("digits"),
        F.char_length(m).alias("chars"),
        F.char_length(F.regexp_replace(m, r"[0-9A-Za-z]", "")).alias("gaps"),
        flag(_luhn(d)).alias("luhn") if kind == "card" else F.lit(0).alias("luhn"),
        F.when(m.startswith("+"), 3).when(m.startswith("00"), 2).when(m.startswith("("), 1).otherwise(0).alias("lead"),
        flag(before.rlike(WORDS[kind])).alias("word"),
        F.char_length(F.regexp_replace(m, "[^A-Za-z]", "")).alias("letters"),
        flag(F.forall(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda p: (F.char_length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))).alias("octets"),
        flag(after.rlike("[0-9A-Za-z%$€]") | F.substring(before, -1, 1).rlike("[0-9A-Za-z$€#.,-]")).alias("glued"),
        flag(F.lower(m).rlike(r"(?:\.|dot[)\]]?\x20?)(?:com|org|net|edu|io|de|fr|es)$")).alias("zone"),
    )


def proposals(text: Column) -> Column:
    """Array of (k, s, e, f): kind number, span, features."""
    def of(i, kind):
        return lambda x: F.struct(F.lit(i).alias("k"), x["s"].alias("s"), x["e"].alias("e"), _features(kind, x).alias("f"))

    each = [F.transform(_matches(text, WIDE[k], WIDE_NEEDS[k], context=True), of(i, k)) for i, k in enumerate(ALL)]
    return F.concat(*each)


# ---------------------------------------------------------------- training
def examples(n: int = 160, seed: int = 7) -> list[tuple[int, str, int]]:
    """Generated (kind number, text, label) rows: n of each sort."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda k=6: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, k)))

    def luhn(k, valid):
        body = r.choice("3456") + digits(k - 2)
        s = 0
        for i, c in enumerate(reversed(body)):
            d = int(c)
            s += d if i % 2 else (2 * d - 9 if d > 4 else 2 * d)
        last = (10 - s % 10) % 10
        return body + str(last if valid else (last + r.randint(1, 9)) % 10)

    def grouped(x, sep, size=4):
        return sep.join(x[i : i + size] for i in range(0, len(x), size))

    code = lambda k, of="0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ": "".join(r.choice(of) for _ in range(k))
    plain = lambda: f"{word()} {word(9)} "
    zone = lambda: r.choice(["com", "org", "net", "de", "fr"])
    octets = lambda: ".".join(str(r.randint(1, 254)) for _ in range(4))
    rows = []
    for _ in range(n):
        rows += [
            (0, f"{plain()}mail {word()} at {word()} dot {zone()} {word()}", 1),
            (0, f"{plain()}contact {word()}.{word()} (at) {word()} (dot) {zone()}", 1),
            (0, f"{plain()}{word()}[at]{word()}.{zone()} {word()}", 1),
            (0, f"{plain()}{word()} at {word()} dot {word()} {word()}", 0),
            (0, f"{plain()}{word()} at {word()}.{word()} {word()}", 0),
            (1, f"{plain()}server {octets()}:{r.randint(80, 65000)} {word()}", 1),
            (1, f"{plain()}host {':'.join(f'{r.randint(4096, 65535):x}' for _ in range(8))} {word()}", 1),
            (1, f"{plain()}version {r.randint(1, 9)}.{r.randint(256, 999)}.{r.randint(1, 9)}.{r.randint(300, 999)} {word()}", 0),
            (1, f"{plain()}at {r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}:{r.randint(10, 99)} {word()}", 0),
            (2, f"{plain()}card {grouped(luhn(16, True), r.choice(['.', '/', '--', '_']))} {word()}", 1),
            (2, f"{plain()}visa {grouped(luhn(15, True), r.choice([' ', '-', '.']), 5)} {word()}", 1),
            (2, f"{plain()}order {grouped(luhn(16, False), r.choice(['.', '/', '']))} {word()}", 0),
            (2, f"{plain()}{luhn(16, False)} {word()}", 0),
            (2, f"{plain()}number {digits(r.choice([12, 13, 14, 20, 22]))} {word()}", 0),
            (3, f"{plain()}phone {digits(3)}-{digits(3)}-{digits(4)} {word()}", 1),
            (3, f"{plain()}call ({digits(3)}) {digits(3)}-{digits(4)} {word()}", 1),
            (3, f"{plain()}tel 00{digits(2)} {digits(3)} {digits(3)} {digits(3)} {word()}", 1),
            (3, f"{plain()}{digits(4)}-{digits(2)}-{digits(2)} {word()}", 0),
            (3, f"{plain()}total {digits(r.randint(7, 12))} {word()}", 0),
            (3, f"{plain()}{digits(2)}.{digits(2)}.{digits(4)} {word()}", 0),
            (3, f"{plain()}{luhn(16, False)[:15]} {word()}", 0),
            (3, f"{plain()}{octets()} {word()}", 0),
            (4, f'{plain()}{r.choice(["token", "api_key", "secret"])} = "{code(40, "0123456789abcdef")}" {word()}', 1),
            (4, f"{plain()}{r.choice(['password: ', 'access key ', 'Bearer '])}{code(r.randint(16, 40))} {word()}", 1),
            (4, f"{plain()}{word(9)}{word(9)}{word(9)}{word(9)} {word()}", 0),
            (4, f"{plain()}token {word(9)}_{word(9)}-{word(9)}/{word(9)} {word()}", 0),
            (4, f"{plain()}revision {code(40, '0123456789abcdef')} {word()}", 0),
            (4, f"{plain()}{r.choice(['token', 'order'])} {digits(r.randint(16, 24))} {word()}", 0),
        ]
    return rows


#: Sorts of examples; each run of so many rows of :func:`examples` holds one of each.
SORTS = 28


def _grow(x, grad, depth, least=8):
    """A regression tree on the gradient: a leaf value, or (feature, threshold, low side, high side)."""
    value = float(grad.sum() / (len(grad) * 0.25 + 1.0))
    if depth == 0 or len(grad) < 2 * least:
        return value
    best = (1e-9, None, None)
    total = grad.sum() ** 2 / len(grad)
    for j in range(x.shape[1]):
        for t in np.unique(x[:, j])[:-1]:
            low = x[:, j] <= t
            a, b = low.sum(), (~low).sum()
            if a >= least and b >= least:
                gain = grad[low].sum() ** 2 / a + grad[~low].sum() ** 2 / b - total
                if gain > best[0] + 1e-9:
                    best = (gain, j, float(t))
    if best[1] is None:
        return value
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[low], grad[low], depth - 1, least), _grow(x[~low], grad[~low], depth - 1, least))


def _walk(tree, x):
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    low = x[:, tree[0]] <= tree[1]
    out = np.zeros(len(x))
    out[low], out[~low] = _walk(tree[2], x[low]), _walk(tree[3], x[~low])
    return out


class Boosted:
    """Trees, learning rate, and for each kind the margin from which its proposals are taken."""

    def __init__(self, trees, rate, bounds):
        self.trees, self.rate, self.bounds = trees, rate, bounds

    def margin(self, x: np.ndarray) -> np.ndarray:
        return sum((self.rate * _walk(t, x) for t in self.trees), np.zeros(len(x)))

    def expression(self, f: Column) -> Column:
        """The margin as a column of the feature struct."""

        def column(t):
            return F.lit(float(t)) if not isinstance(t, tuple) else F.when(f[FEATURES[t[0]]] <= t[1], column(t[2])).otherwise(column(t[3]))

        return functools.reduce(lambda a, b: a + b, (column(t) * self.rate for t in self.trees))


@functools.lru_cache(maxsize=4)
def _fitted(spark: SparkSession, rounds: int, depth: int, rate: float, precision: float) -> Boosted:
    rows = examples()
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind int, text string, label int")
    got = frame.select("i", "kind", "label", F.explode(proposals(F.col("text"))).alias("p")).select("i", "kind", "label", "p.k", "p.f.*").collect()
    x = np.array([[r[4 + j] for j in range(len(FEATURES))] for r in got], float)
    y = np.array([float(r[2] == 1 and r[1] == r[3]) for r in got])
    fold = np.array([r[0] // SORTS % 3 for r in got])  # every third run of examples calibrates
    fit = fold != 2
    margin, trees = np.zeros(fit.sum()), []
    for _ in range(rounds):
        t = _grow(x[fit], y[fit] - 1 / (1 + np.exp(-margin)), depth)
        trees.append(t)
        margin += rate * _walk(t, x[fit])
    model = Boosted(trees, rate, [])
    held, truth, kind = model.margin(x[~fit]), y[~fit], x[~fit][:, 0]
    for k in range(len(ALL)):
        own = kind == k
        seen = np.unique(held[own])
        good = [b for b in seen if truth[own][held[own] >= b].mean() >= precision]
        least = min(good, default=np.inf)
        below = max(seen[seen < least], default=least)  # the bound lies half way to the next margin below
        model.bounds.append(float(max((least + below) / 2, 0.0)))
    return model


def train(spark: SparkSession, rounds: int = 24, depth: int = 3, rate: float = 0.3, precision: float = 0.99) -> Boosted:
    """Fits the trees on two thirds of the examples; on the rest, each kind's bound is the lowest margin of that precision."""
    return _fitted(spark, rounds, depth, rate, precision)


# ---------------------------------------------------------------- whole operator
def find(docs: DataFrame, model: Boosted | None = None, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with the column ``into``: base spans by kind, and added spans, each array sorted by start.

    A null text is empty and has none.  Repeated rows stay; other columns pass through (one named ``into`` is
    replaced).  Of equally good proposals that overlap, the first kind and then the first start is added.
    """
    model = model or train(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    base = {k: F.transform(base_spans(t, k), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in KINDS}
    names = [c for c in docs.columns if c != into]
    found, many, lists = _fresh(docs.columns, 3)
    out = docs.withColumn(found, F.struct(*(base[k].alias(k) for k in KINDS)))
    bound = F.array(*(F.lit(b if np.isfinite(b) else 1e9) for b in model.bounds))
    over = lambda a, b: (a["s"] < b["e"]) & (b["s"] < a["e"])
    any_of = lambda conditions: functools.reduce(lambda a, b: a | b, conditions)

    def free(p):
        """No base span overlaps, but for those of its kind that it extends."""
        def in_the_way(i):
            return lambda b: over(b, p) & ~((p["k"] == i) & _extends(p, b))

        return ~any_of(F.exists(_touching(F.col(found)[k], p), in_the_way(i)) for i, k in enumerate(KINDS))

    scored = F.transform(F.filter(proposals(t), free), lambda p: F.struct(p["k"].alias("k"), p["s"].alias("s"), p["e"].alias("e"), model.expression(p["f"]).alias("v")))
    # proposals are made only where the wide patterns can match at all
    any_wide = any_of(t.rlike(x) for x in WIDE_NEEDS.values())
    none = F.array().cast("array<struct<k:int,s:bigint,e:bigint,v:double>>")
    out = out.withColumn(many, F.when(any_wide, F.filter(scored, lambda p: p["v"] >= F.element_at(bound, p["k"] + 1))).otherwise(none))

    def of_kind(i):
        return lambda p: p["k"] == i

    out = out.withColumn(lists, F.struct(*(F.filter(F.col(many), of_kind(i)).alias(k) for i, k in enumerate(ALL))))
    better = lambda a, b: (a["v"] > b["v"]) | (a["v"] == b["v"]) & ((a["k"] < b["k"]) | (a["k"] == b["k"]) & (a["s"] < b["s"]))
    more = F.filter(F.col(many), lambda p: ~any_of(F.exists(_touching(F.col(lists)[k], p), lambda q: over(q, p) & better(q, p)) for k in ALL))
    added = F.array_sort(F.transform(more, lambda p: F.struct(p["k"].alias("k"), p["s"].alias("s"), p["e"].alias("e"))))
    return out.select(*(F.col(f"`{c}`") for c in names), F.struct(*(F.col(found)[k].alias(k) for k in KINDS), added.alias("added")).alias(into))


def _fresh(columns: list[str], n: int) -> list[str]:
    """Names that no column has."""
    taken = {c.lower() for c in columns}
    return [x for i in range(len(columns) + n) if (x := f"inner_{i}") not in taken][:n]


def _extends(p: Column, b: Column) -> Column:
    """Whether the proposal holds the span and more."""
    return (p["s"] <= b["s"]) & (p["e"] >= b["e"]) & (p["e"] - p["s"] > b["e"] - b["s"])


def spans_text(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def redact(docs: DataFrame, model: Boosted | None = None, text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; overlapping spans join (the first kind names them)."""
    (into,) = _fresh(docs.columns, 1)
    found = find(docs, model, text, into)

    def numbered(i):
        return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(i).alias("k"))

    every = F.concat(*(F.transform(F.col(into)[k], numbered(i)) for i, k in enumerate(KINDS)), F.transform(F.col(into)["added"], lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in ALL))
    t = F.coalesce(F.col(text), F.lit(""))

    def step(a, x):
        return F.when(x["s"] >= a["p"], F.struct(x["e"].alias("p"), F.concat(a["o"], F.substring(t, (a["p"] + 1).cast("int"), (x["s"] - a["p"]).cast("int")), F.element_at(names, x["k"] + 1)).alias("o"))).otherwise(F.struct(F.greatest(a["p"], x["e"]).alias("p"), a["o"].alias("o")))

    clean = F.aggregate(F.array_sort(every), F.struct(F.lit(0).cast("long").alias("p"), F.lit("").alias("o")), step, lambda a: F.concat(a["o"], F.substring(t, (a["p"] + 1).cast("int"), F.char_length(t))))
    return found.withColumn(text, F.when(F.col(text).isNotNull(), clean)).drop(into)
