"""Text normalisation as column expressions (no Python on executors)."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NBSP = " "


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility composition of Unicode; no built-in function has it, so texts go through Arrow once."""
    return values.str.normalize("NFKC")


def clean_text(c: Column, compose: bool = False) -> Column:
    """NFKC if ``compose``, no-break spaces to spaces, runs of blanks to one, three or more newlines to two, ends stripped; null is empty."""
    c = F.regexp_replace(F.coalesce(nfkc(c) if compose else c, F.lit("")), NBSP, " ")
    c = F.regexp_replace(F.regexp_replace(c, "[ \\t]+", " "), "\\n{3,}", "\n\n")
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


@functools.cache
def _folding() -> tuple[str, str]:
    """Characters of the Latin blocks that decompose to one base letter and marks, and those letters."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(c: Column) -> Column:
    """Latin letters without their marks (letters without decomposition, such as sharp s, stay)."""
    source, target = _folding()
    return F.regexp_replace(F.translate(c, source, target), "\\p{Mn}", "")


def normalize_for_matching(c: Column) -> Column:
    c = F.regexp_replace(strip_accents(F.lower(clean_text(c))), "[^a-z0-9+#.\\s-]", " ")
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def normalize_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(clean_text(c)), "[^a-z0-9+#.]+", " "))


def sentence_split(c: Column) -> Column:
    """Sentences: cut after ``.!?`` with white space, at newlines and at bullets; edge punctuation stripped, empty ones dropped."""
    parts = F.split(clean_text(c), "(?<=[.!?])\\s+|\\n+|[•·]\\s*")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, "^[ \\-:\\t]+|[ \\-:\\t]+$", "")), lambda x: x != "")


def word_count(c: Column) -> Column:
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "^\\s+|\\s+$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, "\\s+")))


def title_label(c: Column) -> Column:
    return F.initcap(F.regexp_replace(c, "-", " "))


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n) if n > 0 else c


def contains_any(c: Column, words) -> Column:
    return functools.reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c``, which is computed once however often ``f`` names it: branches of a condition would each compute it again."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def first_rule(c: Column, rules, default: str) -> Column:
    """The name of the first rule any of whose keywords the text contains."""

    def name_of(text: Column) -> Column:
        out = None
        for name, words in rules:
            hit = contains_any(text, words)
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out.otherwise(default)

    return once(c, name_of)
