"""Compatibility decomposition without marks, as Columns: tables made from the Unicode data, not written down."""

from __future__ import annotations

import functools
import itertools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hangul syllables, which decompose by arithmetic; they stay as they are.
_HANGUL = range(0xAC00, 0xD7A4)


@functools.cache
def tables() -> tuple[str, str, dict[str, str]]:
    """Characters with a base character of their own, those base characters, and characters that become several."""
    one, base, many = [], [], {}
    for c in map(chr, itertools.chain(range(0xA0, 0xD800), range(0xE000, sys.maxunicode + 1))):
        if ord(c) in _HANGUL or (plain := unicodedata.normalize("NFKD", c)) == c:
            continue
        plain = "".join(x for x in plain if unicodedata.category(x)[0] != "M")
        if len(plain) == 1:
            one.append(c)
            base.append(plain)
        elif plain:
            many[c] = plain
    return "".join(one), "".join(base), many


@functools.cache
def _class_of_many() -> str:
    """A character class of those that become several."""
    points = sorted(map(ord, tables()[2]))
    runs = [[x for _, x in g] for _, g in itertools.groupby(enumerate(points), lambda p: p[1] - p[0])]
    return "[" + "".join(f"\\x{{{r[0]:x}}}-\\x{{{r[-1]:x}}}" for r in runs) + "]"


def without_marks(x: Column) -> Column:
    """Marks go, letters become their base letters, ligatures and other compatibility characters what they stand for.

    Texts of ASCII alone, as most words are, stay as they are.
    """
    one, base, many = tables()
    plain = F.translate(x, one, base)
    table = F.create_map(*(F.lit(v) for pair in many.items() for v in pair))
    spelt = F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    decomposed = F.regexp_replace(F.when(plain.rlike(_class_of_many()), spelt).otherwise(plain), r"\p{M}+", "")
    return F.when(x.rlike(r"[^\x00-\x7F]"), decomposed).otherwise(x)
