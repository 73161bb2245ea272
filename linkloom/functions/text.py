"""Text column expressions: Unicode-aware trimming, splitting and keyword patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators that end a line in a text, and the characters that count as white space.
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only U+0020; looks only at the two ends of the text."""
    return F.trim(c, F.lit(SPACES))


def lines(content: Column) -> Column:
    return F.split(content, LINE_BREAKS)


def before_comma(c: Column) -> Column:
    return strip(F.substring_index(c, ",", 1))


def after_comma(c: Column) -> Column:
    return strip(F.substr(c, F.instr(c, ",") + F.lit(1)))


def has_comma(c: Column) -> Column:
    return F.contains(c, F.lit(","))


def _tree(words: set[str]) -> str:
    """Alternatives grouped by common beginnings, so that few are tried at each position."""
    heads: dict[str, set[str]] = {}
    for w in sorted(words):
        if w:
            heads.setdefault(w[0], set()).add(w[1:])
    parts = [re.sub(r"([\\.\[\]{}()*+?^$|&~#\-])", r"\\\1", h) + _tree(t) for h, t in heads.items()]
    if len(parts) == 1 and "" not in words:
        return parts[0]
    return f"(?:{'|'.join(parts)})" + ("?" if "" in words else "") if parts else ""


def any_of(words: Iterable[str], ignore_case: bool = False) -> str:
    """A pattern that matches any of the literal words."""
    words = {w.lower() if ignore_case else w for w in words if w}
    if not words:
        return r"(?!)"
    cased = ignore_case and any(w != w.upper() for w in words)
    return f"(?iu)(?:{_tree(words)})" if cased else f"(?:{_tree(words)})"


def contains_any(c: Column, words: Iterable[str], ignore_case: bool = False) -> Column:
    return c.rlike(any_of(words, ignore_case))


def starts_with_any(c: Column, prefixes: Iterable[str]) -> Column:
    return c.rlike("^" + any_of(prefixes))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, which may use it many times.

    The optimizer copies a derived column into every place that uses it when it moves filters
    down; binding it keeps the plan small and the value computed once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_pairs(pairs: Iterable[tuple], names: tuple[str, str] = ("a", "b")) -> Column:
    """An array of two-field structs as one literal."""
    items = []
    for pair in pairs:
        values = [_quoted(v) if isinstance(v, str) else f"{v}L" for v in pair]
        items.append(", ".join(f"{v} AS {n}" for v, n in zip(values, names)))
    return F.expr("array(" + ", ".join(f"struct({i})" for i in items) + ")")
