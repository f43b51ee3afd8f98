"""Replacement of many literals at once: leftmost, longest, never rescanned.

All literals become one regular expression that is factored like a trie, so a text is matched in one
pass however many there are; the surrounding plan is split, look up, join.  Where some literals ignore
case, a state is a pair of trie nodes (as written, lower-cased), so that the longest match wins across
both kinds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .policy import Policy, ascii_lower

_UPPER, _LOWER = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))


def _trie(words) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}
    return root


def _class(chars: list[str]) -> str:
    escaped = [re.sub(r"([\\\[\]^&\-])", r"\\\1", c) for c in sorted(chars)]
    return re.sub(r"([\\.\[\]{}()*+?^$|\-&#])", r"\\\1", chars[0]) if len(chars) == 1 else "[" + "".join(escaped) + "]"


def _pattern(a: dict | None, b: dict | None) -> str:
    """Regular expression of what may follow a state, longest first; chains are walked in a loop."""
    out, closing = [], []
    while True:
        targets: dict[tuple[int, int], tuple[dict | None, dict | None, list[str]]] = {}
        for c in sorted(({*(a or {})} | {x for y in (b or {}) for x in (y, y.upper() if y in _LOWER else y)}) - {""}):
            x, y = (a or {}).get(c), (b or {}).get(ascii_lower(c))
            targets.setdefault((id(x) if x is not None else 0, id(y) if y is not None else 0), (x, y, []))[2].append(c)
        if not targets:
            break
        if "" in (a or {}) or "" in (b or {}):  # a literal ends here: what follows is optional
            out.append("(?:")
            closing.append(")?")
        if len(targets) > 1:
            out.append("(?:" + "|".join(_class(chars) + _pattern(x, y) for x, y, chars in targets.values()) + ")")
            break
        ((a, b, chars),) = targets.values()
        out.append(_class(chars))
    return "".join(out) + "".join(reversed(closing))


def expression(policy: Policy) -> str | None:
    """The policy's pattern; None if it has no literals."""
    return _pattern(_trie(policy.exact), _trie(policy.folded)) if policy.exact or policy.folded else None


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else F.create_map().cast("map<string,string>")


def matches(text: Column, policy: Policy) -> Column:
    """The literals found, in order."""
    pattern = expression(policy)
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if pattern else F.array().cast("array<string>")


def replaced(text: Column, policy: Policy) -> tuple[Column, Column]:
    """(text with pseudonyms, number of replacements)."""
    pattern = expression(policy)
    if pattern is None:
        return text, F.lit(0)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    exact, folded = _map(policy.exact), _map(policy.folded)
    new = F.transform(found, lambda m: F.coalesce(exact[m], folded[F.translate(m, _UPPER, _LOWER)]))
    joined = F.array_join(F.flatten(F.zip_with(F.split(text, pattern, -1), new, lambda s, m: F.array(s, F.coalesce(m, F.lit(""))))), "")
    return F.when(F.size(found) > 0, joined).otherwise(text), F.size(found)


def occurrences(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal)))) / len(literal)).cast("long")
