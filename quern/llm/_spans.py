"""Positions of pattern matches, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._shared import let


def prefix_sums(a: Column) -> Column:
    """Running sums of an array of ints, by doubling strides: n log n steps for n entries."""

    def stride(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - back), F.lit(0)))

    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(F.size(a)))), a, stride)


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """An array of (start, end, found, part) of the leftmost non-overlapping matches in a text
    that has one: code points with exclusive end, the match, and what its group holds.

    The pieces between the matches and the matches alternate, so their lengths give positions.
    The pattern must not match the empty string.
    """

    def placed(pieces: Column, found: Column, parts: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.length(m) + F.length(pieces[i]))
        return let(
            prefix_sums(steps),
            lambda ends: F.transform(
                found, lambda m, i: F.struct((ends[i] - F.length(m)).alias("start"), ends[i].alias("end"), m.alias("found"), parts[i].alias("part"))
            ),
        )

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)
    whole = let(pieces, lambda p: let(found, lambda f: let(parts, lambda g: placed(p, f, g)) if group else placed(p, f, f)))
    return F.when(text.rlike(pattern), whole)


def any_case(word: str) -> str:
    """A pattern for ASCII letters in either case and nothing else that folds to them."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)
