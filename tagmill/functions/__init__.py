"""Scalar functions that several operators share, all of them column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: In front of a pattern: classes and boundaries over all of Unicode, with and without regard to case.
EXACT, ANY_CASE = "(?U)", "(?iU)"


def stripped(value: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def present(value: Column) -> Column:
    return F.coalesce(stripped(value) != "", F.lit(False))


def tokens(text: Column) -> Column:
    """What white space separates."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def hit(text: Column, pattern: str, group: int = 0) -> Column:
    """A group of the pattern's first match, null where there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def hits(words: Column, pattern: str, group: int = 0) -> Column:
    """hit() of each word (structs with a text) that matches, in order."""
    return F.transform(F.filter(words, lambda w: w["text"].rlike(pattern)), lambda w: F.regexp_extract(w["text"], pattern, group))


def first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def last(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


def before(items: Column, stop: Column) -> Column:
    """The items in front of the place (from 1) of the first one to stop at, all of them where it is 0."""
    return F.when(stop == 0, items).otherwise(F.slice(items, F.lit(1), stop - 1))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def box_around(words: Column) -> Column:
    """STRUCT x, y, w, h around words (structs with these), null where there are none."""
    edge = lambda f, ws, of: f(F.transform(ws, of))

    def box(ws: Column) -> Column:
        x, y = edge(F.array_min, ws, lambda w: w["x"]), edge(F.array_min, ws, lambda w: w["y"])
        right, bottom = edge(F.array_max, ws, lambda w: w["x"] + w["w"]), edge(F.array_max, ws, lambda w: w["y"] + w["h"])
        return F.when(F.size(ws) > 0, F.struct(x.alias("x"), y.alias("y"), (right - x).alias("w"), (bottom - y).alias("h")))

    return first(F.transform(F.array(words), box))  # the words are found once, not at each edge


def nano(value: Column) -> Column:
    """In billionths, as integers: their sums don't depend on the order of rows."""
    return F.round(value * 1_000_000_000).cast("long")


def mean3(total: Column, n: Column) -> Column:
    """The mean of n values whose billionths sum to total, rounded to 3 places, halves up."""
    return F.floor((total * 2 + n * 1_000_000) / (n * 2_000_000)) / 1000


def mapping(values: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def none_of(found: Column, known: Iterable[str]) -> Column:
    return ~F.coalesce(found.isin(*known), F.lit(False))
