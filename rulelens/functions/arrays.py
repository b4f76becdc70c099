"""Expressions on arrays within a row: what a sentence's tokens say of one another needs no shuffle."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def labelled(token: Column, lang: Column, rules: Iterable[tuple[str, str, str]], otherwise: Column | None = None) -> Column:
    """The label of ``token`` by rules (form, language, label), each form once a language; hash lookups, no scan of rules."""
    groups: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    for form, language, label in rules:
        groups[language][label].append(form)
    none = F.lit(None).cast("string") if otherwise is None else otherwise
    out = none
    for language in sorted(groups):
        within = none
        for label in sorted(groups[language]):
            within = F.when(token.isin(groups[language][label]), F.lit(label)).otherwise(within)
        out = F.when(lang == language, within).otherwise(out)
    return out


def indexed(values: Column, body: Callable[[Column, Column], Column], keep: Callable[[Column], Column] | None = None) -> Column:
    """``body(value, place)`` of all values; those that ``keep`` holds of, if it is given."""
    made = F.transform(values, body)
    return F.filter(made, keep) if keep else made


def at(values: Column, place: Column) -> Column:
    """The value at a place, null outside."""
    return F.when((place >= 0) & (place < F.size(values)), F.get(values, place))


def run_length(values: Column, start: Column, holds: Callable[[Column], Column]) -> Column:
    """How many values from ``start`` on hold, up to the first that doesn't."""
    step = lambda acc, v: F.struct((acc["n"] + F.when(acc["on"] & holds(v), 1).otherwise(0)).alias("n"), (acc["on"] & holds(v)).alias("on"))
    rest = F.slice(values, start + 1, F.size(values))
    return F.aggregate(rest, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), step)["n"]
