"""Recoding of survey and encounter columns.

``recode_map`` style functions leave unknown codes NULL; nothing here turns a
missing input into a zero.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_col


def at_least(c: Column | str, bound: float) -> Column:
    return (as_col(c) >= bound).cast("int")


def equals(c: Column | str, value) -> Column:
    return (as_col(c) == F.lit(value)).cast("int")


def in_set(c: Column | str, positive: list, valid: list) -> Column:
    """1 inside ``positive``, 0 elsewhere in ``valid``, NULL outside it."""
    c = as_col(c)
    return F.when(c.isin(valid), c.isin(positive).cast("int"))


def yes_no(c: Column | str, yes, no) -> Column:
    c = as_col(c)
    return F.when(c == F.lit(yes), 1).when(c == F.lit(no), 0)


def mapped(c: Column | str, table: dict, default=None) -> Column:
    """Look a code up in a literal table; a miss is NULL or ``default``."""
    lookup = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    hit = F.try_element_at(lookup, as_col(c))
    return hit if default is None else F.coalesce(hit, F.lit(default))


def without_sentinels(c: Column | str, sentinels: list) -> Column:
    c = as_col(c)
    return F.when(~c.isin(sentinels), c)


def day_count(c: Column | str, none_code: int = 88, longest: int = 30) -> Column:
    """Days per month: the code for "none" is 0, values past a month are missing."""
    c = as_col(c)
    return F.when(c == none_code, F.lit(0).cast("double")).when(c <= longest, c.cast("double"))


def valid_only(c: Column | str, values: list) -> Column:
    c = as_col(c)
    return F.when(c.isin(values), c)


def flag_if_known(c: Column | str, value) -> Column:
    c = as_col(c)
    return F.when(c.isNotNull(), (c == F.lit(value)).cast("int"))


def rescaled(c: Column | str, divisor: float) -> Column:
    return as_col(c).cast("double") / F.lit(float(divisor))


def filled(c: Column | str, text: str) -> Column:
    return F.coalesce(as_col(c), F.lit(text))


def relabelled(c: Column | str, old: str, new: str) -> Column:
    c = as_col(c)
    return F.when(c == old, F.lit(new)).otherwise(c)


def half_open_bands(c: Column | str, edges: list[float], labels: list[str]) -> Column:
    """Label of [edge, next edge); NULL outside."""
    c = as_col(c)
    out = F.when(c < edges[0], None)
    for edge, label in zip(edges[1:], labels):
        out = out.when(c < edge, F.lit(label))
    return out


def upper_closed_rule(
    c: Column | str, excluded: list, uppers: list[float], labels: list[str]
) -> Column:
    """Label by the first upper bound not exceeded; the last label is open-ended."""
    c = as_col(c)
    out = F.when(c.isNull() | c.isin(excluded), None)
    for bound, label in zip(uppers, labels):
        out = out.when(c <= bound, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def numeric_or_null(c: Column | str) -> Column:
    return as_col(c).try_cast("double")
