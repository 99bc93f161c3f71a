"""Column helpers: rounding, lookups, formatted ids and derived fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F


def half_even(value: Column, places: int) -> Column:
    """Round the scaled double half to even, as array libraries do; used for row values."""
    scale = float(10**places)
    return F.rint(value * scale) / scale


def _mean(value: Column, places: int, digits: int) -> Column:
    """The mean in units of the last place that is kept. Values of `digits` decimals are added up as whole numbers, so
    the sum is exact and does not depend on the order of partial sums; rounding is left to the caller, once."""
    total = F.sum(F.round(value * float(10**digits)).cast("decimal(38,0)")).cast("double")
    return F.try_divide(total * float(10 ** max(places - digits, 0)), F.count(value) * float(10 ** max(digits - places, 0)))


def mean_half_even(value: Column, places: int, digits: int) -> Column:
    """Mean of values of at most `digits` decimals, rounded half to even as array libraries do."""
    return F.rint(_mean(value, places, digits)) / float(10**places)


def mean_half_up(value: Column, places: int, digits: int) -> Column:
    """Mean of values of at most `digits` decimals, rounded half up as SQL does."""
    return F.round(_mean(value, places, digits)) / float(10**places)


def percent(ratio: Column, places: int = 1) -> Column:
    """A ratio of three decimals as a percentage."""
    return F.round(ratio * 100.0, places)


def percent_of(part: Column, whole: Column) -> Column:
    """Share of two counts in percent with one decimal, rounded half up, from whole numbers."""
    return F.call_function("div", part * 2000 + whole, whole * 2) / 10.0


def lookup(key: Column, entries: Mapping[Any, Any]) -> Column:
    """Dictionary lookup as a map literal; an unknown key gives null."""
    literals = [F.lit(x) for x in chain.from_iterable(entries.items())]
    return F.try_element_at(F.create_map(*literals), key)


def cluster_name(cluster: Column, names: Mapping[int, str]) -> Column:
    return F.coalesce(lookup(cluster.cast("int"), names), F.concat(F.lit("Cluster "), cluster.cast("string")))


def padded_id(prefix: str, number: Column, width: int) -> Column:
    """`EQ-0007`: zero padded, and never cut when the number is wider than the padding."""
    digits = number.cast("string")
    return F.concat(F.lit(f"{prefix}-"), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")))


def offset_date(start: str, days: Column) -> Column:
    return F.date_add(F.lit(start).cast("date"), days.cast("int"))


def iso_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def age_in(year: int, installation_year: Column) -> Column:
    return F.lit(year) - installation_year


def keep_when(condition: Column, value: Column) -> Column:
    """The value where the condition holds, null elsewhere."""
    return F.when(condition, value)


def is_any(column: str, values: Sequence[Any] | None) -> Column | None:
    """Multi-select predicate. No selection means no predicate."""
    return F.col(column).isin(list(values)) if values else None


def with_all(df: DataFrame, predicates: Sequence[Column | None]) -> DataFrame:
    for predicate in predicates:
        if predicate is not None:
            df = df.filter(predicate)
    return df
