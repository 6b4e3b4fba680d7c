"""Sums of doubles that do not depend on the order in which tasks add them up.

Where two sums are told apart or ranked, the noise of different orders would part what is equal: the values of a user who
did nothing in between, or of two users who did the same. A double is cut into a decimal of DIGITS places, whose sums are
exact, and the rest, which is zero for values of so many places and far below the last bit of the sum for others. Values
that the decimal cannot hold (1e10 and more, NaN, infinite) are all rest and add up as doubles do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 8
_KIND = f"decimal(18,{DIGITS})"


def cut(value: Column) -> tuple[Column, Column]:
    """The decimal and the rest of a value, which add up to it; both null where it is."""
    value = value.cast("double")
    held = F.coalesce(value.try_cast(_KIND), F.when(value.isNotNull(), F.lit(0).cast(_KIND)))
    return held, value - held.cast("double")


def joined(held: Column, rest: Column) -> Column:
    """The double that sums of both parts stand for."""
    return held.cast("double") + rest


def total(value: Column) -> Column:
    """The sum of a column as an aggregate."""
    held, rest = cut(value)
    return joined(F.sum(held), F.sum(rest))
