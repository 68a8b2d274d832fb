"""Name a value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often it is used.

    Branches of a conditional are not covered by common-subexpression
    elimination, so a long expression used in several of them would run again.
    """
    return F.transform(F.array(value), body)[0]
