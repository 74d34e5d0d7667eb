"""Naming the value of an expression inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    Spark doesn't share common parts inside higher-order functions, so an expression that uses
    an array several times would compute it as often.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
