"""Bind a column to a name inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    A column that is mentioned inside a lambda is evaluated again for every
    array element, which turns a linear expression into a quadratic one.
    """
    return F.transform(F.array(value), body)[0]
