"""Name an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An array expression mentioned inside a lambda is computed again for every
    element; as a lambda variable it is computed once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
