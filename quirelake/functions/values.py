"""Values of column expressions that are used more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once.

    Inside a fold or a transform each mention of an expression is worked out anew, as often as it is named and, in a nested lambda, for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
