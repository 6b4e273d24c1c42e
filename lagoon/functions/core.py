"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable; otherwise Catalyst
    may inline it into a lambda and evaluate it for every element."""
    return F.transform(F.array(value), body)[0]


def tidy(value: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(value, digits) + F.lit(0.0)
