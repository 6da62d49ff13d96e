"""Column functions: each takes and returns ``pyspark.sql.Column``.

They are built only from ``pyspark.sql.functions`` so they stay inside
whole-stage codegen and work on batch and streaming DataFrames alike.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable.

    Catalyst collapses adjacent projections, so an expensive column referenced
    from inside a higher-order-function lambda would otherwise be recomputed for
    every array element. Binding it through a one-element ``transform`` keeps it
    to one evaluation per row.
    """
    return F.get(F.transform(F.array(value), body), 0)


def int_array(values) -> Column:
    """Literal ``array<int>`` (an empty list gives a typed empty array)."""
    values = list(values)
    if not values:
        return F.array().cast("array<int>")
    return F.array(*[F.lit(int(v)) for v in values])


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
