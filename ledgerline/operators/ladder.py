"""Ladders: rows of (condition, status, question), of which the first true one decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONSISTENT, INCONSISTENT, CONFIRM, MISSING, OUT = "consistent", "inconsistent", "needs_confirmation", "missing", "out_of_scope"


def ladder(*rows: tuple[Column | None, str, str | Column | None]) -> Column:
    """struct<gate, status, question>; a condition of None is always true, a null condition is false."""
    out = None
    for i, (condition, status, question) in reversed(list(enumerate(rows, 1))):
        q = question if isinstance(question, Column) else F.lit(question).cast("string")
        row = F.struct(F.lit(i).alias("gate"), F.lit(status).alias("status"), q.alias("question"))
        out = row if condition is None else F.when(condition, row) if out is None else F.when(condition, row).otherwise(out)
    return out
