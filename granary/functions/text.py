"""Search predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches_any(term: str, *columns: str) -> Column:
    """Case-blind LIKE '%term%' on any column. The term is not escaped: % and _ are wildcards."""
    pattern = f"%{term.lower()}%"
    return reduce(lambda a, b: a | b, [F.lower(F.col(c)).like(pattern) for c in columns])


def contains_any(term: str, *columns: str) -> Column:
    """Case-blind literal substring on any column; a NULL column never matches."""
    needle = term.lower()
    found = [F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, found)
