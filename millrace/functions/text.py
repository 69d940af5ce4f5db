"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_id(col: Column | str) -> Column:
    """An id without the blanks and tabs at its ends, in lower case."""
    return F.lower(F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(" \t")))


def blank_to_null(col: Column | str) -> Column:
    """NULL for empty or blank text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.btrim(c, F.lit(" \t\r\n")) != "", c)
