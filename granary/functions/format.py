"""Numbers as short texts, for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thousands and their signs.
UNITS = ((1e9, "B"), (1e6, "M"), (1e3, "K"))


def short_number(c: Column, digits: int = 1) -> Column:
    """1234 as 1.2K; whole numbers under a thousand as they are."""
    x = c.cast("double")
    out = F.format_string("%s", F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.round(x, digits).cast("string")))
    for size, sign in reversed(UNITS):
        out = F.when(F.abs(x) >= size, F.concat(F.round(x / size, digits).cast("string"), F.lit(sign))).otherwise(out)
    return F.when(x.isNotNull(), out)


def percent(c: Column, digits: int = 1) -> Column:
    """0.125 as 12.5%."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f%%", c.cast("double") * 100))
