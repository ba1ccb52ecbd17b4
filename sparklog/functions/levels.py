"""Log levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklog import constants as C


def level_severity(level: Column) -> Column:
    """1 for TRACE up to 6 for FATAL, null for anything else."""
    rank = F.array_position(F.array(*[F.lit(name) for name in C.LEVELS]), level)
    return F.when(rank > 0, rank.cast("int"))


def known_level(text: Column, default: str = "INFO") -> Column:
    """Upper-cased level, or the default if it is missing or unknown."""
    upper = F.upper(text)
    return F.when(upper.isin(*C.LEVELS), upper).otherwise(F.lit(default))


def is_error(level: Column) -> Column:
    return F.upper(level).isin(*C.ERROR_LEVELS)


def is_warning(level: Column) -> Column:
    return F.upper(level) == "WARN"
