"""Fact-to-dimension joins with a checked broadcast, and the top rows of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_ROWS = 200_000
MAX_BYTES = 64 * 1024 * 1024
SALTS = 16


def fits_broadcast(dim: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Measure the dimension: at most ``max_rows`` rows and ``max_bytes`` of JSON text.

    One aggregation over the dimension alone, combined in its tasks; only two numbers reach the driver.
    """
    row_bytes = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in dim.columns])))
    rows, size = dim.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def join_dim(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "inner",
    condition: Column | None = None,
    salts: int = SALTS,
    max_rows: int = MAX_ROWS,
    fits: bool | None = None,
) -> DataFrame:
    """Join facts with a dimension on equal columns, plus an optional residual condition.

    A dimension that is measured as small is broadcast, so the facts are not shuffled. A larger one is
    joined by shuffle with the facts salted: every fact row gets one salt, made of the row and its task
    so that equal rows of different tasks spread too, and every dimension row is repeated once per salt, so one hot key spreads over ``salts`` tasks and the result is the same for
    inner, left, semi and anti joins. That join is hinted as a merge join, since Spark's size estimate leaves out the repeats and would send
    all of them through the driver. ``fits`` is the result of a measurement that was already made. ``condition`` may use columns of both sides; the names must differ.
    """
    side = dim.select(*[F.col(c).alias(f"_k_{c}") if c in on else F.col(c) for c in dim.columns])
    keys = on
    if fits_broadcast(dim, max_rows) if fits is None else fits:
        side = F.broadcast(side)
    else:
        keys = [*on, "_salt"]
        facts = facts.withColumn("_salt", F.pmod(F.xxhash64(F.spark_partition_id(), *_hashable(facts)), F.lit(salts)))
        side = side.withColumn("_k__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))).hint("merge")
    matches = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    if condition is not None:
        matches.append(condition)
    joined = facts.join(side, matches, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_salt")
    return joined.drop(*[f"_k_{k}" for k in keys], "_salt")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, splits: int = 64) -> DataFrame:
    """The first ``k`` rows of every group, with their ``rank``.

    Every task keeps at most ``k`` rows per group before the shuffle. Those are ranked in ``splits``
    parts first, so the last step sees at most ``splits * k`` rows per group, however many tasks fed it.
    """
    part = Window.partitionBy(*keys, "_part").orderBy(*order)
    parts = df.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(splits)))
    heads = parts.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= k).drop("_rank", "_part")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return heads.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)


def _hashable(df: DataFrame) -> list[str]:
    """Columns that can feed a hash (maps and variants cannot)."""
    return [f.name for f in df.schema.fields if f.dataType.simpleString().split("<")[0] not in ("map", "variant")]
