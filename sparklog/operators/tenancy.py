"""Who may see what, and clean-up of users."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.operators.joins import join_dim


def restrict_to_user(df: DataFrame, projects: DataFrame, users: DataFrame, email: str) -> DataFrame:
    """Rows of the projects that the user owns."""
    owner = users.where(F.col("email") == email).select(F.col("id").alias("owner_id"))
    owned = projects.join(owner, "owner_id", "left_semi").select(F.col("id").alias("project_id"))
    return join_dim(df, owned, ["project_id"], "left_semi")


def projects_of(users: DataFrame, projects: DataFrame, email: str) -> DataFrame:
    """Projects of one owner; keys and hashes are not selected."""
    owner = users.where(F.col("email") == email).select(F.col("id").alias("owner_id"))
    return projects.join(owner, "owner_id").select("id", F.col("id").alias("project_id"), "name")


def purge_users(users: DataFrame, roles: DataFrame, condition: Column | str) -> tuple[DataFrame, DataFrame]:
    """(users, roles) without the users that match; a null condition keeps the user, as a DELETE would."""
    hit = F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))
    victims = users.where(hit).select(F.col("id").alias("user_id"))
    return users.where(~hit), roles.join(victims, "user_id", "left_anti")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Labelled row counts."""
    counts = [df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("info"), "count")
              for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)
