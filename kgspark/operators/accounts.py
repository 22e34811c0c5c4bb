"""Users with their roles and teams, and changes to them that leave an audit row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active(users: DataFrame) -> DataFrame:
    """F12."""
    return users.where("active")


def with_roles(users: DataFrame, roles: DataFrame, teams: DataFrame) -> DataFrame:
    """Users with roles and teams as sorted arrays, empty where there are none.

    roles: user_id, role; teams: user_id, team. Each side is gathered on its own, so no user gets roles times teams rows.
    """
    none = F.array().cast("array<string>")
    for rows, name in ((roles, "role"), (teams, "team")):
        own = rows.groupBy("user_id").agg(F.array_sort(F.collect_set(name)).alias(f"{name}s"))
        users = users.join(own, "user_id", "left").withColumn(f"{name}s", F.coalesce(f"{name}s", none))
    return users


def effective_roles(user_roles: DataFrame, team_roles: DataFrame, user_teams: DataFrame) -> DataFrame:
    """user_id, role: the union of a user's own roles and those of the user's teams, each once."""
    by_team = user_teams.join(team_roles, "team").select("user_id", "role")
    return user_roles.select("user_id", "role").union(by_team).distinct()


def changed(users: DataFrame, changes: DataFrame, actor: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """The next users table and an audit row for every user that a change (user_id, active) really changes."""
    c = changes.dropDuplicates(["user_id"]).select("user_id", F.col("active").alias("_active"))
    met = users.join(c, "user_id", "left").withColumn("_hit", F.col("_active").isNotNull() & ~F.col("active").eqNullSafe(F.col("_active")))
    audit = met.where("_hit").select(
        F.lit(actor).alias("user_id"), F.lit("user.update").alias("action"), F.col("user_id").cast("string").alias("entity_id"),
        F.to_json(F.struct("active")).alias("old_value"), F.to_json(F.struct(F.col("_active").alias("active"))).alias("new_value"), now.alias("ts"),
    )
    return met.withColumn("active", F.coalesce("_active", "active")).select(users.columns), audit
