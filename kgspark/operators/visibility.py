"""Row-level visibility as column predicates.

NULL means "not set" and inherits; an empty array or false is explicit. A principal's tenant is enforced everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


DIMENSIONS = ("is_public", "roles", "teams", "tenant")


@dataclass(frozen=True)
class Principal:
    user_id: str = ""
    roles: tuple[str, ...] = ()
    teams: tuple[str, ...] = ()
    tenant: str | None = None

    @property
    def bypass(self) -> bool:
        """Admins and editors see every row (a named exception)."""
        return bool({"admin", "editor"} & set(self.roles))


def _array(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def overlaps(column: Column, values: tuple[str, ...]) -> Column:
    """Whether an array shares a value; NULL and empty arrays never do."""
    return F.coalesce(F.arrays_overlap(column, _array(values)), F.lit(False))


def visible(principal: Principal, is_public: Column, roles: Column, teams: Column, tenant: Column) -> Column:
    """bypass, else tenant matches (or none is set) and the row is public or shares a role or team."""
    if principal.bypass:
        return F.lit(True)
    home = tenant.isNull() | (tenant.eqNullSafe(F.lit(principal.tenant)))
    return home & (F.coalesce(is_public, F.lit(False)) | overlaps(roles, principal.roles) | overlaps(teams, principal.teams))


def visible_rows(df: DataFrame, principal: Principal) -> DataFrame:
    return df.where(visible(principal, F.col("is_public"), F.col("roles"), F.col("teams"), F.col("tenant")))


def with_parent(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Each fact's effective visibility, dimension by dimension: its own value, else its entity's.

    NULL inherits, also in the four columns that the facts do not have; empty arrays and false are explicit. A left join:
    facts without an entity keep their own visibility.
    """
    e = entities.select(F.col("id").alias("entity_id"), *[F.col(c).alias(f"_entity_{c}") for c in DIMENSIONS])
    own = [F.coalesce(c, f"_entity_{c}") if c in facts.columns else F.col(f"_entity_{c}") for c in DIMENSIONS]
    met = facts.join(e, "entity_id", "left").withColumns(dict(zip(DIMENSIONS, own, strict=True)))
    return met.drop(*[f"_entity_{c}" for c in DIMENSIONS])


def patched(df: DataFrame, patch: DataFrame, key: str, *columns: str) -> DataFrame:
    """Replace columns by the patch's values where those are set.

    With a column ``unset`` (array of names) the patch also sets NULL: the columns named in it lose their value, so that
    they inherit again.
    """
    unset = F.col("unset") if "unset" in patch.columns else F.array().cast("array<string>")
    p = patch.select(key, unset.alias("_unset"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = df.join(p, key, "left")
    for c in columns:
        gone = F.coalesce(F.array_contains("_unset", c), F.lit(False))
        out = out.withColumn(c, F.when(~gone, F.coalesce(f"_{c}", c))).drop(f"_{c}")
    return out.drop("_unset")
