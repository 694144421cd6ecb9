"""The catalog: users, tenants, environments, collections; and sessions.

Small tables held as DataFrames; parents don't list their children, lists are
filters.  Each call returns a new catalog, so a failed step leaves the old one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMAS = {
    "users": "id string, username string, tenants array<string>",
    "tenants": "id string, name string, owner string",
    "environments": "id string, name string, tenant string",
    "collections": "id string, name string, environment string",
    "sessions": "id string, username string, started long, seen long, active boolean",
    "session_log": "session string, level string, message string, at long",
}


class CatalogError(ValueError):
    """A name that exists already, or one that doesn't."""


@dataclass(frozen=True)
class Catalog:
    users: DataFrame
    tenants: DataFrame
    environments: DataFrame
    collections: DataFrame
    sessions: DataFrame
    session_log: DataFrame | None = None

    @classmethod
    def empty(cls, spark: SparkSession) -> Catalog:
        return cls(**{name: spark.createDataFrame([], schema) for name, schema in _SCHEMAS.items()})

    def put(self, kind: str, row: dict) -> Catalog:
        """Insert or replace one row by id."""
        table = getattr(self, kind)
        new = table.sparkSession.createDataFrame([tuple(row.get(c) for c in table.columns)], _SCHEMAS[kind])
        return replace(self, **{kind: table.where(F.col("id") != row["id"]).unionByName(new)})

    def get(self, kind: str, key: str) -> DataFrame:
        return getattr(self, kind).where(F.col("id") == key)

    def create_user(self, row: dict) -> Catalog:
        if not self.get("users", row["id"]).isEmpty():
            raise CatalogError(f"user {row['id']} exists already")
        return self.put("users", row)

    def _children(self, kind: str, parent_kind: str, column: str, parent: str) -> DataFrame:
        if self.get(parent_kind, parent).isEmpty():
            raise CatalogError(f"no {parent_kind[:-1]} {parent}")
        return getattr(self, kind).where(F.col(column) == parent).select("id", "name").orderBy("id")

    def list_environments(self, tenant: str) -> DataFrame:
        return self._children("environments", "tenants", "tenant", tenant)

    def list_collections(self, environment: str) -> DataFrame:
        return self._children("collections", "environments", "environment", environment)

    def list_tenants(self, owner: str) -> DataFrame:
        return self.tenants.where(F.col("owner") == owner).select("id", "name").orderBy("id")

    def drop_collection(self, environment: str, collection: str) -> Catalog:
        gone = (F.col("id") == collection) & (F.col("environment") == environment)
        return replace(self, collections=self.collections.where(~gone))

    def touch(self, session: str, now: int) -> Catalog:
        return replace(self, sessions=self.sessions.withColumn("seen", F.when(F.col("id") == session, F.lit(now)).otherwise(F.col("seen"))))

    def end(self, session: str) -> Catalog:
        return replace(self, sessions=self.sessions.withColumn("active", F.col("active") & (F.col("id") != session)))

    def expire(self, before: int) -> Catalog:
        """Drop sessions not seen since ``before``."""
        return replace(self, sessions=self.sessions.where(F.col("seen") >= before))

    # -- what sessions noted

    def note(self, entries: DataFrame) -> Catalog:
        """Add entries (session, level, message, at) to the session log."""
        entries = entries.select("session", "level", "message", F.col("at").cast("long").alias("at"))
        return replace(self, session_log=entries if self.session_log is None else self.session_log.unionByName(entries))

    def notes(self, session: str, level: str | None = None) -> DataFrame:
        """A session's entries, of one level in either case if that is given, oldest first."""
        if self.session_log is None:
            return self.sessions.sparkSession.createDataFrame([], _SCHEMAS["session_log"])
        found = self.session_log.where(F.col("session") == session)
        return (found.where(F.lower("level") == level.lower()) if level is not None else found).orderBy("at", "level", "message")

    def clear_notes(self, session: str) -> Catalog:
        """Drop a session's entries; entries without a session stay."""
        return self if self.session_log is None else replace(self, session_log=self.session_log.where(~F.col("session").eqNullSafe(session)))

    def clean_notes(self) -> Catalog:
        """Drop the entries of sessions that are no longer there."""
        if self.session_log is None:
            return self
        there = self.sessions.select(F.col("id").alias("session"))
        return replace(self, session_log=self.session_log.join(there, "session", "left_semi"))
