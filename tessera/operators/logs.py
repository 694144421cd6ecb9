"""Queries over JSON-lines logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TYPED = {"timestamp": "string", "level": "string", "message": "string", "target": "string", "threadId": "long", "threadName": "string", "filename": "string", "line_number": "int", "session_id": "string", "username": "string"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a log; blank lines and lines that aren't JSON objects are skipped.  ``entry`` keeps the whole line."""
    return parse(spark.read.text(path))


def parse(lines: DataFrame) -> DataFrame:
    """Lines (``value``) to typed columns plus ``entry``."""
    rows = lines.where(F.trim("value") != "").select(F.try_parse_json("value").alias("entry"))
    rows = rows.where(F.col("entry").isNotNull() & F.startswith(F.schema_of_variant("entry"), F.lit("OBJECT")))
    return rows.select(*(F.try_variant_get("entry", f"$.{c}", kind).alias(c) for c, kind in _TYPED.items()), "entry")


def _first_string(keys: list[str], nested: bool) -> Column:
    """The first of ``keys`` whose value is a string, at the top and then under ``fields``."""
    found = []
    for prefix in ("$", "$.fields") if nested else ("$",):
        for key in keys:
            v = F.try_variant_get("entry", f"{prefix}.{key}", "variant")
            found.append(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get("entry", f"{prefix}.{key}", "string")))
    return F.coalesce(*found)


def by_session(entries: DataFrame, session: str, *, compat: bool = False) -> DataFrame:
    """A session's entries; ``compat`` looks at top-level keys only."""
    return entries.where(_first_string(["session_id", "sessionId", "session"], not compat) == session)


def by_user(entries: DataFrame, user: str, *, compat: bool = False) -> DataFrame:
    return entries.where(_first_string(["username", "user"], not compat) == user)


def by_level(entries: DataFrame, level: str) -> DataFrame:
    """Entries of a level in either case; those without one are dropped."""
    return entries.where(F.lower("level") == level.lower())
