"""The change feed: a stream over the change log, subscriptions, and windows."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.dml import LOG


def events_of(log: DataFrame) -> DataFrame:
    """Change-log rows, static or streaming, as events: event_type, collection, id, data (JSON, null for deletes), timestamp (s)."""
    data = F.when(F.col("op") != "delete", F.to_json(F.struct("id", "text", "category", "vector", F.try_parse_json("metadata").alias("metadata"))))
    return log.where("emit").select(F.col("op").alias("event_type"), "collection", "id", data.alias("data"), F.floor(F.col("batch") / 1_000_000_000).cast("long").alias("timestamp"))


def feed(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The stream of events of a store; a consumer's checkpoint remembers how far it came."""
    return events_of(spark.readStream.schema(LOG).options(**options).parquet(path))


def wanted(collections: Iterable[str] = (), documents: Iterable[str] = ()) -> Column:
    """Which events a subscriber gets: all without subscriptions, else those of a collection or a ``collection:id``."""
    collections, documents = list(collections), list(documents)
    if not collections and not documents:
        return F.lit(True)
    return F.col("collection").isin(*collections) | F.concat_ws(":", "collection", "id").isin(*documents)


def subscribe(events: DataFrame, collections: Iterable[str] = (), documents: Iterable[str] = ()) -> DataFrame:
    return events.where(wanted(collections, documents))


def subscribe_by(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Events for each subscriber of a control table (subscriber, kind, key); kind is collection or document.

    A subscriber with no rows isn't in the table and so gets nothing here;
    kind ``all`` asks for everything.
    """
    doc = F.concat_ws(":", events["collection"], events["id"])
    match = ((F.col("kind") == "collection") & (F.col("key") == events["collection"])) | ((F.col("kind") == "document") & (F.col("key") == doc)) | (F.col("kind") == "all")
    return events.join(subscriptions, match).select("subscriber", *events.columns).dropDuplicates()


def subscriptions(messages: DataFrame) -> DataFrame:
    """The control table that subscribers' messages leave.

    ``messages`` has (subscriber, at, message): JSON with ``action`` subscribe or
    unsubscribe and a ``collection``, with or without a document ``id``.  Other
    actions, names that aren't strings, and texts that aren't such an object
    change nothing; an ``id`` that isn't a string counts as absent.  The latest
    message on a key decides (of equal times a subscribe); a subscriber who has
    no key left gets everything.
    """
    m = F.try_parse_json("message")
    at = lambda name: F.try_variant_get(m, f"$.{name}", "variant")
    get = lambda name: F.when(F.schema_of_variant(at(name)) == "STRING", F.try_variant_get(m, f"$.{name}", "string"))
    rows = messages.select("subscriber", "at", get("action").alias("action"), get("collection").alias("collection"), get("id").alias("id"))
    rows = rows.withColumn("heard", F.coalesce(F.col("action").isin("subscribe", "unsubscribe") & F.col("collection").isNotNull(), F.lit(False)))
    kind = F.when(F.col("id").isNull(), "collection").otherwise("document")
    rows = rows.select("subscriber", "at", "action", F.when(F.col("heard"), kind).alias("kind"), F.when(F.col("heard"), F.concat_ws(":", "collection", "id")).alias("key"))
    last = rows.groupBy("subscriber", "kind", "key").agg(F.max_by("action", F.struct("at", F.col("action") == "subscribe")).alias("action"))
    held = last.where("key is not null and action = 'subscribe'").select("subscriber", "kind", "key")
    empty = last.select("subscriber").distinct().join(held, "subscriber", "left_anti")
    return held.unionByName(empty.select("subscriber", F.lit("all").alias("kind"), F.lit("").alias("key")))


def with_time(events: DataFrame, column: str = "timestamp") -> DataFrame:
    """Event time as a timestamp column ``at`` (a time without zone is taken as UTC)."""
    kind = events.schema[column].dataType.simpleString()
    return events.withColumn("at", F.timestamp_seconds(column) if kind in ("bigint", "int") else F.col(column).cast("timestamp"))


def tumbling(events: DataFrame, every: str, *keys: str, late: str | None = None) -> DataFrame:
    """Counts in fixed windows; with ``late`` a watermark lets a stream drop old state."""
    return sliding(events, every, every, *keys, late=late)


def sliding(events: DataFrame, length: str, step: str, *keys: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("at", late) if late else events
    out = rows.groupBy(F.window("at", length, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def sessions(events: DataFrame, gap: str, *keys: str, late: str | None = None) -> DataFrame:
    """Counts in sessions that end after ``gap`` without an event."""
    rows = events.withWatermark("at", late) if late else events
    out = rows.groupBy(F.session_window("at", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def run_now(stream: DataFrame, name: str, *, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Process all that is there into an in-memory table and return it: for tests and small reports.

    The table is this run's alone and leaves no view behind, so runs at the
    same time don't collide; ``name`` begins the name of the stream.
    """
    spark = stream.sparkSession
    view = f"{name}_{uuid.uuid4().hex}"
    writer = stream.writeStream.format("memory").queryName(view).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    try:
        query.awaitTermination()
        return spark.table(view)
    finally:
        spark.catalog.dropTempView(view)
