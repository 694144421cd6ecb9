"""Mutable collections on plain Parquet: an append-only change log and its snapshot.

Every write appends rows (collection, id, op, when, place, document).  The
snapshot is the last row of each id unless that is a delete, found by one
partial aggregation (``max_by``), not by a window.  The log doubles as the
source of the change stream.
"""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.documents import DOCUMENT, envelope, no_vector

LOG = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("batch", T.LongType()),
    T.StructField("place", T.LongType()),
    *DOCUMENT.fields[1:],
    T.StructField("emit", T.BooleanType()),
    T.StructField("collection", T.StringType()),
])
_FIELDS = [f.name for f in DOCUMENT.fields[1:]]


class OperationError(ValueError):
    """A multi-collection operation that can't be read."""


def snapshot(log: DataFrame) -> DataFrame:
    """Documents that a change log leaves: the latest row of each id, deletes dropped."""
    last = log.groupBy("collection", "id").agg(F.max_by(F.struct("op", *_FIELDS), F.struct("batch", "place")).alias("d"))
    return last.where("d.op <> 'delete'").select("collection", "id", *(F.col(f"d.{c}").alias(c) for c in _FIELDS))


class Store:
    """Collections under one path."""

    def __init__(self, spark: SparkSession, path: str, *, compat: bool = False, cached: int = 4):
        self.spark, self.path, self.compat = spark, path.rstrip("/"), compat
        self._last = 0
        self._cached, self._snapshots = cached, OrderedDict[str, DataFrame]()

    def _batch(self) -> int:
        self._last = max(self._last + 1, time.time_ns())
        return self._last

    def log(self) -> DataFrame:
        """All changes so far."""
        return self.spark.read.schema(LOG).parquet(self.path) if self._exists() else self.spark.createDataFrame([], LOG)

    def _exists(self) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()).exists(target)

    def _append(self, df: DataFrame, collection: Column | str, op: Column | str, emit: bool) -> None:
        op = F.lit(op) if isinstance(op, str) else op
        collection = F.lit(collection) if isinstance(collection, str) else collection
        place = F.col("__place") if "__place" in df.columns else F.monotonically_increasing_id()
        rows = df.select("id", op.alias("op"), F.lit(self._batch()).alias("batch"), place.cast("long").alias("place"), *(F.col(c) for c in _FIELDS), F.lit(emit).alias("emit"), collection.alias("collection"))
        rows.write.mode("append").partitionBy("collection").parquet(self.path)
        self.forget()

    # -- reads

    def scan(self, collection: str) -> DataFrame:
        """A collection's documents; only its folder is read."""
        return snapshot(self.log().where(F.col("collection") == collection)).drop("collection")

    def get(self, collection: str, doc_id: str) -> DataFrame:
        return snapshot(self.log().where((F.col("collection") == collection) & (F.col("id") == doc_id))).drop("collection")

    def get_cached(self, collection: str, doc_id: str) -> tuple[DataFrame, bool]:
        """``get`` on a kept snapshot of the collection, and whether that was kept already.

        The ``cached`` collections last read are kept, in Spark's storage and on
        disk beyond it; any write through this store drops them.  Writes of
        other stores aren't seen until ``forget``.
        """
        hit = collection in self._snapshots
        if not hit:
            self._snapshots[collection] = self.scan(collection).persist(StorageLevel.MEMORY_AND_DISK)
        self._snapshots.move_to_end(collection)
        found = self._snapshots[collection].where(F.col("id") == doc_id)
        while len(self._snapshots) > max(1, self._cached):
            self._snapshots.popitem(last=False)[1].unpersist()
        return found, hit

    def forget(self) -> None:
        """Drop the kept snapshots."""
        while self._snapshots:
            self._snapshots.popitem()[1].unpersist()

    def all(self) -> DataFrame:
        return snapshot(self.log())

    # -- writes

    def upsert(self, collection: str, docs: DataFrame) -> None:
        """Insert or replace documents; of equal ids in one call the later row wins."""
        docs = envelope(docs)
        known = self.scan(collection).select("id", F.lit(True).alias("__known"))
        docs = docs.withColumn("__place", F.monotonically_increasing_id()).join(known, "id", "left")
        self._append(docs, collection, F.when(F.col("__known"), "update").otherwise("insert"), True)

    insert = update = upsert

    def insert_vectors(self, collection: str, vectors: DataFrame) -> None:
        """Vectors (id, vector[, metadata]) as documents without text, of category ``vector``."""
        self.upsert(collection, vectors.withColumns({"text": F.lit(""), "category": F.lit("vector")}))

    def delete(self, collection: str, ids: Sequence[str]) -> None:
        """Delete by id; absent ids are fine and still make an event."""
        rows = self.spark.createDataFrame([(i,) for i in ids], "id string")
        self._append(rows.select("id", *(F.lit(None).cast(DOCUMENT[c].dataType).alias(c) for c in _FIELDS)), collection, "delete", True)

    def drop_collection(self, collection: str) -> None:
        """Delete all documents of a collection, without events."""
        rows = self.scan(collection).select("id", *(F.lit(None).cast(DOCUMENT[c].dataType).alias(c) for c in _FIELDS))
        self._append(rows, collection, "delete", False)

    def compact(self, collection: str) -> None:
        """Rewrite a collection's log as its snapshot; replaced and deleted rows go, and with them their events.

        Nobody else may read or write the collection meanwhile, and consumers of
        its stream must have caught up.  Rows keep their batch, so what is
        written later still wins.  Old files go oldest first: should that be
        interrupted, a delete outlives the rows that it hides.
        """
        if not self._exists():
            return
        log = self.log().where(F.col("collection") == collection)
        files = [r.path for r in log.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.max("batch").alias("batch")).orderBy("batch").collect()]
        if not files:
            return
        whole = F.struct(*log.columns)
        last = log.groupBy("id").agg(F.max_by(whole, F.struct("batch", "place")).alias("d")).select("d.*").where("op <> 'delete'")
        last.withColumn("emit", F.lit(False)).write.mode("append").partitionBy("collection").parquet(self.path)
        hadoop = self.spark._jsc.sc().hadoopConfiguration()
        for path in files:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(self.spark._jvm.java.net.URI(path))
            target.getFileSystem(hadoop).delete(target, False)
        self.forget()

    def multi(self, spec: dict) -> DataFrame:
        """``{operation, collections, documents}`` over several collections: (collection, id, status)."""
        op, names, docs = parse_operation(spec)
        rows = documents_frame(self.spark, docs)
        quiet = self.compat
        if op == "insert":
            done = round_robin(rows, names)
            self._append(done, F.col("collection"), "insert", not quiet)
            return done.select("collection", "id", F.lit("inserted").alias("status"))
        pairs = rows.withColumn("collection", F.explode(F.array(*(F.lit(n) for n in names))))
        if op == "delete":
            gone = pairs.select("collection", "id", "__place", *(F.lit(None).cast(DOCUMENT[c].dataType).alias(c) for c in _FIELDS))
            self._append(gone, F.col("collection"), "delete", not quiet)
            return pairs.select("collection", "id", F.lit("deleted").alias("status"))
        changed = updated(snapshot(self.log().where(F.col("collection").isin(names))), pairs)
        status = self.spark.createDataFrame(changed.select("collection", "id", F.lit("updated").alias("status")).toArrow()) if names else changed
        self._append(changed, F.col("collection"), "update", not quiet)
        return status


def parse_operation(spec: dict) -> tuple[str, list[str], list[dict]]:
    if not isinstance(spec, dict) or spec.get("operation") not in ("insert", "update", "delete"):
        raise OperationError("operation must be insert, update or delete")
    if not isinstance(spec.get("collections"), list):
        raise OperationError("collections must be a list")
    names = [c for c in spec["collections"] if isinstance(c, str)]
    if not names:
        raise OperationError("no collections")
    docs = spec.get("documents") or []
    if not isinstance(docs, list):
        raise OperationError("documents must be a list")
    return spec["operation"], names, [d for d in docs if isinstance(d, dict)]


def documents_frame(spark: SparkSession, docs: list[dict]) -> DataFrame:
    """Literal documents as rows; fields that a document doesn't have are NULL."""
    import json

    rows = []
    for i, d in enumerate(docs):
        metadata = d.get("metadata")
        rows.append((i, str(d.get("id", "")), d.get("text"), d.get("category"), [float(x) for x in d["vector"]] if isinstance(d.get("vector"), list) else None, None if metadata is None else json.dumps(metadata, separators=(",", ":"), ensure_ascii=False)))
    return spark.createDataFrame(rows, "__place long, id string, text string, category string, vector array<float>, metadata string")


def round_robin(rows: DataFrame, collections: Sequence[str]) -> DataFrame:
    """Document i goes to collection i mod n; absent fields get their defaults."""
    names = F.array(*(F.lit(n) for n in collections))
    return rows.select("__place", "id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("vector", no_vector()).alias("vector"), F.coalesce("metadata", F.lit("{}")).alias("metadata"), F.get(names, F.pmod(F.col("__place"), F.lit(len(collections))).cast("int")).alias("collection"))


def updated(current: DataFrame, pairs: DataFrame) -> DataFrame:
    """Existing documents with given fields replaced (metadata as a whole); absent ids give nothing."""
    new = pairs.select("collection", "id", "__place", *(F.col(c).alias(f"__{c}") for c in _FIELDS))
    return current.join(new, ["collection", "id"]).select("collection", "id", "__place", *(F.coalesce(f"__{c}", c).alias(c) for c in _FIELDS))
