"""Sharding by sampled splitters: key samples weighted by size, quantile bounds, ranges.

Law ``bytes``: shards have nearly equal sizes (no two differ by more than the
largest record or so).  The key is (checksum of the text, id, row number), so copies of
a text lie together and leave their shard only where it would be overfull.

A bounded sample, each row drawn in proportion to its size, gives splitters
for many narrow ranges.  Sizes of the ranges are then summed over all rows;
ranges that are overfull are cut again by a sample of their own.  A running sum
inside each range, on top of the sum of the ranges before, says how many bytes
come before a record, and so its shard; places (slots) are counted likewise.
The sample decides only how the work is spread, never which shard a row gets.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._io import fresh, materialise

SHARDS = 24
LAW = "bytes"
#: Sampled keys a range, and rows for which there is one range at least: the driver gathers the one for the other.
PER_RANGE, RANGE_ROWS = 16, 1_000_000


def size_of(text: Column) -> Column:
    """UTF-8 bytes (null: none) plus 8."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 8


def checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _pack(crc: pd.Series, key: pd.Series, tie: pd.Series) -> np.ndarray:
    """Keys as 20 big-endian bytes, which sort like the triples."""
    out = np.zeros(len(crc), dtype=[("a", ">u4"), ("b", ">u8"), ("c", ">u8")])
    out["a"] = crc.to_numpy(np.int64).astype(np.uint64).astype(np.uint32)
    for name, column in (("b", key), ("c", tie)):
        out[name] = column.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.view("S20").ravel() if len(out) else np.zeros(0, "S20")


def splitters(df: DataFrame, names: Names, ranges: int, total: int) -> np.ndarray:
    """Quantile bounds (packed keys) of about ``ranges`` ranges, from a size-weighted sample of ``PER_RANGE`` keys each."""
    if not total:
        return np.zeros(0, "S20")
    # uniform in [0, 1) from the key: the same on every run
    u = (F.shiftrightunsigned(F.xxhash64(*names.key, F.lit(7)), 11)).cast("double") * F.lit(2.0**-53)
    rate = ranges * PER_RANGE / total
    drawn = df.where(u < F.col(names.size) * rate).select(*names.key, F.greatest(F.col(names.size) * rate, F.lit(1.0)).alias("w"))
    sample = drawn.toPandas()  # about ranges * PER_RANGE rows: each stands for that share of the bytes or its own size
    if not len(sample):
        return np.zeros(0, "S20")
    keys = _pack(*(sample[c] for c in names.key))
    order = np.argsort(keys, kind="stable")
    reached = np.cumsum(sample["w"].to_numpy()[order])
    at = np.searchsorted(reached, np.arange(1, ranges) * reached[-1] / ranges)
    return np.unique(keys[order][np.minimum(at, len(order) - 1)])


def _ranged(df: DataFrame, names: Names, bounds: np.ndarray) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(bounds)  # 20 bytes a range

    @F.pandas_udf("int")
    def find(crc: pd.Series, key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sent.value, _pack(crc, key, tie), "right").astype(np.int32))

    return df.withColumn(names.range, find(*names.key))


@dataclass(frozen=True)
class Names:
    """Names of the helper columns, none of which a given column has."""

    crc: str
    id: str
    tie: str
    size: str
    range: str
    sum: str
    place: str
    before: str
    base: str

    @property
    def key(self) -> tuple[str, str, str]:
        return self.crc, self.id, self.tie


def assign(df: DataFrame, *, key_col: str, shards: int = SHARDS) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... in each shard) under law ``bytes``.

    ``df`` has whole-number columns ``size`` and ``text_crc32`` beside the
    key.  All columns are kept (``shard`` and ``slot`` are replaced).  It is
    written once to the shared folder, so that all passes see the same rows,
    numbered: a key that many rows share is cut by that number.  Null keys
    come first; rows of one key and checksum may take either order, which
    shows in nothing but which of them has which place.  An empty table gives
    an empty result.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    kept = df.columns
    n = Names(*(fresh(f"_{f.name}", [*kept, "shard", "slot"]) for f in fields(Names)))
    work = df.withColumns({
        n.crc: F.coalesce(F.col("text_crc32"), F.lit(0)).cast("long"),
        n.id: F.coalesce(F.col(key_col).cast("long"), F.lit(-(2**63))),
        n.tie: F.monotonically_increasing_id(),
        n.size: F.coalesce(F.col("size"), F.lit(0)).cast("long"),
    })
    work = materialise(work, "shards")
    rows, total = work.agg(F.count(F.lit(1)), F.coalesce(F.sum(n.size), F.lit(0))).first()
    ranges = max(8 * shards, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS)
    bounds = splitters(work, n, ranges, total)
    ranged = _ranged(work, n, bounds)
    sums = ranged.groupBy(n.range).agg(F.sum(n.size).alias("bytes")).toPandas()  # one row a range
    over = sums[sums["bytes"] > 4 * max(total, 1) / ranges]
    if len(over):
        # what the sample missed: cut the overfull ranges at a finer sample of their own
        held = int(over["bytes"].sum())
        inside = ranged.where(F.col(n.range).isin(over[n.range].tolist()))
        bounds = np.unique(np.concatenate([bounds, splitters(inside, n, max(2, 4 * -(-held * ranges // total)), held)]))
        ranged = _ranged(work, n, bounds)
        sums = ranged.groupBy(n.range).agg(F.sum(n.size).alias("bytes")).toPandas()
    sums = sums.sort_values(n.range)
    before = {int(r): int(b) for r, b in zip(sums[n.range], sums["bytes"].cumsum() - sums["bytes"], strict=True)}
    starts = spark.createDataFrame([(r, b) for r, b in before.items()] or [(0, 0)], f"{n.range} int, {n.before} long")
    by = Window.partitionBy(n.range).orderBy(*n.key)
    placed = ranged.withColumn(n.sum, F.sum(n.size).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn(n.place, F.row_number().over(by))
    placed = placed.join(F.broadcast(starts), n.range)  # one row a range
    middle = F.col(n.before) + F.col(n.sum) - F.col(n.size) / 2
    placed = placed.withColumn("shard", F.least(F.floor(middle * shards / F.lit(float(max(total, 1)))), F.lit(shards - 1)).cast("int"))
    # rows that each shard has before each range: ranges times the few shards that each touches
    counts = placed.groupBy("shard", n.range).agg(F.count(F.lit(1)).alias("n"), F.min(n.place).alias("first")).toPandas().sort_values(["shard", n.range])
    counts["base"] = counts.groupby("shard")["n"].cumsum() - counts["n"] - counts["first"]
    offsets = spark.createDataFrame([(int(s), int(r), int(b)) for s, r, b in zip(counts["shard"], counts[n.range], counts["base"], strict=True)] or [(0, 0, 0)], f"shard int, {n.range} int, {n.base} long")
    out = placed.join(F.broadcast(offsets), ["shard", n.range]).withColumn("slot", F.col(n.place) + F.col(n.base))
    return out.select(*kept, "shard", "slot")


def write(df: DataFrame, path: str, *, key_col: str, text_col: str = "text", shards: int = SHARDS) -> None:
    """Shard whole records into ``path/shard=k`` folders, in slot order.

    Null texts count 0 bytes and the checksum of the empty text; repeated rows
    are records of their own; an empty table writes nothing.  ``size`` and
    ``text_crc32`` are added to the records, in place of columns of these
    names.
    """
    sized = df.withColumns({"size": size_of(F.col(text_col)), "text_crc32": checksum(F.col(text_col))})
    out = assign(sized, key_col=key_col, shards=shards)
    out.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def placement(docs: DataFrame) -> DataFrame:
    """The contract's rows for all documents: null texts have size 8, repeated rows one row each; extra columns are left out."""
    text = F.col("text").cast("string")
    df = docs.select("doc_id", size_of(text).alias("size"), checksum(text).alias("text_crc32"))
    out = assign(df, key_col="doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
