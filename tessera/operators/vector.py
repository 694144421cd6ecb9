"""Exact nearest neighbours by L2 distance, and filtered (hybrid) search.

Distances are JVM-side array expressions; the k best of each partition meet in
one small merge (TakeOrderedAndProject), so a search reads two columns once
and shuffles k rows a task.  ``lsh_index`` offers an approximate index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def query_vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)).cast("float") for v in values)) if len(values) else F.array().cast("array<float>")


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance; the longer vector is cut to the shorter one's length."""
    n = F.least(F.size(a), F.size(b))
    parts = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def knn(df: DataFrame, query: Sequence[float], k: int, *, id_col: str = "id", vector_col: str = "vector", compat: bool = False) -> DataFrame:
    """The ``k`` nearest rows as (id, distance), nearest first, ties by id.

    Empty vectors are left out; with ``compat`` they count as at distance 0.
    """
    rows = df.select(F.col(id_col), F.col(vector_col).cast("array<float>").alias("__v")).where(F.col("__v").isNotNull())
    if not compat:
        rows = rows.where(F.size("__v") > 0)
    return rows.select(id_col, l2(F.col("__v"), query_vector(query)).alias("distance")).orderBy("distance", id_col).limit(k)


def knn_many(df: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", vector_col: str = "vector", most_queries: int = 10_000) -> DataFrame:
    """The ``k`` nearest rows of every query (query_id, vector): (query_id, id, distance, rank).

    Queries are a small stated set: sent to all tasks in blocks of
    ``most_queries``; ranks are cut to k inside each task's partial results by
    Spark's window group limit before anything is shuffled.
    """
    n = queries.count()
    blocks = max(1, -(-n // most_queries))
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        q = part.select("query_id", F.col("vector").cast("array<float>").alias("__q"))
        rows = df.select(F.col(id_col), F.col(vector_col).cast("array<float>").alias("__v")).where(F.size("__v") > 0)
        pairs = rows.join(F.broadcast(q), F.lit(True)).select("query_id", id_col, l2(F.col("__v"), F.col("__q")).alias("distance"))
        ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_col))).where(F.col("rank") <= k)
        out = ranked if out is None else out.union(ranked)
    return out


def hybrid(df: DataFrame, query: Sequence[float], k: int, where: str | Column | None = None, *, compat: bool = False) -> DataFrame:
    """The ``k`` nearest documents among those that ``where`` keeps, all columns, nearest first.

    With ``compat`` the vector is ignored and the first ``k`` ids are taken.
    """
    rows = df.where(where) if where is not None else df
    if compat:
        return rows.orderBy("id").limit(k)
    found = rows.where(F.size("vector") > 0).withColumn("distance", l2(F.col("vector"), query_vector(query)))
    return found.orderBy("distance", "id").limit(k)


def lsh_index(df: DataFrame, *, vector_col: str = "vector", bucket: float = 2.0, tables: int = 8, seed: int = 42):
    """A random-projection index (model, indexed frame) for approximate search in Euclidean space."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("__features", array_to_vector(F.col(vector_col).cast("array<double>")))
    model = BucketedRandomProjectionLSH(inputCol="__features", outputCol="__hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(rows)
    return model, model.transform(rows)


def lsh_search(model, indexed: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """About the ``k`` nearest rows by an index, with exact distances."""
    from pyspark.ml.linalg import Vectors

    return model.approxNearestNeighbors(indexed, Vectors.dense([float(x) for x in query]), k, distCol="distance").drop("__features", "__hashes")
