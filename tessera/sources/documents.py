"""The document model and what reads into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.compile import Rows
from tessera.session import share_code

DOCUMENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("metadata", T.StringType()),
])
#: A vector given to documents that come without one on the command line.
PLACEHOLDER = (0.0, 0.0, 0.0, 0.0)


def with_placeholder(docs: DataFrame) -> DataFrame:
    """Envelope rows whose empty vectors are the placeholder."""
    return docs.withColumn("vector", F.when(F.size("vector") > 0, F.col("vector")).otherwise(F.array(*(F.lit(x).cast("float") for x in PLACEHOLDER))))


def no_vector() -> Column:
    return F.array().cast("array<float>")


def envelope(df: DataFrame) -> DataFrame:
    """Any frame with some of the envelope's columns, completed: absent ones are '', [] and {}."""
    have = {c.lower(): c for c in df.columns}
    at = lambda c: F.col(have[c]) if c in have else None
    metadata = at("metadata_json") if "metadata_json" in have else at("metadata")
    if metadata is None:
        metadata = F.lit("{}")
    elif isinstance(df.select(metadata).schema[0].dataType, T.StringType):
        # what isn't JSON counts as an empty object
        metadata = F.when(F.try_parse_json(metadata).isNotNull(), metadata).otherwise(F.lit("{}"))
    else:
        metadata = F.coalesce(F.to_json(metadata), F.lit("{}"))
    vector = at("vector")
    return df.select(
        F.coalesce(at("id").cast("string") if "id" in have else F.lit(None), F.lit("")).alias("id"),
        F.coalesce(at("text").cast("string") if "text" in have else F.lit(None), F.lit("")).alias("text"),
        F.coalesce(at("category").cast("string") if "category" in have else F.lit(None), F.lit("")).alias("category"),
        (F.coalesce(vector.cast("array<float>"), no_vector()) if vector is not None else no_vector()).alias("vector"),
        metadata.alias("metadata"),
    )


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A file holding an array of documents, or an object with one under ``documents``."""
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$.documents", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    one = text.select(F.explode(items).alias("d"))
    get = lambda key, kind: F.try_variant_get("d", f"$.{key}", kind)
    given = F.coalesce(get("metadata_json", "string"), F.to_json(get("metadata", "variant")))
    return envelope(one.select(get("id", "string").alias("id"), get("text", "string").alias("text"), get("category", "string").alias("category"), get("vector", "array<float>").alias("vector"), given.alias("metadata")))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: (id from the file's name, text, source path)."""
    df = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_name").alias("name"))
    return df.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("id"), F.col("value").alias("text"), "source")


#: Instruments: name, family, weight in kg, how bright, soft and low they sound.
_INSTRUMENTS = (
    ("violin", "strings", 0.5, (0.9, 0.4, 0.1)),
    ("cello", "strings", 3.2, (0.4, 0.7, 0.8)),
    ("harp", "strings", 36.0, (0.6, 0.9, 0.5)),
    ("oboe", "winds", 0.7, (0.8, 0.3, 0.2)),
    ("tuba", "winds", 9.5, (0.1, 0.5, 1.0)),
    ("celesta", "keys", 95.0, (1.0, 0.8, 0.0)),
)


def sample(spark: SparkSession) -> DataFrame:
    """Six small documents about instruments, with vectors, for trying things out."""
    text = "The {} belongs to the {} and weighs {} kg."
    rows = [(name, text.format(name, family, kg), family, list(sound), f'{{"kg":{kg},"letters":{len(name)}}}') for name, family, kg, sound in _INSTRUMENTS]
    return spark.createDataFrame(rows, DOCUMENT)


# -- tables of the test data as collections

_ENVELOPES = {
    # table: id, text, category, vector, metadata columns
    "documents": (["doc_id"], "text", "lang", None, ["source", "n_chars"]),
    "embeddings": (["vec_id"], None, "label", "embedding", []),
    "events": (["event_id"], "event_type", "event_type", None, ["user_id", "value", "ts", "props"]),
    "conversations": (["conv_id", "turn"], "text", "role", None, ["conv_id", "turn"]),
    "orders": (["o_orderkey"], "o_orderpriority", "o_orderstatus", None, ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"]),
    "customer": (["c_custkey"], "c_name", "c_mktsegment", None, ["c_custkey", "c_nationkey", "c_acctbal"]),
    "supplier": (["s_suppkey"], "s_name", None, None, ["s_suppkey", "s_nationkey", "s_acctbal"]),
    "part": (["p_partkey"], "p_name", "p_brand", None, ["p_partkey", "p_type", "p_size", "p_retailprice"]),
    "lineitem": (["l_orderkey", "l_linenumber"], None, "l_returnflag", None, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate"]),
    "nation": (["n_nationkey"], "n_name", None, None, ["n_nationkey", "n_regionkey"]),
    "region": (["r_regionkey"], "r_name", None, None, ["r_regionkey"]),
    "pages": (["page_id"], "html", None, None, ["url"]),
    "benchmark": (["item_id"], "text", None, None, []),
    "labels": (["doc_id"], None, None, None, ["quality", "toxic"]),
}
TABLES = tuple(_ENVELOPES)


def collection(spark: SparkSession, sf_dir: str, name: str) -> Rows:
    """A test table as a collection with typed metadata; the scan keeps column pruning and pushdown."""
    key, text, category, vector, rest = _ENVELOPES[name]
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    empty = F.lit("")
    fields = [F.col(c).alias(c) for c in rest] or [F.lit(None).cast("string").alias("none")]
    out = df.select(
        F.concat_ws("-", *(F.col(c).cast("string") for c in key)).alias("id"),
        (F.col(text) if text else empty).alias("text"),
        (F.col(category).cast("string") if category else empty).alias("category"),
        (F.col(vector).cast("array<float>") if vector else no_vector()).alias("vector"),
        F.struct(*fields).alias("metadata"),
    )
    return Rows(out, frozenset({"metadata.props"}) if name == "events" else frozenset())


class Tables(dict):
    """All test tables by name, read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        share_code(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def __contains__(self, name: object) -> bool:
        return name in TABLES

    def __missing__(self, name: str) -> Rows:
        if name not in TABLES:
            raise KeyError(name)
        self[name] = collection(self.spark, self.sf_dir, name)
        return self[name]
