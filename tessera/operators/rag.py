"""Chunking, deterministic n-gram embeddings, and retrieval over chunk tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.vector import l2, query_vector

#: Fixed values of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3

CHUNK = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("token_count", T.LongType()),
    T.StructField("start_offset", T.LongType()),
    T.StructField("end_offset", T.LongType()),
    T.StructField("chunk_index", T.LongType()),
    T.StructField("total_chunks", T.LongType()),
])


@dataclass(frozen=True)
class Chunking:
    """Sizes in tokens; the plain chunker takes four characters for one."""

    max_tokens: int = 512
    overlap_tokens: int = 50
    sentence_boundary: bool = True
    min_tokens: int = 50

    def __post_init__(self):
        if self.overlap_tokens >= self.max_tokens:
            raise ValueError("the overlap must be smaller than a chunk")


@dataclass(frozen=True)
class Embedding:
    dim: int = 384
    normalize: bool = True
    ngrams: tuple[int, int] = (1, 4)


# -- chunks


def chunk_windows(df: DataFrame, config: Chunking = Chunking(), *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Overlapping windows of characters, all in built-in functions.

    Adds nothing to rows with empty texts: they have no chunks.  Result: the
    rows' other columns with ``doc_id`` and the fields of ``CHUNK``.
    """
    size, step = config.max_tokens * 4, (config.max_tokens - config.overlap_tokens) * 4
    n = F.length(text_col)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)).cast("int") + 1)
    rest = [c for c in df.columns if c not in (id_col, text_col)]
    rows = df.where(n > 0).select(*rest, F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("__t"), n.cast("long").alias("__n"), count.cast("long").alias("total_chunks"))
    rows = rows.withColumn("chunk_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_chunks") - 1)))
    start = F.col("chunk_index") * step
    end = F.least(start + size, F.col("__n"))
    return rows.select(
        *rest,
        "doc_id",
        F.concat_ws("-", "doc_id", F.col("chunk_index").cast("string")).alias("id"),
        F.substring("__t", (start + 1).cast("int"), F.lit(size)).alias("text"),
        F.floor((end - start) / 4).cast("long").alias("token_count"),
        start.alias("start_offset"),
        end.alias("end_offset"),
        "chunk_index",
        "total_chunks",
    )


def whitespace_spans(text: str) -> list[tuple[int, int]]:
    """The stand-in tokenizer: one token for each run of visible characters."""
    out, at = [], 0
    for word in text.split():
        at = text.index(word, at)
        out.append((at, at + len(word)))
        at += len(word)
    return out


@lru_cache(4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def file_spans(path: str) -> Callable[[str], list[tuple[int, int]]]:
    """Spans by a tokenizer.json that every node can read."""
    return lambda text: [tuple(x) for x in _tokenizer(path).encode(text, add_special_tokens=False).offsets]


def split_tokens(text: str, config: Chunking, spans: Callable[[str], list[tuple[int, int]]] = whitespace_spans) -> list[tuple[str, int, int, int]]:
    """(text, tokens, start, end) of each chunk of one text.

    Windows of ``max_tokens`` overlap by ``overlap_tokens`` tokens; all but
    the last end at their last sentence mark if there is one, and those then
    under ``min_tokens`` are dropped.  What trimming cuts off beyond the
    overlap isn't taken up again.
    """
    found = spans(text)
    total = len(found)
    if total == 0:
        return []
    if total <= config.max_tokens:
        return [(text, total, 0, len(text))]
    out, at = [], 0
    while at < total:
        stop = min(at + config.max_tokens, total)
        last = stop == total
        a, b = found[at][0], len(text) if last else found[stop - 1][1]
        piece = text[a:b]
        if config.sentence_boundary and not last:
            cut = max(piece.rfind(c) for c in ".!?\n")
            if cut >= 0:
                piece = piece[: cut + 1]
                b = a + cut + 1
        n = len(spans(piece))
        if n >= config.min_tokens or last:
            out.append((piece, n, a, b))
        at = total if last else stop - config.overlap_tokens
    return out


def chunk_tokens(df: DataFrame, config: Chunking = Chunking(), *, tokenizer_path: str | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Token windows that end at sentences; columns as ``chunk_windows`` gives them."""
    spans = file_spans(tokenizer_path) if tokenizer_path else whitespace_spans

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])))
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("text", "n", "a", "b"), c, strict=True)) for c in split_tokens(t or "", config, spans)] for t in texts])

    rest = [c for c in df.columns if c not in (id_col, text_col)]
    rows = df.select(*rest, F.col(id_col).cast("string").alias("doc_id"), split(text_col).alias("__c"))
    rows = rows.select(*rest, "doc_id", F.size("__c").cast("long").alias("total_chunks"), F.posexplode("__c").alias("__i", "__x"))
    return rows.select(*rest, "doc_id", F.concat_ws("-", "doc_id", F.col("__i").cast("string")).alias("id"), F.col("__x.text").alias("text"), F.col("__x.n").alias("token_count"), F.col("__x.a").alias("start_offset"), F.col("__x.b").alias("end_offset"), F.col("__i").cast("long").alias("chunk_index"), "total_chunks")


# -- embeddings


@lru_cache(1 << 17)
def _bytes_hash(word: str) -> int:
    h = FNV_OFFSET
    for b in word.encode("utf-8"):
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def embed_text(text: str, config: Embedding = Embedding()) -> np.ndarray:
    """Counts of hashed character n-grams (two slots each) and of words, as 32-bit floats."""
    dim = np.uint64(config.dim)
    out = np.zeros(config.dim)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    low, high = config.ngrams
    h = np.full(len(code), FNV_OFFSET, np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, high + 1):
            if n > len(code):
                break
            # h[i] takes in one more character: all n-grams of a length at once
            h = (h[: len(code) - n + 1] ^ code[n - 1 :]) * np.uint64(FNV_PRIME)
            if n >= low:
                out += np.bincount((h % dim).astype(np.int64), minlength=config.dim)
                out += 0.5 * np.bincount(((h >> np.uint64(32)) % dim).astype(np.int64), minlength=config.dim)
    for word in text.split():
        out[_bytes_hash(word) % config.dim] += 2.0
    out = out.astype(np.float32)
    if config.normalize:
        norm = np.sqrt(np.sum(out * out, dtype=np.float32))
        if norm > 0:
            out = out / norm
    return out


def embed(config: Embedding = Embedding()) -> Callable[[Column | str], Column]:
    """An Arrow UDF from texts to vectors (null: null)."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else embed_text(t, config) for t in texts])

    return run


# -- retrieval over a table of chunks


def ingest(df: DataFrame, *, chunking: Chunking = Chunking(), embedding: Embedding = Embedding(), tokenizer_path: str | None = None, by_tokens: bool = False, created_at: str | None = None, custom: str = "{}") -> DataFrame:
    """Chunk and embed documents (id, text[, source]) into rows of the chunk table, which are documents of category ``rag``."""
    source = F.col("source") if "source" in df.columns else F.lit(None).cast("string")
    rows = df.select("id", "text", source.cast("string").alias("source"))
    chunks = chunk_tokens(rows, chunking, tokenizer_path=tokenizer_path) if by_tokens or tokenizer_path else chunk_windows(rows, chunking)
    stamp = F.lit(created_at) if created_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    chunks = chunks.withColumn("vector", embed(embedding)("text")).withColumn("created_at", stamp).withColumn("category", F.lit("rag"))
    meta = F.to_json(F.struct("source", "created_at", F.parse_json(F.lit(custom)).alias("custom")), {"ignoreNullFields": "false"})
    return chunks.withColumn("metadata", meta)


def search(chunks: DataFrame, question: str, k: int, *, embedding: Embedding = Embedding(), compat: bool = False) -> DataFrame:
    """The ``k`` chunks nearest to a question: (chunk columns, doc_id, score); a lower score is nearer.

    ``doc_id`` is the id without its chunk number; with ``compat``, what
    stands before its first hyphen.
    """
    far = l2(F.col("vector"), query_vector(embed_text(question, embedding).tolist()))
    # chunks without a vector come last and are left out; one pass makes each vector once
    score = far if compat else F.when(F.size("vector") > 0, far)
    out = chunks.drop("doc_id").withColumn("score", score).orderBy(F.col("score").asc_nulls_last(), "id").limit(k).where("score is not null")
    doc = F.split("id", "-")[0] if compat else F.regexp_replace("id", r"-\d+$", "")
    return out.withColumn("doc_id", doc).orderBy("score", "id")


def list_docs(chunks: DataFrame) -> DataFrame:
    """The distinct documents behind a chunk table."""
    return chunks.select("doc_id").distinct()


def get_chunk(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """One chunk by its id."""
    return chunks.where(F.col("id") == chunk_id)


def get_doc(chunks: DataFrame, doc_id: str) -> DataFrame:
    """A document's chunks in order."""
    return chunks.where(F.col("doc_id") == doc_id).orderBy("chunk_index")


def delete_doc(chunks: DataFrame, doc_id: str, *, compat: bool = False) -> DataFrame:
    """The chunk table without a document; ``compat`` also takes documents whose id starts with it and a hyphen."""
    gone = (F.col("id") == doc_id) | F.col("id").startswith(f"{doc_id}-") if compat else F.col("doc_id") == doc_id
    return chunks.where(~gone)


def update_doc(chunks: DataFrame, new: DataFrame, **options) -> DataFrame:
    """The chunk table with the documents of ``new`` (id, text[, source]) chunked anew."""
    fresh = ingest(new, **options)
    kept = chunks.join(fresh.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)
