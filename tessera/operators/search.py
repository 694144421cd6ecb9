"""Text search: a whole token or a part, over text, category and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates tokens: anything that's no letter and no number.
SEPARATOR = r"[^\p{IsAlphabetic}\p{N}]"


def haystack(df: DataFrame, metadata: bool = True) -> Column:
    """What is searched: the text, and with ``metadata`` the category and the compact JSON of the metadata."""
    out = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if not metadata:
        return out
    parts = [out, F.coalesce(F.col("category").cast("string"), F.lit("")) if "category" in df.columns else F.lit("")]
    if "metadata" in df.columns:
        kind = df.schema["metadata"].dataType
        text = F.to_json(F.try_parse_json("metadata")) if isinstance(kind, T.StringType) else F.to_json("metadata")
        parts.append(F.coalesce(text, F.lit("{}")))
    else:
        parts.append(F.lit("{}"))
    return F.concat_ws(" ", *parts)


def text_match(df: DataFrame, query: str, *, partial: bool = False, case_sensitive: bool = False, metadata: bool = True) -> Column:
    """True where the haystack holds ``query``: anywhere if partial, else as one whole token."""
    where = haystack(df, metadata)
    if not case_sensitive:
        where, query = F.lower(where), query.lower()
    if partial:
        return F.contains(where, F.lit(query))
    tokens = F.array_contains(F.split(where, SEPARATOR, -1), F.lit(query))
    # a cheap substring test first; splitting only where it could matter
    return F.contains(where, F.lit(query)) & tokens if query else tokens


def search(df: DataFrame, query: str, **options: bool) -> DataFrame:
    """The documents that match, in order of id."""
    return df.where(text_match(df, query, **options)).orderBy("id")
