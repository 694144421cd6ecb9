"""Order-aware work without a global sort in one task: rows are cut into ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a range is to hold, sampled keys a range, and bounds that one step of a search looks at.
RANGE_BYTES, PER_RANGE, _STEP = 128 << 20, 8, 64


def boundaries(df: DataFrame, key: str, tie: str, text: str, least: int) -> list[tuple[int, int]]:
    """Lower bounds of ranges of the pairs (key, tie), ascending, each the pair of some row; the first is the least pair.

    There are about ``least`` ranges, or more where they would hold over
    ``RANGE_BYTES`` of text.  The driver gathers ``PER_RANGE`` sampled pairs
    for each.
    """
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("size"), F.min(F.struct(key, tie)).alias("low")).first()
    if not row.n:
        return []
    ranges = max(1, least, (row["size"] or 0) // RANGE_BYTES)
    # uniform in [0, 1) from the pair: the same on every run
    u = F.shiftrightunsigned(F.xxhash64(key, tie, F.lit(11)), 11).cast("double") * F.lit(2.0**-53)
    drawn = sorted({(r[0], r[1]) for r in df.where(u < ranges * PER_RANGE / row.n).select(key, tie).collect()})
    return sorted({tuple(row.low), *drawn[:: max(1, len(drawn) // ranges)]})


def _table(bounds: list[tuple[int, int]]) -> Column:
    """The bounds as one constant, whatever their number."""
    numbers = [f"cast(split('{','.join(str(b[i]) for b in bounds)}', ',') as array<bigint>)" for i in (0, 1)]
    return F.expr(f"arrays_zip({', '.join(numbers)})")


def with_range(df: DataFrame, key: str, tie: str, bounds: list[tuple[int, int]], out: str, first: str) -> DataFrame:
    """Add ``out``, the range, from 1, that a row falls in, and ``first``, whether it is the range's lower bound."""
    k, t = F.col(key), F.col(tie)
    reached = lambda b: (b["0"] < k) | ((b["0"] == k) & (b["1"] <= t))
    stride = 1
    while stride * _STEP < len(bounds):
        stride *= _STEP
    df = df.withColumn(out, F.size(F.filter(_table(bounds[::stride]), reached)))
    while stride > 1:
        stride //= _STEP
        at = (F.col(out) - 1) * _STEP
        df = df.withColumn(out, at + F.size(F.filter(F.slice(_table(bounds[::stride]), at + 1, F.lit(_STEP)), reached)))
    own = F.get(_table(bounds), F.col(out) - 1)
    return df.withColumn(first, (own["0"] == k) & (own["1"] == t))
