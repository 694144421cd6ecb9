"""Stupid-backoff language-model scores, computed as joins on hashed n-grams.

The model is the corpus itself: counts of all word n-grams up to ``ORDER``,
and every text is scored by what the other texts say (its own counts are taken
off first).  For a word w after context c

    S(w | c) = C(c w) / C(c)  where C(c w) > 0, else ALPHA * S(w | shorter c)

down to C(w) / N, and ALPHA**ORDER / (N + 1) for a word that no other text
has.  A text's score is the sum of ln S over its words.

The plan is three shuffles: texts by chunk; each chunk's distinct n-grams and
counts by hash bucket, where the count table of that bucket is summed and
joined back; and the joined counts by chunk, where they meet the chunk's texts
(whose first shuffle is reused) and are summed per text.  N-grams travel as
packed arrays, one row for each chunk and each bucket that it has n-grams of:
never more rows than exploded n-grams would be, and as many only where chunks
outnumber the n-grams of one.  A very frequent n-gram is one entry for each
chunk, so no key is hot.

One row for each n-gram and document or chunk would be the plainer plan.  Over
0.51 GB of documents there are some 125 million distinct pairs of a chunk and
an n-gram of order 2; at 12 bytes each, there and back, with the texts, they
take over 7 times the input in shuffle files, where the packed ones take 3.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text

ORDER = 2
ALPHA = 0.4
#: Bytes of text that make a chunk, and so about a bucket.
CHUNK_BYTES = 6 << 20
_TOTAL = np.uint64(0)  # stands for the empty n-gram, whose count is the number of words


def _grams(texts: pa.Array, order: int):
    """Words' bounds by text, and for each word and n the hash of the n-gram that ends there (0: too early in the text)."""
    h, bounds = _text.tokens(*_text.buffers(texts))
    place = np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))
    out, acc = [], np.zeros(len(h), np.uint64)
    for n in range(1, order + 1):
        # acc: hash of the n words that end at each place, built from the right
        shifted = h if n == 1 else np.concatenate([np.zeros(n - 1, np.uint64), h[: max(0, len(h) - n + 1)]])[: len(h)]
        acc = _text.mix(acc * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(n))
        out.append(np.where(place >= n - 1, acc | np.uint64(1), _TOTAL))
    return bounds, out


def _context(grams: list[np.ndarray], n: int) -> np.ndarray:
    """Hash of the n-1 words before each place: the (n-1)-gram that ends one word earlier."""
    return np.concatenate([[_TOTAL], grams[n - 2][:-1]]) if len(grams[0]) else grams[0]


def _distinct(grams: list[np.ndarray]):
    return np.unique(np.concatenate([*grams, [_TOTAL]]), return_inverse=True, return_counts=True)


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the hash, so that sorted n-grams lie bucket by bucket."""
    return ((grams >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)


def _planes(values: np.ndarray) -> bytes:
    """64-bit values byte plane by byte plane: sorted hashes and small counts then compress in the shuffle."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(packed: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _counts(uniq: np.ndarray, count: np.ndarray, words: int) -> np.ndarray:
    count = count.astype(np.int64)
    count[uniq == _TOTAL] = words
    return count


def log_scores(bounds: np.ndarray, grams: list[np.ndarray], inverse: np.ndarray, totals: np.ndarray, order: int) -> np.ndarray:
    """Sum of ln S for each text, given corpus counts of the chunk's distinct n-grams (``inverse`` maps places to them)."""
    words = len(grams[0])
    size = np.diff(bounds)
    doc = np.repeat(np.arange(len(size)), size)
    others = []
    for n in range(order):
        ids = inverse[n * words : (n + 1) * words]
        _, back, own = np.unique(doc * np.int64(len(totals)) + ids, return_inverse=True, return_counts=True)
        others.append(np.where(grams[n] != _TOTAL, totals[ids] - own[back], 0))
    everything = totals[inverse[-1]] - size[doc]  # words in the other texts
    score = np.full(words, np.nan)
    left = np.ones(words, bool)
    for n in range(order, 0, -1):
        if n == 1:
            below = everything
        else:
            below = np.concatenate([[0], others[n - 2][:-1]]) if words else others[0]
        hit = left & (others[n - 1] > 0) & (below > 0)
        score[hit] = (order - n) * np.log(ALPHA) + np.log(others[n - 1][hit] / below[hit])
        left &= ~hit
    score[left] = order * np.log(ALPHA) - np.log(everything[left] + 1.0)
    acc = np.concatenate([[0.0], np.cumsum(score)])
    return np.array([score[a:b].sum() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]) if words else np.diff(acc[bounds])


def score(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Per row: id, n_words, log_score (sum of ln S; 0 for no words) and mean_log_score (null for no words).

    Null texts count as empty.  Rows may repeat; each copy is another text to
    the other copies.  Words are what white space separates, A-Z folded.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // CHUNK_BYTES)
    # the row's number spreads copies of a row over the chunks
    docs = df.select(F.pmod(F.xxhash64(F.col(id_col), text, F.monotonically_increasing_id()), F.lit(parts)).alias("chunk"), F.col(id_col).alias("id"), text.alias("text"))

    def request(table: pa.Table) -> pa.Table:
        _, grams = _grams(table.column("text"), order)
        uniq, _, count = _distinct(grams)
        count = _counts(uniq, count, len(grams[0]))
        edge = np.searchsorted(_bucket(uniq, parts), np.arange(parts + 1))
        some = np.flatnonzero(np.diff(edge))
        return pa.table({
            "bucket": pa.array(some, pa.int32()),
            "chunk": pa.array(np.full(len(some), table.column("chunk")[0].as_py()), pa.int64()),
            "grams": pa.array([_planes(uniq[edge[b] : edge[b + 1]]) for b in some], pa.binary()),
            "counts": pa.array([_planes(count[edge[b] : edge[b + 1]]) for b in some], pa.binary()),
        })

    def answer(table: pa.Table) -> pa.Table:
        asked = [_from_planes(x, np.uint64) for x in table.column("grams").to_pylist()]
        every = np.concatenate(asked)
        counts = np.concatenate([_from_planes(x, np.int64) for x in table.column("counts").to_pylist()])
        order_ = np.argsort(every, kind="stable")
        every, counts = every[order_], counts[order_]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        known, total = every[first], np.add.reduceat(counts, first)
        return pa.table({
            "chunk": table.column("chunk"),
            "bucket": table.column("bucket"),
            "totals": pa.array([_planes(total[np.searchsorted(known, x)]) for x in asked], pa.binary()),
        })

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        bounds, grams = _grams(texts.column("text"), order)
        _, inverse, _ = _distinct(grams)
        buckets = answers.column("bucket").to_numpy()
        packed = answers.column("totals").to_pylist()
        totals = np.concatenate([_from_planes(packed[i], np.int64) for i in np.argsort(buckets, kind="stable")])
        n = np.diff(bounds)
        got = log_scores(bounds, grams, inverse, totals, order)
        _text.trim()
        mean = pa.array(got / np.maximum(n, 1), pa.float64(), mask=n == 0)
        return pa.table({id_col: texts.column("id"), "n_words": pa.array(n, pa.int64()), "log_score": pa.array(got, pa.float64()), "mean_log_score": mean})

    requests = docs.groupBy("chunk").applyInArrow(request, "bucket int, chunk long, grams binary, counts binary")
    answers = requests.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, totals binary")
    kind = docs.schema["id"].dataType.simpleString()
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, f"`{id_col}` {kind}, n_words long, log_score double, mean_log_score double")


def oracle(order: int = ORDER) -> str:
    """DuckDB SQL for the scores of table documents, rounded as the query rounds them (order 2)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
t AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM d),
p AS (SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS v FROM t),
n AS (SELECT count(*) AS n FROM t),
u AS (SELECT w, count(*) AS c FROM t GROUP BY w),
ud AS (SELECT r, w, count(*) AS c FROM t GROUP BY r, w),
b AS (SELECT v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY v, w),
bd AS (SELECT r, v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY r, v, w),
s AS (
  SELECT p.r, b.c - bd.c AS cb, uv.c - udv.c AS cv, u.c - ud.c AS cu, n.n - len(d.ws) AS m
  FROM p JOIN d USING (r) CROSS JOIN n
  JOIN u ON u.w = p.w JOIN ud ON ud.r = p.r AND ud.w = p.w
  LEFT JOIN b ON b.v = p.v AND b.w = p.w LEFT JOIN bd ON bd.r = p.r AND bd.v = p.v AND bd.w = p.w
  LEFT JOIN u uv ON uv.w = p.v LEFT JOIN ud udv ON udv.r = p.r AND udv.w = p.v),
g AS (
  SELECT r, count(*) AS n_words,
         sum(CASE WHEN cb > 0 AND cv > 0 THEN ln(cb / cv::DOUBLE)
                  WHEN cu > 0 AND m > 0 THEN ln({ALPHA}) + ln(cu / m::DOUBLE)
                  ELSE 2 * ln({ALPHA}) - ln(m + 1.0::DOUBLE) END) AS x
  FROM s GROUP BY r)
SELECT d.doc_id, coalesce(g.n_words, 0)::BIGINT AS n_words, round(coalesce(g.x, 0.0), 4) AS log_score,
       round(g.x / g.n_words, 4) AS mean_log_score
FROM d LEFT JOIN g USING (r)
"""


def corpus_scores(docs: DataFrame) -> DataFrame:
    """The contract's rows: ``score`` at order ``ORDER`` over all documents, rounded to four places.

    Null, empty and blank texts have 0 words, a log score of 0 and no mean;
    repeated rows are documents of their own; extra columns are left out.
    """
    out = score(docs)
    return out.withColumns({c: F.round(c, 4) for c in ("log_score", "mean_log_score")})
