"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact check.

For every word length L that an item of the benchmark has, windows of L words
slide over each document.  A window's fingerprint is the sign of summed word
bit vectors, taken from running sums.  ``RADIUS`` + 1 bit blocks index the
items: fingerprints within the radius agree in one whole block at least, so
looking up every block finds all of them.  Candidates are verified by exact
weighted-shingle similarity: five-word shingles weighted by their counts, sum
of minima over sum of maxima, ``SIMILARITY`` or more.

No radius bounds that similarity: a run of other words in a long item can move
its fingerprint further.  So the items' shingles are indexed as well.  Of n
shingles of a window, similar items lack at most n / 7 (``lacking``); windows
of which an item lacks no more are candidates too, whatever their distance.
Together the two lose no window that passes the check.

Windows that hold too few words in item shingles to reach that similarity
with any item are not fingerprinted; this loses nothing that could pass.
Words are runs of letters and digits, A-Z folded; punctuation is ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import _text
from tessera.llm._io import fresh

WORDS = 5
SIMILARITY = 0.75
RADIUS = 12
#: Items that one pass over the documents looks for; a larger benchmark takes more passes.
ITEMS = 20_000
_FILTER_BITS = 22
#: Words, and windows, whose 64 sums are held at once.
STRETCH = 8192


def _shingles(h: np.ndarray) -> np.ndarray:
    return _text.grams(h, np.array([0, len(h)]), WORDS)[0]


def lacking(n: np.ndarray) -> np.ndarray:
    """Most shingles, of a window's ``n``, that a similar item of as many can lack."""
    # alike = i / (2 n - i) >= SIMILARITY  =>  n - i <= n (1 - SIMILARITY) / (1 + SIMILARITY)
    return np.floor(n * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-9).astype(np.int64)


def _running(h: np.ndarray) -> np.ndarray:
    """Running sums of the words' 64 signs: row i holds the sum of the first i words."""
    bits = (h[:, None] >> np.arange(64, dtype=np.uint64)[None, :]) & np.uint64(1)
    out = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(bits.astype(np.int8) * 2 - 1, axis=0, out=out[1:])
    return out


def _pack(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def block_bounds(radius: int = RADIUS) -> list[tuple[int, int]]:
    """First bit and width of each of ``radius`` + 1 blocks of the 64 bits."""
    edges = np.linspace(0, 64, radius + 2).astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Index:
    """One block of items, ready to be sent to the tasks (bounded by ``ITEMS``)."""

    def __init__(self, items: list[tuple[int, str | None]], radius: int = RADIUS):
        self.radius = radius
        h, bounds = _text.tokens(*_text.buffers(pa.array([t for _, t in items], pa.large_string())), wordy=True)
        size = np.diff(bounds)
        rows = [i for i in np.argsort(size, kind="stable") if size[i]]
        words = [h[bounds[i] : bounds[i + 1]] for i in rows]
        self.ids = [items[i][0] for i in rows]
        self.size = size[rows].astype(np.int64)
        #: The lengths that items have, ascending; ``length`` is each item's place among them.
        self.lengths, self.length = np.unique(self.size, return_inverse=True)
        self.prints = np.array([_pack(_running(w)[-1:])[0] for w in words], np.uint64)
        sets = [_shingles(w) for w in words]
        self.shingles = [Counter(x.tolist()) for x in sets]
        every = [np.zeros(0, np.uint64), *sets]
        #: Each item's distinct shingles, ascending over all items, and who has them.
        own = [np.unique(x) if len(w) >= WORDS else x[:0] for x, w in zip(sets, words, strict=True)]
        holds, holder = np.concatenate([np.zeros(0, np.uint64), *own]), np.repeat(np.arange(len(own)), [len(x) for x in own])
        order = np.argsort(holds, kind="stable")
        self.holds, self.holder = holds[order], holder[order]
        grams = np.maximum(self.size - WORDS + 1, 0)
        #: Fewest shingles of a similar window that each item has.
        self.needed = grams - lacking(grams)
        self.blocks = []
        for first, width in block_bounds(radius):
            value = self._block(self.prints, self.length, first, width)
            order = np.argsort(value, kind="stable")
            self.blocks.append((first, width, value[order], order))
        self.known = np.unique(np.concatenate(every))
        self.table = np.zeros(1 << _FILTER_BITS, bool)
        self.table[(self.known >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.shortest = int(self.lengths[0]) if len(self.lengths) else 0

    @staticmethod
    def _block(prints: np.ndarray, length: np.ndarray, first: int, width: int) -> np.ndarray:
        """A block's bits below the length's place, so that only equal lengths meet."""
        return (length.astype(np.int64) << width) | ((prints >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Which shingles any item has."""
        found = self.table[(shingles >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
        maybe = np.flatnonzero(found)
        if len(maybe) and len(self.known):
            at = np.minimum(np.searchsorted(self.known, shingles[maybe]), len(self.known) - 1)
            found[maybe] = self.known[at] == shingles[maybe]
        return found

    def near(self, prints: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) of equal length within the radius, by the blocks' values."""
        pairs = [np.zeros(0, np.int64)]
        for first, width, values, order in self.blocks:
            key = self._block(prints, length, first, width)
            lo, hi = np.searchsorted(values, key, "left"), np.searchsorted(values, key, "right")
            n = hi - lo
            w = np.repeat(np.arange(len(prints)), n)
            ends = np.cumsum(n)
            i = order[np.arange(len(w)) - np.repeat(ends - n, n) + np.repeat(lo, n)] if len(w) else w
            close = np.bitwise_count(prints[w] ^ self.prints[i]) <= self.radius
            pairs.append(w[close] * len(self.ids) + i[close])
        both = np.unique(np.concatenate(pairs))
        return both // max(1, len(self.ids)), both % max(1, len(self.ids))

    def sharing(self, shingles: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (first word, item) of a text's windows of an item's length of which it lacks no more shingles than ``lacking``."""
        firsts, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        places = np.flatnonzero(hit)
        value, which, times = np.unique(shingles[places], return_inverse=True, return_counts=True)
        lo, hi = np.searchsorted(self.holds, value, "left"), np.searchsorted(self.holds, value, "right")
        n = hi - lo
        v = np.repeat(np.arange(len(value)), n)
        holder = self.holder[np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        total = np.bincount(holder, times[v], len(self.ids))
        for i in np.flatnonzero((total > 0) & (total >= self.needed)):
            grams = int(self.size[i]) - WORDS + 1
            if grams > len(shingles):
                continue
            mine = np.zeros(len(value), bool)
            mine[v[holder == i]] = True
            seen = np.zeros(len(shingles) + 1, np.int64)
            seen[places + 1] = mine[which]
            np.cumsum(seen, out=seen)
            first = np.flatnonzero(seen[grams:] - seen[:-grams] >= self.needed[i])
            firsts.append(first)
            items.append(np.full(len(first), i))
        return np.concatenate(firsts), np.concatenate(items)

    def windows(self, words: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, place of the length, fingerprint) of a text's windows that could reach the similarity."""
        seen = np.concatenate([[0], np.cumsum(hit)])
        starts, places = [], []
        for place, n in enumerate(self.lengths.tolist()):
            if n > len(words):
                break
            if n >= WORDS:
                size = n - WORDS + 1
                at = np.flatnonzero(seen[size:] - seen[: len(seen) - size] >= SIMILARITY * size)
            else:
                at = np.arange(len(words) - n + 1)
            if len(at):
                starts.append(at)
                places.append(np.full(len(at), place))
        if not starts:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64)
        start, place = np.concatenate(starts), np.concatenate(places)
        stop = start + self.lengths[place]
        prints = np.empty(len(start), np.uint64)
        # running sums over one stretch of words at a time bound the memory
        for low in range(int(start.min()) // STRETCH * STRETCH, int(start.max()) + 1, STRETCH):
            here = np.flatnonzero((start >= low) & (start < low + STRETCH))
            if len(here):
                a, b = int(start[here].min()), int(stop[here].max())
                sums = _running(words[a:b])
                for k in range(0, len(here), STRETCH):
                    part = here[k : k + STRETCH]
                    prints[part] = _pack(sums[stop[part] - a] - sums[start[part] - a])
        return start, place, prints

    def search(self, h: np.ndarray, bounds: np.ndarray, s: np.ndarray, at_s: np.ndarray) -> dict[int, list[tuple]]:
        """Text's number -> (item, first word, words, similarity, distance): the best window of each item in each text."""
        hit = self.hits(s)
        total = np.concatenate([[0], np.cumsum(hit)])
        touched = total[at_s[1:]] > total[at_s[:-1]]
        if 0 < self.shortest < WORDS:
            touched |= np.diff(bounds) >= self.shortest
        owner, start, place, prints = [], [], [], []
        pairs: set[tuple[int, int, int]] = set()
        for i in np.flatnonzero(touched):
            a, p, f = self.windows(h[bounds[i] : bounds[i + 1]], hit[at_s[i] : at_s[i + 1]])
            if len(a):
                owner.append(np.full(len(a), i))
                start.append(a)
                place.append(p)
                prints.append(f)
                shared = self.sharing(s[at_s[i] : at_s[i + 1]], hit[at_s[i] : at_s[i + 1]])
                pairs.update((int(i), x, y) for x, y in zip(*map(np.ndarray.tolist, shared), strict=True))
        if not owner:
            return {}
        owner, start, place, prints = map(np.concatenate, (owner, start, place, prints))
        w, near = self.near(prints, place)
        pairs.update(zip(owner[w].tolist(), start[w].tolist(), near.tolist(), strict=True))
        best: dict[tuple[int, int], tuple] = {}
        for doc, first, i in sorted(pairs):
            n = int(self.size[i])
            if n >= WORDS:
                own = s[at_s[doc] + first : at_s[doc] + first + n - WORDS + 1].tolist()
            else:
                own = _shingles(h[bounds[doc] + first : bounds[doc] + first + n]).tolist()
            item = self.shingles[i]
            both = sum(min(c, item[x]) for x, c in Counter(own).items() if x in item)
            alike = both / (2 * len(own) - both)
            if alike >= SIMILARITY:
                now = (alike, -first, n)
                key = (doc, i)
                if key not in best or now > best[key]:
                    best[key] = now
        out: dict[int, list[tuple]] = {}
        for (doc, i), (alike, first, n) in sorted(best.items()):
            at = bounds[doc] - first
            away = int(np.bitwise_count(_pack(_running(h[at : at + n])[-1:])[0] ^ self.prints[i]))
            out.setdefault(doc, []).append((self.ids[i], -first, n, alike, away))
        return out


FOUND = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("similarity", T.DoubleType()),
    T.StructField("distance", T.IntegerType()),
])


def find(df: DataFrame, index: Index, *, text_col: str, out_col: str) -> DataFrame:
    """Add ``out_col``: an array of all findings in each row's whole text (null, empty: none)."""
    sent = df.sparkSession.sparkContext.broadcast(index)
    at = df.columns.index(text_col)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64()), ("distance", pa.int32())]))

    @_text.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in (part for b in batches for part in _text.slices(b, at, 2 << 20)):
            h, bounds = _text.tokens(*_text.buffers(batch.column(at)), wordy=True)
            s, at_s = _text.grams(h, bounds, WORDS, short=False)
            found = index.search(h, bounds, s, at_s)
            out = [[dict(zip(FOUND.names, row, strict=True)) for row in found.get(i, ())] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, out_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(FOUND))]))


def _indexes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Index]:
    """Indexes over at most about ``ITEMS`` items each; the driver holds one at a time."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    n = items.count()
    passes = max(1, -(-n // ITEMS))
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == k)
        yield Index([(r.i, r.t) for r in part.collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document and item found in it: where, how alike, how many bits apart.

    Documents without findings have no row; null and empty texts and items
    have none; repeated documents and repeated items are found each.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    parts = [find(texts, index, text_col="_t", out_col="_f").select("_id", F.explode("_f").alias("_f")) for index in _indexes(benchmark, item_col, "text")]
    return reduce(DataFrame.union, parts).select(F.col("_id").alias(id_col), *(F.col(f"_f.{c}").alias(c) for c in FOUND.names))


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows, all columns, in which no item is found."""
    name = fresh("_found", docs.columns)
    text = fresh("_t", docs.columns)
    for index in _indexes(benchmark, item_col, "text"):
        marked = find(docs.withColumn(text, F.col(text_col).cast("string")), index, text_col=text, out_col=name)
        docs = marked.where(F.size(name) == 0).drop(name, text)
    return docs
