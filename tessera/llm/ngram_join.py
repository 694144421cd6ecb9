"""N-gram Jaccard self-join by PartEnum signatures.

A text is the set of hashes of its five-word shingles.  Sets are put into size
bands whose bounds grow threefold, so similar sets are in one band or in
neighbouring ones; a pair belongs to the level of its smaller set's band, and a
set near a band's lower bound takes part in the level below as well.  A level
cuts the feature domain into ``n1`` parts by hash and enumerates subsets of
the parts; a signature is the level, the subset and the hash of what the set
has there.  Two sets that differ in at most d elements differ in at most d
parts, so they share at least n1 - d single parts.

Of PartEnum's parameters those of fewest signatures are taken: subsets of one
part (no scheme that bears d differences has fewer than d + 1 signatures;
subsets of two out of three parts need half as many again), and as many parts
as the largest sets of the band need, for which fewer, wider bands let most
sets take part in one level only: about 0.4 signatures a shingle.

All parts of a set are ranked by one global order that puts parts holding many
uncommon shingles first; by the pigeonhole principle sharing n1 - d parts
means sharing one among each set's first d + 1.  Only those are emitted, which
drops empty parts and parts filled by passages that half the corpus holds,
without losing any pair.  (Which shingles count as common comes from a bounded
sample and changes cost, never results.)

Texts with equal sets are one class from the start.  Candidates are verified
by exact intersection, in two steps.  First every class is held against the
leaders of its signatures' groups (the member that shares most), which joins
families of near copies at a few checks a member.  Then only pairs that still
lie in different components are looked at, and inside the join itself: a pair
leaves it only if its sizes fit and the odd sketches (parities of the sets'
elements by hash) differ in no more bits than similar sets can; then it must
share as many signatures as similar sets of its sizes at least do.  All these
bounds are exact.  So no group emits all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import _text
from tessera.llm._io import discard, fresh, materialise, release
from tessera.llm.components import components

WORDS = 5
#: Similarity as a fraction: 100 * intersection >= 75 * union.
NUM, DEN = 75, 100
#: Extra parts that the ranking may leave out, as a share of the needed ones.
SLACK = 0.5
#: Upper size bound of the first band, and what the bound grows by from band to band.
FIRST_BAND, STRETCH = 24, 3
#: Parts of a level at least, so that the elements of small sets lie apart.
LEAST_PARTS = 64
#: 64-bit words in a set's odd sketch.
SKETCH = 16
_SKETCHES = [f"k{i}" for i in range(SKETCH)]
#: Leaders that each class is held against first.
LEADERS = 3
#: Texts in the sample that finds common shingles, in how many of them a shingle must be, and most shingles kept.
SAMPLE, SEEN, COMMON = 2000, 8, 20000
#: Most class ids that are sent to all nodes; beyond, a shuffled join takes over.
BROADCAST_IDS = 2_000_000


@cache
def _bands(upto: int) -> tuple[int, ...]:
    """Upper size bound of each band, the last at least ``upto``."""
    out = [FIRST_BAND]
    while out[-1] < upto:
        out.append(out[-1] * STRETCH)
    return tuple(out)


def differ(a: int, b: int) -> int:
    """Most elements that similar sets of sizes a and b can differ in."""
    both = a + b
    # 100 i >= 75 (a + b - i)  =>  i >= 75 (a + b) / 175
    return both - 2 * -(-NUM * both // (NUM + DEN))


def differ_up_to(low: int, high: int) -> int:
    """Most elements that similar sets can differ in whose sizes add up to low .. high.

    ``differ`` goes up and down with the sum of the sizes, but grows by one
    every seven steps (NUM + DEN over DEN - NUM): the last seven sums have the
    maximum.
    """
    period = (NUM + DEN) // (DEN - NUM)
    return max(differ(0, both) for both in range(max(low, high - period + 1), high + 1))


@cache
def _plan(size: int) -> tuple[tuple[int, int, int, bool], ...]:
    """(level, parts, how many to emit, whether it's the set's own level) for a set of ``size`` elements."""
    bands = _bands(size)
    band = next(i for i, high in enumerate(bands) if size <= high)
    least, most = -(-size * NUM // DEN), size * DEN // NUM  # sizes of similar sets
    out = []
    for level in (band, band - 1):
        if level < 0 or least > bands[level]:
            continue  # nothing in the lower band is large enough
        top = bands[level]
        need = differ_up_to(2, top + top * DEN // NUM)
        parts = max(LEAST_PARTS, need + 1 + int(np.ceil(SLACK * (need + 1))))
        d = differ_up_to(size + least, size + (most if level == band else top))
        out.append((level, parts, min(parts, d + 1), level == band))
    return tuple(out)


def signatures(s: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (uint64) of one set of distinct hashes; and how many its level has, negative if the level isn't its own."""
    out, kind = [], []
    weight = np.full(len(s), 1.0)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        weight[common[at] == s] = 1e-6
    for level, parts, emit, own in _plan(len(s)):
        seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        m = _text.mix(s ^ seed)
        part = ((m >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        acc = np.concatenate([[np.uint64(0)], np.cumsum(_text.mix(m + np.uint64(0x632BE59BD9B4E019))[order])])
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        content = acc[ends[1:]] - acc[ends[:-1]]
        mass = np.bincount(part, weight, parts)
        sig = _text.mix(content + _text.mix(np.arange(parts, dtype=np.uint64) + seed))
        if emit < parts:
            rank = np.lexsort((sig, -mass))  # equal signatures have equal content, and so equal mass
            sig = sig[rank[:emit]]
        out.append(sig)
        kind.append(np.full(len(sig), emit if own else -emit, np.int32))
    return np.concatenate(out), np.concatenate(kind)


def _sets(batch_text: pa.Array):
    h, bounds = _text.tokens(*_text.buffers(batch_text))
    return _text.distinct(*_text.grams(h, bounds, WORDS))


def classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, size n of its set, the set's class c (null for an empty set) and its odd sketch."""
    schema = T.StructType([T.StructField(name, T.LongType()) for name in ("id", "n", "c", *_SKETCHES)])

    @_text.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in _text.slices(b, 1)):
            s, _, bounds = _sets(batch.column(1))
            n = np.diff(bounds)
            c = pa.array(_text.fold_sets(s, bounds).view(np.int64), pa.int64(), mask=n == 0)
            words = odd_sketches(s, bounds)
            sketch = (pa.array(np.ascontiguousarray(words[:, i])) for i in range(SKETCH))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), c, *sketch], names=schema.names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def common_shingles(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Shingles that many classes of a bounded sample (those of least hash) hold, ascending."""
    chosen = members.groupBy("c").agg(F.min("id").alias("id")).orderBy(F.xxhash64("c"), "c").limit(SAMPLE)

    @_text.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b.column(0).flatten().to_numpy() for b in batches]
        s, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, int))
        s, n = s[n >= SEEN], n[n >= SEEN]
        top = np.argsort(-n, kind="stable")[:COMMON]
        yield pa.RecordBatch.from_arrays([pa.array(s[top], pa.int64())], names=["s"])

    sets = _sets_of(docs, chosen, SAMPLE, id_col, text_col).select("s")
    found = sets.repartition(1).mapInArrow(run, "s long").toPandas()  # COMMON rows at most
    return np.sort(found["s"].to_numpy(np.int64).view(np.uint64))


def _signature_rows(docs: DataFrame, text_col: str, common: np.ndarray) -> DataFrame:
    """(signature, class), once for each class that a task sees."""
    sent = docs.sparkSession.sparkContext.broadcast(common)  # COMMON numbers at most

    @_text.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (part for b in batches for part in _text.slices(b, 0)):
            s, _, bounds = _sets(batch.column(0))
            c = _text.fold_sets(s, bounds).view(np.int64)
            parts: list[tuple[np.ndarray, np.ndarray]] = []
            owner: list[int] = []
            for i in np.flatnonzero(np.diff(bounds)):
                if int(c[i]) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()  # only saves work: copies that come again are dropped later
                seen.add(int(c[i]))
                parts.append(signatures(s[bounds[i] : bounds[i + 1]], sent.value))
                owner.append(int(c[i]))
                if len(parts) >= 512:
                    yield packed(parts, owner)
                    parts, owner = [], []
            if parts:
                yield packed(parts, owner)

    def packed(parts: list[tuple[np.ndarray, np.ndarray]], owner: list[int]) -> pa.RecordBatch:
        c = np.repeat(np.array(owner, np.int64), [len(x) for x, _ in parts])
        sig, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(c), pa.array(kind, pa.int32())], names=["sig", "c", "e"])

    return docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "sig long, c long, e int")


def odd_sketches(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parity, for each of 64 * SKETCH hash values, of how many elements of each set have it: SKETCH words a set.

    Sketches of two sets differ in at most as many bits as the sets differ in elements.
    """
    bits = 64 * SKETCH
    at = (_text.mix(s ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(40)).astype(np.int64) % bits
    out = []
    for k in range(0, len(bounds) - 1, 512):
        part = bounds[k : k + 513]
        doc = np.repeat(np.arange(len(part) - 1), np.diff(part))
        odd = np.bincount(doc * bits + at[part[0] : part[-1]], minlength=(len(part) - 1) * bits) & 1
        out.append(np.packbits(odd.astype(bool).reshape(-1, bits), axis=1).view(np.int64))
    return np.concatenate(out) if out else np.zeros((0, SKETCH), np.int64)


def _verify(docs: DataFrame, pairs: DataFrame, heads: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar, by exact intersection; only sets that a pair asks for are made."""
    pairs = materialise(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    wanted = materialise(heads.join(wanted, "c", "left_semi").select("id", "c", "repeats"), "wanted")
    n_wanted, repeats = wanted.agg(F.count(F.lit(1)), F.max("repeats")).first()
    if not n_wanted:
        discard(pairs, wanted)
        return docs.sparkSession.createDataFrame([], "a long, b long")
    sets = _sets_of(docs, wanted, n_wanted, id_col, text_col)
    if repeats > 1:
        sets = sets.dropDuplicates(["c"])
    # both joins read one exchange of the sets, which needs no table beside it
    left = pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    out = materialise(both.where(common * (NUM + DEN) >= NUM * (F.size("sa") + F.size("sb"))).select("a", "b"), "found")
    discard(pairs, wanted)
    release(docs.sparkSession)
    return out


def _apart(x: str, y: str) -> Column:
    """In how many bits the sketches of two rows differ."""
    return sum((F.bit_count(F.col(f"{k}_{x}").bitwiseXOR(F.col(f"{k}_{y}"))) for k in _SKETCHES), F.lit(0))


def _could_be_similar(x: str = "x", y: str = "y") -> Column:
    """Sizes and sketches allow two rows to be similar."""
    nx, ny = F.col(f"n_{x}"), F.col(f"n_{y}")
    return (nx * DEN >= ny * NUM) & (ny * DEN >= nx * NUM) & (_apart(x, y) <= _most(nx, ny))


def _named(df: DataFrame, side: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{c}_{side}") for c in df.columns))


def _most(a: Column, b: Column) -> Column:
    """``differ`` as a column expression."""
    both = a + b
    return both - 2 * F.floor((NUM * both + NUM + DEN - 1) / F.lit(float(NUM + DEN)))


def links(docs: DataFrame, members: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Links (u, v) between classes that connect all classes that any links connect.

    ``members`` has what ``classes`` gives, without empty sets.  Verified
    pairs that would only join what is joined already are left out.
    """
    spark = docs.sparkSession
    rows = _signature_rows(docs, text_col, common_shingles(docs, members, id_col, text_col))
    by = Window.partitionBy("sig").orderBy("c")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("sig", "c", "e", F.lag("c").over(by).alias("before"), (F.first("c").over(whole) != F.last("c").over(whole)).alias("several"))
    # copies in other tasks give the same row again: keep the first of each
    shared = materialise(rows.where("several and (before is null or before <> c)").select("sig", "c", "e"), "shared")
    release(spark)
    # one row a class that shares a signature: its least id, how many rows have that, its size and sketch
    heads = members.join(shared.select("c").distinct(), "c", "left_semi").groupBy("c", "id").agg(F.count(F.lit(1)).alias("repeats"), *(F.first(k).alias(k) for k in ("n", *_SKETCHES)))
    heads = heads.groupBy("c").agg(F.min(F.struct("id", "repeats")).alias("i"), *(F.first(k).alias(k) for k in ("n", *_SKETCHES)))
    heads = materialise(heads.select("c", "i.id", "i.repeats", "n", *_SKETCHES), "heads")
    sized = heads.select("c", "n", *_SKETCHES)

    # step one: against the leaders of its groups, those first that it meets most often
    popular = shared.join(shared.groupBy("sig").agg(F.count(F.lit(1)).alias("size")), "sig").groupBy("c").agg(F.sum("size").alias("p"))
    leader = shared.join(popular, "c").groupBy("sig").agg(F.max(F.struct("p", "c")).alias("l")).select("sig", F.col("l.c").alias("a"))
    met = shared.join(leader, "sig").where("a <> c").groupBy("a", F.col("c").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("k"), "a"))).where(F.col("r") <= LEADERS)
    first = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = first.join(_named(sized, "x").withColumnRenamed("c_x", "a"), "a").join(_named(sized, "y").withColumnRenamed("c_y", "b"), "b")
    first = materialise(first.where(_could_be_similar()).select("a", "b"), "first")
    release(spark)
    found = _verify(docs, first, heads, id_col, text_col)

    # step two: what still lies in different components
    label = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
    group = Window.partitionBy("sig")
    mixed = shared.join(label.withColumnRenamed("node", "c"), "c", "left").select("sig", "c", "e", F.coalesce("component", "c").alias("g"))
    mixed = mixed.withColumn("_m", F.min("g").over(group) != F.max("g").over(group)).where("_m").drop("_m")
    mixed = materialise(mixed.join(sized, "c"), "mixed")
    discard(shared)
    release(spark)
    x, y = _named(mixed, "x"), _named(mixed, "y")
    # a level is for pairs of which it is one's own
    fits = (F.col("sig_x") == F.col("sig_y")) & (F.col("g_x") < F.col("g_y")) & ((F.col("e_x") > 0) | (F.col("e_y") > 0)) & _could_be_similar()
    least = F.least(F.abs("e_x"), F.abs("e_y")) - _most(F.col("n_x"), F.col("n_y"))
    pairs = x.join(y, fits).select(F.least("c_x", "c_y").alias("a"), F.greatest("c_x", "c_y").alias("b"), least.alias("least"))
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.first("least").alias("least")).where("k >= least").select("a", "b")
    more = _verify(docs, pairs.join(first, ["a", "b"], "left_anti"), heads, id_col, text_col)
    discard(first, mixed, heads)
    return found.union(more).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _sets_of(docs: DataFrame, wanted: DataFrame, n_wanted: int, id_col: str, text_col: str) -> DataFrame:
    """(class, sorted set) for the texts of the wanted classes' ids (id, c), found by their ids: one row for each row of that id and class."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    wanted = wanted.select("id", "c")
    side = F.broadcast(wanted) if n_wanted <= BROADCAST_IDS else wanted
    # a class may have rows with null ids only
    picked = texts.join(side, texts["id"].eqNullSafe(wanted["id"])).select("c", "t")
    schema = T.StructType([T.StructField("c", T.LongType()), T.StructField("s", T.ArrayType(T.LongType()))])

    @_text.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in _text.slices(b, 1)):
            s, _, bounds = _sets(batch.column(1))
            right = pa.array(_text.fold_sets(s, bounds).view(np.int64)).to_numpy() == batch.column(0).to_numpy()
            out = pa.RecordBatch.from_arrays([batch.column(0), _text.list_column(s.view(np.int64), bounds, pa.int64())], names=schema.names)
            yield out.filter(pa.array(right))  # rows may share an id

    return picked.mapInArrow(run, schema)


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n, class c (null for an empty set) and component_id."""
    members = materialise(classes(docs, id_col, text_col), "members")
    found = links(docs, members.where("c is not null"), id_col=id_col, text_col=text_col)
    label = components(found)
    heads = members.where("c is not null").groupBy("c").agg(F.min("id").alias("low"))
    heads = heads.join(label.withColumnRenamed("node", "c"), "c", "left").withColumn("g", F.coalesce("component", "c"))
    lows = heads.groupBy("g").agg(F.min("low").alias("component_id"))
    named = heads.select("c", "g").join(lows, "g").select("c", "component_id")
    return members.join(named, "c", "left").select("id", "n", "c", F.coalesce("component_id", "id").alias("component_id"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    component_id is the least id reachable by links, the row's own included.
    Null, empty and blank texts have no shingles and no links.  Ids must be
    whole numbers; null ids are kept, with a null component unless linked.
    Repeated rows give one row each.
    """
    out = _components(docs, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns, that are their component's least id; of rows that share that id one stays.

    Rows without shingles (null, empty or blank texts) are in no group and all
    stay, as do rows with a null id that nothing links to a row with one.
    Where ids repeat, a row goes by its id and its set, so a text that shares
    its id with a copy of another text isn't taken for one.
    """
    marks = _components(docs.select(id_col, text_col), id_col, text_col).where("c is not null")
    gone = materialise(marks.where(F.col("component_id") != F.col("id")).select(F.col("id").alias("_gone"), F.col("c").alias("_class")).distinct(), "gone")
    # ids that more than one row of a component keeps, or that both stay and go: none where ids are unique
    twice = marks.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1 and id is not null").select(F.col("id").alias("_twice"))
    twice = materialise(twice, "twice")
    plain = gone.select("_gone").distinct()
    if twice.isEmpty():
        return _without(docs, plain, docs[id_col].cast("long") == plain["_gone"])
    name, place = fresh("_set", docs.columns), fresh("_place", docs.columns)
    clear = _without(docs, twice, docs[id_col].cast("long") == twice["_twice"])
    clear = _without(clear, plain, clear[id_col].cast("long") == plain["_gone"])
    side = F.broadcast(twice) if twice.count() <= BROADCAST_IDS else twice
    again = _with_class(docs.join(side, docs[id_col].cast("long") == twice["_twice"], "left_semi"), text_col, name)
    again = _without(again, gone, (again[id_col].cast("long") == gone["_gone"]) & (again[name] == gone["_class"]))
    # of equal ids in one component one row: those of one class, or of classes that share the component
    heads = marks.select(F.col("id").alias("_head"), F.col("c").alias("_c"), "component_id").where("component_id = _head").distinct()
    again = again.join(heads, (again[id_col].cast("long") == heads["_head"]) & (again[name] == heads["_c"]), "left")
    by = Window.partitionBy(F.col(id_col)).orderBy(F.xxhash64(F.col(text_col).cast("string")), F.col(text_col).cast("string"))
    again = again.withColumn(place, F.when(F.col("_head").isNotNull(), F.row_number().over(by.partitionBy(F.col(id_col), F.col("_head").isNull()))))
    again = again.where(F.col(place).isNull() | (F.col(place) == 1))
    return clear.unionByName(again.select(*docs.columns))


def _without(docs: DataFrame, ids: DataFrame, same: Column) -> DataFrame:
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, same, "left_anti")


def _with_class(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """Add each row's class (null for an empty set) as ``name``."""
    at = docs.columns.index(text_col)

    @_text.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in _text.slices(b, at)):
            s, _, bounds = _sets(batch.column(at).cast(pa.string()))
            c = pa.array(_text.fold_sets(s, bounds).view(np.int64), pa.int64(), mask=np.diff(bounds) == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, c], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
