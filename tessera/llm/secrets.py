"""Secret scans in SQL functions only: fixed patterns plus sliding-window entropy.

Spans come from two native calls: the matches of a pattern and the gaps that
splitting by it leaves; their running lengths give every end, in code points.  Candidate strings of a character class are then judged by the
largest Shannon entropy of any window of ``WINDOW`` characters, from counts
that change by one character in and one out at each step.  An allow list
suppresses candidates that are known to be no secrets.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._io import fresh

WINDOW = 20
#: Kinds in the order that ties of start take; ``entropy`` is what the method adds.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Character classes, narrowest first: name, pattern of a whole candidate, least bits in a window.
CLASSES = (("hex", "[0-9a-fA-F]+", 3.0), ("upper", "[A-Z0-9]+", 3.5), ("base64", "[A-Za-z0-9+/_=-]+", 3.7))
#: Candidates that any of these finds are no secrets: plain numbers, words, paths, rules and placeholders.
ALLOW = ("^[0-9_=/+-]+$", "^[A-Za-z_/=+-]+$", "(?i)example|placeholder|changeme|your[-_]?(key|token|secret)", "(.)\\1{7}", "(?i)0123456789|abcdefghij", "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Counts of a window are held in whole numbers of 64 bits, so many to a number and so many bits each.
_PER_WORD, _BITS = 12, 5
_SPAN = "array<struct<start:bigint,kind:int,stop:bigint,value:string>>"
#: Elements of a block of a running sum or maximum.
_BLOCK = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running sum or maximum (``op``) of an array of whole numbers from 0 up.

    An accumulator that grows is copied at each step, so it grows inside
    blocks only; what comes before a block is put on top of it.
    """
    none = F.array().cast("array<bigint>")
    last = lambda xs: F.coalesce(F.get(xs, F.size(xs) - 1), F.lit(0).cast("bigint"))
    scan = lambda xs: F.aggregate(xs, none, lambda acc, x: F.concat(acc, F.array(op(last(acc), x))))

    def joined(blocks: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("bigint")), scan(F.transform(blocks, last)))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda xs, o: F.transform(xs, lambda x: op(o, x))))

    def cut(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda b: scan(F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK))))
        return F.when(F.size(xs) > 0, _let(blocks, joined)).otherwise(none)

    return _let(values, cut)


def _spans(df: DataFrame, text: str, out: str, pattern: str, kind: str, *, floor: int = 0, group: int = 0) -> DataFrame:
    """Add ``out``: all matches as (start, kind, stop, value); those whose ``group`` is shorter than ``floor`` are dropped."""
    none = F.array().cast(_SPAN)
    t, whole = F.col(text), F.col(out)
    df = df.withColumn(out, F.when(t.rlike(pattern), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))))
    lengths = F.zip_with(F.slice(F.split(t, pattern, -1), F.lit(1), F.size(whole)), whole, lambda gap, w: (F.length(gap) + F.length(w)).cast("bigint"))
    span = lambda stop, w: F.struct((stop - F.length(w)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), stop.alias("stop"), w.alias("value"))
    found = F.zip_with(running(lengths, lambda a, b: a + b), whole, span)
    if floor:
        # a match by itself matches as it does in the text
        found = F.filter(found, lambda x: F.length(F.regexp_extract(x["value"], pattern, group)) >= floor)
    return df.withColumn(out, F.when(whole.isNotNull(), found).otherwise(none))


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """Most bits a character in any ``window`` of a string over the candidate alphabet; null if shorter.

    Each character is looked up once; a step takes one character out of the
    counts and puts one in.
    """
    f = [0.0 if c == 0 else c * math.log2(c) for c in range(window + 2)]
    table = F.array(*(F.lit(x) for x in f))
    words = -(-len(_ALPHABET) // _PER_WORD)
    one = F.lit(1).cast("bigint")
    bits = lambda i: (i % _PER_WORD) * _BITS
    word = lambda i: F.floor(i / _PER_WORD)
    put = lambda i: F.call_function("shiftleft", one, bits(i))
    held = lambda counts, i: F.call_function("shiftright", F.get(counts, word(i).cast("int")), bits(i)).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")
    zero = F.struct(F.array_repeat(F.lit(0).cast("bigint"), words).alias("n"), F.lit(0.0).alias("s"), F.lit(1e9).alias("least"))

    def step(acc: Column, x: Column) -> Column:
        come, go = x["come"], x["go"]
        full = go.isNotNull()
        counts = F.transform(acc["n"], lambda c, k: c + F.when(k == word(come), put(come)).otherwise(0) - F.when(full & (k == word(go)), put(go)).otherwise(0))
        a, b = held(acc["n"], come), held(acc["n"], go)
        moved = F.get(table, a + 1) - F.get(table, a) + F.when(full, F.get(table, b - 1) - F.get(table, b)).otherwise(0.0)
        s = acc["s"] + F.when(come.eqNullSafe(go), F.lit(0.0)).otherwise(moved)
        # the window is full from its last character on, one step before anything leaves it
        return F.struct(counts.alias("n"), s.alias("s"), F.when(x["whole"], F.least(acc["least"], s)).otherwise(acc["least"]).alias("least"))

    def best(codes: Column) -> Column:
        size = F.size(codes)
        left = F.concat(F.array_repeat(F.lit(None).cast("int"), window), F.slice(codes, F.lit(1), size - window))
        places = F.transform(F.sequence(F.lit(1), size), lambda i: i >= window)
        moves = F.arrays_zip(codes.alias("come"), left.alias("go"), places.alias("whole"))
        return F.aggregate(moves, zero, step, lambda acc: F.lit(math.log2(window)) - acc["least"] / window)

    codes = F.transform(F.split(value, "", -1), lambda c: F.instr(F.lit(_ALPHABET), c) - 1)
    # splitting at nothing may leave an empty last part
    return F.when(F.length(value) >= window, _let(F.slice(codes, F.lit(1), F.length(value)), best))


def high_entropy(value: Column) -> Column:
    """True where no allow-list entry fits and the narrowest class's entropy bound is reached."""
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | value.rlike(pattern)
    bound = F.lit(99.0)
    for _, pattern, least in reversed(CLASSES):
        bound = F.when(value.rlike(f"^{pattern}$"), least).otherwise(bound)
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(value) >= bound)


def scan(df: DataFrame, *, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """Add ``out_col``: spans (start, kind, stop, value), ordered by start and kind.

    ``kind`` is an index into ``KINDS``; places are code points, stop
    exclusive.  Null and empty texts have none.  An entropy span is added only
    where no fixed pattern's span holds the whole candidate.  A column named
    ``out_col`` is replaced, and no other is touched; one row out for each row
    in, repeated rows included.  Time grows with the text's length and the
    number of matches, however long one candidate is.
    """
    df = df.drop(out_col)
    text, assign, access, hex_, more, every = (fresh(n, df.columns) for n in ("_text", "_assign", "_access", "_hex", "_more", "_every"))
    # Class runs are maximal, so asking for the least length within the pattern finds the same matches as a filter after it.
    df = df.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = _spans(df, text, assign, ASSIGN, "assign", floor=12, group=2)
    df = _spans(df, text, access, ACCESS.replace("+", "{14,}"), "access")
    df = _spans(df, text, hex_, HEX.replace("+", "{16,}"), "hex")
    df = _spans(df, text, more, CANDIDATE, "entropy")
    # in order of start, fixed kinds first: a candidate is held if a span at or before it reaches its end
    fixed = KINDS.index("entropy")
    df = df.withColumn(every, F.array_sort(F.concat(assign, access, hex_, more)))
    reach = running(F.transform(every, lambda x: F.when(x["kind"] < fixed, x["stop"]).otherwise(F.lit(0).cast("bigint"))), F.greatest)
    judged = F.zip_with(every, reach, lambda x, r: F.struct(x.alias("x"), ((x["kind"] < fixed) | ((r < x["stop"]) & high_entropy(x["value"]))).alias("keep")))
    kept = F.transform(F.filter(judged, lambda y: y["keep"]), lambda y: y["x"])
    return df.withColumn(out_col, F.when(F.size(more) > 0, kept).otherwise(F.col(every))).drop(text, assign, access, hex_, more, every)


def _joined(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """The contract's rows: counts by kind, the base spans' digest, and all spans.

    Null and empty texts have no spans, counts of 0 and the digest of the empty
    string; equal texts have equal rows, and repeated rows one each.  Extra
    columns of ``docs`` are left out.
    """
    df = scan(docs.select("doc_id", "text"), out_col="_spans").select("doc_id", "_spans")
    count = lambda kind: F.size(F.filter("_spans", lambda x: x["kind"] == KINDS.index(kind))).cast("long")
    base = F.filter("_spans", lambda x: x["kind"] < KINDS.index("entropy"))
    return df.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.encode(_joined(base), "UTF-8"), 256).alias("base_sha256"),
        _joined(F.col("_spans")).alias("spans"),
        count("entropy").alias("n_entropy"),
    )
