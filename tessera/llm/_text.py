"""Vectorised byte-level tokenising and hashing, straight off Arrow buffers.

A batch of texts is one UTF-8 byte buffer plus offsets.  Words are found and
hashed with a handful of numpy passes, so no Python object is made per word.
The hash of a word is a polynomial over its bytes modulo 2**64 followed by a
finaliser; a range of the prefix sums gives any word's value in O(1).

Memory stays near ``CHUNK`` bytes times a small constant beside the result,
however long one text is: work is cut at separators, not at documents.
"""

from __future__ import annotations

import contextlib
import ctypes
import warnings
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Hashes wrap around by design.
warnings.filterwarnings("ignore", "overflow encountered", RuntimeWarning)

CHUNK = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: True for letters, digits and every byte of a non-ASCII character.
WORDY = np.zeros(256, bool)
WORDY[48:58] = WORDY[65:91] = WORDY[97:123] = True
WORDY[128:] = True

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
KEEP = np.arange(256, dtype=np.uint8)

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (uint64 in, uint64 out)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, CHUNK + 4096)
        for name, base in (("p", _P), ("i", _P_INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["p"], _powers["i"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def trim() -> None:
    """Give freed memory back to the system: Python workers are kept and reused by later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@cache
def lean() -> None:
    """Let this process give large arrays back as soon as they are freed.

    The C library's allocator raises the size from which it maps memory apart
    with each large block that is freed, and then keeps what it gets; Arrow's
    own pool keeps memory too.  Workers live on from stage to stage, so what
    one stage keeps adds to the next one's needs.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


def trimmed(run):
    """A generator function over batches that keeps little memory and trims it when its task ends."""

    @wraps(run)
    def wrapper(batches):
        lean()
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapper


def slices(batch: pa.RecordBatch, at: int, budget: int = 2 << 20):
    """The batch in runs of rows of about ``budget`` bytes of text (one row at least), to bound memory."""
    column = batch.column(at)
    size = np.cumsum(np.nan_to_num(pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(float)))
    start = 0
    while start < batch.num_rows:
        done = size[start - 1] if start else 0.0
        stop = max(start + 1, int(np.searchsorted(size, done + budget, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _cuts(data: np.ndarray, offsets: np.ndarray, same: np.ndarray):
    """Chunk bounds that fall on a text's edge or where ``same`` allows a cut."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + CHUNK)
        if end < n:
            edge = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            if edge > at:
                end = edge
            else:
                back = np.flatnonzero(same[data[at:end]])
                if len(back) and back[-1] > 0:
                    end = at + int(back[-1])
                else:
                    stop = int(offsets[np.searchsorted(offsets, end, "right")])
                    ahead = np.flatnonzero(same[data[end:stop]])
                    end = end + int(ahead[0]) if len(ahead) else stop
        yield at, end
        at = end


def tokens(data: np.ndarray, offsets: np.ndarray, *, fold: bool = True, wordy: bool = False, marks: bool = False):
    """Hashes of all tokens (uint64) and, per text, where its tokens begin.

    By default tokens are runs of anything but white space.  ``wordy`` takes
    runs of letters, digits and non-ASCII bytes only; ``marks`` adds the runs
    of other visible bytes between them as tokens of their own.
    """
    table = FOLD if fold else KEEP
    cls = np.zeros(256, np.uint8)  # 0 separates; equal neighbours join
    if wordy or marks:
        cls[WORDY] = 1
        if marks:
            cls[~WORDY & ~SPACE] = 2
            cls[0:9] = cls[14:32] = cls[127] = 2
    else:
        cls[~SPACE] = 1
    edge = np.zeros(256, bool)
    edge[cls == 0] = True
    all_h, all_s = [], []
    for a, b in _cuts(data, offsets, edge):
        seg = data[a:b]
        kind = cls[seg]
        lo = np.searchsorted(offsets, a, "left")
        hi = np.searchsorted(offsets, b, "left")
        breaks = np.zeros(b - a + 1, bool)
        breaks[0] = breaks[-1] = True
        breaks[offsets[lo:hi] - a] = True
        breaks[1:-1] |= kind[1:] != kind[:-1]
        at = np.flatnonzero(breaks)
        keep = kind[at[:-1]] > 0
        s, e = at[:-1][keep], at[1:][keep]
        p, inv = _power(b - a + 1)
        acc = np.empty(b - a + 1, np.uint64)
        acc[0] = 0
        np.cumsum((table[seg].astype(np.uint64) + np.uint64(1)) * p[: b - a], out=acc[1:])
        h = (acc[e] - acc[s]) * inv[s]
        all_h.append(mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        all_s.append(s + a)
    if not all_h:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts = np.concatenate(all_s)
    return np.concatenate(all_h), np.searchsorted(starts, offsets, "left").astype(np.int64)


def grams(h: np.ndarray, bounds: np.ndarray, n: int, *, short: bool = True):
    """Hashes of all runs of ``n`` tokens, and per text where they begin.

    With ``short``, a text of 1 to n-1 tokens gives its whole sequence as one.
    """
    size = np.diff(bounds)
    count = np.maximum(size - n + 1, 0)
    if short:
        count = np.where((size > 0) & (size < n), 1, count)
    out_bounds = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    total = int(out_bounds[-1])
    if total == 0:
        return np.zeros(0, np.uint64), out_bounds
    acc = np.zeros(len(h), np.uint64)
    factor = _P
    for j in range(n):
        acc[: max(0, len(h) - j)] += h[j:] * factor
        factor = np.uint64((int(factor) * int(_P)) & (2**64 - 1))
    if (count == np.maximum(size - n + 1, 0)).all():
        keep = np.ones(len(h) + 1, bool)
        for j in range(1, n):
            last = bounds[1:][size >= j] - j
            keep[last] = False
        return mix(acc[keep[:-1]]), out_bounds
    out = np.empty(total, np.uint64)
    few = np.flatnonzero((size > 0) & (size < n))
    long = np.flatnonzero(size >= n)
    at = np.repeat(bounds[long] - out_bounds[long], count[long]) + _ranges(out_bounds[long], count[long])
    out[_ranges(out_bounds[long], count[long])] = acc[at]
    for i in few:
        part = np.uint64(size[i]) * np.uint64(0xA0761D6478BD642F)
        factor = int(_P)
        for x in h[bounds[i] : bounds[i + 1]]:
            part = part + x * np.uint64(factor)
            factor = factor * int(_P) & (2**64 - 1)
        out[out_bounds[i]] = part
    return mix(out), out_bounds


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each start, concatenated."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - count), count)


def distinct(h: np.ndarray, bounds: np.ndarray):
    """Each text's distinct hashes, ascending, with counts and new bounds."""
    h = h.copy()
    new = np.ones(len(h), bool)
    edges = bounds.tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        h[a:b].sort()
    new[1:] = h[1:] != h[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(h)))
    return h[at], weight, np.searchsorted(at, bounds, "left").astype(np.int64)


def fold_sets(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit value per text for its set of (distinct) hashes, order-free."""
    acc = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0xA0761D6478BD642F)))])
    total = acc[bounds[1:]] - acc[bounds[:-1]]
    return mix(total + np.diff(bounds).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def list_column(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and bounds (no Python objects)."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
