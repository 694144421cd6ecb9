"""Byte-level BPE encoding and decoding on length-bucketed numpy matrices.

Distinct pieces of an Arrow batch are grouped by byte length, padded into one
matrix per group, and merged in rounds: in every round each row merges its
leftmost pair of minimum rank.  Pair ranks come from an open-addressing hash
table in two numpy arrays; rows that have no pair left are taken out of the
matrix (compaction), as are the merged cells.  Long pieces are first cut where
no token spans two bytes; a long row that is left merges, in a round, all pairs
of its least rank.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import _text

NONE = np.int32(2**31 - 1)
#: Rows over this many bytes merge all pairs of their least rank in a round, not the leftmost alone: fewer rounds, same result.
LONG = 2048
#: Bytes of text that are encoded at once: more would find more pieces again, but take more memory.
BLOCK = 3 << 19
#: Finds a white-space character before a space.
BLANK_SPACE = regex.compile(r"\s ").search
#: Marks that are a piece by themselves after a word.
PLAIN = frozenset(".,;:?!")
#: The pattern of which no match spans a single space after a visible character, or looks across one (fixed value).
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MULT = np.uint64(0x9E3779B97F4A7C15)
_loaded: dict[tuple[str, str], "Vocabulary"] = {}


class Vocabulary:
    """Ranks of byte strings, the rank of each mergeable pair, and the inverse."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        #: Whether texts may be cut before spaces first; under any other pattern whole texts are split.
        self.spaced = pattern == SPACED
        size = max(ranks.values(), default=-1) + 1
        self.byte = np.full(256, -1, np.int32)
        for token, rank in ranks.items():
            if len(token) == 1:
                self.byte[token[0]] = rank
        left, right, out = [], [], []
        get = ranks.get
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a = get(token[:cut])
                if a is not None:
                    b = get(token[cut:])
                    if b is not None:
                        left.append(a)
                        right.append(b)
                        out.append(rank)
        #: Tokens that are part of a join which ranks before them.
        self.early = np.zeros(size, bool)
        for parts in (left, right):
            parts, joins = np.array(parts, np.int64), np.array(out, np.int64)
            self.early[parts[joins < parts]] = True
        self.neighbours = np.zeros((256, 256), bool)
        for token in ranks:
            data = np.frombuffer(token, np.uint8)
            self.neighbours[data[:-1], data[1:]] = True
        self._table(np.array(left, np.int64), np.array(right, np.int64), np.array(out, np.int32))
        lengths = np.zeros(size + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank + 1] = len(token)
        self.at = np.cumsum(lengths)
        self.bytes = np.zeros(int(self.at[-1]), np.uint8)
        for token, rank in ranks.items():
            self.bytes[self.at[rank] : self.at[rank + 1]] = np.frombuffer(token, np.uint8)

    def _table(self, left: np.ndarray, right: np.ndarray, out: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(len(out), 1) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        key = (left << 32) | right
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]] = key[won]
            self.values[slot[won]] = out[won]
            rest = np.ones(len(key), bool)
            rest[won] = False
            key, out, slot = key[rest], out[rest], (slot[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MULT) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's join, ``NONE`` where it's not in the vocabulary; -1 pads."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        key = np.where((left < 0) | (right < 0), np.int64(-2), key)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def merge_matrix(self, pieces: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a padded matrix) and their number for pieces of like length, all rows merged together round by round."""
        sizes = lengths.copy()
        width = int(sizes.max())
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        result, final = np.full_like(ids, -1), np.zeros(len(pieces), np.int64)
        row = np.arange(len(pieces))
        rank = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        while True:
            if rank.shape[1]:
                best = rank.argmin(axis=1)
                low = rank[np.arange(len(ids)), best]
            else:
                best, low = np.zeros(len(ids), np.int64), np.full(len(ids), NONE)
            done = low == NONE
            if done.any():
                result[row[done], : ids.shape[1]] = ids[done]
                final[row[done]] = sizes[done]
                live = ~done
                ids, rank, row, sizes, best, low = ids[live], rank[live], row[live], sizes[live], best[live], low[live]
                if not len(ids):
                    return result, final
                used = int(sizes.max())
                ids, rank = ids[:, :used], rank[:, : used - 1]
            n, width = ids.shape
            every = np.arange(n)
            ids[every, best] = low
            take = np.arange(width - 1)[None, :]
            ids = np.take_along_axis(ids, take + (take > best[:, None]), axis=1)
            sizes = sizes - 1
            if width == 2:
                rank = np.empty((n, 0), np.int32)
                continue
            take = np.arange(width - 2)[None, :]
            rank = np.take_along_axis(rank, take + (take >= best[:, None]), axis=1)
            after = best < width - 2
            i, j = every[after], best[after]
            rank[i, j] = self.pair_ranks(ids[i, j], ids[i, j + 1])
            before = best > 0
            i, j = every[before], best[before]
            rank[i, j - 1] = self.pair_ranks(ids[i, j - 1], ids[i, j])

    def merge_wide(self, piece: bytes) -> np.ndarray:
        """The same for one long row, of which a round merges every pair of the least rank, from the left and without overlaps.

        Where nothing that a merge makes (the new token joined with the tokens
        beside it or itself) ranks before the merge, one round does what leftmost
        merges do in many.  Otherwise, which takes an ``early`` token, a round
        merges the leftmost pair only.
        """
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        rank = self.pair_ranks(ids[:-1], ids[1:])
        while len(rank) and (low := rank.min()) != NONE:
            at = np.flatnonzero(rank == low)
            if self.early[low]:
                after, before = ids[at[at + 2 < len(ids)] + 2], ids[at[at > 0] - 1]
                new = np.full(len(after) + len(before) + 1, low, np.int32)
                made = self.pair_ranks(np.concatenate([new[: len(after) + 1], before]), np.concatenate([after, new[len(after) :]]))
                if made.min() < low:
                    at = at[:1]
            # of a run of overlapping pairs every other one, the first included
            place = np.arange(len(at))
            first = np.concatenate([[True], np.diff(at) > 1])
            at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
            ids[at] = low
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1  # where the merged ones are now
            ids = ids[keep]
            # a pair goes with its left cell; the merged cells' pairs, and those before them, are looked up
            rank = rank[keep[:-1]][: len(ids) - 1]
            for left in (new, new - 1):
                left = left[(left >= 0) & (left < len(ids) - 1)]
                rank[left] = self.pair_ranks(ids[left], ids[left + 1])
        return ids

    def cut(self, piece: bytes) -> list[bytes]:
        """The piece cut between bytes that are neighbours in no token: no merge spans such a cut."""
        data = np.frombuffer(piece, np.uint8)
        at = np.flatnonzero(~self.neighbours[data[:-1], data[1:]]) + 1
        edges = [0, *at.tolist(), len(piece)]
        return [piece[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and bounds for distinct pieces; what is no token by itself is merged by groups of like length."""
        whole_pieces = [p.encode("utf-8") for p in pieces]
        raw: list[bytes] = []
        parts_of = np.ones(len(pieces), np.int64)
        for i, piece in enumerate(whole_pieces):
            if len(piece) > LONG and piece not in self.ranks:
                parts = self.cut(piece)
                parts_of[i] = len(parts)
                raw += parts
            else:
                raw.append(piece)
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = np.fromiter(map(self.ranks.get, raw, repeat(-1)), np.int32, len(raw))
        sizes = (whole >= 0).astype(np.int64)
        left = whole < 0
        solved: list[tuple[np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(left & (length > LONG)):
            ids = self.merge_wide(raw[i])
            sizes[i] = len(ids)
            solved.append((np.array([i]), ids[None, :]))
        bits = np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64)
        group = np.where(length <= 16, length, 16 + bits * 4 + ((length - 1) >> np.maximum(bits - 3, 0) & 3))
        group[~left | (length > LONG)] = -1
        for g in np.unique(group[group >= 0]):
            members = np.flatnonzero(group == g)
            block = max(1, (1 << 20) // int(length[members].max()))
            for k in range(0, len(members), block):
                part = members[k : k + block]
                ids, n = self.merge_matrix([raw[i] for i in part], length[part])
                sizes[part] = n
                solved.append((part, ids))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.empty(int(bounds[-1]), np.int32)
        flat[bounds[:-1][~left]] = whole[~left]
        for part, ids in solved:
            n = sizes[part]
            ends = np.cumsum(n)
            flat[np.arange(int(ends[-1])) + np.repeat(bounds[part] - (ends - n), n)] = ids[np.arange(ids.shape[1]) < n[:, None]]
        # parts of one piece lie side by side
        return flat, bounds[np.concatenate([[0], np.cumsum(parts_of)])]

    def units(self, text: str) -> list[str]:
        """The text cut before each single space that follows a visible character.

        No match of the pattern spans such a cut or looks across it, so each
        unit may be split by itself, once per distinct unit.  Units but the
        first stand without their leading space.
        """
        parts = text.split(" ")
        if BLANK_SPACE(text) is None and text[:1] != " ":
            return parts
        out = parts[:1]
        for part in parts[1:]:
            if out[-1] == "" or out[-1][-1].isspace():
                out[-1] += " " + part
            else:
                out.append(part)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts (null: empty) and the bounds of each."""
        lists = [(self.units(t) if self.spaced else [t]) if t else [] for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        unit_bounds = np.concatenate([[0], np.cumsum(counts)])
        flat = np.fromiter(chain.from_iterable(lists), dtype=object, count=int(unit_bounds[-1]))
        firsts = [x[0] for x in lists if x]
        del lists
        codes, distinct = pd.factorize(flat)
        codes = codes.astype(np.int64)
        codes[unit_bounds[:-1][counts > 0]] = len(distinct) + np.arange(len(firsts))
        split = self.split
        split_up = [[" " + u] if u.isalpha() else [" " + u[:-1], u[-1]] if u[-1:] in PLAIN and u[:-1].isalpha() else split(" " + u) for u in distinct] + [split(u) for u in firsts]
        n_pieces = np.fromiter(map(len, split_up), np.int64, len(split_up))
        piece_codes, pieces = pd.factorize(np.fromiter(chain.from_iterable(split_up), dtype=object, count=int(n_pieces.sum())))
        pool, at = self.encode_pieces(list(pieces))
        # ids of each unit, then of each text
        size = np.diff(at)[piece_codes] if len(piece_codes) else np.zeros(0, np.int64)
        unit_pool = spread(pool, at, piece_codes, size)
        unit_at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n_pieces)])]
        unit_size = np.diff(unit_at)[codes] if len(codes) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(unit_size)])
        return spread(unit_pool, unit_at, codes, unit_size), ends[unit_bounds]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids."""
        return spread(self.bytes, self.at, ids, self.at[ids + 1] - self.at[ids])


def spread(pool: np.ndarray, at: np.ndarray, codes: np.ndarray, size: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """Concatenate ``pool[at[c] : at[c + 1]]`` for each code, block by block."""
    parts = []
    for k in range(0, len(codes), block):
        c, n = codes[k : k + block], size[k : k + block]
        ends = np.cumsum(n)
        total = int(ends[-1])
        parts.append(pool[np.arange(total) + np.repeat(at[c] - (ends - n), n)])
    return np.concatenate(parts) if parts else pool[:0]


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Loaded once a process; ``path`` is a tiktoken file on every node."""
    if (path, pattern) not in _loaded:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _loaded[path, pattern] = Vocabulary(ranks, pattern)
    return _loaded[path, pattern]


def encode(df: DataFrame, vocab_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text: one row per input row, ``(id_col, n_tokens, ids)``.

    ``ids`` is binary: the ids as little-endian unsigned 32-bit integers.  Null
    and empty texts give no ids.  Ids may repeat or be null; rows are kept as
    they are.  Other columns of ``df`` aren't read.
    """
    schema = T.StructType([df.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    @_text.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path, pattern)
        for batch in batches:
            for part in _text.slices(batch, 1, BLOCK):
                ids, bounds = vocab.encode(part.column(1).to_pylist())
                packed = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([
                    part.column(0),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array([packed[4 * x : 4 * y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                ], names=[id_col, "n_tokens", "ids"])

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode(df: DataFrame, vocab_path: str, pattern: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``: the bytes of packed ids (null: null).  A column of that name is replaced."""
    df = df.drop(out_col)
    at = df.columns.index(ids_col)

    @_text.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path, pattern)
        for batch in (part for b in batches for part in _text.slices(b, at, 1 << 20)):
            done = [None if x is None else vocab.decode(np.frombuffer(x, "<u4").astype(np.int64)).tobytes() for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.binary())], names=[*batch.schema.names, out_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType())]))


def digests(df: DataFrame, vocab_path: str, pattern: str) -> DataFrame:
    """The contract's rows: counts and digests of what ``encode`` and ``decode`` give.

    Null and empty texts have no ids and the digest of nothing; equal texts
    have equal rows, repeated rows one each; extra columns are left out.
    """
    return decode(encode(df, vocab_path, pattern), vocab_path, pattern).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
