"""Shared helpers: numpy text kernels and connected components.

The kernels work on the bytes of many texts at once, straight from Arrow buffers. A caller
gets the rows of an Arrow batch in pieces of about ``PIECE`` bytes, so that memory stays
bounded; a longer text makes a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldproof.sources.tables import discard, stored

PIECE = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but digits and letters.
PUNCT = np.zeros(256, bool)
PUNCT[: 0x80] = True
PUNCT[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(int(_BASE), 1 << 16)
_POW_HIGH = _powers(int(_POW[-1]) * int(_BASE) % 2**64, 1 << 12)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (constants of the public splitmix64 generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null text has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def pieces(col: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about ``limit`` bytes."""
    data, offs = text_buffers(col)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


class Words:
    """The words of a piece: byte spans, and for each text the range of its words."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, sep: np.ndarray):
        self.data = LOWER[data]
        word = ~sep[self.data]
        first, last = np.empty_like(word), np.empty_like(word)
        if len(word):
            first[0], last[-1] = word[0], word[-1]
            first[1:] = word[1:] & ~word[:-1]
            last[:-1] = word[:-1] & ~word[1:]
            inner = offs[1:-1]
            inner = inner[(inner > 0) & (inner < len(word))]
            first[inner] = word[inner]
            last[inner - 1] = word[inner - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.start, offs)  # words of text i: of[i] .. of[i + 1]
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    @property
    def hash(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if self._hash is None:
            if not len(self.start):
                self._hash = np.zeros(0, np.uint64)
            else:
                size = self.end - self.start
                at = np.cumsum(size) - size
                place = np.arange(size.sum()) - np.repeat(at, size)
                value = _BYTE[self.data[place + np.repeat(self.start, size)]]
                if size.max() <= len(_POW):
                    value *= _POW[place]
                else:
                    value *= _POW[place & 0xFFFF] * _POW_HIGH[(place >> 16) % len(_POW_HIGH)]
                self._hash = mix64(np.add.reduceat(value, at) + size.astype(np.uint64))
        return self._hash

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; the last k - 1 places of the piece are left out, and
        places whose words run into the next text are the caller's to drop (see ``inside``)."""
        h = self.hash
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = h[:n] * _STEP[0]
        for j in range(1, k):
            out += h[j : j + n] * _STEP[j]
        return mix64(out + np.uint64(k))

    def inside(self, k: int) -> np.ndarray:
        """True at word places from which k words stand in one text; as long as ``grams(k)``."""
        n = max(0, len(self.start) - k + 1)
        ok = np.ones(n, bool)
        for e in self.of[1:-1]:
            ok[max(0, e - k + 1) : min(n, e)] = False
        return ok


def gram_of(hashes: np.ndarray) -> int:
    """The value that ``Words.grams`` gives for exactly these word hashes."""
    k = len(hashes)
    with np.errstate(over="ignore"):
        out = (hashes * _STEP[:k]).sum(dtype=np.uint64) + np.uint64(k)
        return int(mix64(np.array([out], np.uint64))[0])


def per_text_sum(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of values[of[i]:of[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[of[1:]] - total[of[:-1]]


class Lookup:
    """Members of a sorted uint64 set, found by a bitmap over the top bits and then binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(16, min(24, int(len(keys) * 16).bit_length())))
        self.map = np.zeros(1 << (64 - int(self.shift)), bool)
        self.map[(keys >> self.shift).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``values`` of members, and their index in ``keys``."""
        at = np.flatnonzero(self.map[(values >> self.shift).view(np.int64)]) if len(self.keys) else np.zeros(0, np.int64)
        ix = np.searchsorted(self.keys, values[at])
        ok = ix < len(self.keys)
        at, ix = at[ok], ix[ok]
        ok = self.keys[ix] == values[at]
        return at[ok], ix[ok]


def spread_join(rows: DataFrame, ones: DataFrame, key: str, by: str, salts: int = 16) -> DataFrame:
    """rows joined with ``ones``, a table with one row for each of few keys, in ``salts`` parts of each key by the column ``by``:
    a key with many rows is several tasks' work."""
    more = ones.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(F.col(by), F.lit(3)), F.lit(salts)).cast("int")
    return rows.withColumn("_salt", salt).join(more.hint("merge"), [key, "_salt"]).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: rows (id, component) with the smallest id reachable, for linked ids.

    Each round passes the smallest label over every link and then follows the label's own label
    (pointer jumping), so paths shorten by half; the table is written to the shared folder each
    round. Stops when no label changes.
    """
    both = stored(links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    changed = True
    while changed:
        heard = both.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("heard"))
        hop = label.select(F.col("id").alias("component"), F.col("component").alias("hop"))
        new = label.join(heard, "id", "left").join(hop, "component", "left").select("id", F.least("component", "heard", "hop").alias("component"), F.col("component").alias("old"))
        new = stored(new)
        changed = not new.where("component <> old").isEmpty()
        discard(label)
        label = new
    discard(both)
    return label.select("id", "component")
