"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is ``window`` consecutive words of a benchmark item; an item with fewer words, but not
none, is one window. A document contains a window only if it contains every word shingle of it,
so one necessary token is enough to find candidates: shingles are ordered by rarity (document
frequency over the whole corpus, one counting pass), each window is indexed under its rarest
shingle, and a document's shingles are looked up in that index. The place of the shingle in the
window fixes where the window would stand (positional bound); it must fit between the first and
the last word of the text (length bound); then all its words are compared, by their hashes and those that agree byte by byte.

The benchmark is cut into blocks of at most ``block_bytes`` of text by a hash of item_id. Only
the index of one block is broadcast at a time, so the size of what is sent is bounded; the blocks
are chained row by row over the same scan of the documents and nothing of a document is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldproof.llm.kit import PUNCT, Lookup, Words, gram_of, pieces

SHINGLE = 3
WINDOW = 10


class Index:
    """Distinct windows of some items, each with the items that have it, and their shingles."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        seen: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []
        self.texts: list[bytes] = []
        self.items: list[list[str]] = []
        for item, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            found = Words(raw, np.array([0, len(raw)]), PUNCT)
            h = found.hash
            for i in range(max(1, len(h) - window + 1) if len(h) else 0):
                w = h[i : i + window]
                k = seen.setdefault(w.tobytes(), len(seen))
                if k == len(self.words):
                    self.words.append(w)
                    self.texts.append(_plain(found, i, i + len(w)))
                    self.items.append([])
                if not self.items[k] or self.items[k][-1] != item:
                    self.items[k].append(item)
        #: of each window, its (shingle length, shingle hash, place in the window)
        self.tokens = [[(k, gram_of(w[j : j + k]), j) for k in [min(shingle, len(w))] for j in range(len(w) - k + 1)] for w in self.words]
        self.lengths = sorted({t[0] for ts in self.tokens for t in ts})

    def shingles(self) -> dict[int, np.ndarray]:
        return {k: np.unique(np.array([h for ts in self.tokens for n, h, _ in ts if n == k], np.uint64)) for k in self.lengths}

    def by_rarest(self, counts: dict[tuple[int, int], int]) -> dict:
        """Windows under their rarest shingle. Counts only choose the shingle, so that any of them gives the same hits: one that has
        not been counted is the rarest."""
        out: dict[int, dict[int, list[tuple[int, int]]]] = {k: defaultdict(list) for k in self.lengths}
        for w, ts in enumerate(self.tokens):
            k, h, j = min(ts, key=lambda t: (counts.get(t[:2], 0), t))
            out[k][h].append((w, j))
        return {
            "prefix": {k: (np.array(sorted(d), np.uint64), [d[h] for h in sorted(d)]) for k, d in out.items() if d},
            "words": self.words,
            "texts": self.texts,
            "items": self.items,
        }


def _plain(words: Words, first: int, end: int) -> bytes:
    """The words from ``first`` to before ``end``, with a space between."""
    return b" ".join(words.data[a:b].tobytes() for a, b in zip(words.start[first:end].tolist(), words.end[first:end].tolist(), strict=True))


def _counted(rows: DataFrame, shingles: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """Number of texts that contain each of the shingles, over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(shingles)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = {k: Lookup(v) for k, v in shared.value.items()}
        total = {k: np.zeros(len(v), np.int64) for k, v in shared.value.items()}
        for batch in batches:
            for _, _, data, offs in pieces(batch.column("_t")):
                words = Words(data, offs, PUNCT)
                for k, find in look.items():
                    at, ix = find.find(words.grams(k))
                    text = np.searchsorted(words.of, at, "right") - 1
                    ok = at + k <= words.of[text + 1]
                    pair = np.unique(text[ok] * len(find.keys) + ix[ok])
                    total[k] += np.bincount(pair % max(1, len(find.keys)), minlength=len(find.keys))
        for k, v in total.items():
            some = np.flatnonzero(v)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(shared.value[k][some].view(np.int64)), pa.array(v[some])], ["k", "h", "n"])

    got = rows.select("_t").mapInArrow(count, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n"))
    return {(r.k, r.h & (2**64 - 1)): r.n for r in got.collect()}  # at most the shingles of one block of the benchmark


def _hits(index: dict, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of an indexed window in a piece."""
    first, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    h = words.hash
    for k, (keys, entries) in index["prefix"].items():
        at, ix = index["look"][k].find(words.grams(k))
        order = np.argsort(ix, kind="stable")
        at, ix = at[order], ix[order]
        for i in np.unique(ix):
            places = at[np.searchsorted(ix, i) : np.searchsorted(ix, i, "right")]
            text = np.searchsorted(words.of, places, "right") - 1
            for w, j in entries[i]:
                want = index["words"][w]
                start = places - j
                ok = (start >= words.of[text]) & (start + len(want) <= words.of[text + 1])
                start = start[ok]
                for m in range(len(want)):
                    if not len(start):
                        break
                    start = start[h[start + m] == want[m]]
                start = start[[_plain(words, s, s + len(want)) == index["texts"][w] for s in start.tolist()]] if len(start) else start
                if len(start):
                    first.append(start)
                    which.append(np.full(len(start), w))
    return np.concatenate(first), np.concatenate(which)


def _mark(rows: DataFrame, index: Index, counts: dict) -> DataFrame:
    """Adds the occurrences of one block's windows to the columns n_words, hit (a bit for each word) and items."""
    shared = rows.sparkSession.sparkContext.broadcast(index.by_rarest(counts))
    names = rows.columns
    had = "hit" in names

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = dict(shared.value)
        ix["look"] = {k: Lookup(keys) for k, (keys, _) in ix["prefix"].items()}
        sizes = np.array([len(w) for w in ix["words"]], np.int64)
        for batch in batches:
            n_words = np.zeros(len(batch), np.int64)
            hit: list = batch.column("hit").to_pylist() if had else [None] * len(batch)
            items: list = batch.column("items").to_pylist() if had else [[] for _ in range(len(batch))]
            for i, j, data, offs in pieces(batch.column("_t")):
                words = Words(data, offs, PUNCT)
                n_words[i:j] = words.counts
                start, which = _hits(ix, words)
                if not len(start):
                    continue
                step = np.zeros(len(words) + 1, np.int32)
                np.add.at(step, start, 1)
                np.add.at(step, start + sizes[which], -1)
                cover = np.cumsum(step[:-1]) > 0
                text = np.searchsorted(words.of, start, "right") - 1
                for t in np.unique(text):
                    bits = np.packbits(cover[words.of[t] : words.of[t + 1]])
                    if hit[i + t]:
                        bits |= np.frombuffer(hit[i + t], np.uint8)
                    hit[i + t] = bits.tobytes()
                    items[i + t] = sorted({x for w in np.unique(which[text == t]) for x in ix["items"][w]} | set(items[i + t]))
            keep = [batch.column(c) for c in names if c not in ("n_words", "hit", "items")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n_words), pa.array(hit, pa.binary()), pa.array(items, pa.list_(pa.string()))], [*(c for c in names if c not in ("n_words", "hit", "items")), "n_words", "hit", "items"])

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("n_words", "hit", "items"))
    return rows.mapInArrow(mark, f"{base}, n_words long, hit binary, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = 8 << 20, keep: list[str] | None = None) -> DataFrame:
    """Benchmark windows in every whole text: rows (id_col, *keep, n_words, n_hit, items), one for each input row.

    ``n_hit`` counts the words inside any occurrence of any window, ``items`` lists the ids (as
    strings, sorted) of the items that have an occurring window. Words are lower-cased in A-Z.

    Null or empty texts have 0 words and no hit. Items without words have no window and never
    occur; items with equal windows are all listed. A null item id is left out. Repeated rows are
    judged one by one; rows are told apart by row, never joined by id. An empty benchmark gives 0
    hits; an empty docs table no rows. Other columns of either table are ignored, but for
    ``keep``, whose columns are passed on unless they have a result's name.
    """
    keep = [c for c in keep or [] if c not in (id_col, "n_words", "n_hit", "hit", "items")]
    rows = docs.select(F.col(id_col).alias("_id"), *(c for c in keep if c != text_col), F.col(text_col).cast("string").alias("_t"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    out = rows
    for b in range(blocks):
        index = Index(sorted((r.item, r.text) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()), window, shingle)
        out = _mark(out, index, _counted(rows, index.shingles()) if index.words else {})
    return out.select(F.col("_id").alias(id_col), *(F.col("_t").alias(c) if c == text_col else F.col(c) for c in keep), "n_words", _bits("hit").cast("long").alias("n_hit"), "items")


def _bits(name: str) -> Column:
    """Number of set bits of a binary column (null: 0), from its hexadecimal digits."""
    digits = F.hex(name)
    weight = {1: "1248", 2: "3569AC", 3: "7BDE", 4: "F"}
    return F.coalesce(sum((F.length(F.translate(digits, "".join(set("0123456789ABCDEF") - set(ds)), "")) * n for n, ds in weight.items()), F.lit(0)), F.lit(0))

