"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash over the last 16 bytes is rolled along each text. A chunk ends where the hash is the
smallest within ``RADIUS`` bytes on either side, so cuts depend on nearby bytes alone: after an
insertion the next cuts are the same again. Chunks are at least ``RADIUS`` bytes but for a text's
first and last. Every chunk has a 128-bit digest; of a digest that several documents hold, the
document with the smallest id keeps its chunks, and the others lose them. What a text's edge cuts
short of ``RADIUS`` bytes is no chunk of its own: it goes with a repeated neighbour or with the
whole text, so that a word that texts begin with by chance stays.

Chunks meet by digest in one shuffle. Each task first folds its own occurrences of a digest into
one row, so a chunk that a third of all documents hold is a few rows a task, and the sorted rows
are streamed: no group is gathered in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldproof.llm.kit import pieces
from fieldproof.llm.spans import PACKED, buckets_for, cut_out, packed, union_of

RADIUS, REACH = 24, 16
_GAP = RADIUS + REACH
_GEAR = np.random.default_rng(9).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Digests that a task folds before it hands them on.
FOLD = 150_000


def cuts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, end offset within the text) of all chunks of a piece, in order."""
    size = np.diff(offs)
    n = len(size)
    shift = (np.arange(n) + 1) * _GAP
    place = np.arange(len(data)) + np.repeat(shift, size)
    total = len(data) + (n + 1) * _GAP
    h = np.zeros(total, np.uint32)
    h[place] = _GEAR[data]
    step = 1
    while step < REACH:  # h(i) = sum of gear(byte i - j) << 2j over j < REACH
        older = h[:-step] << np.uint32(2 * step)
        h[step:] += older
        step *= 2
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    outside = np.ones(total, bool)
    outside[place] = False
    h[outside] = 0xFFFFFFFF
    low = h
    for s in (1, 2, 4, 8):
        low = np.minimum(low[:-s], low[s:])
    low = np.minimum(low[:-8], low[8:])  # low[i]: smallest of h[i .. i + 23]
    here = h[place]
    cut = (here < low[place - RADIUS]) & (here <= low[np.minimum(place + 1, len(low) - 1)])
    at = np.flatnonzero(cut) + 1
    for _ in range(3):  # not inside a character
        inside = at < len(data)
        inside[inside] = (data[at[inside]] & 0xC0) == 0x80
        at[inside] += 1
    text = np.searchsorted(offs, at - 1, "right") - 1
    inner = at < offs[text + 1]
    whole = np.flatnonzero(size > 0)
    text, end = np.concatenate([text[inner], whole]), np.concatenate([at[inner], offs[whole + 1]])
    order = np.lexsort((end, text))
    text, end = text[order], end[order]
    return text, end - offs[text]


def _occurrences(texts: DataFrame) -> DataFrame:
    """(digest, lo, occ): a task's occurrences of a chunk; occ packs (id, start, end), lo is the smallest id."""
    pack = np.dtype([("id", "<i8"), ("start", "<i4"), ("end", "<i4")])

    def flush(seen: dict) -> pa.RecordBatch:
        occ = [b"".join(v) if len(v) > 1 else v[0] for v in seen.values()]
        lo = [int(np.frombuffer(o, pack)["id"].min()) if len(o) > 16 else int.from_bytes(o[:8], "little", signed=True) for o in occ]
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(lo, pa.int64()), pa.array(occ, pa.binary())], ["digest", "lo", "occ"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[bytes]] = {}
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for i, _, data, offs in pieces(batch.column("text")):
                text, end = cuts(data, offs)
                start = np.zeros(len(end), np.int64)
                start[1:] = np.where(text[1:] == text[:-1], end[:-1], 0)
                row = np.empty(len(end), pack)
                row["id"], row["start"], row["end"] = ids[i + text], start, end
                raw, packed = data.tobytes(), row.tobytes()
                for k, (a, b) in enumerate(zip((offs[text] + start).tolist(), (offs[text] + end).tolist(), strict=True)):
                    seen.setdefault(hashlib.blake2b(raw[a:b], digest_size=16).digest(), []).append(packed[16 * k : 16 * k + 16])
                if len(seen) >= FOLD:
                    yield flush(seen)
                    seen = {}
        if seen:
            yield flush(seen)

    return texts.mapInArrow(part, "digest binary, lo long, occ binary")


def _repeated(sorted_rows: DataFrame, buckets: int) -> DataFrame:
    """PACKED spans of the chunks whose digest a smaller id holds; input sorted by digest and lo."""
    pack = np.dtype([("id", "<i8"), ("start", "<i4"), ("end", "<i4")])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, owner = None, 0
        for batch in batches:
            digests, los, occs = (batch.column(c) for c in ("digest", "lo", "occ"))
            lo = los.to_numpy()
            d = np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(len(batch), 2)
            new = np.ones(len(batch), bool)
            new[1:] = (d[1:] != d[:-1]).any(axis=1)
            if len(batch) and key == d[0].tobytes():
                new[0] = False
            first = np.maximum.accumulate(np.where(new, np.arange(len(batch)), -1))
            own = np.where(first >= 0, lo[np.maximum(first, 0)], owner)
            size = np.array([len(x) for x in (o.as_buffer() for o in occs)]) if len(batch) else np.zeros(0)
            some = np.flatnonzero(~new | (size > 16))
            found = []
            for k in some:
                occ = np.frombuffer(occs[k].as_buffer(), pack)
                found.append(occ[occ["id"] > own[k]])
            if len(batch):
                key, owner = d[-1].tobytes(), int(own[-1])
            if found:
                x = np.concatenate(found)
                if (out := packed(union_of(x["id"], x["start"], x["end"]), buckets)) is not None:
                    yield out

    return sorted_rows.mapInArrow(part, PACKED)


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_run: int = RADIUS) -> DataFrame:
    """Texts without the chunks that a document with a smaller id holds too.

    Rows (id_col, n_bytes, n_removed, n_spans, text), one for each input row. Runs of repeated
    chunks are removed if they have ``min_run`` bytes, which every chunk inside a text has by default, or are the whole text. Ids are integers; rows with a null id are kept whole. Null
    texts are empty; empty texts have no chunk. Chunks repeated inside one document stay. Rows with
    equal ids count as one document and lose the same byte places. Other columns are ignored. An
    empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = buckets_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    rows = _occurrences(docs.where("id is not null")).repartition("digest").sortWithinPartitions("digest", "lo")
    out = cut_out(docs, _repeated(rows, buckets), buckets, min_run=min_run)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("text"))
