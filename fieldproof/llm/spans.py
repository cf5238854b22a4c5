"""Byte spans and places of texts, packed by bucket of the id, and cutting spans out of texts.

What a task finds about documents leaves it as one packed row for each bucket of ids, not as one
row for each document: the number of rows follows the tasks, and what belongs to a bucket is held
in memory a bucket at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = np.dtype([("id", "<i8"), ("a", "<i4"), ("b", "<i4")])
#: Rows (bucket, blob).
PACKED = "bucket int, blob binary"
#: Bytes of text of a bucket, about.
BUCKET = 4 << 20


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a union of half-open spans; adjacent ones join."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1]


def buckets_for(total_bytes: int) -> int:
    """A prime, so that ids with a regular step spread over all buckets: an id's bucket is its remainder."""
    n = int(total_bytes) // BUCKET + 2
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def bucket_of(id_: Column, buckets: int) -> Column:
    return F.pmod(id_, F.lit(buckets)).cast("int")


def packed(records: np.ndarray, buckets: int) -> pa.RecordBatch | None:
    """Records with a field id as rows of PACKED."""
    if not len(records):
        return None
    to = np.mod(records["id"], buckets)
    order = np.argsort(to, kind="stable")
    records, to = records[order], to[order]
    at = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    blobs = [records[a:b].tobytes() for a, b in zip(at.tolist(), [*at[1:].tolist(), len(to)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(to[at].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def union_of(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans as records of SPAN, overlapping and adjacent ones of an id joined."""
    if not len(ids):
        return np.zeros(0, SPAN)
    order = np.lexsort((start, ids))
    ids, start, end = ids[order], start[order].astype(np.int64), end[order].astype(np.int64)
    # every id on a stretch of its own, so that one pass joins the spans of all
    new_id = np.append(False, ids[1:] != ids[:-1])
    shift = np.cumsum(new_id) * (int(end.max()) + 2)
    a, b = merged(start + shift, end + shift)
    at = np.searchsorted(start + shift, a)
    out = np.empty(len(a), SPAN)
    out["id"], out["a"], out["b"] = ids[at], a - shift[at], b - shift[at]
    return out


def by_bucket(batches: Iterator[pa.RecordBatch], key: str = "bucket") -> Iterator[tuple[int, list[bytes]]]:
    """(key, blobs) of a stream of packed rows that is sorted by key; one key is held at a time."""
    held, last = [], None
    for batch in batches:
        for k, blob in zip(batch.column(key).to_pylist(), batch.column("blob"), strict=True):
            if held and k != last:
                yield last, held
                held = []
            last = k
            held.append(blob.as_py())
    if held:
        yield last, held


def meet(docs: DataFrame, found: DataFrame, buckets: int, kind: np.dtype, f: Callable[[pa.RecordBatch, np.ndarray, Callable[[int], np.ndarray]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Gives ``f`` the rows of docs(id, text), with what ``found`` (PACKED records of ``kind``) has of their buckets.

    f(rows, of) yields batches; of(id) gives the records of an id. Texts are streamed, the records of one bucket are held.
    Ids are not null.
    """
    texts = docs.select(bucket_of(F.col("id"), buckets).alias("bucket"), F.lit(None).cast("binary").alias("blob"), "id", "text")
    side = found.select("bucket", "blob", F.lit(None).cast("long").alias("id"), F.lit(None).cast(docs.schema["text"].dataType).alias("text"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, records = None, [], np.zeros(0, kind)

        def of(i: int) -> np.ndarray:
            return records[np.searchsorted(records["id"], i) : np.searchsorted(records["id"], i, "right")]

        for batch in batches:
            ks = batch.column("bucket").to_numpy()
            is_text = batch.column("blob").is_null().to_numpy(zero_copy_only=False)
            edge = [0, *(np.flatnonzero((ks[1:] != ks[:-1]) | (is_text[1:] != is_text[:-1])) + 1).tolist(), len(ks)] if len(ks) else [0]
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if ks[s] != key:
                    key, held, records = ks[s], [], np.zeros(0, kind)
                x = batch.slice(s, e - s)
                if not is_text[s]:
                    held += [b.as_py() for b in x.column("blob")]
                    continue
                if held:
                    records, held = np.frombuffer(b"".join(held), kind), []
                    records = records[np.argsort(records["id"], kind="stable")]
                yield from f(x, of)

    both = texts.unionByName(side).withColumn("_last", F.col("blob").isNull())
    return both.repartition("bucket").sortWithinPartitions("bucket", "_last").drop("_last").mapInArrow(part, schema)


def cut_out(docs: DataFrame, spans: DataFrame, buckets: int, *, min_run: int = 1) -> DataFrame:
    """Removes the union of ``spans`` (PACKED records of SPAN) from the texts of docs(id long, text), in runs that have at least ``min_run`` bytes or are the whole text.

    Rows (id, n_bytes, n_removed, n_spans, kept), one for each row of ``docs``; a null text is empty. Rows with equal ids lose
    the same byte places, those with a null id nothing.
    """
    texts = docs.select("id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def cut(rows: pa.RecordBatch, of: Callable[[int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        n_bytes, removed, n_spans, kept = [], [], [], []
        for i, text in zip(rows.column("id").to_pylist(), rows.column("text"), strict=True):
            raw = out = text.as_py()
            gone, runs, own = 0, 0, of(i)
            if len(own):
                a, b = merged(own["a"], np.minimum(own["b"], len(raw)))
                ok = ((b - a >= min_run) | (b - a == len(raw))) & (b > a)
                a, b = a[ok], b[ok]
                gone, runs = int((b - a).sum()), len(a)
                out = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
            n_bytes.append(len(raw))
            removed.append(gone)
            n_spans.append(runs)
            kept.append(out)
        yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    zero = F.lit(0).cast("long")
    whole = texts.where("id is null").select("id", F.length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").alias("kept"))
    return meet(texts.where("id is not null"), spans, buckets, SPAN, cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary").unionByName(whole)
