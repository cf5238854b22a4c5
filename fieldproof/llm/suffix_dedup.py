"""Exact substring dedup with per-shard suffix arrays.

A byte is removed if a string of ``WIDTH`` bytes that covers it also starts in a document with a
smaller id.

1. Candidates. Winnowing picks anchors: of every ``WINNOW`` neighbouring ``GRAM``-byte strings the
   one with the smallest hash, so every string of WIDTH bytes contains an anchor, and equal strings
   contain equal ones. All anchors meet by hash, packed, with a digest of their context (the bytes
   that a WIDTH-byte string around the anchor can reach). An anchor seen in one document only is
   dropped. Contexts with equal digests, of the same anchor, count as equal and fold into one, which
   its smallest document stands for (64 bits for the anchor and 64 for the context).
2. Shards. The distinct contexts of anchors that several documents share are dealt to shards by
   anchor. Each shard's suffix array is built by Larsson-Sadakane refinement in numpy, common
   prefixes by Kasai's rule, and runs of suffixes with a common prefix of WIDTH bytes give the
   smallest document of each string.
3. Merging. Contexts of anchors with more of them than one shard should hold are dealt over shards
   at will, so a string can stand in several. The ordered strings of each such shard's suffix array are cut
   at common bounds by binary search, equal strings of all shards meet in one range, and the
   smallest document of all shards owns them.
4. The covered bytes of each document are united and cut out.

Texts are read whole, long ones in overlapping segments. Anchors that a sample shows to be frequent
are spread over the exchange by context instead of by anchor, and merged as in 3; the sample
decides only where they are dealt to, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldproof.llm.kit import mix64, pieces, stored
from fieldproof.llm.spans import PACKED, SPAN, buckets_for, by_bucket, cut_out, meet, packed, union_of

WIDTH = 50
GRAM = 26
WINNOW = WIDTH - GRAM + 1
SIDE = WIDTH - GRAM
SEGMENT, MARGIN = 1 << 18, 2 * WIDTH
#: Anchors that one part of the exchange holds on average; contexts of one anchor that go to one shard at most.
PART_ANCHORS, HOT = 200_000, 2_000
#: Bytes of text whose anchors a task packs at a time.
PACK = 4 << 20
#: Bytes of text of one suffix array, about; bytes of contexts that a task hands on at a time; of the strings of one range.
SHARD, FLUSH, RANGE = 1 << 20, 4 << 20, 4 << 20
#: Bytes of text that the sample for frequent anchors has at least, times that an anchor is seen in it to count as frequent, and how many may be named.
SAMPLE, SEEN, NAMED = 8 << 20, 32, 1 << 20
#: Ranges at most: their bounds are drawn on the driver, DRAWN strings for each.
RANGES, DRAWN = 1 << 14, 8

_VALUE = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64)
_B = 0x9E3779B97F4A7C15
_INVERSE = pow(_B, -1, 1 << 64)
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables[0]) < n:
        for i, base in enumerate((_B, _INVERSE)):
            t = np.full(n + (n >> 2), base, np.uint64)
            t[0] = 1
            _tables[i] = np.multiply.accumulate(t)
    return _tables[0], _tables[1]


def _segments(offs: np.ndarray) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Lists of (text, from, to, own from, own to), byte places in the text, of about SEGMENT bytes in all."""
    out, total = [], 0
    for t, size in enumerate(np.diff(offs).tolist()):
        if size < WIDTH:
            continue
        for a in range(0, size, SEGMENT):
            b = min(size, a + SEGMENT)
            out.append((t, max(0, a - MARGIN), min(size, b + MARGIN), a, b))
            total += b - a
            if total >= SEGMENT:
                yield out
                out, total = [], 0
    if out:
        yield out


def anchors(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, anchor hash, context hash) of the anchors of texts of at least WIDTH bytes."""
    for segs in _segments(offs):
        text, lo, hi, own_lo, own_hi = np.array(segs).T
        size = hi - lo
        end = np.cumsum(size + WIDTH)
        begin = end - size - WIDTH
        raw = np.zeros(int(end[-1]) + WIDTH, np.uint8)
        for s, (t, a, b, _, _) in zip(begin.tolist(), segs, strict=True):
            raw[s : s + b - a] = data[offs[t] + a : offs[t] + b]
        n = len(raw)
        power, inverse = _powers(n)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[raw] * power[:n], out=prefix[1:])
        m = n - WIDTH
        gram = mix64((prefix[GRAM : GRAM + m + WINNOW] - prefix[: m + WINNOW]) * inverse[: m + WINNOW]) | np.uint64(1)
        low = gram
        for s in (1, 2, 4, 8):
            low = np.minimum(low[:-s], low[s:])
        low = np.minimum(low[: -(WINNOW - 16)], low[WINNOW - 16 :])[:m]  # of the grams of the string from here
        starts = np.zeros(m + 1, np.int8)
        np.add.at(starts, begin, 1)
        np.add.at(starts, begin + size - WIDTH + 1, -1)
        low = np.concatenate([np.zeros(WINNOW - 1, np.uint64), np.where(np.cumsum(starts[:m]) > 0, low, 0), np.zeros(WINNOW - 1, np.uint64)])
        top = low
        for s in (1, 2, 4, 8):
            top = np.maximum(top[:-s], top[s:])
        top = np.maximum(top[: -(WINNOW - 16)], top[WINNOW - 16 :])[: m + WINNOW - 1]
        at = np.flatnonzero(gram[: len(top)] == top)
        seg = np.searchsorted(begin, at, "right") - 1
        place = at - begin[seg] + lo[seg]
        ok = (place >= own_lo[seg]) & (place < own_hi[seg])
        at, seg, place = at[ok], seg[ok], place[ok]
        a, b = np.maximum(begin[seg], at - SIDE), np.minimum(begin[seg] + size[seg], at + WIDTH)
        context = mix64((prefix[b] - prefix[a]) * inverse[a] + ((at - a) * 128 + (b - a)).astype(np.uint64))
        yield text[seg], place, gram[at], context


_ANCHOR = np.dtype([("id", "<i8"), ("at", "<i4"), ("h", "<u8"), ("c", "<u8")])
_PLACE = np.dtype([("id", "<i8"), ("at", "<i4"), ("key", "<u8"), ("hot", "?")])
#: Kinds of rows in the exchange: anchors of a part, spans and places of a bucket of documents; n counts the records.
ANCHORS, SPANS, PLACES = 0, 1, 2
_FOUND = "kind int, bucket int, n long, blob binary"


def _records(kind: np.dtype, **columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(columns["id"]), kind)
    for name, values in columns.items():
        out[name] = values
    return out


def _spread(h: np.ndarray, n: int) -> np.ndarray:
    """A number under n for each hash. Anchors are the smallest of many hashes, so they are mixed anew first."""
    return (((mix64(h ^ np.uint64(0x51ED270B)) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _tagged(kind: int, records: np.ndarray, to: np.ndarray | None = None, *, buckets: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows of _FOUND: records by bucket of their documents, or by ``to``."""
    if not len(records):
        return
    to = np.mod(records["id"], buckets) if to is None else to
    order = np.argsort(to, kind="stable")
    records, to = records[order], to[order]
    at = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
    blobs = [records[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    n = len(blobs)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(to[at[:-1]].astype(np.int32)), pa.array(np.diff(at).astype(np.int64)), pa.array(blobs, pa.binary())], ["kind", "bucket", "n", "blob"])


def _anchors_of(ids: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    found = list(anchors(data, offs))
    if not found:
        return np.zeros(0, _ANCHOR)
    text, place, h, c = (np.concatenate(x) for x in zip(*found, strict=True))
    return _records(_ANCHOR, id=ids[text], at=place, h=h, c=c)


def _frequent(texts: DataFrame, total: int, most: int) -> np.ndarray:
    """Anchors with very many contexts, as far as a sample of the texts by id shows; it grows with the texts."""
    step = max(1, min(total // SAMPLE, PART_ANCHORS // (2 * SEEN)))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for i, j, data, offs in pieces(batch.column("text"), PACK):
                r = _anchors_of(ids[i:j], data, offs)
                r = r[np.unique(mix64(r["h"]) ^ r["c"], return_index=True)[1]]
                h, n = np.unique(r["h"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    counts = texts.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).mapInArrow(part, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") >= max(SEEN, most // step)).orderBy(F.desc("n"), "h").limit(NAMED)
    return np.sort(np.array([r.h for r in often.collect()], np.int64).view(np.uint64))


def _exchange(texts: DataFrame, parts: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Map side: anchors of about PACK bytes of text at a time, packed by part; a context that these have in several documents is
    sent for the smallest one, and the others' are spans already."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)  # at most NAMED hashes

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for i, j, data, offs in pieces(batch.column("text"), PACK):
                r = _anchors_of(ids[i:j], data, offs)
                key = r["h"] ^ mix64(r["c"])
                order = np.lexsort((r["id"], key))
                k, d = key[order], r["id"][order]
                first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
                over = order[d > np.repeat(d[first], np.diff(np.append(first, len(k))))]
                x = r[over]
                yield from _tagged(SPANS, union_of(x["id"], np.maximum(x["at"] - SIDE, 0), x["at"] + WIDTH), buckets=buckets)
                keep = np.ones(len(r), bool)
                keep[over] = False
                r, key = r[keep], key[keep]
                yield from _tagged(ANCHORS, r, _spread(np.where(_among(r["h"], shared.value), key, r["h"]), parts))

    return texts.mapInArrow(part, _FOUND)


def _among(values: np.ndarray, members: np.ndarray) -> np.ndarray:
    at = np.searchsorted(members, values)
    return np.append(members, 0)[at] == values if len(members) else np.zeros(len(values), bool)


def _shared(rows: DataFrame, buckets: int, hot: np.ndarray, most: int) -> DataFrame:
    """Reduce side: spans of contexts that a smaller document has, and places of the distinct contexts of anchors that several
    documents share, by bucket of documents; of more than ``most`` contexts, as those of a frequent anchor."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def settle(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        r = np.frombuffer(b"".join(blobs), _ANCHOR)
        r = r[np.lexsort((r["at"], r["id"], r["c"], r["h"]))]
        n, h, c, doc = len(r), r["h"], r["c"], r["id"]
        new_h = np.append(True, h[1:] != h[:-1])
        new_c = new_h | np.append(True, c[1:] != c[:-1])
        at_c, at_h = np.flatnonzero(new_c), np.flatnonzero(new_h)
        least = np.repeat(doc[at_c], np.diff(np.append(at_c, n)))
        over = doc > least
        x = r[over]
        yield from _tagged(SPANS, union_of(x["id"], np.maximum(x["at"] - SIDE, 0), x["at"] + WIDTH), buckets=buckets)
        spread = _among(h[at_h], shared.value)  # the other contexts of these are in other parts
        several = spread | (np.minimum.reduceat(least, at_h) < np.maximum.reduceat(least, at_h))
        often = spread | (np.add.reduceat(new_c.astype(np.int64), at_h) > most)
        size = np.diff(np.append(at_h, n))
        need = np.repeat(several, size) & ~over & ~np.append(False, ~new_c[1:] & (doc[1:] == doc[:-1]) & (r["at"][1:] == r["at"][:-1]))
        x = r[need]
        yield from _tagged(PLACES, _records(_PLACE, id=x["id"], at=x["at"], key=x["h"], hot=np.repeat(often, size)[need]), buckets=buckets)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            is_anchor = pc.equal(batch.column("kind"), ANCHORS)
            if len(rest := batch.filter(pc.invert(is_anchor))):
                yield rest
            for k, blobs in by_bucket(iter([batch.filter(is_anchor)])):
                if held and k != key:
                    yield from settle(held)
                    held = []
                key = k
                held += blobs
        if held:
            yield from settle(held)

    return rows.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(part, _FOUND)


_CONTEXT = np.dtype([("id", "<i8"), ("at", "<i4"), ("size", "u1")])


def _contexts(texts: DataFrame, places: DataFrame, buckets: int, shards: int) -> DataFrame:
    """(hot, shard, n, blob): the text around each place, packed by shard: of an anchor, or of any place for frequent anchors."""

    def packed_by_shard(held: list) -> pa.RecordBatch:
        x = np.concatenate([h[0] for h in held])
        contexts = [c for h in held for c in h[1]]
        info = _records(_CONTEXT, id=x["id"], at=np.maximum(x["at"] - SIDE, 0), size=np.array([len(c) for c in contexts]))
        to = _spread(np.where(x["hot"], x["id"].view(np.uint64) * np.uint64(1 << 20) + x["at"].astype(np.uint64), x["key"]), shards) * 2 + x["hot"]
        order = np.argsort(to, kind="stable")
        at = np.append(np.flatnonzero(np.append(True, np.diff(to[order]) != 0)), len(to))
        blobs = [len(own).to_bytes(4, "little") + info[own].tobytes() + b"".join([contexts[i] for i in own.tolist()]) for own in (order[a:b] for a, b in zip(at[:-1], at[1:], strict=True))]
        to = to[order[at[:-1]]]
        return pa.RecordBatch.from_arrays([pa.array(to % 2 == 1), pa.array((to // 2).astype(np.int32)), pa.array(np.diff(at)), pa.array(blobs, pa.binary())], ["hot", "shard", "n", "blob"])

    def cut(rows: pa.RecordBatch, of) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for i, text in zip(rows.column("id").to_pylist(), rows.column("text"), strict=True):
            x = of(i)
            if not len(x):
                continue
            raw = text.as_py().encode()
            contexts = [raw[max(0, p - SIDE) : p + WIDTH] for p in x["at"].tolist()]
            if ok := [len(c) >= WIDTH for c in contexts]:
                held.append((x[np.array(ok)], [c for c in contexts if len(c) >= WIDTH]))
                size += len(x) * (WIDTH + SIDE)
            if size >= FLUSH:
                yield packed_by_shard(held)
                held, size = [], 0
        if held and any(len(h[0]) for h in held):
            yield packed_by_shard(held)

    return meet(texts, places, buckets, _PLACE, cut, "hot boolean, shard int, n long, blob binary")


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(records of _CONTEXT, bytes of all contexts)."""
    info, raw = [], []
    for blob in blobs:
        n = int.from_bytes(blob[:4], "little")
        info.append(np.frombuffer(blob, _CONTEXT, n, 4))
        raw.append(blob[4 + info[-1].nbytes :])
    return np.concatenate(info), np.frombuffer(b"".join(raw), np.uint8)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by Larsson-Sadakane refinement: ranks by 8 bytes, then of 16, 32, ... from the ranks
    before, sorting only groups that are still tied."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    first = np.zeros(n, np.uint64)
    for j in range(8):
        first = (first << np.uint64(8)) | padded[j : j + n]
    sa = np.argsort(first, kind="stable")
    f = first[sa]
    new = np.append(True, f[1:] != f[:-1])
    at = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.repeat(at, np.diff(np.append(at, n)))  # a group has the place of its first suffix
    h = 8
    while h < n:
        size = np.diff(np.append(at, n))
        tied = np.repeat(size > 1, size)
        where = np.flatnonzero(tied)
        if not len(where):
            break
        s = sa[where]
        key = rank[s] * (n + 1) + rank[np.minimum(s + h, n)] + 1
        order = np.argsort(key, kind="stable")
        sa[where] = s[order]  # groups keep their places: rank is the major part of the key
        k = key[order]
        new[where] = np.append(True, k[1:] != k[:-1])
        at = np.flatnonzero(new)
        rank[sa] = np.repeat(at, np.diff(np.append(at, n)))
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int, stride: int = 8) -> np.ndarray:
    """Common prefix, up to ``cap``, of each suffix in the array with the one before it.

    Kasai's rule: the prefix of the suffix from i is at least that from i - 1, less one. Every
    ``stride``-th place starts from nothing, and the next ones from what the place before them found."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    lcp = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(cap + 1, np.uint8)])
    for j in range(stride):
        i = np.arange(j, n, stride)
        if j:
            lcp[i] = np.maximum(lcp[i - 1] - 1, 0)
        i = i[before[i] >= 0]
        while len(i):
            k = lcp[i]
            ok = (k < cap) & (np.maximum(i, before[i]) + k < n)
            i, k = i[ok], k[ok]
            i = i[padded[i + k] == padded[before[i] + k]]
            lcp[i] += 1
        lcp[before < 0] = 0
    return lcp[sa]


def strings(text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The WIDTH-byte strings inside the contexts that ``text`` joins, in order: (context, place in it, place in text, group);
    equal strings are a group, numbered from 0."""
    end = np.cumsum(size)
    sa = suffix_array(text)
    of = np.searchsorted(end, sa, "right")
    whole = sa + WIDTH <= end[of]
    new = common_prefixes(text, sa, WIDTH) < WIDTH
    new[0] = True
    sa, of, group = sa[whole], of[whole], np.cumsum(new)[whole]
    group = np.cumsum(np.append(False, group[1:] != group[:-1]))
    return of, sa - (end - size)[of], sa, group


def _least(own: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The smallest id of each one's group."""
    at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    return np.repeat(np.minimum.reduceat(own, at), np.diff(np.append(at, len(own)))) if len(own) else own


def _in_shards(contexts: DataFrame, buckets: int) -> DataFrame:
    """PACKED spans from the suffix arrays of shards that hold whole anchors."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in by_bucket(batches, "shard"):
            info, text = _unpacked(blobs)
            of, at, _, group = strings(text, info["size"].astype(np.int64))
            own, start = info["id"][of], info["at"][of] + at
            hit = _least(own, group) < own
            if (out := packed(union_of(own[hit], start[hit], start[hit] + WIDTH), buckets)) is not None:
                yield out

    return contexts.select("shard", "blob").repartition("shard").sortWithinPartitions("shard").mapInArrow(part, PACKED)


_STRING = np.dtype([("s", f"S{WIDTH}"), ("id", "<i8"), ("at", "<i4")])


def _bounds(contexts: DataFrame, n: int) -> np.ndarray:
    """Strings that cut all strings of n contexts into ranges of about RANGE bytes, from a drawn sample: at most RANGES of them."""
    ranges = min(RANGES, int(n * (SIDE + 1) * _STRING.itemsize / RANGE) + 1)
    step = max(1, n // (ranges * DRAWN))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                info, text = _unpacked([blob])
                begin = np.cumsum(info["size"].astype(np.int64)) - info["size"]
                draw = mix64(info["id"].view(np.uint64) * np.uint64(_B) + info["at"].astype(np.uint64))
                some = np.flatnonzero(draw % np.uint64(step) == 0)
                at = begin[some] + ((draw[some] >> np.uint64(32)) % (info["size"][some] - np.uint64(WIDTH - 1))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([text[a : a + WIDTH].tobytes() for a in at.tolist()], pa.binary())], ["s"])

    drawn = sorted(bytes(r.s) for r in contexts.select("blob").mapInArrow(part, "s binary").collect())
    return np.array(drawn[DRAWN::DRAWN], f"S{WIDTH}")


def _over_shards(contexts: DataFrame, n: int, buckets: int) -> DataFrame:
    """PACKED spans of strings that can stand in several shards. A shard settles what it has more than once; the strings of its
    smallest documents are cut at the bounds of ranges by binary search in the order of the suffix array, and settled there."""
    bounds = _bounds(contexts, n)
    shared = contexts.sparkSession.sparkContext.broadcast(bounds)  # at most RANGES strings

    def spans(own: np.ndarray, start: np.ndarray, hit: np.ndarray) -> pa.RecordBatch | None:
        return packed(union_of(own[hit], start[hit], start[hit] + WIDTH), buckets)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in by_bucket(batches, "shard"):
            info, text = _unpacked(blobs)
            of, at, place, group = strings(text, info["size"].astype(np.int64))
            own, start = info["id"][of], info["at"][of] + at
            first = _least(own, group) == own
            if (out := spans(own, start, ~first)) is not None:
                yield _with_range(out, np.full(len(out), -1))
            if not first.any():
                continue
            s = np.ascontiguousarray(text[place[first, None] + np.arange(WIDTH)]).view(f"S{WIDTH}").ravel()
            rows = _records(_STRING, s=s, id=own[first], at=start[first])
            cut = np.concatenate([[0], np.searchsorted(s, shared.value), [len(s)]])
            some = np.flatnonzero(np.diff(cut))
            blobs_ = pa.array([rows[cut[i] : cut[i + 1]].tobytes() for i in some.tolist()], pa.binary())
            yield _with_range(pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int32()), blobs_], ["bucket", "blob"]), some)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in by_bucket(batches, "range"):
            rows = np.frombuffer(b"".join(blobs), _STRING)
            rows = rows[np.argsort(rows["s"], kind="stable")]  # runs that are in order already
            group = np.cumsum(np.append(False, rows["s"][1:] != rows["s"][:-1]))
            if (out := spans(rows["id"], rows["at"].astype(np.int64), _least(rows["id"], group) < rows["id"])) is not None:
                yield out

    found = stored(contexts.select("shard", "blob").repartition("shard").sortWithinPartitions("shard").mapInArrow(part, f"{PACKED}, range int"))
    apart = found.where("range >= 0").select("range", "blob").repartition("range").sortWithinPartitions("range").mapInArrow(merge, PACKED)
    return found.where("range < 0").select("bucket", "blob").unionByName(apart)


def _with_range(batch: pa.RecordBatch, ranges: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranges.astype(np.int32))], ["bucket", "blob", "range"])


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = HOT) -> DataFrame:
    """Texts without the bytes that repeat from documents with smaller ids in strings of WIDTH bytes or more.

    Anchors with more than ``most`` contexts are dealt over shards and merged; the result is the same for any number.

    Rows (id_col, n_bytes, n_removed, n_spans, kept), one for each input row; ``kept`` holds the remaining bytes,
    which need not be valid UTF-8. Ids are integers; rows with a null id are kept whole. Null texts are empty; texts
    shorter than WIDTH match nothing. Strings that repeat inside one document stay. Rows with equal ids count as one
    document and lose the same byte places. Other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = docs.where(f"id is not null and octet_length(text) >= {WIDTH}")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, buckets = int(total * 2 / (WINNOW + 1) / PART_ANCHORS) + 1, buckets_for(total)
    hot = _frequent(texts, total, most)
    found = stored(_shared(_exchange(texts, parts, buckets, hot), buckets, hot, most))
    n = found.where(F.col("kind") == PLACES).agg(F.sum("n")).first()[0] or 0
    contexts = stored(_contexts(texts, found.where(F.col("kind") == PLACES).select("bucket", "blob"), buckets, n * (WIDTH + SIDE) // SHARD + 1))
    spans = found.where(F.col("kind") == SPANS).select("bucket", "blob").unionByName(_in_shards(contexts.where("not hot"), buckets))
    if n_hot := contexts.where("hot").agg(F.sum("n")).first()[0]:
        spans = spans.unionByName(_over_shards(contexts.where("hot"), n_hot, buckets))
    return cut_out(docs, stored(spans), buckets).withColumnRenamed("id", id_col)
