"""MinHash near-duplicates: one-permutation hashing, banded buckets, star-shaped candidate edges.

1. Each text becomes the set of its distinct word shingles. One hash of each shingle both picks a
   bin and orders the shingles in it; the smallest of each bin is kept, and an empty bin takes the
   value of the first filled bin in its own fixed random order (optimal densification,
   Shrivastava 2017). Texts with equal sets collapse to a class, known by the digest of its set.
2. Runs of ``rows`` bins make a band; texts with an equal band share a bucket. A bucket gives one
   star of edges, from a hub to every other member, not all pairs. Edges are screened by the share
   of equal bins, then confirmed on the full sets.
3. Confirmed links make components. In a bucket that still holds several components, a star from
   the most linked member of its largest component follows; whatever is then still apart is
   compared, in blocks of bounded size, with the rest of its bucket. So no linked pair that shares a bucket is
   lost for components, while the pairs made stay near linear in the size of a group of copies.

A pair right at the bound t shares no bucket with probability (1 - t**rows)**bands; ``rows`` is the
largest number that keeps this under MISS (8 at 0.85, 6 at 0.8).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldproof.llm.kit import SPACE, Words, components, mix64, pieces, spread_join, stored, union_all

BINS = 256
#: Chance that a pair right at the similarity bound shares no bucket.
MISS = 1e-4
#: Rows of a bucket that one task compares with as many others.
BLOCK = 512

_ORDER = np.argsort(np.random.default_rng(5).random((BINS, BINS)), axis=1).astype(np.int16)
_EDGES = np.arange(BINS)


def shingle_set(words: Words, grams: np.ndarray, i: int, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of text i of a piece; a text of fewer words is one shingle."""
    a, b = int(words.of[i]), int(words.of[i + 1])
    if b - a >= k:
        return np.unique(grams[a : b - k + 1])
    if b == a:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.uint64(b - a)
        for x in words.hash[a:b]:
            h = mix64(np.array([h * np.uint64(0x9E3779B97F4A7C15) + x], np.uint64))[0]
    return np.array([h], np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The value of each bin, from a sorted non-empty set."""
    bins = (((shingles >> np.uint64(40)) * np.uint64(BINS)) >> np.uint64(24)).astype(np.int64)
    at = np.searchsorted(bins, _EDGES)
    at[at == len(bins)] = 0
    filled = bins[at] == _EDGES
    if not filled.all():
        empty = np.flatnonzero(~filled)
        hit = filled[_ORDER[empty]]
        at[empty] = at[_ORDER[empty, hit.argmax(axis=1)]]
    return shingles[at]


def band_rows(least: float) -> int:
    return next((r for r in range(16, 1, -1) if (1 - least**r) ** (BINS // r) <= MISS), 1)


def _signed(texts: DataFrame, k: int, rows: int) -> DataFrame:
    n_bands = BINS // rows

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sig, bands = np.zeros(len(batch), np.int64), [], [], []
            for i, j, data, offs in pieces(batch.column("text")):
                words = Words(data, offs, SPACE)
                grams = words.grams(k)
                for t in range(j - i):
                    s = shingle_set(words, grams, t, k)
                    n[i + t] = len(s)
                    if not len(s):
                        digest.append(None)
                        sig.append(None)
                        bands.append(None)
                        continue
                    v = mix64(signature(s))
                    digest.append(_digest(s))
                    sig.append((v & np.uint64(255)).astype(np.uint8).tobytes())
                    b = np.arange(n_bands, dtype=np.uint64)
                    for r in range(rows):
                        b = mix64(b * np.uint64(0x9E3779B97F4A7C15) + v[r : n_bands * rows : rows])
                    bands.append(b.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "n", "digest", "sig", "bands"])

    return texts.mapInArrow(part, "id long, n long, digest binary, sig binary, bands array<long>")


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """(digest, s): the sets of rows (text) with their digests."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, out = [], []
            for i, j, data, offs in pieces(batch.column("text")):
                words = Words(data, offs, SPACE)
                grams = words.grams(k)
                for t in range(j - i):
                    x = shingle_set(words, grams, t, k)
                    digest.append(_digest(x))
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(out, pa.binary())], ["digest", "s"])

    return rows.mapInArrow(part, "digest binary, s binary")


def _sets_of(reps: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(rep, s): the full sets of some classes (rep, id, digest), written once.

    The texts of a class's id are read again; an id may have other texts too, so a set is known by its digest, never by the id."""
    reps = reps.distinct()
    rows = texts.join(reps.select("id").distinct().hint("shuffle_hash"), "id", "left_semi").select("text")
    return stored(_sets(rows, k).dropDuplicates(["digest"]).join(reps.select("rep", "digest").hint("merge"), "digest").select("rep", "s"))


def _screened(edges: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) whose signatures agree in a share of ``least`` of the bins."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("sa", "sb"))
                yield batch.filter(pa.array((x == y).mean(axis=1) >= least)).select(["a", "b"])

    named = lambda x: sigs.select(F.col("rep").alias(x), F.col("sig").alias(f"s{x}")).hint("merge")
    return edges.join(named("b"), "b").join(named("a"), "a").select("a", "b", "sa", "sb").mapInArrow(part, "a long, b long")


def _confirmed(edges: DataFrame, reps: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) with den * intersection >= num * union of the full sets."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    some = edges.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = _sets_of(reps.select("rep", "id", "digest").join(some.hint("shuffle_hash"), "rep", "left_semi"), texts, k)
    named = lambda x: sets.select(F.col("rep").alias(x), F.col("s").alias(f"x{x}")).hint("merge")
    return edges.join(named("b"), "b").join(named("a"), "a").select("a", "b", "xa", "xb").mapInArrow(part, "a long, b long")


def _block_links(members: DataFrame, reps: DataFrame, texts: DataFrame, k: int, num: int, den: int, least: float) -> DataFrame:
    """Confirmed links (a, b) between members of a bucket in different components.

    members(bucket, rep, comp, major): every member outside the bucket's largest component is compared with all members, in
    blocks of about BLOCK by BLOCK rows: screened by signatures, then confirmed on full sets, likeliest first, until the two
    components are linked. Only links leave a task, never the pairs it looked at."""
    size = members.groupBy("bucket").agg(F.count("*").alias("m"), F.sum((F.col("comp") != F.col("major")).cast("int")).alias("minor"))
    sigs, some = reps.select("rep", "sig"), members.select("rep").distinct()
    sets = _sets_of(reps.select("rep", "id", "digest").join(some.hint("shuffle_hash"), "rep", "left_semi"), texts, k)
    rows = spread_join(members, size, "bucket", "rep").join(sigs.join(sets.hint("merge"), "rep").hint("merge"), "rep")
    blocks, minors = F.ceil(F.col("m") / BLOCK).cast("int"), F.ceil(F.col("minor") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    mine_minor = F.pmod(F.xxhash64("rep", F.lit(1)), minors).cast("int")
    left = rows.where("comp <> major").select("bucket", mine_minor.alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"), F.lit(True).alias("left"), "rep", "comp", "sig", "s")
    right = rows.select("bucket", F.explode(F.sequence(F.lit(0), minors - 1)).alias("i"), mine.alias("j"), F.lit(False).alias("left"), "rep", "comp", "sig", "s")

    def compare(group: list) -> tuple[list, list]:
        rep, comp, sig, left = (np.concatenate(x) for x in list(zip(*group, strict=True))[:4])
        sets = [np.frombuffer(x, np.uint64) for g in group for x in g[4]]
        li, ri = np.flatnonzero(left), np.flatnonzero(~left)
        a, b, joined = [], [], {}

        def top(c: int) -> int:
            while joined.get(c, c) != c:
                c = joined[c]
            return c

        for x in li:
            near = (sig[ri] == sig[x]).mean(axis=1)
            for o in np.argsort(-near, kind="stable"):
                if near[o] < least:
                    break
                y = ri[o]
                if (p := top(comp[x])) == (q := top(comp[y])):
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if den * both >= num * (len(sets[x]) + len(sets[y]) - both):
                    joined[max(p, q)] = min(p, q)
                    a.append(min(rep[x], rep[y]))
                    b.append(max(rep[x], rep[y]))
        return a, b

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            if not len(batch):
                continue
            ks = list(zip(*(batch.column(c).to_numpy() for c in ("bucket", "i", "j")), strict=True))
            rep, comp, left = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "comp", "left"))
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(len(batch), -1)
            full = batch.column("s").to_pylist()
            cut = [0, *(x for x in range(1, len(ks)) if ks[x] != ks[x - 1]), len(ks)]
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if held and ks[s] != key:
                    a, b = compare(held)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                    held = []
                key = ks[s]
                held.append((rep[s:e], comp[s:e], sig[s:e], left[s:e], full[s:e]))
        if held:
            a, b = compare(held)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return left.unionByName(right).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(part, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, star_rounds: int = 2) -> DataFrame:
    """Groups of near-duplicate texts: rows (id_col, n_shingles, component_id, kept), one for each input row.

    Texts are linked where den * intersection >= num * union of their sets of ``k``-word shingles.
    ``component_id`` is the smallest id reachable by links, itself included; ``kept`` marks the row
    with that id. Ids are integers. Texts with fewer than ``k`` words are one shingle; null, empty
    and wordless texts have no shingle and link with nothing. Rows with equal ids and different
    texts have the components of their own texts; such an id can be the smallest of several components. Other columns are ignored. An
    empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(_signed(texts, k, band_rows(num / den)))
    # a class gets a number of its own, fixed by the write: its smallest id may be that of other classes too
    reps = stored(signed.where("n > 0").groupBy("digest").agg(F.first(F.struct("sig", "bands")).alias("v"), F.min("id").alias("id")).select("digest", "id", "v.sig", "v.bands", F.monotonically_increasing_id().alias("rep")))
    sigs = reps.select("rep", "sig")
    rows = reps.select("rep", F.posexplode("bands").alias("band", "h")).select(F.xxhash64("band", "h").alias("bucket"), "rep")
    hubs = rows.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).where("m > 1")
    members = stored(rows.join(hubs.hint("merge"), "bucket").select("bucket", "rep", "hub", "m"))
    least = num / den - 6 * (num / den * (1 - num / den) / BINS) ** 0.5  # a true link falls below once in 1e9
    edges = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = [stored(_confirmed(stored(_screened(edges, sigs, least)), reps, texts, k, num, den))]
    for n in range(star_rounds):
        comp = components(union_all(links))
        # buckets with two members are settled; of buckets with equal members one is enough
        where = members.where("m > 2").join(comp.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").select("bucket", "rep", "m", F.coalesce("component", "rep").alias("comp"))
        open_ = where.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("x"), F.first("m").alias("m")).where("lo <> hi").groupBy("m", "x", "lo").agg(F.min("bucket").alias("bucket")).select("bucket")
        left = stored(spread_join(where, open_, "bucket", "rep").select("bucket", "rep", "comp"))
        # the next hub of a bucket is the member of its largest component that has been linked most often, so most central
        degree = union_all(links).select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("degree"))
        left = left.join(degree.hint("merge"), "rep", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        major = left.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.max_by("rep", F.struct("degree", F.xxhash64("rep", F.lit(n)))).alias("hub")).groupBy("bucket").agg(F.max_by(F.struct("comp", "hub"), F.struct("c", "comp")).alias("v")).select("bucket", F.col("v.comp").alias("major"), F.col("v.hub").alias("hub"))
        left = spread_join(left, major, "bucket", "rep")
        if n < star_rounds - 1:
            edges = left.where("comp <> major").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
            links.append(stored(_confirmed(stored(_screened(edges, sigs, least)), reps, texts, k, num, den)))
        else:
            links.append(stored(_block_links(stored(left), reps, texts, k, num, den, least)))
    comp = components(union_all(links))
    known = stored(comp.withColumnRenamed("id", "rep").join(reps.select("rep", "id").hint("merge"), "rep"))
    smallest = known.groupBy("component").agg(F.min("id").alias("component_id"))
    linked = spread_join(known, smallest, "component", "rep").select("rep", "component_id")
    classes = reps.select("digest", "rep", "id").join(linked.hint("merge"), "rep", "left").select("digest", F.coalesce("component_id", "id").alias("component_id"))
    out = signed.select("id", "n", "digest").join(classes.hint("merge"), "digest", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
