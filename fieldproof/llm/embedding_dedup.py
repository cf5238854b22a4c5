"""Embedding near-duplicates by sorted projection passes.

In each pass the vectors are put in lexicographic order of the concatenated signs of their random
projections, and each is compared with those in a bounded window of the order. A pair with a high
cosine shares the leading signs, and so a window, in some pass with high probability. Pairs
are verified by their cosine in double precision and united across passes.

How many signs the rows at the ends of a window share tells how likely a pair is to miss it. These
chances are multiplied over the passes for each vector, and vectors with a chance over ``MISS`` (many,
or in a dense topic) are ordered again among themselves by new planes, until none is left.

Equal vectors collapse to a class first. A window that is full of links says that a group is larger
than the window: links inside the components that were found are then counted exactly, in blocks
of bounded size, so the window is no cap on partners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldproof.llm.kit import components, discard, stored

#: Passes of a round at least, rows of a window, signs of a key.
PASSES, WINDOW, SIGNS = 24, 256, 63
#: Accepted chance that a pair right at the bound shares no window.
MISS = 1e-4
#: Classes of a component that a group compares with as many others; parts that a large component is dealt in.
BLOCK, SALTS = 1024, 64


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def _unit(rows: DataFrame) -> DataFrame:
    """(id, v, key): unit vectors, null where a vector takes no part; key tells equal directions apart from others."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("v").to_pylist():
                x = np.array([np.nan if c is None else c for c in v], np.float64) if v else np.zeros(0)
                n = np.linalg.norm(x) if np.isfinite(x).all() else 0.0
                if not np.isfinite(n):  # very large components
                    x = x / np.abs(x).max()
                    n = np.linalg.norm(x)
                out.append(x / n if n > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.float64()))], ["id", "v"])

    return rows.mapInArrow(part, "id long, v array<double>")


def _ordered(classes: DataFrame, passes: int, start: int = 0) -> DataFrame:
    """(pass, key, rep, v): the sign key of every vector in every pass from ``start`` on."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = 1 << np.arange(SIGNS, dtype=np.int64)[::-1]
        for batch in batches:
            for i in range(0, len(batch), 1024):
                b = batch.slice(i, 1024)
                sizes = b.column("v").value_lengths().to_numpy()
                for dim in np.unique(sizes):
                    own = b.filter(pa.array(sizes == dim))
                    x = _matrix(own.column("v"))
                    for p in range(start, start + passes):
                        if (p, dim) not in planes:
                            planes[p, dim] = np.random.default_rng([p, dim]).standard_normal((dim, SIGNS))
                        key = ((x @ planes[p, dim]) > 0) @ weight
                        n = len(own)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p * 100_000 + dim, np.int64)), pa.array(key), own.column("rep"), own.column("v")], ["pass", "key", "rep", "v"])

    return classes.select("rep", "v").mapInArrow(part, "pass long, key long, rep long, v array<double>")


def _windows(rows: DataFrame, window: int, least: float) -> DataFrame:
    """Verified pairs (a, b) within the windows of each sorted partition, those that join two groups of its pass:
    the others add nothing to components. Where partitions meet, the last and first ``window`` rows are returned
    with side and border to be compared too. credit (of a) is the logarithm of the chance that a pair at the bound misses
    the window of the pass; a row that is linked with half of its window has its group already."""
    keeps = 1 - np.arccos(least) / np.pi  # chance of a sign to be the same
    schema = ["a", "b", "border", "pass", "v", "credit"]

    def row(a, b, border, p, v, credit=None) -> pa.RecordBatch:
        n = len(a)
        full = lambda x: pa.array(np.full(n, x, np.int64)) if x is not None else pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b) if b is not None else full(-1), full(border), full(p), pa.array(v, pa.list_(pa.float64())) if v is not None else pa.nulls(n, pa.list_(pa.float64())), pa.array(credit) if credit is not None else pa.nulls(n, pa.float64())], schema)

    def chance(k: np.ndarray, end: np.ndarray) -> np.ndarray:
        shared = SIGNS - np.frexp((k ^ end).astype(np.float64))[1]
        return np.log1p(-np.minimum(keeps ** (shared + 1.0), 0.999))

    def credits(rows: tuple, n: int) -> pa.RecordBatch:
        """Of the first n rows: the worse of the window behind and the window ahead."""
        _, reps, _, keys, behind = rows
        ahead = chance(keys[:n], keys[np.minimum(np.arange(n) + window, len(keys) - 1)])
        return row(reps[:n], None, -1, None, None, np.where(np.isnan(behind[:n]), -np.inf, np.maximum(behind[:n], ahead)))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me = TaskContext.get().partitionId()
        last = None  # (pass, reps, vectors, keys, chances behind) of the rows before
        opening: list = []
        parent: dict[int, int] = {}  # groups of this partition in the current pass

        def top(r: int) -> int:
            while (p := parent.get(r, r)) != r:
                parent[r] = parent.get(p, p)
                r = p
            return r

        for batch in batches:
            ps, reps, keys = (batch.column(c).to_numpy() for c in ("pass", "rep", "key"))
            edge = [0, *(np.flatnonzero(ps[1:] != ps[:-1]) + 1).tolist(), len(ps)] if len(ps) else [0]
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                for i in range(s, e, window):
                    j = min(e, i + window)
                    x, r = _matrix(batch.column("v").slice(i, j - i)), reps[i:j]
                    y, q = (np.concatenate([last[2], x]), np.concatenate([last[1], r])) if last and last[0] == ps[i] else (x, r)
                    kq = np.concatenate([last[3], keys[i:j]]) if last and last[0] == ps[i] else keys[i:j]
                    if len(opening) == 0 or (opening[0][0] == ps[i] and sum(len(o[1]) for o in opening) < window):
                        opening.append((ps[i], r, x))
                    if not last or last[0] != ps[i]:
                        parent.clear()
                    before = len(q) - len(r)
                    near = x @ y.T >= least
                    a, b = np.nonzero(near)
                    ok = (b < before + a) & (before + a - b <= window)
                    at = before + np.arange(len(r))
                    behind = chance(kq[at], kq[np.maximum(at - window, 0)])
                    behind[np.bincount(a[ok], minlength=len(r)) * 2 >= window] = np.nan
                    if last and last[0] != ps[i]:
                        yield credits(last, len(last[1]))
                    rows_ = (ps[i], q, y, kq, np.concatenate([last[4], behind]) if before else behind)
                    if len(q) > window:  # the rows whose window ahead is full now
                        yield credits(rows_, len(q) - window)
                    joins = []
                    for u, v in zip(r[a[ok]].tolist(), q[b[ok]].tolist(), strict=True):
                        if (g := top(u)) != (h := top(v)):
                            parent[max(g, h)] = min(g, h)
                            joins.append((u, v))
                    a, b = np.array(joins, np.int64).reshape(-1, 2).T
                    if len(a):
                        yield row(np.minimum(a, b), np.maximum(a, b), -1, None, None)
                    last = (ps[i], *(x[-window:] for x in rows_[1:]))
        if last:
            yield credits(last, len(last[1]))
        for border, side, p, r, x in ([(me, 1, *last[:3])] if last else []) + [(me - 1, 0, p, r, x) for p, r, x in opening]:
            n = min(len(r), window)
            r, x = (r[-n:], x[-n:]) if side else (r[:n], x[:n])
            yield row(r, np.full(n, side, np.int64), border, p, list(x))

    return rows.mapInArrow(part, "a long, b long, border long, pass long, v array<double>, credit double")


def _across(borders: DataFrame, least: float) -> DataFrame:
    """Pairs that join what is linked over a border between two partitions: at most two windows of rows in a group."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(t: pa.Table) -> pa.RecordBatch:
            side = t.column("b").to_numpy()
            left, right = t.filter(pa.array(side == 1)).combine_chunks(), t.filter(pa.array(side == 0)).combine_chunks()
            a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(left) and len(right):
                x, y = (_matrix(s.column("v").combine_chunks()) for s in (left, right))
                near = x @ y.T >= least
                r, q = left.column("a").to_numpy(), right.column("a").to_numpy()
                none = np.iinfo(np.int64).max
                # the smallest id that each row reaches over the border; a star of it joins as much as all the pairs do
                lr, lq, before = np.where(near.any(axis=1), r, none), np.where(near.any(axis=0), q, none), None
                while before is None or (before != lr).any():
                    before = lr
                    lq = np.minimum(lq, np.where(near, lr[:, None], none).min(axis=0))
                    lr = np.minimum(lr, np.where(near, lq[None, :], none).min(axis=1))
                a, b = np.concatenate([lr, lq]), np.concatenate([r, q])
            ok = (a != b) & (a != np.iinfo(np.int64).max)
            return pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

        yield from _grouped(batches, ("border", "pass"), compare)

    return borders.repartition("border", "pass").sortWithinPartitions("border", "pass").mapInArrow(part, "a long, b long")


def _grouped(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], f) -> Iterator[pa.RecordBatch]:
    """Applies f to the rows of each key of a sorted stream; the caller bounds the groups."""
    held, key = [], None
    for batch in batches:
        if not len(batch):
            continue
        ks = np.stack([batch.column(c).to_numpy() for c in by])
        edge = [0, *(np.flatnonzero((ks[:, 1:] != ks[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            if held and tuple(ks[:, s]) != key:
                yield f(pa.Table.from_batches(held))
                held = []
            key = tuple(ks[:, s])
            held.append(batch.slice(s, e - s))
    if held:
        yield f(pa.Table.from_batches(held))


def _within(members: DataFrame, least: float) -> DataFrame:
    """(rep, links): for each class the rows of other classes of its component with a cosine of ``least`` or more.

    members(comp, rep, copies, v). Every component is compared block by block, about BLOCK
    by BLOCK classes in a task's group; what leaves a task is one count for each class and block. A vector is sent as often as its
    component has blocks, twice."""
    # few components have several blocks; their sizes meet the members salted, so that a large one is many tasks' work
    large = members.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    large = large.select("comp", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(SALTS)).cast("int"))
    rows = salted.join(large.hint("merge"), ["comp", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    all_ = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = rows.select("comp", mine.alias("i"), F.explode(all_).alias("j"), F.lit(0).alias("side"), "rep", "copies", "v")
    right = rows.select("comp", F.explode(all_).alias("i"), mine.alias("j"), F.lit(1).alias("side"), "rep", "copies", "v")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def count(t: pa.Table) -> pa.RecordBatch:
            side = t.column("side").to_numpy()
            left, right = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
            x, y = (_matrix(s.column("v").combine_chunks()) for s in (left, right))
            r, q = left.column("rep").to_numpy(), right.column("rep").to_numpy()
            copies, links = right.column("copies").to_numpy(), np.zeros(len(r), np.int64)
            for k in range(0, len(r), 256):
                near = (x[k : k + 256] @ y.T >= least) & (r[k : k + 256, None] != q[None, :])
                links[k : k + 256] = near @ copies
            return pa.RecordBatch.from_arrays([pa.array(r), pa.array(links)], ["rep", "links"])

        yield from _grouped(batches, ("comp", "i", "j"), count)

    spread = left.unionByName(right).repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    return spread.mapInArrow(part, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def passes_for(rows: int, window: int, least: float) -> int:
    """Passes after which a pair at the bound has shared a window with a chance of 1 - MISS, if directions are spread evenly."""
    q = (1 - np.arccos(least) / np.pi) ** (max(0.0, np.log2(max(1, rows) / window)) + 1)
    return int(np.ceil(np.log(MISS) / np.log1p(-min(q, 0.999))))


def _linked_pairs(classes: DataFrame, least: float, passes: int, window: int) -> DataFrame:
    """Pairs (a, b) of linked classes that make up the components, found in rounds of passes over the classes not yet safe."""
    todo, start, left, pairs = classes.select("rep", "v"), 0, None, None
    while True:
        rows = todo.count()
        each = max(passes, passes_for(rows, window, least))
        n = max(1, rows * each // 50_000 + 1)
        found = stored(_windows(_ordered(todo, each, start).repartitionByRange(n, "pass", "key", F.xxhash64("rep")).sortWithinPartitions("pass", "key"), window, least))
        new = found.where("pass is null and credit is null").select("a", "b").unionByName(_across(found.where("pass is not null"), least))
        every = stored((new if pairs is None else pairs.unionByName(new)).distinct())
        discard(*([] if pairs is None else [pairs]))
        pairs = every
        start += each
        if rows <= window:  # all were compared with all
            return pairs
        credit = found.where("credit is not null").select(F.col("a").alias("rep"), "credit")
        left = (credit if left is None else left.unionByName(credit)).groupBy("rep").agg(F.sum("credit").alias("credit"))
        left = stored(left.where(F.col("credit") > float(np.log(MISS))))  # not safe yet
        if left.isEmpty():
            return pairs
        todo = stored(todo.join(left.select("rep").hint("merge"), "rep", "left_semi"))


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """Groups of near-equal vectors: rows (id_col, n_links, component_id, kept), one for each input row.

    Vectors are linked when found with a cosine of ``least`` or more in double precision.
    ``n_links`` counts the other rows linked directly, copies included; ``component_id`` is the
    smallest id reachable by links, itself included. Ids are integers. Vectors that are null, empty,
    zero, or hold a null or a non-finite component link with nothing; so do vectors of different lengths. Rows with
    equal ids count one by one as rows; a component's smallest id may then be shared. Other columns
    are ignored. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    unit = stored(_unit(rows).withColumn("class", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct("v")), 256))))
    classes = stored(unit.where("v is not null").groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")))
    pairs = _linked_pairs(classes, least, passes, window)
    comp = components(pairs).withColumnRenamed("id", "rep").withColumnRenamed("component", "comp")
    members = classes.select("rep", "copies", "v").join(comp.hint("merge"), "rep")
    linked = _within(members, least).join(comp.hint("merge"), "rep")
    known = classes.select("class", "rep", "copies").join(linked.hint("merge"), "rep", "left").select("class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("comp", "rep").alias("component_id"))
    out = unit.select("id", "class").join(known.hint("merge"), "class", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
