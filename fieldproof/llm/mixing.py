"""Mixing sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document belongs to). Token
capacity flows from patterns to the quotas of the sources they belong to; the first pass over a
pattern's tokens costs nothing, each further one more than the one before (convex repetition
costs), so nothing is repeated while fresh tokens are left. The flow says how often each pattern is
taken for each source; then documents are selected by a seeded order.

The flow runs on the driver over patterns, not documents: their number is checked against
``max_patterns``.
"""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldproof.llm.kit import stored

REPEATS = 3
CELLS = 1 << 12


def quotas(sizes: dict, weights: dict, repeats: int = REPEATS, total: int | None = None) -> dict:
    """Target of each source: ``total`` (all sizes) shared by weight; a target stops at ``repeats`` times
    the source's size and its excess is shared again by weight among the others."""
    left, out, free = float(sum(sizes.values()) if total is None else total), {}, set(sizes)
    while free:
        w = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / w > repeats * sizes[s]] if w else []
        if not over:
            return out | {s: left * weights[s] / w if w else 0.0 for s in free}
        out |= {s: float(repeats * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def flow(patterns: dict[tuple, int], targets: dict, repeats: int = REPEATS) -> dict[tuple, dict]:
    """Tokens routed from each pattern to each of its sources, at least total repetition cost.

    Shortest paths and blocking flows in turn on the graph pattern copy r (capacity: the pattern's tokens, cost r)
    -> source (capacity: its target). A pattern's copies are filled in order as costs rise; the number of rounds follows the
    number of different costs, not that of patterns.
    """
    nodes = [("s",), *(("p", p) for p in patterns), *(("q", s) for s in targets), ("t",)]
    number = {n: i for i, n in enumerate(nodes)}
    graph: list[list[list]] = [[] for _ in nodes]

    def edge(a, b, cap, cost):
        graph[number[a]].append([number[b], cap, cost, len(graph[number[b]])])
        graph[number[b]].append([number[a], 0.0, -cost, len(graph[number[a]]) - 1])

    for p, tokens in patterns.items():
        for r in range(repeats):
            edge(("s",), ("p", p), float(tokens), r)
        for s in p:
            if s in targets:
                edge(("p", p), ("q", s), float("inf"), 0)
    for s, t in targets.items():
        edge(("q", s), ("t",), float(t), 0)
    start, end, tiny, far = 0, len(nodes) - 1, 1e-6, float("inf")
    potential = [0.0] * len(nodes)
    while True:
        # shortest distances by reduced cost
        dist, heap = [far] * len(nodes), [(0.0, start)]
        dist[start] = 0.0
        while heap:
            d, u = heappop(heap)
            if d > dist[u]:
                continue
            for v, cap, cost, _ in graph[u]:
                if cap > tiny and (new := d + cost + potential[u] - potential[v]) < dist[v] - 1e-12:
                    dist[v] = new
                    heappush(heap, (new, v))
        if dist[end] == far:
            break
        potential = [p + min(d, dist[end]) for p, d in zip(potential, dist, strict=True)]
        # all that fits over edges without reduced cost, level by level: one round for each distance, not for each path
        while True:
            level, queue = [-1] * len(nodes), [start]
            level[start] = 0
            for u in queue:
                for v, cap, cost, _ in graph[u]:
                    if level[v] < 0 and cap > tiny and abs(cost + potential[u] - potential[v]) < 1e-9:
                        level[v] = level[u] + 1
                        queue.append(v)
            if level[end] < 0:
                break
            at, path = [0] * len(nodes), []
            while True:
                u = graph[path[-1][0]][path[-1][1]][0] if path else start
                if u == end:
                    push = min(graph[x][k][1] for x, k in path)
                    for x, k in path:
                        e = graph[x][k]
                        e[1] -= push
                        graph[e[0]][e[3]][1] += push
                    full = next(i for i, (x, k) in enumerate(path) if graph[x][k][1] <= tiny)
                    del path[full:]
                    continue
                while at[u] < len(graph[u]):
                    v, cap, cost, _ = graph[u][at[u]]
                    if cap > tiny and level[v] == level[u] + 1 and abs(cost + potential[u] - potential[v]) < 1e-9:
                        break
                    at[u] += 1
                if at[u] < len(graph[u]):
                    path.append((u, at[u]))
                elif path:
                    x, k = path.pop()
                    at[x] += 1
                else:
                    break
    out: dict[tuple, dict] = {p: {} for p in patterns}
    for s in targets:
        for v, cap, cost, _ in graph[number[("q", s)]]:
            if nodes[v][0] == "p" and cap > tiny:
                out[nodes[v][1]][s] = out[nodes[v][1]].get(s, 0.0) + cap
    return out


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0)."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def mix(docs: DataFrame, sources: Column, weights: dict | None = None, *, id_col: str = "doc_id", text_col: str = "text", repeats: int = REPEATS, total: int | None = None, cycle: tuple[int, ...] = (5, 2, 1), seed: int = 11, fill_rounds: int = 6, max_patterns: int = 10_000, keep: list[str] | None = None) -> DataFrame:
    """How many words of each document a mix takes.

    ``sources`` gives the array of sources that a row belongs to (an empty or null array: the null
    source). ``weights`` by source defaults to ``cycle``, repeated over the sources by code point,
    null last. Rows: id_col, *keep, pattern, size (words), times (whole copies taken), taken (words
    taken: size times copies, and for at most one document of a pattern a part of one more copy). Every document is taken floor(quota / tokens of its pattern) times and the first
    ones in a seeded order once more; then the gap that is left to the quota is filled by the
    largest documents that fit, ``fill_rounds`` times for each pattern; if over 1% of the quota is
    left then, the smallest document that is larger gives that many of its words. No document is taken over ``repeats``
    times. Reruns agree. Documents without words have size 0 and are taken as the whole pattern is.

    Null texts have size 0. Rows with equal ids are taken independently, also where they are copies of each other. Other columns are
    ignored, but for ``keep``, whose columns are passed on unless they have a result's name. An
    empty table gives no rows.
    """
    keep = [c for c in keep or [] if c not in (id_col, "pattern", "size", "times", "taken")]
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    pattern = F.array_sort(F.array_distinct(F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, sources).otherwise(F.array(F.lit(None).cast("string")))))
    # equal ids order by content, so that reruns agree
    order = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")))
    rows = docs.select(F.col(id_col).alias("_id"), *keep, pattern.alias("pattern"), word_count(text).alias("size"), order.alias("_o"))
    # copies of a row share their place in the order; once written, a number tells them apart
    rows = stored(rows.withColumns({"_cell": F.shiftright(F.col("_o"), 52).cast("int"), "_row": F.monotonically_increasing_id()}))
    cells = rows.groupBy("pattern", "_cell").agg(F.sum("size").alias("s"))
    by_pattern = rows.groupBy("pattern").agg(F.sum("size").alias("s")).limit(max_patterns + 1).collect()
    if len(by_pattern) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    tokens = {tuple(r.pattern): r.s for r in by_pattern}
    names = sorted({s for p in tokens for s in p}, key=lambda s: (s is None, s or ""))
    weights = weights or {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    weights = {s: weights.get(s, 0) for s in names}
    sizes = {s: sum(t for p, t in tokens.items() if s in p) for s in names}
    targets = quotas(sizes, weights, repeats, total if total is not None else sum(tokens.values()))
    routed = {p: sum(q.values()) for p, q in flow(tokens, targets, repeats).items()}
    full = {p: min(repeats, int(q / tokens[p] + 1e-9)) if tokens[p] else 1 for p, q in routed.items()}
    gap = {p: q - full[p] * tokens[p] if full[p] < repeats else 0.0 for p, q in routed.items()}
    plan = F.broadcast(spark.createDataFrame([(list(p), full[p], float(gap[p])) for p in tokens], "pattern array<string>, _full int, _gap double"))
    key = lambda c: F.to_json(F.struct(F.col(c).alias("p")), {"ignoreNullFields": "false"})  # noqa: E731  arrays with nulls join by value
    plan = plan.select(key("pattern").alias("_k"), "_full", "_gap")
    rows = rows.withColumn("_k", key("pattern"))
    # whole cells while they fit, then documents of the cell where the quota ends
    running = F.sum("s").over(Window.partitionBy("_k").orderBy("_cell"))
    edge = F.broadcast(cells.withColumn("_k", key("pattern")).join(F.broadcast(plan), "_k").withColumn("_before", running - F.col("s")).where("_before <= _gap").groupBy("_k").agg(F.max("_cell").alias("_edge"), F.max_by("_before", "_cell").alias("_before")))
    state = rows.join(F.broadcast(plan), "_k").join(edge, "_k", "left")
    at_edge = F.col("_cell") == F.col("_edge")
    inner = F.sum(F.when(at_edge, F.col("size")).otherwise(0)).over(Window.partitionBy("_k", "_cell").orderBy("_o", "_row").rowsBetween(Window.unboundedPreceding, 0))
    inside = state.where(at_edge).withColumn("_in", F.col("_before") + inner <= F.col("_gap"))
    outside = state.where(~at_edge | F.col("_edge").isNull()).withColumn("_in", F.coalesce(F.col("_cell") < F.col("_edge"), F.lit(False)))
    cols = ["_id", *keep, "pattern", "_k", "size", "_o", "_row", "_full", "_gap", "_in"]
    state = stored(inside.select(*cols).unionByName(outside.select(*cols)))
    taken = {r["_k"]: r.s for r in state.where("_in").groupBy("_k").agg(F.sum("size").alias("s")).collect()}
    left = {r["_k"]: (r["_full"], r["_gap"] - taken.get(r["_k"], 0)) for r in plan.collect()}
    picked: dict[str, list[tuple[int, int]]] = {}
    for _ in range(fill_rounds):
        want = [(k, float(g)) for k, (f, g) in left.items() if f < repeats and g >= 1]
        if not want:
            break
        need = F.broadcast(spark.createDataFrame(want, "_k string, _want double"))
        free = state.where("not _in and size > 0").join(need, "_k").where("size <= _want")
        if done := [(o,) for x in picked.values() for o, _ in x]:
            free = free.join(F.broadcast(spark.createDataFrame(done, "_row long")), "_row", "left_anti")
        found = free.groupBy("_k").agg(F.max(F.struct("size", "_o", "_row")).alias("m")).collect()
        for r in found:
            picked.setdefault(r["_k"], []).append((r.m["_row"], r.m["size"]))
            left[r["_k"]] = (left[r["_k"]][0], left[r["_k"]][1] - r.m["size"])
    # where no whole document comes near what is left, the smallest larger one gives a part of its words
    routed_by = {r["_k"]: r["_full"] * r.s + r["_gap"] for r in plan.join(rows.groupBy("_k").agg(F.sum("size").alias("s")), "_k").collect()}
    want = [(k, float(g)) for k, (f, g) in left.items() if f < repeats and g >= max(1.0, 0.01 * routed_by[k])]
    parts: dict[int, int] = {}
    if want:
        need = F.broadcast(spark.createDataFrame(want, "_k string, _want double"))
        found = state.where("not _in").join(need, "_k").where("size > _want").groupBy("_k").agg(F.min(F.struct("size", "_o", "_row")).alias("m")).collect()
        parts = {r.m["_row"]: int(dict(want)[r["_k"]]) for r in found}
    whole = {o for x in picked.values() for o, _ in x}
    extra = spark.createDataFrame([(o, o in whole, parts.get(o, 0)) for o in sorted(whole | set(parts))], "_row long, _more boolean, _part long")
    times = F.col("_full") + (F.col("_in") | F.coalesce("_more", F.lit(False))).cast("int")
    out = state.join(F.broadcast(extra), "_row", "left").withColumn("times", F.least(times, F.lit(repeats)))
    part = F.when(F.col("times") < repeats, F.coalesce("_part", F.lit(0))).otherwise(0)
    return out.select(F.col("_id").alias(id_col), *keep, "pattern", "size", "times", (F.col("size") * F.col("times") + part).alias("taken"))
