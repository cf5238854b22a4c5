"""Sharding by a minimax contiguous partition.

Rows with equal texts form an atomic group. Groups are put in a fixed order (by the digest of the
text) and cut into ``shards`` contiguous runs so that the largest run is as small as possible:
binary search on the capacity, each candidate checked greedily, then cut at the smallest
feasible one.

Spark sums the sizes in 2 ** ``CELL_BITS`` equal ranges of the digest. The smallest capacity over whole cells
bounds the answer, and so the places where a cut can fall: only the cells there are summed again in
2 ** ``SPLIT_BITS`` parts each, or by group where few rows are left, until every such place is a single group.
The driver sees a fixed number of sums in each round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldproof.llm.kit import stored

#: Bits of the digest that order the groups; those of a cell, and those that tell a cell's parts apart.
BITS, CELL_BITS, SPLIT_BITS = 60, 14, 8
#: Units that are opened in a round, and rows whose groups the driver lists at once, at most.
OPENED, LISTED = 256, 200_000
#: Slots are numbered in ranges of the digest, and in so many parts of each, so that one text with many rows is not one task's work.
PART_BITS, PARTS = 8, 16


@dataclass(frozen=True)
class Unit:
    """Neighbouring groups: all with the same first ``bits`` of the digest, or one group (key)."""

    start: int
    bits: int
    key: str
    size: int
    rows: int

    @property
    def splits(self) -> bool:
        return not self.key and self.size > 0


def ends(before: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Unit after the last one of each greedy run within ``capacity``."""
    at, out = 0, []
    for _ in range(shards):
        at = int(np.searchsorted(before, before[at] + capacity, "right")) - 1
        out.append(at)
    return out


def smallest(before: np.ndarray, shards: int) -> int:
    """The smallest capacity with which ``shards`` greedy runs of whole units reach the end."""
    lo, hi = -(-int(before[-1]) // shards) - 1, int(before[-1])
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if ends(before, mid, shards)[-1] == len(before) - 1 else (mid, hi)
    return hi


def open_units(units: list[Unit], before: np.ndarray, shards: int) -> list[int]:
    """Units that split and in which a cut of the best partition can fall: from where the greedy runs end at least, with the
    least capacity there can be, to where they end at most with the smallest one over whole units. The largest ones of the
    coarsest kind come first, ``OPENED`` of them; what they hold narrows the rest down."""
    low, high = max(1, -(-int(before[-1]) // shards), *(u.size for u in units if u.key)), smallest(before, shards)
    at, found = [0, 0], set()
    for k in range(shards):
        # a run and the next one hold more than the capacity together, whatever the units are
        at.append(max(int(before[np.searchsorted(before, at[-1] + low, "right") - 1]), at[-1], at[-2] + low if k else 0))
        first, last = int(np.searchsorted(before, at[-1], "right")) - 1, int(np.searchsorted(before, (k + 1) * high, "left"))
        found |= {u for u in range(max(0, first), min(last + 1, len(units))) if units[u].splits}
    coarsest = min((units[u].bits for u in found), default=0)
    return sorted(sorted((u for u in found if units[u].bits == coarsest), key=lambda u: (-units[u].size, u))[:OPENED])


def shard(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Puts all rows into shards 0 .. shards - 1 of nearly equal bytes; equal texts stay together.

    Rows: id_col, *keep, size (UTF-8 bytes plus 1), text_crc32, shard, slot (gapless from 0 in each
    shard). One output row for each input row, repeated rows included. A null text has size 1 and
    is grouped with empty ones. Ties in the slot order are broken by id, then at will. Other
    columns are ignored, but for ``keep``, whose columns are passed on unless they have a result's
    name. An empty table gives no rows; with fewer groups than shards the last shards stay empty.
    """
    keep = [c for c in keep or [] if c not in (id_col, "size", "text_crc32", "shard", "slot", "key", "order")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("_id"), *keep, (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.concat(F.md5(text), F.lpad(F.hex(F.length(text)), 8, "0")).alias("key"))
    rows = stored(rows.withColumn("order", F.conv(F.substring("key", 1, BITS // 4), 16, 10).cast("long")))
    prefix = lambda bits: F.shiftright("order", BITS - bits)

    def summed(part: DataFrame, bits: int, listed: bool) -> dict[int, list[Unit]]:
        """Units of rows by the prefix of ``bits`` bits, or groups by that prefix, in order."""
        found: dict[int, list[Unit]] = {}
        by = ["order", "key"] if listed else [prefix(bits).alias("p")]
        for r in part.groupBy(*by).agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect():
            unit = Unit(r.order, BITS, r.key, r["size"], r["rows"]) if listed else Unit(r.p << (BITS - bits), bits, "", r["size"], r["rows"])
            found.setdefault(unit.start >> (BITS - bits), []).append(unit)
        return {p: sorted(us, key=lambda u: (u.start, u.key)) for p, us in found.items()}

    units = [u for _, us in sorted(summed(rows, CELL_BITS, False).items()) for u in us]
    while True:
        before = np.concatenate([[0], np.cumsum([u.size for u in units])]).astype(np.int64)
        todo = open_units(units, before, shards) if units else []
        if not todo:
            break
        bits = units[todo[0]].bits
        listed = bits + SPLIT_BITS > BITS or sum(units[u].rows for u in todo) <= LISTED
        inside = rows.where(prefix(bits).isin([units[u].start >> (BITS - bits) for u in todo]))
        found = summed(inside, bits if listed else bits + SPLIT_BITS, listed)
        parts: dict[int, list[Unit]] = {}
        for p, us in sorted(found.items()):
            parts.setdefault(p if listed else p >> SPLIT_BITS, []).extend(us)
        chosen = set(todo)
        units = [x for i, u in enumerate(units) for x in (parts[u.start >> (BITS - bits)] if i in chosen else [u])]
    which = F.lit(0)
    for u in ends(before, smallest(before, shards), shards)[:-1] if units else []:
        if u < len(units):
            past = (F.col("key") >= units[u].key) if units[u].key else (F.col("order") >= units[u].start)
            which = which + past.cast("int")
    placed = rows.withColumn("shard", which).withColumn("_part", F.shiftright("order", BITS - PART_BITS).cast("int") * PARTS + F.pmod(F.xxhash64("_id"), F.lit(PARTS)))
    # slots: a number within each (shard, part), plus the rows of the shard's parts before it
    counts = sorted((r.shard, r["_part"], r.n) for r in placed.groupBy("shard", "_part").agg(F.count("*").alias("n")).collect())  # at most 2 ** PART_BITS * PARTS + shards rows
    offset, total = [], {}
    for s, p, n in counts:
        offset.append((s, p, total.get(s, 0)))
        total[s] = total.get(s, 0) + n
    starts = docs.sparkSession.createDataFrame(offset, "shard int, _part int, _before long")
    number = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("key", "_id"))
    out = placed.join(F.broadcast(starts), ["shard", "_part"]).withColumn("slot", F.col("_before") + number - 1)
    return out.select(F.col("_id").alias(id_col), *keep, "size", "text_crc32", "shard", "slot")
