"""Looking into large tables without reading them whole: pages deep in an order, and records that hold a text."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldproof.operators.explore import request_hits
from fieldproof.operators.ingest import sort_keys
from fieldproof.sources.tables import discard, numbered, settled, stored

#: Characters of a gram (at most three), and how many rows share a posting list (a power of two, at most 2^15).
GRAM, BITS = 3, 12


def _way(descending: bool) -> list[tuple[str, bool]]:
    """The keys of a page's order, and which of them go down."""
    return [("missing", False), ("is_text", False), ("num", descending), ("text", descending)]


def _ordered(descending: bool, key: str) -> list[Column]:
    way = lambda name, down: F.col(f"_{name}").desc_nulls_last() if down else F.col(f"_{name}").asc_nulls_last()
    return [*(way(name, down) for name, down in _way(descending)), F.col(key)]


def _keyed(records: DataFrame, by: Column) -> DataFrame:
    return records.withColumns({f"_{name}": c for name, c in sort_keys(by).items()})


def paged(records: DataFrame, by: Column, key: str, descending: bool = False) -> DataFrame:
    """Records with their ``position`` from 1 in the order of ``dataset_page``, written in that order.

    Sorted once, in ranges; ``page_of`` then reads the part of the files that holds a page, however deep. ``key`` is unique and not
    null; an empty table has no positions.
    """
    keyed = _keyed(records, by)
    return settled(lambda: numbered(keyed, _ordered(descending, key), "position").select(*records.columns, "position").sortWithinPartitions("position"))


def page_of(rows: DataFrame, page: int, size: int = 10) -> DataFrame:
    """A page of what ``paged`` has written; one past the end has no rows."""
    return rows.where(F.col("position").between((page - 1) * size + 1, page * size))


def page_after(records: DataFrame, by: Column, key: str, last: tuple, descending: bool = False, size: int = 10) -> DataFrame:
    """The ``size`` records that follow one with the value and key of ``last`` in the order of ``dataset_page``.

    Nothing has to be written before, and no page before is sorted: a filter and a top-k. The record itself may be gone.
    """
    value, at = last
    here = sort_keys(F.lit(value).cast("string"))
    after = F.col(key) > F.lit(at)
    for name, down in reversed(_way(descending)):
        c, v = F.col(f"_{name}"), here[name]
        later = v.isNotNull() & (c.isNull() | ((c < v) if down else (c > v)))
        after = F.coalesce(later, F.lit(False)) | (c.eqNullSafe(v) & after)
    return _keyed(records, by).where(after).orderBy(*_ordered(descending, key)).limit(size).select(*records.columns)


class TextIndex(NamedTuple):
    """texts (.., _text, n), in the order of n, and postings (gram, block, members): the rows of a block whose text
    holds a gram, as n less the block's first."""

    texts: DataFrame
    postings: DataFrame


def _lists(texts: DataFrame) -> DataFrame:
    """(gram, block, members): for each block of 2^BITS rows the distinct runs of GRAM characters of its texts, with the rows that hold
    them, told from the block's first. Texts are shuffled by block, not their grams; a task holds the texts of one block."""
    size, bits = GRAM, BITS

    def lists(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("n")
        row = rows.column("n").to_numpy() & ((1 << bits) - 1)
        texts = rows.column("_text").to_pylist()
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        left = np.repeat(np.cumsum(length), length) - np.arange(len(chars))  # characters up to the end of the text
        at = np.flatnonzero(left >= size)
        gram = reduce(lambda g, k: g << 21 | chars[at + k], range(size), np.zeros(len(at), np.int64))
        order = np.argsort(gram, kind="stable")
        gram, of = gram[order], np.repeat(row, length)[at][order]
        new = np.diff(gram, prepend=-1) != 0
        keep = new | (np.diff(of, prepend=-1) != 0)
        gram, of, first = gram[keep], of[keep], np.flatnonzero(new[keep])
        names = np.stack([gram[first] >> 21 * (size - 1 - k) & 0x1FFFFF for k in range(size)], axis=1).astype("<u4").tobytes().decode("utf-32-le")
        members = pa.ListArray.from_arrays(pa.array(np.append(first, len(of)).astype(np.int32)), pa.array(of.astype(np.int16)))
        return pa.table([pa.array([names[i : i + size] for i in range(0, len(names), size)], pa.string()), pa.array(np.full(len(first), key[0].as_py())), members], ["gram", "block", "members"])

    of_block = texts.where("_text is not null").select(F.shiftright("n", bits).alias("block"), "n", "_text")
    return of_block.groupBy("block").applyInArrow(lists, "gram string, block long, members array<short>")


def text_index(rows: DataFrame, order: list[str], text: Column) -> TextIndex:
    """The written index of a text of each row, without regard to case. ``order`` is unique; found rows come in it.

    The list of a gram is cut into blocks of 2^BITS rows, so one that a third of all rows hold is spread like the rows. Columns
    ``_text`` and ``n`` are added; a null text is never found.
    """
    texts = settled(lambda: numbered(rows.withColumn("_text", F.lower(text)), order, "n").sortWithinPartitions("n"))
    lists = stored(_lists(texts))  # written first, as dealing out by ranges looks at all rows twice
    postings = stored(lists.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block"))
    discard(lists)
    return TextIndex(texts, postings)


def find(index: TextIndex, text: str, cap: int | None = None) -> DataFrame:
    """Rows of an index whose text holds ``text``, without regard to case; with ``cap`` only the first of them.

    Lists of the text's grams are intersected block by block, and what is left is compared. With ``cap`` blocks are read in order, each
    time 16 times as many, until enough is found; without it all at once. A text of fewer than GRAM characters is looked for in all rows.
    """
    q = text.lower().strip()
    hit = F.contains("_text", F.lit(q))
    wanted = sorted({q[i : i + GRAM] for i in range(len(q) - GRAM + 1)})
    if not wanted:
        found = index.texts.where(hit)
        return found.orderBy("n").limit(cap) if cap is not None else found
    lists = index.postings.where(F.col("gram").isin(wanted)).groupBy("block").agg(F.collect_list("members").alias("m")).where(F.size("m") == len(wanted))
    common = F.aggregate(F.slice("m", 2, len(wanted)), F.get("m", 0), F.array_intersect)
    held = stored(lists.select("block", common.alias("members")).where(F.size("members") > 0))

    def among(first: int, last: int) -> DataFrame:
        ids = held.where(F.col("block").between(first, last)).select("block", F.explode("members").alias("m")).select((F.shiftleft("block", BITS) + F.col("m")).alias("n"))
        near = index.texts.where(F.col("n").between(first << BITS, (last + 1 << BITS) - 1))
        return near.join(ids.hint("shuffle_hash"), "n", "left_semi").where(hit)

    parts, have, at, step = [], 0, -1, 1
    while cap is None or have < cap:
        rest = held.where(F.col("block") > at).select("block").orderBy("block")
        first, last = (rest.limit(step) if cap is not None else rest).agg(F.min("block"), F.max("block")).first()
        if first is None:
            break
        parts.append(among(first, last) if cap is None else stored(among(first, last).orderBy("n").limit(cap - have)))
        have += 0 if cap is None else parts[-1].count()
        at, step = last, step * 16
    if cap is not None:
        discard(held)
    return reduce(DataFrame.unionByName, parts) if parts else index.texts.limit(0)


def record_index(records: DataFrame) -> TextIndex:
    """The index of what ``explore.search`` looks at in records: name, role and attribute values."""
    text = F.concat_ws(" ", "entity_name", "role", F.concat_ws(" ", F.map_values("attributes")))
    return text_index(records.select("run_id", "record_id", "entity_name", text.alias("_text")), ["run_id", "record_id"], F.col("_text"))


def indexed_search(requests: DataFrame, index: TextIndex, text: str, cap: int = 8) -> DataFrame:
    """``explore.search`` with the records from a ``record_index`` instead of a scan."""
    key = F.concat_ws("/", F.col("run_id").cast("string"), F.col("record_id").cast("string"))
    found = find(index, text, cap).select(F.lit("record").alias("kind"), key.alias("id"), F.col("entity_name").alias("title"))
    return request_hits(requests, text).unionByName(found)
