"""Phrases whose words belong together, from an FM-index over word ids in each shard.

1. Each task cuts the pieces it reads into shards of about SHARD words of one language and numbers the words of a shard (``_shards``);
   word counts are summed over shards, and words with ``least`` occurrences get an id (``_frequent``).
2. A shard's pieces, reversed and not, become two Burrows-Wheeler transforms (``_built``); rarer words and the ends of pieces break
   the text, as no frequent phrase crosses them. A phrase is an interval in both. Its words to the right are the symbols of its
   interval in the reversed index, those to the left the symbols of its interval in the other one (``_extended``).
3. Depth by depth (``phrases``): shards extend the phrases that are frequent over all shards by a word to the right, as far as the phrase without
   its first word is frequent too, which a step to the left from that one tells (``_deeper``). Counts are summed over shards; what has
   ``least`` occurrences gets an id, and each shard is told those of its own phrases (``_told``). So a phrase that is rare in every shard
   but frequent in all is found.
4. What a shard sends of one depth is bounded by its words, however many phrases are frequent: phrases are dealt by a hash over parts, as
   many as the occurrences to count ask for, and a shard sends one packed block of ids and counts to each part. Where a phrase stands
   in the index is not sent: a shard works its own phrases out again and is told by their places in its blocks which are frequent.

Nothing of the size of a vocabulary or of all phrases is held by the driver or one task: a task holds one shard, with its own words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldproof.llm.kit import Words, discard, mix64, pieces, stored, union_all

#: Words of a shard, about.
SHARD = 1 << 20
#: Occurrences of phrases that one part counts, at most about: a task holds a part.
PART = 1 << 22
#: Fixed values of the contract: longest phrase, fewest occurrences, rows of a language.
DEPTH, LEAST, FIRST = 5, 100, 2000

#: What ends a piece, and what stands between words.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True

_SHARDS = "shard long, lang string, ids binary, words array<string>, counts array<long>"


class _Buffer:
    """Words of one language that wait to become a shard."""

    def __init__(self) -> None:
        self.size, self.parts = 0, []

    def add(self, words: Words, of_piece: np.ndarray) -> None:
        self.parts.append((words.data, words.start, words.end, of_piece))
        self.size += len(of_piece)

    def shard(self) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Word ids from 1, in order of first sight, with 0 between pieces; the words; their counts."""
        number: dict[bytes, int] = {}
        out = []
        for data, start, end, of_piece in self.parts:
            text = data.tobytes()
            got = np.fromiter((number.setdefault(text[s:e], len(number) + 1) for s, e in zip(start.tolist(), end.tolist(), strict=True)), np.int32, len(start))
            cut = np.flatnonzero(np.diff(of_piece)) + 1
            out += [np.insert(got, cut, 0), np.zeros(1, np.int32)]
        ids = np.concatenate(out)
        return ids, [w.decode("utf-8", "replace") for w in number], np.bincount(ids, minlength=len(number) + 1)[1:]


def _pieces_of(words: Words, offs: np.ndarray) -> np.ndarray:
    """For each word the number of its piece: it grows at the ends of texts and at the characters that end a piece."""
    ends = np.concatenate([[0], np.cumsum(BREAK[words.data])])
    text = np.searchsorted(offs[1:], words.start, "right")
    return ends[words.start] + text


def _shards(docs: DataFrame, size: int) -> DataFrame:
    """(shard, lang, ids, words, counts) of rows (lang, text): shards of about ``size`` words; a longer text makes several."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, _Buffer] = {}
        held, made = 0, TaskContext.get().partitionId() << 32

        def shard(lang: str) -> pa.RecordBatch:
            nonlocal held, made
            made += 1
            held -= waiting[lang].size
            ids, words, counts = waiting.pop(lang).shard()
            return pa.RecordBatch.from_arrays([pa.array([made]), pa.array([lang]), pa.array([ids.tobytes()], pa.binary()), pa.array([words], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))], ["shard", "lang", "ids", "words", "counts"])

        for batch in batches:
            lang = batch.column("lang").to_pylist()
            for i, j, data, offs in pieces(batch.column("text")):
                words = Words(data, offs, GAP)
                of_piece = _pieces_of(words, offs)
                for t in range(j - i):
                    a, b = int(words.of[t]), int(words.of[t + 1])
                    while a < b:
                        # a text longer than a shard is cut between two pieces; one piece is never cut
                        e = b if b - a <= size else min(b, a + int(np.searchsorted(of_piece[a:b], of_piece[a + size], "left")) or b)
                        if e <= a:
                            e = min(b, a + int(np.searchsorted(of_piece[a:b], of_piece[a], "right")))
                        part = Words.__new__(Words)
                        at = int(words.start[a])
                        part.data, part.start, part.end = words.data[at : int(words.end[e - 1])], words.start[a:e] - at, words.end[a:e] - at
                        buffer = waiting.setdefault(lang[i + t], _Buffer())
                        buffer.add(part, of_piece[a:e])
                        held += e - a
                        if buffer.size >= size:
                            yield shard(lang[i + t])
                        elif held >= 4 * size:
                            yield shard(max(waiting, key=lambda k: waiting[k].size))
                        a = e
        for one in list(waiting):
            yield shard(one)

    return docs.mapInArrow(cut, _SHARDS)


def _order(key: np.ndarray) -> np.ndarray:
    """The stable order of non-negative numbers: a plain sort of (number, place) in one word where they fit."""
    bits = max(1, len(key).bit_length())
    if not len(key) or int(key.max()) >> (63 - bits):
        return np.argsort(key, kind="stable")
    return np.sort(key.astype(np.int64) << bits | np.arange(len(key))) & ((1 << bits) - 1)


def _suffix_order(ids: np.ndarray) -> np.ndarray:
    """Order of all suffixes, compared up to the first 0; equal ones by place, as if each 0 were larger than those before it.

    As many words as fit a number make the first order; then only suffixes that are still equal, and go on, are sorted further,
    each time by twice as many words (Larsson, Sadakane 2007).
    """
    n, bits = len(ids), max(1, int(ids.max()).bit_length())
    to_end = np.flatnonzero(ids == 0)
    left = to_end[np.searchsorted(to_end, np.arange(n))] - np.arange(n)  # words up to the next 0
    h, key = max(1, (62 - n.bit_length()) // bits), np.zeros(n, np.int64)
    for j in range(h):
        key = key << bits | np.where(left > j, ids[np.minimum(np.arange(n) + j, n - 1)], 0)
    order = _order(key)
    rank = np.empty(n, np.int64)
    same = np.concatenate([[False], (key[order][1:] == key[order][:-1]) & (left[order][1:] >= h)])  # shorter ones are told apart by place
    rank[order] = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    while True:
        tied = np.flatnonzero(same | np.append(same[1:], False))  # places in the order
        if not len(tied):
            return order
        at = order[tied]
        key = rank[at] * (n + 1) + np.where(left[at] >= h, rank[np.minimum(at + h, n - 1)], 0)
        by = np.lexsort((at, key))
        order[tied] = at = at[by]
        key = key[by]
        again = np.concatenate([[False], (key[1:] == key[:-1]) & (left[at][1:] >= 2 * h)])
        same[tied] = again
        rank[at] = np.maximum.accumulate(np.where(again, 0, tied))
        h *= 2


def _transform(ids: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform of a text of pieces that each end with 0."""
    return ids[_suffix_order(ids) - 1]  # before the first place stands the last, which is 0


def _packed(ids: np.ndarray) -> bytes:
    """Numbers as bytes, two to each where all fit; the first byte tells their width."""
    width = 2 if int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int32)


class _Index:
    """Bidirectional FM-index of a text of pieces: transforms of the text and of the text of reversed pieces, with their steps."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right
        self.left_step, self.right_step = self._steps(left), self._steps(right)

    @classmethod
    def of(cls, ids: np.ndarray) -> _Index:
        return cls(_transform(ids), _transform(np.concatenate([ids[:-1][::-1], [0]]).astype(ids.dtype)))

    @staticmethod
    def _steps(before: np.ndarray) -> np.ndarray:
        """Where a step from a word to the one before it leads (of breaks the value is not used)."""
        step = np.empty(len(before), np.int64)
        step[_order(before)] = np.arange(len(before))
        return step

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word in the text: its id, the start of its interval (the same in both transforms), its count."""
        count = np.bincount(self.left)
        word = np.flatnonzero(count[1:]) + 1
        return word, (np.cumsum(count) - count)[word], count[word]

    def extended(self, lo: np.ndarray, lo_back: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """The phrases that are a given one and a word to its right, where the phrase without its first word is given too.

        Given are disjoint intervals of phrases of equal length. Returns for each new phrase its interval (start, start in the
        reversed index, count) and the numbers of the given phrases that it starts and ends with."""
        of = np.repeat(np.arange(len(lo)), count)
        at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        # to the left: where a step from the interval of a phrase leads, in the interval of that phrase with a word before it
        ends_with = np.full(len(self.left), -1, np.int64)
        rows = lo[of] + at
        word = self.left[rows] > 0
        ends_with[self.left_step[rows[word]]] = of[word]
        # to the right: words after a phrase in order, breaks first, as in its interval of the forward index
        rows = lo_back[of] + at
        symbol = self.right[rows].astype(np.int64)
        key = of * np.int64(int(self.right.max()) + 1) + symbol
        order = _order(key)
        first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(order)))
        starts_with = of[order[first]]
        new_lo = lo[starts_with] + first - (np.cumsum(count) - count)[starts_with]
        new_back = self.right_step[rows[order[first]]]
        ok = symbol[order[first]] > 0
        ok[ok] = ends_with[new_lo[ok]] >= 0
        return new_lo[ok], new_back[ok], n[ok], starts_with[ok], ends_with[new_lo[ok]]


def _blocked(*columns: np.ndarray) -> bytes:
    """Columns of numbers from 0 on, equally long, as compressed bytes: the lowest byte of every number, then the next one, as many as are used."""
    raw = b""
    for x in columns:
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        raw += bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return np.array([len(columns[0]), len(raw)], "<u4").tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unblocked(data: bytes) -> list[np.ndarray]:
    size, length = np.frombuffer(data, "<u4", 2).tolist()
    raw, at, out = np.frombuffer(pa.decompress(data[8:], length, "zstd"), np.uint8), 0, []
    while at < length:
        width = int(raw[at])
        x = np.zeros((size, 8), np.uint8)
        x[:, :width] = raw[at + 1 : at + 1 + width * size].reshape(width, size).T
        out.append(x.view("<i8").ravel())
        at += 1 + width * size
    return out


_INDEX = "shard long, left binary, right binary, ids binary"
_BLOCKS = "shard long, part int, block binary"
_TOLD = "shard long, part int, kept binary, id array<long>, first array<long>, last array<long>, f array<long>"


def _built(shards: DataFrame, known: DataFrame) -> DataFrame:
    """(shard, left, right, ids): the transforms of shards over their frequent words, which are (shard, at, id), and the ids of those."""

    def build(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return pa.table([pa.array([], pa.int64()), *(pa.array([], pa.binary()) for _ in range(3))], ["shard", "left", "right", "ids"])
        ids = np.frombuffer(left.column("ids")[0].as_py(), np.int32)
        right = right.sort_by("id")  # words have the same order in all shards
        local = np.zeros(int(ids.max()) + 1, np.int32)
        local[right.column("at").to_numpy()] = np.arange(1, right.num_rows + 1)
        ids = local[ids]
        keep = np.concatenate([[bool(ids[0])], (ids[1:] > 0) | (ids[:-1] > 0)])  # one break is enough
        index = _Index.of(ids[keep])
        known = _blocked(np.diff(right.column("id").to_numpy(), prepend=0))
        return pa.table([pa.array([key[0].as_py()]), *(pa.array([x], pa.binary()) for x in (_packed(index.left), _packed(index.right), known))], ["shard", "left", "right", "ids"])

    return shards.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(build, _INDEX)


def _dealt(first: np.ndarray, last: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of phrases by part and then by their ids, and where the parts begin in it."""
    part = (mix64(first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + last.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((last, first, part))
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _blocks(row: dict, told: list[dict[int, bytes]], parts: list[int]) -> Iterator[tuple[int, bytes]]:
    """(part, block) of a shard's phrases of ``len(parts)`` + 1 words; ``told`` has for each shorter length but 1 what parts told of the shard's blocks."""
    index = _Index(_unpacked(row["left"]), _unpacked(row["right"]))
    word, lo, count = index.words()
    back, known = lo, np.cumsum(_unblocked(row["ids"])[0])[word - 1]
    for depth, number in enumerate(parts):
        lo, back, count, first, last = index.extended(lo, back, count)
        first, last = known[first], known[last]
        order, start = _dealt(first, last, number)
        if depth < len(told):
            kept = [(start[p], *_unblocked(x)) for p, x in told[depth].items()]
            if not kept:
                return
            rows = order[np.concatenate([begin + np.cumsum(step) for begin, step, _ in kept])]
            by = np.argsort(lo[rows])
            known, rows = np.concatenate([ids for *_, ids in kept])[by], rows[by]
            lo, back, count = lo[rows], back[rows], count[rows]
    for p in np.flatnonzero(np.diff(start)).tolist():
        of = order[start[p] : start[p + 1]]
        yield p, _blocked(np.diff(first[of], prepend=0), last[of], count[of])


def _deeper(index: DataFrame, told: list[DataFrame], parts: list[int]) -> DataFrame:
    """Blocks of the phrases of ``len(parts)`` + 1 words found in shards; ``told`` of the phrases of 2, 3, ... words, all shorter ones."""

    def table(shard: int, found: Iterable[tuple[int, bytes]]) -> pa.Table:
        found = list(found)
        return pa.table([pa.array([shard] * len(found), pa.int64()), pa.array([p for p, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["shard", "part", "block"])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                yield from table(row["shard"], _blocks(row, [], parts)).to_batches()

    def go(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        kept: list[dict[int, bytes]] = [{} for _ in parts[1:]]
        for r in right.to_pylist():
            kept[r["depth"]][r["part"]] = r["kept"]
        return table(key[0].as_py(), _blocks(left.to_pylist()[0], kept, parts) if left.num_rows else [])

    if not told:
        return index.mapInArrow(start, _BLOCKS)
    known = union_all([t.where("shard is not null").select("shard", F.lit(depth).alias("depth"), "part", "kept") for depth, t in enumerate(told)])
    return index.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(go, _BLOCKS)


def _told(blocks: DataFrame, parts: int, least: int) -> DataFrame:
    """Phrases with ``least`` occurrences over all shards: for each part a row (id, first, last, f) of lists without a shard, and for each
    shard and part that holds some a row (shard, part, kept) with their places in the shard's block and their ids.

    A phrase has one entry for each shard that holds it, so parts are even however often one occurs.
    """

    def count(key: tuple, table: pa.Table) -> pa.Table:
        part, shards = key[0].as_py(), table.column("shard").to_pylist()
        got = [_unblocked(x.as_py()) for x in table.column("block")]
        first, last, n = np.concatenate([np.cumsum(x[0]) for x in got]), np.concatenate([x[1] for x in got]), np.concatenate([x[2] for x in got])
        begin = np.cumsum([0, *(len(x[0]) for x in got)])
        del got
        if int(first.max()) >> 31 or int(last.max()) >> 32:
            order = np.lexsort((last, first))
        else:
            order = np.argsort(first << 32 | last)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(first[order]) != 0) | (np.diff(last[order]) != 0)]))
        f = np.add.reduceat(n[order], new)
        often = np.flatnonzero(f >= least)
        ids = np.arange(len(often)) * parts + part  # unlike those of other parts, and small
        size = np.diff(np.append(new, len(order)))[often]
        at = order[np.repeat(new[often] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        by = np.argsort(at)
        at, of = at[by], np.repeat(ids, size)[by]
        cut = np.searchsorted(at, begin)
        rows = [{"shard": shards[i], "part": part, "kept": _blocked(np.diff(at[a:b] - begin[i], prepend=0), of[a:b])} for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]
        head = order[new[often]]
        lists = {"id": ids, "first": first[head], "last": last[head], "f": f[often]}
        rows.append({"part": part} | {k: x.tolist() for k, x in lists.items()})
        return pa.Table.from_pylist(rows, pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("kept", pa.binary()), *((k, pa.list_(pa.int64())) for k in lists)]))

    return blocks.groupBy("part").applyInArrow(count, _TOLD)


def _frequent(rows: DataFrame, by: list[str], count: str, least: int) -> DataFrame:
    """Rows of shards with f, the sum of ``count`` over rows with equal ``by``, where it is ``least`` or more; with the id of the words
    or phrase, and ``head`` on one of its rows.

    The rows of a word or phrase, one for each shard that holds it, lie side by side in one task, so f and id are told there: what
    shards hold is shuffled once and never joined with what is frequent. An id is the number of the first row.
    """
    rows = rows.repartition(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    same = Window.partitionBy(*by)
    rows = rows.withColumns({"f": F.sum(count).over(same), "id": F.min("_row").over(same)}).where(F.col("f") >= least)
    return rows.withColumn("head", F.col("_row") == F.col("id")).drop("_row")


def phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH, least: int = LEAST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): phrases (lang, words, fs, ls, f, ended) of 2 to ``depth`` words with f >= ``least`` occurrences, and totals (lang, n).

    ``fs`` and ``ls`` hold the counts of a phrase's first and last 1, 2, ... words. ``ended`` tells that a phrase one word longer has
    as many occurrences. Words are lower-cased in A-Z; ``lang`` null counts as "und". Null and empty texts have no words.
    Repeated rows count as often as they occur. Other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    shards = stored(_shards(rows, shard))
    vocabulary = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("shard", "lang", (F.col("at") + 1).alias("at"), F.col("w.words").alias("word"), F.col("w.counts").alias("k"))
    totals = stored(shards.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, k: a + k)).alias("n")))
    words = stored(_frequent(vocabulary, ["lang", "word"], "k", least).select("shard", "at", "lang", "word", "f", "id", "head"))
    # ids count rows of each partition; across partitions they are as small as there are rows
    partitions = (words.agg(F.max(F.shiftright("id", 33))).first()[0] or 0) + 1
    words = words.withColumn("id", F.col("id").bitwiseAND((1 << 33) - 1) * partitions + F.shiftright("id", 33))
    level = words.where("head").select("id", "lang", F.array("word").alias("words"), F.array("f").alias("fs"), F.array("f").alias("ls"), "f")
    index = stored(_built(shards.select("shard", "ids"), words.select("shard", "at", "id")))
    discard(shards)
    told: list[DataFrame] = []
    parts: list[int] = []
    out = []
    for k in range(2, depth + 1):
        # a phrase has no more occurrences than its first part, so a part has no more than PART entries, about
        parts.append(max(1, -(-(level.agg(F.sum("f")).first()[0] or 0) // PART)))
        told.append(stored(_told(_deeper(index, told, parts), parts[-1], least)))
        often = told[-1].where("shard is null").select(F.inline(F.arrays_zip("id", "first", "last", "f")))
        a = level.select(F.col("id").alias("first"), "lang", "words", "fs")
        b = level.select(F.col("id").alias("last"), F.element_at("words", -1).alias("word"), "ls")
        longer = often.join(a.hint("merge"), "first").join(b.hint("merge"), "last")
        longer = stored(longer.select("id", "first", "last", "lang", F.array_append("words", F.col("word")).alias("words"), F.array_append("fs", F.col("f")).alias("fs"), F.array_append("ls", F.col("f")).alias("ls"), "f"))
        if k > 2:
            out.append(_ended(level, longer))
        level = longer
    discard(index, *told)
    out.append(level.select("lang", "words", "fs", "ls", "f", F.lit(False).alias("ended")))
    return union_all(out), totals


def _ended(level: DataFrame, longer: DataFrame) -> DataFrame:
    """Phrases with the mark whether one of ``longer`` that starts or ends with it has as many occurrences."""
    within = longer.select(F.explode(F.array("first", "last")).alias("id"), F.col("f").alias("most")).groupBy("id").agg(F.max("most").alias("most"))
    return level.join(within.hint("merge"), "id", "left").select("lang", "words", "fs", "ls", "f", F.coalesce(F.col("most") >= F.col("f"), F.lit(False)).alias("ended"))


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH, least: int = LEAST, first: int = FIRST, shard: int = SHARD) -> DataFrame:
    """Each language's ``first`` phrases by score: rows (lang, rank, phrase, a, l, r, n, score).

    A cut of a phrase with ``a`` occurrences into parts with l and r occurrences scores floor(1000 * a * n / (l * r)), n being all
    words of the language; the lowest score counts, ties to the shortest first part. Phrases inside a longer one (of up to
    ``depth`` words) with as many occurrences are left out: it is enough to look one word further, as counts only fall with length.
    Products are decimals of 38 digits: exact below 10^15 words. Ranks go by score and a, descending, then by phrase. See
    ``phrases`` for odd input; an empty table gives no rows.
    """
    found, totals = phrases(docs, text_col=text_col, lang_col=lang_col, depth=depth, least=least, shard=shard)
    rows = found.where("not ended").join(F.broadcast(totals) if totals.count() <= 10_000 else totals.hint("merge"), "lang")
    whole = lambda c: c.cast("decimal(15,0)")
    # an integral division of decimals gives a long, so the score is exact
    cuts = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(F.call_function("div", F.lit(1000).cast("decimal(4,0)") * whole(F.col("f")) * whole(F.col("n")), whole(F.get("fs", k - 1)) * whole(F.get("ls", F.size("words") - k - 1))).alias("score"), k.alias("k"), F.get("fs", k - 1).alias("l"), F.get("ls", F.size("words") - k - 1).alias("r")))
    rows = rows.withColumn("cut", F.array_min(cuts)).select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
