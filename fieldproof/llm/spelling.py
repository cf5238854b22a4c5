"""Spelling variants by PartEnum signatures of letter multisets.

Two words that differ by one inserted, deleted or replaced letter have letter multisets that differ in
at most two elements. A multiset is a binary vector over elements (letter, how many-th of its kind), and
"Hamming distance at most two" is joined exactly by partition and enumeration (Arasu, Ganti, Kaushik 2006,
one first-level part, PARTS second-level parts): the elements are dealt to PARTS parts by a hash, and each
choice of two parts to leave out gives a signature, the hash of all elements in the other parts. Two
vectors at distance two differ in at most two parts, so they agree in the signature that leaves these out.
An equi-join on signatures gives the candidates, and each is verified by its edit distance.

Anagrams share all signatures, so a signature may have many words. Where it has more than BUCKET of them,
its words meet by signature and by what is left of the word without one letter instead, taken over the
letters whose element lies in a part left out (only these can differ), or by the whole shorter word. That
loses no pair: two words at edit distance one are equal once the letter at the place of the edit is taken
out. A set of words with one common rest is bounded by its length times the size of the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldproof.llm.kit import _powers, discard, mix64, stored

#: Fixed values of the contract: letters, the share of runs that lose a letter, shortest word, fewest occurrences, size of a form.
LETTERS = r"[A-Za-zÀ-ÿ]"
SLIP, SHORTEST, FEWEST, TIMES = 31, 7, 2, 10
PARTS = 5
BUCKET = 24

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OUT = list(combinations(range(PARTS), 2))
_BASE = 0x9E3779B97F4A7C15
#: Of each choice of parts left out, what its signatures differ by.
_CHOICE = mix64(np.arange(1, len(_OUT) + 1, dtype=np.uint64))
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slip: int = SLIP, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n): the distinct words of all texts and how often each occurs, from ``fewest`` times on.

    A word is a maximal run of letters, lower-cased in A-Z. If ``slip`` divides the crc32 h of "<id>:<run>", its code point
    h % length is taken out. Words of under ``shortest`` code points are left out. A null text has no runs; a null id counts as
    an empty text. Repeated rows count as often as they occur.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    run, size = F.translate("run", _UPPER, _LOWER), F.length("run")
    rows = rows.select(run.alias("run"), F.crc32(F.concat("id", F.lit(":"), run)).alias("h"))
    at = (F.col("h") % size).cast("int")
    word = F.when(F.col("h") % slip == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def _elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of some words one after the other, the word of each, and of each its element's hash and part; and the words' starts.

    Elements stand at the code points of their letter in the order they occur in the word."""
    texts = column.to_pylist()
    size = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word, start = np.repeat(np.arange(len(texts)), size), np.cumsum(size) - size
    key = word.astype(np.uint64) << np.uint64(21) | code
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    nth = np.empty(len(key), np.uint64)
    nth[order] = np.arange(len(key)) - first
    element = mix64(nth << np.uint64(21) | code)
    return code, word, start, element, (element % np.uint64(PARTS)).astype(np.int64)


def signatures(vocabulary: DataFrame) -> DataFrame:
    """(word, n, out, key): the signatures of each word, ``out`` the number of the two parts that are left out."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            _, word, _, element, of = _elements(batch.column("word"))
            sums = np.zeros((len(batch), PARTS), np.uint64)
            np.add.at(sums, (word, of), mix64(element + np.uint64(1)))
            keys = [mix64(sums.sum(axis=1) - sums[:, i] - sums[:, j] + _CHOICE[c]) for c, (i, j) in enumerate(_OUT)]
            every = np.repeat(np.arange(len(batch)), len(_OUT))
            out = np.tile(np.arange(len(_OUT), dtype=np.int8), len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(every)), batch.column("n").take(pa.array(every)), pa.array(out), pa.array(np.stack(keys, axis=1).ravel().view(np.int64))], ["word", "n", "out", "key"])

    return vocabulary.mapInArrow(part, "word string, n long, out byte, key long")


def _rests(rows: DataFrame) -> DataFrame:
    """(key, word, n): the words of full signatures by signature and rest, from rows (word, n, key, out)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            code, word, start, _, of = _elements(batch.column("word"))
            size = np.bincount(word, minlength=len(batch))
            value = mix64(code) * _powers(_BASE, int(size.max()) + 1)[1:][np.arange(len(code)) - start[word]]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
            whole = total[start + size] - total[start]
            before = total[:-1] - total[start][word]
            rest = before + (whole[word] - before - value) * _INVERSE
            # the element that a word loses with a letter is the last of its kind, so the letter counts by that one's part
            key = word.astype(np.uint64) << np.uint64(21) | code
            order = np.argsort(key, kind="stable")
            last = np.concatenate([key[order][1:] != key[order][:-1], [True]])
            group = np.cumsum(last) - last
            lost = np.empty(len(code), np.int64)
            lost[order] = of[order[last]][group]
            left_out = np.array(_OUT)[batch.column("out").to_numpy()]
            some = np.flatnonzero((lost == left_out[word, 0]) | (lost == left_out[word, 1]))
            owner = np.concatenate([word[some], np.arange(len(batch))])
            keys = mix64(np.concatenate([rest[some], whole]) + mix64(batch.column("key").to_numpy().view(np.uint64))[owner])
            order = np.lexsort((keys, owner))
            keys, owner = keys[order], owner[order]
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
            own = pa.array(owner[new])
            yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), batch.column("word").take(own), batch.column("n").take(own)], ["key", "word", "n"])

    return rows.mapInArrow(part, "key long, word string, n long")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): the pairs a < b of words of (word, n) that differ by one inserted, deleted or replaced code point, each once."""
    signed = stored(signatures(vocabulary))
    full = stored(signed.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > BUCKET).select("key", F.lit(True).alias("full")))
    told = signed.join(full.hint("merge"), "key", "left")
    rows = stored(told.where("full is null").select("key", "word", "n").unionByName(_rests(told.where("full").select("word", "n", "key", "out"))))
    a, b = (rows.select("key", F.col("word").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    met = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    pairs = stored(a.hint("merge").join(b.hint("merge"), (a["key"] == b["key"]) & met).select("a", "n_a", "b", "n_b").distinct())
    discard(signed, full, rows)
    return pairs


def variants(vocabulary: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each word of (word, n).

    ``form`` is the near word of largest n (ties: the smallest) if that n is at least ``times`` the word's own; ``root`` is the
    last of the chain of forms from a word, itself if it has none; n grows along a chain, so it ends. ``n_near`` counts near
    words. An empty vocabulary gives no rows.
    """
    vocabulary = stored(vocabulary)
    pairs = near_words(vocabulary)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("k")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("k"))))
    best = pairs.select(both.alias("p")).select("p.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("k")).alias("k"), "near")).alias("best"))
    is_form = -F.col("best.k") >= times * F.col("n")
    rows = vocabulary.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.k")).alias("form_n"))
    rows = stored(rows)
    # chains shorten by half each round; a word that is nobody's form is looked up by none, so only words with a form are held
    roots = stored(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        new = stored(roots.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")))
        discard(roots)
        roots = new.select("word", "root")
        roots._stored_at = new._stored_at
        if new.where("moved").isEmpty():
            break
    discard(pairs, vocabulary)
    return rows.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
