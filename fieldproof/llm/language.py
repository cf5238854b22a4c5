"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is the elementwise product
(binding) of its letters' vectors, each rotated by its place in the n-gram (permutation). A text's
vector is the sum (bundle) of its n-gram vectors; a language's prototype is the bundle over all
training texts of that language. A text gets the language whose prototype has the largest cosine.

Bundling is linear, so n-grams are counted first and each distinct one is bound once. Prototypes
come from all training rows: tasks sum vectors by language and Spark adds the partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


N, DIM, SYMBOLS = 3, 1024, 1024
#: Texts longer than this many code points are counted in parts, so that memory stays bounded.
PART = 1 << 20
UNKNOWN = "und"
#: Languages that may be learned.
MOST = 10_000


def _letters(dim: int, n: int, seed: int = 17) -> list[np.ndarray]:
    """Vectors of the symbols, rotated for each place of an n-gram. Symbol 0 is the word boundary."""
    base = np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dim), np.int8) * 2 - 1
    return [np.roll(base, n - 1 - place, axis=1) for place in range(n)]


def _symbol_table() -> np.ndarray:
    """Code point (up to 0xFFFF) to symbol: letters keep apart, everything else is a boundary. Letters
    beyond the first 1023 code points share symbols by their remainder."""
    points = np.arange(0x10000)
    letter = np.array([chr(p).isalpha() for p in points])
    return np.where(letter, np.where(points < SYMBOLS, points, 1 + points % (SYMBOLS - 1)), 0).astype(np.int64)


class Encoder:
    def __init__(self, n: int = N, dim: int = DIM):
        self.n, self.dim = n, dim
        self.vectors = _letters(dim, n)
        self.symbol = _symbol_table()

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """(codes, counts) of the letter n-grams of a text, and whether it has a letter."""
        codes, counts, any_letter = [], [], False
        for i in range(0, len(text), PART):
            part = text[max(0, i - self.n + 1) : i + PART]
            points = np.frombuffer(part.lower().encode("utf-32-le", "replace"), np.uint32)
            high = points > 0xFFFF
            s = self.symbol[np.where(high, 0, points)]
            if high.any():
                for k in np.flatnonzero(high):
                    s[k] = 1 + points[k] % (SYMBOLS - 1) if chr(points[k]).isalpha() else 0
            any_letter |= bool(s.any())
            # runs of boundaries count as one
            s = np.concatenate([[0], s, [0]])
            s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
            if len(s) >= self.n:
                code = s[: len(s) - self.n + 1].copy()
                for j in range(1, self.n):
                    code = code * SYMBOLS + s[j : len(s) - self.n + 1 + j]
                c, k = np.unique(code, return_counts=True)
                codes.append(c)
                counts.append(k)
        if len(codes) > 1:
            c, back = np.unique(np.concatenate(codes), return_inverse=True)
            return c, np.bincount(back, np.concatenate(counts)), any_letter
        return (codes[0], counts[0].astype(float), any_letter) if codes else (np.zeros(0, np.int64), np.zeros(0), any_letter)

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dim, np.float64)
        for i in range(0, len(codes), 4096):
            c, k = codes[i : i + 4096], counts[i : i + 4096]
            bound = self.vectors[-1][c % SYMBOLS]
            for j in range(1, self.n):
                c = c // SYMBOLS
                bound = bound * self.vectors[-1 - j][c % SYMBOLS]
            out += k.astype(np.float32) @ bound.astype(np.float32)
        return out


def prototypes(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang", n: int = N, dim: int = DIM, most: int = MOST) -> dict[str, np.ndarray]:
    """Bundled n-gram vectors of each language over all rows of ``train``; rows without text or language are passed over.

    What reaches the driver is one vector for each language; with over ``most`` languages a ValueError is raised before that."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(n, dim)
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text")
            for lang in sorted(set(langs)):
                codes, counts = [np.zeros(0, np.int64)], [np.zeros(0)]
                for i in (i for i, x in enumerate(langs) if x == lang):
                    c, k, _ = enc.grams(texts[i].as_py())
                    codes.append(c)
                    counts.append(k)
                    if len(codes) > 256:
                        codes, counts = _joined(codes, counts)
                codes, counts = _joined(codes, counts)
                total[lang] = total.get(lang, 0) + enc.bundle(codes[0], counts[0])
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(v)], ["lang", "i", "v"])

    rows = train.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(part, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    if rows.select("lang").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} languages")
    for r in sums.collect():
        out.setdefault(r.lang, np.zeros(dim))[r.i] = r.v
    return dict(sorted(out.items()))


def _joined(codes: list, counts: list) -> tuple[list, list]:
    c, back = np.unique(np.concatenate(codes), return_inverse=True)
    return [c], [np.bincount(back, np.concatenate(counts), len(c))]


def identify(docs: DataFrame, learned: dict[str, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text", n: int = N, dim: int = DIM, keep: list[str] | None = None) -> DataFrame:
    """Language of every whole text: rows (id_col, *keep, lang_pred, score), one for each input row, no shuffle.

    ``score`` is the largest cosine, cut to 0..1. A null text, a text without a letter, and every
    text when nothing was learned, gets ``und`` with score 0. Equal cosines go to the language
    that sorts first. Repeated rows are judged one by one; other columns are ignored, but for
    ``keep``, whose columns are passed on unless they have a result's name. An empty table gives
    no rows.
    """
    keep = [c for c in keep or [] if c not in (id_col, "lang_pred", "score", "_text")]
    rows = docs.select(F.col(id_col).alias("_id"), *keep, F.col(text_col).cast("string").alias("_text"))
    names = list(learned)
    unit = np.array([v / (np.linalg.norm(v) or 1) for v in learned.values()]) if names else np.zeros((0, dim))
    shared = rows.sparkSession.sparkContext.broadcast((names, unit))  # a few vectors

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (langs, profile) = Encoder(n, dim), shared.value
        for batch in batches:
            pred, best = [], np.zeros(len(batch))
            texts = batch.column("_text")
            for i in range(len(batch)):
                codes, counts, letters = enc.grams(texts[i].as_py() or "")
                if not letters or not langs:
                    pred.append(UNKNOWN)
                    continue
                v = enc.bundle(codes, counts)
                cos = profile @ v / (np.linalg.norm(v) or 1)
                k = int(np.argmax(cos))
                pred.append(langs[k])
                best[i] = min(1.0, max(0.0, cos[k]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "_text"), pa.array(pred, pa.string()), pa.array(best)], [*(c for c in batch.schema.names if c != "_text"), "lang_pred", "score"])

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(score, f"{base}, lang_pred string, score double").withColumnRenamed("_id", id_col)
