"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on the set of a text's words (hashed) is trained in numpy from confirmed toxic
texts and unlabelled texts. With class prior ``pi``, logistic losses l+ and l-, the risk is

    pi * E_p[l+] + max(0, E_u[l-] - pi * E_p[l-])

(Kiryo, Niu, du Plessis, Sugiyama 2017). Where the second part falls below 0, its gradient is
followed upwards instead, which keeps the model from overfitting the unlabelled texts.

E_u runs over all texts of the training part, whatever their labels: one pass counts the texts of every
word, a second one turns each text into the words that tell the two sides apart, equal ones counted
together, and every step sums the gradient over that table in Spark. Confirmed texts are the only
sample: at most ``max_positive`` of them, those with the smallest hash of their id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldproof.llm.kit import SPACE, Words, pieces
from fieldproof.sources.tables import discard, stored

BITS = 21
#: Patterns that a task holds before it hands them on; parts of one that a sum over texts is rounded to.
HELD, SCALE = 100_000, 1 << 20


@dataclass
class Model:
    """Weights of the hashed words (``feature`` sorted) and the bias."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.feature] = self.weight
        return out


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each distinct word feature of each text in a piece."""
    text = np.repeat(np.arange(len(words.of) - 1), words.counts)
    pair = np.unique(text << BITS | (words.hash >> np.uint64(64 - BITS)).astype(np.int64))
    return pair >> BITS, pair & ((1 << BITS) - 1)


def _doc_frequency(rows: DataFrame) -> DataFrame:
    """(f, n): texts that have each word feature, over all rows of (text)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for _, _, data, offs in pieces(batch.column("text")):
                _, f = _distinct(Words(data, offs, SPACE))
                total += np.bincount(f, minlength=1 << BITS)
        f = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(total[f])], ["f", "n"])

    return rows.mapInArrow(part, "f int, n long").groupBy("f").agg(F.sum("n").alias("n"))


def _pattern(words: Words, telling: np.ndarray, texts: int) -> list[bytes]:
    """Of each text its telling features, as their numbers in order (int16, or int32 beyond)."""
    f = (words.hash >> np.uint64(64 - BITS)).astype(np.int64)
    at = np.searchsorted(telling, f)
    at[at == len(telling)] = 0
    some = np.flatnonzero(telling[at] == f)
    pair = np.unique((np.searchsorted(words.of, some, "right") - 1) << BITS | at[some])
    kind = "<i2" if len(telling) < 1 << 15 else "<i4"
    cut = np.searchsorted(pair, np.arange(texts + 1) << BITS)
    own = (pair & ((1 << BITS) - 1)).astype(kind)
    return [own[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _patterns(rows: DataFrame, telling: np.ndarray) -> DataFrame:
    """(p, n): distinct patterns of telling features and the texts that have them, over all rows of (text)."""
    shared = rows.sparkSession.sparkContext.broadcast(telling)  # at most 2 ** BITS features

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["p", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for i, j, data, offs in pieces(batch.column("text")):
                seen.update(_pattern(Words(data, offs, SPACE), shared.value, j - i))
            if len(seen) > HELD:
                yield flush(seen)
                seen = Counter()
        yield flush(seen)

    return rows.mapInArrow(part, "p binary, n long").groupBy("p").agg(F.sum("n").alias("n"))


class _Patterns:
    """Packed patterns as rows of a sparse matrix."""

    def __init__(self, packed: list[bytes], counts: np.ndarray, features: int):
        self.features = features
        kind = np.dtype("<i2" if features < 1 << 15 else "<i4")
        self.row = np.repeat(np.arange(len(packed)), [len(p) // kind.itemsize for p in packed])
        self.col = np.frombuffer(b"".join(packed), kind).astype(np.int64)
        self.n = counts

    def slopes(self, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        """Summed over the texts: the gradient of l- (weights, then bias), and l-."""
        z = np.bincount(self.row, w[self.col], len(self.n)) + bias
        up = self.n / (1 + np.exp(-np.clip(z, -40, 40)))
        return np.append(np.bincount(self.col, up[self.row], self.features), up.sum()), float((self.n * np.logaddexp(0, z)).sum())


def _slopes(table: DataFrame, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """``_Patterns.slopes`` over a table (p, n). Sums are of whole numbers, so that they do not depend on the order of tasks."""
    features = len(w)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(features + 2)
        for batch in batches:
            g, loss = _Patterns(batch.column("p").to_pylist(), batch.column("n").to_numpy().astype(np.float64), features).slopes(w, bias)
            total += np.append(g, loss)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.round(total[some] * SCALE).astype(np.int64))], ["i", "v"])

    out = np.zeros(features + 2)
    for r in table.mapInArrow(part, "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v / SCALE
    return out[:-1], float(out[-1])


def train(docs: DataFrame, labels: DataFrame, use: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = 3000, prior: float | None = None, steps: int = 60, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Fits a model on the rows of ``docs`` where ``use`` (of the id column) holds.

    Confirmed positives are rows whose id has ``label_col`` = 1 in ``labels``, of at most ``max_positive`` ids by
    a hash of the id and, where ids repeat, as many rows by a hash of the text; the unlabelled
    side is every row of the training part with a text, whatever its label, as the risk asks for. ``prior`` defaults to the share
    of positives among the labelled ids of the training part. With no positives or no texts the
    model scores 0 for every text. Null ids, texts and labels are passed over; an id that has
    both labels counts as positive. Repeated rows count as often as they stand there.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").withColumnRenamed("id", id_col).where(use).groupBy(F.col(id_col).alias("id")).agg(F.max("y").alias("y"))
    n_label, n_pos = marks.agg(F.count("*"), F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0))).first()
    pi = min(0.9, max(1e-4, n_pos / max(1, n_label) if prior is None else prior))
    rows = docs.where(use).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    n_texts = rows.count()
    frequency = stored(_doc_frequency(rows.select("text")))
    chosen = marks.where("y = 1").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(max_positive).select("id")
    confirmed = rows.join(F.broadcast(chosen), "id", "left_semi")
    confirmed = confirmed.orderBy(F.xxhash64("text", F.lit(1)), "text").limit(max_positive).select("text")  # a sample that no order of rows changes
    texts = sorted(r.text for r in confirmed.collect()) if n_pos and n_texts else []  # bounded; in an order of their own
    if not texts:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -40.0, pi)
    positive = Counter()
    col = pa.array(texts, pa.string())
    for _, _, data, offs in pieces(col):
        positive.update(_distinct(Words(data, offs, SPACE))[1].tolist())
    telling = _telling(frequency, positive, len(texts), n_texts)
    table = stored(_patterns(rows.select("text"), telling))
    packed = [p for i, j, data, offs in pieces(col) for p in _pattern(Words(data, offs, SPACE), telling, j - i)]
    model = _fit(_Patterns(packed, np.ones(len(packed)), len(telling)), table, n_texts, telling, pi, steps, rate, decay)
    discard(frequency, table)
    return model


def _telling(frequency: DataFrame, positive: Counter, n_pos: int, n_texts: int, errors: float = 4.0) -> np.ndarray:
    """Words whose share of texts differs between both sides by ``errors`` standard errors; others only add noise."""
    known = frequency.sparkSession.createDataFrame(sorted(positive.items()), "f int, a long")
    both = frequency.join(F.broadcast(known), "f", "left").withColumn("a", F.coalesce("a", F.lit(0)))
    a, b = F.col("a") / n_pos, F.col("n") / n_texts
    share = (F.col("a") + F.col("n") + 1) / (n_pos + n_texts + 2)
    found = both.where(F.abs(a - b) >= errors * F.sqrt(share * (1 - share) * (1 / n_pos + 1 / n_texts))).select("f")
    return np.array(sorted(r.f for r in found.collect()), np.int64)


def _fit(pos: _Patterns, table: DataFrame, n_texts: int, telling: np.ndarray, pi: float, steps: int, rate: float, decay: float) -> Model:
    n_pos = len(pos.n)
    w, bias = np.zeros(len(telling)), float(np.log(pi / (1 - pi)))
    m, v = np.zeros(len(telling) + 1), np.zeros(len(telling) + 1)
    ones = np.append(np.bincount(pos.col, minlength=len(telling)), n_pos) / n_pos
    for t in range(1, steps + 1):
        (g_u, l_u), (g_p, l_p) = _slopes(table, w, bias), pos.slopes(w, bias)
        rest, part = l_u / n_texts - pi * l_p / n_pos, g_u / n_texts - pi * g_p / n_pos
        # the derivative of l+ is that of l- less one
        grad = (pi * (g_p / n_pos - ones) + part if rest >= 0 else -part) + np.append(decay * w, 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(telling, w.astype(np.float32), float(bias), pi)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Toxicity of every whole text: rows (id_col, *keep, score in 0..1), one for each input row, no shuffle.

    Null and empty texts get the score of a text without words. Repeated rows are scored one by
    one. Other columns are ignored, but for ``keep``, whose columns are passed on unless they have
    a result's name. An empty table gives no rows.
    """
    keep = [c for c in keep or [] if c not in (id_col, "score", "_text")]
    rows = docs.select(F.col(id_col).alias("_id"), *keep, F.col(text_col).cast("string").alias("_text"))
    shared = rows.sparkSession.sparkContext.broadcast(model)  # at most 2 ** BITS features

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value.dense(), shared.value.bias
        for batch in batches:
            out = np.full(len(batch), bias)
            for i, j, data, offs in pieces(batch.column("_text")):
                words = Words(data, offs, SPACE)
                x = weight[(words.hash >> np.uint64(64 - BITS)).astype(np.int64)]
                some = np.flatnonzero(x)  # words without weight need no sorting
                text = np.searchsorted(words.of, some, "right") - 1
                pair, first = np.unique(text << BITS | (words.hash[some] >> np.uint64(64 - BITS)).astype(np.int64), return_index=True)
                out[i:j] += np.bincount(pair >> BITS, x[some][first], j - i)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "_text"), pa.array(1 / (1 + np.exp(-np.clip(out, -40, 40))))], [*(c for c in batch.schema.names if c != "_text"), "score"])

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(part, f"{base}, score double").withColumnRenamed("_id", id_col)
