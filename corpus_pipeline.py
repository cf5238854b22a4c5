"""A training-corpus pipeline: five of the operators in a row, each on all that the one before kept."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldproof.llm import decontam, language, mixing, near_dedup, sharding
from fieldproof.llm.kit import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 8
LEAST_COSINE, SHORT = 4 / language.DIM**0.5, 20
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def of_known_language(found: DataFrame) -> DataFrame:
    """Rows of language.identify (with the text kept) whose text has a letter and is like what was learned.

    The cosine of a text that shares nothing with a profile spreads around 0 with a deviation of 1 / sqrt(DIM). A text whose
    largest cosine stays below four of these is dropped, but for texts of under SHORT letters: too few for the cosine to tell.
    """
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & ((F.col("score") >= LEAST_COSINE) | (letters < SHORT)))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without text or letters, and those that are like no learned language (``of_known_language``).

    Profiles are learned from the documents with a stated language; without any, every document with a letter stays. Repeated
    rows are judged one by one.
    """
    learned = language.prototypes(docs)
    if not learned:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    return of_known_language(language.identify(docs, learned, keep=COLUMNS[1:])).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-duplicates (five words, 0.8), once.

    Documents without words have no duplicates. Rows without a doc_id are dropped. Of several rows of a kept id the one with the
    largest text stays (null is smallest; ties by the other columns).
    """
    kept = near_dedup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id")
    rows = docs.select(*COLUMNS).join(kept.hint("shuffle_hash"), "doc_id", "left_semi")
    one = F.max(F.struct("text", *(c for c in COLUMNS if c not in ("doc_id", "text"))))
    return rows.groupBy("doc_id").agg(one.alias("r")).select("doc_id", "r.*").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item. Repeated rows are judged one by one."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.contamination(docs, benchmark, keep=COLUMNS[1:]).where("n_hit = 0").select(*COLUMNS)


def first_words(rows: DataFrame) -> DataFrame:
    """Texts cut after their first ``part`` words (as the mix counts words), with the n_chars of what is left."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, n in zip(batch.column("text"), batch.column("part").to_pylist(), strict=True):
                t, end = text.as_py(), 0
                for m in itertools.islice(WORD.finditer(t), n):
                    end = m.end()
                texts.append(t[:end])
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return rows.mapInArrow(cut, rows.schema).withColumn("n_chars", F.length("text").cast(rows.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does: not at all, once, or up to three times as repeated rows.

    A document of which the mix takes a part of one more copy gives one more row with the first words of its text, as many as
    the mix takes. Rows with equal doc_ids are taken alike.
    """
    mixed = mixing.mix(docs, F.array("source"))
    most = F.max(F.struct("times", (F.col("taken") - F.col("size") * F.col("times")).cast("int").alias("part")))
    times = stored(mixed.where("taken > 0 or times > 0").groupBy(F.col("doc_id").alias("id")).agg(most.alias("m")).select("id", "m.*"))
    taken = lambda t: docs.select(*COLUMNS).join(t.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")))
    whole = taken(times.where("times > 0")).withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)
    return whole.unionByName(first_words(taken(times.where("part > 0")).select(*COLUMNS, "part")).select(*COLUMNS))


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts every row into one of SHARDS shards of nearly equal bytes, with a gapless slot in it."""
    return sharding.shard(docs, SHARDS, keep=COLUMNS[1:])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: The stages learn, hash and route; SQL does not express them. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
