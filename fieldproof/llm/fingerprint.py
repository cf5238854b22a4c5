"""Homomorphic multiset fingerprints of texts, by column expressions only.

A fingerprint is a sum of wide vectors, one for each paragraph, so it does not depend on the order of paragraphs, and a
paragraph is added or taken out by adding or subtracting its vector (``plus``, ``minus``). A paragraph's vector has two parts:

* EQUAL words of 32 bits from the SHA-256 of the paragraph, summed modulo 2**32: texts with equal paragraphs, in any order,
  have equal sums, and others differ but for a chance of 2**-256.
* one bit for each of SIGNS hash bits of every sentence of the paragraph, summed modulo 2**31, two to a 64-bit word (no text has
  so many sentences that a sum reaches that). With the number of sentences they give sums of signs, whose cosine estimates how much
  of their sentences two texts share, with a standard error of about 1 / sqrt(SIGNS) (Alon, Matias, Szegedy 1996).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EQUAL = 8
HASHES = 4
LANES, LANE_BITS = 2, 31
SIGNS = HASHES * LANES * LANE_BITS
PARAGRAPH_END = r"[\x0A-\x0D]+"
SENTENCE_END = r"[\x20\x09]*[.!?\x0A-\x0D][.!?\x20\x09-\x0D]*"

_ONE = sum(1 << LANE_BITS * i for i in range(LANES))
_LOW32, _LANE = (1 << 32) - 1, (1 << LANE_BITS) - 1


def _parts(text: Column, end: str) -> Column:
    return F.filter(F.split(text, end, -1), lambda p: p != "")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), f), 0)


def _digits(digest: Column, at: int, n: int) -> Column:
    """The signed 64-bit number of n hexadecimal digits."""
    return F.conv(F.substring(digest, at * n + 1, n), 16, -10).cast("long")


def _item(i: int) -> Callable[[Column], Column]:
    return lambda row: F.get(row, i)


def _numbers(parts: Column, k: int, digits: int) -> Column:
    """Of each part the first k numbers of its digest."""
    return F.transform(parts, lambda p: _let(F.sha2(p, 256), lambda d: F.array(*(_digits(d, i, digits) for i in range(k)))))


def _zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), n)


def _added(a: Column, b: Column, sign: int, room: Column) -> Column:
    """Element by element a + b or a - b, in the bits of ``room``."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(room))


def vector(text: Column) -> Column:
    """The fingerprint of a text (null: as empty) as struct<equal array<long>, signs array<long>, n long>."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    equal = F.aggregate(_numbers(_parts(text, PARAGRAPH_END), EQUAL, 8), _zeros(EQUAL), lambda a, w: _added(a, w, 1, F.lit(_LOW32).cast("long")))
    bits = lambda x, s: F.call_function("shiftrightunsigned", x, s).bitwiseAND(F.lit(_ONE).cast("long"))
    shifts = F.array(*(F.lit(i) for i in range(LANE_BITS)))
    summed = lambda xs: F.transform(shifts, lambda s: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + bits(x, s)))
    signs = lambda rows: F.concat(*(_let(F.transform(rows, _item(i)), summed) for i in range(HASHES)))
    return _let(_numbers(_parts(text, SENTENCE_END), HASHES, 16), lambda rows: F.struct(equal.alias("equal"), signs(rows).alias("signs"), F.size(rows).cast("long").alias("n")))


def _combined(a: Column, b: Column, sign: int) -> Column:
    lanes = lambda x, y: sum((((F.shiftrightunsigned(x, LANE_BITS * i).bitwiseAND(_LANE) + sign * F.shiftrightunsigned(y, LANE_BITS * i).bitwiseAND(_LANE)).bitwiseAND(_LANE)) * (1 << LANE_BITS * i) for i in range(LANES)), F.lit(0).cast("long"))
    return F.struct(_added(a["equal"], b["equal"], sign, F.lit(_LOW32).cast("long")).alias("equal"), F.zip_with(a["signs"], b["signs"], lanes).alias("signs"), (a["n"] + sign * b["n"]).alias("n"))


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of all paragraphs of both."""
    return _combined(a, b, 1)


def minus(a: Column, b: Column) -> Column:
    """The fingerprint of what is left of a without the paragraphs of b, all of which a has."""
    return _combined(a, b, -1)


def written(v: Column) -> Column:
    """A fingerprint as text: its sums in hexadecimal."""
    return F.concat(F.array_join(F.transform(v["equal"], lambda x: F.lpad(F.hex(x), 8, "0")), ""), F.lit(":"), F.array_join(F.transform(v["signs"], lambda x: F.hex(x)), "."), F.lit(":"), v["n"].cast("string"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of the sums of signs."""
    signed = lambda x, n, i: 2 * F.shiftrightunsigned(x, LANE_BITS * i).bitwiseAND(F.lit(_LANE).cast("long")) - n
    products = F.zip_with(a["signs"], b["signs"], lambda x, y: sum(signed(x, a["n"], i) * signed(y, b["n"], i) for i in range(LANES)))
    return F.aggregate(products, F.lit(0).cast("long"), lambda s, p: s + p)


def likeness(ab: Column, aa: Column, bb: Column, equal: Column) -> Column:
    """0 to 1 from inner products: 1 for equal fingerprints, else the cosine of the sums of signs, at least 0."""
    norm = F.sqrt(aa.cast("double") * bb.cast("double"))
    cosine = F.when(norm > 0, ab.cast("double") / norm).otherwise(0.0)
    return F.when(equal, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine)))


def with_next(docs: DataFrame, id_col: str, text_col: str, cells: int) -> DataFrame:
    """(id, text, next, cell, ...) of all rows in ascending order of id; after the last comes the first.

    A pass over ids and digests cuts the order into ``cells`` ranges of about as many rows; then each text goes to the task of
    its range, the first one of a range also to the range before, whose last text it follows. No range is one task's work for
    all rows, and a text is moved once.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    place = F.struct("id", "digest")
    ranges = rows.select("id", "digest").repartitionByRange(cells, "id", "digest").select(F.spark_partition_id().alias("p"), place.alias("place"))
    first = [r.place for r in ranges.groupBy("p").agg(F.min("place").alias("place")).orderBy("place").collect()]  # at most ``cells`` rows
    kind = rows.schema["id"].dataType
    starts = F.array(*(F.struct(F.lit(p.id).cast(kind).alias("id"), F.lit(p.digest).cast("long").alias("digest")) for p in first)) if first else F.array(F.struct(F.lit(None).cast(kind).alias("id"), F.lit(0).cast("long").alias("digest")))
    cell = F.greatest(F.size(F.filter(starts, lambda s: s <= place)) - 1, F.lit(0))
    opens = F.array_contains(starts, place)
    homes = F.when(opens, F.array(F.struct(F.col("c").alias("cell"), F.lit(False).alias("ghost")), F.struct(F.pmod(F.col("c") - 1, F.lit(max(1, len(first)))).alias("cell"), F.lit(True).alias("ghost")))).otherwise(F.array(F.struct(F.col("c").alias("cell"), F.lit(False).alias("ghost"))))
    return rows.withColumn("c", cell).withColumn("home", F.explode(homes)).select("id", "text", "digest", "home.cell", "home.ghost").repartition(cells, "cell")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of whole texts and of their edited texts: rows (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next), one for each input row.

    The edited text has the last n_chars // 2 code points replaced by as many of the first (or all) of the next row's text, in
    ascending order of id (null first; of equal ids by a digest of the text, then the text; after the last row the first).
    A null text is empty; an empty text has no paragraphs, and is like another empty one (1) but like no other text (0). A
    table of one row has itself as next. Repeated rows are taken one by one. An empty table gives no rows; other columns are
    ignored, also such with the names of results.
    """
    cells = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("cell").orderBy("ghost", F.col("id").asc_nulls_first(), "digest", "text")
    rows = with_next(docs, id_col, text_col, cells).withColumn("v", vector(F.col("text"))).withColumn("vv", dot(F.col("v"), F.col("v")))
    ahead = F.lead(F.struct("text", "v", "vv")).over(order)
    rows = rows.withColumn("ahead", ahead).where(~F.col("ghost"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("ahead.text", F.lit(1), half))
    rows = rows.select("id", n.cast("long").alias("n_chars"), "v", "vv", "ahead", edited.alias("edited")).withColumn("e", vector(F.col("edited")))
    v, e, w = F.col("v"), F.col("e"), F.col("ahead.v")
    return rows.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(v).alias("fingerprint"), written(e).alias("edited_fingerprint"),
        likeness(dot(v, e), F.col("vv"), dot(e, e), v == e).alias("near_edited"), likeness(dot(v, w), F.col("vv"), F.col("ahead.vv"), v == w).alias("near_next"),
    )
