"""Which text first holds which: equi-joins on rare parts, and a multi-pattern automaton for texts without one.

A text of PART or more characters meets the holders of that one of its parts that the fewest have, as long as these are at most
MEET. All other texts, the short ones and those whose every part is common, are looked for by an Aho-Corasick automaton: blocks of
PATTERNS bytes of texts of a run go over blocks of HOLDERS bytes of its holders, best rank first, and only the best finding of each
text in a block leaves a task. So the rows made are linear in the size of the texts, however many holders a short text has.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldproof.sources.tables import stored

#: Characters of a part, and the most holders by which a part is met.
PART, MEET = 5, 64
#: Bytes of the texts that one automaton holds, and of the holders that a task takes it over.
PATTERNS, HOLDERS = 1 << 19, 8 << 20


def _parts(text: Column) -> Column:
    """The distinct parts of a text of PART or more characters; none of a shorter one."""
    last = F.length(text) - PART + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(PART))))).otherwise(F.array().cast("array<string>"))


def _key(row: dict | None) -> tuple:
    return tuple((v is not None, v) for v in (row or {}).values())


def first_holding(texts: DataFrame, wheres: DataFrame) -> DataFrame:
    """(run_id, text, r): for each text of texts(run_id, text) the least rank r of those wheres(run_id, holder, r) of its run that hold it.

    ``r`` is a struct. Null texts and holders take no part, an empty text is held by all; repeated rows make no difference. Texts
    that nothing holds are left out.
    """
    need, have = _distinct(texts, wheres, "r")
    return _best(need, have, "text")


def first_held(texts: DataFrame, wheres: DataFrame) -> DataFrame:
    """(run_id, holder, r): for each holder of wheres(run_id, holder) the least rank r of those texts(run_id, text, r) of its run that it holds."""
    need, have = _distinct(texts, wheres, "")
    return _best(need, have, "holder")


def all_holding(texts: DataFrame, wheres: DataFrame) -> DataFrame:
    """(run_id, text, holder): every pair of a text of texts(run_id, text) and one of wheres(run_id, holder) of its run that holds it, once.

    For results that are pairs; by the automaton alone. Empty and null texts and null holders take no part."""
    need, have = texts.where("text <> ''").distinct(), wheres.where("holder is not null").distinct()
    return _scanned(stored(need), stored(have), "pair")


def _distinct(texts: DataFrame, wheres: DataFrame, on_holders: str) -> tuple[DataFrame, DataFrame]:
    need, have = texts.where("text is not null"), wheres.where("holder is not null")
    one = lambda df, c, ranked: df.groupBy("run_id", c).agg(F.min("r").alias("r")) if ranked else df.select("run_id", c).distinct()
    need, have = one(need, "text", not on_holders), one(have, "holder", bool(on_holders))
    return stored(need), stored(have.withColumn("h", F.xxhash64("holder")))


def _best(need: DataFrame, have: DataFrame, of: str) -> DataFrame:
    grams = have.select("run_id", "h", F.explode(_parts(F.col("holder"))).alias("part"))
    often = grams.groupBy("run_id", "part").agg(F.count("*").alias("n"))
    own = need.where(F.length("text") >= PART).select("run_id", "text", F.explode(_parts(F.col("text"))).alias("part"))
    # a part that no holder has counts as rarest and meets nothing
    rare = own.join(often.hint("merge"), ["run_id", "part"], "left").groupBy("run_id", "text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part")).alias("p"))
    rare = stored(rare.select("run_id", "text", "p.n", "p.part"))
    met = rare.where((F.col("n") > 0) & (F.col("n") <= MEET)).select("run_id", "text", "part").join(grams.hint("merge"), ["run_id", "part"]).select("run_id", "text", "h")
    met = met.join(have.hint("merge"), ["run_id", "h"]).where(F.contains("holder", F.col("text")))
    if of == "holder":
        met = met.join(need.hint("merge"), ["run_id", "text"])
    common = rare.where(F.col("n") > MEET).select("run_id", "text")
    rest = need.where(F.length("text") < PART).unionByName(need.join(common.hint("merge"), ["run_id", "text"], "left_semi"))
    found = met.select("run_id", of, "r").unionByName(_scanned(rest, have, of))
    return found.groupBy("run_id", of).agg(F.min("r").alias("r"))


def _scanned(need: DataFrame, have: DataFrame, of: str) -> DataFrame:
    """Best findings (run_id, text or holder, r) of each pair of blocks."""
    blocks = lambda df, c, size, name: df.groupBy("run_id").agg(F.ceil((F.sum(F.octet_length(c)) + 1) / size).cast("int").alias(name))
    sizes = stored(blocks(need, "text", PATTERNS, "m").join(blocks(have, "holder", HOLDERS, "n").hint("merge"), "run_id"))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = need.join(sizes.hint("merge"), "run_id").withColumn("i", part("text", "m")).withColumn("j", every("n")).drop("m", "n")
    right = have.select("run_id", "holder", *(["r"] if "r" in have.columns else [])).join(sizes.hint("merge"), "run_id").withColumn("j", part("holder", "n")).withColumn("i", every("m")).drop("m", "n")
    run = f"run_id {have.schema['run_id'].dataType.simpleString()}"
    schema = f"{run}, text string, holder string" if of == "pair" else f"{run}, {of} string, r {(have if of == 'text' else need).schema['r'].dataType.simpleString()}"

    def scan(key: tuple, patterns: pa.Table, holders: pa.Table) -> pa.Table:
        texts, wheres = patterns.column("text").to_pylist(), holders.column("holder").to_pylist()
        everywhere = [i for i, t in enumerate(texts) if not t]
        machine = ahocorasick.Automaton()
        for i, t in enumerate(texts):
            if t:
                machine.add_word(t, i)
        machine.make_automaton()
        hits = lambda w: (*everywhere, *(i for _, i in machine.iter(w))) if len(machine) else everywhere
        run = holders.schema.field("run_id").type
        if of == "pair":
            out = [(texts[i], w) for w in wheres for i in set(hits(w))]
            return pa.table([pa.array([key[0].as_py()] * len(out), run), *(pa.array([o[n] for o in out], pa.string()) for n in range(2))], ["run_id", "text", "holder"])
        rank = (holders if of == "text" else patterns).column("r").to_pylist()
        best: dict[int, int] = {}
        if of == "text":
            for j in sorted(range(len(wheres)), key=lambda j: _key(rank[j])):
                for i in hits(wheres[j]):
                    best.setdefault(i, j)
                if len(best) == len(texts):
                    break
            out = [(texts[i], rank[j]) for i, j in best.items()]
        else:
            place = {i: k for k, i in enumerate(sorted(range(len(texts)), key=lambda i: _key(rank[i])))}
            for j, w in enumerate(wheres):
                got = min(hits(w), key=place.__getitem__, default=None)
                if got is not None:
                    best[j] = got
            out = [(wheres[j], rank[i]) for j, i in best.items()]
        kind = (holders if of == "text" else patterns).schema.field("r").type
        return pa.table([pa.array([key[0].as_py()] * len(out), run), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], kind)], ["run_id", of, "r"])

    keys = ["run_id", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda k, a, b: scan(k, a, b), schema)
