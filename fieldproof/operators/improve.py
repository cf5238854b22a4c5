"""What a run lacks and how it is filled: source summary, gaps, enrichment, catalog backfill, new candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldproof.functions.text import is_missing, js_round, truthy
from fieldproof.functions.urls import host, source_type
from fieldproof.operators.constraints import small
from fieldproof.operators.holding import all_holding, first_held, first_holding
from fieldproof.sources.tables import numbered, stored


#: Parts of a group that are ranked on their own before the best of them are.
PARTS = 64


def source_summary(evidence: DataFrame, top: int = 10) -> DataFrame:
    """(run_id, rank, domain, type, records, confirmed, reliability): the hosts a run cites most, ties by name."""
    bare = F.regexp_replace(F.lower(F.coalesce("source", F.lit(""))), "[^a-z0-9.]", "")
    domain = F.when(~truthy(F.col("url")), "web-source").otherwise(F.coalesce(host(F.col("url")), F.nullif(bare, F.lit("")), F.lit("source")))
    counts = evidence.groupBy("run_id", domain.alias("domain")).agg(F.count("*").alias("records"), F.count_if(F.col("verification") == "Confirmed").alias("confirmed"))
    best = [F.desc("records"), F.col("domain")]
    # the first of each of many parts of a run's hosts, and then of those
    part = F.row_number().over(Window.partitionBy("run_id", F.pmod(F.xxhash64("domain"), F.lit(PARTS))).orderBy(*best))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(*best))
    out = counts.withColumn("n", part).where(F.col("n") <= top).withColumn("rank", rank).where(F.col("rank") <= top)
    return out.select("run_id", "rank", "domain", source_type(F.col("domain")).alias("type"), "records", "confirmed", js_round(F.least(F.lit(99.0), F.greatest(F.lit(50.0), F.col("confirmed") * 100 / F.col("records")))).alias("reliability"))


def gap_report(verdicts: DataFrame, evals: DataFrame, records: DataFrame, constraints: DataFrame, top: int = 3, names: int = 8) -> DataFrame:
    """(run_id, rank, field, is_constraint, n_entities, entities): fields that most entities in need of verification lack.

    Fields of hard constraints come first. Names are distinct, sorted, at most ``names`` shown; the count is of all.
    """
    need = verdicts.where("status = 'Needs verification'").select("run_id", "record_id", "missing_fields")
    unknown = evals.where("result = 'UNKNOWN'").select("run_id", "record_id", "field").join(need.select("run_id", "record_id"), ["run_id", "record_id"], "left_semi")
    gaps = unknown.unionByName(need.select("run_id", "record_id", F.explode("missing_fields").alias("field"))).distinct()
    each = gaps.join(records.select("run_id", "record_id", "entity_name").hint("merge"), ["run_id", "record_id"]).select("run_id", "field", "entity_name").distinct()
    # the first names of each of many parts, and then of those: no field's names are one task's work
    part = each.withColumn("part", F.pmod(F.xxhash64("entity_name"), F.lit(PARTS)))
    first = F.row_number().over(Window.partitionBy("run_id", "field", "part").orderBy("entity_name"))
    some = part.withColumn("n", first).groupBy("run_id", "field", "part").agg(F.count("*").alias("m"), F.collect_list(F.when(F.col("n") <= names, F.col("entity_name"))).alias("e"))
    each = some.groupBy("run_id", "field").agg(F.sum("m").alias("n_entities"), F.slice(F.array_sort(F.flatten(F.collect_list("e"))), 1, names).alias("entities"))
    hard = small(constraints.where("hard").select("field").distinct().withColumn("is_constraint", F.lit(True)))
    each = each.join(hard, "field", "left").withColumn("is_constraint", F.coalesce("is_constraint", F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("is_constraint"), F.desc("n_entities"), "field"))
    return each.withColumn("rank", rank).where(F.col("rank") <= top).select("run_id", "rank", "field", "is_constraint", "n_entities", "entities")


def alnum(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")


def enrich(fields: DataFrame, names: DataFrame, found: DataFrame) -> DataFrame:
    """Values found later, given to the records they name: (run_id, record_id, field, value, url, verification).

    names(run_id, record_id, ingest_seq, entity_name); found(run_id, entity_name, field, value, url). A found row belongs to the first
    record of its run with an equal name by letters and digits, else to the first whose name holds it or is held by it. Only fields
    without a value (in ``fields``) are filled, by the first value in order of text. Equal names meet in a hash join; what is left
    meets by a part that both names have.
    """
    new = found.where(~is_missing(F.col("value")) & (F.lower("value") != "n/a")).withColumn("k", alnum(F.col("entity_name"))).where("k <> ''").select("run_id", "k", "field", "value", "url")
    have = names.withColumn("rk", alnum(F.col("entity_name"))).where("rk <> ''").groupBy("run_id", "rk").agg(F.min(F.struct("ingest_seq", "record_id")).alias("r"))
    have = stored(have)
    keys = new.select("run_id", "k").distinct()
    equal = keys.join(have, (keys["run_id"] == have["run_id"]) & (keys["k"] == have["rk"]), "inner").select(keys["run_id"], "k", "r")
    rest = stored(keys.join(equal.select("run_id", "k").hint("merge"), ["run_id", "k"], "left_anti"))
    # the first record whose name holds the found one, and the first whose name it holds
    around = first_holding(rest.select("run_id", F.col("k").alias("text")), have.select("run_id", F.col("rk").alias("holder"), "r")).withColumnRenamed("text", "k")
    inside = first_held(have.select("run_id", F.col("rk").alias("text"), "r"), rest.select("run_id", F.col("k").alias("holder"))).withColumnRenamed("holder", "k")
    near = around.unionByName(inside).groupBy("run_id", "k").agg(F.min("r").alias("r"))
    owner = equal.unionByName(near).select("run_id", "k", F.col("r.record_id").alias("record_id"))
    got = new.join(owner.hint("merge"), ["run_id", "k"]).groupBy("run_id", "record_id", "field").agg(F.min(F.struct("value", "url")).alias("v"))
    open_ = fields.where(is_missing(F.col("value"))).select("run_id", "record_id", "field")
    verified = F.when(truthy(F.col("url")), "Confirmed").otherwise("Needs verification")
    return got.join(open_.hint("merge"), ["run_id", "record_id", "field"], "left_semi").select("run_id", "record_id", "field", "v.value", "v.url").withColumn("verification", verified)


def new_candidates(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Existing and found candidates, without found ones whose trimmed lower-case name exists in the run; nameless ones stay."""
    name = F.lower(F.trim(F.coalesce("entity_name", F.lit(""))))
    known = existing.select("run_id", name.alias("n")).where("n <> ''").distinct()
    add = found.withColumn("n", name).join(known, ["run_id", "n"], "left_anti").drop("n")
    return existing.unionByName(add, allowMissingColumns=True)


def backfill(records: DataFrame, catalog: DataFrame, least: int) -> DataFrame:
    """Catalog entries (run_id, position, entity_name, provenance) that fill runs with fewer than ``least`` records.

    catalog(position, entity_name): entries whose name holds or is held by that of an earlier entry are left out once for all; then those
    whose name holds or is held by a record's name or its first word. Entries go in order until the run is full. Nothing is invented:
    without entries left a run stays short. Equal positions go by name; entries without a name are left out.

    Runs and catalog are never paired: the entries left get ranks, each short run learns the ranks it may not take, and the free ranks
    before, between and after these are read off as gaps, no more than the run needs.
    """
    low = lambda c: F.lower(F.trim(c))
    entries = numbered(catalog.select("position", "entity_name", low(F.col("entity_name")).alias("n")).where("n <> ''"), ["position", "n", "entity_name"], "at")
    # of the entries that a name holds or that hold it, the earliest tells whether it is left out
    names = stored(entries.groupBy("n").agg(F.min("at").alias("at")).select(F.lit(0).alias("run_id"), "n", F.struct("at").alias("r")))
    texts, wheres = names.select("run_id", F.col("n").alias("text"), "r"), names.select("run_id", F.col("n").alias("holder"), "r")
    first = first_holding(texts.select("run_id", "text"), wheres).select(F.col("text").alias("n"), "r").unionByName(first_held(texts, wheres.select("run_id", "holder")).select(F.col("holder").alias("n"), "r"))
    kept = entries.join(first.groupBy("n").agg(F.min("r.at").alias("first")).hint("merge"), "n").where(F.col("first") == F.col("at"))
    kept = stored(numbered(kept.select("at", "position", "entity_name", "n"), ["at"], "rank"))
    size = kept.count()
    short = stored(records.groupBy("run_id").agg(F.count("*").alias("have")).where(F.col("have") < least))
    # only runs that are short take part, so at most ``least`` names of each meet the catalog, each distinct one once
    seen = records.join(short.select("run_id").hint("merge"), "run_id").select("run_id", low(F.col("entity_name")).alias("s")).where("s <> ''")
    seen = stored(seen.select("run_id", F.explode(F.array_distinct(F.array("s", F.split_part("s", F.lit(" "), F.lit(1))))).alias("s")).where("s <> ''").distinct())
    taken = seen.join(all_alike(seen.select("s").distinct(), kept.select("n", "rank")).hint("merge"), "s").select("run_id", "rank").distinct()
    gaps = short.select("run_id", (F.lit(least) - F.col("have")).alias("wants")).join(taken.groupBy("run_id").agg(F.array_sort(F.collect_list("rank")).alias("no")).hint("merge"), "run_id", "left")
    no = F.concat(F.array(F.lit(0).cast("long")), F.coalesce("no", F.array().cast("array<long>")), F.array(F.lit(size + 1).cast("long")))
    # before the k-th excluded rank lie no[k] - k free ones, so a run needs no rank beyond wants + k
    free = F.flatten(F.transform(F.sequence(F.lit(1), F.size("no") - 1), lambda k: _between(F.get("no", k - 1) + 1, F.least(F.get("no", k) - 1, F.get("no", k - 1) + F.col("wants")))))
    ranks = gaps.withColumn("no", no).select("run_id", F.explode(F.slice(free, 1, F.col("wants").cast("int"))).alias("rank"))
    return ranks.join(kept.hint("merge"), "rank").select("run_id", "position", "entity_name", F.lit("CATALOG").alias("provenance"))


def _between(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<long>"))


def all_alike(names: DataFrame, entries: DataFrame) -> DataFrame:
    """(s, rank): which of entries(n, rank) hold or are held by each of names(s); both not empty."""
    one = lambda df, c, to: df.select(F.lit(0).alias("run_id"), F.col(c).alias(to))
    within = all_holding(one(entries, "n", "text"), one(names, "s", "holder")).select(F.col("holder").alias("s"), F.col("text").alias("n"))
    around = all_holding(one(names, "s", "text"), one(entries, "n", "holder")).select(F.col("text").alias("s"), F.col("holder").alias("n"))
    return within.unionByName(around).distinct().join(entries.select("n", "rank").hint("merge"), "n").select("s", "rank")
