"""Runs over time, and looking into them: comparison, summaries, pages, search, notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fieldproof.functions.text import js_round
from fieldproof.operators.ingest import sort_keys
from fieldproof.sources.tables import stored


def quality_summary(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Counters of each run: collected, qualified, needs_verification, conflicts, excluded, incomplete (with a missing field), mean
    completeness, quality. ``run_quality`` has the counters that a finished run keeps."""
    rows = records.select("run_id", "record_id").join(verdicts, ["run_id", "record_id"], "left")
    n = lambda s: F.count_if(F.col("status") == s)
    return rows.groupBy("run_id").agg(
        F.count("*").alias("collected"),
        n("Qualified").alias("qualified"),
        n("Needs verification").alias("needs_verification"),
        n("Conflict").alias("conflicts"),
        n("Excluded").alias("excluded"),
        F.count_if(F.size("missing_fields") > 0).alias("incomplete"),
        js_round(F.avg("completeness")).alias("completeness"),
        js_round(n("Qualified") * 100 / F.count("*")).alias("quality"),
    )


def run_quality(collected: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The counters of finished runs: (run_id, collected, unique, validated, duplicates, incomplete, conflicts, qualified,
    needs_verification, excluded).

    collected(run_id) has a row for each raw record, verdicts(run_id, record_id, status) one for each record left after merging. A
    record in need of verification counts as incomplete, whatever it lacks. A run without records left has zeros.
    """
    n = lambda s: F.count_if(F.col("status") == s)
    left = verdicts.groupBy("run_id").agg(F.count("*").alias("unique"), n("Qualified").alias("qualified"), n("Needs verification").alias("needs_verification"), n("Conflict").alias("conflicts"), n("Excluded").alias("excluded"))
    raw = collected.groupBy("run_id").agg(F.count("*").alias("collected"))
    c = lambda name: F.coalesce(name, F.lit(0).cast("long"))
    rows = raw.join(left.hint("merge"), "run_id", "left").select("run_id", "collected", *(c(x).alias(x) for x in left.columns[1:]))
    return rows.select("run_id", "collected", "unique", F.col("qualified").alias("validated"), (F.col("collected") - F.col("unique")).alias("duplicates"), F.col("needs_verification").alias("incomplete"), "conflicts", "qualified", "needs_verification", "excluded")


def coverage(verdicts_before: DataFrame, verdicts_after: DataFrame) -> DataFrame:
    """(run_id, before, after, recovered): share of qualified records before and after, and fields found in between."""
    one = lambda v, name: v.groupBy("run_id").agg(js_round(F.avg((F.col("status") == "Qualified").cast("int")) * 100).alias(name), F.sum(F.size("missing_fields")).alias(f"m_{name}"))
    return one(verdicts_before, "before").join(one(verdicts_after, "after"), "run_id").select("run_id", "before", "after", F.greatest(F.col("m_before") - F.col("m_after"), F.lit(0)).alias("recovered"))


def next_run_number(runs: DataFrame) -> DataFrame:
    """(request_id, run_number, run_id) for the next run of each request."""
    return runs.groupBy("request_id").agg((F.max("run_number") + 1).alias("run_number")).withColumn("run_id", F.concat(F.lit("RUN-"), F.col("request_id").cast("string"), F.lit("-v"), F.col("run_number").cast("string")))


def run_comparison(runs: DataFrame) -> DataFrame:
    """Each run against the one before it: deltas of unique, validated, conflicts and coverage; quality_delta is the size of the
    validated delta, quality_change its signed value. A first run is compared with 0, its coverage with 70."""
    w = Window.partitionBy("request_id").orderBy("run_number")
    cover = js_round(F.try_divide(F.col("validated") * 100.0, F.col("unique")))
    rows = runs.withColumn("coverage", F.coalesce(cover, F.lit(0)))
    before = lambda c, first: F.coalesce(F.lag(c).over(w), F.lit(first))
    delta = lambda c, first=0: (F.col(c) - before(c, first)).alias(f"{c}_delta")
    out = rows.select("request_id", "run_id", "run_number", "coverage", delta("unique"), delta("validated"), delta("conflicts"), delta("coverage", 70))
    return out.withColumns({"quality_change": F.col("validated_delta"), "quality_delta": F.abs("validated_delta")})


def latest_run(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """The active run of each request, else its newest; requests without runs have nulls."""
    rows = requests.select("request_id", "active_run_id").join(runs, "request_id", "left")
    w = Window.partitionBy("request_id").orderBy(F.desc(F.coalesce(F.col("run_id") == F.col("active_run_id"), F.lit(False))), F.desc("run_number"))
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def request_history(runs: DataFrame) -> DataFrame:
    """Runs of each request, newest first, with the change in validated records as text."""
    d = F.col("validated_delta")
    text = F.when(F.col("run_number") == 1, "First run").when(d > 0, F.concat(F.lit("+"), d.cast("string"), F.lit(" validated"))).when(d < 0, F.concat(d.cast("string"), F.lit(" validated"))).otherwise("No change")
    w = Window.partitionBy("request_id").orderBy(F.desc("run_number"))
    return run_comparison(runs).select("request_id", "run_id", "run_number", F.row_number().over(w).alias("position"), text.alias("change"))


def effective_status(qualification: Column, legacy: Column) -> Column:
    """The qualification status, else what a legacy status stands for."""
    old = F.when(legacy == "Verified", "Qualified").when(legacy == "Conflict", "Conflict").when(legacy == "Incomplete", "Excluded").otherwise("Needs verification")
    return F.coalesce(F.nullif(qualification, F.lit("")), old)


def legacy_status(qualification: Column) -> Column:
    return F.when(qualification == "Qualified", "Verified").when(qualification == "Conflict", "Conflict").when(qualification == "Excluded", "Incomplete").otherwise("Review")


def search_text(names: list[str], attributes: str = "attributes") -> Column:
    return F.lower(F.concat_ws(" ", *names, F.map_values(attributes)))


def dataset_filter(records: DataFrame, text: str | None = None, status: str | None = None, names: tuple[str, ...] = ("entity_name", "company", "role", "location", "source")) -> DataFrame:
    """Records of an effective status (columns qualification_status, status) whose names or attributes hold a text, without regard to case."""
    out = records.where(effective_status(F.col("qualification_status"), F.col("status")) == status) if status else records
    return out.where(F.contains(search_text(list(names)), F.lit(text.lower().strip()))) if text else out


def dataset_page(records: DataFrame, by: Column, key: str, descending: bool = False, page: int = 1, size: int = 10) -> DataFrame:
    """A page of records by any column: missing last in both directions, numbers before text; ties by key. Top-k, not a full sort."""
    k = sort_keys(by)
    way = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_last())
    ordered = records.withColumns({f"_{n}": c for n, c in k.items()}).orderBy(F.col("_missing"), F.col("_is_text"), way(F.col("_num")), way(F.col("_text")), F.col(key))
    return ordered.offset((page - 1) * size).limit(size).drop(*(f"_{n}" for n in k))


def _holds(text: str, *cols: str | Column) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", *cols)), F.lit(text.lower().strip()))


def request_hits(requests: DataFrame, text: str) -> DataFrame:
    """(kind, id, title): all requests whose name, id or prompt hold a text."""
    found = requests.where(_holds(text, "name", "request_id", "prompt"))
    return found.select(F.lit("request").alias("kind"), F.col("request_id").cast("string").alias("id"), F.col("name").alias("title"))


def search(requests: DataFrame, records: DataFrame, text: str, cap: int = 8) -> DataFrame:
    """(kind, id, title): requests and records that hold a text; of the records the first ``cap`` by run and id.

    A scan; ``lookup.indexed_search`` gives the same rows from a written index."""
    found = records.where(_holds(text, "entity_name", "role", F.concat_ws(" ", F.map_values("attributes")))).orderBy("run_id", "record_id").limit(cap)
    return request_hits(requests, text).unionByName(found.select(F.lit("record").alias("kind"), F.concat_ws("/", F.col("run_id").cast("string"), F.col("record_id").cast("string")).alias("id"), F.col("entity_name").alias("title")))


def notifications(runs: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """(id, run_id, kind, amount): each run completed; its conflicts and incomplete records if any; without ids already read."""
    note = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.cast("long").alias("amount"))
    feed = F.array(note("completed", F.col("collected")), F.when(F.col("conflicts") > 0, note("conflicts", F.col("conflicts"))), F.when(F.col("incomplete") > 0, note("incomplete", F.col("incomplete"))))
    out = runs.select("run_id", F.inline(F.array_compact(feed))).select(F.concat_ws("-", F.col("run_id").cast("string"), "kind").alias("id"), "run_id", "kind", "amount")
    return out.join(read.select("id").distinct().hint("merge"), "id", "left_anti") if read is not None else out


def overview(runs: DataFrame, evidence: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """One row: runs, requests, records collected, quality, runs with conflicts, distinct sources, share of evidence that is not waiting for verification,
    and with ``requests`` how many of them are running."""
    a = runs.agg(F.count("*").alias("runs"), F.count_distinct("request_id").alias("requests"), F.sum("collected").alias("collected"), js_round(F.try_divide(F.sum("validated") * 100.0, F.sum("unique"))).alias("quality"), F.count_if(F.col("conflicts") > 0).alias("runs_with_conflicts"))
    b = evidence.agg(F.count_distinct("source").alias("sources"), js_round(F.avg((F.col("verification") != "Needs verification").cast("int")) * 100).alias("evidence_coverage"))
    out = a.join(F.broadcast(b))  # one row each
    return out if requests is None else out.join(F.broadcast(requests.agg(F.count_if(F.col("status") == "running").alias("running"))))


def attention(summary: DataFrame, evidence: DataFrame) -> DataFrame:
    """(run_id, needs_verification, conflicts, incomplete, evidence_coverage): what asks for attention in each run of a ``quality_summary``;
    the coverage is the share of its evidence that is not waiting for verification, 0 without any."""
    cover = evidence.groupBy("run_id").agg(js_round(F.avg((F.col("verification") != "Needs verification").cast("int")) * 100).alias("evidence_coverage"))
    return summary.select("run_id", "needs_verification", "conflicts", "incomplete").join(cover, "run_id", "left").withColumn("evidence_coverage", F.coalesce("evidence_coverage", F.lit(0)))


def outcome_texts(summary: DataFrame, covered: DataFrame) -> DataFrame:
    """(run_id, outcomes, text): the counters of a ``quality_summary`` as (amount, label) pairs, and one sentence on the run; with
    recovered fields (``coverage``) it tells coverage before and after."""
    rows = summary.join(covered, "run_id")
    pair = lambda c, label: F.struct(F.col(c).cast("string").alias("amount"), F.lit(label).alias("label"))
    outcomes = F.array(pair("qualified", "Records qualified"), pair("needs_verification", "Needs verification"), pair("excluded", "Excluded"), pair("conflicts", "Conflicts detected"))
    better = F.format_string("Targeted searches for missing fields raised coverage from %d%% to %d%% (%d fields recovered). Final: %d qualified, %d needs verification, %d excluded, %d conflicts.", "before", "after", "recovered", "qualified", "needs_verification", "excluded", "conflicts")
    same = F.format_string("Collection ended with %d of %d records qualified (%d%% coverage). %d needs verification, %d excluded.", "qualified", "collected", "after", "needs_verification", "excluded")
    return rows.select("run_id", outcomes.alias("outcomes"), F.when(F.col("recovered") > 0, better).otherwise(same).alias("text"))


def newest(rows: DataFrame, at: str, key: str, n: int = 8) -> DataFrame:
    """The n newest rows, ties by the larger key. Top-k, not a full sort."""
    return rows.orderBy(F.desc(at), F.desc(key)).limit(n)


def drill_down(evidence: DataFrame, records: DataFrame) -> DataFrame:
    """Evidence with the name, company and status of its record; evidence of records that are gone has nulls."""
    of = records.select("run_id", "record_id", "entity_name", "company", "status")
    return evidence.join(of, ["run_id", "record_id"], "left")


def written_stages(stages: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, counts): the tables of a run, written in order of name, and counts(stage, rows), observed while they were written."""
    tables, rows = {}, []
    for name, df in sorted(stages.items()):
        seen = Observation()
        tables[name] = stored(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        rows.append((name, seen.get["rows"]))
    spark = next(iter(stages.values())).sparkSession
    return tables, spark.createDataFrame(rows, "stage string, rows long")


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, rows) of the tables of a run, in order of name."""
    return written_stages(stages)[1]


def evidence_from_source(evidence: DataFrame, name: str) -> DataFrame:
    """Evidence whose source starts with the first word of a name, without regard to case; "All" is every source."""
    words = name.lower().split()
    return evidence if name == "All" else evidence.where(F.startswith(F.lower("source"), F.lit(words[0] if words else "")))
