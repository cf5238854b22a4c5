"""Reading and writing the tables of a run."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EVIDENCE = "array<struct<field:string,value:string,source:string,url:string,retrieved:string,snippet:string,verification:string>>"
CONFLICTS = "array<struct<field:string,values:array<struct<source:string,value:string,url:string,retrieved:string,snippet:string>>>>"
SNAPSHOT = f"""
    requests array<struct<id:string,name:string,prompt:string,status:string,activeRunId:string,createdAt:string>>,
    runs array<struct<id:string,requestId:string,runNumber:int,createdAt:string,
        records:array<struct<id:string,entityName:string,attributes:map<string,string>,company:string,role:string,location:string,
            experience:string,salary:string,size:string,source:string,confidence:int,status:string,evidence:{EVIDENCE},conflicts:{CONFLICTS}>>>>
"""


#: Held while a table is written: what a write shuffled is released with it, and Python workers get batches of bounded size.
SESSION = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}

#: Rows of a shuffle that one task reads, about, where a table says how many it shuffles.
TASK_ROWS = 1 << 18
#: Pairs of a range and a group in it that are sent to all tasks (``numbered``).
SPANS = 100_000

#: Folders of written tables, innermost owner last. The outermost list is emptied when the process ends.
_OWNED: list[list[tuple[SparkSession, str]]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: that of spark.checkpoint.dir. A temporary one only where Spark runs in one process."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(base)
    return base


@contextmanager
def options(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session options that hold inside the block and are put back after it."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def scratch(spark: SparkSession) -> str:
    """A new folder for a written table, removed by the owner of the moment (``owner``), or when the process ends."""
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    _OWNED[-1].append((spark, path))
    return path


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


@contextmanager
def owner() -> Iterator[None]:
    """Owns the tables written inside the block: they are removed when it ends, but for those given to ``release``.

    What a query returns is worked out when it is used, so use it inside the block."""
    _OWNED.append([])
    try:
        yield
    finally:
        for spark, path in _OWNED.pop():
            _remove(spark, path)


def release(*written: DataFrame) -> None:
    """Hands tables that ``stored`` has written to the owner around the present one."""
    for df in written:
        path = df.__dict__.get("_stored_at")
        for entry in [e for e in _OWNED[-1] if e[1] == path]:
            _OWNED[-1].remove(entry)
            _OWNED[max(0, len(_OWNED) - 2)].append(entry)


@atexit.register
def _at_exit() -> None:
    for owned in _OWNED:
        for spark, path in owned:
            with suppress(Exception):  # the session may have been stopped before
                _remove(spark, path)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Parts of a shuffle of so many rows: those of the session, or more, so that a task does not read more as rows get more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS)


def stored(df: DataFrame, rows: int = 0) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors. ``rows``: how many it shuffles, if known."""
    spark = df.sparkSession
    path = scratch(spark)
    parts = {"spark.sql.shuffle.partitions": str(tasks_for(spark, rows))} if rows else {}
    with options(spark, SESSION | parts):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The written table of ``make()``; all tables written on the way to it are removed."""
    with owner():
        out = stored(make())
        release(out)
    return out


def discard(*written: DataFrame) -> None:
    """Removes tables that ``stored`` has written and that nothing reads any more."""
    for df in written:
        if path := df.__dict__.pop("_stored_at", None):
            _remove(df.sparkSession, path)
            for owned in _OWNED:
                owned[:] = [e for e in owned if e[1] != path]


def numbered(df: DataFrame, order: list, name: str, by: list[str] = ()) -> DataFrame:
    """Rows with their number from 1 in the given order, over the whole table or in each group of ``by``; ties in any order.

    Two passes instead of a window in one task: rows are dealt out by ranges of the order and numbered inside their range, then
    the sizes of the ranges before (one row for each task) and, with ``by``, the first number of each group are put in. A group
    with all rows is spread over all tasks.
    """
    key = [F.col(c) if isinstance(c, str) else c for c in (*by, *order)]
    dealt = stored(df.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).collect()  # one row for each task
    before, starts = 0, []
    for r in sorted(sizes):
        starts.append((r._part, before))
        before += r._n
    starts = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    rows = dealt.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1)
    if by:
        # each range of a group learns the group's first number: the join is on range and group, so it does not gather a group; there
        # are about as many such pairs as ranges and groups together, and where these are few no row is shuffled for them
        spans = rows.groupBy("_part", *by).agg(F.min("_at").alias("_from")).withColumnsRenamed({c: f"_{c}" for c in by})
        first = spans.withColumn("_first", F.min("_from").over(Window.partitionBy(*(f"_{c}" for c in by)))).withColumnRenamed("_part", "_range")
        first = stored(first)
        few = F.broadcast(first) if first.count() <= SPANS else first.hint("merge")
        rows = rows.join(few, [F.col("_part") == F.col("_range"), *(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by)])
        rows = rows.withColumn("_at", F.col("_at") - F.col("_first") + 1)
    return rows.select(*df.columns, F.col("_at").alias(name))


def read_snapshot(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """Tables requests, runs, records, evidence and conflicts of nested JSON stores: one in each file, or one in each line."""
    return split_snapshot(spark.read.schema(SNAPSHOT).json(path, multiLine=multi_line))


def nested_records(root: DataFrame) -> DataFrame:
    """The records of nested stores as they are nested, with run_id, ingest_seq, and request_id and request (its name) of their run.

    Nothing is joined: each store is read once, and a run's request is looked for in its own store; runs without one are left out."""
    of = lambda r: F.filter("requests", lambda q: q["id"] == r)
    runs = root.select("requests", F.explode("runs").alias("r")).select("r", F.explode(of(F.col("r.requestId"))).alias("q"))
    rows = runs.select(F.col("q.id").alias("request_id"), F.col("q.name").alias("request"), F.col("r.id").alias("run_id"), F.posexplode("r.records").alias("i", "x"))
    return rows.select("request_id", "request", "run_id", F.col("i").cast("long").alias("ingest_seq"), "x.*").withColumnsRenamed({"id": "record_id", "entityName": "entity_name"})


def split_snapshot(root: DataFrame) -> dict[str, DataFrame]:
    runs = root.select(F.explode("runs").alias("r"))
    records = runs.select(F.col("r.id").alias("run_id"), F.posexplode("r.records").alias("i", "x")).select("run_id", F.col("i").cast("long").alias("ingest_seq"), "x.*").withColumnRenamed("id", "record_id").withColumnRenamed("entityName", "entity_name")
    return {
        "requests": root.select(F.inline("requests")).withColumnRenamed("id", "request_id").withColumnRenamed("activeRunId", "active_run_id").withColumnRenamed("createdAt", "created_at"),
        "runs": runs.select(F.col("r.id").alias("run_id"), F.col("r.requestId").alias("request_id"), F.col("r.runNumber").alias("run_number"), F.col("r.createdAt").alias("created_at")),
        "records": records.drop("evidence", "conflicts"),
        "evidence": records.select("run_id", "record_id", F.posexplode("evidence").alias("ev_seq", "e")).select("run_id", "record_id", "ev_seq", "e.*"),
        "conflicts": records.select("run_id", "record_id", F.inline("conflicts")),
    }


def with_ids(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of runs with ids of their own: {run}-SRC-n for sources (by search_rank, url), {record}-EV-n and {record}-CONF-n for
    evidence (by ev_seq) and conflicts (by field). Sources of a run are numbered in two passes, citations of a record in a window."""
    n = lambda *order: F.row_number().over(Window.partitionBy("run_id", "record_id").orderBy(*order)).cast("string")
    text = F.col("record_id").cast("string")
    rules = {
        "sources": lambda df: numbered(df, ["search_rank", "url"], "id", ["run_id"]).withColumn("id", F.concat("run_id", F.lit("-SRC-"), F.col("id").cast("string"))),
        "evidence": lambda df: df.withColumn("id", F.concat(text, F.lit("-EV-"), n("ev_seq"))),
        "conflicts": lambda df: df.withColumn("id", F.concat(text, F.lit("-CONF-"), n("field"))),
    }
    return {name: rules[name](df) if name in rules else df for name, df in tables.items()}


_MANIFEST = "run_id string, version long, folder string"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, version, folder): where each run was written, all versions; no rows before the first write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    there = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest") if there else spark.createDataFrame([], _MANIFEST)


def write_run(tables: dict[str, DataFrame], path: str) -> None:
    """Publishes runs as one: all their tables go to a new folder, partitioned by run_id, and only then one file names that folder
    for these runs. A reader sees a run as it was before or as it is now, never a part; a write that breaks off is never seen.

    Runs that are not in ``tables`` stay as they are. The columns of a table are written beside it, as one without rows leaves no file
    to read them from. Folders of older versions stay for readers that have begun; ``vacuum_runs`` removes them.
    """
    spark = next(iter(tables.values())).sparkSession
    folder = uuid.uuid4().hex
    written = []
    for name, df in with_ids(tables).items():
        spark.createDataFrame([(df.schema.json(),)], "columns string").coalesce(1).write.text(f"{path}/{folder}/columns/{name}")
        (df.write.partitionBy("run_id") if "run_id" in df.columns else df.write).parquet(f"{path}/{folder}/{name}")
        if "run_id" in df.columns:
            written.append(spark.read.schema(df.schema).parquet(f"{path}/{folder}/{name}"))
    version = (_manifest(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    # which runs these are is told by the folders written: the tables are not worked out again
    ids = [df.select(F.col("run_id").cast("string")).distinct() for df in written]
    runs = reduce(DataFrame.union, ids).distinct()
    runs.select("run_id", F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder")).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def run_tables(spark: SparkSession, path: str, run_id: str) -> dict[str, DataFrame]:
    """The tables of the newest version of a run, by partition-pruned reads; none if it was never written."""
    newest = _manifest(spark, path).where(F.col("run_id") == run_id).agg(F.max_by("folder", "version")).first()[0]
    if newest is None:
        return {}
    named = spark.read.text(f"{path}/{newest}/columns/*").select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("name"))
    columns = {r.name: StructType.fromJson(json.loads(r.value)) for r in named.collect()}  # one row for each table
    read = lambda name: spark.read.schema(columns[name]).parquet(f"{path}/{newest}/{name}")
    return {name: read(name).where(F.col("run_id") == run_id) if "run_id" in kind.names else read(name) for name, kind in columns.items()}


def vacuum_runs(spark: SparkSession, path: str) -> int:
    """Removes folders of which no run is the newest version, and says how many; for times when nobody reads or writes."""
    folders = _manifest(spark, path)
    live = folders.groupBy("run_id").agg(F.max_by("folder", "version").alias("folder")).select("folder").distinct()
    old = [r.folder for r in folders.select("folder").distinct().join(live, "folder", "left_anti").collect()]
    for folder in old:
        _remove(spark, f"{path}/{folder}")
    return len(old)


def read_run(spark: SparkSession, path: str, run_id: str) -> dict[str, DataFrame]:
    """One run as published last: ``records`` with their evidence and conflicts nested, ``sources`` by search_rank, and ``run``,
    its counters, where a counter that is missing (or not positive, of collected and unique) is counted from the records."""
    part = run_tables(spark, path, run_id)
    records = part["records"]
    n = lambda s: F.count_if(F.col("qualification_status") == s)
    live = records.agg(F.count("*").alias("l_collected"), F.count("*").alias("l_unique"), n("Qualified").alias("l_validated"), n("Conflict").alias("l_conflicts"), n("Needs verification").alias("l_incomplete"))
    stated = lambda c: F.when(F.col(c) > 0, F.col(c)) if c in ("collected", "unique") else F.col(c)
    counters = ["collected", "unique", "validated", "conflicts", "incomplete"]
    run = part["runs"].join(F.broadcast(live)).select("run_id", "request_id", "run_number", *(F.coalesce(stated(c), F.col(f"l_{c}")).alias(c) for c in counters))
    return {"run": run, "records": nest(records, part["evidence"], part["conflicts"]), "sources": part["sources"].orderBy("search_rank", "url")}


def nest(records: DataFrame, evidence: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Records with arrays ``evidence`` (by ev_seq) and ``conflicts`` (by field); empty where there is none."""
    keys = ["run_id", "record_id"]

    def packed(df: DataFrame, name: str, first: str) -> DataFrame:
        rest = [c for c in df.columns if c not in (*keys, first)]
        return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(first, *rest))).alias(name))

    out = records.join(packed(evidence, "evidence", "ev_seq"), keys, "left").join(packed(conflicts, "conflicts", "field"), keys, "left")
    empty = lambda name: F.coalesce(name, F.array().cast(out.schema[name].dataType)).alias(name)
    return out.select(*records.columns, empty("evidence"), empty("conflicts"))


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], immutable: list[str] = ()) -> DataFrame:
    """Rows of ``delta`` replace those of ``base`` with equal keys, but for the immutable columns of rows that exist. ``delta`` has unique keys."""
    new = delta.select(*keys, F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in delta.columns if c not in keys))
    both = base.withColumn("_old", F.lit(True)).join(new, keys, "full_outer")
    pick = lambda c: F.when(F.col("_old") & F.lit(c in immutable), F.col(c)).when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*keys, *(pick(c) for c in base.columns if c not in keys))


def melt_fields(records: DataFrame) -> DataFrame:
    """One row for each attribute: run_id, record_id, field, field_key, value, status (FOUND or NOT_FOUND)."""
    from fieldproof.functions.text import is_missing, norm_key

    rows = records.select("run_id", "record_id", F.explode("attributes").alias("field", "value"))
    return rows.select("run_id", "record_id", "field", norm_key(F.col("field")).alias("field_key"), "value", F.when(is_missing(F.col("value")), "NOT_FOUND").otherwise("FOUND").alias("status"))


def orphans(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Children whose parent does not exist."""
    return children.join(parents.select(*keys).distinct(), keys, "left_anti")


def without_orphans(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Children whose parent exists: what a cascading delete of parents leaves."""
    return children.join(parents.select(*keys).distinct(), keys, "left_semi")


def csv_line(cols: list[Column]) -> Column:
    """A CSV line: a value with a comma, a quote or a line break is quoted, and quotes in it doubled; null is empty."""
    cell = lambda c: F.when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    return F.array_join(F.array(*(cell(c.cast("string")) for c in cols)), ",")


def export_rows(records: DataFrame, cols: dict[str, Column], confidence: Column | None = None) -> DataFrame:
    """The columns of an export, by name; confidence as "n%"."""
    more = {"Confidence": F.concat(F.round(confidence).cast("long").cast("string"), F.lit("%"))} if confidence is not None else {}
    return records.select(*(c.alias(n) for n, c in (cols | more).items()))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def export_json(df: DataFrame, path: str, summary: DataFrame | None = None) -> None:
    """Records as JSON lines, and beside them one line of metadata (``summary`` has one row)."""
    df.write.mode("overwrite").json(f"{path}/records")
    if summary is not None:
        summary.write.mode("overwrite").json(f"{path}/metadata")

