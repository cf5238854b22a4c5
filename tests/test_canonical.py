"""Raw candidates to records: pinned cases with nulls, repeats and odd names."""

from pyspark.sql import functions as F

from fieldproof.operators import canonical, explore, ingest
from fieldproof.sources import tables

RAW = "run_id string, record_id long, ingest_seq long, entityName string, name string, company string, brand string, role string, location string, experience string, salary string, size string, price string, sourceUrl string, sourceName string, attributes map<string,string>, evidence array<struct<field:string,value:string,source:string,url:string,snippet:string>>, note string"


def raw(spark, *rows):
    base = dict.fromkeys(c.split()[0] for c in RAW.split(", ") if not c.startswith(("value:", "source:")))
    names = [f.name for f in spark.createDataFrame([], RAW).schema]
    return spark.createDataFrame([tuple((base | {"run_id": "R", "record_id": i, "ingest_seq": i} | r).get(n) for n in names) for i, r in enumerate(rows)], RAW)


def test_names_and_fields(spark):
    rows = [
        {"entityName": "  Acme ", "attributes": {"Company Name": "Other"}},
        {"entityName": "Top 10 firms", "attributes": {"Company Name": "Real Firm", "price": "5", "Price": ""}, "location": "Pune"},
        {"entityName": "best of", "attributes": {"Role": "QA"}, "sourceUrl": "https://www.a.example.com/x"},
        {"name": "10 best cars"},
        {},
        {"entityName": "Zed", "attributes": {"Price": None, "Role": "", "ROLE": "Dev"}, "evidence": [("", None, None, "https://b.example.org/", None)], "note": "kept out"},
    ]
    records, evidence = canonical.canonicalize(raw(spark, *rows), ["Role", "Price", "Location"])
    got = {r.record_id: r for r in records.collect()}
    assert [got[i].entity_name for i in range(6)] == ["Acme", "Real Firm", "QA", "10 best cars", "Candidate Entity 5", "Zed"]
    assert [got[i].display_id for i in range(6)] == [f"R-00{i + 1}" for i in range(6)]
    assert got[1].attributes == {"Company Name": "Real Firm", "price": "5", "Price": "5", "Role": None, "Location": "Pune"}
    assert got[2].attributes["Source"] == "a.example.com" and got[2].source == "a.example.com"
    assert got[5].attributes["Role"] == "Dev" and got[5].attributes["Source URL"] == "https://b.example.org/" and got[5].role == "Dev"
    assert (got[4].role, got[4].salary, got[4].company, got[4].source) == ("—", "Not disclosed", "Candidate Entity 5", "Web Source")
    cites = [tuple(r) for r in evidence.select("record_id", "field", "value", "source", "verification").collect()]
    assert cites == [(5, "General", "—", "b.example.org", "Needs verification")]


def test_no_candidates(spark):
    records, evidence = canonical.canonicalize(raw(spark), [])
    assert records.count() == evidence.count() == 0


def test_natural_order(spark):
    texts = ["item 10", "Item 9", "item 009b", "item", "9", "10", "", "a2b10", "a2b9", "item 9a"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").orderBy(ingest.natural(F.col("t")), "t").collect()]
    assert got == ["", "9", "10", "a2b9", "a2b10", "item", "Item 9", "item 9a", "item 009b", "item 10"]


def test_run_is_replaced_alone(spark, tmp_path):
    """Writing a run again replaces its partition and no other."""
    path = str(tmp_path / "store")
    rec = lambda *rows: spark.createDataFrame(rows, "run_id string, record_id long, qualification_status string")
    ev = spark.createDataFrame([], "run_id string, record_id long, ev_seq int, value string")
    clash = spark.createDataFrame([("A", 1, "Price")], "run_id string, record_id long, field string")
    src = spark.createDataFrame([("A", "https://x", 2), ("A", "https://y", 1)], "run_id string, url string, search_rank int")
    runs = lambda run, n: spark.createDataFrame([(run, "Q", 1, n, None, None, None, None)], "run_id string, request_id string, run_number int, collected long, `unique` long, validated long, conflicts long, incomplete long")
    every = lambda run, *rows, n=0: {"runs": runs(run, n), "records": rec(*rows), "evidence": ev, "conflicts": clash.where(F.col("run_id") == run), "sources": src.where(F.col("run_id") == run)}
    tables.write_run(every("A", ("A", 1, "Qualified"), ("A", 2, None)), path)
    tables.write_run(every("B", ("B", 3, "Conflict")), path)
    tables.write_run(every("A", ("A", 1, "Qualified"), n=7), path)
    a, b = tables.read_run(spark, path, "A"), tables.read_run(spark, path, "B")
    assert a["run"].collect()[0][3:] == (7, 1, 1, 0, 0) and b["run"].collect()[0][3:] == (1, 1, 0, 1, 0)
    assert [r.record_id for r in a["records"].collect()] == [1] and a["records"].collect()[0].conflicts[0].id == "1-CONF-1"
    assert [(r.id, r.url) for r in a["sources"].collect()] == [("A-SRC-1", "https://y"), ("A-SRC-2", "https://x")] and b["sources"].count() == 0


def test_statuses_stand_for_each_other(spark):
    rows = [("Qualified",), ("Conflict",), ("Excluded",), ("Needs verification",)]
    df = spark.createDataFrame(rows, "q string")
    back = df.select("q", explore.effective_status(F.lit(""), explore.legacy_status(F.col("q"))).alias("b"))
    assert all(r.q == r.b for r in back.collect())
