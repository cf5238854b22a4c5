"""Pinned cases of constraint evaluation, qualification, titles, places, numbers and URLs."""

from functools import reduce

import pytest
from pyspark.sql import functions as F

from fieldproof.functions.numbers import parse_date, parse_number
from fieldproof.functions.places import match_places, parse_place
from fieldproof.functions.titles import match_titles, parse_title
from fieldproof.functions.urls import RESOLVER_SECOND_LEVEL, root_domain, safe_link, source_tier, validate_url
from fieldproof.operators import constraints as C
from fieldproof.operators.resolve import norm_entity_name

def union_all(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def record(spark, attributes, record_id=1, **fixed):
    order = list(attributes)
    row = {"run_id": "R", "record_id": record_id, "request_id": "Q", "entity_name": "Acme", "attributes": attributes, "attr_order": order} | {c: None for c in ("company", "role", "location", "experience", "salary", "size", "source")} | fixed
    return spark.createDataFrame([row], "run_id string, record_id long, request_id string, entity_name string, attributes map<string,string>, attr_order array<string>, company string, role string, location string, experience string, salary string, size string, source string")


def con(spark, *rows):
    return spark.createDataFrame([("Q", i, *r, *([None] * (5 - len(r))), True) if len(r) < 6 else ("Q", i, *r) for i, r in enumerate(rows)], "request_id string, c_seq int, field string, operator string, value string, value_to string, unit string, hard boolean")


def results(spark, attributes, *rows):
    return [(r.result, r.reason) for r in C.evaluate_constraints(record(spark, attributes), con(spark, *rows)).orderBy("c_seq").collect()]


NUMBERS = [("₹2 lakh", 200000, None, None), ("₹2,00,000", 200000, None, None), ("200000", 200000, None, None), ("₹50 lakh", 5000000, None, None), ("₹1.5 Lakh", 150000, None, None), ("₹1,50,000", 150000, None, None), ("₹5 Cr", 50000000, None, None), ("1,000–5,000 employees", 1000, 1000, 5000), ("3-4 years", 3, 3, 4), ("—", None, None, None), ("none at all", None, None, None)]


def test_numbers(spark):
    rows = spark.createDataFrame([(x[0],) for x in NUMBERS], "t string").select("t", parse_number(F.col("t")).alias("n")).collect()
    assert [(r.t, r.n and r.n.num, r.n and r.n.min, r.n and r.n.max) for r in rows] == NUMBERS


def test_dates(spark):
    rows = spark.createDataFrame([("2018-05-15",), ("founded in 2015",), ("3 May 2019",), ("soon",)], "t string").select(F.date_format(parse_date(F.col("t")), "yyyy-MM-dd").alias("d")).collect()
    assert [r.d for r in rows] == ["2018-05-15", "2015-01-01", "2019-05-03", None]


CASES = [
    ("3-4 years", ("Experience", "between", "2", "5", "years"), "PASS"),
    ("8-10 years", ("Experience", "between", "2", "5", "years"), "FAIL"),
    ("1-3 years", ("Experience", "between", "2", "5", "years"), "PASS"),
    (None, ("Experience", "between", "2", "5"), "UNKNOWN"),
    ("Not disclosed", ("Experience", "greater_than", "2"), "UNKNOWN"),
    ("Senior Backend Engineer", ("Level", "starts_with", "Senior"), "PASS"),
    ("Senior Backend Engineer", ("Level", "starts_with", "Junior"), "FAIL"),
    ("Senior Backend Engineer", ("Level", "ends_with", "Engineer"), "PASS"),
    ("FinTech", ("Sector", "not_equals", "EdTech"), "PASS"),
    ("FinTech", ("Sector", "not_equals", "FinTech"), "FAIL"),
    ("FinTech", ("Sector", "not_contains", "Fin"), "FAIL"),
    ("Tier 1", ("Tier", "in", "Tier 1, Tier 2"), "PASS"),
    ("Tier 1", ("Tier", "in", "Tier 3, Tier 4"), "FAIL"),
    ("Tier 1", ("Tier", "not_in", "Tier 3, Tier 4"), "PASS"),
    ("Java, Spring Boot, Docker, Kubernetes", ("Stack", "contains_any", "Python, Java, Rust"), "PASS"),
    ("Java, Spring Boot, Docker, Kubernetes", ("Stack", "contains_any", "Python, Ruby"), "FAIL"),
    ("Java, Spring Boot, Docker, Kubernetes", ("Stack", "contains_all", "Java, Spring"), "PASS"),
    ("Java, Spring Boot, Docker, Kubernetes", ("Stack", "contains_all", "Java, React"), "FAIL"),
    ("2018-05-15", ("Founded", "before", "2020-01-01"), "PASS"),
    ("2018-05-15", ("Founded", "after", "2015-01-01"), "PASS"),
    ("2018-05-15", ("Founded", "before", "2015-01-01"), "FAIL"),
    ("₹1,85,000", ("Price", "within", "200000", "25000"), "PASS"),
    ("₹1,85,000", ("Price", "within", "200000", "10000"), "FAIL"),
]


def test_operators(spark):
    """All cases in one job: each record has a request of its own with one constraint."""
    rec = union_all([record(spark, {row[0]: value}, i).withColumn("request_id", F.lit(str(i))) for i, (value, row, _) in enumerate(CASES)])
    rows = [(str(i), 1, *row, *([None] * (5 - len(row))), True) for i, (_, row, _) in enumerate(CASES)]
    con_ = spark.createDataFrame(rows, "request_id string, c_seq int, field string, operator string, value string, value_to string, unit string, hard boolean")
    got = {r.record_id: r.result for r in C.evaluate_constraints(rec, con_).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(CASES)}


TITLES = [("Backend Engineer - Java", "MATCH"), ("Java Backend Engineer", "MATCH"), ("Backend Developer (Java)", "MATCH"), ("Senior Java Backend Engineer", "MATCH"), ("React Frontend Developer", "NO_MATCH"), ("Python Backend Developer", "NO_MATCH"), ("Java Android Developer", "NO_MATCH"), ("Java QA Automation Engineer", "NO_MATCH"), ("Java Developer - Backend", "MATCH"), ("Software Engineer - Java Backend", "MATCH"), ("Data Scientist", "NO_MATCH"), ("UI/UX Designer", "NO_MATCH"), ("DevOps Engineer", "NO_MATCH")]


def test_titles(spark):
    df = spark.createDataFrame([("Java Backend Developer", a) for a, _ in TITLES], "r string, a string")
    got = df.select("a", match_titles(parse_title(F.col("r")), parse_title(F.col("a")))["result"].alias("m")).collect()
    assert [(r.a, r.m) for r in got] == TITLES


PLACES = [("Bengaluru", "Bangalore", "PASS"), ("Bengaluru", "Chennai, Tamil Nadu", "FAIL"), ("Bengaluru", "India", "UNKNOWN"), ("Bengaluru", None, "UNKNOWN"), ("India", "Bengaluru", "PASS"), ("India", "San Francisco, CA, USA", "FAIL"), ("India", "London, United Kingdom", "FAIL"), ("Remote", "100% Remote, India", "PASS"), ("Remote", "Chennai office only", "FAIL"), ("India", "Office in London", "FAIL")]


def test_places(spark):
    df = spark.createDataFrame([(r, a) for r, a, _ in PLACES], "r string, a string")
    got = df.select("r", "a", match_places(parse_place(F.col("r")), parse_place(F.col("a")), F.col("a"))["result"].alias("m")).collect()
    assert [(r.r, r.a, r.m) for r in got] == PLACES


def verdict(spark, attributes, rows, required=(), conflicts=(), evidence=()):
    rec = record(spark, attributes)
    ev = spark.createDataFrame([("R", 1, v) for v in evidence], "run_id string, record_id long, verification string")
    cf = spark.createDataFrame([("R", 1, f) for f in conflicts], "run_id string, record_id long, field string")
    return C.qualify(rec, C.evaluate_constraints(rec, con(spark, *rows)), C.completeness(rec, list(required)), cf, ev).first()


def test_verdicts(spark):
    years = ("Experience", "between", "2", "5")
    assert verdict(spark, {"Experience": "3-4 years"}, [years]).status == "Qualified"
    out = verdict(spark, {"Experience": "9.5-15 years"}, [years, ("Salary", "less_than_or_equal", "2000000")])
    assert out.status == "Excluded" and "does not satisfy" in out.reason
    assert verdict(spark, {}, [years, ("Salary", "less_than_or_equal", "2000000")]).status == "Needs verification"
    assert verdict(spark, {"Experience": "3 years"}, [years], conflicts=["Experience"]).status == "Conflict"
    assert verdict(spark, {"Experience": "3 years"}, [years], evidence=["Needs verification"]).status == "Needs verification"
    half = verdict(spark, {"A": "1", "B": "2", "C": None, "D": "—"}, [years], required=["A", "B", "C", "D"])
    assert half.completeness == 50 and half.missing_fields == ["C", "D"]


@pytest.mark.parametrize("fields", [0, 64])
def test_fields_are_looked_up_alike_however_many(spark, monkeypatch, fields):
    """Both ways to look a constrained field up: each by its own rules, and all by a join with the fields asked for."""
    monkeypatch.setattr(C, "FIELDS", fields)
    rows = [("Role", "contains", "Java Developer"), ("Salary", "less_than", "500000"), ("experience", "between", "2", "5"), ("Nowhere", "equals", "x")]
    got = results(spark, {"Role": "Java Developer", "salary": "4,00,000", "Experience": "3 years"}, *rows)
    assert [result for result, _ in got] == ["PASS", "PASS", "PASS", "UNKNOWN"]


def test_soft_constraints_are_not_evaluated(spark):
    assert len(results(spark, {"Role": "Java Developer"}, ("Role", "contains", "Java Developer"), ("Location", "contains", "Pune", None, None, False))) == 1


def test_urls(spark):
    def each(urls, f):
        return [r.x for r in spark.createDataFrame([(u,) for u in urls], "u string").select(f(F.col("u")).alias("x")).collect()]

    assert each(["https://careers.freshworks.com/job/12", "www.infosys.co.in"], lambda c: root_domain(c, RESOLVER_SECOND_LEVEL)) == ["freshworks.com", "infosys.co.in"]
    bad = ["http://127.0.0.1/a", "http://10.0.0.1", "ftp://x.org/a", "javascript:alert(1)", "http://localhost:80/", "http://a.internal", "http://[::1]/", "", "http://2130706433/", None]
    assert not any(x.valid for x in each(bad, validate_url))
    assert each(["example.com/a"], safe_link) == ["https://example.com/a"]
    urls = ["https://jobs.lever.co/acme/1", "https://labour.gov/x", "https://www.linkedin.com/jobs/1", "—"]
    assert each(urls, lambda c: source_tier(c, F.lit("Acme"))) == ["PRIMARY_OFFICIAL", "AUTHORITATIVE", "ESTABLISHED_PLATFORM", "SEARCH_SNIPPET"]


def test_entity_names(spark):
    rows = spark.createDataFrame([("Infosys Technologies Pvt Ltd",), ("Freshworks Inc.",), (None,)], "n string").select(norm_entity_name(F.col("n")).alias("x")).collect()
    assert [r.x for r in rows] == ["infosys", "freshworks", ""]


def test_rows_without_a_lookup_meet_in_no_task(spark):
    """Most rows have no title to look up: they take no part in the join, and lose nothing."""
    from fieldproof.operators import constraints
    from fieldproof.sources import tables

    rows = tables.stored(spark.range(50).selectExpr("id", "case when id % 10 = 0 then 'a' when id % 10 = 1 then 'c' end k"))
    table = spark.createDataFrame([("a", 7)], "k string, found int")
    got = constraints.looked_up(rows, rows["k"].isNotNull(), table, ["k"])
    assert {r.id: r.found for r in got.collect()} == {i: 7 if i % 10 == 0 else None for i in range(50)}
    assert "hashpartitioning(k" not in got._jdf.queryExecution().executedPlan().toString()


def test_records_of_one_split_are_dealt_out(spark, monkeypatch):
    """One file of records is evaluated by several tasks."""
    from fieldproof.operators import constraints

    seen = []
    monkeypatch.setattr(constraints, "stored", lambda df: seen.append(df) or tables_stored(df))
    from fieldproof.plans import adapters as A
    from fieldproof.sources.tables import stored as tables_stored

    d = "/root/testdata/sf0.001"
    assert constraints.evaluate_constraints(A.records(spark, d, "Q"), A.constraints(spark)).count() == 3 * A.records(spark, d).count()
    assert "hashpartitioning(run_id" in seen[0]._jdf.queryExecution().executedPlan().toString()
