"""Records, evidence, runs and requests as views on the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = ["Java Backend Developer", "Senior Java Backend Engineer", "React Frontend Developer", "Python Backend Developer", "Java Engineering Manager", "Java Android Developer", "Full Stack Developer - Java", "Software Engineer - Java Backend", "Data Scientist", "UI/UX Designer", "DevOps Engineer", "Backend Engineer", "Backend Developer (Java)", "—"]
PLACES = ["Bangalore", "Chennai, Tamil Nadu", "India", "100% Remote, India", "San Francisco, CA, USA", "London, United Kingdom", "Gurgaon (Hybrid)", "Karnataka", "Navi Mumbai", "Not disclosed", "Kochi, Kerala", "Toronto"]
EXPERIENCE = ["3-4 years", "8-10 years", "1-3 years", "9.5-15 years", "5 years", "—", "2 to 6 yrs", "senior"]
SALARY = ["₹2 lakh", "₹1.5 Lakh", "₹5 Cr", "₹2,00,000", "200000", "Not disclosed", "1,000–5,000", "12 LPA"]
FOUNDED = ["2018-05-15", "founded in 2015", "not sure", "2021-03-01", "Unknown", "since 1999"]
SUFFIXES = ["", " Ltd", " Inc.", " Technologies Pvt Ltd"]
GENERIC_NAMES = ["Top Companies", "Software Companies Ltd", "N/A", "X", "Jobs!"]
FIELDS = ["Brand", "Type", "Price", "Size", "Role", "Location", "Experience", "Founded", "Salary"]
REQUIRED = ["Brand", "Price", "Role", "Location", "Experience"]
AS_OF = "2001-12-01"
PROMPTS = [
    "Find Java backend developer jobs in India with 50-500 employees companies priced under ₹2 lakh",
    "List electric scooters with at least 100 km range under ₹1.5 lakh, salary if available",
    "React frontend developer openings in Pune with 20 to 80 staff, experience when available",
    "Software companies in Chennai",
    "Full stack developer roles",
]
#: request, number, field, operator, value, value_to, unit, hard
CONSTRAINTS = [
    ("ALL", 1, "Price", "less_than", "1500", None, None, True),
    ("ALL", 2, "Price", "less_than_or_equal", "1200", None, "INR", True),
    ("ALL", 3, "Size", "greater_than", "10", None, None, True),
    ("ALL", 4, "Size", "greater_than_or_equal", "25", None, None, True),
    ("ALL", 5, "Experience", "between", "2", "5", "years", True),
    ("ALL", 6, "Role", "contains", "Java Backend Developer", None, None, True),
    ("ALL", 7, "Location", "contains", "Bengaluru", None, None, True),
    ("ALL", 8, "Location", "not_equals", "Chennai", None, None, True),
    ("ALL", 9, "Founded", "before", "2018-01-01", None, None, True),
    ("ALL", 10, "Founded", "after", "2016-06-01", None, None, True),
    ("ALL", 11, "Type", "in", "ECONOMY, PROMO", None, None, True),
    ("ALL", 12, "Type", "not_in", "STANDARD|MEDIUM", None, None, True),
    ("ALL", 13, "Type", "contains_any", "eco,pro", None, None, True),
    ("ALL", 14, "Brand", "contains_all", "brand,1", None, None, True),
    ("ALL", 15, "Type", "starts_with", "eco", None, None, True),
    ("ALL", 16, "Type", "ends_with", "y", None, None, True),
    ("ALL", 17, "Type", "not_equals", "ECONOMY", None, None, True),
    ("ALL", 18, "Brand", "not_contains", "2", None, None, True),
    ("ALL", 19, "Salary", "within", "200000", "50000", None, True),
    ("ALL", 20, "Salary", "within", "200000", None, None, True),
    ("ALL", 21, "Brand", "equals", "brand#1", None, None, True),
    ("ALL", 22, "Location", "semantic_match", "India", None, None, True),
    ("ALL", 23, "Location", "equals", "Remote", None, None, True),
    ("ALL", 24, "Role", "semantic_match", "Senior Python Developer", None, None, True),
    ("ALL", 25, "Revenue", "greater_than", "5", None, None, True),
    ("ALL", 26, "Brand", "matches_regex", "x", None, None, True),
    ("ALL", 27, "Location", "contains", "Karnataka", None, None, True),
    ("ALL", 28, "Type", "between", "1", "2", None, True),
    ("ALL", 29, "Salary", "less_than", "5", None, None, False),
    ("Q", 1, "Price", "less_than_or_equal", "1500", None, "INR", True),
    ("Q", 2, "Experience", "between", "2", "5", "years", True),
    ("Q", 3, "Size", "greater_than_or_equal", "10", None, None, True),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str | None], key: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def run_of(key: Column) -> Column:
    """The records come from three runs."""
    return F.concat(F.lit("RUN-"), (F.pmod(key, F.lit(3)) + 1).cast("string"))


def _attributes() -> list[Column]:
    k = F.col("p_partkey")
    return [F.col("p_brand"), F.col("p_type"), F.round("p_retailprice").cast("long").cast("string"), F.col("p_size").cast("string"), pick(TITLES, k), pick(PLACES, F.floor(k / 3)), pick(EXPERIENCE, F.floor(k / 5)), pick(FOUNDED, F.floor(k / 7)), pick(SALARY, k)]


def records(spark: SparkSession, sf_dir: str, request: str = "Q") -> DataFrame:
    """One record for each part."""
    part = table(spark, sf_dir, "part")
    values = dict(zip(FIELDS, _attributes(), strict=True))
    return part.select(
        run_of(F.col("p_partkey")).alias("run_id"), F.col("p_partkey").alias("record_id"), F.col("p_partkey").alias("ingest_seq"), F.lit(request).alias("request_id"), F.col("p_name").alias("entity_name"),
        F.create_map(*(x for f, v in values.items() for x in (F.lit(f), v))).alias("attributes"), F.array(*(F.lit(f) for f in FIELDS)).alias("attr_order"),
        F.col("p_brand").alias("company"), values["Role"].alias("role"), values["Location"].alias("location"), values["Experience"].alias("experience"), values["Salary"].alias("salary"), values["Size"].alias("size"), F.lit("—").alias("source"),
    )


def constraints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONSTRAINTS, "request_id string, c_seq int, field string, operator string, value string, value_to string, unit string, hard boolean")


def fields(spark: SparkSession, sf_dir: str, names: list[str] = REQUIRED) -> DataFrame:
    """(run_id, record_id, entity_name, field, value) of the named fields of every record."""
    rec = records(spark, sf_dir)
    return rec.select("run_id", "record_id", "entity_name", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.try_element_at("attributes", F.lit(f)).alias("value")) for f in names))).alias("f")).select("run_id", "record_id", "entity_name", "f.*")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One citation for each lineitem, of its part's field by line number; every 97th value disagrees."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    values = F.array(*_attributes()[:7])
    names = F.array(*(F.lit(f) for f in FIELDS[:7]))
    at = (F.pmod(n, F.lit(7)) + 1).cast("int")
    own = F.element_at(values, at)
    value = F.when(F.pmod(o * 7 + n, F.lit(97)) == 0, F.concat(F.lit("Alt "), own)).otherwise(own)
    base = line.join(part, line["l_partkey"] == part["p_partkey"]).withColumns({"field": F.element_at(names, at), "value": value})
    k, say = F.pmod(o, F.lit(10)), F.pmod(o + n, F.lit(8))
    key = o.cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://www.linkedin.com/jobs/"), key)).when(k == 1, F.concat(F.lit("https://www.google.com/search?q="), key)).when(k == 2, F.lit("https://data.labour.gov/list")).when(k == 3, F.lit("")).otherwise(F.concat(F.lit("https://careers.supplier"), F.col("l_suppkey").cast("string"), F.lit(".com/jobs/"), key))
    snippet = (
        F.when(say == 0, F.concat("p_name", F.lit(" lists "), "field", F.lit(" as "), "value", F.lit(" on its official page")))
        .when(say == 1, F.concat("field", F.lit(" is "), "value"))
        .when(say == 2, F.lit("Read our cookie policy and terms of service for details"))
        .when(say == 3, F.lit("short text"))
        .when(say == 4, F.lit("Careers at Globex for people who want more"))
        .when(say == 5, F.concat("p_name", F.lit(" is hiring across several teams this year")))
        .when(say == 6, F.concat(F.lit("updated 12 days ago by the "), "p_name", F.lit(" team")))
    )
    status = F.when(F.col("l_returnflag") == "N", "Confirmed").when(F.col("l_returnflag") == "A", "Partially verified").otherwise("Needs verification")
    return base.select(
        run_of(F.col("l_partkey")).alias("run_id"), F.col("l_partkey").alias("record_id"), (o * 10_000_000 + n * 1_000_000 + F.col("l_suppkey")).alias("ev_seq"), "field", "value",
        F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("source"), url.alias("url"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("retrieved"), snippet.alias("snippet"), status.alias("verification"),
    )


def line_key(line: DataFrame) -> Column:
    """The number that a line is known by, in order of its order. A long where that of every line fits, as it does up to 9 million orders; else all
    are decimals of the same value."""
    parts = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    add = lambda a, x, b: F.try_add(F.try_multiply(a, F.lit(x)), b)
    made = lambda o, n, s, p: add(add(add(o, 10, n), 100_000, s), 1_000_000, p)
    short, exact = made(*parts), made(*(c.cast("decimal(20,0)") for c in parts)).cast("decimal(38,0)")
    fits = line.where(short.isNull() & exact.isNotNull()).isEmpty()
    return short if fits else exact


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate for each lineitem, for entity resolution: (run_id, record_id, ingest_seq, entity_name, url, role, location, confidence, Size, Type).
    Ids are those of ``line_key``."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    o, n, s = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")
    own = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"), pick(SUFFIXES, o))
    name = F.when(F.pmod(F.col("l_partkey"), F.lit(101)) == 7, pick(GENERIC_NAMES, o)).otherwise(own)
    url = F.when(F.pmod(o, F.lit(10)) < 7, F.lit("https://www.linkedin.com/company/x")).otherwise(F.concat(F.lit("https://careers.supplier"), F.pmod(s, F.lit(3)).cast("string"), F.lit(".com/jobs")))
    off = F.pmod(o * 7 + n, F.lit(97)) == 0
    key = line_key(line)
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        run_of(F.floor(o / 32)).alias("run_id"), key.alias("record_id"), key.alias("ingest_seq"), name.alias("entity_name"), url.alias("url"),
        pick([TITLES[0], TITLES[1], TITLES[2], None], F.floor(o / 2)).alias("role"), pick(["Bangalore", "Chennai", None], n.cast("long")).alias("location"), F.round(F.col("l_discount") * 100).cast("int").alias("confidence"),
        F.when(off, F.concat(F.col("p_size").cast("string"), F.lit("0"))).otherwise(F.col("p_size").cast("string")).alias("Size"), F.when(off, F.concat("p_type", F.lit(" X"))).otherwise(F.col("p_type")).alias("Type"),
    )


def candidate_fields(cand: DataFrame, *keep: str) -> DataFrame:
    return cand.select("run_id", "record_id", *keep, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("Size", "Type")))).alias("f")).select("run_id", "record_id", *keep, "f.*")


def field_marks(ev: DataFrame) -> DataFrame:
    """(run_id, record_id, field, a, b, verification): the least and greatest stated value of a field in a record's own evidence, and
    "Confirmed" if one of its citations is. One grouping tells which fields clash and which records are cited."""
    norm = F.regexp_replace(F.lower("value"), "[^a-z0-9]", "")
    stated = F.expr("value is not null and lower(trim(value)) not in ('', '—', 'not disclosed', 'unknown')")
    confirmed = F.bool_or(F.col("verification") == "Confirmed")
    marks = ev.groupBy("run_id", "record_id", "field").agg(F.min(F.when(stated, norm)).alias("a"), F.max(F.when(stated, norm)).alias("b"), confirmed.alias("confirmed"))
    return marks.withColumn("verification", F.when(F.col("confirmed"), "Confirmed").when(~F.col("confirmed"), "Needs verification")).drop("confirmed")


def clashes(ev: DataFrame) -> DataFrame:
    """(run_id, record_id, field): fields of which a record's own evidence holds several values."""
    return field_marks(ev).where("a <> b").select("run_id", "record_id", "field")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run for each order, of its customer's request."""
    from pyspark.sql import Window

    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    flag = lambda f: F.count_if(F.col("l_returnflag") == f)
    per = line.groupBy("l_orderkey").agg(F.count("*").alias("collected"), F.count_distinct("l_partkey").alias("unique"), flag("N").alias("validated"), flag("R").alias("conflicts"), flag("A").alias("incomplete"))
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return orders.withColumn("run_number", number).join(per, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("run_id"), "run_number", "collected", "unique", "validated", "conflicts", "incomplete")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each customer; every third has an active run."""
    c = F.col("c_custkey")
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    return table(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select(c.alias("request_id"), F.col("c_name").alias("name"), pick(PROMPTS, c).alias("prompt"), F.when(F.pmod(c, F.lit(7)) == 0, "running").otherwise("completed").alias("status"), F.when(F.pmod(c, F.lit(3)) == 0, F.col("first")).alias("active_run_id"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in several wrappings, one for each document: plain JSON, fenced, with commentary, a list under a key, broken."""
    docs = table(spark, sf_dir, "documents")
    k = F.pmod("doc_id", F.lit(5))
    item = F.to_json(F.struct(F.concat(F.lit("Entity "), F.col("doc_id").cast("string")).alias("entityName"), F.concat(F.lit("chars "), F.col("n_chars").cast("string")).alias("role"), F.col("source").alias("location")))
    text = (
        F.when(k == 0, item)
        .when(k == 1, F.concat(F.lit("Here you are:\n```json\n["), item, F.lit(","), item, F.lit("]\n```\nDone.")))
        .when(k == 2, F.concat(F.lit('The answer is {"records": ['), item, F.lit("]} as asked, see https://host"), F.pmod("doc_id", F.lit(7)).cast("string"), F.lit(".example.com/a?b=1, thanks")))
        .when(k == 3, F.concat(F.lit("List: ["), item, F.lit("] end (https://www.example.org/x) and https://www.example.org/x")))
        .otherwise(F.concat(F.lit('{"records": ['), F.col("doc_id").cast("string")))
    )
    return docs.select("doc_id", text.alias("answer"))


RAW_REQUIRED = ["Brand", "Company Size", "Price", "Role", "Notes"]
RAW_ENTITY = ["", "Top 10 best rings", None, "  ", "best of all", "plain", "plain"]


def raw_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw candidate for each part: names missing or list titles, attributes under several spellings, citations of some."""
    k = F.col("p_partkey")
    entity = pick(RAW_ENTITY, k)
    price = F.round("p_retailprice").cast("long").cast("string")
    m = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    attributes = (
        F.when(F.pmod(k, F.lit(5)) == 0, m("Brand Name", "p_brand_", "company size", F.col("p_size").cast("string"), "Price", "Not disclosed"))
        .when(F.pmod(k, F.lit(5)) == 1, m("Model", F.col("p_type"), "PRICE", price, "Brand", ""))
        .when(F.pmod(k, F.lit(5)) == 2, m("Company", F.lit("Not disclosed"), "Brand", F.col("p_brand"), "Role", "—"))
        .when(F.pmod(k, F.lit(5)) == 3, m("Colour", "red"))
    )
    cite = lambda f, v, s, u, t: F.struct(f.alias("field"), v.alias("value"), s.alias("source"), u.alias("url"), t.alias("snippet"))
    none = F.lit(None).cast("string")
    evidence = (
        F.when(F.pmod(k, F.lit(4)) == 0, F.array(cite(F.lit("Price"), price, none, none, none), cite(none, none, F.lit("Shop"), F.lit("https://www.shop.example.org/x"), F.lit("text"))))
        .when(F.pmod(k, F.lit(4)) == 1, F.array(cite(F.lit("Size"), F.lit("Not disclosed"), none, F.lit("https://maker.example.com/p"), none)))
        .otherwise(F.array().cast("array<struct<field:string,value:string,source:string,url:string,snippet:string>>"))
    )
    url = F.when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit("https://www.site"), F.pmod(k, F.lit(9)).cast("string"), F.lit(".com/p/"), k.cast("string")))
    return table(spark, sf_dir, "part").select(
        run_of(k).alias("run_id"), k.alias("record_id"), k.alias("ingest_seq"), F.when(entity == "plain", F.col("p_name")).otherwise(entity).alias("entityName"), F.when(F.pmod(k, F.lit(14)) == 2, F.concat(F.lit(" "), F.col("p_name"))).alias("name"),
        none.alias("company"), F.when(F.pmod(k, F.lit(28)) == 9, F.col("p_brand")).alias("brand"), F.when(F.pmod(k, F.lit(2)) == 0, pick(TITLES, k)).alias("role"), none.alias("location"), none.alias("experience"), F.lit("1 lakh").alias("salary"),
        F.when(F.pmod(k, F.lit(6)) == 3, F.lit("200")).alias("size"), price.alias("price"), url.alias("sourceUrl"), F.when(F.pmod(k, F.lit(8)) == 4, F.lit("Named")).alias("sourceName"), attributes.alias("attributes"), evidence.alias("evidence"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested store for each request: its runs (orders) with their records (lines) and their citations.

    What is shuffled are the columns of lines; texts and nesting are made of them afterwards, in each store's row."""
    s = lambda c: c.cast("string")
    at = F.struct(F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("mode"), F.round("l_extendedprice").cast("long").alias("price"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(at).alias("lines"))
    of = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    stores = of.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), "lines")).alias("orders"))
    clash = F.struct(F.lit("Price").alias("field"), F.array(F.struct(F.lit("a").alias("source"), F.lit("1").alias("value")), F.struct(F.lit("b").alias("source"), F.lit("2").alias("value"))).alias("values"))

    def record(k: Column, x: Column) -> Column:
        cite = F.struct(F.lit("Price").alias("field"), s(x["price"]).alias("value"), F.concat(F.lit("Supplier "), s(x["s"])).alias("source"), F.lit("Confirmed").alias("verification"))
        return F.struct(
            F.concat_ws("-", s(k), s(x["n"]), s(x["s"]), s(x["p"])).alias("id"), F.concat(F.lit("Part "), s(x["p"])).alias("entityName"), F.lit("Review").alias("status"), F.when(x["mode"] != "A", F.array(cite, cite)).otherwise(F.array(cite)).alias("evidence"),
            F.when(x["mode"] == "R", F.array(clash)).otherwise(F.array().cast("array<struct<field:string,values:array<struct<source:string,value:string>>>>")).alias("conflicts"), F.create_map(F.lit("Mode"), x["mode"]).alias("attributes"),
        )

    run = lambda o: F.struct(s(o["k"]).alias("id"), s(F.col("o_custkey")).alias("requestId"), o["k"].cast("int").alias("runNumber"), F.transform(F.array_sort(o["lines"]), lambda x: record(o["k"], x)).alias("records"))
    request = F.struct(s(F.col("o_custkey")).alias("id"), F.concat(F.lit("Request "), s(F.col("o_custkey"))).alias("name"))
    return stores.select(F.array(request).alias("requests"), F.transform("orders", run).alias("runs"))
