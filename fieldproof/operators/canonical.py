"""From raw candidates to records: names, required fields, fixed columns, evidence, numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldproof.functions.text import norm_key, truthy
from fieldproof.functions.urls import host
from fieldproof.operators.ingest import candidate_name, normalize_evidence
from fieldproof.operators.reliability import numbered

NONE, UNDISCLOSED = "—", "Not disclosed"
#: Columns of a raw candidate that stand for a required field without a value, by what the field's name holds; the first that holds and has one.
STAND_INS = [("role", "role"), ("location", "location"), ("salary", "salary"), ("experience", "experience"), ("size", "size"), ("price", "price")]
#: Fixed columns and the attributes they come from, best first, with what stands there if there is none.
FIXED = {
    "role": (["Role", "Model", "Property Type"], NONE),
    "location": (["Location"], NONE),
    "experience": (["Experience", "Range"], NONE),
    "salary": (["Salary", "Price"], UNDISCLOSED),
    "size": (["Company Size", "Size", "Battery Capacity"], NONE),
}


def _norm(field: str) -> str:
    return "".join(ch for ch in field.lower() if ch.isascii() and ch.isalnum())


def _stated(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def required_value(field: str, attributes: Column, entity: Column) -> Column:
    """Value of a required field: under its own name, under a name with equal letters and digits, from the raw candidate's columns, else null."""
    key = _norm(field)
    alike = F.filter(F.map_entries(attributes), lambda e: (norm_key(e["key"]) == key) & truthy(e["value"]))
    named = F.lit(None).cast("string")
    if "company" in key or "brand" in key:
        named = entity
    else:
        of = [F.col(c) for part, c in STAND_INS if part in key]
        named = F.coalesce(*(_stated(c) for c in of)) if of else named
    return F.coalesce(_stated(F.try_element_at(attributes, F.lit(field))), F.try_element_at(alike, F.lit(1))["value"], named)


def with_required(attributes: Column, entity: Column, required: list[str]) -> Column:
    """The attributes with every required field, null where it has no value; own ones keep their places, new ones follow."""
    filled = {f: required_value(f, attributes, entity) for f in required}
    if not filled:
        return attributes

    def own(e: Column) -> Column:
        value = e["value"]
        for f, v in filled.items():
            value = F.when(e["key"] == f, v).otherwise(value)
        return F.struct(e["key"].alias("key"), value.alias("value"))

    more = F.array(*(F.struct(F.lit(f).alias("key"), v.alias("value")) for f, v in filled.items()))
    return F.map_from_entries(F.concat(F.transform(F.map_entries(attributes), own), F.filter(more, lambda e: ~F.array_contains(F.map_keys(attributes), e["key"]))))


def _add(attributes: Column, name: str, value: Column) -> Column:
    """The attributes with a value that has none yet."""
    rest = F.map_filter(attributes, lambda k, v: k != name)
    return F.when(truthy(value) & ~F.coalesce(truthy(F.try_element_at(attributes, F.lit(name))), F.lit(False)), F.map_concat(rest, F.create_map(F.lit(name), value))).otherwise(attributes)


def canonicalize(raw: DataFrame, required: list[str], geography: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, evidence) of raw candidates (run_id, record_id, ingest_seq, entityName, name, company, brand, role, location, experience, salary, size,
    price, sourceUrl, sourceName, attributes, evidence array<struct<field, value, source, url, snippet>>).

    Records get a name (``candidate_name``), all required fields, the fixed columns, the source's URL and host as attributes, confidence 50, status
    Review and the ids R-001, R-002, ... of their run. Evidence is what the candidate states, with defaults; nothing is invented: a
    candidate without citations has none, and a citation without a snippet stays without one.
    """
    rows = numbered(raw).withColumnRenamed("n", "_n").withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))
    own = F.coalesce(*(_stated(F.col(c)) for c in ("entityName", "name", "company", "brand")))
    entries = F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    first = F.array(*(F.lit(f) for f in required[:1])).cast("array<string>")
    rows = rows.withColumn("entity_name", candidate_name(own, entries, first, F.col("_n")))
    rows = rows.withColumn("filled", with_required(F.col("attributes"), F.col("entity_name"), required))
    given = F.try_element_at("evidence", F.lit(1))
    rows = rows.withColumn("url", F.coalesce(_stated(F.col("sourceUrl")), _stated(given["url"]), F.lit("")))
    rows = rows.withColumn("domain", F.when(truthy(F.col("url")), F.coalesce(host(F.col("url")), F.lit(""))).otherwise(F.lit("")))
    value = lambda names: F.coalesce(*(_stated(F.try_element_at("filled", F.lit(n))) for n in names))
    fixed = {c: F.coalesce(value(names), F.lit(geography) if c == "location" else F.lit(None), F.lit(none)).alias(c) for c, (names, none) in FIXED.items()}
    records = rows.select(
        "run_id", "record_id", "ingest_seq", "display_id", "entity_name", _add(_add(F.col("filled"), "Source URL", F.col("url")), "Source", F.col("domain")).alias("attributes"),
        F.coalesce(value(["Company", "Brand"]), F.col("entity_name")).alias("company"), *fixed.values(),
        F.coalesce(_stated(F.col("domain")), _stated(given["source"]), F.lit("Web Source")).alias("source"),
        F.lit(50).alias("confidence"), F.lit("Review").alias("status"), F.lit("Needs verification").alias("verification_status"), F.lit("Needs verification").alias("qualification_status"),
    )
    cites = raw.select("run_id", "record_id", "sourceUrl", "sourceName", F.posexplode("evidence").alias("ev_seq", "e")).select("run_id", "record_id", "ev_seq", "sourceUrl", "sourceName", "e.*")
    cites = cites.withColumns({"url": F.coalesce(_stated(F.col("url")), _stated(F.col("sourceUrl"))), "source": F.coalesce(_stated(F.col("source")), _stated(F.col("sourceName")))})
    return records, normalize_evidence(cites).drop("sourceUrl", "sourceName")
