"""From raw answers to records: parsing, citations, canonical records, cleaning, constraints in request text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldproof.functions.numbers import parse_number
from fieldproof.functions.text import PLACEHOLDER_RX, extract, is_missing, matches, norm_key, truthy
from fieldproof.functions.urls import host
from fieldproof.operators.holding import first_holding
from fieldproof.sources.tables import stored

CONTAINERS = ["records", "candidates", "results", "items"]
# Fixed value: a name that is the title of a list.
LISTICLE = r"(?i)^(top|best|list of|\d+\s+best|\d+\s+top)"
# Role phrases in request text, first match wins.
ROLE_PHRASES = [
    (r"java\s+backend\s+(?:developer|engineer)", "Java Backend Developer"),
    (r"python\s+backend\s+(?:developer|engineer)", "Python Backend Developer"),
    (r"react\s+(?:frontend|front[\s-]?end)\s+(?:developer|engineer)", "React Frontend Developer"),
    (r"full[\s-]?stack\s+(?:developer|engineer)", "Full Stack Developer"),
    (r"backend\s+(?:developer|engineer)", "Backend Developer"),
    (r"frontend\s+(?:developer|engineer)", "Frontend Developer"),
    (r"java\s+(?:developer|engineer)", "Java Developer"),
    (r"python\s+(?:developer|engineer)", "Python Developer"),
]
# Patterns of constraints stated in request text, and of one legal suffix of a name.
SIZE_RX = r"(?:between\s+)?(\d+)\s*(?:[-–—]|to)\s*(\d+)\s*employees"
STAFF_RX = r"(\d+)\s*(?:[-–—]|to)\s*(\d+)\s*(?:people|staff|headcount|emp)"
PRICE_RX = r"(?:under|below|less than|within|up to|priced under)\s*(?:₹|inr|rs\.?)?\s*(\d+(?:\.\d+)?)\s*lakh"
KM_RX = r"(?:at least|minimum|min|>=)\s*(\d+)\s*km"
CITY_RX = r"\bin\s+(chennai|bengaluru|bangalore|pune|hyderabad|mumbai|delhi|kolkata|gurugram|noida)\b"
OPTIONAL_TAIL = r"\s+(?:if\s+available|where\s+possible|when\s+available|optional)"
SUFFIX_RX = r"(?i)\s+(Pvt\.?|Ltd\.?|Inc\.?|LLP|Technologies|Private Limited)$"


def json_payload(text: Column) -> Column:
    """The first JSON in an answer, as variant: the whole text, a fenced block, the outermost object if it starts before
    any array, the outermost array, else the outermost object. Null if none parses."""
    t = F.trim(text)
    a, b, c, d = F.locate("{", t), F.length(t) - F.locate("}", F.reverse(t)) + 1, F.locate("[", t), F.length(t) - F.locate("]", F.reverse(t)) + 1
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    obj = F.when((a > 0) & (b > a), F.substring(t, a, b - a + 1))
    arr = F.when((c > 0) & (d > c), F.substring(t, c, d - c + 1))
    first = (a > 0) & ((a < c) | (c == 0))
    return F.coalesce(F.try_parse_json(t), F.try_parse_json(F.nullif(F.trim(fenced), F.lit(""))), F.when(first, F.try_parse_json(obj)), F.try_parse_json(arr), F.try_parse_json(obj))


def parse_responses(df: DataFrame, id_col: str, text_col: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, quarantined): records of each answer (id, pos, and the fields of ``schema``), and the answers without any.

    A JSON array is the records; an object holds them under records, candidates, results or items, or is one record.
    """
    kind = f"array<struct<{schema}>>"

    def listed(v: Column) -> Column:
        own = F.try_variant_get(v, "$", f"struct<{schema}>")
        return F.coalesce(*(F.try_variant_get(v, path, kind) for path in ("$", *(f"$.{k}" for k in CONTAINERS))), F.when(own.isNotNull(), F.array(own)))

    # the answer is parsed once: a lambda's variable stands for the result
    records = F.element_at(F.transform(F.array(json_payload(F.col(text_col))), listed), 1)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.posexplode_outer(records).alias("pos", "r"))
    return rows.where("r is not null").select("id", "pos", "r.*"), rows.where("r is null").select("id", "text").distinct()


def extract_citations(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, url, title): every http(s) URL in a text, once for each row; the title is its host."""
    urls = F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit("(https?://[^\\s)\\]>\"',]+)"), F.lit(1)))
    return df.select(F.col(id_col).alias("id"), F.explode(urls).alias("url")).withColumn("title", F.coalesce(host(F.col("url")), F.col("url")))


def discover_sources(evidence: DataFrame) -> DataFrame:
    """(run_id, url, source, snippet, citations): distinct URLs of a run with their first source name and snippet."""
    first = F.min_by(F.struct("source", "snippet"), F.struct("record_id", "ev_seq"))
    return evidence.where(truthy(F.col("url"))).groupBy("run_id", "url").agg(first.alias("f"), F.count("*").alias("citations")).select("run_id", "url", "f.source", "f.snippet", "citations")


def candidate_name(entity: Column, entries: Column, required: Column, number: Column) -> Column:
    """A name for a candidate. Where its own is empty or a list title, the first attribute that names something takes its place, and where
    that is none or a list title again, the first required field; without any it is "Candidate Entity n". entries: array of struct(k, v) in order."""
    poor = lambda c: (c == "") | c.rlike(LISTICLE)
    own = F.trim(F.coalesce(entity, F.lit("")))
    names = F.filter(entries, lambda e: F.lower(e["k"]).rlike("name|company|brand|model") & truthy(e["v"]) & ~e["v"].isin("Not disclosed", "—"))
    named = F.trim(F.try_element_at(names, F.lit(1))["v"])
    asked = F.filter(entries, lambda e: (e["k"] == F.try_element_at(required, F.lit(1))) & truthy(e["v"]))
    from_field = F.trim(F.try_element_at(asked, F.lit(1))["v"])
    best = F.when(poor(own) & named.isNotNull(), named).otherwise(own)
    best = F.when(poor(best) & from_field.isNotNull(), from_field).otherwise(best)
    return F.when(best == "", F.concat(F.lit("Candidate Entity "), number.cast("string"))).otherwise(best)


def clean_name(name: Column) -> Column:
    """One trailing legal suffix removed."""
    return F.regexp_replace(F.trim(name), SUFFIX_RX, "")


def clean_value(value: Column) -> Column:
    """Trimmed; placeholders and empty text null; "n - n lpa" in capitals."""
    v = F.trim(value)
    return F.when((v == "") | v.rlike(PLACEHOLDER_RX), F.lit(None)).when(v.rlike(r"(?i)^\d+(\.\d+)?\s*-\s*\d+(\.\d+)?\s*LPA$"), F.upper(v)).otherwise(v)


def clean(records: DataFrame) -> DataFrame:
    """Records with cleaned names and attributes; the company follows the name."""
    name = F.nullif(clean_name(F.col("entity_name")), F.lit(""))
    return records.withColumns({"entity_name": F.coalesce(name, F.lit("Entity")), "company": F.coalesce(name, F.col("company")), "attributes": F.transform_values("attributes", lambda k, v: clean_value(v))})


def normalize_evidence(evidence: DataFrame, default_url: str = "") -> DataFrame:
    """Evidence with defaults: field General, value —, the record's url, the host as source; without a value it needs verification."""
    value = F.coalesce(F.nullif("value", F.lit("")), F.lit("—"))
    url = F.coalesce(F.nullif("url", F.lit("")), F.lit(default_url))
    return evidence.withColumns({"field": F.coalesce(F.nullif("field", F.lit("")), F.lit("General")), "value": value, "url": url, "source": F.coalesce(F.nullif("source", F.lit("")), host(url), F.lit("Web Source")), "verification": F.when(value.isin("—", "Not disclosed"), "Needs verification").otherwise("Confirmed")})


def complete_evidence(fields: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations for stated fields that have none: the first source of the run, by rank, whose snippet holds the value or whose snippet or title
    names the entity. A field without such a source stays uncited.

    fields(run_id, record_id, entity_name, field, value); sources(run_id, url, title, snippet, search_rank).
    """
    cited = evidence.select("run_id", "record_id", F.lower("field").alias("f")).distinct()
    open_ = fields.where(~is_missing(F.col("value"))).withColumn("f", F.lower("field")).join(cited.hint("merge"), ["run_id", "record_id", "f"], "left_anti")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    # each distinct text is looked for once, in the distinct texts of the sources
    values, names = (open_.select("run_id", F.lower(c).alias("text")).where("text is not null").distinct() for c in ("value", "entity_name"))
    rank = lambda df: df.groupBy("run_id", "holder").agg(F.min(F.struct("search_rank", "url", "title", "snippet")).alias("r"))
    snippets, titles = (rank(sources.withColumn("holder", low(F.col(c)))) for c in ("snippet", "title"))
    hit = lambda what, kind, where: first_holding(what, where).withColumn("kind", F.lit(kind))
    # names stand in snippets or titles; both are holders of their own, and one that is both has its better rank
    hits = hit(values, "value", snippets).unionByName(hit(names, "entity_name", snippets.unionByName(titles)))
    firsts = stored(hits.select("run_id", "kind", "text", F.col("r").alias("s")))
    asked = open_.select("run_id", "record_id", "field", "value", F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.lower(c).alias("text")) for c in ("value", "entity_name")))).alias("a"))
    found = asked.select("run_id", "record_id", "field", "value", "a.*").join(firsts.hint("merge"), ["run_id", "kind", "text"])
    best = found.groupBy("run_id", "record_id", "field").agg(F.min_by(F.struct("value", "s.url", "s.title", "s.snippet"), F.struct("s.search_rank", "s.url")).alias("s"))
    return best.select("run_id", "record_id", "field", "s.value", F.col("s.title").alias("source"), "s.url", "s.snippet")


def extract_constraints(requests: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, field, operator, value, value_to, unit, hard): constraints stated in request text."""
    t = F.lower(F.col(text_col))
    text = lambda v: F.lit(v).cast("string")

    def con(field, op, value, to=None, unit=None, hard=True) -> Column:
        val = value if isinstance(value, Column) else F.lit(value)
        return F.struct(F.lit(field).alias("field"), F.lit(op).alias("operator"), val.alias("value"), (text(None) if to is None else to).alias("value_to"), text(unit).alias("unit"), F.lit(hard).alias("hard"))

    pair = lambda g: F.when(matches(t, SIZE_RX), extract(t, SIZE_RX, g)).otherwise(extract(t, STAFF_RX, g))
    lakh = F.regexp_replace((extract(t, PRICE_RX).try_cast("double") * 100000).cast("decimal(20,2)").cast("string"), r"\.00$", "")
    india = matches(t, r"\bindian\b") | matches(t, r"\bin\s+india\b")
    role = F.lit(None).cast("string")
    for pattern, name in reversed(ROLE_PHRASES):
        role = F.when(t.rlike(pattern), F.lit(name)).otherwise(role)
    found = F.array_compact(
        F.array(
            F.when(pair(1).isNotNull(), con("company_size", "between", pair(1), pair(2), "employees")),
            F.when(lakh.isNotNull(), con("price", "less_than_or_equal", lakh, unit="INR")),
            F.when(matches(t, KM_RX), con("range", "greater_than_or_equal", extract(t, KM_RX), unit="km")),
            F.when(india, con("location", "contains", "India", hard=False)).when(matches(t, CITY_RX), con("location", "contains", F.initcap(extract(t, CITY_RX)), hard=False)),
            F.when(role.isNotNull(), con("role", "contains", role)),
        )
    )
    return requests.select(F.col(id_col).alias("id"), F.inline(found))


def optional_fields(requests: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, field): fields a request asks for only if available."""
    t = F.lower(F.col(text_col))
    each = F.array_compact(F.array(*(F.when(t.rlike(f + OPTIONAL_TAIL), F.lit(f)) for f in ("salary", "experience"))))
    return requests.select(F.col(id_col).alias("id"), F.explode(each).alias("field"))


def merge_constraints(stated: DataFrame, found: DataFrame, key: str = "request_id") -> DataFrame:
    """Stated constraints, plus those found whose (request, field, operator) is not stated."""
    return stated.unionByName(found.join(stated.select(key, "field", "operator").hint("merge"), [key, "field", "operator"], "left_anti"), allowMissingColumns=True)


def constraint_label(field: Column, operator: Column, value: Column, value_to: Column, unit: Column) -> Column:
    """Display text of a constraint; INR amounts in crore and lakh."""
    name = F.initcap(F.replace(F.coalesce(F.nullif(field, F.lit("")), F.lit("Field")), F.lit("_"), F.lit(" ")))
    tail = F.when(truthy(unit), F.concat(F.lit(" "), unit)).otherwise(F.lit(""))
    num = value.try_cast("double")
    money = (unit == "INR") | F.contains(F.lower(name), F.lit("price"))
    scaled = lambda by, word: F.concat(F.lit("₹"), F.regexp_replace(F.round(num / by, 1).cast("decimal(20,1)").cast("string"), r"\.0$", ""), F.lit(word))
    shown = F.when(F.coalesce(money, F.lit(False)) & (num >= 1e7), scaled(1e7, " Cr")).when(F.coalesce(money, F.lit(False)) & (num >= 1e5), scaled(1e5, " lakh")).otherwise(value)
    text = lambda *x: F.concat(name, F.lit(": "), *(y if isinstance(y, Column) else F.lit(y) for y in x))
    out = F.when(operator == "between", text(value, "–", F.coalesce(value_to, F.lit("—")), tail))
    for op, sign in (("less_than_or_equal", "<= "), ("less_than", "< "), ("greater_than_or_equal", ">= "), ("greater_than", "> ")):
        out = out.when(operator == op, text(sign, shown, tail))
    for op, a, b in (("contains", 'contains "', '"'), ("not_contains", 'does not contain "', '"'), ("equals", '"', '"'), ("not_equals", '!= "', '"'), ("starts_with", 'starts with "', '"'), ("ends_with", 'ends with "', '"'), ("in", "in [", "]"), ("not_in", "not in [", "]"), ("contains_any", "contains any of [", "]"), ("contains_all", "contains all of [", "]"), ("before", "before ", ""), ("after", "after ", ""), ("semantic_match", '~ "', '"')):
        out = out.when(operator == op, text(a, value, b))
    return out.when(operator == "within", text("within ", value, tail)).otherwise(text(value, tail))


def relevant_fields(required: Column, hard_fields: Column) -> tuple[Column, Column]:
    """(required, optional) fields: those that a hard constraint's field equals, holds or is held by, and the rest."""
    keep = lambda f: F.exists(hard_fields, lambda c: F.contains(norm_key(f), norm_key(c)) | F.contains(norm_key(c), norm_key(f)))
    return F.filter(required, keep), F.filter(required, lambda f: ~keep(f))


def natural(text: Column) -> Column:
    """A key that puts text in order without regard to case, and digits in it by value: "item 9" before "Item 10"."""
    plain = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    part = lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(plain(p)).cast("string"), 4, "0"), plain(p))).otherwise(p)
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), part), "")


def sort_keys(col: Column) -> dict[str, Column]:
    """Keys of a table's sort: missing last, then numbers, then text in natural order, which also decides between equal numbers."""
    num = parse_number(col, ranges=False)["num"]
    return {"missing": is_missing(col).cast("int"), "is_text": num.isNull().cast("int"), "num": num, "text": natural(col)}
