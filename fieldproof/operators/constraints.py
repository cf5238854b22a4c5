"""Records against typed constraints: PASS, FAIL or UNKNOWN for every pair, then a verdict for each record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldproof.functions.numbers import parse_date, parse_number
from fieldproof.functions.places import match_places, parse_place
from fieldproof.functions.text import contains_any, is_missing, js_round, matches, norm_key, truthy
from fieldproof.functions.titles import match_titles, parse_title
from fieldproof.sources.tables import stored

KEYS = ["run_id", "record_id"]
NUMERIC = ["less_than", "less_than_or_equal", "greater_than", "greater_than_or_equal", "between"]
SAME = ["equals", "contains", "semantic_match"]
DIFFERENT = ["not_equals", "not_contains"]
ROLE_FIELDS = ["role", "title", "designation", "position"]
PLACE_FIELDS = ["location", "city", "country", "geography", "state"]
# Fixed value.
INDIAN_PLACES = r"\b(chennai|bengaluru|bangalore|hyderabad|pune|mumbai|delhi|noida|gurugram|gurgaon|kolkata|ahmedabad|jaipur|kochi|coimbatore|chandigarh|tamil\s*nadu|karnataka|maharashtra|telangana)\b"

#: Constraints are few by nature; a larger table is joined without a broadcast.
BROADCAST_ROWS = 100_000
#: Distinct constrained fields, by request, that are looked up one by one.
FIELDS = 64


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if it has at most ``rows`` rows, with a merge hint if not."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def looked_up(rows: DataFrame, need: Column, table: DataFrame, on: list[str]) -> DataFrame:
    """The rows with the columns of ``table``, a small one sent to all tasks; null where ``need`` does not hold or nothing is found.

    Rows that need nothing do not take part in the join: without a key, or with one that most share, they would meet in one task.
    ``rows`` is written."""
    need = F.coalesce(need, F.lit(False))
    more = [F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns if c not in on]
    found = rows.where(need).join(small(stored(table)), on, "left")
    return found.select(*rows.columns, *(c for c in table.columns if c not in on)).unionByName(rows.where(~need).select("*", *more))


def entries_of() -> Column:
    """The attributes of a record in order: key, its normal form, value."""
    return F.transform("attr_order", lambda k: F.struct(k.alias("k"), norm_key(k).alias("n"), F.try_element_at("attributes", k).alias("v")))


def field_value(field: Column | str, entries: Column | None = None) -> Column:
    """Value of a field in a record: exact key, key by normal form, key of the same family, then the fixed
    columns. Needs attributes, attr_order and the fixed columns of records; "" without a value. ``entries`` is a column made by
    ``entries_of``, where several fields are asked for. Of a field given as text only the rules that can hold for it are in the expression."""
    known = isinstance(field, str)
    key = F.lit(field) if known else field
    target = F.lit("".join(ch for ch in field.lower() if ch.isascii() and ch.isalnum())) if known else norm_key(field)
    entries = entries_of() if entries is None else entries
    first = lambda keep: F.try_element_at(F.filter(entries, keep), F.lit(1))["v"]
    stated = lambda v: truthy(v) & ~v.isin("—", "Not disclosed")

    def chosen(asked: list[str], value: Callable[[], Column]) -> tuple[Column, Column] | None:
        """(condition, value) of a rule for fields whose name holds one of ``asked``; None where it cannot hold."""
        if not known:
            return contains_any(target, asked), value()
        name = "".join(ch for ch in field.lower() if ch.isascii() and ch.isalnum())
        return (F.lit(True), value()) if any(p in name for p in asked) else None

    def keyed(keys: list[str], more=None) -> Callable[[], Column]:
        return lambda: first(lambda e: (contains_any(e["n"], keys) | (more(e) if more else F.lit(False))) & stated(e["v"]))

    city = lambda e: matches(F.lower(e["k"]), r"\b(city|cities)\b") | (F.contains(e["n"], F.lit("city")) & ~F.contains(e["n"], F.lit("capacity")))
    col = lambda name: lambda: F.coalesce(F.col(name), F.lit(""))
    families = [
        chosen(["size", "employee"], keyed(["size", "employee", "headcount"])),
        chosen(["location", "country", "city", "geo"], keyed(["location", "country", "headquarter", "hq"], city)),
        chosen(["price", "salary", "cost", "budget"], keyed(["price", "salary", "cost", "budget", "compensation"])),
        chosen(["range", "experience"], keyed(["range", "experience"])),
    ]
    fixed = [
        chosen(["company", "brand", "developer"], lambda: F.coalesce(F.nullif("company", F.lit("")), F.col("entity_name"), F.lit(""))),
        chosen(["role", "model", "property"], col("role")),
        chosen(["location", "city", "geo"], col("location")),
        chosen(["salary", "price", "cost"], col("salary")),
        chosen(["range", "experience"], col("experience")),
        chosen(["size", "employee", "battery"], col("size")),
    ]
    last = F.lit("")
    for condition, value in reversed([x for x in fixed if x]):
        last = F.when(condition, value).otherwise(last)
    return F.coalesce(
        F.nullif(F.try_element_at("attributes", key), F.lit("")),
        first(lambda e: (e["n"] == target) & truthy(e["v"])),
        *(F.when(condition, value) for condition, value in (x for x in families if x)),
        last,
    )


def match_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts on distinct (required, actual) titles and places: each distinct text is parsed once."""

    def parsed(kind: str, f) -> DataFrame:
        mine = pairs.where(F.col("kind") == kind).select("required", "actual").distinct()
        texts = stored(mine.select(F.explode(F.array("required", "actual")).alias("text")).distinct().select("text", f(F.col("text")).alias("p")))
        r, a = (texts.select(F.col("text").alias(n), F.col("p").alias(f"{n}_p")) for n in ("required", "actual"))
        return mine.join(small(r), "required").join(small(a), "actual")

    title = parsed("role", parse_title).select("required", "actual", match_titles(F.col("required_p"), F.col("actual_p")).alias("verdict"))
    place = parsed("place", parse_place).select("required", "actual", match_places(F.col("required_p"), F.col("actual_p"), F.col("actual")).alias("verdict"))
    return title, place


def _items(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(value), "[,|]"), lambda x: F.trim(x)), lambda x: x != "")


def field_values(records: DataFrame, con: DataFrame, request_col: str) -> DataFrame:
    """(run_id, record_id, request, field, actual): each field that a request's constraints name, once for each of its records."""
    pairs = con.select("field", request_col).distinct().limit(FIELDS + 1).collect()
    rows = records.withColumn("_entries", entries_of())
    if len(pairs) <= FIELDS:  # each field by its own rules, all in one pass
        of = {f: [r[1] for r in pairs if r[0] == f] for f in sorted({r[0] for r in pairs})}
        values = F.array(*(F.struct(F.lit(f).alias("field"), F.when(F.col(request_col).isin(rs), field_value(f, F.col("_entries"))).alias("actual")) for f, rs in of.items())) if of else F.array().cast("array<struct<field:string,actual:string>>")
        return rows.select(*KEYS, request_col, F.inline(F.filter(values, lambda v: v["actual"].isNotNull())))
    asked = con.select(request_col, "field").distinct()
    return rows.join(small(asked), request_col).select(*KEYS, request_col, "field", field_value(F.col("field"), F.col("_entries")).alias("actual"))


def evaluate_constraints(records: DataFrame, constraints: DataFrame, request_col: str = "request_id") -> DataFrame:
    """One row for each record and hard constraint of its request.

    Rows: run_id, record_id, c_seq, field, operator, expected, actual, normalized_value, result, reason.
    Missing values are UNKNOWN, never FAIL. Titles and places are compared once for each distinct pair.
    """
    con = constraints.where("hard").select(F.col(request_col), "c_seq", "field", "operator", "value", "value_to", "unit")
    # a compact file of records is one split: dealt out before one record becomes a row for each constraint
    base = field_values(records.repartition(*KEYS), con, request_col).join(small(con), [request_col, "field"])
    f = norm_key(F.col("field"))
    role, place = contains_any(f, ROLE_FIELDS), contains_any(f, PLACE_FIELDS)
    op = F.col("operator")
    missing = is_missing(F.col("actual"))
    kind = F.when(missing, F.lit(None)).when(role & op.isin(SAME), F.lit("role")).when(place & op.isin(SAME + DIFFERENT), F.lit("place"))
    base = stored(base.select(*KEYS, "c_seq", "field", "operator", "value", "value_to", "unit", "actual", kind.alias("kind")))
    titles, places = match_pairs(base.where("kind is not null").select("kind", F.col("value").alias("required"), "actual"))
    verdicts = titles.withColumn("kind", F.lit("role")).unionByName(places.withColumn("kind", F.lit("place"))).withColumnRenamed("required", "value")
    base = looked_up(base, F.col("kind").isNotNull(), verdicts, ["kind", "value", "actual"])

    value, actual, to = F.col("value"), F.col("actual"), F.col("value_to")
    unit = F.coalesce(F.col("unit"), F.lit(""))
    spoken = F.replace(op, F.lit("_"), F.lit(" "))
    asked = F.trim(F.when(op == "between", F.concat(value, F.lit(" to "), F.coalesce(to, F.lit("—")), F.lit(" "), unit)).otherwise(F.concat(spoken, F.lit(" "), value, F.lit(" "), unit)))
    # columns of their own, so that no branch parses a value again
    base = base.withColumns(
        {
            "num": F.when(op.isin(*NUMERIC, "within"), parse_number(actual)),
            "target": value.try_cast("double"),
            "target_to": F.coalesce(to.try_cast("double"), value.try_cast("double")),
            "date": F.when(op.isin("before", "after"), parse_date(actual)),
            "want": F.when(op.isin("before", "after"), parse_date(value)),
            "items": _items(value),
            "v": F.lower(F.trim(actual)),
            "t": F.lower(F.trim(value)),
            "asked": asked,
            "missing": missing,
        }
    )
    num, target, target_to, date, want, items, v, t, asked, missing, verdict = (F.col(c) for c in ("num", "target", "target_to", "date", "want", "items", "v", "t", "asked", "missing", "verdict"))
    tolerance = F.coalesce(to.try_cast("double"), target * 0.15)

    def out(result, reason, expected=value, normal=None) -> Column:
        text = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(text(expected).alias("expected"), (F.lit(None) if normal is None else normal).cast("double").alias("normalized_value"), text(result).alias("result"), text(reason).alias("reason"))

    def tested(passes: Column, good, bad, expected=value, normal=None) -> Column:
        text = lambda x: x if isinstance(x, Column) else F.lit(x)
        return out(F.when(passes, "PASS").otherwise("FAIL"), F.when(passes, text(good)).otherwise(text(bad)), expected, normal)

    overlap = F.when(num["min"].isNotNull() & num["max"].isNotNull(), ~((num["max"] < target) | (num["min"] > target_to))).otherwise(num["num"].between(target, target_to))
    listed = F.exists(items, lambda x: F.contains(v, x))
    all_in = F.forall(items, lambda x: F.contains(v, x))
    flipped = F.when(verdict["result"] == "PASS", "FAIL").when(verdict["result"] == "FAIL", "PASS").otherwise("UNKNOWN")
    india = F.contains(F.lower(F.col("field")), F.lit("location")) & F.contains(t, F.lit("india")) & matches(v, INDIAN_PLACES)
    set_text = lambda by: F.concat(F.lit("["), F.array_join(items, by), F.lit("]"))
    upper = F.upper(op)
    got = (
        F.when(missing, out("UNKNOWN", "FIELD_NOT_FOUND", asked))
        .when(op.isin(NUMERIC) & (num.isNull() | target.isNull()), out("UNKNOWN", "VALUE_UNPARSEABLE", asked))
        .when(op == "less_than", tested(num["num"] < target, "WITHIN_LIMIT", "VALUE_EXCEEDS_MAXIMUM", asked, num["num"]))
        .when(op == "less_than_or_equal", tested(num["num"] <= target, "WITHIN_LIMIT", "VALUE_EXCEEDS_MAXIMUM", asked, num["num"]))
        .when(op == "greater_than", tested(num["num"] > target, "MEETS_MINIMUM", "VALUE_BELOW_MINIMUM", asked, num["num"]))
        .when(op == "greater_than_or_equal", tested(num["num"] >= target, "MEETS_MINIMUM", "VALUE_BELOW_MINIMUM", asked, num["num"]))
        .when(op == "between", tested(overlap, "WITHIN_RANGE", "OUTSIDE_RANGE", asked, num["num"]))
        .when(F.col("kind") == "role", out(F.when(verdict["result"] == "MATCH", "PASS").when(verdict["result"] == "NO_MATCH", "FAIL").otherwise("UNKNOWN"), verdict["reason"]))
        .when((F.col("kind") == "place") & op.isin(SAME), out(verdict["result"], verdict["reason"]))
        .when(F.col("kind") == "place", out(flipped, F.when(flipped == "PASS", "LOCATION_EXCLUDED_AS_REQUESTED").otherwise("LOCATION_MATCHES_DISALLOWED"), F.concat(F.lit("NOT "), value)))
        .when(op.isin("before", "after") & (date.isNull() | want.isNull()), out("UNKNOWN", "DATE_UNPARSEABLE"))
        .when(op.isin("before", "after"), tested(F.when(op == "before", date < want).otherwise(date > want), F.concat(upper, F.lit("_DATE_SATISFIED")), F.concat(F.lit("DATE_"), upper, F.lit("_VIOLATION")), value, F.unix_millis(date)))
        .when(op == "in", tested(listed, "MEMBER_OF_ALLOWED_SET", "NOT_IN_ALLOWED_SET", set_text(", ")))
        .when(op == "not_in", tested(~listed, "NOT_IN_DISALLOWED_SET", "FOUND_IN_DISALLOWED_SET", set_text(", ")))
        .when(op == "contains_any", tested(listed, "CONTAINS_ANY_SATISFIED", "CONTAINS_ANY_FAILED", set_text(" OR ")))
        .when(op == "contains_all", tested(all_in, "CONTAINS_ALL_SATISFIED", "CONTAINS_ALL_FAILED", set_text(" AND ")))
        .when(op == "starts_with", tested(F.startswith(v, t), "STARTS_WITH_MATCH", "DOES_NOT_START_WITH"))
        .when(op == "ends_with", tested(F.endswith(v, t), "ENDS_WITH_MATCH", "DOES_NOT_END_WITH"))
        .when(op == "not_equals", tested(v != t, "NOT_EQUAL_SATISFIED", "VALUE_EQUALS_DISALLOWED", F.concat(F.lit("!= "), value)))
        .when(op == "not_contains", tested(~F.contains(v, t), "DOES_NOT_CONTAIN", "CONTAINS_DISALLOWED_TEXT", F.concat(F.lit("NOT CONTAINS "), value)))
        .when((op == "within") & num.isNotNull() & target.isNotNull(), tested(F.abs(num["num"] - target) <= tolerance, "WITHIN_TOLERANCE", "OUTSIDE_TOLERANCE", F.concat(value, F.lit(" ±"), F.coalesce(to, F.regexp_replace(tolerance.cast("string"), r"\.0$", ""))), num["num"]))
        .when(op == "within", tested(F.contains(v, t), "WITHIN_MATCH", "OUTSIDE_BOUNDS"))
        .when(op.isin(SAME), tested(F.contains(v, t) | india, "MATCHES", "DOES_NOT_MATCH"))
        .otherwise(out("UNKNOWN", "UNSUPPORTED_OPERATOR"))
    )
    shown = F.when(missing, F.lit(None)).otherwise(actual)
    return base.withColumn("got", got).select(*KEYS, "c_seq", "field", "operator", "got.expected", shown.alias("actual"), "got.normalized_value", "got.result", "got.reason")


def completeness(records: DataFrame, required: list[str], optional: list[str] = ()) -> DataFrame:
    """run_id, record_id, missing_fields (in the order asked), completeness (0 to 100; 100 without required fields)."""
    skip = {"".join(ch for ch in f.lower() if ch.isascii() and ch.isalnum()) for f in optional}
    need = [f for f in required if "".join(ch for ch in f.lower() if ch.isascii() and ch.isalnum()) not in skip]
    if not need:
        return records.select(*KEYS, F.array().cast("array<string>").alias("missing_fields"), F.lit(100).cast("long").alias("completeness"))
    gone = F.array_compact(F.array(*(F.when(is_missing(field_value(f, F.col("_entries"))), F.lit(f)) for f in need)))
    return records.withColumn("_entries", entries_of()).select(*KEYS, gone.alias("missing_fields")).withColumn("completeness", js_round((len(need) - F.size("missing_fields")) * 100 / len(need)))


def qualify(records: DataFrame, evals: DataFrame, complete: DataFrame, conflicts: DataFrame, evidence: DataFrame) -> DataFrame:
    """run_id, record_id, status and reason: any FAIL excludes; then conflicts, then unknown or missing fields, then
    evidence without a confirmed citation; else Qualified. conflicts and evidence need the key columns, field and verification."""
    ordered = lambda keep, what: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("c_seq", what.alias("x"))))), lambda s: s["x"])
    words = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    failed = F.concat(words(F.col("field")), F.lit(": "), F.col("actual"), F.lit(" does not satisfy "), words(F.col("operator")), F.lit(" "), F.col("expected"))
    tests = evals.groupBy(*KEYS).agg(
        F.bool_or(F.col("result") == "FAIL").alias("has_fail"),
        F.bool_or(F.col("result") == "UNKNOWN").alias("has_unknown"),
        F.array_join(ordered(F.col("result") == "FAIL", failed), "; ").alias("failed"),
        ordered(F.col("result") == "UNKNOWN", F.col("field")).alias("unknown"),
    )
    clash = conflicts.groupBy(*KEYS).agg(F.array_join(F.array_sort(F.collect_set("field")), ", ").alias("clash"))
    cited = evidence.groupBy(*KEYS).agg(F.bool_or(F.col("verification") == "Confirmed").alias("confirmed"))
    all_ = records.select(*KEYS).join(tests, KEYS, "left").join(complete, KEYS, "left").join(clash, KEYS, "left").join(cited, KEYS, "left")
    none = F.array().cast("array<string>")
    missing = F.array_distinct(F.concat(F.coalesce("unknown", none), F.coalesce("missing_fields", none)))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    verdict = lambda s, r: F.struct(F.lit(s).alias("status"), r.alias("reason"))
    got = (
        F.when(yes("has_fail"), verdict("Excluded", F.col("failed")))
        .when(F.col("clash").isNotNull(), verdict("Conflict", F.concat(F.lit("Conflicting values across sources for: "), F.col("clash"), F.lit("."))))
        .when(F.size(missing) > 0, verdict("Needs verification", F.concat(F.lit("Missing or unverifiable fields: "), F.array_join(missing, ", "), F.lit(". These fields could not be confirmed from collected sources."))))
        .when(~F.coalesce(F.col("confirmed"), F.lit(True)), verdict("Needs verification", F.lit("All constraints satisfied but evidence citations could not be fully confirmed.")))
        .otherwise(verdict("Qualified", F.lit("All qualification constraints satisfied with verified source evidence.")))
    )
    return all_.withColumn("v", got).select(*KEYS, "v.status", "v.reason", "completeness", F.coalesce("missing_fields", none).alias("missing_fields"))
