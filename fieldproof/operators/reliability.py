"""How far the evidence of a record can be trusted: directness, sources, agreement, consistency, fidelity, freshness, score.

Every part is a grouped job on evidence rows; nothing loops over records. ``as_of`` is always given, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldproof.functions.numbers import parse_date
from fieldproof.functions.text import contains_any, extract, is_missing, js_round, matches, norm_key, truthy
from fieldproof.functions.titles import parse_title, titles_match
from fieldproof.functions.urls import NO_URL, SCORING_SECOND_LEVEL, root_domain, tier_score, with_tier
from fieldproof.operators.constraints import looked_up, small
from fieldproof.operators.resolve import leaders
from fieldproof.sources import tables
from fieldproof.sources.tables import stored

KEYS = ["run_id", "record_id"]
# Fixed values.
BOILERPLATE = ["cookie policy", "privacy policy", "all rights reserved", "terms of service", "click here to apply"]
ENTITY_NOISE = ["pvt", "ltd", "inc", "private", "limited", "corp", "technologies", "services"]
STOP_WORDS = ["as", "in", "at", "for", "with", "a", "an", "the", "to", "on", "of", "and", "is", "are", "our", "their"]
OTHER_COMPANY = r"(?i)\b(?:at|for|by|join|with|careers\s+at)\s+([A-Za-z0-9]+)\b"
#: Domains of a record that one pass decides.
FEW = 64
FALLBACK = ["Role", "Location", "Experience"]
FRESH_WORDS = ["currently hiring", "latest", "active jobs", "recent"]
YEARS = r"(?i)\b\d+(?:\s*[-–—to]+\s*\d+)?\s*(?:years?|yrs?)\b"
WEIGHTS = {"support": 0.30, "directness": 0.20, "source_quality": 0.20, "agreement": 0.10, "consistency": 0.10, "fidelity": 0.10}


def rated_sources(pairs: DataFrame) -> DataFrame:
    """(url, entity_name, tier, tier_score), once for each distinct pair."""
    return with_tier(pairs.select("url", "entity_name").distinct()).withColumn("tier_score", tier_score(F.col("tier")))


def _title_matches(rows: DataFrame, value: str, text: str) -> DataFrame:
    """Distinct (value, text) pairs whose titles match: each distinct text is parsed once."""
    pairs = stored(rows.select(F.col(value).alias("x"), F.col(text).alias("y")).distinct())
    x, y = (small(stored(pairs.select(n).distinct().withColumn(f"p{n}", parse_title(F.col(n))))) for n in ("x", "y"))
    return pairs.join(x, "x").join(y, "y").where(titles_match(F.col("px"), F.col("py"))).select("x", "y", F.lit(True).alias("title_match"))


def directness(fields: DataFrame, evidence: DataFrame) -> DataFrame:
    """(run_id, record_id, field, score, level) of fields(run_id, record_id, entity_name, field, value), missing ones included.

    DIRECT 100: a citation of the field states the value, or years of experience, or a matching title. INDIRECT 65: other text of
    25 characters or more; 60: only a citation of another field holds the value. WEAK 25: boilerplate or short. MISSING 0.
    """
    f, ef = norm_key(F.col("field")), norm_key(F.col("ev_field"))
    ev = evidence.select(*KEYS, F.col("field").alias("ev_field"), F.trim(F.coalesce("snippet", F.lit(""))).alias("snippet"))
    stated = fields.where(~is_missing(F.col("value"))).withColumn("v", F.lower(F.trim("value")))
    rows = stated.join(ev.hint("merge"), KEYS)
    low = F.lower("snippet")
    holds = F.contains(low, F.col("v")) & (F.col("snippet") != "")
    mine = F.contains(ef, f) | F.contains(f, ef) | ((F.lower("ev_field") == "general") & holds)
    role = contains_any(f, ["role", "title"])
    weak = (F.length("snippet") < 15) | contains_any(low, BOILERPLATE) | (F.contains(low, F.lit("technology company")) & F.contains(f, F.lit("role")))
    rows = rows.withColumns({"mine": F.coalesce(mine, F.lit(False)), "holds": F.coalesce(holds, F.lit(False)), "role": role, "weak": F.coalesce(weak, F.lit(True)), "f": f})
    # a citation of another field that does not hold the value tells nothing
    rows = stored(rows.where("mine or holds").select(*KEYS, "field", "value", "snippet", "mine", "holds", "role", "weak", "f"))
    titles = _title_matches(rows.where("mine and role and not weak and not holds"), "value", "snippet").withColumnsRenamed({"x": "value", "y": "snippet"})
    rows = looked_up(rows, F.expr("mine and not weak and not holds"), titles, ["value", "snippet"])
    asserted = F.col("holds") | (F.contains("f", F.lit("exp")) & matches(F.col("snippet"), YEARS)) | F.coalesce("title_match", F.lit(False))
    each = F.when(F.col("mine"), F.when(F.col("weak"), 25).when(asserted, 100).when(F.length("snippet") >= 25, 65).otherwise(25))
    best = rows.groupBy(*KEYS, "field").agg(F.max(each).alias("own"), F.bool_or("holds").alias("mentioned"))
    score = F.coalesce("own", F.when(F.col("mentioned"), 60), F.lit(0))
    out = fields.select(*KEYS, "field").join(best.hint("merge"), [*KEYS, "field"], "left").withColumn("score", score)
    level = F.when(F.col("score") == 100, "DIRECT").when(F.col("score") >= 60, "INDIRECT").when(F.col("score") == 25, "WEAK").otherwise("MISSING")
    return out.select(*KEYS, "field", "score", level.alias("level"))


def support(direct: DataFrame) -> DataFrame:
    """(run_id, record_id, support, directness, missing) over the required fields of a record."""
    good = F.col("level").isin("DIRECT", "INDIRECT").cast("int")
    return direct.groupBy(*KEYS).agg(js_round(F.avg(good) * 100).alias("support"), js_round(F.avg("score")).alias("directness"), F.sum((F.col("level") == "MISSING").cast("int")).alias("missing"))


def source_quality(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """(run_id, record_id, source_quality): 0.7 of the best and 0.3 of the mean score of a record's distinct sources: those
    of its citations, its source and its attribute "Source URL"."""
    own = [F.col("source")] + ([F.try_element_at("attributes", F.lit("Source URL"))] if "attributes" in records.columns else [])
    urls = evidence.select(*KEYS, "url").unionByName(records.select(*KEYS, F.explode(F.array(*own)).alias("url"))).where(~F.coalesce("url", F.lit("")).isin(NO_URL)).distinct()
    named = records.select(*KEYS, "entity_name").join(urls, KEYS, "left")
    rated = rated_sources(named)
    rows = named.join(rated.hint("shuffle_hash"), [named["url"].eqNullSafe(rated["url"]), named["entity_name"].eqNullSafe(rated["entity_name"])]).select(named["run_id"], named["record_id"], "tier_score")
    return rows.groupBy(*KEYS).agg(js_round(F.max("tier_score") * 0.7 + js_round(F.avg("tier_score")) * 0.3).alias("source_quality"))


def with_roots(evidence: DataFrame) -> DataFrame:
    """Evidence with the root domain of each url, worked out once for all parts of a score that read it."""
    return evidence.withColumn("url_root", root_domain(F.col("url"), SCORING_SECOND_LEVEL, fallback=True))


def _independent_of_few(first: DataFrame) -> DataFrame:
    """(run_id, record_id, independent, domains) of domains (run_id, record_id, at, w), in one pass over each record's."""
    domains = first.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "w")))), lambda d: d["w"]).alias("ds"))
    # of sets: both / (a + b - both) > 0.85; sizes that are too far apart need no comparison
    near = lambda a, b: (F.size(a) * 100 > F.size(b) * 85) & (F.size(b) * 100 > F.size(a) * 85)
    alike = lambda a, b: near(a, b) & (F.size(F.array_intersect(a, b)) * 185 > (F.size(a) + F.size(b)) * 85)
    start = F.struct(F.array().cast("array<array<string>>").alias("kept"), F.lit(0).alias("n"))
    step = lambda acc, w: F.when(w.isNotNull() & F.exists(acc["kept"], lambda k: alike(k, w)), F.struct(acc["kept"].alias("kept"), acc["n"].alias("n"))).otherwise(F.struct(F.when(w.isNull(), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(w))).alias("kept"), (acc["n"] + 1).alias("n")))
    return domains.select(*KEYS, F.aggregate("ds", start, step)["n"].alias("independent"), F.size("ds").alias("domains"))


def _independent_of_many(first: DataFrame, many: DataFrame) -> DataFrame:
    """The same of records with many domains, by a set similarity join inside each record.

    Equal word sets count as their first domain. Two sets that are alike share one of the rarest words of each: of so many words that
    what is left of a set is too small for 0.85. Domains that meet by such a word, with sizes that leave room, are compared; then a
    domain is independent if no earlier independent one is alike (``resolve.leaders``).
    """
    key = F.struct(*KEYS).alias("run_id")
    sets = stored(first.where("w is not null").groupBy(*KEYS, F.array_sort("w").alias("w")).agg(F.min("at").alias("at")))
    each = sets.select(key, F.col("at").alias("sig"), F.explode("w").alias("word"), F.size("w").alias("m"))
    often = each.groupBy("run_id", "word").agg(F.count("*").alias("n"))
    ranked = each.join(often.hint("merge"), ["run_id", "word"]).groupBy("run_id", "sig", "m").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ws"))
    # the i-th word can only be the first that a set of m words shares with an alike one of ``other`` words if enough words follow
    size, first_words = F.col("m"), F.slice("ws", F.lit(1), (F.col("m") - F.floor(F.col("m") * 85 / 100)).cast("int"))
    rare = ranked.select("run_id", "sig", "m", F.posexplode(first_words).alias("i", "r"))
    rare = rare.withColumn("other", F.explode(F.sequence(F.floor(size * 85 / 100), F.ceil(size * 100 / 85)))).where(size - F.col("i") - 1 >= F.floor((size + F.col("other")) * 85 / 185))
    rare = stored(rare.select("run_id", "sig", F.col("m").cast("long").alias("m"), "other", "r.word"))
    a, b = rare.select("run_id", "word", "m", "other", F.col("sig").alias("a")), rare.select("run_id", "word", F.col("other").alias("m"), F.col("m").alias("other"), F.col("sig").alias("b"))
    met = a.join(b.hint("merge"), ["run_id", "word", "m", "other"]).where("a < b").select("run_id", "a", "b").distinct()
    named = lambda x: sets.select(key, F.col("at").alias(x), F.col("w").alias(f"w_{x}")).hint("merge")
    met = met.join(named("a"), ["run_id", "a"]).join(named("b"), ["run_id", "b"])
    alike = met.where(F.size(F.array_intersect("w_a", "w_b")) * 185 > (F.size("w_a") + F.size("w_b")) * 85).select("run_id", "a", "b")
    led = leaders(sets.select(key, F.col("at").alias("sig")), alike).where("sig = leader").groupBy("run_id").agg(F.count("*").alias("n")).select("run_id.*", "n")
    short = first.where("w is null").groupBy(*KEYS).agg(F.count("*").alias("s"))
    rows = many.join(led.hint("merge"), KEYS, "left").join(short.hint("merge"), KEYS, "left")
    return rows.select(*KEYS, (F.coalesce("n", F.lit(0)) + F.coalesce("s", F.lit(0))).cast("int").alias("independent"), F.col("domains").cast("int").alias("domains"))


def agreement(records: DataFrame, evidence: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(run_id, record_id, agreement, independent, mirrors): independent root domains of a record's sources.

    A domain whose first snippet repeats that of an earlier independent domain (word sets with a Jaccard index over 0.85, both over 30
    characters) is a mirror. Domains go in order of their first citation. One pass over a record's domains decides where they are at
    most FEW; the domains of other records meet by a join on rare words, and are decided in rounds.
    """
    return _agreement(records, with_roots(evidence), conflicts)


def _agreement(records: DataFrame, evidence: DataFrame, conflicts: DataFrame) -> DataFrame:
    """``agreement`` of evidence with roots."""
    root = F.when(F.coalesce("url", F.lit("")) != "", F.col("url_root")).otherwise(root_domain(F.col("source"), SCORING_SECOND_LEVEL, fallback=True))
    # a filter on the root would work it out once more
    first = evidence.withColumn("root", root).groupBy(*KEYS, "root").agg(F.min_by("snippet", "ev_seq").alias("snippet"), F.min("ev_seq").alias("at"))
    words = F.array_distinct(F.split(F.lower(F.coalesce("snippet", F.lit(""))), r"\s+"))
    first = stored(first.select(*KEYS, F.when(truthy(F.col("root")), F.col("at")).alias("at"), F.when(F.length("snippet") > 30, words).alias("w")))
    many = stored(first.groupBy(*KEYS).agg(F.count("at").alias("domains")).where(F.col("domains") > FEW))
    if many.isEmpty():
        counted = _independent_of_few(first)
    else:
        of_few = first.join(many.select(*KEYS).hint("merge"), KEYS, "left_anti")
        counted = _independent_of_few(of_few).unionByName(_independent_of_many(first.join(many.select(*KEYS).hint("merge"), KEYS, "left_semi").where("at is not null"), many))
    head = evidence.groupBy(*KEYS).agg(F.min_by("url", "ev_seq").alias("url"))
    clash = conflicts.select(*KEYS).distinct().withColumn("clash", F.lit(True))
    rows = records.select(*KEYS, "entity_name").join(counted, KEYS, "left").join(head.withColumn("cited", F.lit(True)), KEYS, "left").join(clash, KEYS, "left")
    rows, tier = with_tier(rows), F.col("tier")
    n = F.coalesce("independent", F.lit(0))
    one = F.when(tier == "PRIMARY_OFFICIAL", 85).when(tier == "ESTABLISHED_PLATFORM", 80).when(tier == "SECONDARY_SOURCE", 65).otherwise(45)
    score = F.when(F.col("clash"), 35).when(F.col("cited").isNull(), 20).when(n >= 3, 98).when(n == 2, 92).when(n == 1, one).otherwise(30)
    return rows.select(*KEYS, score.alias("agreement"), n.alias("independent"), (F.coalesce("domains", F.lit(0)) - n).alias("mirrors"))


def consistency(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """(run_id, record_id, consistency): 25 if a citation of 20 characters or more names another company and neither it nor its
    domain names the entity, 50 without an entity name, else 100."""
    return _consistency(records, with_roots(evidence))


def _consistency(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """``consistency`` of evidence with roots."""
    tokens = F.filter(F.split(F.lower("entity_name"), r"[\s,.\-]+"), lambda t: (F.length(t) > 2) & ~t.isin(ENTITY_NOISE))
    rows = records.select(*KEYS, "entity_name", tokens.alias("tokens")).join(evidence.where(F.length("snippet") >= 20).select(*KEYS, "snippet", F.col("url_root").alias("root")), KEYS, "left")
    root, low, me = F.col("root"), F.lower("snippet"), norm_key(F.col("entity_name"))
    named = F.exists("tokens", lambda t: F.contains(low, t) | F.contains(root, t))
    other = F.lower(extract(F.col("snippet"), OTHER_COMPANY))
    alien = ~named & ~other.isin(STOP_WORDS) & (F.length(other) >= 3) & ~F.contains(me, other) & ~F.contains(other, me)
    none = F.col("entity_name").isNull() | F.col("entity_name").isin("", "—")
    return rows.groupBy(*KEYS, "entity_name").agg(F.bool_or(F.coalesce(alien, F.lit(False))).alias("alien")).select(*KEYS, F.when(none, 50).when(F.col("alien"), 25).otherwise(100).alias("consistency"))


def fidelity(fields: DataFrame, evidence: DataFrame) -> DataFrame:
    """(run_id, record_id, fidelity): mean over stated fields of how literally their first citation states the value; 40 without fields."""
    stated = fields.where(F.col("value").isNotNull() & ~F.col("value").isin("—", "Not disclosed"))
    f, ef = norm_key(F.col("field")), norm_key(F.col("ev_field"))
    # the first citation of each field that is cited, not every citation, meets the fields of a record
    cited = evidence.groupBy(*KEYS, F.col("field").alias("ev_field")).agg(F.min(F.struct("ev_seq", F.coalesce("snippet", F.lit("")).alias("snippet"))).alias("c"))
    rows = stated.join(cited.select(*KEYS, "ev_field", "c.*").hint("merge"), KEYS, "left").withColumn("mine", F.contains(ef, f))
    first = rows.groupBy(*KEYS, "field", "value").agg(F.min(F.when(F.col("mine"), F.struct("ev_seq", "snippet")))["snippet"].alias("snippet"))
    low = F.lower("snippet")
    literal = F.contains(low, F.lower(F.trim("value")))
    first = stored(first.withColumns({"literal": literal, "low": low, "role": contains_any(f, ["role", "title"])}))
    titles = _title_matches(first.where("role and snippet <> '' and not literal"), "value", "low").withColumnsRenamed({"x": "value", "y": "low"})
    first = looked_up(first, F.expr("role and snippet <> '' and not literal"), titles, ["value", "low"])
    each = F.when(~truthy(F.col("snippet")), 50).when(F.col("literal"), 100).when(contains_any(f, ["experience", "salary", "size"]), 92).when(F.col("role"), F.when(F.col("title_match"), 88).otherwise(60)).otherwise(75)
    mean = first.groupBy(*KEYS).agg(js_round(F.avg(each)).alias("fidelity"))
    return fields.select(*KEYS).distinct().join(mean.hint("merge"), KEYS, "left").select(*KEYS, F.coalesce("fidelity", F.lit(40)).alias("fidelity"))


def score_plan(requests: DataFrame, constraints: DataFrame) -> DataFrame:
    """(request_id, fields, fresh), one row for each of requests(request_id, prompt, required_fields): what its records are scored by.

    ``fields`` are the required fields; without any, the distinct fields of its constraints(request_id, c_seq, field) in their order;
    without these, FALLBACK. ``fresh`` tells that the text asks for recent evidence. A null text asks for nothing.
    """
    stated = constraints.groupBy("request_id", "field").agg(F.min("c_seq").alias("c_seq")).groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_seq", "field"))), lambda c: c["field"]).alias("stated"))
    fields = F.when(F.size("required_fields") > 0, F.col("required_fields")).when(F.size("stated") > 0, F.col("stated")).otherwise(F.array(*(F.lit(f) for f in FALLBACK)))
    return requests.join(stated.hint("merge"), "request_id", "left").select("request_id", fields.alias("fields"), F.coalesce(contains_any(F.lower("prompt"), FRESH_WORDS), F.lit(False)).alias("fresh"))


def scored_fields(records: DataFrame, plan: DataFrame) -> DataFrame:
    """(run_id, record_id, entity_name, field, value): the fields that the plan of a record's request scores.

    A value is that of the attribute with this name, else of the first (by ``attr_order``) with equal letters and digits; where it is
    missing or empty, of the column for roles, places, experience or companies, unless that is a dash.
    """
    rows = records.join(plan.select("request_id", "fields").hint("merge"), "request_id").withColumn("field", F.explode("fields"))
    f, attribute = norm_key(F.col("field")), lambda k: F.try_element_at("attributes", k)
    alike = F.get(F.filter("attr_order", lambda k: norm_key(k) == f), 0)
    value = F.when(F.map_contains_key("attributes", F.col("field")), attribute(F.col("field"))).otherwise(attribute(alike))
    column = F.when(contains_any(f, ["role", "title"]), F.col("role")).when(contains_any(f, ["location", "city"]), F.col("location")).when(F.contains(f, F.lit("exp")), F.col("experience")).when(contains_any(f, ["company", "brand"]), F.col("company"))
    return rows.select(*KEYS, "entity_name", "field", F.coalesce(F.nullif(value, F.lit("")), F.nullif(column, F.lit("—"))).alias("value"))


def freshness(records: DataFrame, evidence: DataFrame, as_of: Column, required: bool | Column = False) -> DataFrame:
    """(run_id, record_id, freshness, freshness_status, age_days): by the newest date retrieved or "n days ago" in a snippet.

    ``required`` is a flag, or a column of ``records``; old evidence then counts less."""
    required = required if isinstance(required, Column) else F.lit(required)
    ago = extract(F.col("snippet"), r"(?i)(\d+)\s+days?\s+ago").try_cast("int")
    day = F.greatest(F.to_date(parse_date(F.col("retrieved"))), F.date_sub(F.to_date(as_of), ago))
    newest = evidence.groupBy(*KEYS).agg(F.max(day).alias("day"))
    age = F.greatest(F.datediff(as_of, F.col("day")), F.lit(0))
    out = records.select(*KEYS, required.alias("fresh")).join(newest, KEYS, "left").withColumn("age_days", age)
    status = F.when(F.col("day").isNull(), "UNKNOWN").when(F.col("age_days") <= 30, "RECENT").when(F.col("age_days") <= 90, "MODERATE").otherwise("AGED")
    score = F.when(F.col("day").isNull(), 70).when(F.col("age_days") <= 30, 95).when(F.col("age_days") <= 90, 80).otherwise(F.when(F.col("fresh"), 40).otherwise(60))
    return out.select(*KEYS, score.alias("freshness"), status.alias("freshness_status"), F.when(F.col("day").isNotNull(), F.col("age_days")).alias("age_days"))


def reliability(records: DataFrame, fields: DataFrame, evidence: DataFrame, conflicts: DataFrame, as_of: Column, fresh_required: bool | Column = False) -> DataFrame:
    """The composite score (0 to 100) and grade of every record, with its parts and penalties.

    ``fields`` are the required fields of each record. A conflict on one of them costs 35, any other 15; an inconsistent entity 35,
    fidelity under 60 10, each missing field 6. ``fresh_required``, a flag or a column of ``records``, gives freshness a tenth of the score;
    with ``score_plan`` and ``scored_fields`` each request has its own fields and its own flag.
    """
    # seven parts read them: what they come from is worked out once
    evidence, fields = stored(with_roots(evidence.select(*KEYS, "ev_seq", "field", "snippet", "url", "source", "retrieved"))), stored(fields)
    fresh = fresh_required if isinstance(fresh_required, Column) else F.lit(fresh_required)
    parts = records.select(*KEYS, fresh.alias("fresh"))
    for part in (support(directness(fields, evidence)), source_quality(records, evidence), _agreement(records, evidence, conflicts), _consistency(records, evidence), fidelity(fields, evidence), freshness(records, evidence, as_of, fresh_required)):
        parts = parts.join(part.hint("merge"), KEYS, "left")
    low = lambda c: F.lower(c)
    clash = conflicts.select(*KEYS, F.col("field").alias("cf")).join(fields.select(*KEYS, "field").hint("merge"), KEYS, "left").groupBy(*KEYS).agg(F.bool_or(F.contains(low("field"), low("cf")) | F.contains(low("cf"), low("field"))).alias("hits"))
    parts = parts.join(clash.withColumn("clash", F.lit(True)), KEYS, "left")
    conflict_penalty = F.when(F.col("clash").isNull(), 0).when(F.col("hits"), 35).otherwise(15)
    inference = F.when(F.col("consistency") < 100, 35).otherwise(0) + F.when(F.col("fidelity") < 60, 10).otherwise(0) + 6 * F.coalesce("missing", F.lit(0))
    base = sum((F.coalesce(c, F.lit(0)) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    base = F.when(F.col("fresh"), base * 0.9 + F.col("freshness") * 0.1).otherwise(base)
    score = F.least(F.lit(100), F.greatest(F.lit(0), js_round(base - conflict_penalty - inference)))
    out = parts.withColumns({"conflict_penalty": conflict_penalty, "inference_penalty": inference, "score": score.cast("int")})
    return out.withColumn("grade", grade(F.col("score"))).select(*KEYS, *WEIGHTS, "freshness", "conflict_penalty", "inference_penalty", "score", "grade")


def grade(score: Column) -> Column:
    return F.when(score >= 80, "High").when(score >= 60, "Moderate").when(score >= 35, "Low").otherwise("Unverified")


def verification_status(score: Column, support_: Column) -> Column:
    return F.when((score >= 80) & (support_ >= 75), "Confirmed").when(score >= 45, "Partially verified").otherwise("Needs verification")


def calibration(scored: DataFrame, label: Column, predicted: Column, score: Column) -> DataFrame:
    """One row: confusion counts, precision, recall, false rates, accuracy of high and low scores, a histogram in four bands."""
    n = lambda c: F.count_if(c)
    share = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    tp, fp, fn, tn = n(label & predicted), n(~label & predicted), n(label & ~predicted), n(~label & ~predicted)
    high, low = score >= 80, score < 50
    return scored.agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"),
        share(fp, fp + tn).alias("false_qualification_rate"), share(fn, tp + fn).alias("false_exclusion_rate"),
        share(n(label & high), n(high)).alias("high_accuracy"), share(n(~label & low), n(low)).alias("low_accuracy"),
        n(score < 35).alias("band_0_34"), n((score >= 35) & (score < 60)).alias("band_35_59"), n((score >= 60) & (score < 80)).alias("band_60_79"), n(score >= 80).alias("band_80_100"),
    )


def numbered(records: DataFrame) -> DataFrame:
    """Records with a number n by ingest_seq within their run, and ids R-001, R-002, ... from it. A run with all rows is spread over all tasks."""
    n = F.col("n")
    rows = tables.numbered(records, ["ingest_seq", "record_id"], "n", ["run_id"])
    return rows.withColumn("display_id", F.concat(F.lit("R-"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))))
