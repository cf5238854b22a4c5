"""URLs: host, root domain, safety, and what kind of source they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldproof.functions.text import contains_any, norm_key, truthy

# Fixed values.
RESOLVER_SECOND_LEVEL = ["co", "com", "gov", "org", "edu"]
SCORING_SECOND_LEVEL = ["co", "gov", "ac", "nic", "org", "edu"]
BLOCKED_HOSTS = ["localhost", "localhost.localdomain", "127.0.0.1", "0.0.0.0", "::1", "metadata.google.internal", "169.254.169.254", "instance-data"]
PRIVATE_RX = r"^(127\.|10\.|172\.(1[6-9]|2[0-9]|3[0-1])\.|192\.168\.|169\.254\.|0\.|100\.(6[4-9]|[7-9][0-9]|1[0-1][0-9]|12[0-7])\.|::1$|fc00:|fe80:)"
THIRD_PARTY = ["linkedin.com", "naukri.com", "glassdoor.com", "indeed.com", "foundit.in", "monster.com", "cutshort.io", "instahyre.com", "wellfound.com", "hirist.com", "google.com", "bing.com"]
ATS = ["myworkdayjobs.com", "lever.co", "greenhouse.io", "ashbyhq.com", "smartrecruiters.com", "bamboohr.com", "workable.com", "jobvite.com", "icims.com", "breezy.hr", "rippling-ats.com", "recruitee.com"]
CAREER_PATHS = ["/career", "/jobs", "/job/", "/opening", "/apply", "/work-with-us"]
ESTABLISHED = ["linkedin.com", "indeed.com", "naukri.com", "glassdoor.com", "wellfound.com", "angellist.com", "monster.com", "dice.com", "builtina.com", "github.com", "hired.com", "efinancialcareers.com", "stackoverflow.com"]
AGGREGATORS = ["jooble.org", "jooble.com", "talent.com", "neuvoo", "adzuna", "salary.com", "ambitionbox.com", "mouthshut.com", "jobrapido", "simplyhired", "postings", "classifieds", "zwayam", "jobisjob"]
SEARCH_ENGINES = ["google.com", "google.co.in", "bing.com", "duckduckgo.com", "yahoo.com", "search."]
SOURCE_TYPES = [
    ("Job board", ["linkedin", "naukri", "cutshort", "instahyre", "indeed"]),
    ("Product Directory", ["bikedekho", "bikewale", "zigwheels", "auto"]),
    ("Compensation Data", ["glassdoor", "ambitionbox", "levels.fyi"]),
    ("Reference", ["github", "wikipedia", "crunchbase", "tracxn"]),
]
TIER_SCORES = {"PRIMARY_OFFICIAL": 96, "AUTHORITATIVE": 92, "ESTABLISHED_PLATFORM": 86, "AGGREGATOR": 50, "SEARCH_SNIPPET": 30, "SECONDARY_SOURCE": 72}
NO_URL = ["", "—", "Web Source"]


def with_scheme(url: Column) -> Column:
    u = F.trim(url)
    return F.when(F.lower(u).rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def host(url: Column) -> Column:
    """Lower-case host without brackets and leading www., null where there is none."""
    h = F.lower(F.try_parse_url(with_scheme(url), F.lit("HOST")))
    return F.regexp_replace(F.regexp_replace(h, r"^\[|\]$", ""), r"^www\.", "")


def path(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(with_scheme(url), F.lit("PATH"))), F.lit(""))


def root_domain(url: Column, second_level: list[str], fallback: bool = False) -> Column:
    """The last two labels of the host, three after a second-level label of the list.

    ``fallback``: text before the first slash where the URL cannot be parsed, "" for none (scoring); else null."""

    def of(h: Column) -> Column:
        parts = F.split(h, r"\.")
        return F.when(F.size(parts) < 3, h).when(F.element_at(parts, -2).isin(second_level), F.array_join(F.slice(parts, -3, 3), ".")).otherwise(F.array_join(F.slice(parts, -2, 2), "."))

    root = F.element_at(F.transform(F.array(host(url)), of), 1)  # the host is found once: a lambda's variable stands for it
    if fallback:
        bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^https?://", ""), r"^www\.", "")
        return F.when(truthy(url), F.coalesce(root, F.split_part(bare, F.lit("/"), F.lit(1)))).otherwise(F.lit(""))
    return F.when(~url.isin("—", "Not disclosed"), root)


def validate_url(url: Column) -> Column:
    """struct(valid, canonical_url, domain, private, error). Any scheme but http and https is refused."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    other = F.lower(raw).rlike("^[a-z][a-z0-9+.-]*:") & ~F.lower(raw).rlike("^https?://") & ~raw.rlike(r"^[^/:]+:\d+(/|$)")
    full = with_scheme(raw)
    h = F.regexp_replace(F.lower(F.try_parse_url(full, F.lit("HOST"))), r"^\[|\]$", "")
    blocked = h.isin(BLOCKED_HOSTS) | h.endswith(".local") | h.endswith(".internal") | h.rlike(r"^\d+$")
    private = h.rlike(PRIVATE_RX)
    error = (
        F.when(raw == "", F.lit("EMPTY"))
        .when(other, F.lit("UNSUPPORTED_SCHEME"))
        .when(h.isNull(), F.lit("MALFORMED"))
        .when(blocked, F.lit("BLOCKED_HOST"))
        .when(private, F.lit("PRIVATE_ADDRESS"))
    )
    canonical = F.when(F.try_parse_url(full, F.lit("PATH")) == "", F.concat(full, F.lit("/"))).otherwise(full)
    return F.struct(
        error.isNull().alias("valid"),
        F.when(error.isNull(), canonical).otherwise(F.lit("")).alias("canonical_url"),
        F.when(error.isNull(), F.regexp_replace(h, r"^www\.", "")).otherwise(F.lit("")).alias("domain"),
        (error.isin("BLOCKED_HOST", "PRIVATE_ADDRESS") & error.isNotNull()).alias("private"),
        error.alias("error"),
    )


def safe_link(url: Column) -> Column:
    v = validate_url(url)
    return F.when(~url.isin(*NO_URL) & v["valid"], v["canonical_url"]).otherwise(F.lit("#"))


def tier_of(url: Column, domain: Column, path_: Column, entity: Column) -> Column:
    """Tier of a source for an entity, by its host ("" for none), its path and the entity's name in letters and digits: the first rule that holds.

    The rules look at host and path many times, so they should be columns that are worked out already."""
    d, p, e = domain, path_, entity
    tokens = F.split(d, "[.-]")
    own = (F.length(e) >= 3) & F.exists(tokens, lambda t: (t == e) | ((F.length(t) >= 4) & F.contains(e, t)))
    ats = contains_any(d, ATS)
    career = contains_any(p, CAREER_PATHS) | d.startswith("careers.") | d.startswith("jobs.")
    return (
        F.when(url.isNull() | url.isin(NO_URL), F.lit("SEARCH_SNIPPET"))
        .when(((career | F.contains(d, e)) & own) | (ats & (F.contains(p, e) | own)), F.lit("PRIMARY_OFFICIAL"))
        .when(d.endswith(".gov") | d.endswith(".edu") | contains_any(d, [".gov.", ".nic.in", ".edu.", ".ac.in"]), F.lit("AUTHORITATIVE"))
        .when(contains_any(d, ESTABLISHED), F.lit("ESTABLISHED_PLATFORM"))
        .when(contains_any(d, AGGREGATORS), F.lit("AGGREGATOR"))
        .when(contains_any(d, SEARCH_ENGINES) | (d == ""), F.lit("SEARCH_SNIPPET"))
        .otherwise(F.lit("SECONDARY_SOURCE"))
    )


def source_tier(url: Column, entity: Column) -> Column:
    """``tier_of`` as one expression, for a few rows; ``with_tier`` is for tables."""
    return tier_of(url, F.coalesce(host(url), F.lit("")), path(url), norm_key(F.coalesce(entity, F.lit(""))))


def with_tier(rows: DataFrame, url: str = "url", entity: str = "entity_name", to: str = "tier") -> DataFrame:
    """The rows with the tier of each URL for its entity; host, path and name are worked out once for each row."""
    u = F.col(url)
    known = rows.withColumns({"_d": F.coalesce(host(u), F.lit("")), "_p": path(u), "_e": norm_key(F.coalesce(entity, F.lit("")))})
    return known.withColumn(to, tier_of(u, F.col("_d"), F.col("_p"), F.col("_e"))).drop("_d", "_p", "_e")


def tier_score(tier: Column) -> Column:
    out = F.lit(None).cast("int")
    for t, s in TIER_SCORES.items():
        out = F.when(tier == t, F.lit(s)).otherwise(out)
    return out


def source_type(domain: Column) -> Column:
    out = F.lit("Primary")
    for name, parts in reversed(SOURCE_TYPES):
        out = F.when(contains_any(F.lower(domain), parts), F.lit(name)).otherwise(out)
    return out
