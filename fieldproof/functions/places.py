"""Places: city, state, country, remote work, and whether a place meets a required one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldproof.functions.text import is_missing, matches

# City, state, spellings; the first city that occurs decides.
CITIES = [
    ("Bengaluru", "Karnataka", ["bengaluru", "bangalore", "blr", "bangaluru", "whitefield", "electronic city", "koramangala", "indiranagar"]),
    ("Mumbai", "Maharashtra", ["mumbai", "bombay", "navi mumbai", "thane", "bkc", "andheri"]),
    ("Pune", "Maharashtra", ["pune", "poona", "hinjewadi", "magarpatta"]),
    ("Hyderabad", "Telangana", ["hyderabad", "secunderabad", "cyberabad", "hitech city", "gachibowli", "madhapur"]),
    ("Chennai", "Tamil Nadu", ["chennai", "madras", "omr", "guindy", "t nagar", "velachery"]),
    ("Delhi NCR", "Delhi", ["delhi", "new delhi", "ncr", "national capital region"]),
    ("Gurugram", "Haryana", ["gurugram", "gurgaon", "cyber city", "sohna road"]),
    ("Noida", "Uttar Pradesh", ["noida", "greater noida", "sector 62", "sector 125"]),
    ("Kolkata", "West Bengal", ["kolkata", "calcutta", "salt lake", "new town"]),
    ("Ahmedabad", "Gujarat", ["ahmedabad", "gandhinagar", "gift city"]),
    ("Kochi", "Kerala", ["kochi", "cochin", "infopark", "kakkanad"]),
    ("Thiruvananthapuram", "Kerala", ["thiruvananthapuram", "trivandrum", "technopark"]),
    ("Chandigarh", "Chandigarh", ["chandigarh", "mohali", "panchkula"]),
    ("Jaipur", "Rajasthan", ["jaipur"]),
    ("Indore", "Madhya Pradesh", ["indore"]),
    ("Coimbatore", "Tamil Nadu", ["coimbatore"]),
]
STATES = ["andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand", "karnataka", "kerala", "madhya pradesh", "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "punjab", "rajasthan", "sikkim", "tamil nadu", "telangana", "tripura", "uttar pradesh", "uttarakhand", "west bengal", "delhi", "chandigarh"]
# Spellings and big cities of other countries; one country has one name.
COUNTRIES = [
    ("united states", "UNITED STATES"), ("usa", "UNITED STATES"), ("us", "UNITED STATES"),
    ("uk", "UNITED KINGDOM"), ("united kingdom", "UNITED KINGDOM"), ("london", "UNITED KINGDOM"),
    ("singapore", "SINGAPORE"), ("germany", "GERMANY"), ("berlin", "GERMANY"),
    ("canada", "CANADA"), ("toronto", "CANADA"), ("vancouver", "CANADA"),
    ("australia", "AUSTRALIA"), ("sydney", "AUSTRALIA"), ("melbourne", "AUSTRALIA"),
    ("dubai", "UAE"), ("uae", "UAE"), ("netherlands", "NETHERLANDS"), ("amsterdam", "NETHERLANDS"),
    ("ireland", "IRELAND"), ("dublin", "IRELAND"),
]
# Fixed values.
REMOTE = r"\b(remote|work from home|wfh|anywhere)\b"
HYBRID = r"\b(hybrid|flexible)\b"
INDIA = r"\b(india|indian)\b"


def city_pattern(spellings: list[str]) -> str:
    return r"\b(" + "|".join(s.replace(" ", r"\s+") for s in spellings) + r")\b"


def _first(text: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for pattern, value in reversed(rules):
        out = F.when(matches(text, pattern), F.lit(value)).otherwise(out)
    return out


def parse_place(place: Column) -> Column:
    """struct(raw, city, state, country, remote, hybrid); apply to distinct places."""
    raw = F.trim(F.coalesce(place, F.lit("")))
    t = F.lower(raw)
    city = _first(t, [(city_pattern(s), c) for c, _, s in CITIES])
    state = F.coalesce(_first(t, [(city_pattern(s), st) for _, st, s in CITIES]), _first(t, [(city_pattern([s]), s[0].upper() + s[1:]) for s in STATES]))
    country = F.when(state.isNotNull() | matches(t, INDIA), F.lit("India")).otherwise(_first(t, [(city_pattern([s]), c) for s, c in COUNTRIES]))
    return F.struct(raw.alias("raw"), city.alias("city"), state.alias("state"), country.alias("country"), matches(t, REMOTE).alias("remote"), matches(t, HYBRID).alias("hybrid"))


def match_places(required: Column, actual: Column, actual_text: Column) -> Column:
    """struct(result, reason) of two parsed places: PASS, FAIL or UNKNOWN."""
    r, a = required, actual
    verdict = lambda res, *text: F.struct(F.lit(res).alias("result"), F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in text)).alias("reason"))
    same = lambda x, y: F.lower(x) == F.lower(y)
    state_only = r["state"].isNotNull() & r["city"].isNull()
    return (
        F.when(is_missing(actual_text), verdict("UNKNOWN", "LOCATION_NOT_FOUND"))
        .when(r["remote"] & a["remote"], verdict("PASS", "REMOTE_MATCH"))
        .when(r["remote"] & ~a["remote"] & ~a["hybrid"], verdict("FAIL", "ON_SITE_ONLY: required remote, actual is ", a["raw"]))
        .when(r["city"].isNotNull() & same(r["city"], a["city"]), verdict("PASS", "CITY_MATCH: ", a["city"], " matches required ", r["city"]))
        .when(r["city"].isNotNull() & a["city"].isNotNull(), verdict("FAIL", "CITY_MISMATCH: actual ", a["city"], " does not match required ", r["city"]))
        .when(r["city"].isNotNull() & a["remote"] & (a["country"] == r["country"]), verdict("PASS", "REMOTE_IN_TARGET_COUNTRY: Remote role within ", r["country"]))
        .when(r["city"].isNotNull() & a["country"].isNotNull(), verdict("UNKNOWN", "CITY_UNSPECIFIED: Required city ", r["city"], ", but actual only specifies country '", a["country"], "'"))
        .when(state_only & same(r["state"], a["state"]), verdict("PASS", "STATE_MATCH: ", a["state"], " matches ", r["state"]))
        .when(state_only & a["state"].isNotNull(), verdict("FAIL", "STATE_MISMATCH: actual ", a["state"], " does not match ", r["state"]))
        .when(same(r["country"], a["country"]), verdict("PASS", "COUNTRY_MATCH: ", a["country"], " matches required ", r["country"]))
        .when(r["country"].isNotNull() & a["country"].isNotNull(), verdict("FAIL", "COUNTRY_MISMATCH: actual ", a["country"], " does not match required ", r["country"]))
        .when(F.contains(F.lower(a["raw"]), F.lower(r["raw"])), verdict("PASS", "TEXT_MATCH: '", a["raw"], "' contains '", r["raw"], "'"))
        .otherwise(verdict("UNKNOWN", "GEOGRAPHY_INCONCLUSIVE: could not conclusively match '", a["raw"], "' with required '", r["raw"], "'"))
    )
