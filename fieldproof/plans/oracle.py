"""DuckDB SQL for the registered queries. The views repeat plans.adapters; patterns and lists are the shared fixed values."""

from __future__ import annotations

from fieldproof.functions import places as P
from fieldproof.functions import text as X
from fieldproof.functions import titles as T
from fieldproof.functions import urls as U
from fieldproof.operators import resolve as R
from fieldproof.operators.reliability import BOILERPLATE, ENTITY_NOISE, STOP_WORDS
from fieldproof.plans import adapters as A


def lit(v) -> str:
    if v is None:
        return "NULL"
    return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def pick(values, key: str) -> str:
    n = len(values)
    return f"({arr(values)})[1 + (({key}) % {n})]"


def js_round(e: str) -> str:
    return f"CAST(floor(({e}) + 0.5) AS BIGINT)"


def norm(e: str) -> str:
    return f"regexp_replace(lower({e}), '[^a-z0-9]', '', 'g')"


def missing(e: str) -> str:
    return f"({e} IS NULL OR lower(trim({e})) IN ({', '.join(lit(v) for v in X.MISSING)}))"


def has(e: str, parts) -> str:
    return "(" + " OR ".join(f"contains({e}, {lit(p)})" for p in parts) + ")"


def first(e: str, rules, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({e}, {lit(p)}) THEN {lit(v)}" for p, v in rules) + f" ELSE {default} END"


def rx1(e: str, p: str, g: int = 1, flags: str = "") -> str:
    f = f", '{flags}'" if flags else ""
    return f"nullif(regexp_extract({e}, {lit(p)}, {g}{f}), '')"


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


# ---- views -----------------------------------------------------------------------------------
ATTRS = {
    "Brand": "p_brand", "Type": "p_type", "Price": "CAST(CAST(round(p_retailprice) AS BIGINT) AS VARCHAR)", "Size": "CAST(p_size AS VARCHAR)",
    "Role": pick(A.TITLES, "p_partkey"), "Location": pick(A.PLACES, "p_partkey // 3"), "Experience": pick(A.EXPERIENCE, "p_partkey // 5"),
    "Founded": pick(A.FOUNDED, "p_partkey // 7"), "Salary": pick(A.SALARY, "p_partkey"),
}
_RUN = "'RUN-' || (1 + ({0}) % 3)"
REC = f"rec AS (SELECT {_RUN.format('p_partkey')} AS run_id, p_partkey AS record_id, p_name AS entity_name, " + ", ".join(f"{e} AS {f.lower()}" for f, e in ATTRS.items()) + " FROM part)"
FIELDS_ALL = "fields_all AS (" + " UNION ALL ".join(f"SELECT record_id, entity_name, {lit(f)} AS field, {f.lower()} AS value FROM rec" for f in A.FIELDS) + ")"
FIELDS = "fields AS (SELECT * FROM fields_all WHERE field IN (" + ", ".join(lit(f) for f in A.REQUIRED) + "))"
CON = "con AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in A.CONSTRAINTS) + ") t(request_id, c_seq, field, operator, value, value_to, unit, hard))"
_AT = "(l_linenumber % 7)"
_OWN = "([" + ", ".join(ATTRS[f] for f in A.FIELDS[:7]) + f"])[1 + {_AT}]"
EV = f"""ev0 AS (SELECT l_partkey AS record_id, p_name, l_orderkey AS o, l_linenumber AS n, l_suppkey AS s, l_returnflag, l_shipdate, ({arr(A.FIELDS[:7])})[1 + {_AT}] AS field,
  CASE WHEN (l_orderkey * 7 + l_linenumber) % 97 = 0 THEN 'Alt ' || {_OWN} ELSE {_OWN} END AS value FROM lineitem JOIN part ON l_partkey = p_partkey),
ev AS (SELECT {_RUN.format("record_id")} AS run_id, record_id, o * 10000000 + n * 1000000 + s AS ev_seq, field, value, 'Supplier ' || s AS source,
  CASE o % 10 WHEN 0 THEN 'https://www.linkedin.com/jobs/' || o WHEN 1 THEN 'https://www.google.com/search?q=' || o WHEN 2 THEN 'https://data.labour.gov/list' WHEN 3 THEN '' ELSE 'https://careers.supplier' || s || '.com/jobs/' || o END AS url,
  strftime(l_shipdate, '%Y-%m-%d') AS retrieved,
  CASE (o + n) % 8 WHEN 0 THEN p_name || ' lists ' || field || ' as ' || value || ' on its official page' WHEN 1 THEN field || ' is ' || value WHEN 2 THEN 'Read our cookie policy and terms of service for details'
    WHEN 3 THEN 'short text' WHEN 4 THEN 'Careers at Globex for people who want more' WHEN 5 THEN p_name || ' is hiring across several teams this year' WHEN 6 THEN 'updated 12 days ago by the ' || p_name || ' team' END AS snippet,
  CASE l_returnflag WHEN 'N' THEN 'Confirmed' WHEN 'A' THEN 'Partially verified' ELSE 'Needs verification' END AS verification FROM ev0)"""
CLASH = f"clash AS (SELECT record_id, field FROM ev WHERE NOT {missing('value')} GROUP BY record_id, field HAVING min({norm('value')}) <> max({norm('value')}))"
_OFF = "(l_orderkey * 7 + l_linenumber) % 97 = 0"
CAND = f"""cand AS (SELECT {_RUN.format("l_orderkey // 32")} AS run_id, ((l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey) * 1000000 + l_partkey AS record_id, CASE WHEN l_partkey % 101 = 7 THEN {pick(A.GENERIC_NAMES, 'l_orderkey')} ELSE p_name || ' ' || p_partkey || {pick(A.SUFFIXES, 'l_orderkey')} END AS entity_name,
  CASE WHEN l_orderkey % 10 < 7 THEN NULL ELSE 'supplier' || (l_suppkey % 3) || '.com' END AS domain, {pick([A.TITLES[0], A.TITLES[1], A.TITLES[2], None], 'l_orderkey // 2')} AS title,
  lower({pick(['Bangalore', 'Chennai', None], 'l_linenumber')}) AS place, CAST(round(l_discount * 100) AS INT) AS confidence,
  CASE WHEN {_OFF} THEN p_size || '0' ELSE CAST(p_size AS VARCHAR) END AS size_, CASE WHEN {_OFF} THEN p_type || ' X' ELSE p_type END AS type_,
  CASE WHEN l_orderkey % 10 < 7 THEN 'https://www.linkedin.com/company/x' ELSE 'https://careers.supplier' || (l_suppkey % 3) || '.com/jobs' END AS url
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_LEGAL = r"\b(" + "|".join(R.LEGAL_WORDS) + r")\b\.?"
_GENERIC = f"(name IN ({', '.join(lit(g) for g in R.GENERIC)}) OR length(name) < 2)"
_NAME = f"trim(regexp_replace(regexp_replace(regexp_replace(lower(entity_name), {lit(_LEGAL)}, '', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
SIG = f"""named AS (SELECT *, CASE WHEN {_GENERIC} THEN record_id END AS own FROM (SELECT *, {_NAME} AS name FROM cand)),
sigs AS (SELECT run_id, name, domain, title, place, own, min(record_id) AS sig FROM named GROUP BY ALL),
assigned AS (SELECT record_id, sig FROM named n JOIN sigs s ON n.run_id = s.run_id AND n.name = s.name AND n.domain IS NOT DISTINCT FROM s.domain AND n.title IS NOT DISTINCT FROM s.title AND n.place IS NOT DISTINCT FROM s.place AND n.own IS NOT DISTINCT FROM s.own)"""
PAIRS = """pairs AS (SELECT *, CASE WHEN a_domain = b_domain AND clash THEN 'DIFFERENT_POSITIONS_AT_SAME_COMPANY' WHEN a_domain <> b_domain THEN 'DOMAIN_MISMATCH'
  WHEN clash THEN 'DISTINCT_ROLES_SAME_COMPANY_NAME' WHEN NOT contains(a_place, b_place) AND NOT contains(b_place, a_place) THEN 'AMBIGUOUS_LOCATION' ELSE 'STRONG_IDENTITY_MATCH' END AS reason
  FROM (SELECT a.sig AS a, b.sig AS b, a.domain AS a_domain, b.domain AS b_domain, a.place AS a_place, b.place AS b_place, coalesce(t.clash, false) AS clash
    FROM sigs a JOIN sigs b ON a.run_id = b.run_id AND a.name = b.name AND a.sig < b.sig AND a.own IS NULL AND b.own IS NULL LEFT JOIN tclash t ON t.a = a.title AND t.b = b.title))"""
# leaders in signature order within a name: a walk that takes each next signature and keeps the list of leaders
WALK = """strong AS (SELECT a, b FROM pairs WHERE reason = 'STRONG_IDENTITY_MATCH'), near AS (SELECT b AS sig, list(a ORDER BY a) AS before FROM strong GROUP BY b),
ordered AS (SELECT run_id, name || coalesce(CAST(own AS VARCHAR), '') AS name, sig, coalesce(before, []) AS before, row_number() OVER (PARTITION BY run_id, name, own ORDER BY sig) AS i FROM sigs LEFT JOIN near USING (sig)),
walk AS (SELECT run_id, name, i, sig, [sig] AS leaders, sig AS leader FROM ordered WHERE i = 1
  UNION ALL SELECT o.run_id, o.name, o.i, o.sig, CASE WHEN len(list_intersect(o.before, w.leaders)) = 0 THEN list_append(w.leaders, o.sig) ELSE w.leaders END,
    CASE WHEN len(list_intersect(o.before, w.leaders)) = 0 THEN o.sig ELSE list_min(list_intersect(o.before, w.leaders)) END
  FROM walk w JOIN ordered o ON o.run_id = w.run_id AND o.name = w.name AND o.i = w.i + 1),
clustered AS (SELECT record_id, w.leader AS cluster FROM assigned JOIN walk w USING (sig))"""
RUNS = """per AS (SELECT l_orderkey, count(*) AS collected, count(DISTINCT l_partkey) AS "unique", count(*) FILTER (l_returnflag = 'N') AS validated, count(*) FILTER (l_returnflag = 'R') AS conflicts, count(*) FILTER (l_returnflag = 'A') AS incomplete FROM lineitem GROUP BY l_orderkey),
runs AS (SELECT o_custkey AS request_id, o_orderkey AS run_id, CAST(row_number AS INT) AS run_number, collected, "unique", validated, conflicts, incomplete FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS row_number FROM orders) JOIN per ON o_orderkey = l_orderkey)"""
REQ = f"""req AS (SELECT c_custkey AS request_id, c_name AS name, {pick(A.PROMPTS, 'c_custkey')} AS prompt, CASE WHEN c_custkey % 7 = 0 THEN 'running' ELSE 'completed' END AS status, CASE WHEN c_custkey % 3 = 0 THEN first END AS active_run_id FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey)"""
COMPARE = f"""cov AS (SELECT *, {js_round('validated * 100.0 / "unique"')} AS coverage FROM runs),
cmp AS (SELECT request_id, run_id, run_number, coverage, "unique" - lag("unique", 1, 0) OVER w AS unique_delta, validated - lag(validated, 1, 0) OVER w AS validated_delta, conflicts - lag(conflicts, 1, 0) OVER w AS conflicts_delta, coverage - lag(coverage, 1, 70) OVER w AS coverage_delta FROM cov WINDOW w AS (PARTITION BY request_id ORDER BY run_number))"""


# ---- titles, places, numbers ------------------------------------------------------------------
def norm_title(e: str) -> str:
    t = f"regexp_replace(lower(trim({e})), '[-–—/\\\\&|,;:•·]+', ' ', 'g')"
    t = f"regexp_replace({t}, '[()\\[\\]{{}}]', ' ', 'g')"
    t = f"regexp_replace({t}, '(^|[^a-z])\\.([^a-z]|$)', '\\1 \\2', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def techs(t: str) -> str:
    found, left = [], t
    for p in T.PHRASES:
        found.append(f"CASE WHEN contains({left}, {lit(p)}) THEN {lit(T.TECHNOLOGIES.get(p, p))} END")
        left = f"replace({left}, {lit(p)}, ' ')"
    names = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in T.TECHNOLOGIES.items()) + "}"
    words = f"list_transform(string_split_regex({left}, '\\s+'), lambda w: ({names})[regexp_replace(w, '[^a-z0-9.#+]', '', 'g')])"
    return f"list_filter(list_concat([{', '.join(found)}], {words}), lambda x: x IS NOT NULL)"


_UNIQ = "list_filter(te, lambda x, i: list_position(te, x) = i)"


def titles_cte(source: str) -> str:
    """title(t, fam, te, sen) of the distinct texts of a query that selects column t."""
    return f"""title0 AS (SELECT t, nt, {first('nt', T.ordered_families(), "'UNKNOWN'")} AS fam, {techs('nt')} AS te, {first('nt', T.SENIORITY, "'UNKNOWN'")} AS sen FROM (SELECT t, {norm_title('t')} AS nt FROM ({source}))),
title AS (SELECT t, fam, {_UNIQ} AS te, sen FROM title0)"""


def title_verdict(r: str, a: str) -> tuple[str, str]:
    """(result, reason) of aliases r and a of title."""
    fam = f"CASE WHEN {r}.fam = {a}.fam THEN true WHEN {r}.fam = 'UNKNOWN' OR {a}.fam = 'UNKNOWN' THEN NULL WHEN ({r}.fam = 'FULLSTACK' AND {a}.fam IN ('BACKEND', 'FRONTEND')) OR ({a}.fam = 'FULLSTACK' AND {r}.fam IN ('BACKEND', 'FRONTEND')) THEN NULL ELSE false END"
    lang = arr(T.LANGUAGES)
    tech = f"CASE WHEN len({r}.te) = 0 THEN true WHEN len({a}.te) = 0 THEN NULL WHEN list_has_all({a}.te, {r}.te) THEN true WHEN list_has_any({r}.te, {lang}) AND list_has_any({a}.te, {lang}) AND NOT list_has_any(list_intersect({r}.te, {lang}), {a}.te) THEN false END"
    lev = arr(T.LEVELS)
    sen = f"CASE WHEN {r}.sen = 'UNKNOWN' THEN true WHEN {a}.sen = 'UNKNOWN' THEN NULL ELSE abs(list_position({lev}, {r}.sen) - list_position({lev}, {a}.sen)) <= 1 END"
    need, had = f"array_to_string({r}.te, ', ')", f"array_to_string({a}.te, ', ')"
    result = f"CASE WHEN ({fam}) = false OR ({tech}) = false OR ({sen}) = false THEN 'NO_MATCH' WHEN ({fam}) AND ({tech}) THEN 'MATCH' ELSE 'UNKNOWN' END"
    reason = f"""CASE WHEN ({fam}) = false THEN 'Role family ' || {a}.fam || ' conflicts with required ' || {r}.fam || ' role.' WHEN ({tech}) = false THEN 'Technology ' || {had} || ' does not match required ' || {need} || '.'
      WHEN ({sen}) = false THEN 'Seniority ' || {a}.sen || ' is incompatible with required ' || {r}.sen || '.' WHEN ({fam}) AND ({tech}) THEN 'Role family matches ' || {r}.fam || CASE WHEN len({r}.te) > 0 THEN ' and required technology ' || upper({need}) || ' is present' ELSE '' END || '.'
      WHEN ({fam}) THEN 'Role family matches ' || {r}.fam || ', but required technology ' || upper({need}) || ' could not be confirmed.' WHEN ({tech}) THEN 'Role family could not be reliably determined from the title. Required technology ' || upper({need}) || ' is present.'
      ELSE 'Role family could not be reliably determined from the available evidence.' END"""
    return result, reason


def title_clashes() -> str:
    """tclash(a, b, clash): which titles of the candidates do not go together."""
    return titles_cte("SELECT DISTINCT title AS t FROM cand WHERE title IS NOT NULL") + f", tclash AS (SELECT r.t AS a, x.t AS b, {title_verdict('r', 'x')[0]} = 'NO_MATCH' AS clash FROM title r CROSS JOIN title x)"


CLUSTERED = "WITH RECURSIVE " + ", ".join([CAND, SIG, title_clashes(), PAIRS, WALK]) + " "


def places_cte(source: str) -> str:
    low = "lower(trim(t))"
    city = first(low, [(P.city_pattern(s), c) for c, _, s in P.CITIES])
    state = f"coalesce({first(low, [(P.city_pattern(s), st) for _, st, s in P.CITIES])}, {first(low, [(P.city_pattern([s]), s[0].upper() + s[1:]) for s in P.STATES])})"
    country = f"CASE WHEN {state} IS NOT NULL OR regexp_matches({low}, {lit(P.INDIA)}) THEN 'India' ELSE {first(low, [(P.city_pattern([s]), c) for s, c in P.COUNTRIES])} END"
    return f"place AS (SELECT t, trim(t) AS raw, {city} AS city, {state} AS state, {country} AS country, regexp_matches({low}, {lit(P.REMOTE)}) AS remote, regexp_matches({low}, {lit(P.HYBRID)}) AS hybrid FROM ({source}))"


def place_verdict(r: str, a: str) -> tuple[str, str]:
    rules = [
        (missing(f"{a}.t"), "UNKNOWN", "'LOCATION_NOT_FOUND'"),
        (f"{r}.remote AND {a}.remote", "PASS", "'REMOTE_MATCH'"),
        (f"{r}.remote AND NOT {a}.remote AND NOT {a}.hybrid", "FAIL", f"'ON_SITE_ONLY: required remote, actual is ' || {a}.raw"),
        (f"lower({r}.city) = lower({a}.city)", "PASS", f"'CITY_MATCH: ' || {a}.city || ' matches required ' || {r}.city"),
        (f"{r}.city IS NOT NULL AND {a}.city IS NOT NULL", "FAIL", f"'CITY_MISMATCH: actual ' || {a}.city || ' does not match required ' || {r}.city"),
        (f"{r}.city IS NOT NULL AND {a}.remote AND {a}.country = {r}.country", "PASS", f"'REMOTE_IN_TARGET_COUNTRY: Remote role within ' || {r}.country"),
        (f"{r}.city IS NOT NULL AND {a}.country IS NOT NULL", "UNKNOWN", f"'CITY_UNSPECIFIED: Required city ' || {r}.city || ', but actual only specifies country ''' || {a}.country || ''''"),
        (f"{r}.city IS NULL AND lower({r}.state) = lower({a}.state)", "PASS", f"'STATE_MATCH: ' || {a}.state || ' matches ' || {r}.state"),
        (f"{r}.city IS NULL AND {r}.state IS NOT NULL AND {a}.state IS NOT NULL", "FAIL", f"'STATE_MISMATCH: actual ' || {a}.state || ' does not match ' || {r}.state"),
        (f"lower({r}.country) = lower({a}.country)", "PASS", f"'COUNTRY_MATCH: ' || {a}.country || ' matches required ' || {r}.country"),
        (f"{r}.country IS NOT NULL AND {a}.country IS NOT NULL", "FAIL", f"'COUNTRY_MISMATCH: actual ' || {a}.country || ' does not match required ' || {r}.country"),
        (f"contains(lower({a}.raw), lower({r}.raw))", "PASS", f"'TEXT_MATCH: ''' || {a}.raw || ''' contains ''' || {r}.raw || ''''"),
    ]
    last = f"'GEOGRAPHY_INCONCLUSIVE: could not conclusively match ''' || {a}.raw || ''' with required ''' || {r}.raw || ''''"
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v, _ in rules) + " ELSE 'UNKNOWN' END", "CASE " + " ".join(f"WHEN {c} THEN {t}" for c, _, t in rules) + f" ELSE {last} END"


def numbers_cte(source: str, name: str = "num") -> str:
    """num(t, n, lo, hi): the value in a text, and its range."""
    g = r"\d+(?:,\d{2,3})*(?:\.\d+)?"
    clean = r"trim(regexp_replace(t, '^(?:top|best|list of|\d+\s+best|\d+\s+top)\s+\d+\b', '', 'i'))"
    rng = lambda k: f"TRY_CAST(replace({rx1('c', rf'({g})\s*(?:[-–—]|to)\s*({g})', k, 'i')}, ',', '') AS DOUBLE)"
    val = lambda p, f="i": f"TRY_CAST(replace({rx1('c', p, 1, f)}, ',', '') AS DOUBLE)"
    is_rng = r"lo IS NOT NULL AND hi IS NOT NULL AND NOT regexp_matches(lower(c), '(?:^|[^a-z])(?:lakhs?|crores?|cr)(?:[^a-z]|$)')"
    return f"""{name} AS (SELECT t, CASE WHEN {missing('c')} THEN NULL WHEN {is_rng} THEN lo ELSE coalesce({val(r'(\d+(?:\.\d+)?)\s*(?:lakhs?|l)\b')} * 100000, {val(r'(\d+(?:\.\d+)?)\s*(?:crores?|cr)\b')} * 10000000, {val(r'(\d{1,3}(?:,\d{2,3})+(?:\.\d+)?)')}, {val(r'(\d+(?:\.\d+)?)')}) END AS n,
  CASE WHEN NOT {missing('c')} AND {is_rng} THEN lo END AS lo, CASE WHEN NOT {missing('c')} AND {is_rng} THEN hi END AS hi FROM (SELECT t, c, {rng(1)} AS lo, {rng(2)} AS hi FROM (SELECT t, {clean} AS c FROM ({source}))))"""


def natural(e: str) -> str:
    """Natural order: digits by value."""
    plain = "regexp_replace(p, '^0+(.)', '\\1')"
    return f"array_to_string(list_transform(regexp_extract_all(lower({e}), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(CAST(length({plain}) AS VARCHAR), 4, '0') || {plain} ELSE p END), '')"


def eval_sql(request: str, rec: str = REC, optional: str = "") -> str:
    """CTEs up to evals(record_id, c_seq, field, operator, expected, actual, normalized_value, result, reason)."""
    tr, tx = title_verdict("r", "a")
    pr, px = place_verdict("pr", "pa")
    role, place = "field = 'Role' AND operator IN ('equals', 'contains', 'semantic_match')", "field = 'Location' AND operator IN ('equals', 'contains', 'semantic_match', 'not_equals', 'not_contains')"
    numeric = "operator IN ('less_than', 'less_than_or_equal', 'greater_than', 'greater_than_or_equal', 'between')"
    date = lambda e: f"coalesce(TRY_CAST(CASE WHEN regexp_matches({e}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN {e} END AS TIMESTAMP), TRY_CAST({rx1(e, r'\b(19\d\d|20\d\d)\b')} || '-01-01' AS TIMESTAMP))"
    # condition, passes (or a fixed verdict), good, bad
    tests = [
        ("operator = 'less_than'", "n < target", "WITHIN_LIMIT", "VALUE_EXCEEDS_MAXIMUM"),
        ("operator = 'less_than_or_equal'", "n <= target", "WITHIN_LIMIT", "VALUE_EXCEEDS_MAXIMUM"),
        ("operator = 'greater_than'", "n > target", "MEETS_MINIMUM", "VALUE_BELOW_MINIMUM"),
        ("operator = 'greater_than_or_equal'", "n >= target", "MEETS_MINIMUM", "VALUE_BELOW_MINIMUM"),
        ("operator = 'between'", "CASE WHEN lo IS NOT NULL THEN NOT (hi < target OR lo > upto) ELSE n BETWEEN target AND upto END", "WITHIN_RANGE", "OUTSIDE_RANGE"),
        ("operator = 'before'", "day < want", "BEFORE_DATE_SATISFIED", "DATE_BEFORE_VIOLATION"),
        ("operator = 'after'", "day > want", "AFTER_DATE_SATISFIED", "DATE_AFTER_VIOLATION"),
        ("operator = 'in'", "listed", "MEMBER_OF_ALLOWED_SET", "NOT_IN_ALLOWED_SET"),
        ("operator = 'not_in'", "NOT listed", "NOT_IN_DISALLOWED_SET", "FOUND_IN_DISALLOWED_SET"),
        ("operator = 'contains_any'", "listed", "CONTAINS_ANY_SATISFIED", "CONTAINS_ANY_FAILED"),
        ("operator = 'contains_all'", "len(list_filter(items, lambda x: NOT contains(v, x))) = 0", "CONTAINS_ALL_SATISFIED", "CONTAINS_ALL_FAILED"),
        ("operator = 'starts_with'", "starts_with(v, w)", "STARTS_WITH_MATCH", "DOES_NOT_START_WITH"),
        ("operator = 'ends_with'", "ends_with(v, w)", "ENDS_WITH_MATCH", "DOES_NOT_END_WITH"),
        ("operator = 'not_equals'", "v <> w", "NOT_EQUAL_SATISFIED", "VALUE_EQUALS_DISALLOWED"),
        ("operator = 'not_contains'", "NOT contains(v, w)", "DOES_NOT_CONTAIN", "CONTAINS_DISALLOWED_TEXT"),
        ("operator = 'within' AND n IS NOT NULL AND target IS NOT NULL", "abs(n - target) <= coalesce(TRY_CAST(value_to AS DOUBLE), target * 0.15)", "WITHIN_TOLERANCE", "OUTSIDE_TOLERANCE"),
        ("operator = 'within'", "contains(v, w)", "WITHIN_MATCH", "OUTSIDE_BOUNDS"),
        ("operator IN ('equals', 'contains', 'semantic_match')", "contains(v, w)", "MATCHES", "DOES_NOT_MATCH"),
    ]
    flip = "CASE p_result WHEN 'PASS' THEN 'FAIL' WHEN 'FAIL' THEN 'PASS' ELSE 'UNKNOWN' END"
    head = [
        ("is_missing", "'UNKNOWN'", "'FIELD_NOT_FOUND'"),
        (f"{numeric} AND (n IS NULL OR target IS NULL)", "'UNKNOWN'", "'VALUE_UNPARSEABLE'"),
    ]
    mid = [
        (role, "CASE r_result WHEN 'MATCH' THEN 'PASS' WHEN 'NO_MATCH' THEN 'FAIL' ELSE 'UNKNOWN' END", "r_reason"),
        (f"{place} AND operator NOT LIKE 'not%'", "p_result", "p_reason"),
        (place, flip, f"CASE WHEN {flip} = 'PASS' THEN 'LOCATION_EXCLUDED_AS_REQUESTED' ELSE 'LOCATION_MATCHES_DISALLOWED' END"),
        ("operator IN ('before', 'after') AND (day IS NULL OR want IS NULL)", "'UNKNOWN'", "'DATE_UNPARSEABLE'"),
    ]
    rows = head + [(c, f"CASE WHEN {p} THEN 'PASS' ELSE 'FAIL' END", f"CASE WHEN {p} THEN '{g}' ELSE '{b}' END") for c, p, g, b in tests[:5]] + mid + [(c, f"CASE WHEN {p} THEN 'PASS' ELSE 'FAIL' END", f"CASE WHEN {p} THEN '{g}' ELSE '{b}' END") for c, p, g, b in tests[5:]]
    result = "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r, _ in rows) + " ELSE 'UNKNOWN' END"
    reason = "CASE " + " ".join(f"WHEN {c} THEN {t}" for c, _, t in rows) + " ELSE 'UNSUPPORTED_OPERATOR' END"
    asked = "trim(CASE WHEN operator = 'between' THEN value || ' to ' || coalesce(value_to, '—') || ' ' || coalesce(unit, '') ELSE replace(operator, '_', ' ') || ' ' || value || ' ' || coalesce(unit, '') END)"
    expected = f"""CASE WHEN is_missing OR {numeric} THEN {asked} WHEN {place} AND operator LIKE 'not%' THEN 'NOT ' || value WHEN operator IN ('in', 'not_in') THEN '[' || array_to_string(items, ', ') || ']'
      WHEN operator = 'contains_any' THEN '[' || array_to_string(items, ' OR ') || ']' WHEN operator = 'contains_all' THEN '[' || array_to_string(items, ' AND ') || ']' WHEN operator = 'not_equals' THEN '!= ' || value WHEN operator = 'not_contains' THEN 'NOT CONTAINS ' || value
      WHEN operator = 'within' AND n IS NOT NULL THEN value || ' ±' || coalesce(value_to, CAST(CAST(target * 0.15 AS BIGINT) AS VARCHAR)) ELSE value END"""
    normal = f"CASE WHEN is_missing THEN NULL WHEN ({numeric} OR operator = 'within') AND target IS NOT NULL THEN n WHEN operator IN ('before', 'after') AND day IS NOT NULL AND want IS NOT NULL THEN CAST(epoch_ms(day) AS DOUBLE) END"
    return ", ".join(
        [
            rec, FIELDS_ALL, CON,
            f"""raw AS (SELECT r.record_id, c.c_seq, c.field, c.operator, c.value, c.value_to, c.unit, coalesce(f.value, '') AS actual FROM rec r CROSS JOIN con c LEFT JOIN fields_all f ON f.record_id = r.record_id AND f.field = c.field WHERE c.hard AND c.request_id = '{request}')""",
            titles_cte("SELECT DISTINCT actual AS t FROM raw WHERE field = 'Role' UNION SELECT DISTINCT value FROM raw WHERE field = 'Role'"),
            places_cte("SELECT DISTINCT actual AS t FROM raw WHERE field = 'Location' UNION SELECT DISTINCT value FROM raw WHERE field = 'Location'"),
            numbers_cte("SELECT DISTINCT actual AS t FROM raw"),
            f"""full_ AS (SELECT raw.*, {missing('actual')} AS is_missing, num.n, num.lo, num.hi, TRY_CAST(value AS DOUBLE) AS target, coalesce(TRY_CAST(value_to AS DOUBLE), TRY_CAST(value AS DOUBLE)) AS upto, {date('actual')} AS day, {date('value')} AS want,
              list_filter(list_transform(string_split_regex(lower(value), '[,|]'), lambda x: trim(x)), lambda x: x <> '') AS items, lower(trim(actual)) AS v, lower(trim(value)) AS w, {tr} AS r_result, {tx} AS r_reason, {pr} AS p_result, {px} AS p_reason
              FROM raw LEFT JOIN num ON num.t = actual LEFT JOIN title r ON r.t = value AND field = 'Role' LEFT JOIN title a ON a.t = actual AND field = 'Role' LEFT JOIN place pr ON pr.t = value AND field = 'Location' LEFT JOIN place pa ON pa.t = actual AND field = 'Location')""",
            "full2 AS (SELECT *, len(list_filter(items, lambda x: contains(v, x))) > 0 AS listed FROM full_)",
            f"evals AS (SELECT record_id, c_seq, field, operator, {expected} AS expected, CASE WHEN NOT is_missing THEN actual END AS actual, {normal} AS normalized_value, {result} AS result, {reason} AS reason FROM full2)",
        ]
    )


def verdicts_sql(need: list[str]) -> str:
    return f"""comp AS (SELECT record_id, list_filter([{', '.join(f"CASE WHEN {missing(f.lower())} THEN {lit(f)} END" for f in need)}], lambda x: x IS NOT NULL) AS missing_fields FROM rec),
tested AS (SELECT record_id, bool_or(result = 'FAIL') AS has_fail, string_agg(replace(field, '_', ' ') || ': ' || actual || ' does not satisfy ' || replace(operator, '_', ' ') || ' ' || expected, '; ' ORDER BY c_seq) FILTER (result = 'FAIL') AS failed,
  coalesce(list(field ORDER BY c_seq) FILTER (result = 'UNKNOWN'), []) AS unknown FROM evals GROUP BY record_id),
clashing AS (SELECT record_id, string_agg(DISTINCT field, ', ' ORDER BY field) AS c FROM clash GROUP BY record_id), cited AS (SELECT record_id, bool_or(verification = 'Confirmed') AS confirmed FROM ev GROUP BY record_id),
lacks AS (SELECT *, list_concat(unknown, list_filter(missing_fields, lambda x: NOT list_contains(unknown, x))) AS lack FROM rec JOIN comp USING (record_id) JOIN tested USING (record_id) LEFT JOIN clashing USING (record_id) LEFT JOIN cited USING (record_id)),
verdicts AS (SELECT record_id, missing_fields, {js_round(f'({len(need)} - len(missing_fields)) * 100.0 / {len(need)}')} AS completeness,
  CASE WHEN has_fail THEN 'Excluded' WHEN c IS NOT NULL THEN 'Conflict' WHEN len(lack) > 0 OR NOT coalesce(confirmed, true) THEN 'Needs verification' ELSE 'Qualified' END AS status,
  CASE WHEN has_fail THEN failed WHEN c IS NOT NULL THEN 'Conflicting values across sources for: ' || c || '.' WHEN len(lack) > 0 THEN 'Missing or unverifiable fields: ' || array_to_string(lack, ', ') || '. These fields could not be confirmed from collected sources.'
    WHEN NOT coalesce(confirmed, true) THEN 'All constraints satisfied but evidence citations could not be fully confirmed.' ELSE 'All qualification constraints satisfied with verified source evidence.' END AS reason FROM lacks)"""


VERDICTS = verdicts_sql([f for f in A.REQUIRED if f != "Experience"])
SUMMARY = f"SELECT run_id, count(*) AS collected, count(*) FILTER (status = 'Qualified') AS qualified, count(*) FILTER (status = 'Needs verification') AS needs_verification, count(*) FILTER (status = 'Conflict') AS conflicts, count(*) FILTER (status = 'Excluded') AS excluded, count(*) FILTER (len(missing_fields) > 0) AS incomplete FROM verdicts JOIN (SELECT run_id, record_id FROM rec) USING (record_id) GROUP BY run_id"

# ---- sources ----------------------------------------------------------------------------------
HOST = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '')"


def root(h: str, second) -> str:
    parts = f"string_split({h}, '.')"
    return f"CASE WHEN len({parts}) < 3 THEN {h} WHEN list_contains({arr(second)}, {parts}[-2]) THEN array_to_string({parts}[-3:], '.') ELSE array_to_string({parts}[-2:], '.') END"


_D, _P, _E = f"coalesce({HOST}, '')", "lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1))", norm("entity_name")
_OWN_DOMAIN = f"(length({_E}) >= 3 AND len(list_filter(string_split_regex({_D}, '[.-]'), lambda t: t = {_E} OR (length(t) >= 4 AND contains({_E}, t)))) > 0)"
TIER = f"""CASE WHEN url IS NULL OR url IN ('', '—', 'Web Source') THEN 'SEARCH_SNIPPET'
  WHEN ({_OWN_DOMAIN} AND ({has(_P, U.CAREER_PATHS)} OR starts_with({_D}, 'careers.') OR starts_with({_D}, 'jobs.') OR contains({_D}, {_E}))) OR ({has(_D, U.ATS)} AND ({_OWN_DOMAIN} OR contains({_P}, {_E}))) THEN 'PRIMARY_OFFICIAL'
  WHEN ends_with({_D}, '.gov') OR ends_with({_D}, '.edu') OR {has(_D, ['.gov.', '.nic.in', '.edu.', '.ac.in'])} THEN 'AUTHORITATIVE' WHEN {has(_D, U.ESTABLISHED)} THEN 'ESTABLISHED_PLATFORM'
  WHEN {has(_D, U.AGGREGATORS)} THEN 'AGGREGATOR' WHEN {has(_D, U.SEARCH_ENGINES)} OR {_D} = '' THEN 'SEARCH_SNIPPET' ELSE 'SECONDARY_SOURCE' END"""
SCORE = "CASE tier " + " ".join(f"WHEN '{t}' THEN {s}" for t, s in U.TIER_SCORES.items()) + " END"
RATED = f"rated AS (SELECT *, {SCORE} AS tier_score FROM (SELECT url, entity_name, {TIER} AS tier FROM (SELECT DISTINCT url, entity_name FROM ev JOIN rec USING (record_id))))"
_ROLE_OK = title_verdict("r", "a")[0]


def title_pairs(name: str, source: str) -> str:
    """name(x, y): pairs of a query with columns x, y whose titles match."""
    return f"{name}_p AS ({source}), {titles_cte(f'SELECT x AS t FROM {name}_p UNION SELECT y FROM {name}_p').replace('title0', name + '_t0').replace('title AS', name + '_t AS')}, {name} AS (SELECT x, y FROM {name}_p JOIN {name}_t r ON r.t = x JOIN {name}_t a ON a.t = y WHERE {_ROLE_OK} = 'MATCH')"


_LOW = "lower(coalesce(trim(snippet), ''))"
DIRECT = f"""cites AS (SELECT f.record_id, f.field, f.value, lower(trim(f.value)) AS v, e.field AS ev_field, coalesce(trim(snippet), '') AS snip, lower(coalesce(trim(snippet), '')) AS low FROM fields f JOIN ev e USING (record_id) WHERE NOT {missing('f.value')}),
flags AS (SELECT *, contains({norm('ev_field')}, {norm('field')}) OR contains({norm('field')}, {norm('ev_field')}) AS mine, snip <> '' AND contains(low, v) AS holds, length(snip) < 15 OR {has('low', BOILERPLATE)} AS weak FROM cites),
{title_pairs('tm', "SELECT DISTINCT value AS x, snip AS y FROM flags WHERE mine AND field = 'Role' AND NOT weak AND NOT holds")},
best AS (SELECT record_id, field, max(CASE WHEN mine THEN CASE WHEN weak THEN 25 WHEN holds OR (field = 'Experience' AND regexp_matches(snip, '\\b\\d+(?:\\s*[-–—to]+\\s*\\d+)?\\s*(?:years?|yrs?)\\b', 'i')) OR tm.x IS NOT NULL THEN 100 WHEN length(snip) >= 25 THEN 65 ELSE 25 END END) AS own, bool_or(holds) AS mentioned
  FROM flags LEFT JOIN tm ON tm.x = value AND tm.y = snip GROUP BY record_id, field),
direct AS (SELECT record_id, field, score, CASE WHEN score = 100 THEN 'DIRECT' WHEN score >= 60 THEN 'INDIRECT' WHEN score = 25 THEN 'WEAK' ELSE 'MISSING' END AS level FROM (SELECT f.record_id, f.field, coalesce(own, CASE WHEN mentioned THEN 60 END, 0) AS score FROM fields f LEFT JOIN best b ON b.record_id = f.record_id AND b.field = f.field))"""
_GOOD = "avg(CASE WHEN level IN ('DIRECT', 'INDIRECT') THEN 1 ELSE 0 END) * 100"
SUPPORT = f"support_ AS (SELECT record_id, {js_round(_GOOD)} AS support, {js_round('avg(score)')} AS directness, count(*) FILTER (level = 'MISSING') AS missing FROM direct GROUP BY record_id)"
QUALITY = f"""quality AS (SELECT record_id, {js_round(f"max(tier_score) * CAST(0.7 AS DOUBLE) + {js_round('avg(tier_score)')} * CAST(0.3 AS DOUBLE)")} AS source_quality FROM (SELECT DISTINCT r.record_id, u.url, coalesce(x.tier_score, 30) AS tier_score FROM rec r LEFT JOIN (SELECT record_id, url FROM ev WHERE coalesce(url, '') NOT IN ('', '—', 'Web Source')) u ON u.record_id = r.record_id LEFT JOIN rated x ON x.url = u.url AND x.entity_name = r.entity_name) GROUP BY record_id)"""
_RT = f"CASE WHEN coalesce(url, '') = '' THEN source ELSE {root(HOST, U.SCORING_SECOND_LEVEL)} END"
_ALIKE = "len(list_intersect(k, n.w)) / len(list_distinct(list_concat(k, n.w))) > 0.85"
AGREE = f"""dom AS (SELECT record_id, {_RT} AS root, min(ev_seq) AS pos_, arg_min(coalesce(snippet, ''), ev_seq) AS snip FROM ev GROUP BY ALL),
dom2 AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY pos_) AS i, CASE WHEN length(snip) > 30 THEN list_distinct(string_split_regex(lower(snip), '\\s+')) END AS w FROM dom WHERE root <> ''),
steps AS (SELECT record_id, 0::BIGINT AS i, CAST([] AS VARCHAR[][]) AS kept, 0 AS n FROM rec
  UNION ALL SELECT s.record_id, n.i, CASE WHEN n.w IS NULL OR len(list_filter(s.kept, lambda k: {_ALIKE})) > 0 THEN s.kept ELSE list_append(s.kept, n.w) END,
    s.n + CASE WHEN n.w IS NOT NULL AND len(list_filter(s.kept, lambda k: {_ALIKE})) > 0 THEN 0 ELSE 1 END FROM steps s JOIN dom2 n ON n.record_id = s.record_id AND n.i = s.i + 1),
head AS (SELECT record_id, arg_min(url, ev_seq) AS url FROM ev GROUP BY record_id),
ended AS (SELECT record_id, max(i) AS domains, arg_max(n, i) AS independent FROM steps GROUP BY record_id),
agree AS (SELECT e.record_id, CASE WHEN c.record_id IS NOT NULL THEN 35 WHEN h.record_id IS NULL THEN 20 WHEN independent >= 3 THEN 98 WHEN independent = 2 THEN 92
  WHEN independent = 1 THEN CASE coalesce(x.tier, 'SEARCH_SNIPPET') WHEN 'PRIMARY_OFFICIAL' THEN 85 WHEN 'ESTABLISHED_PLATFORM' THEN 80 WHEN 'SECONDARY_SOURCE' THEN 65 ELSE 45 END ELSE 30 END AS agreement, independent, domains - independent AS mirrors
  FROM ended e JOIN rec r USING (record_id) LEFT JOIN head h ON h.record_id = e.record_id LEFT JOIN rated x ON x.url = h.url AND x.entity_name = r.entity_name LEFT JOIN (SELECT DISTINCT record_id FROM clash) c ON c.record_id = e.record_id)"""
_TOK = f"list_filter(string_split_regex(lower(entity_name), '[\\s,.\\-]+'), lambda t: length(t) > 2 AND t NOT IN ({', '.join(lit(x) for x in ENTITY_NOISE)}))"
_ME, _OTHER = norm("entity_name"), "lower(nullif(regexp_extract(snippet, '\\b(?:at|for|by|join|with|careers\\s+at)\\s+([A-Za-z0-9]+)\\b', 1, 'i'), ''))"
CONSIST = f"""ent AS (SELECT record_id, entity_name, {_ME} AS me, {_TOK} AS toks, low, other, root FROM rec LEFT JOIN (SELECT record_id, lower(snippet) AS low, {_OTHER} AS other, CASE WHEN coalesce(url, '') = '' THEN '' ELSE {root(HOST, U.SCORING_SECOND_LEVEL)} END AS root FROM ev WHERE length(snippet) >= 20) USING (record_id)),
consist AS (SELECT record_id, CASE WHEN bool_or(coalesce(len(list_filter(toks, lambda t: contains(low, t) OR contains(root, t))) = 0 AND other NOT IN ({', '.join(lit(x) for x in STOP_WORDS)}) AND length(other) >= 3 AND NOT contains(me, other) AND NOT contains(other, me), false)) THEN 25 ELSE 100 END AS consistency FROM ent GROUP BY record_id)"""


def fidelity_sql(fields: str, name: str) -> str:
    return f"""{name}_f AS (SELECT f.record_id, f.field, f.value, arg_min(coalesce(e.snippet, ''), e.ev_seq) FILTER (contains({norm('e.field')}, {norm('f.field')})) AS snip FROM {fields} f LEFT JOIN ev e USING (record_id) WHERE f.value IS NOT NULL AND f.value NOT IN ('—', 'Not disclosed') GROUP BY ALL),
{title_pairs(name + '_m', f"SELECT DISTINCT value AS x, lower(snip) AS y FROM {name}_f WHERE field = 'Role' AND snip <> '' AND NOT contains(lower(snip), lower(trim(value)))")},
{name} AS (SELECT record_id, {js_round("avg(CASE WHEN coalesce(snip, '') = '' THEN 50 WHEN contains(lower(snip), lower(trim(value))) THEN 100 WHEN field IN ('Experience', 'Salary', 'Size') THEN 92 WHEN field = 'Role' THEN CASE WHEN m.x IS NOT NULL THEN 88 ELSE 60 END ELSE 75 END)")} AS fidelity
  FROM {name}_f LEFT JOIN {name}_m m ON m.x = value AND m.y = lower(snip) GROUP BY record_id)"""


FRESH = f"""fresh AS (SELECT record_id, CASE WHEN day IS NULL THEN 70 WHEN age <= 30 THEN 95 WHEN age <= 90 THEN 80 ELSE 60 END AS freshness, CASE WHEN day IS NULL THEN 'UNKNOWN' WHEN age <= 30 THEN 'RECENT' WHEN age <= 90 THEN 'MODERATE' ELSE 'AGED' END AS freshness_status, CASE WHEN day IS NOT NULL THEN age END AS age_days
  FROM (SELECT record_id, day, greatest(date_diff('day', day, DATE '{A.AS_OF}'), 0) AS age FROM rec LEFT JOIN (SELECT record_id, max(greatest(CAST(retrieved AS DATE), coalesce(DATE '{A.AS_OF}' - TRY_CAST(regexp_extract(snippet, '(\\d+)\\s+days?\\s+ago', 1, 'i') AS INT), CAST(retrieved AS DATE)))) AS day FROM ev GROUP BY record_id) USING (record_id)))"""
RELIABLE = f"""hits AS (SELECT c.record_id, bool_or(contains(lower(f.field), lower(c.field)) OR contains(lower(c.field), lower(f.field))) AS hits FROM clash c JOIN fields f USING (record_id) GROUP BY c.record_id),
parts AS (SELECT r.record_id, support, directness, source_quality, agreement, consistency, coalesce(fidelity, 40) AS fidelity, freshness, CASE WHEN h.record_id IS NULL THEN 0 WHEN hits THEN 35 ELSE 15 END AS conflict_penalty,
  CASE WHEN consistency < 100 THEN 35 ELSE 0 END + CASE WHEN coalesce(fidelity, 40) < 60 THEN 10 ELSE 0 END + 6 * missing AS inference_penalty
  FROM rec r JOIN support_ USING (record_id) JOIN quality USING (record_id) JOIN agree USING (record_id) JOIN consist USING (record_id) LEFT JOIN fid USING (record_id) JOIN fresh USING (record_id) LEFT JOIN hits h ON h.record_id = r.record_id),
scored AS (SELECT *, CAST(least(100, greatest(0, floor(0.3::DOUBLE * support + 0.2::DOUBLE * directness + 0.2::DOUBLE * source_quality + 0.1::DOUBLE * agreement + 0.1::DOUBLE * consistency + 0.1::DOUBLE * fidelity - conflict_penalty - inference_penalty + 0.5::DOUBLE))) AS INT) AS score FROM parts)"""
# four requests: fields stated, those of constraints, none, and others; the second and the last ask for recent evidence
_FRESH_ASKED = "record_id % 4 IN (1, 3)"
ASKED_FIELDS = "fields AS (" + " UNION ALL ".join(f"SELECT record_id, entity_name, {lit(f)} AS field, {v} AS value FROM rec WHERE record_id % 4 = {k}" for k, f, v in ((0, "Brand", "brand"), (0, "Price", "price"), (1, "Size", "size"), (1, "Role", "role"), (2, "Role", "role"), (2, "Location", "location"), (2, "Experience", "experience"), (3, "Experience", "experience"), (3, "Company Name", "brand"))) + ")"
ASKED_EV = "cited AS (SELECT record_id, url FROM ev UNION ALL SELECT record_id, 'https://data.labour.gov/list/' || record_id FROM rec WHERE record_id % 3 = 0)"
ASKED_FRESH = FRESH.replace("ELSE 60 END AS freshness", f"WHEN {_FRESH_ASKED} THEN 40 ELSE 60 END AS freshness")
_BASE = "0.3::DOUBLE * support + 0.2::DOUBLE * directness + 0.2::DOUBLE * source_quality + 0.1::DOUBLE * agreement + 0.1::DOUBLE * consistency + 0.1::DOUBLE * fidelity"
ASKED_RELIABLE = RELIABLE.replace(_BASE, f"CASE WHEN {_FRESH_ASKED} THEN ({_BASE}) * 0.9::DOUBLE + freshness * 0.1::DOUBLE ELSE {_BASE} END")
_ROLE_PAIRS = f"titles_ AS (SELECT role AS t, count(*) AS records FROM rec GROUP BY role)"
_ITEM = "to_json({'entityName': 'Entity ' || doc_id, 'role': 'chars ' || n_chars, 'location': source})"
_WRAP = "CASE doc_id % 5 WHEN 2 THEN 'https://host' || (doc_id % 7) || '.example.com/a?b=1' WHEN 3 THEN 'https://www.example.org/x' END"
_EXTRACT = """found AS (SELECT request_id AS id, unnest([
  CASE WHEN contains(prompt, '50-500 employees') THEN {'field': 'company_size', 'operator': 'between', 'value': '50', 'value_to': '500', 'unit': 'employees', 'hard': true, 'label': 'Company Size: 50–500 employees'} END,
  CASE WHEN contains(prompt, '20 to 80 staff') THEN {'field': 'company_size', 'operator': 'between', 'value': '20', 'value_to': '80', 'unit': 'employees', 'hard': true, 'label': 'Company Size: 20–80 employees'} END,
  CASE WHEN contains(prompt, 'under ₹2 lakh') THEN {'field': 'price', 'operator': 'less_than_or_equal', 'value': '200000', 'value_to': NULL, 'unit': 'INR', 'hard': true, 'label': 'Price: <= ₹2 lakh INR'} END,
  CASE WHEN contains(prompt, 'under ₹1.5 lakh') THEN {'field': 'price', 'operator': 'less_than_or_equal', 'value': '150000', 'value_to': NULL, 'unit': 'INR', 'hard': true, 'label': 'Price: <= ₹1.5 lakh INR'} END,
  CASE WHEN contains(prompt, 'at least 100 km') THEN {'field': 'range', 'operator': 'greater_than_or_equal', 'value': '100', 'value_to': NULL, 'unit': 'km', 'hard': true, 'label': 'Range: >= 100 km'} END,
  CASE WHEN contains(prompt, 'in India') THEN {'field': 'location', 'operator': 'contains', 'value': 'India', 'value_to': NULL, 'unit': NULL, 'hard': false, 'label': 'Location: contains "India"'} END,
  CASE WHEN contains(prompt, 'in Pune') THEN {'field': 'location', 'operator': 'contains', 'value': 'Pune', 'value_to': NULL, 'unit': NULL, 'hard': false, 'label': 'Location: contains "Pune"'} END,
  CASE WHEN contains(prompt, 'in Chennai') THEN {'field': 'location', 'operator': 'contains', 'value': 'Chennai', 'value_to': NULL, 'unit': NULL, 'hard': false, 'label': 'Location: contains "Chennai"'} END,
  CASE WHEN contains(prompt, 'Java backend') THEN {'field': 'role', 'operator': 'contains', 'value': 'Java Backend Developer', 'value_to': NULL, 'unit': NULL, 'hard': true, 'label': 'Role: contains "Java Backend Developer"'} END,
  CASE WHEN contains(prompt, 'React frontend') THEN {'field': 'role', 'operator': 'contains', 'value': 'React Frontend Developer', 'value_to': NULL, 'unit': NULL, 'hard': true, 'label': 'Role: contains "React Frontend Developer"'} END,
  CASE WHEN contains(prompt, 'Full stack') THEN {'field': 'role', 'operator': 'contains', 'value': 'Full Stack Developer', 'value_to': NULL, 'unit': NULL, 'hard': true, 'label': 'Role: contains "Full Stack Developer"'} END]) AS c FROM req),
extracted AS (SELECT id, c.field, c.operator, c.value, c.value_to, c.unit, c.hard, c.label FROM found WHERE c IS NOT NULL)"""
_PART_NAME = "CASE WHEN p_partkey % 3 = 0 THEN 'The ' || upper(p_name) || '!' ELSE p_name END"
_ALNUM = lambda e: f"regexp_replace(lower({e}), '[^a-z0-9]', '', 'g')"
_NATURAL = "CASE WHEN regexp_matches(t, '\\d') THEN 0 ELSE 1 END"

SEARCH = with_(REC, REQ) + "SELECT 'request' AS kind, CAST(request_id AS VARCHAR) AS id, name AS title FROM req WHERE contains(lower(name || ' ' || request_id || ' ' || prompt), 'react') UNION ALL SELECT * FROM (SELECT 'record', run_id || '/' || record_id, entity_name FROM rec WHERE contains(lower(concat_ws(' ', entity_name, role, brand, type, location)), 'react') ORDER BY run_id, record_id LIMIT 8)"
PAGES = with_(REC, numbers_cte("SELECT DISTINCT salary AS t FROM rec")) + f", pos AS (SELECT row_number() OVER (ORDER BY {missing('salary')}, n IS NULL, n DESC NULLS LAST, {natural('salary')} DESC NULLS LAST, record_id) AS position, record_id, entity_name, salary FROM rec LEFT JOIN num ON t = salary)"

SQL: dict[str, str] = {
    "qualify_numeric": with_(eval_sql("Q"), EV, CLASH, VERDICTS) + "SELECT record_id, status, reason, completeness, array_to_string(missing_fields, ',') AS missing_fields FROM verdicts",
    "quality_summary": with_(eval_sql("Q"), EV, CLASH, VERDICTS) + f"SELECT run_id, count(*) AS collected, count(*) FILTER (status = 'Qualified') AS qualified, count(*) FILTER (status = 'Needs verification') AS needs_verification, count(*) FILTER (status = 'Conflict') AS conflicts, count(*) FILTER (status = 'Excluded') AS excluded, count(*) FILTER (len(missing_fields) > 0) AS incomplete, {js_round('avg(completeness)')} AS completeness, {js_round('count(*) FILTER (status = ' + lit('Qualified') + ') * 100.0 / count(*)')} AS quality FROM verdicts JOIN (SELECT run_id, record_id FROM rec) USING (record_id) GROUP BY run_id",
    "constraint_ops": with_(eval_sql("ALL")) + "SELECT * FROM evals",
    "role_match": with_(REC, _ROLE_PAIRS, titles_cte("SELECT t FROM titles_")) + f"SELECT r.t AS required, a.t AS actual, a.fam AS family, array_to_string(a.te, ',') AS technologies, a.sen AS seniority, {title_verdict('r', 'a')[0]} AS result, {title_verdict('r', 'a')[1]} AS reason, records FROM title r CROSS JOIN title a JOIN titles_ n ON n.t = a.t",
    "location_match": with_(REC, "wanted AS (SELECT unnest(['Bengaluru', 'India', 'Remote', 'Karnataka', 'Toronto', 'Pune office']) AS t)", places_cte("SELECT DISTINCT location AS t FROM rec UNION SELECT t FROM wanted"), "n AS (SELECT location AS t, count(*) AS records FROM rec GROUP BY location)") + f"SELECT r.t AS required, a.t AS actual, a.city, a.state, a.country, a.remote, {place_verdict('r', 'a')[0]} AS result, {place_verdict('r', 'a')[1]} AS reason, records FROM wanted w JOIN place r ON r.t = w.t CROSS JOIN n JOIN place a ON a.t = n.t",
    "entity_pairs": with_(CAND, SIG, title_clashes(), PAIRS) + "SELECT a, b, CASE reason WHEN 'AMBIGUOUS_LOCATION' THEN 'AMBIGUOUS' WHEN 'STRONG_IDENTITY_MATCH' THEN 'STRONG_MATCH' ELSE 'DISTINCT' END AS decision, reason FROM pairs",
    "entity_clusters": CLUSTERED + "SELECT record_id, cluster FROM clustered",
    "merge_log": CLUSTERED + "SELECT cluster AS target_record_id, record_id AS merged_record_id, 'STRONG_IDENTITY_MATCH' AS reason, entity_name FROM clustered JOIN cand USING (record_id) WHERE record_id <> cluster",
    "resolution_summary": CLUSTERED + "SELECT run_id, count(*) AS collected, count(DISTINCT cluster) AS \"unique\", count(*) - count(DISTINCT cluster) AS duplicates FROM clustered JOIN cand USING (record_id) GROUP BY run_id",
    "generic_names": with_(CAND) + f"SELECT entity_name, candidates, name, {_GENERIC} AS generic FROM (SELECT entity_name, count(*) AS candidates, {_NAME} AS name FROM cand GROUP BY entity_name)",
    "merge_records": CLUSTERED + "SELECT cluster, cluster AS record_id, arg_max(record_id, (confidence, -record_id)) AS base_record_id, count(*) AS size FROM clustered JOIN cand USING (record_id) GROUP BY cluster",
    "merge_attributes": CLUSTERED + "SELECT cluster, 'Size' AS field, arg_min(size_, record_id) AS value FROM clustered JOIN cand USING (record_id) GROUP BY cluster UNION ALL SELECT cluster, 'Type', arg_min(type_, record_id) FROM clustered JOIN cand USING (record_id) GROUP BY cluster",
    "conflicts": CLUSTERED + f", vals AS (SELECT cluster, record_id, 'Size' AS field, size_ AS value FROM clustered JOIN cand USING (record_id) UNION ALL SELECT cluster, record_id, 'Type', type_ FROM clustered JOIN cand USING (record_id)), each_ AS (SELECT cluster, field, {norm('value')} AS k, min(record_id) AS pos_, arg_min(value, record_id) AS value FROM vals GROUP BY ALL) SELECT cluster, field, count(*) AS n_values, string_agg(value, '|' ORDER BY pos_) AS \"values\" FROM each_ GROUP BY cluster, field HAVING count(*) > 1",
    "merge_evidence": CLUSTERED + "SELECT cluster, min(record_id) AS record_id, 'Profile' AS field, url FROM clustered JOIN cand USING (record_id) GROUP BY cluster, url",
    "source_tier": with_(REC, EV) + f"SELECT url, entity_name, tier, {SCORE} AS tier_score FROM (SELECT url, entity_name, {TIER} AS tier FROM (SELECT url, entity_name FROM ev JOIN rec USING (record_id) UNION SELECT url, 'example' FROM pages))",
    "directness": with_(REC, FIELDS_ALL, FIELDS, EV, DIRECT) + "SELECT * FROM direct",
    "source_quality": with_(REC, EV, RATED, QUALITY) + "SELECT * FROM quality",
    "source_agreement": "WITH RECURSIVE " + ", ".join([REC, EV, CLASH, RATED, AGREE]) + " SELECT * FROM agree",
    "entity_consistency": with_(REC, EV, CONSIST) + "SELECT * FROM consist",
    "extraction_fidelity": with_(REC, FIELDS_ALL, EV, fidelity_sql("fields_all", "fid")) + "SELECT record_id, coalesce(fidelity, 40) AS fidelity FROM rec LEFT JOIN fid USING (record_id)",
    "freshness": with_(REC, EV, FRESH) + "SELECT * FROM fresh",
    "reliability_score": "WITH RECURSIVE " + ", ".join([REC, FIELDS_ALL, FIELDS, EV, CLASH, RATED, QUALITY, DIRECT, SUPPORT, AGREE, CONSIST, fidelity_sql("fields", "fid"), FRESH, RELIABLE]) + " SELECT *, CASE WHEN score >= 80 THEN 'High' WHEN score >= 60 THEN 'Moderate' WHEN score >= 35 THEN 'Low' ELSE 'Unverified' END AS grade, CASE WHEN score >= 80 AND support >= 75 THEN 'Confirmed' WHEN score >= 45 THEN 'Partially verified' ELSE 'Needs verification' END AS status FROM scored",
    "request_scores": "WITH RECURSIVE " + ", ".join([REC, ASKED_FIELDS, EV, CLASH, ASKED_EV, RATED.replace("FROM ev JOIN", "FROM cited JOIN"), QUALITY.replace("FROM ev WHERE", "FROM cited WHERE"), DIRECT, SUPPORT, AGREE, CONSIST, fidelity_sql("fields", "fid"), ASKED_FRESH, ASKED_RELIABLE]) + " SELECT record_id, support, directness, source_quality, freshness, conflict_penalty, inference_penalty, score FROM scored",
    "run_quality": with_(eval_sql("Q"), EV, CLASH, VERDICTS) + "SELECT run_id, collected, n AS \"unique\", q AS validated, collected - n AS duplicates, nv AS incomplete, c AS conflicts, q AS qualified, nv AS needs_verification, x AS excluded FROM (SELECT run_id, count(*) AS collected FROM ev GROUP BY run_id) JOIN (SELECT run_id, count(*) AS n, count(*) FILTER (status = 'Qualified') AS q, count(*) FILTER (status = 'Needs verification') AS nv, count(*) FILTER (status = 'Conflict') AS c, count(*) FILTER (status = 'Excluded') AS x FROM verdicts JOIN (SELECT run_id, record_id FROM rec) USING (record_id) GROUP BY run_id) USING (run_id)",
    "parse_responses": "SELECT doc_id AS id, CAST(pos AS INT) AS pos, CASE WHEN pos >= 0 THEN 'Entity ' || doc_id END AS \"entityName\", CASE WHEN pos >= 0 THEN 'chars ' || n_chars END AS role, CASE WHEN pos >= 0 THEN source END AS location FROM (SELECT *, unnest(CASE doc_id % 5 WHEN 1 THEN [0, 1] WHEN 4 THEN [-1] ELSE [0] END) AS pos FROM documents)",
    "citations": f"SELECT doc_id AS id, url, regexp_replace(regexp_extract(url, '//([^/]+)', 1), '^www\\.', '') AS title FROM (SELECT doc_id, {_WRAP} AS url FROM documents) WHERE url IS NOT NULL",
    "discover_sources": with_(EV) + "SELECT run_id, url, arg_min(source, (record_id, ev_seq)) AS source, nullif(arg_min(coalesce(snippet, 'none'), (record_id, ev_seq)), 'none') AS snippet, count(*) AS citations FROM ev WHERE url <> '' GROUP BY run_id, url",
    "clean": with_(REC) + "SELECT record_id, regexp_replace(entity_name || sfx, '\\s+(Pvt\\.?|Ltd\\.?|Inc\\.?|LLP|Technologies|Private Limited)$', '', 'i') AS entity_name, regexp_replace(entity_name || sfx, '\\s+(Pvt\\.?|Ltd\\.?|Inc\\.?|LLP|Technologies|Private Limited)$', '', 'i') AS company, nullif(role, '—') AS role, nullif(location, 'Not disclosed') AS location, nullif(experience, '—') AS experience, nullif(salary, 'Not disclosed') AS salary FROM (SELECT *, " + pick(A.SUFFIXES, "record_id") + " AS sfx FROM rec)",
    "melt_fields": with_(REC, FIELDS_ALL) + f"SELECT record_id, field, lower(field) AS field_key, value, CASE WHEN {missing('value')} THEN 'NOT_FOUND' ELSE 'FOUND' END AS status FROM fields_all",
    "extract_constraints": with_(REQ, _EXTRACT) + "SELECT * FROM extracted",
    "constraint_merge": with_(REQ, _EXTRACT) + "SELECT request_id, 'role' AS field, 'contains' AS operator, 'Any Developer' AS value FROM req WHERE request_id % 2 = 0 UNION ALL SELECT id, field, operator, value FROM extracted WHERE NOT (id % 2 = 0 AND field = 'role') UNION ALL SELECT request_id, 'salary', 'optional', NULL FROM req WHERE contains(prompt, 'salary if available') UNION ALL SELECT request_id, 'experience', 'optional', NULL FROM req WHERE contains(prompt, 'experience when available')",
    "source_summary": with_(EV) + f"SELECT * FROM (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY records DESC, domain) AS rank, domain, {first('lower(domain)', [('|'.join(p.replace('.', '[.]') for p in ps), n) for n, ps in U.SOURCE_TYPES], lit('Primary'))} AS type, records, confirmed, {js_round('least(99.0, greatest(50.0, confirmed * 100.0 / records))')} AS reliability FROM (SELECT run_id, CASE WHEN url = '' THEN 'web-source' ELSE {HOST} END AS domain, count(*) AS records, count(*) FILTER (verification = 'Confirmed') AS confirmed FROM ev GROUP BY ALL)) WHERE rank <= 10",
    "gap_report": with_(eval_sql("Q"), EV, CLASH, VERDICTS) + ", need AS (SELECT record_id, missing_fields FROM verdicts WHERE status = 'Needs verification'), gaps AS (SELECT record_id, field FROM evals JOIN need USING (record_id) WHERE result = 'UNKNOWN' UNION SELECT record_id, unnest(missing_fields) FROM need), each AS (SELECT DISTINCT run_id, field, entity_name FROM gaps JOIN rec USING (record_id)), agg AS (SELECT run_id, field, field IN ('Price', 'Experience', 'Size') AS is_constraint, count(*) AS n_entities, array_to_string(list(entity_name ORDER BY entity_name)[1:8], '|') AS entities FROM each GROUP BY run_id, field) SELECT * FROM (SELECT row_number() OVER (PARTITION BY run_id ORDER BY is_constraint DESC, n_entities DESC, field) AS rank, * FROM agg) WHERE rank <= 3",
    "enrich": with_(REC) + f", rec2 AS (SELECT run_id, {_ALNUM('entity_name')} AS rk, min(record_id) AS rid FROM rec GROUP BY ALL), new AS (SELECT {_RUN.format('p_partkey // 5')} AS run_id, {_ALNUM(_PART_NAME)} AS k, '₹' || (p_partkey % 40) || ' lakh' AS value, CASE WHEN p_partkey % 2 = 0 THEN 'https://pay.example.com' END AS url FROM part WHERE p_partkey % 5 <> 0), keys AS (SELECT DISTINCT run_id, k FROM new), own AS (SELECT run_id, k, coalesce(min(rid) FILTER (rk = k), min(rid)) AS record_id FROM keys JOIN rec2 USING (run_id) WHERE rk = k OR contains(k, rk) OR contains(rk, k) GROUP BY ALL), got AS (SELECT record_id, value, url FROM (SELECT record_id, value, url, row_number() OVER (PARTITION BY record_id ORDER BY value, url NULLS FIRST) AS i FROM new JOIN own USING (run_id, k)) WHERE i = 1) SELECT record_id, 'Salary' AS field, value, url, CASE WHEN url IS NULL THEN 'Needs verification' ELSE 'Confirmed' END AS verification FROM got JOIN rec USING (record_id) WHERE {missing('salary')}",
    "new_candidates": with_(REC) + f", new AS (SELECT {_RUN.format('c_custkey')} AS run_id, c_custkey + 10000000 AS record_id, CASE c_custkey % 4 WHEN 0 THEN '  SMALL ring ' WHEN 1 THEN '' WHEN 2 THEN (SELECT min(p_name) FROM part) ELSE c_name END AS entity_name FROM customer) SELECT run_id, record_id, entity_name FROM rec UNION ALL SELECT * FROM new n WHERE trim(entity_name) = '' OR NOT EXISTS (SELECT 1 FROM rec r WHERE r.run_id = n.run_id AND lower(trim(r.entity_name)) = lower(trim(n.entity_name)))",
    "catalog_backfill": "WITH cat0 AS (SELECT n_nationkey AS position, " + pick(["small ring", "red widget", "Ather 450X", "Ola S1", "TVS iQube", "Ather", "Bajaj Chetak", "blue"], "n_nationkey") + " AS entity_name FROM nation), cat AS (SELECT * FROM cat0 c WHERE NOT EXISTS (SELECT 1 FROM cat0 e WHERE e.position < c.position AND (contains(lower(e.entity_name), lower(c.entity_name)) OR contains(lower(c.entity_name), lower(e.entity_name))))), run AS (SELECT l_orderkey AS run_id, lower(p_name) AS s FROM lineitem JOIN part ON l_partkey = p_partkey), short AS (SELECT run_id, count(*) AS have FROM run GROUP BY run_id HAVING count(*) < 5), seen AS (SELECT run_id, s FROM run UNION SELECT run_id, split_part(s, ' ', 1) FROM run), free AS (SELECT run_id, have, position, entity_name FROM short CROSS JOIN cat WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.run_id = short.run_id AND (contains(seen.s, lower(cat.entity_name)) OR contains(lower(cat.entity_name), seen.s)))) SELECT run_id, position, entity_name FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY position) AS i FROM free) WHERE i <= 5 - have",
    "run_comparison": with_(RUNS, COMPARE) + "SELECT *, validated_delta AS quality_change, abs(validated_delta) AS quality_delta FROM cmp",
    "latest_run": with_(RUNS, REQ) + "SELECT request_id, active_run_id, run_id, run_number FROM (SELECT request_id, active_run_id, run_id, run_number, row_number() OVER (PARTITION BY request_id ORDER BY coalesce(run_id = active_run_id, false) DESC, run_number DESC) AS i FROM req LEFT JOIN runs USING (request_id)) WHERE i = 1",
    "request_history": with_(RUNS, COMPARE) + "SELECT request_id, run_id, run_number, row_number() OVER (PARTITION BY request_id ORDER BY run_number DESC) AS position, CASE WHEN run_number = 1 THEN 'First run' WHEN validated_delta > 0 THEN '+' || validated_delta || ' validated' WHEN validated_delta < 0 THEN validated_delta || ' validated' ELSE 'No change' END AS change FROM cmp",
    "next_run_number": with_(RUNS) + "SELECT request_id, max(run_number) + 1 AS run_number, 'RUN-' || request_id || '-v' || (max(run_number) + 1) AS run_id FROM runs GROUP BY request_id",
    "dataset_page": with_(REC, numbers_cte("SELECT DISTINCT salary AS t FROM rec")) + f"SELECT record_id, entity_name, salary FROM rec JOIN num ON t = salary WHERE contains(lower(concat_ws(' ', entity_name, brand, type, price, size, role, location, experience, founded, salary)), 'ring') ORDER BY {missing('salary')}, n IS NULL, n DESC, {natural('salary')} DESC, record_id LIMIT 10 OFFSET 20",
    "search": SEARCH,
    "indexed_search": SEARCH,
    "deep_page": PAGES + " SELECT position, record_id, entity_name, salary FROM pos WHERE position BETWEEN 976 AND 1000",
    "next_page": PAGES + ", h AS (SELECT count(*) // 2 AS half FROM pos) SELECT record_id, salary FROM pos, h WHERE position BETWEEN half + 1 AND half + 25",
    "text_hits": with_(REC) + "SELECT run_id, record_id, entity_name FROM rec WHERE contains(lower(concat_ws(' ', entity_name, role, brand, type, price, size, location, experience, founded, salary)), 'anvil')",
    "notifications": with_(RUNS) + "SELECT run_id || '-' || kind AS id, run_id, kind, amount FROM (SELECT run_id, 'completed' AS kind, collected AS amount FROM runs UNION ALL SELECT run_id, 'conflicts', conflicts FROM runs WHERE conflicts > 0 UNION ALL SELECT run_id, 'incomplete', incomplete FROM runs WHERE incomplete > 0) WHERE NOT (kind = 'completed' AND run_id % 4 = 0)",
    "overview": with_(RUNS, EV, REQ) + f"SELECT *, (SELECT count(*) FILTER (status = 'running') FROM req) AS running FROM (SELECT count(*) AS runs, count(DISTINCT request_id) AS requests, CAST(sum(collected) AS BIGINT) AS collected, {js_round('sum(validated) * 100.0 / sum(' + chr(34) + 'unique' + chr(34) + ')')} AS quality, count(*) FILTER (conflicts > 0) AS runs_with_conflicts FROM runs), (SELECT count(DISTINCT source) AS sources, {js_round('count(*) FILTER (verification <> ' + lit('Needs verification') + ') * 100.0 / count(*)')} AS evidence_coverage FROM ev)",
    "calibration": "WITH s AS (SELECT quality = 1 AND toxic = 0 AS label, floor(least(100.0, n_chars / 25) + 0.5) AS score FROM labels JOIN documents USING (doc_id)), n AS (SELECT count(*) FILTER (label AND score >= 50) AS tp, count(*) FILTER (NOT label AND score >= 50) AS fp, count(*) FILTER (label AND score < 50) AS fn, count(*) FILTER (NOT label AND score < 50) AS tn, round(count(*) FILTER (label AND score >= 80) / nullif(count(*) FILTER (score >= 80), 0), 6) AS high_accuracy, round(count(*) FILTER (NOT label AND score < 50) / nullif(count(*) FILTER (score < 50), 0), 6) AS low_accuracy, count(*) FILTER (score < 35) AS band_0_34, count(*) FILTER (score >= 35 AND score < 60) AS band_35_59, count(*) FILTER (score >= 60 AND score < 80) AS band_60_79, count(*) FILTER (score >= 80) AS band_80_100 FROM s) SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS false_qualification_rate, round(fn / nullif(tp + fn, 0), 6) AS false_exclusion_rate FROM n",
    "upsert": "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE 'now' END AS created_at FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0",
    "orphans": "SELECT l_orderkey AS k, count(*) AS children FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0) GROUP BY l_orderkey",
    "csv_export": with_(REC) + "SELECT record_id, array_to_string(list_transform([entity_name, location, salary, 'say \"' || brand || '\"'], lambda c: CASE WHEN regexp_matches(c, '[,\"\n\r]') THEN '\"' || replace(c, '\"', '\"\"') || '\"' ELSE coalesce(c, '') END), ',') AS line FROM rec",
    "stage_counts": with_(REC, FIELDS_ALL, FIELDS, EV, CLASH) + "SELECT '1 records' AS stage, count(*) AS \"rows\" FROM rec UNION ALL SELECT '2 fields', count(*) FROM fields UNION ALL SELECT '3 evidence', count(*) FROM ev UNION ALL SELECT '4 conflicts', count(*) FROM clash",
    "dynamic_columns": with_(REC) + f"SELECT record_id, size AS company_size, CASE WHEN location = 'Not disclosed' THEN location ELSE location END AS city, CASE WHEN salary = 'Not disclosed' THEN price ELSE price END AS salary_range, experience, brand, {missing('location')} AS location_missing FROM rec",
}


# ---- raw candidates, runs written and read again ------------------------------------------------
_S = lambda e: f"nullif({e}, '')"
_CITE = lambda f, v, src, u, t: f"{{'field': {f}, 'value': {v}, 'source': {src}, 'url': {u}, 'snippet': {t}}}"
_N = "CAST(NULL AS VARCHAR)"
_RAW_PRICE = "CAST(CAST(round(p_retailprice) AS BIGINT) AS VARCHAR)"
_SHOP = lit("https://www.shop.example.org/x")
RAW = f"""raw AS (SELECT {_RUN.format("p_partkey")} AS run_id, p_partkey AS record_id, row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) AS n,
  CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Top 10 best rings' WHEN 2 THEN NULL WHEN 3 THEN '  ' WHEN 4 THEN 'best of all' ELSE p_name END AS entity, CASE WHEN p_partkey % 14 = 2 THEN ' ' || p_name END AS name,
  CASE WHEN p_partkey % 28 = 9 THEN p_brand END AS brand, CASE WHEN p_partkey % 2 = 0 THEN {pick(A.TITLES, "p_partkey")} END AS role, {_RAW_PRICE} AS price,
  CASE WHEN p_partkey % 3 = 0 THEN 'https://www.site' || (p_partkey % 9) || '.com/p/' || p_partkey END AS url0, CASE WHEN p_partkey % 8 = 4 THEN 'Named' END AS source0,
  CASE p_partkey % 5 WHEN 0 THEN [{{'k': 'Brand Name', 'v': 'p_brand_'}}, {{'k': 'company size', 'v': CAST(p_size AS VARCHAR)}}, {{'k': 'Price', 'v': 'Not disclosed'}}]
    WHEN 1 THEN [{{'k': 'Model', 'v': p_type}}, {{'k': 'PRICE', 'v': {_RAW_PRICE}}}, {{'k': 'Brand', 'v': ''}}] WHEN 2 THEN [{{'k': 'Company', 'v': 'Not disclosed'}}, {{'k': 'Brand', 'v': p_brand}}, {{'k': 'Role', 'v': '—'}}]
    WHEN 3 THEN [{{'k': 'Colour', 'v': 'red'}}] ELSE [] END AS e,
  CASE p_partkey % 4 WHEN 0 THEN [{_CITE(lit("Price"), _RAW_PRICE, _N, _N, _N)}, {_CITE(_N, _N, lit("Shop"), _SHOP, lit("text"))}] WHEN 1 THEN [{_CITE(lit("Size"), lit("Not disclosed"), _N, lit("https://maker.example.com/p"), _N)}] ELSE [] END AS ev FROM part)"""
_POOR = lambda e: f"({e} = '' OR regexp_matches({e}, '^(top|best|list of|\\d+\\s+best|\\d+\\s+top)', 'i'))"
_GET = lambda f: _S(f"list_filter(e, lambda x: x.k = {lit(f)})[1].v")
_LIKE = lambda f: f"list_filter(e, lambda x: {norm('x.k')} = {lit(''.join(c for c in f.lower() if c.isalnum()))} AND coalesce(x.v, '') <> '')[1].v"
_FILL = {"Brand": "entity_name", "Company Size": "entity_name", "Price": "price", "Role": "role", "Notes": "CAST(NULL AS VARCHAR)"}
_OWN_ATTR = lambda f: "f_" + f.lower().replace(" ", "_") if f in _FILL else _GET(f)
CANON = f"""{RAW}, own AS (SELECT *, trim(coalesce({_S("entity")}, {_S("name")}, {_S("brand")}, '')) AS own_,
    trim(list_filter(e, lambda x: regexp_matches(lower(x.k), 'name|company|brand|model') AND coalesce(x.v, '') NOT IN ('', 'Not disclosed', '—'))[1].v) AS named, trim({_GET("Brand")}) AS first_ FROM raw),
better AS (SELECT *, CASE WHEN {_POOR("own_")} AND named IS NOT NULL THEN named ELSE own_ END AS better_ FROM own),
best_ AS (SELECT *, CASE WHEN {_POOR("better_")} AND first_ IS NOT NULL THEN first_ ELSE better_ END AS best_ FROM better),
named_ AS (SELECT *, CASE WHEN best_ = '' THEN 'Candidate Entity ' || n ELSE best_ END AS entity_name, coalesce({_S("url0")}, {_S("ev[1].url")}, '') AS url FROM best_),
filled AS (SELECT *, {", ".join(f"coalesce({_GET(f)}, {_LIKE(f)}, {_S(v)}) AS {_OWN_ATTR(f)}" for f, v in _FILL.items())}, coalesce({HOST}, '') AS domain FROM named_),
canon AS (SELECT *, list_concat(list_filter(e, lambda x: x.k NOT IN ({", ".join(lit(f) for f in _FILL)})), [{", ".join(f"{{'k': {lit(f)}, 'v': {_OWN_ATTR(f)}}}" for f in _FILL)}], CASE WHEN url <> '' THEN [{{'k': 'Source URL', 'v': url}}] ELSE [] END, CASE WHEN domain <> '' THEN [{{'k': 'Source', 'v': domain}}] ELSE [] END) AS a FROM filled)"""
_ANY = lambda *fs: "coalesce(" + ", ".join(_OWN_ATTR(f) for f in fs)
_RUN_STATUS = "CASE record_id % 4 WHEN 0 THEN 'Qualified' WHEN 1 THEN 'Conflict' ELSE 'Needs verification' END"
_ADDED = "f2 AS (SELECT * REPLACE (CASE WHEN field = 'Experience' AND value = '—' THEN '3 years' ELSE value END AS value) FROM fields_all)"


def covered_sql(which: str) -> str:
    """CTEs up to before_ or after_ (record_id, status, missing_fields): verdicts with experience required, as found or with "3 years" where there is none."""
    rec = REC if which == "before_" else REC.replace("rec AS (", "rec AS (SELECT * REPLACE (CASE WHEN experience = '—' THEN '3 years' ELSE experience END AS experience) FROM (", 1) + ")"
    return with_(eval_sql("Q", rec), EV, CLASH, verdicts_sql(A.REQUIRED)) + "SELECT run_id, record_id, status, missing_fields FROM verdicts JOIN (SELECT run_id, record_id FROM rec) USING (record_id)"


_ONE = lambda name: f"(SELECT run_id, {js_round('avg(CASE WHEN status = ' + lit('Qualified') + ' THEN 1 ELSE 0 END) * 100')} AS {name}, sum(len(missing_fields)) AS m_{name} FROM {name}_ GROUP BY run_id)"
COVERED = f"WITH before_ AS ({covered_sql('before_')}), after_ AS ({covered_sql('after_')}), cov AS (SELECT run_id, before, after, CAST(greatest(m_before - m_after, 0) AS BIGINT) AS recovered FROM {_ONE('before')} JOIN {_ONE('after')} USING (run_id)) "
_U = "CASE WHEN (page_id // 12) % 2 = 0 OR page_id % 12 = 11 THEN url ELSE " + pick(["http://127.0.0.1/a", "http://10.1.2.3", "https://192.168.0.9/x", "ftp://host.com/f", "javascript:alert(1)", "http://localhost:8080/", "http://metadata.google.internal/", "https://printer.local/q", "http://[::1]/", "", "http://2130706433/"], "page_id % 12") + " END"
_BARE = "regexp_replace(h, '^www\\.', '')"
URLS = f"""given AS (SELECT page_id, {_U} AS u FROM pages),
split_ AS (SELECT *, lower(trim(u)) AS low, CASE WHEN regexp_matches(lower(trim(u)), '^https?://') THEN trim(u) ELSE 'https://' || trim(u) END AS full_ FROM given),
hosts AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(full_, '^[a-zA-Z]+://(\\[[^]]*\\]|[^/?#:]*)(?::\\d*)?(?:[/?#]|$)', 1)), '^\\[', ''), '\\]$', '') AS h, regexp_extract(full_, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM split_),
judged AS (SELECT *, CASE WHEN low = '' THEN 'EMPTY' WHEN regexp_matches(low, '^[a-z][a-z0-9+.-]*:') AND NOT regexp_matches(low, '^https?://') AND NOT regexp_matches(low, '^[^/:]+:\\d+(/|$)') THEN 'UNSUPPORTED_SCHEME' WHEN h = '' THEN 'MALFORMED'
  WHEN h IN ({", ".join(lit(x) for x in U.BLOCKED_HOSTS)}) OR ends_with(h, '.local') OR ends_with(h, '.internal') OR regexp_matches(h, '^\\d+$') THEN 'BLOCKED_HOST' WHEN regexp_matches(h, {lit(U.PRIVATE_RX)}) THEN 'PRIVATE_ADDRESS' END AS error FROM hosts)"""
SOURCES = f"""src AS (SELECT {_RUN.format("s_suppkey // 2")} AS run_id, 'https://s.example.com/' || s_suppkey AS url, s_name AS title, 'About ' || p_name || ' in Bangalore' AS snippet, s_suppkey AS search_rank FROM supplier JOIN part ON p_partkey = s_suppkey * 7)"""

SQL |= {
    "attention": with_(eval_sql("Q"), EV, CLASH, VERDICTS) + f"SELECT run_id, needs_verification, conflicts, incomplete, evidence_coverage FROM ({SUMMARY}) JOIN (SELECT run_id, {js_round('avg(CASE WHEN verification <> ' + lit('Needs verification') + ' THEN 1 ELSE 0 END) * 100')} AS evidence_coverage FROM ev GROUP BY run_id) USING (run_id)",
    "coverage": COVERED + "SELECT * FROM cov",
    "outcome_texts": COVERED + f", verdicts AS (SELECT record_id, status, missing_fields FROM after_), rec AS (SELECT run_id, record_id FROM after_), s AS ({SUMMARY}) SELECT run_id, qualified || ' Records qualified; ' || needs_verification || ' Needs verification; ' || excluded || ' Excluded; ' || conflicts || ' Conflicts detected' AS outcomes, CASE WHEN recovered > 0 THEN 'Targeted searches for missing fields raised coverage from ' || before || '% to ' || after || '% (' || recovered || ' fields recovered). Final: ' || qualified || ' qualified, ' || needs_verification || ' needs verification, ' || excluded || ' excluded, ' || conflicts || ' conflicts.' ELSE 'Collection ended with ' || qualified || ' of ' || collected || ' records qualified (' || after || '% coverage). ' || needs_verification || ' needs verification, ' || excluded || ' excluded.' END AS text FROM s JOIN cov USING (run_id)",
    "canonicalize": with_(CANON) + f"SELECT run_id, record_id, 'R-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS display_id, entity_name, array_to_string(list_transform(list_sort(a), lambda x: x.k || '=' || coalesce(x.v, '~')), '|') AS attributes, {_ANY('Company', 'Brand')}, entity_name) AS company, {_ANY('Role', 'Model', 'Property Type')}, '—') AS role, {_ANY('Location')}, 'India') AS location, {_ANY('Experience', 'Range')}, '—') AS experience, {_ANY('Salary', 'Price')}, 'Not disclosed') AS salary, {_ANY('Company Size', 'Size', 'Battery Capacity')}, '—') AS size, coalesce({_S('domain')}, {_S('ev[1].source')}, 'Web Source') AS source, 50 AS confidence, 'Review' AS status, 'Needs verification' AS verification_status, 'Needs verification' AS qualification_status FROM canon",
    "canonical_evidence": with_(RAW) + f", c AS (SELECT record_id, i - 1 AS ev_seq, coalesce({_S('x.field')}, 'General') AS field, coalesce({_S('x.value')}, '—') AS value, coalesce({_S('x.source')}, source0) AS src, coalesce({_S('x.url')}, {_S('url0')}, '') AS url, x.snippet AS snippet FROM (SELECT *, unnest(ev) AS x, generate_subscripts(ev, 1) AS i FROM raw)) SELECT record_id, ev_seq, field, value, coalesce(src, {_S(HOST)}, 'Web Source') AS source, url, snippet, CASE WHEN value IN ('—', 'Not disclosed') THEN 'Needs verification' ELSE 'Confirmed' END AS verification FROM c",
    "snapshot": "WITH l AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_partkey) AS record_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) - 1 AS ingest_seq FROM lineitem) SELECT CAST(o_custkey AS VARCHAR) AS request_id, 'Request ' || o_custkey AS request, CAST(l_orderkey AS VARCHAR) AS run_id, record_id, ingest_seq, 'Part ' || l_partkey AS entity_name, l_returnflag AS mode, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS citations, CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS last, CAST(CAST(round(l_extendedprice) AS BIGINT) AS VARCHAR) AS value, 'Supplier ' || l_suppkey AS source, CASE WHEN l_returnflag = 'R' THEN '1|2' END AS clash FROM l JOIN orders ON o_orderkey = l_orderkey",
    "run_counters": with_(REC) + f", live AS (SELECT run_id, count(*) AS n, count(*) FILTER ({_RUN_STATUS} = 'Qualified') AS q, count(*) FILTER ({_RUN_STATUS} = 'Conflict') AS c, count(*) FILTER ({_RUN_STATUS} = 'Needs verification') AS v FROM rec GROUP BY run_id) SELECT run_id, 'Q' AS request_id, CAST(substr(run_id, 5) AS INT) AS run_number, n AS collected, n AS \"unique\", CASE WHEN run_id = 'RUN-1' THEN 5 ELSE q END AS validated, CASE WHEN run_id = 'RUN-1' THEN 5 ELSE c END AS conflicts, CASE WHEN run_id = 'RUN-1' THEN 5 ELSE v END AS incomplete FROM live WHERE run_id IN ('RUN-1', 'RUN-2')",
    "run_records": with_(REC, EV, CLASH) + ", e AS (SELECT record_id, count(*) AS n, arg_max(value, ev_seq) AS last_value FROM ev GROUP BY record_id), c AS (SELECT record_id, string_agg(field, ',' ORDER BY field) AS clashing, string_agg(record_id || '-CONF-' || i, ',' ORDER BY i) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY field) AS i FROM clash) GROUP BY record_id) SELECT record_id, entity_name, coalesce(n, 0) AS n_evidence, CASE WHEN n > 0 THEN record_id || '-EV-1' END AS first_id, last_value, coalesce(clashing, '') AS clashing, coalesce(ids, '') AS clash_ids FROM rec LEFT JOIN e USING (record_id) LEFT JOIN c USING (record_id) WHERE run_id = 'RUN-2'",
    "run_sources": with_(EV) + ", s AS (SELECT run_id, url, -count(*) AS search_rank FROM ev WHERE url <> '' GROUP BY ALL) SELECT run_id || '-SRC-' || row_number() OVER (ORDER BY search_rank, url) AS id, url, search_rank FROM s WHERE run_id = 'RUN-3'",
    "json_export": with_(REC, FIELDS_ALL) + ", a AS (SELECT record_id, string_agg(field || '=' || value, '|' ORDER BY field) AS attributes FROM fields_all GROUP BY record_id) SELECT record_id AS id, entity_name AS \"entityName\", attributes, '—' AS source FROM rec JOIN a USING (record_id) UNION ALL SELECT -1, 'Q', count(*) || '/' || count(DISTINCT run_id), 'metadata' FROM rec",
    "csv_roundtrip": with_(REC) + "SELECT record_id AS \"Id\", entity_name AS \"Name\", '\"a, b\"' || CASE WHEN record_id % 3 = 0 THEN chr(10) ELSE ';' END || location AS \"Where\", (record_id % 101 + 1) || '%' AS \"Confidence\" FROM rec",
    "evidence_by_source": with_(EV) + f", s AS (SELECT record_id, ev_seq, CASE WHEN url = '' THEN source ELSE {HOST} END AS source FROM ev) SELECT * FROM s WHERE starts_with(lower(source), 'linkedin') OR starts_with(lower(source), 'supplier')",
    "drill_down": with_(REC, EV) + "SELECT ev_seq, record_id, entity_name, brand AS company, CASE WHEN entity_name IS NOT NULL THEN 'Review' END AS status FROM ev LEFT JOIN (SELECT * FROM rec WHERE record_id % 7 <> 3) r USING (record_id)",
    "relevant_fields": with_(REQ, _EXTRACT) + f", h AS (SELECT id, list({norm('field')}) AS hard FROM extracted WHERE hard GROUP BY id), asked AS (SELECT ['Company Size', 'Price', 'Role', 'Price Range', 'Location', 'Notes'] AS f), r AS (SELECT request_id, f, coalesce(hard, []) AS hard FROM req LEFT JOIN h ON id = request_id CROSS JOIN asked), k AS (SELECT request_id, f, list_filter(f, lambda x: len(list_filter(hard, lambda c: contains({norm('x')}, c) OR contains(c, {norm('x')}))) > 0) AS keep FROM r) SELECT request_id, array_to_string(keep, ',') AS required, array_to_string(list_filter(f, lambda x: NOT list_contains(keep, x)), ',') AS optional FROM k",
    "effective_status": f"WITH s AS (SELECT l_suppkey, {pick([None, '', 'Qualified', None, 'Excluded', 'Conflict', 'Needs verification'], 'l_orderkey + l_linenumber')} AS q, {pick(['Verified', 'Conflict', 'Incomplete', 'Review', None], 'l_orderkey')} AS l FROM lineitem), t AS (SELECT l_suppkey, CASE WHEN coalesce(q, '') <> '' THEN q ELSE CASE l WHEN 'Verified' THEN 'Qualified' WHEN 'Conflict' THEN 'Conflict' WHEN 'Incomplete' THEN 'Excluded' ELSE 'Needs verification' END END AS status FROM s) SELECT l_suppkey, status, CASE status WHEN 'Qualified' THEN 'Verified' WHEN 'Conflict' THEN 'Conflict' WHEN 'Excluded' THEN 'Incomplete' ELSE 'Review' END AS legacy, count(*) AS n FROM t GROUP BY ALL",
    "status_page": with_(REC) + f", s AS (SELECT *, {pick([None, 'Qualified', 'Excluded'], 'record_id')} AS qualification_status, {pick(['Verified', 'Review'], 'record_id // 2')} AS status FROM rec), t AS (SELECT *, lower(concat_ws(' ', entity_name, brand, type, price, size, role, location, experience, founded, salary)) AS text FROM s WHERE coalesce(qualification_status, CASE WHEN status = 'Verified' THEN 'Qualified' ELSE 'Needs verification' END) = 'Qualified') SELECT record_id, qualification_status, status, location FROM t WHERE contains(text, 'pune') UNION ALL SELECT record_id, qualification_status, status, location FROM t WHERE contains(text, 'kochi')",
    "newest_runs": "SELECT o_orderkey, o_custkey, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 8",
    "natural_sort": with_(REC) + f", s AS (SELECT record_id, {pick(['Lot 7 row ', 'lot 7 Row ', 'No. 7, '], 'record_id')} || (record_id // 2) || {pick(['b', 'B2', 'b10'], 'record_id // 3')} AS label FROM rec) SELECT row_number() OVER (ORDER BY {natural('label')}) AS n, record_id, label FROM (SELECT * FROM s ORDER BY {natural('label')}, record_id LIMIT 40 OFFSET 40)",
    "cascade": "SELECT l_suppkey, count(*) AS children FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0) GROUP BY l_suppkey",
    "url_safety": with_(URLS) + f"SELECT page_id, u, error IS NULL AS valid, CASE WHEN error IS NULL THEN {_BARE} ELSE '' END AS domain, coalesce(error IN ('BLOCKED_HOST', 'PRIVATE_ADDRESS'), false) AS private, error, CASE WHEN error IS NULL AND u NOT IN ('', '—', 'Web Source') THEN CASE WHEN path = '' THEN full_ || '/' ELSE full_ END ELSE '#' END AS link, CASE WHEN u = '' THEN '' WHEN h = '' THEN split_part(regexp_replace(regexp_replace(u, '^https?://', ''), '^www\\.', ''), '/', 1) ELSE {root(_BARE, U.SCORING_SECOND_LEVEL)} END AS root, nullif({root(_BARE, U.RESOLVER_SECOND_LEVEL)}, '') AS resolver_root FROM judged",
    "complete_evidence": with_(REC, FIELDS_ALL, FIELDS, EV, SOURCES) + f", open_ AS (SELECT run_id, f.record_id, f.entity_name, field, value FROM fields f JOIN (SELECT run_id, record_id FROM rec) USING (record_id) WHERE NOT {missing('value')} AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.record_id = f.record_id AND lower(e.field) = lower(f.field) AND e.verification = 'Confirmed')), hit AS (SELECT o.record_id, o.field, o.value, s.title AS source, s.url, s.snippet, row_number() OVER (PARTITION BY o.record_id, o.field ORDER BY s.search_rank, s.url) AS i FROM open_ o JOIN src s USING (run_id) WHERE contains(lower(s.snippet), lower(o.value)) OR contains(lower(s.snippet), lower(o.entity_name)) OR contains(lower(s.title), lower(o.entity_name))) SELECT record_id, field, value, source, url, snippet FROM hit WHERE i = 1",
}
