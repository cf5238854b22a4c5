"""Job titles: normal form, role family, technologies, seniority, and whether two titles agree.

The patterns are long; apply them to the distinct titles of a table and join the result back
(see operators.constraints)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldproof.functions.text import matches

# Pattern, family, priority. The highest priority wins, then the first listed.
FAMILIES = [
    (r"\bback\s*end\b", "BACKEND", 10),
    (r"\bserver[\s-]*side\b", "BACKEND", 10),
    (r"\bapi\s+(developer|engineer|architect)\b", "BACKEND", 10),
    (r"\bmicroservices?\s+(developer|engineer)\b", "BACKEND", 10),
    (r"\bfront\s*end\b", "FRONTEND", 10),
    (r"\bclient[\s-]*side\b", "FRONTEND", 10),
    (r"\bui\s+(developer|engineer)\b", "FRONTEND", 10),
    (r"\bui/ux\b", "FRONTEND", 10),
    (r"\breact\s+(developer|engineer)\b", "FRONTEND", 9),
    (r"\bangular\s+(developer|engineer)\b", "FRONTEND", 9),
    (r"\bvue\s+(developer|engineer)\b", "FRONTEND", 9),
    (r"\bfull\s*stack\b", "FULLSTACK", 11),
    (r"\bfull[\s-]*stack\b", "FULLSTACK", 11),
    (r"\bmern\s+(developer|engineer)\b", "FULLSTACK", 11),
    (r"\bmean\s+(developer|engineer)\b", "FULLSTACK", 11),
    (r"\bandroid\b", "MOBILE", 10),
    (r"\bios\b", "MOBILE", 10),
    (r"\bmobile\b", "MOBILE", 10),
    (r"\bflutter\s+(developer|engineer)\b", "MOBILE", 10),
    (r"\breact\s+native\b", "MOBILE", 10),
    (r"\bswift\s+(developer|engineer)\b", "MOBILE", 10),
    (r"\bkotlin\s+(developer|engineer)\b", "MOBILE", 9),
    (r"\bdevops\b", "DEVOPS", 10),
    (r"\bsite\s+reliability\b", "DEVOPS", 10),
    (r"\bsre\b", "DEVOPS", 10),
    (r"\binfrastructure\s+(engineer|developer)\b", "DEVOPS", 10),
    (r"\bplatform\s+engineer\b", "DEVOPS", 9),
    (r"\brelease\s+engineer\b", "DEVOPS", 9),
    (r"\bdata\s+engineer", "DATA_ENGINEERING", 10),
    (r"\betl\s+(developer|engineer)\b", "DATA_ENGINEERING", 10),
    (r"\bdata\s+pipeline\b", "DATA_ENGINEERING", 10),
    (r"\bbig\s+data\s+(developer|engineer)\b", "DATA_ENGINEERING", 10),
    (r"\bdata\s+scien", "DATA_SCIENCE", 10),
    (r"\bdata\s+analyst\b", "DATA_SCIENCE", 10),
    (r"\bstatistician\b", "DATA_SCIENCE", 10),
    (r"\banalytics\s+engineer\b", "DATA_SCIENCE", 10),
    (r"\bmachine\s+learning\b", "ML_AI", 10),
    (r"\bml\s+(engineer|developer|scientist)\b", "ML_AI", 10),
    (r"\bai\s+(engineer|developer|scientist|researcher)\b", "ML_AI", 10),
    (r"\bdeep\s+learning\b", "ML_AI", 10),
    (r"\bnlp\s+(engineer|developer|scientist)\b", "ML_AI", 10),
    (r"\bcomputer\s+vision\b", "ML_AI", 10),
    (r"\bqa\b", "QA_TESTING", 10),
    (r"\bquality\s+assurance\b", "QA_TESTING", 10),
    (r"\btest\s+(engineer|developer|automation|analyst|lead)\b", "QA_TESTING", 10),
    (r"\bsdet\b", "QA_TESTING", 10),
    (r"\bautomation\s+(engineer|tester)\b", "QA_TESTING", 10),
    (r"\bsecurity\s+(engineer|analyst|architect)\b", "SECURITY", 10),
    (r"\bcyber\s+security\b", "SECURITY", 10),
    (r"\bpentester\b", "SECURITY", 10),
    (r"\binfosec\b", "SECURITY", 10),
    (r"\bdba\b", "DATABASE", 10),
    (r"\bdatabase\s+(administrator|engineer|developer)\b", "DATABASE", 10),
    (r"\bcloud\s+(engineer|architect|developer)\b", "CLOUD", 10),
    (r"\baws\s+(engineer|architect|developer)\b", "CLOUD", 9),
    (r"\bazure\s+(engineer|architect|developer)\b", "CLOUD", 9),
    (r"\bgcp\s+(engineer|architect|developer)\b", "CLOUD", 9),
    (r"\bui\s*/?\s*ux\s+(design|designer)\b", "DESIGN", 10),
    (r"\bux\s+(design|designer|researcher)\b", "DESIGN", 10),
    (r"\bgraphic\s+design\b", "DESIGN", 10),
    (r"\bproduct\s+design\b", "DESIGN", 10),
    (r"\bproduct\s+manager\b", "PRODUCT", 10),
    (r"\bproduct\s+owner\b", "PRODUCT", 10),
    (r"\bprogram\s+manager\b", "PRODUCT", 9),
    (r"\bengineering\s+manager\b", "MANAGEMENT", 10),
    (r"\bvp\s+(?:of\s+)?engineering\b", "MANAGEMENT", 10),
    (r"\bcto\b", "MANAGEMENT", 10),
    (r"\bdirector\s+(?:of\s+)?engineering\b", "MANAGEMENT", 10),
]

# Spelling of a technology to its name.
TECHNOLOGIES = {
    "js": "javascript", "javascript": "javascript", "ts": "typescript", "typescript": "typescript",
    "react.js": "react", "reactjs": "react", "react": "react", "react native": "react native",
    "angular": "angular", "angularjs": "angular", "vue": "vue", "vue.js": "vue", "vuejs": "vue",
    "node": "node.js", "node.js": "node.js", "nodejs": "node.js", "express": "express", "express.js": "express",
    "next.js": "next.js", "nextjs": "next.js", "java": "java", "spring": "spring", "spring boot": "spring boot",
    "springboot": "spring boot", "python": "python", "django": "django", "flask": "flask", "fastapi": "fastapi",
    "go": "go", "golang": "go", "rust": "rust", "c++": "c++", "cpp": "c++", "c#": "c#", "csharp": "c#",
    ".net": ".net", "dotnet": ".net", "ruby": "ruby", "rails": "ruby on rails", "ruby on rails": "ruby on rails",
    "php": "php", "laravel": "laravel", "scala": "scala", "kotlin": "kotlin", "swift": "swift", "flutter": "flutter",
    "dart": "dart", "sql": "sql", "mysql": "mysql", "postgresql": "postgresql", "postgres": "postgresql",
    "mongodb": "mongodb", "mongo": "mongodb", "redis": "redis", "kafka": "kafka", "elasticsearch": "elasticsearch",
    "docker": "docker", "kubernetes": "kubernetes", "k8s": "kubernetes", "aws": "aws", "azure": "azure", "gcp": "gcp",
    "terraform": "terraform", "graphql": "graphql", "rest": "rest", "grpc": "grpc",
}
PHRASES = ["spring boot", "ruby on rails", "react native", "node.js", "vue.js", "next.js", "express.js", "react.js", "machine learning", "deep learning"]
LANGUAGES = ["java", "python", "javascript", "typescript", "go", "rust", "c++", "c#", "ruby", "php", "scala", "kotlin", "swift", "dart"]

# The first pattern that occurs decides.
SENIORITY = [
    (r"\bintern\b", "INTERN"),
    (r"\btrainee\b", "INTERN"),
    (r"\bentry[\s-]*level\b", "ENTRY"),
    (r"\bfresher\b", "ENTRY"),
    (r"\bjunior\b|\bjr\b", "JUNIOR"),
    (r"\bmid[\s-]*level\b", "MID"),
    (r"\bsenior\b|\bsr\b", "SENIOR"),
    (r"\blead\b", "LEAD"),
    (r"\bstaff\b", "STAFF"),
    (r"\bprincipal\b", "PRINCIPAL"),
    (r"\barchitect\b", "ARCHITECT"),
    (r"\bmanager\b", "MANAGER"),
    (r"\bdirector\b", "DIRECTOR"),
    (r"\bvp\b", "DIRECTOR"),
    (r"\bhead\s+of\b", "DIRECTOR"),
]
LEVELS = ["INTERN", "ENTRY", "JUNIOR", "MID", "SENIOR", "LEAD", "STAFF", "PRINCIPAL", "ARCHITECT", "MANAGER", "DIRECTOR"]


def ordered_families() -> list[tuple[str, str]]:
    return [(p, f) for p, f, _ in sorted(FAMILIES, key=lambda x: -x[2])]


def normalize_title(title: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(title)), r"[-–—/\\&|,;:•·]+", " ")
    t = F.regexp_replace(t, r"[()\[\]{}]", " ")
    t = F.regexp_replace(t, r"(?<![a-z])\.(?![a-z])", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def _first(title: Column, rules: list[tuple[str, str]]) -> Column:
    out = None
    for pattern, value in rules:
        out = F.when(matches(title, pattern), F.lit(value)) if out is None else out.when(matches(title, pattern), F.lit(value))
    # one search without word edges tells most texts that match no rule
    some = "|".join(f"(?:{p})" for p in dict.fromkeys(p.replace(r"\b", "") for p, _ in rules))
    return F.when(title.rlike(some), out.otherwise(F.lit("UNKNOWN"))).otherwise(F.lit("UNKNOWN"))


def technologies(title: Column) -> Column:
    """Distinct names: phrases first, then the words that are left, in order."""
    left, found = title, []
    for p in PHRASES:
        found.append(F.when(F.contains(left, F.lit(p)), F.lit(TECHNOLOGIES.get(p, p))))
        left = F.replace(left, F.lit(p), F.lit(" "))
    names = F.create_map(*(F.lit(x) for kv in TECHNOLOGIES.items() for x in kv))
    words = F.transform(F.split(left, r"\s+"), lambda w: F.try_element_at(names, F.regexp_replace(w, "[^a-z0-9.#+]", "")))
    return F.array_distinct(F.array_compact(F.concat(F.array(*found), words)))


def parse_title(title: Column) -> Column:
    t = normalize_title(title)
    return F.struct(t.alias("title"), _first(t, ordered_families()).alias("family"), technologies(t).alias("technologies"), _first(t, SENIORITY).alias("seniority"))


def family_match(required: Column, actual: Column) -> Column:
    either = ["BACKEND", "FRONTEND"]
    return (
        F.when(required == actual, F.lit(True))
        .when((required == "UNKNOWN") | (actual == "UNKNOWN"), F.lit(None))
        .when(((required == "FULLSTACK") & actual.isin(either)) | ((actual == "FULLSTACK") & required.isin(either)), F.lit(None))
        .otherwise(F.lit(False))
    )


def technology_match(required: Column, actual: Column) -> Column:
    langs = F.array(*(F.lit(x) for x in LANGUAGES))
    r, a = F.array_intersect(required, langs), F.array_intersect(actual, langs)
    return (
        F.when(F.size(required) == 0, F.lit(True))
        .when(F.size(actual) == 0, F.lit(None))
        .when(F.size(F.array_except(required, actual)) == 0, F.lit(True))
        .when((F.size(r) > 0) & (F.size(a) > 0) & ~F.arrays_overlap(r, a), F.lit(False))
    )


def seniority_match(required: Column, actual: Column) -> Column:
    levels = F.array(*(F.lit(x) for x in LEVELS))
    apart = F.abs(F.array_position(levels, required) - F.array_position(levels, actual))
    return F.when(required == "UNKNOWN", F.lit(True)).when(actual == "UNKNOWN", F.lit(None)).otherwise(apart <= 1)


def titles_clash(required: Column, actual: Column) -> Column:
    """Whether ``match_titles`` says NO_MATCH, without its reasons."""
    no = lambda c: F.coalesce(~c, F.lit(False))
    return no(family_match(required["family"], actual["family"])) | no(technology_match(required["technologies"], actual["technologies"])) | no(seniority_match(required["seniority"], actual["seniority"]))


def titles_match(required: Column, actual: Column) -> Column:
    """Whether ``match_titles`` says MATCH, without its reasons."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return yes(family_match(required["family"], actual["family"])) & yes(technology_match(required["technologies"], actual["technologies"])) & F.coalesce(seniority_match(required["seniority"], actual["seniority"]), F.lit(True))


def match_titles(required: Column, actual: Column) -> Column:
    """struct(result, reason) of two parsed titles: MATCH, NO_MATCH or UNKNOWN."""
    fam, tech, sen = family_match(required["family"], actual["family"]), technology_match(required["technologies"], actual["technologies"]), seniority_match(required["seniority"], actual["seniority"])
    need, has = F.array_join(required["technologies"], ", "), F.array_join(actual["technologies"], ", ")
    some = F.size(required["technologies"]) > 0
    verdict = lambda r, *text: F.struct(F.lit(r).alias("result"), F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in text)).alias("reason"))
    no = lambda c: F.coalesce(~c, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(no(fam), verdict("NO_MATCH", "Role family ", actual["family"], " conflicts with required ", required["family"], " role."))
        .when(no(tech), verdict("NO_MATCH", "Technology ", has, " does not match required ", need, "."))
        .when(no(sen), verdict("NO_MATCH", "Seniority ", actual["seniority"], " is incompatible with required ", required["seniority"], "."))
        .when(yes(fam) & yes(tech), verdict("MATCH", "Role family matches ", required["family"], F.when(some, F.concat(F.lit(" and required technology "), F.upper(need), F.lit(" is present"))).otherwise(F.lit("")), "."))
        .when(yes(fam), verdict("UNKNOWN", "Role family matches ", required["family"], ", but required technology ", F.upper(need), " could not be confirmed."))
        .when(yes(tech), verdict("UNKNOWN", "Role family could not be reliably determined from the title. Required technology ", F.upper(need), " is present."))
        .otherwise(verdict("UNKNOWN", "Role family could not be reliably determined from the available evidence."))
    )
