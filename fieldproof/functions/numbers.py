"""Numbers and dates written in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldproof.functions.text import extract, is_missing, matches, rx

TITLE_NUMBER = r"(?i)^(?:top|best|list of|\d+\s+best|\d+\s+top)\s+\d+\b"
GROUPED = r"\d+(?:,\d{2,3})*(?:\.\d+)?"
RANGE = rf"(?i)({GROUPED})\s*(?:[-–—]|to)\s*({GROUPED})"
SCALED = r"(?:^|[^a-z])(?:lakhs?|crores?|cr)(?:[^a-z]|$)"
LAKH = r"(?i)(\d+(?:\.\d+)?)\s*(?:lakhs?|l)\b"
CRORE = r"(?i)(\d+(?:\.\d+)?)\s*(?:crores?|cr)\b"
COMMAS = r"(\d{1,3}(?:,\d{2,3})+(?:\.\d+)?)"
PLAIN = r"(\d+(?:\.\d+)?)"
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss[.SSS]X", "yyyy-MM-dd HH:mm:ss", "yyyy-MM", "yyyy/MM/dd", "d MMM yyyy", "MMM d, yyyy", "d MMMM yyyy", "MMMM d, yyyy", "dd/MM/yyyy", "d/M/yyyy, h:mm:ss a"]
YEAR = r"\b(19\d\d|20\d\d)\b"


def _double(col: Column) -> Column:
    return F.regexp_replace(col, ",", "").try_cast("double")


def parse_number(col: Column, ranges: bool = True, lpa_scale: bool = False) -> Column:
    """struct(num, min, max, unit): a range (its minimum is num), lakh and crore amounts, grouped and plain numbers.

    Null for missing text and text without a number. ``lpa_scale`` reads "15 LPA" as 15 lakh."""
    clean = F.trim(F.regexp_replace(col, rx(TITLE_NUMBER), ""))
    found = F.struct
    none = F.lit(None).cast("double")
    unit = F.lit(None).cast("string")
    lo, hi = _double(extract(clean, RANGE, 1)), _double(extract(clean, RANGE, 2))
    one = lambda c, scale=1.0, u=unit: F.when(c.isNotNull(), found((_double(c) * scale).alias("num"), none.alias("min"), none.alias("max"), u.alias("unit")))
    parts = [
        F.when(lo.isNotNull() & hi.isNotNull() & ~matches(F.lower(clean), SCALED), found(lo.alias("num"), lo.alias("min"), hi.alias("max"), unit.alias("unit"))) if ranges else None,
        one(extract(clean, r"(?i)(\d+(?:\.\d+)?)\s*lpa\b"), 1e5, F.lit("INR")) if lpa_scale else None,
        one(extract(clean, LAKH), 1e5, F.lit("INR")),
        one(extract(clean, CRORE), 1e7, F.lit("INR")),
        one(extract(clean, COMMAS)),
        one(extract(clean, PLAIN)),
    ]
    return F.when(~is_missing(clean), F.coalesce(*(p for p in parts if p is not None)))


def parse_date(col: Column) -> Column:
    """Timestamp of ISO and common spellings, else January 1 of the first year from 1900 to 2099 in the text."""
    clean = F.trim(col)
    return F.coalesce(*(F.try_to_timestamp(clean, F.lit(f)) for f in DATE_FORMATS), F.try_to_timestamp(F.concat(extract(clean, YEAR), F.lit("-01-01")), F.lit("yyyy-MM-dd")))
