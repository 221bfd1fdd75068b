"""Named fields out of texts and codes: the column expressions behind the extractors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions import mapping
from tagmill.values import SECTIONS, STOP_WORDS

#: Marks in their order, and whether case matters.
MARKS = (("CE", r"\bCE\b"), ("TSCA", r"\bTSCA\b"), ("ULEF", r"\bULEF\b"), ("CARB", r"\bCARB\b"), ("RoHS", r"(?i)\bRoHS\b"), ("EPEAT", r"\bEPEAT\b"))
ARTICLE = r"\b(\d{3})[\s.\-](\d{3})[\s.\-](\d{2})\b"


def article_number(text: Column) -> Column:
    part = lambda k: F.regexp_extract(text, ARTICLE, k)
    return F.when(text.rlike(ARTICLE), F.concat_ws(".", part(1), part(2), part(3)))


def itf_article(code: Column) -> Column:
    """STRUCT: article number from the first 8 digits, article code from the next 5."""
    digits = F.regexp_replace(code, r"\D", "")
    number = F.when(F.length(digits) >= 8, F.concat_ws(".", F.substring(digits, 1, 3), F.substring(digits, 4, 3), F.substring(digits, 7, 2)))
    return F.struct(number.alias("article_number"), F.when(F.length(digits) >= 13, F.substring(digits, 9, 5)).alias("article_code"))


def origin(text: Column) -> Column:
    """Verb and country by the first step of the ladder that fits; null without a country."""
    low = F.lower(text)
    has = lambda s: low.contains(s)  # noqa: E731  # fixed values: the words of the ladder, in its order
    republic = has("republic") | has("publi") | has("repub")
    country = (
        F.when(has("people") & (has("china") | republic), "People's Republic of China").when(republic & has("china"), "Republic of China").when(has("china"), "China")
        .when(has("vietnam"), "Vietnam").when(has("poland"), "Poland").when(has("india") & ~has("indiana"), "India").when(has("united states") | has(" usa"), "United States")
    )
    return F.concat(F.when(low.rlike(r"\bassembled\s+in\b"), "Assembled in ").otherwise("Made in "), country)


def date_stamp(text: Column, conf: Column) -> Column:
    """STRUCT of value, confidence and pattern_match from the labelled, the partial or the bare form."""
    label, partial, bare = r"[Dd][Aa][Tt][Ee]\s*[:\-]\s*(\d{4})", r"[Aa][Tt][Ee]\s*[:\-]?\s*(\d{4})", r"\b(\d{4})\b"
    rung = lambda p, share, sure: F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("value"), F.round(conf * share, 4).alias("confidence"), F.lit(sure).alias("pattern_match")))
    return F.coalesce(rung(label, 1.0, True), rung(partial, 0.9, True), rung(bare, 0.7, False))


def compliance_marks(text: Column) -> Column:
    """Marks found, joined; empty where there is text but no mark, null without text."""
    found = F.array_compact(F.array(*(F.when(text.rlike(p), m) for m, p in MARKS)))
    return F.when(F.trim(text) != "", F.array_join(found, ", "))


def age_rating(text: Column) -> Column:
    pattern = r"(?i)(\d+\s*[Mm]\s*\+|\d+\+)"
    return F.when(text.rlike(pattern), F.regexp_replace(F.regexp_extract(text, pattern, 1), r"\s", ""))


def is_name_token(token: Column) -> Column:
    """Capitals, none of the words that names don't have, and no unit; an article number has no capitals."""
    bare = F.regexp_replace(token, r"""^[.,;:|"'`]+|[.,;:|"'`]+$""", "")
    unit = bare.rlike(r"(?i)(?:cm|mm|kg|lbs?)\b")
    return bare.rlike(r"^[A-ZÅÄÖ]{2,}(?:[-/][A-ZÅÄÖ]+)*\n?\z") & ~F.upper(bare).isin(*STOP_WORDS) & ~unit


def highlight_tokens(value: Column) -> Column:
    """Distinct lower-case tokens of three characters or more, sorted."""
    parts = F.transform(F.split(value, r"(?U)[\s,;:()\[\]©®™\\]+"), lambda t: F.lower(F.regexp_replace(t, r"^[.,/\-]+|[.,/\-]+$", "")))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: F.length(t) >= 3)))


def fix_single(text: Column) -> Column:
    """A lone letter that looks like a one is a one."""
    return F.regexp_replace(text, r"^[lI|]+$", "1")


def file_hash(content: Column, dpi: Column) -> Column:
    return F.substring(F.sha2(F.concat(content, F.encode(dpi.cast("string"), "UTF-8")), 256), 1, 16)


def sniffed(head: Column) -> Column:
    """File suffix by the first bytes (binary)."""
    at = F.hex(head)
    return F.when(at.startswith("25504446"), ".pdf").when(at.startswith("FFD8FF"), ".jpg").when(at.startswith("89504E47"), ".png").when(at.startswith("49492A00") | at.startswith("4D4D002A"), ".tif").when(at.startswith("424D"), ".bmp")


def category(field_id: Column) -> Column:
    """The section of a field: the catalogue's, else by what its name holds."""
    low = F.lower(field_id)
    has = lambda *xs: F.greatest(*(low.contains(x) for x in xs), F.lit(False))
    known = F.try_element_at(mapping({f: section for section, fields in SECTIONS.items() for f in fields}), field_id)
    return F.coalesce(
        known,
        F.when(has("barcode", "ean", "itf") | low.startswith("ai_"), "barcodes").when(has("date", "stamp", "identifier"), "date").when(has("address", "supplier", "plant", "origin"), "address")
        .when(has("compliance", "copyright", "age"), "compliance").when(has("copy"), "copy").otherwise("identity"),
    )


def band(value: Column, high: float, low: float) -> Column:
    return F.when(value >= high, "green").when(value >= low, "amber").otherwise("red")


def check_digit_ok(code: Column) -> Column:
    """Modulo 10 check of a 14 digit code (stated, but never computed, by the reference)."""
    digit = lambda k: F.substring(code, k, 1).cast("int")
    total = sum((digit(k) * (3 if k % 2 else 1) for k in range(2, 14)), digit(1) * 3)
    return (F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10))) == digit(14)
