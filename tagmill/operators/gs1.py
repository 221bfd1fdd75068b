"""GS1 element strings: parenthesised, compact and link forms, cleaning, dates and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions import mapping, stripped
from tagmill.values import BRAND

#: Fixed value: what a link of the maker's holds.
HOST = f"{BRAND.lower()}.com"
#: Application identifier, name, fixed length (0: variable).
AI_SPECS = (
    ("00", "sscc", 18), ("01", "gtin", 14), ("10", "batch_lot", 0), ("11", "prod_date", 6), ("13", "pack_date", 6), ("17", "exp_date", 6), ("21", "serial_no", 0), ("30", "var_count", 0),
    ("37", "qty_pieces", 0), ("240", "additional_id", 0), ("241", "customer_pn", 0), ("310", "net_wt_kg", 6), ("320", "net_wt_lb", 6), ("91", "internal_1", 0), ("92", "internal_2", 0),
    ("93", "internal_3", 0), ("99", "internal_9", 0),
)
NUMERIC = ("00", "01", "11", "13", "17", "30", "37", "240", "310", "320")


def clean(ai: Column, raw: Column) -> Column:
    """Leading digits of numeric values, cut to the fixed length."""
    value = stripped(raw)
    digits = F.regexp_extract(value, r"^(\d+)", 1)
    value = F.when(ai.isin(*NUMERIC) & (digits != ""), digits).otherwise(value)
    length = F.coalesce(F.try_element_at(mapping({a: n for a, _, n in AI_SPECS if n}), ai), F.lit(1 << 30))
    return F.substring(value, F.lit(1), length)


def field(ai: Column, raw: Column) -> Column:
    """STRUCT of name, value, formatted date and presence."""
    value = clean(ai, raw)
    name = F.coalesce(F.try_element_at(mapping({a: n for a, n, _ in AI_SPECS}), ai), F.concat(F.lit("ai_"), ai))
    date = F.when(name.endswith("_date") & value.rlike(r"^\d{6}\z"), F.concat_ws("-", F.substring(value, 1, 2), F.substring(value, 3, 2), F.substring(value, 5, 2)))
    return F.struct(ai.alias("ai_code"), name.alias("name"), value.alias("value"), date.alias("formatted"), (value != "").alias("present"))


def parenthesised(text: Column) -> Column:
    """(ai, raw) pairs of "(AI)VALUE" runs."""
    text = F.regexp_replace(text, r"AI ?\(", "(")
    found = lambda k: F.regexp_extract_all(text, F.lit(r"\((\d{2,4})\)([^(]+)"), F.lit(k))
    return F.transform(F.arrays_zip(found(1).alias("ai"), found(2).alias("raw")), lambda x: F.struct(x["ai"].alias("ai"), x["raw"].alias("raw")))


def compact(text: Column) -> Column:
    """(ai, raw) pairs, one for each group between separators: the longest known identifier, else two digits."""
    known = [a for a, _, _ in AI_SPECS]
    text = F.regexp_replace(text, r"^\](?:d2|d1|d0|Q3)", "")

    def part(p: Column) -> Column:
        ai = F.when(F.left(p, F.lit(4)).isin(*known), F.left(p, F.lit(4))).when(F.left(p, F.lit(3)).isin(*known), F.left(p, F.lit(3)))
        ai = ai.when(F.left(p, F.lit(2)).isin(*known) | p.rlike(r"^\d{2}"), F.left(p, F.lit(2)))
        return F.struct(ai.alias("ai"), F.substring(p, F.length(ai) + 1, F.length(p)).alias("raw"))

    return F.filter(F.transform(F.split(text, "\x1d"), part), lambda x: x["ai"].isNotNull())


def link(url: Column) -> Column:
    """(ai, raw) pairs of a link: its first path step /AI/VALUE, and numeric query keys, of repeated ones the first."""
    step = lambda k: F.regexp_extract(url, r"/(\d{2,4})/([^/?#]+)", k)
    path = F.filter(F.array(F.struct(step(1).alias("ai"), step(2).alias("raw"))), lambda p: p["ai"] != "")
    query = lambda k: F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)(\d+)=([^&]+)"), F.lit(k))
    pairs = F.transform(F.arrays_zip(query(1).alias("ai"), query(2).alias("raw")), lambda x: F.struct(x["ai"].alias("ai"), F.try_url_decode(x["raw"]).alias("raw")))
    earlier = lambda i, ai: F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["ai"] == ai)
    return F.concat(path, F.filter(pairs, lambda p, i: ~earlier(i, p["ai"])))


def detected(text: Column, host: str = HOST) -> Column:
    """The pairs by the form that the text shows: a link of the host, parentheses, else compact."""
    return F.when(text.contains(host), link(text)).when(text.contains("("), parenthesised(text)).otherwise(compact(text))


def latest(pairs: Column) -> Column:
    """The pairs without those whose identifier comes again later. Codes are short, so pairs are compared in place."""
    return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["ai"] == p["ai"]))


def merged(*maps: Column) -> Column:
    """One list of pairs out of several; the later list wins."""
    return latest(F.concat(*maps))


def fields(codes: DataFrame, keys: list[str], pairs: Column) -> DataFrame:
    """A row for each identifier of a code; of repeated ones the last counts. No shuffle."""
    return codes.select(*keys, F.inline(F.transform(latest(pairs), lambda p: field(p["ai"], p["raw"]))))


def promoted(ai_fields: DataFrame, *keys: str) -> DataFrame:
    """Identifiers that become fields of their own: the formatted value, else the value."""
    return ai_fields.where(F.col("ai_code").isin("240", "13", "11", "10")).select(*keys, F.concat(F.lit("ai_"), "ai_code").alias("field_id"), F.coalesce(F.nullif("formatted", F.lit("")), "value").alias("value"))
