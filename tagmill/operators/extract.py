"""Named fields of a label out of its words and codes.

Each extractor reads the words of its zone, or all words of the label where the zone has too few (zones of other shapes have
other names, so there all words are read). Words are gathered once a label; everything after that is expressions on that
row. An extractor gives a row per field found: label_id, field_id, value, raw_text, confidence, zone, source, pattern_match,
bbox (null where no words can be named).

words: label_id, word_idx (their order), text, x, y, w, h, conf, zone. codes: label_id and the raw texts of the decoded
codes, itf, ean and matrix (null: not decoded). Words without confidence enough are left out beforehand by lines.gated().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.functions import ANY_CASE, EXACT, before, box_around, digits, first, hit, hits, last, stripped, tokens
from tagmill.operators import gs1
from tagmill.operators.fields import age_rating, article_number, compliance_marks, date_stamp, is_name_token, origin
from tagmill.operators.lines import joined, line_groups, line_words, texts
from tagmill.values import BRAND

#: Zones that each extractor reads, on wide and on tall labels.
ZONES = {
    "identity": ("left_identity", "top_identity"),
    "barcode": ("center_barcode", "mid_barcode"),
    "matrix": ("center_datamatrix",),
    "address": ("center_address", "mid_address"),
    "compliance": ("right_compliance", "bot_compliance"),
    "date": ("right_date", "bot_date"),
    "copy": ("right_copy_count",),
}

#: The patterns of the fields. The maker's mark is often read without its first letter.
_MARK = f"{BRAND[0]}?{BRAND[1:]}"
COPY_INLINE = EXACT + r"([1lIi|'`])\s*\((\d+)\)"
DIM_CM = ANY_CASE + r"\b(\d{2,4}(?:\.\d+)?)\s*(?:cm|mm)\b"
DIM_METRIC = ANY_CASE + r"(\d{1,4}(?:\.\d+)?(?:\s*[xX×]\s*\d{1,4}(?:\.\d+)?)+)\s*(cm|mm)\b"
DIM_IMPERIAL = ANY_CASE + r"""(\d+\s*['′]\s*(?:\d+(?:['′"″¼½¾⅛⅜⅝⅞/]\d*)?)?|\d+(?:\s*/\s*\d+)?\s*[xX×]\s*\d+(?:\s*/\s*\d+)?\s*["″¼½¾⅛⅜⅝⅞'])"""
DIM_BARE = EXACT + r"(?<!\d)(\d{2,4})(?!\d)"
GROSS_KG = ANY_CASE + r"\bGross\s+(\d+(?:\.\d+)?)\s*k(?:g)?\b"
GROSS_LBS = ANY_CASE + r"\bGross[^)]{0,30}\(\s*(\d+(?:\.\d+)?)\s*(?:lbs?|Ibs?)\s*\)"
NET_KG = ANY_CASE + r"\bNet\s+(\d+(?:\.\d+)?)\s*k(?:g)?\b"
NET_LBS = ANY_CASE + r"\bNet[^)]{0,30}\(\s*(\d+(?:\.\d+)?)\s*(?:lbs?|Ibs?)\s*\)"
WEIGHT_KG = ANY_CASE + r"\b(\d+(?:\.\d+)?)\s*k(?:g)?\b"
WEIGHT_LBS = ANY_CASE + r"\(?\s*(\d+(?:\.\d+)?)\s*(?:lbs?|Ibs?)\s*\)?"
QUANTITY = EXACT + r"(?<![0-9/.])\b[Xx×]\s*([2-9]|1[0-2])\b(?![0-9/.])"
PACKAGE_TYPE = ANY_CASE + r"(Not\s+RTS\s+\w+|\bRTS\s+\w+|\bRegular\b|\bSpecial\b)"
UNITS = ANY_CASE + r"\b(?:cm|mm|kg|lbs?)\b"
LOGO = ANY_CASE + rf"\b{BRAND}\b|Design\s+and\s+Quality|of\s+Sweden"
ITEM_NUMBER = EXACT + r"(?<!\d)(\d{4,6})(?!\d)"
HUMAN_DATE = ANY_CASE + r"(\d{2})[\-./](\d{2})[\-./](\d{2})\s*\(YY[\-.]?MM[\-.]?DD\)"
ANCHOR = ANY_CASE + rf"{BRAND}|{BRAND[1:]}|Sweden|SE\s*-\s*34\d{{3}}|Almhult|Älmhult|Inter\s+{BRAND}|{BRAND}\.com|B\.V\.|\.com"
STOP = ANY_CASE + r"\b(?:Made|Assembled|Republic|China|Vietnam|Poland|India|USA)\b"
ORIGIN_WORDS = ANY_CASE + r"\bmade\b|\bassembled\b|\bchina\b|\bvietnam\b|\bpoland\b|\bindia\b|\bpeople\b|\brepublic\b|\bstates\b|\busa\b"
COPYRIGHT = ANY_CASE + rf"(?:©|\(c\)|\||[©\)])?\s*Inter\s+{_MARK}[\s\S]{{0,180}}?B\.?V\.?"
PLANT_ID = ANY_CASE + r"\bPI[-–]\d{3,9}[-–]\d{1,3}\b"
PATENT = ANY_CASE + r"P[Ii1l]\s*[-–—:\s]+\s*([\d][\d\s\-]{4,})"
SUPPLIER_NAME = ANY_CASE + rf"{_MARK}\s+of\s+Sweden\s+AB"
SUPPLIER_ADDRESS = ANY_CASE + r"SE\s*[-–]\s*\d{5}\s*\S+"
CUSTOM_ID = ANY_CASE + r"([A-Za-z]{3,5})[-\s](\d{4})[-\s]([A-Za-z0-9]{3,6})"
COPY_COUNT = EXACT + r"\b(\d{1,2})\b"

_BOX = "struct<x:bigint,y:bigint,w:bigint,h:bigint>"


def _ws() -> Column:
    """The words of a label, as lines.texts() gives them."""
    return F.col("ws")


def _text() -> Column:
    return F.col("text")


def _field(name: str, value: Column, confidence: Column | float, zone: Column | str, raw: Column | None = None, source: Column | str = "ocr", sure: Column | bool | None = None, bbox: Column | None = None) -> tuple[str, Column]:
    """A field's name and row for _rows(), there or not; each expression stands in it once, as Spark would evaluate it wherever it stands."""
    lit = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return name, F.struct(
        F.lit(name).alias("field_id"), value.alias("value"), lit(raw, "string").alias("raw_text"), lit(confidence, "double").alias("confidence"),
        lit(zone, "string").alias("zone"), lit(source, "string").alias("source"), lit(sure, "boolean").alias("pattern_match"), lit(bbox, _BOX).alias("bbox"),
    )


def _rows(labels: DataFrame, *fields: tuple[str, Column], only: tuple[str, ...] = ()) -> DataFrame:
    """The fields (of `only`, if it names any) that have a value; the raw text is the value where there is no other."""
    rows = labels.select("label_id", F.explode(F.array(*(f for name, f in fields if not only or name in only))).alias("f")).where("f.value is not null").select("label_id", "f.*")
    return rows.withColumn("raw_text", F.coalesce("raw_text", "value"))


def _words(pattern: str, ws: Column | None = None) -> Column:
    return F.filter(_ws() if ws is None else ws, lambda w: w["text"].rlike(pattern))


def _word_box(target: Column) -> Column:
    """The box of the first word that holds the target or lies within it."""
    w = first(F.filter(_ws(), lambda w: F.contains(w["text"], target) | F.contains(target, w["text"])))
    return F.when(w.isNotNull(), F.struct(w["x"].alias("x"), w["y"].alias("y"), w["w"].alias("w"), w["h"].alias("h")))


def resolved(words: DataFrame, zones: tuple[str, ...], least: int = 2) -> DataFrame:
    """The words of the zones, or all of a label's where these are fewer than `least`."""
    inside = F.coalesce(F.col("zone").isin(*zones), F.lit(False))
    counted = words.withColumn("_inside", F.count_if(inside).over(Window.partitionBy("label_id")))
    return counted.where(inside | (F.col("_inside") < least)).drop("_inside")


def sub_tokens(words: DataFrame) -> DataFrame:
    """A row per token of words with several, each with an equal share of the word's box: word_idx, part, text, x, y, w, h."""
    parts = words.withColumn("parts", tokens(F.col("text"))).where(F.size("parts") > 1)
    width = F.greatest(F.lit(1), F.floor(F.col("w") / F.size("parts")))
    rows = parts.select("label_id", "word_idx", "x", "y", "h", width.alias("w"), F.posexplode("parts").alias("part", "text"))
    return rows.select("label_id", "word_idx", "part", "text", (F.col("x") + F.col("part") * F.col("w")).cast("long").alias("x"), "y", F.col("w").cast("long").alias("w"), "h")


def _valid(word: Column) -> Column:
    return F.filter(tokens(word["text"]), is_name_token)


def deduplicated_names(words: Column) -> Column:
    """Words of a name without those whose tokens are fewer than another's, and without one that two known tokens make up."""
    upper = lambda w: F.array_distinct(tokens(F.upper(w["text"])))
    within = lambda a, b: (F.size(F.array_except(upper(a), upper(b))) == 0) & (F.size(upper(b)) > F.size(upper(a)))
    widest = F.filter(words, lambda a: ~F.exists(words, lambda b: within(a, b)))
    widest = F.when(F.size(widest) > 0, widest).otherwise(words)
    known = F.flatten(F.transform(widest, upper))

    def made_up(w: Column) -> Column:
        text = F.upper(w["text"])
        cuts = F.when(F.length(text) >= 4, F.sequence(F.lit(2), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
        cut = F.exists(cuts, lambda i: F.array_contains(known, F.substring(text, F.lit(1), i)) & F.array_contains(known, F.substring(text, i + 1, F.length(text))))
        return ~F.contains(text, F.lit(" ")) & cut

    others = F.filter(widest, lambda w: ~made_up(w))
    return F.when(F.size(words) <= 1, words).when(F.size(others) > 0, others).otherwise(widest)


def name_words(words: DataFrame) -> DataFrame:
    """label_id, name: the words of the product name among the words of the identity zone, [] where there are none.

    Of the words in the upper 55 % of the zone, the first line with fit words gives its first run of them; a word of fit
    tokens only, in the order of words, takes over if it is as long and not lower.
    """
    over = Window.partitionBy("label_id")
    top, bottom = F.min("y").over(over), F.max(F.col("y") + F.col("h")).over(over)
    upper = words.withColumn("_middle", top + (bottom - top) * 0.55).where(F.col("y") + F.col("h") / 2 <= F.col("_middle")).drop("_middle")
    fit = lambda w: F.size(_valid(w)) > 0
    rest = F.slice("ws", F.greatest(F.lit(1), F.array_position(F.transform("ws", fit), True).cast("int")), F.size("ws"))
    run = before(rest, F.array_position(F.transform(rest, fit), False).cast("int"))
    lines = line_words(upper, "label_id").select("label_id", F.when(F.exists("ws", fit), F.struct("line_no", run.alias("run"))).alias("l"), F.col("ws"))
    rows = lines.groupBy("label_id").agg(F.min("l")["run"].alias("run"), F.array_sort(F.transform(F.flatten(F.collect_list("ws")), lambda w: F.struct(w["word_idx"].alias("at"), w.alias("w")))).alias("ws"))
    name = F.coalesce("run", F.filter(F.transform("ws", lambda s: s["w"]), lambda _: F.lit(False)))

    def take(found: Column, s: Column) -> Column:
        parts = tokens(s["w"]["text"])
        whole = (F.size(parts) >= 1) & (F.size(_valid(s["w"])) == F.size(parts)) & (F.size(parts) >= F.size(found))
        return F.when(whole & ((F.size(found) == 0) | (s["w"]["y"] <= first(found)["y"])), F.array(s["w"])).otherwise(found)

    return rows.select("label_id", deduplicated_names(F.aggregate("ws", name, take)).alias("name"))


def identity(words: DataFrame, codes: DataFrame) -> DataFrame:
    zone, conf = "left_identity", 0.82
    own = resolved(words, ZONES["identity"])
    labels = texts(own).join(name_words(own), "label_id", "left").join(codes.select("label_id", "itf"), "label_id", "left")
    word = lambda p, g=0: first(hits(_ws(), p, g))
    around = lambda p: box_around(_words(p))

    name = F.col("name")
    fit = F.flatten(F.transform(name, _valid))
    product = F.when(F.size(fit) > 0, F.upper(F.array_join(fit, " ")))
    surety = F.when(F.size(name) > 0, F.aggregate(name, F.lit(0.0), lambda total, w: total + w["conf"]) / F.size(name))

    one = hit(_text(), COPY_INLINE, 1)
    copies = F.when(one.isNotNull(), F.concat(F.when(one == "1", one).otherwise("1"), F.lit("("), hit(_text(), COPY_INLINE, 2), F.lit(")")))

    metric = F.coalesce(word(DIM_METRIC), hit(_text(), DIM_METRIC), word(DIM_CM))
    metric_box = F.when(word(DIM_METRIC).isNotNull(), box_around(F.slice(_words(DIM_METRIC), 1, 1))).when(_text().rlike(DIM_METRIC), around(DIM_CM)).otherwise(box_around(F.slice(_words(DIM_CM), 1, 1)))
    imperial = F.coalesce(word(DIM_IMPERIAL), hit(_text(), DIM_IMPERIAL))
    imperial_box = F.when(word(DIM_IMPERIAL).isNotNull(), box_around(F.slice(_words(DIM_IMPERIAL), 1, 1))).otherwise(around(DIM_IMPERIAL))
    bare = F.transform(_ws(), lambda w: first(F.filter(F.regexp_extract_all(w["text"], F.lit(DIM_BARE), F.lit(1)), lambda d: d.cast("int").between(10, 600))))
    bare = F.transform(F.array_compact(bare), lambda d: F.concat(d, F.lit(" cm")))
    sizes = F.when(F.size(hits(_ws(), DIM_CM)) > 0, hits(_ws(), DIM_CM)).otherwise(bare)
    dimensions = F.when(F.size(sizes) > 0, F.array_join(sizes, ", "))

    weigh = lambda p, head, unit: F.concat(F.lit(head), hit(_text(), p, 1), F.lit(unit))
    gross_words = F.filter(_ws(), lambda w: w["text"].rlike(GROSS_KG) | w["text"].rlike(GROSS_LBS))
    kilos = first(F.filter(_ws(), lambda w: w["text"].rlike(WEIGHT_KG) & ~w["text"].rlike(EXACT + r"\b(?:Net|net)\b")))
    bare_kilos = F.concat(hit(kilos["text"], WEIGHT_KG, 1), F.lit(" kg"), F.coalesce(F.concat(F.lit(" ("), hit(kilos["text"], WEIGHT_LBS, 1), F.lit(" lbs)")), F.lit("")))
    gross_text = F.coalesce(weigh(GROSS_KG, "Gross ", " kg"), weigh(GROSS_LBS, "Gross ", " lbs"))
    gross = F.coalesce(last(gross_words)["text"], gross_text, bare_kilos)
    gross_box = F.when(F.size(gross_words) > 0, box_around(gross_words)).when(gross_text.isNotNull(), around(ANY_CASE + r"\bGross\b")).otherwise(box_around(F.array(kilos)))
    net_words = F.filter(_ws(), lambda w: w["text"].rlike(NET_KG) | w["text"].rlike(NET_LBS))
    pounds = first(F.filter(_ws(), lambda w: w["text"].rlike(WEIGHT_LBS) & ~w["text"].rlike(WEIGHT_KG)))
    net_text = F.coalesce(weigh(NET_KG, "Net ", " kg"), weigh(NET_LBS, "Net ", " lbs"))
    net = F.coalesce(last(net_words)["text"], net_text, F.when(gross.isNotNull(), F.concat(hit(pounds["text"], WEIGHT_LBS, 1), F.lit(" lbs"))))
    net_box = F.when(F.size(net_words) > 0, box_around(net_words)).when(net_text.isNotNull(), around(ANY_CASE + r"\bNet\b")).otherwise(box_around(F.array(pounds)))
    each = F.array_compact(F.transform(_ws(), lambda w: F.coalesce(F.concat(hit(w["text"], WEIGHT_KG, 1), F.lit(" kg")), F.concat(hit(w["text"], WEIGHT_LBS, 1), F.lit(" lbs")))))
    each = F.when(F.size(each) > 0, each).otherwise(F.array_compact(F.array(weigh(WEIGHT_KG, "", " kg"), weigh(WEIGHT_LBS, "", " lbs"))))
    weight = F.when(F.size(each) > 0, F.array_join(each, " / "))

    measured = F.flatten(F.transform(F.array_compact(F.array(metric, dimensions, gross, net, weight)), lambda v: F.regexp_extract_all(v, F.lit(r"\d+"), F.lit(0))))
    plain = lambda w: ~w["text"].rlike(UNITS) & ~w["text"].rlike(r"""[/x×X'".]""") & stripped(w["text"]).rlike(EXACT + r"^\d{2,4}\z")
    package = first(F.filter(_ws(), lambda w: plain(w) & ~F.array_contains(measured, stripped(w["text"]))))

    code = F.when(F.length(digits(F.col("itf"))) >= 13, F.substring(digits(F.col("itf")), 9, 5))
    return _rows(
        labels,
        _field("copy_count_inline", copies, conf, zone, hit(_text(), COPY_INLINE), sure=True, bbox=_word_box(hit(_text(), COPY_INLINE))),
        _field("product_name", product, surety, zone, bbox=box_around(name)),
        _field("product_dimensions_metric", metric, conf, zone, sure=True, bbox=metric_box),
        _field("product_dimensions_imperial", imperial, conf, zone, sure=True, bbox=imperial_box),
        _field("dimensions", dimensions, conf, zone, _text()),
        _field("gross_weight", gross, conf, zone, sure=True, bbox=gross_box),
        _field("net_weight", net, conf, zone, sure=True, bbox=net_box),
        _field("weight", weight, conf, zone, _text()),
        _field("quantity_multiplier", F.concat(F.lit("×"), hit(_text(), QUANTITY, 1)), conf, zone, hit(_text(), QUANTITY), sure=True, bbox=around(QUANTITY)),
        _field("package_type", hit(_text(), PACKAGE_TYPE), conf, zone, sure=True, bbox=around(PACKAGE_TYPE)),
        _field("package_number", stripped(package["text"]), conf * 0.7, zone, sure=True, bbox=box_around(F.array(package))),
        _field(f"{BRAND.lower()}_logo", F.when(F.size(_words(LOGO)) > 0, f"{BRAND} logo detected"), 0.90, zone, F.array_join(F.transform(_words(LOGO), lambda w: w["text"]), " "), bbox=around(LOGO)),
        _field("article_code", code, 1.0, zone, digits(F.col("itf")), "barcode", True),
    )


def barcode(words: DataFrame, codes: DataFrame) -> DataFrame:
    zone, conf = "center_barcode", 0.75
    labels = texts(resolved(words, ZONES["barcode"])).join(codes.select("label_id", "itf"), "label_id", "left")
    code = digits(F.col("itf"))
    printed = article_number(_text())
    encoded = F.when(F.length(code) >= 8, F.concat_ws(".", F.substring(code, 1, 3), F.substring(code, 4, 3), F.substring(code, 7, 2)))
    article = F.coalesce(printed, encoded)
    surety, source = F.when(printed.isNotNull(), conf).otherwise(0.95), F.when(printed.isNotNull(), "ocr").otherwise("barcode")
    raw = F.coalesce(hit(_text(), r"\b\d{3}[\s.\-]\d{3}[\s.\-]\d{2}\b"), code)
    box = F.when(printed.isNotNull(), _word_box(raw))
    known = F.array_compact(F.array(F.when(F.length(code) >= 13, F.substring(code, 9, 5))))
    number = lambda w: hit(w["text"], ITEM_NUMBER, 1)
    free = lambda w: ~F.contains(F.coalesce(digits(article), F.lit("")), number(w)) & ~F.array_contains(known, number(w))
    item = first(F.filter(_ws(), lambda w: w["text"].rlike(ITEM_NUMBER) & free(w)))
    return _rows(
        labels,
        _field("article_number", article, surety, zone, raw, source, True, box),
        _field("itf14_human_readable", article, surety, zone, raw, source, None, box),
        _field("internal_item_number", hit(item["text"], ITEM_NUMBER, 1), conf * 0.8, zone, sure=True, bbox=box_around(F.array(item))),
    )


def matrix(words: DataFrame, codes: DataFrame, host: str = gs1.HOST) -> DataFrame:
    """Identifiers of the matrix code and of the text printed beside it, and the readable date.

    Where the text has identifiers, all of them, those of the code included, are promoted again from the merged map.
    """
    zone, conf = "center_datamatrix", 0.75
    near = texts(resolved(words, ZONES["matrix"]))
    labels = near.join(codes.where("matrix is not null").select("label_id", "matrix"), "label_id", "full_outer")
    decoded, read = gs1.latest(gs1.detected(F.col("matrix"), host)), gs1.latest(gs1.parenthesised(_text()))
    decoded, read = (F.coalesce(x, F.array().cast("array<struct<ai:string,raw:string>>")) for x in (decoded, read))
    printed = F.size("read") > 0
    labels = labels.select("label_id", "ws", "text", decoded.alias("decoded"), read.alias("read"))
    labels = labels.withColumn("merged", gs1.merged(F.col("read"), F.col("decoded")))

    def promoted(ai: str) -> tuple[Column, Column]:
        f = F.transform(F.filter("merged", lambda p: p["ai"] == ai), lambda p: gs1.field(p["ai"], p["raw"]))
        f = first(F.filter(f, lambda x: x["present"]))
        return F.coalesce(F.nullif(f["formatted"], F.lit("")), f["value"]), f["value"]

    surety, source = F.when(printed, conf).otherwise(1.0), F.when(printed, "ocr").otherwise("barcode")
    part = lambda k: hit(_text(), HUMAN_DATE, k)
    date, date_raw = F.concat_ws("-", part(1), part(2), part(3)), F.concat(part(1), part(2), part(3))
    date = F.when(date_raw.isNotNull(), date)
    packed, packed_raw = promoted("13")
    fields = [_field(f"ai_{ai}", promoted(ai)[0], surety, zone, promoted(ai)[1], source, True) for ai in ("240", "11", "10")]
    return _rows(
        labels,
        *fields,
        _field("ai_13", F.coalesce(packed, date), F.when(packed.isNotNull(), surety).otherwise(conf), zone, F.coalesce(packed_raw, date_raw), F.when(packed.isNotNull(), source).otherwise("ocr"), True),
        _field("human_readable_date", date, conf, zone, hit(_text(), HUMAN_DATE), sure=True, bbox=box_around(_words(EXACT + r"\d{2}[-./]\d{2}[-./]\d{2}"))),
    )


def decoded_codes(codes: DataFrame) -> DataFrame:
    """The decoded codes themselves and the text of the EAN code."""
    return _rows(
        codes,
        _field("itf14_barcode", F.col("itf"), 1.0, F.lit(None), source="barcode"),
        _field("ean_barcode", F.col("ean"), 1.0, F.lit(None), source="barcode"),
        _field("datamatrix_barcode", F.col("matrix"), 1.0, F.lit(None), source="barcode"),
        _field("ean_barcode_value", F.col("ean"), 1.0, "center_barcode", source="barcode", sure=True),
    )


def _addressed(words: DataFrame, both: bool, apart: str) -> DataFrame:
    """Words of the address (a) and the matrix zone (m). both: and their text; apart: and the words, lines and text of each zone named.

    With fewer than three words in both, all words of the label count as the address. Lines of both and of each zone are
    numbered by windows, so a label's words are shuffled and gathered once.
    """
    role = F.when(F.col("zone").isin(*ZONES["address"]), "a").when(F.col("zone").isin(*ZONES["matrix"]), "m")
    counted = words.withColumn("_n", F.count(role).over(Window.partitionBy("label_id")))
    own = counted.withColumn("role", F.when(F.col("_n") < 3, "a").otherwise(role)).where("role is not null").drop("_n")
    if both:
        own = line_groups(own).withColumnRenamed("line_no", "line")
    if apart:
        own = line_groups(own, "label_id", "role").withColumnRenamed("line_no", "role_line")
    word = F.struct("word_idx", "text", "x", "y", "w", "h", "conf", *["line"] * both, *["role", "role_line"] * bool(apart))
    labels = own.groupBy("label_id").agg(F.array_sort(F.collect_list(word)).alias("ws"))
    side = lambda r: F.filter(_ws(), lambda w: w["role"] == r)
    placed = lambda ws, line: F.array_sort(F.transform(ws, lambda w: F.struct(w[line].alias("line_no"), w["x"].alias("x"), w["y"].alias("y"), w["word_idx"].alias("word_idx"), w["text"].alias("text"))))
    labels = labels.withColumns(({"ls": placed(_ws(), "line")} if both else {}) | {f"{r}_ws": side(r) for r in apart})
    labels = labels.withColumns({f"{r}_ls": placed(F.col(f"{r}_ws"), "role_line") for r in apart})
    made = ["ws", *[joined(F.col("ls"))[1].alias("text")] * both]
    for r in apart:
        found, text = joined(F.col(f"{r}_ls"))
        made += [f"{r}_ws", F.coalesce(found, F.array().cast("array<string>")).alias(f"{r}_lines"), text.alias(f"{r}_text")]
    return labels.select("label_id", *made)


#: Of the fields of the address: its zone and confidence.
_ADDRESS = "center_address", 0.85


def _origin(labels: DataFrame) -> tuple[DataFrame, list[tuple[str, Column]]]:
    zone, conf = _ADDRESS
    return labels, [_field("origin_text", origin(_text()), conf, zone, F.lower(_text()), sure=True, bbox=box_around(_words(ORIGIN_WORDS)))]


def _block(labels: DataFrame) -> tuple[DataFrame, list[tuple[str, Column]]]:
    zone, conf = _ADDRESS
    a_ws = F.col("a_ws")
    # what is used more than once is a column, as Spark would evaluate it anew at each place
    labels = labels.withColumn("lines", F.filter(F.transform("a_lines", stripped), lambda x: x != ""))
    labels = labels.withColumn("start", F.array_position(F.transform("lines", lambda x: x.rlike(ANCHOR)), True).cast("int"))
    labels = labels.withColumn("block", F.when(F.col("start") > 0, F.slice("lines", F.greatest("start", F.lit(1)), F.size("lines"))))
    labels = labels.withColumn("stop", F.array_position(F.transform("block", lambda x: x.rlike(STOP)), True).cast("int"))
    unnumbered = lambda x: F.regexp_replace(x, ANY_CASE + rf"^\d{{1,3}}\s+(?={_MARK}|{BRAND[1:]}\b)", "")
    labels = labels.withColumns({"block": F.transform(before(F.col("block"), F.col("stop")), unnumbered), "anchors": F.filter(a_ws, lambda w: w["text"].rlike(ANCHOR) & ~w["text"].rlike(STOP))})
    anchors = F.col("anchors")
    ordered = F.array_sort(F.transform(anchors, lambda w: F.struct(w["y"].alias("y"), w["x"].alias("x"), w["word_idx"].alias("at"), stripped(w["text"]).alias("text"))))
    labels = labels.withColumn("ordered", F.filter(F.transform(ordered, lambda w: w["text"]), lambda x: x != ""))
    labels = labels.withColumn("block", F.when(F.size("block") > 0, F.col("block")).when(F.size("ordered") > 0, F.col("ordered")))
    block = F.col("block")
    block_box = F.when(F.size(anchors) > 0, box_around(anchors)).otherwise(box_around(_words(ANCHOR, a_ws)))
    return labels, [_field("address_block", F.when(F.size(block) > 0, F.array_join(block, "\n")), conf, zone, bbox=block_box)]


def _copyright(labels: DataFrame) -> tuple[DataFrame, list[tuple[str, Column]]]:
    zone, conf = _ADDRESS
    a_text, in_a = F.col("a_text"), lambda p: box_around(_words(p, F.col("a_ws")))
    labels = labels.withColumn("notice", F.coalesce(hit(a_text, COPYRIGHT), hit(_text(), COPYRIGHT)))
    notice = F.col("notice")
    pieces = a_text.rlike(ANY_CASE + rf"\bInter\s+{_MARK}\b") & a_text.rlike(ANY_CASE + r"\bB\.?V\.?\b")
    year = F.coalesce(F.concat(F.lit(" "), hit(a_text, EXACT + r"\b(20\d{2})\b", 1)), F.lit(""))
    made = F.when(notice.isNull() & pieces, F.concat(F.lit(f"© Inter {BRAND} Systems B.V."), year))
    notice_box = F.when(notice.isNotNull(), in_a(ANY_CASE + rf"\bInter\b|\b{_MARK}\b|\bSystems\b|\bB\.V\b")).otherwise(in_a(ANY_CASE + rf"\bInter\b|\b{BRAND}\b|\bSystems\b|\bB\.?V\.?\b"))
    return labels, [_field("copyright_notice", F.coalesce(notice, made), F.when(notice.isNotNull(), conf).otherwise(conf * 0.8), zone, F.coalesce(notice, a_text), bbox=notice_box)]


def _preferred(labels: DataFrame, order: str, **patterns: str) -> DataFrame:
    """labels with a column NAME_a and one NAME_m for each pattern: its match in each zone's text."""
    return labels.withColumns({f"{name}_{k}": hit(F.col(f"{k}_text"), pattern) for name, pattern in patterns.items() for k in order})


def _prefer(name: str, order: str, boxed: str) -> tuple[Column, Column, Column]:
    """Value, zone and box from the first of the two zones that has a match."""
    (one, two), zones = order, {"m": "center_datamatrix", "a": _ADDRESS[0]}
    found = F.col(f"{name}_{one}")
    box = box_around(_words(boxed, F.when(found.isNotNull(), F.col(f"{one}_ws")).otherwise(F.col(f"{two}_ws"))))
    return F.coalesce(found, f"{name}_{two}"), F.when(found.isNotNull(), zones[one]).otherwise(zones[two]), box


def _plant(labels: DataFrame) -> tuple[DataFrame, list[tuple[str, Column]]]:
    labels = _preferred(labels, "ma", plant=PLANT_ID, patent=PATENT)
    plant, plant_zone, plant_box = _prefer("plant", "ma", PLANT_ID)
    patent, patent_zone, patent_box = _prefer("patent", "ma", ANY_CASE + r"P[Ii1l]|patent")
    plant, plant_zone, plant_box = F.coalesce(plant, stripped(patent)), F.when(plant.isNotNull(), plant_zone).otherwise(patent_zone), F.when(plant.isNotNull(), plant_box).otherwise(patent_box)
    labels = labels.withColumn("plant_box", plant_box)
    return labels, [_field(name, plant, _ADDRESS[1], plant_zone, sure=True, bbox=F.col("plant_box")) for name in ("plant_identifier", "patent_info")]


def _supplier(labels: DataFrame) -> tuple[DataFrame, list[tuple[str, Column]]]:
    labels = _preferred(labels, "am", supplier=SUPPLIER_NAME, place=SUPPLIER_ADDRESS)
    supplier, supplier_zone, supplier_box = _prefer("supplier", "am", ANY_CASE + rf"\b{_MARK}\b")
    place, place_zone, place_box = _prefer("place", "am", ANY_CASE + r"\bSE\b|\d{5}")
    return labels, [_field("supplier_name", supplier, _ADDRESS[1], supplier_zone, sure=True, bbox=supplier_box), _field("supplier_address", place, _ADDRESS[1], place_zone, sure=True, bbox=place_box)]


#: The fields of the address and what makes them.
_PARTS = {("origin_text",): _origin, ("address_block",): _block, ("copyright_notice",): _copyright, ("plant_identifier", "patent_info"): _plant, ("supplier_name", "supplier_address"): _supplier}


def address(words: DataFrame, *only: str) -> DataFrame:
    """Origin, address block, copyright, plant or patent, supplier, or `only` those named, from the words of the address and the matrix zone.

    What the fields asked for don't need is not put into the plan.
    """
    parts = [part for names, part in _PARTS.items() if not only or not set(names).isdisjoint(only)]
    apart = "am" if not {_plant, _supplier}.isdisjoint(parts) else "" if parts == [_origin] else "a"
    labels, fields = _addressed(words, both=not {_origin, _copyright}.isdisjoint(parts), apart=apart), []
    for part in parts:
        labels, found = part(labels)
        fields += found
    return _rows(labels, *fields, only=only)


def compliance(words: DataFrame) -> DataFrame:
    zone, conf = "right_compliance", 0.65
    labels = texts(resolved(words, ZONES["compliance"]))
    return _rows(labels, _field("compliance_marks", compliance_marks(_text()), conf, zone, stripped(_text())), _field("age_rating", age_rating(_text()), conf, zone))


def date(words: DataFrame) -> DataFrame:
    """Date stamp, numeric prefix, letters and the identifier that is printed or made of the three."""
    zone, conf = "right_date", 0.88
    labels = texts(resolved(words, ZONES["date"])).withColumn("stamp", date_stamp(_text(), F.lit(conf)))
    single = F.flatten(F.transform(_ws(), lambda w: tokens(w["text"])))
    stamp = F.col("stamp.value")
    prefix = first(F.filter(single, lambda t: t.rlike(EXACT + r"^\d{3}\z") & ~F.coalesce(t == stamp, F.lit(False))))
    letters = first(F.filter(single, lambda t: t.rlike(r"^[a-zA-Z]{4}\z")))
    part = lambda k: hit(_text(), CUSTOM_ID, k)
    printed = F.when(_text().rlike(CUSTOM_ID), F.concat_ws("-", part(1), part(2), part(3)))
    made = F.when(letters.isNotNull() & stamp.isNotNull() & prefix.isNotNull(), F.concat_ws("-", F.lower(letters), stamp, prefix))
    return _rows(
        labels,
        _field("date_stamp", stamp, F.col("stamp.confidence"), zone, sure=F.col("stamp.pattern_match"), bbox=_word_box(stamp)),
        _field("date_numeric_prefix", prefix, conf, zone),
        _field("date_alpha_code", F.lower(letters), conf, zone, letters),
        _field("custom_identifier", F.coalesce(printed, made), F.when(printed.isNotNull(), conf).otherwise(conf * 0.85), zone, hit(_text(), CUSTOM_ID), sure=True, bbox=box_around(_words(CUSTOM_ID))),
    )


def copy_count(words: DataFrame) -> DataFrame:
    """The first number of one or two digits in the strip; no other words are asked."""
    labels = texts(words.where(F.col("zone").isin(*ZONES["copy"])))
    return _rows(labels, _field("copy_count", hit(_text(), COPY_COUNT, 1), 0.80, "right_copy_count", stripped(_text()), sure=True, bbox=box_around(F.slice("ws", 1, 1))))


def extracted(words: DataFrame, codes: DataFrame) -> DataFrame:
    """All fields of all labels, from words that are sure enough."""
    parts = [decoded_codes(codes), identity(words, codes), barcode(words, codes), matrix(words, codes), address(words), compliance(words), date(words), copy_count(words)]
    return reduce(DataFrame.unionByName, parts)
