"""Queries of the field extractors. The SQL forms read the same words and number their lines by themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill import fixtures as fx
from tagmill.catalog.registry import add, quoted
from tagmill.catalog.shapes import grouped
from tagmill.fixtures import ctes
from tagmill.operators import boxes, extract, fields, lines
from tagmill.values import STOP_WORDS

_words = lambda s, d: lines.gated(fx.tags(s, d))
_GATED = ("gated", "SELECT * FROM fx_tags WHERE conf>=0.25 OR conf=1")


def _zone(group: str) -> list[tuple[str, str]]:
    """CTEs w_ (the words of the zone, or all where they are fewer than two) and those of their lines and text."""
    inside = f"zone IN ({', '.join(map(repr, extract.ZONES[group]))})" if len(extract.ZONES[group]) > 1 else f"zone='{extract.ZONES[group][0]}'"
    own = f"SELECT w.* FROM gated w JOIN (SELECT label_id, count(*) FILTER ({inside}) AS n FROM gated GROUP BY label_id) USING (label_id) WHERE {inside} OR n<2"
    return [_GATED, (f"w_{group}", own), *grouped(f"w_{group}", group)]


def _m(text: str, pattern: str) -> str:
    return f"regexp_matches({text},{quoted(pattern)})"


def _x(text: str, pattern: str, group: int = 0) -> str:
    """The group of the first match, null where there is none."""
    return f"CASE WHEN {_m(text, pattern)} THEN regexp_extract({text},{quoted(pattern)},{group}) END"


def _first(pattern: str, group: int = 0, also: str = "true") -> str:
    return f"arg_min(regexp_extract(text,{quoted(pattern)},{group}), word_idx) FILTER ({_m('text', pattern)} AND {also})"


def _d(x: float) -> str:
    return f"{x!r}::DOUBLE"


def _long(rows: dict[str, tuple[str, str]], source: str) -> str:
    """A row per field that has a value: rows of (value, confidence)."""
    return " UNION ALL ".join(f"SELECT label_id, '{f}' AS field_id, {v} AS value, {c} AS confidence FROM {source} WHERE ({v}) IS NOT NULL" for f, (v, c) in rows.items())


def _add(name: str, group, rows: dict[str, tuple[str, str]], source: str, *more: tuple[str, str]) -> None:
    """A query over some fields of an extractor's, each with its value and confidence."""
    wanted = list(rows)

    def query(s: SparkSession, d: str) -> DataFrame:
        return group(s, d).where(F.col("field_id").isin(*wanted)).select("label_id", "field_id", "value", F.round("confidence", 6).alias("confidence"))

    add(name, query, ctes(f"SELECT label_id, field_id, value, round(confidence,6) AS confidence FROM ({_long(rows, source)})", *more))


_identity = lambda s, d: extract.identity(_words(s, d), fx.tag_codes(s, d))
E = extract
_BARE = "list_filter(regexp_extract_all(text,'\\d+'), lambda n: length(n) BETWEEN 2 AND 4 AND n::INT BETWEEN 10 AND 600)"
_PER_LABEL = ("a_identity", "SELECT label_id, " + ", ".join([
    f"{_first(E.DIM_METRIC)} AS metric", f"{_first(E.DIM_CM)} AS cm", f"{_first(E.DIM_IMPERIAL)} AS imperial", f"string_agg(regexp_extract(text,{quoted(E.DIM_CM)},0), ', ' ORDER BY word_idx) FILTER ({_m('text', E.DIM_CM)}) AS cms",
    f"string_agg(concat({_BARE}[1],' cm'), ', ' ORDER BY word_idx) FILTER (len({_BARE})>0) AS bares",
    f"arg_max(text, word_idx) FILTER ({_m('text', E.GROSS_KG)} OR {_m('text', E.GROSS_LBS)}) AS gross", f"arg_min(text, word_idx) FILTER ({_m('text', E.WEIGHT_KG)} AND NOT regexp_matches(text,'\\b(?:Net|net)\\b')) AS kilos",
    f"arg_max(text, word_idx) FILTER ({_m('text', E.NET_KG)} OR {_m('text', E.NET_LBS)}) AS net", f"arg_min(text, word_idx) FILTER ({_m('text', E.WEIGHT_LBS)} AND NOT {_m('text', E.WEIGHT_KG)}) AS pounds",
    f"string_agg(CASE WHEN {_m('text', E.WEIGHT_KG)} THEN concat(regexp_extract(text,{quoted(E.WEIGHT_KG)},1),' kg') WHEN {_m('text', E.WEIGHT_LBS)} THEN concat(regexp_extract(text,{quoted(E.WEIGHT_LBS)},1),' lbs') END, ' / ' ORDER BY word_idx) AS weights",
    f"count(*) FILTER ({_m('text', E.LOGO)})>0 AS logo",
]) + " FROM w_identity GROUP BY label_id")
_weigh = lambda p, head, unit: f"CASE WHEN {_m('text', p)} THEN concat('{head}',regexp_extract(text,{quoted(p)},1),'{unit}') END"
_QUANTITY = r"(?:^|[^0-9/.])\b[Xx×]\s*([2-9]|1[0-2])\b(?:[^0-9/.]|$)"
_IDENTITY = ("f_identity", "SELECT *, " + ", ".join([
    f"coalesce(metric, {_x('text', E.DIM_METRIC)}, cm) AS v_metric", f"coalesce(imperial, {_x('text', E.DIM_IMPERIAL)}) AS v_imperial", "coalesce(cms, bares) AS v_dimensions",
    f"coalesce(gross, {_weigh(E.GROSS_KG, 'Gross ', ' kg')}, {_weigh(E.GROSS_LBS, 'Gross ', ' lbs')}, CASE WHEN kilos IS NOT NULL THEN concat(regexp_extract(kilos,{quoted(E.WEIGHT_KG)},1),' kg', CASE WHEN {_m('kilos', E.WEIGHT_LBS)} THEN concat(' (',regexp_extract(kilos,{quoted(E.WEIGHT_LBS)},1),' lbs)') ELSE '' END) END) AS v_gross",
    f"coalesce(net, {_weigh(E.NET_KG, 'Net ', ' kg')}, {_weigh(E.NET_LBS, 'Net ', ' lbs')}) AS net_1", f"coalesce(weights, nullif(concat_ws(' / ',{_weigh(E.WEIGHT_KG, '', ' kg')},{_weigh(E.WEIGHT_LBS, '', ' lbs')}),'')) AS v_weight",
]) + " FROM texts_identity JOIN a_identity USING (label_id)")
_NET = ("n_identity", f"SELECT *, coalesce(net_1, CASE WHEN v_gross IS NOT NULL AND pounds IS NOT NULL THEN concat(regexp_extract(pounds,{quoted(E.WEIGHT_LBS)},1),' lbs') END) AS v_net FROM f_identity")
_ID = [*_zone("identity"), _PER_LABEL, _IDENTITY, _NET]
_add("dimension_ladder", _identity, {"product_dimensions_metric": ("v_metric", _d(0.82)), "product_dimensions_imperial": ("v_imperial", _d(0.82)), "dimensions": ("v_dimensions", _d(0.82))}, "n_identity", *_ID)
_add("weight_ladder", _identity, {"gross_weight": ("v_gross", _d(0.82)), "net_weight": ("v_net", _d(0.82)), "weight": ("v_weight", _d(0.82))}, "n_identity", *_ID)
_add("quantity_and_package", _identity, {
    "quantity_multiplier": (f"CASE WHEN regexp_matches(text,'{_QUANTITY}') THEN concat('×',regexp_extract(text,'{_QUANTITY}',1)) END", _d(0.82)), "package_type": (_x("text", E.PACKAGE_TYPE), _d(0.82)), "package_number": ("package", _d(0.82 * 0.7)),
}, "p_identity", *_ID, ("p_identity", "SELECT n.*, package FROM n_identity n LEFT JOIN (SELECT w.label_id, arg_min(trim(w.text), word_idx) AS package FROM w_identity w JOIN n_identity m USING (label_id) WHERE "
    f"NOT {_m('w.text', E.UNITS)} AND NOT regexp_matches(w.text,'[/x×X''\".]') AND regexp_full_match(trim(w.text),'\\d{{2,4}}') AND NOT list_contains(regexp_extract_all(concat_ws(' ',v_metric,v_dimensions,v_gross,v_net,v_weight),'\\d+'), trim(w.text)) GROUP BY w.label_id) USING (label_id)"))  # fmt: skip
_add("inline_copies_and_logo", _identity, {
    "copy_count_inline": (f"CASE WHEN {_m('text', E.COPY_INLINE)} THEN concat(CASE WHEN regexp_extract(text,{quoted(E.COPY_INLINE)},1)='1' THEN '1' ELSE '1' END,'(',regexp_extract(text,{quoted(E.COPY_INLINE)},2),')') END", _d(0.82)),
    f"{extract.BRAND.lower()}_logo": (f"CASE WHEN logo THEN '{extract.BRAND} logo detected' END", _d(0.9)),
}, "n_identity", *_ID)
_add("article_code", _identity, {"article_code": ("CASE WHEN length(itf)>=13 THEN substr(itf,9,5) END", "1::DOUBLE")}, "k_identity", *_ID, ("k_identity", "SELECT t.label_id, itf FROM texts_identity t LEFT JOIN fx_tagcodes USING (label_id)"))

# product names: lists of words instead of rows, as the order in a line counts
_BARE_TOKEN = """regexp_replace(regexp_replace(t,'^[.,;:|"''`]+',''),'[.,;:|"''`]+$','')"""
_FIT = f"regexp_matches({_BARE_TOKEN},'^[A-ZÅÄÖ]{{2,}}([-/][A-ZÅÄÖ]+)*$') AND NOT contains({_BARE_TOKEN},chr(10)) AND upper({_BARE_TOKEN}) NOT IN ({', '.join(map(repr, STOP_WORDS))}) AND NOT regexp_matches({_BARE_TOKEN},'(?i)(cm|mm|kg|lbs?)\\b')"
_NAME = [
    ("top_words", f"SELECT w.* FROM (SELECT *, string_split_regex(text,'\\s+') AS parts, list_filter(string_split_regex(text,'\\s+'), lambda t: {_FIT}) AS fit FROM w_identity) w JOIN (SELECT label_id, min(y) AS t, max(y+h) AS b FROM w_identity GROUP BY label_id) USING (label_id) WHERE y+h/2<=t+(b-t)*0.55::DOUBLE"),
    *grouped("top_words", "top"),
    ("runs", "SELECT label_id, line_no, CASE WHEN stop>0 THEN rest[:stop-1] ELSE rest END AS run FROM (SELECT *, coalesce(list_position(list_transform(rest, lambda s: len(s.fit)>0), false),0) AS stop FROM "
     "(SELECT *, ws[list_position(list_transform(ws, lambda s: len(s.fit)>0), true):] AS rest FROM (SELECT label_id, line_no, list({'text':text,'y':y,'conf':conf,'parts':parts,'fit':fit} ORDER BY x,y,word_idx) AS ws FROM numbered_top GROUP BY ALL) WHERE len(list_filter(ws, lambda s: len(s.fit)>0))>0))"),
    ("taken", "SELECT label_id, list_reduce(ws, lambda acc, x: CASE WHEN len(x[1].fit)=len(x[1].parts) AND len(x[1].parts)>=len(acc) AND (len(acc)=0 OR x[1].y<=acc[1].y) THEN x ELSE acc END, coalesce(run, ws[1][:0])) AS name FROM "
     "(SELECT label_id, list([{'text':text,'y':y,'conf':conf,'parts':parts,'fit':fit}] ORDER BY word_idx) AS ws FROM top_words GROUP BY label_id) LEFT JOIN (SELECT label_id, arg_min(run, line_no) AS run FROM runs GROUP BY label_id) USING (label_id)"),
    ("widest", "SELECT label_id, name, CASE WHEN len(name)<=1 OR len(kept)=0 THEN name ELSE kept END AS kept FROM (SELECT *, list_filter(name, lambda a: len(list_filter(name, lambda b: list_has_all(list_transform(b.parts, lambda t: upper(t)), list_transform(a.parts, lambda t: upper(t))) "
     "AND len(list_distinct(list_transform(b.parts, lambda t: upper(t))))>len(list_distinct(list_transform(a.parts, lambda t: upper(t))))))=0) AS kept FROM taken)"),
    ("named", "SELECT label_id, CASE WHEN len(name)<=1 OR len(others)=0 THEN kept ELSE others END AS name FROM (SELECT *, list_filter(kept, lambda w: contains(w.text,' ') OR len(list_filter(range(2, greatest(2, len(w.text)-1)), lambda i: list_contains(known, upper(w.text)[:i]) AND list_contains(known, upper(w.text)[i+1:])))=0) AS others "
     "FROM (SELECT *, flatten(list_transform(kept, lambda s: list_transform(s.parts, lambda t: upper(t)))) AS known FROM widest))"),
]
_add("product_name", _identity, {"product_name": ("nullif(upper(array_to_string(flatten(list_transform(name, lambda s: s.fit)),' ')),'')", "list_sum(list_transform(name, lambda s: s.conf))/len(name)")}, "named", *_zone("identity"), *_NAME)

_barcode = lambda s, d: extract.barcode(_words(s, d), fx.tag_codes(s, d))
_ARTICLE = r"\b(\d{3})[\s.\-](\d{3})[\s.\-](\d{2})\b"
_ITEM = r"(?:^|\D)(\d{4,6})(?:\D|$)"
_BAR = [*_zone("barcode"), ("b_article", f"SELECT t.label_id, itf, regexp_matches(text,'{_ARTICLE}') AS printed, CASE WHEN regexp_matches(text,'{_ARTICLE}') THEN concat_ws('.',regexp_extract(text,'{_ARTICLE}',1),regexp_extract(text,'{_ARTICLE}',2),regexp_extract(text,'{_ARTICLE}',3)) "
        "WHEN length(itf)>=8 THEN concat_ws('.',substr(itf,1,3),substr(itf,4,3),substr(itf,7,2)) END AS article FROM texts_barcode t LEFT JOIN fx_tagcodes USING (label_id)"),
        ("b_item", f"SELECT a.*, item FROM b_article a LEFT JOIN (SELECT w.label_id, arg_min(regexp_extract(text,'{_ITEM}',1), word_idx) AS item FROM w_barcode w JOIN b_article USING (label_id) WHERE regexp_matches(text,'{_ITEM}') AND NOT contains(coalesce(replace(article,'.',''),''), regexp_extract(text,'{_ITEM}',1)) "
         f"AND regexp_extract(text,'{_ITEM}',1) IS DISTINCT FROM CASE WHEN length(itf)>=13 THEN substr(itf,9,5) END GROUP BY w.label_id) USING (label_id)")]  # fmt: skip
_surety = f"CASE WHEN printed THEN {_d(0.75)} ELSE {_d(0.95)} END"
_add("article_and_item", _barcode, {"article_number": ("article", _surety), "itf14_human_readable": ("article", _surety), "internal_item_number": ("item", _d(0.75 * 0.8))}, "b_item", *_BAR)

_matrix = lambda s, d: extract.matrix(_words(s, d), fx.tag_codes(s, d))
_AI_TEXT = "regexp_extract(regexp_replace(text,'AI ?\\(','(','g'),'\\({0}\\)([^(]+)',1)"
_AI_PARTS = []
for _ai in ("240", "13", "11", "10"):
    _own = {"240": "CASE WHEN matrix IS NOT NULL THEN '0299999710973' END", "13": "CASE WHEN matrix IS NOT NULL THEN '260402' END", "11": "NULL", "10": "CASE WHEN matrix LIKE 'https%' THEN 'AB/1' END"}[_ai]
    _raw = f"nullif(trim({_AI_TEXT.format(_ai)}, ' '||chr(10)),'')"
    _read = f"left(coalesce(nullif(regexp_extract({_raw},'^(\\d+)',1),''),{_raw}),{6 if _ai != '240' else 1000})" if _ai != "10" else _raw
    _value = f"coalesce({_own},{_read})"
    _AI_PARTS.append(f"{_value} AS raw_{_ai}, " + (f"CASE WHEN regexp_full_match({_value},'\\d{{6}}') THEN concat(substr({_value},1,2),'-',substr({_value},3,2),'-',substr({_value},5,2)) ELSE {_value} END AS ai_{_ai}" if _ai in ("11", "13") else f"{_value} AS ai_{_ai}"))
_MAT = [*_zone("matrix"), ("m_codes", "SELECT label_id, text, matrix, coalesce(regexp_matches(regexp_replace(text,'AI ?\\(','(','g'),'\\((\\d{2,4})\\)([^(]+)'),false) AS printed, " + ", ".join(_AI_PARTS) + " FROM texts_matrix FULL JOIN (SELECT label_id, matrix FROM fx_tagcodes WHERE matrix IS NOT NULL) USING (label_id)"),
        ("m_dates", f"SELECT *, CASE WHEN {_m('text', E.HUMAN_DATE)} THEN concat_ws('-',regexp_extract(text,{quoted(E.HUMAN_DATE)},1),regexp_extract(text,{quoted(E.HUMAN_DATE)},2),regexp_extract(text,{quoted(E.HUMAN_DATE)},3)) END AS printed_date FROM m_codes")]
_conf = f"CASE WHEN printed THEN {_d(0.75)} ELSE 1::DOUBLE END"
_add("matrix_fields", _matrix, {
    "ai_240": ("ai_240", _conf), "ai_11": ("ai_11", _conf), "ai_10": ("ai_10", _conf), "ai_13": ("coalesce(ai_13,printed_date)", f"CASE WHEN ai_13 IS NOT NULL THEN {_conf} ELSE {_d(0.75)} END"), "human_readable_date": ("printed_date", _d(0.75)),
}, "m_dates", *_MAT)
_add("decoded_codes", lambda s, d: extract.decoded_codes(fx.tag_codes(s, d)), {"itf14_barcode": ("itf", "1::DOUBLE"), "ean_barcode": ("ean", "1::DOUBLE"), "datamatrix_barcode": ("matrix", "1::DOUBLE"), "ean_barcode_value": ("ean", "1::DOUBLE")}, "fx_tagcodes")

_address = lambda *only: lambda s, d: extract.address(lines.gated(fx.tags(s, d, together=True)), *only)
_ADDR = [
    _GATED, ("roles", "SELECT w.*, CASE WHEN n<3 THEN 'a' WHEN zone IN ('center_address','mid_address') THEN 'a' WHEN zone='center_datamatrix' THEN 'm' END AS role FROM gated w JOIN (SELECT label_id, count(*) FILTER (zone IN ('center_address','mid_address','center_datamatrix')) AS n FROM gated GROUP BY label_id) USING (label_id)"),
    ("w_both", "SELECT * FROM roles WHERE role IS NOT NULL"), *grouped("w_both", "both"), *grouped("w_both", "role", "label_id", "role"),
    ("starts", f"SELECT label_id, min(line_no) AS start FROM lines_role WHERE role='a' AND {_m('trim(line)', E.ANCHOR)} GROUP BY label_id"),
    ("stops", f"SELECT label_id, min(line_no) AS stop FROM lines_role JOIN starts USING (label_id) WHERE role='a' AND line_no>=start AND {_m('trim(line)', E.STOP)} GROUP BY label_id"),
    ("blocks", "SELECT label_id, string_agg(CASE WHEN regexp_matches(trim(line),'(?i)^\\d{1,3}\\s+(I?KEA|CEA\\b)') THEN regexp_replace(trim(line),'^\\d{1,3}\\s+','') ELSE trim(line) END, chr(10) ORDER BY line_no) AS block FROM lines_role JOIN starts USING (label_id) LEFT JOIN stops USING (label_id) "
     "WHERE role='a' AND trim(line)<>'' AND line_no>=start AND (stop IS NULL OR line_no<stop) GROUP BY label_id"),
    ("anchors", f"SELECT label_id, string_agg(trim(text), chr(10) ORDER BY y, x, word_idx) AS block FROM w_both WHERE role='a' AND {_m('text', E.ANCHOR)} AND NOT {_m('text', E.STOP)} GROUP BY label_id"),
    ("addressed", "SELECT b.label_id, b.text, coalesce(a.text,'') AS a_text, coalesce(m.text,'') AS m_text, coalesce(k.block, n.block) AS block FROM texts_both b LEFT JOIN (SELECT * FROM texts_role WHERE role='a') a USING (label_id) LEFT JOIN (SELECT * FROM texts_role WHERE role='m') m USING (label_id) "
     "LEFT JOIN blocks k USING (label_id) LEFT JOIN anchors n USING (label_id)"),
]
_prefer = lambda p, first, second: f"coalesce({_x(first, p)}, {_x(second, p)})"
_notice = _prefer(E.COPYRIGHT, "a_text", "text")
_made = f"CASE WHEN regexp_matches(a_text,'(?i)\\bInter\\s+I?KEA\\b') AND regexp_matches(a_text,'(?i)\\bB\\.?V\\.?\\b') THEN concat('© Inter IKEA Systems B.V.', CASE WHEN regexp_matches(a_text,'\\b20\\d{{2}}\\b') THEN concat(' ',regexp_extract(a_text,'\\b(20\\d{{2}})\\b',1)) ELSE '' END) END"
_has = lambda t: f"contains(lower(text),'{t}')"
_republic = f"({_has('republic')} OR {_has('publi')} OR {_has('repub')})"
_country = (
    f"CASE WHEN {_has('people')} AND ({_has('china')} OR {_republic}) THEN 'People''s Republic of China' WHEN {_republic} AND {_has('china')} THEN 'Republic of China' WHEN {_has('china')} THEN 'China' WHEN {_has('vietnam')} THEN 'Vietnam' "
    f"WHEN {_has('poland')} THEN 'Poland' WHEN {_has('india')} AND NOT {_has('indiana')} THEN 'India' WHEN {_has('united states')} OR {_has(' usa')} THEN 'United States' END"
)
_origin = f"CASE WHEN ({_country}) IS NOT NULL THEN concat(CASE WHEN regexp_matches(lower(text),'\\bassembled\\s+in\\b') THEN 'Assembled in ' ELSE 'Made in ' END, {_country}) END"
_plant = f"coalesce({_prefer(E.PLANT_ID, 'm_text', 'a_text')}, trim({_prefer(E.PATENT, 'm_text', 'a_text')}, ' '||chr(10)))"
_add("address_block", _address("address_block"), {"address_block": ("block", _d(0.85))}, "addressed", *_ADDR)
_add("origin_ladder", _address("origin_text"), {"origin_text": (_origin, _d(0.85))}, "addressed", *_ADDR)
_add("copyright_notice", _address("copyright_notice"), {"copyright_notice": (f"coalesce({_notice}, {_made})", f"CASE WHEN ({_notice}) IS NOT NULL THEN {_d(0.85)} ELSE {_d(0.85 * 0.8)} END")}, "addressed", *_ADDR)
_add("plant_or_patent", _address("plant_identifier", "patent_info"), {"plant_identifier": (_plant, _d(0.85)), "patent_info": (_plant, _d(0.85))}, "addressed", *_ADDR)
_add("supplier", _address("supplier_name", "supplier_address"), {"supplier_name": (_prefer(E.SUPPLIER_NAME, "a_text", "m_text"), _d(0.85)), "supplier_address": (_prefer(E.SUPPLIER_ADDRESS, "a_text", "m_text"), _d(0.85))}, "addressed", *_ADDR)

_AGE = r"(?i)(\d+\s*[Mm]\s*\+|\d+\+)"
_marks = "concat_ws(', '," + ",".join(f"CASE WHEN regexp_matches(text,'{p}') THEN '{m}' END" for m, p in fields.MARKS) + ")"
_add("compliance_marks", lambda s, d: extract.compliance(_words(s, d)), {"compliance_marks": (f"CASE WHEN trim(text)<>'' THEN {_marks} END", _d(0.65)), "age_rating": (f"CASE WHEN regexp_matches(text,'{_AGE}') THEN regexp_replace(regexp_extract(text,'{_AGE}',1),'\\s','','g') END", _d(0.65))}, "texts_compliance", *_zone("compliance"))

_LABELLED, _PARTIAL, _YYWW = r"[Dd][Aa][Tt][Ee]\s*[:\-]\s*(\d{4})", r"[Aa][Tt][Ee]\s*[:\-]?\s*(\d{4})", r"\b(\d{4})\b"
_stamp = f"CASE WHEN regexp_matches(text,'{_LABELLED}') THEN regexp_extract(text,'{_LABELLED}',1) WHEN regexp_matches(text,'{_PARTIAL}') THEN regexp_extract(text,'{_PARTIAL}',1) WHEN regexp_matches(text,'{_YYWW}') THEN regexp_extract(text,'{_YYWW}',1) END"
_DATES = [
    *_zone("date"), ("d_stamps", f"SELECT *, {_stamp} AS stamp, CASE WHEN regexp_matches(text,'{_LABELLED}') THEN {_d(0.88)} WHEN regexp_matches(text,'{_PARTIAL}') THEN {_d(0.792)} ELSE {_d(0.616)} END AS stamp_conf FROM texts_date"),
    ("d_tokens", "SELECT label_id, word_idx, generate_subscripts(string_split_regex(text,'\\s+'),1) AS part, unnest(string_split_regex(text,'\\s+')) AS token FROM w_date"),
    ("d_parts", "SELECT s.*, prefix, letters FROM d_stamps s LEFT JOIN (SELECT label_id, arg_min(token, word_idx*1000+part) FILTER (regexp_full_match(token,'\\d{3}') AND token IS DISTINCT FROM stamp) AS prefix, arg_min(token, word_idx*1000+part) FILTER (regexp_full_match(token,'[a-zA-Z]{4}')) AS letters "
     "FROM d_tokens JOIN d_stamps USING (label_id) GROUP BY label_id) USING (label_id)"),
]
_CUSTOM = quoted(E.CUSTOM_ID)
_printed = f"CASE WHEN {_m('text', E.CUSTOM_ID)} THEN concat_ws('-',regexp_extract(text,{_CUSTOM},1),regexp_extract(text,{_CUSTOM},2),regexp_extract(text,{_CUSTOM},3)) END"
_synthetic = "CASE WHEN letters IS NOT NULL AND stamp IS NOT NULL AND prefix IS NOT NULL THEN concat_ws('-',lower(letters),stamp,prefix) END"
_date = lambda s, d: extract.date(_words(s, d))
_add("date_stamp", _date, {"date_stamp": ("stamp", "stamp_conf")}, "d_parts", *_DATES)
_add("date_parts", _date, {"date_numeric_prefix": ("prefix", _d(0.88)), "date_alpha_code": ("lower(letters)", _d(0.88)), "custom_identifier": (f"coalesce({_printed},{_synthetic})", f"CASE WHEN ({_printed}) IS NOT NULL THEN {_d(0.88)} ELSE {_d(0.88 * 0.85)} END")}, "d_parts", *_DATES)
_add("copy_count", lambda s, d: extract.copy_count(_words(s, d)), {"copy_count": ("CASE WHEN regexp_matches(text,'\\b\\d{1,2}\\b') THEN regexp_extract(text,'\\b(\\d{1,2})\\b',1) END", _d(0.8))}, "texts_copy", _GATED, ("w_copy", "SELECT * FROM gated WHERE zone='right_copy_count'"), *grouped("w_copy", "copy"))

# what the extractors are made of
add("zone_fallback", lambda s, d: extract.resolved(_words(s, d), extract.ZONES["date"]).groupBy("label_id").agg(F.count("*").alias("n")), ctes("SELECT label_id, count(*) AS n FROM w_date GROUP BY label_id", *_zone("date")[:2]))
add("sub_tokens", lambda s, d: extract.sub_tokens(fx.tags(s, d)), ctes(
    "SELECT label_id, word_idx, (part-1)::INT AS part, parts[part] AS text, x+(part-1)*wide AS x, y, wide AS w, h FROM (SELECT *, greatest(1, w//len(parts)) AS wide, unnest(range(1, len(parts)+1)) AS part FROM (SELECT *, string_split_regex(text,'\\s+') AS parts FROM fx_tags) WHERE len(parts)>1)"))
_box = lambda p, name: f"SELECT label_id, '{name}' AS field_id, min(x) AS x, min(y) AS y, max(x+w)-min(x) AS w, max(y+h)-min(y) AS h FROM w_identity WHERE {_m('text', p)} GROUP BY label_id"
add("field_boxes", lambda s, d: _identity(s, d).where(F.col("field_id").isin("package_type", f"{extract.BRAND.lower()}_logo") & F.col("bbox").isNotNull()).select("label_id", "field_id", "bbox.*"), ctes(
    f"SELECT * FROM ({_box(E.PACKAGE_TYPE, 'package_type')}) UNION ALL {_box(E.LOGO, extract.BRAND.lower() + '_logo')}", *_zone("identity")))
add("name_tokens", lambda s, d: fx.words(s, d).where(fields.is_name_token(F.col("text"))).select("label_id", "word_idx", "text"), ctes(
    f"SELECT label_id, word_idx, text FROM (SELECT *, text AS t FROM fx_words UNION ALL SELECT *, text AS t FROM fx_words WHERE false) WHERE {_FIT}"))
add("tag_name_tokens", lambda s, d: fx.tags(s, d).where(fields.is_name_token(F.col("text"))).select("label_id", "word_idx", "text"), ctes(f"SELECT label_id, word_idx, text FROM (SELECT *, text AS t FROM fx_tags) WHERE {_FIT}"))
add("single_sign_fix", lambda s, d: fx.tags(s, d).select("label_id", "word_idx", fields.fix_single(F.col("text")).alias("text")), ctes("SELECT label_id, word_idx, CASE WHEN regexp_full_match(text,'[lI|]+') THEN '1' ELSE text END AS text FROM fx_tags"))
_TOKENS = "list_distinct(list_filter(list_transform(string_split_regex({0},'[\\s,;:()\\[\\]©®™\\\\]+'), lambda t: lower(trim(t,'.,/-'))), lambda t: length(t)>=3))"
add("highlight_tokens", lambda s, d: fx.zone_texts(s, d).select("label_id", F.array_join(fields.highlight_tokens(F.col("identity_text")), " ").alias("tokens")), ctes(
    f"SELECT label_id, array_to_string(list_sort({_TOKENS.format('identity_text')}),' ') AS tokens FROM fx_zone_texts"))
_shown = lambda s, d: extract.identity(_words(s, d), fx.tag_codes(s, d)).where("field_id in ('package_type','gross_weight','dimensions')").select("label_id", "field_id", "value", F.when(F.col("label_id") % 3 == 0, "right_date").otherwise(F.col("zone")).alias("zone"))
_SHOWN = ("shown", "SELECT label_id, field_id, value, CASE WHEN label_id%3=0 THEN 'right_date' ELSE 'left_identity' END AS zone FROM (" + _long({"package_type": (_x("text", E.PACKAGE_TYPE), _d(0.82)), "gross_weight": ("v_gross", _d(0.82)), "dimensions": ("v_dimensions", _d(0.82))}, "n_identity") + ")")
_AGREE = "(t=c OR (length(t)>=5 AND (contains(c,t) OR contains(t,c))))"
add("word_boxes", lambda s, d: boxes.word_boxes(_shown(s, d), fx.tags(s, d)), ctes(
    f"SELECT label_id, field_id, word_idx, x, y, w, h FROM (SELECT *, row_number() OVER (PARTITION BY label_id, field_id, x//12, y//12 ORDER BY word_idx) AS k FROM (SELECT *, max(near) OVER (PARTITION BY label_id, field_id) AS any_near FROM (SELECT s.label_id, s.field_id, w.word_idx, w.x, w.y, w.w, w.h, max((w.zone=s.zone)::INT) AS near "
    f"FROM (SELECT *, unnest({_TOKENS.format('value')}) AS t FROM shown) s JOIN (SELECT *, lower(regexp_replace(text,'[^\\w.\\-]','','g')) AS c FROM fx_tags) w USING (label_id) WHERE c<>'' AND {_AGREE} GROUP BY ALL)) WHERE near=any_near) WHERE k=1", *_ID, _SHOWN))  # fmt: skip
