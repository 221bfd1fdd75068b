"""Queries over GS1 element strings and other codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill import fixtures as fx
from tagmill.catalog.registry import add
from tagmill.fixtures import ctes
from tagmill.operators import fields, gs1, passes

_KEYS = ["l_orderkey", "l_linenumber", "gs1"]
_DATE = "concat(substr({0},1,2),'-',substr({0},3,2),'-',substr({0},5,2))"
_PAREN = ("paren", "SELECT l_orderkey, l_linenumber, gs1, ai AS ai_code, v AS value FROM (SELECT *, unnest(regexp_extract_all(gs1,'\\((\\d{2,4})\\)([^(]+)',1)) AS ai, unnest(regexp_extract_all(gs1,'\\((\\d{2,4})\\)([^(]+)',2)) AS v FROM fx_codes)")
_NAMED = "CASE ai_code WHEN '240' THEN 'additional_id' WHEN '11' THEN 'prod_date' WHEN '10' THEN 'batch_lot' ELSE concat('ai_',ai_code) END AS name"
_gs1 = lambda s, d: gs1.fields(fx.codes(s, d), _KEYS, gs1.parenthesised(F.col("gs1")))
add("gs1_paren", _gs1, ctes(f"SELECT *, {_NAMED}, CASE WHEN ai_code='11' THEN {_DATE.format('value')} END AS formatted, value<>'' AS present FROM paren", _PAREN))
add("ai_promote", lambda s, d: gs1.promoted(_gs1(s, d), *_KEYS), ctes(f"SELECT l_orderkey, l_linenumber, gs1, concat('ai_',ai_code) AS field_id, CASE WHEN ai_code='11' THEN {_DATE.format('value')} ELSE value END AS value FROM paren", _PAREN))
add("gs1_compact", lambda s, d: gs1.fields(fx.codes(s, d), ["compact"], gs1.compact(F.col("compact"))), ctes(
    f"SELECT compact, ai_code, {_NAMED}, value, CASE WHEN ai_code='11' THEN {_DATE.format('value')} END AS formatted, true AS present FROM (SELECT compact, unnest(['240','11','77']) AS ai_code, "
    "unnest([substr(compact,7,14), substr(compact,24,6), substr(split_part(compact,chr(29),3),3)]) AS value FROM fx_codes)"))  # fmt: skip
add("gs1_detect", lambda s, d: gs1.fields(fx.codes(s, d).selectExpr("case l_orderkey%2 when 0 then url else gs1 end raw"), ["raw"], gs1.detected(F.col("raw"))), ctes(
    "SELECT raw, ai_code, " + _NAMED + ", value, CASE WHEN ai_code='11' THEN " + _DATE.format("value") + " END AS formatted, true AS present FROM (SELECT url AS raw, unnest(['240','11']) AS ai_code, "
    "unnest([split_part(split_part(url,'/240/',2),'?',1), split_part(split_part(url,'?11=',2),'&',1)]) AS value FROM fx_codes WHERE l_orderkey%2=0 UNION ALL SELECT gs1, ai_code, value FROM paren WHERE l_orderkey%2<>0)", _PAREN))  # fmt: skip
add("itf_article", lambda s, d: fx.codes(s, d).select("itf", fields.itf_article(F.col("itf")).alias("a")).select("itf", "a.*").distinct(), ctes(
    "SELECT DISTINCT itf, concat(substr(itf,1,3),'.',substr(itf,4,3),'.',substr(itf,7,2)) AS article_number, substr(itf,9,5) AS article_code FROM fx_codes"))
add("check_digit", lambda s, d: fx.codes(s, d).select("itf", fields.check_digit_ok(F.col("itf")).alias("ok")).distinct(), ctes(
    "SELECT DISTINCT itf, (10 - (" + "+".join(f"substr(itf,{k},1)::INT*{3 if k % 2 else 1}" for k in range(1, 14)) + ")%10)%10 = substr(itf,14,1)::INT AS ok FROM fx_codes"))

# every kind of identifier: fixed and open lengths, numbers with letters behind, dates, unknown ones
_EVERY = "concat('(',ai,')',raw)"
_AIS = "SELECT p_partkey, ai, raw FROM (SELECT p_partkey, unnest([" + ",".join(f"'{a}'" for a, _, _ in gs1.AI_SPECS) + ",'55','9999']) AS ai FROM part), LATERAL (SELECT CASE p_partkey%4 WHEN 0 THEN concat(lpad(p_partkey::VARCHAR,20,'7'),'x') WHEN 1 THEN concat(' 2401',lpad((p_partkey%100)::VARCHAR,2,'0'),' ') WHEN 2 THEN concat('AB',p_partkey::VARCHAR) ELSE concat('12x',p_partkey::VARCHAR) END AS raw)"
_LENGTH = "CASE ai " + " ".join(f"WHEN '{a}' THEN {n}" for a, _, n in gs1.AI_SPECS if n) + " ELSE 1000 END"
_NAME = "CASE ai " + " ".join(f"WHEN '{a}' THEN '{name}'" for a, name, _ in gs1.AI_SPECS) + " ELSE concat('ai_',ai) END"
_NUMBERS = ",".join(f"'{a}'" for a in gs1.NUMERIC)
_raw = "case p_partkey%4 when 0 then concat(lpad(cast(p_partkey as string),20,'7'),'x') when 1 then concat(' 2401',lpad(cast(p_partkey%100 as string),2,'0'),' ') when 2 then concat('AB',cast(p_partkey as string)) else concat('12x',cast(p_partkey as string)) end raw"
_ai_rows = lambda s, d: fx._view(s, d, "part", "p_partkey", _raw, "explode(array(" + ",".join(f"'{a}'" for a, _, _ in gs1.AI_SPECS) + ",'55','9999')) ai")
add("ai_clean", lambda s, d: _ai_rows(s, d).select("p_partkey", gs1.field(F.col("ai"), F.col("raw")).alias("f")).select("p_partkey", "f.*"), "WITH a AS (" + _AIS + f"), c AS (SELECT p_partkey, ai, {_NAME} AS name, left(CASE WHEN ai IN ({_NUMBERS}) AND regexp_matches(trim(raw),'^\\d') "
    f"THEN regexp_extract(trim(raw),'^(\\d+)',1) ELSE trim(raw) END, {_LENGTH}) AS value FROM a) SELECT p_partkey, ai AS ai_code, name, value, CASE WHEN name LIKE '%_date' AND regexp_full_match(value,'\\d{{6}}') THEN {_DATE.format('value')} END AS formatted, value<>'' AS present FROM c")  # fmt: skip
_both = lambda s, d: fx.tag_codes(s, d).where("matrix like '(%'").select("label_id", gs1.merged(gs1.parenthesised(F.concat(F.lit("(10)L(13)"), F.col("label_id").cast("string"))), gs1.parenthesised(F.col("matrix"))).alias("m"))
add("ai_merge", lambda s, d: _both(s, d).select("label_id", F.inline("m")).withColumnRenamed("ai", "ai_code"), ctes("SELECT label_id, unnest(['10','240','13']) AS ai_code, unnest(['L','0299999710973','260402']) AS raw FROM fx_tagcodes WHERE matrix LIKE '(%'"))
_tries = lambda s, d: fx.boxes(s, d).selectExpr("label_id", "seq try", "element_at(array('I25','ITF','EAN13','EAN-13','DataMatrix','QRCODE','CODE-ITF'), cast(seq%7+1 as int)) symbol", "concat('r',seq,'/',x,'/',y,'/',w,'/',h) raw").groupBy("label_id", "try", "symbol").agg(F.min("raw").alias("raw"))
add("barcode_slots", lambda s, d: passes.first_codes(_tries(s, d)), ctes(
    "SELECT label_id, slot, try, symbol, raw FROM (SELECT *, row_number() OVER (PARTITION BY label_id, slot ORDER BY try, symbol) AS k FROM (SELECT label_id, seq AS try, ['I25','ITF','EAN13','EAN-13','DataMatrix','QRCODE','CODE-ITF'][seq%7+1] AS symbol, min(concat('r',seq,'/',x,'/',y,'/',w,'/',h)) AS raw, "
    "CASE WHEN seq%7 IN (0,1,6) THEN 'itf14' WHEN seq%7 IN (2,3) THEN 'ean13' WHEN seq%7=4 THEN 'datamatrix' END AS slot FROM fx_boxes GROUP BY ALL) WHERE slot IS NOT NULL) WHERE k=1"))  # fmt: skip
