"""Label-shaped views over the driver's tables, in Spark and as CTEs for the SQL oracle; both give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _view(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "documents", "doc_id label_id", "2400+(doc_id%5)*500 img_w", "case doc_id%4 when 0 then 600 when 1 then 2400+(doc_id%5)*500 when 2 then 7000 else 1800 end img_h")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _view(spark, sf_dir, "documents", "doc_id label_id", "posexplode(split(text,' ')) as (word_idx,text)")
    return tokens.where("text<>''").selectExpr(
        "label_id", "cast(word_idx as bigint) word_idx", "text", "40+(word_idx%10)*220+(label_id%7)*3 x", "cast(30+(word_idx div 10)*45+(word_idx*7)%5 as bigint) y",
        "cast(20+8*length(text) as bigint) w", "12+(label_id+word_idx)%9 h", "cast((label_id*31+word_idx*17)%101 as double)/100D conf",
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected regions: 20 a page on average, with colours."""
    return repeated_boxes(spark, sf_dir).distinct()


def repeated_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boxes, of which equal ones may be there more than once."""
    return _view(
        spark, sf_dir, "lineitem", "l_orderkey%5000 label_id", "l_partkey*10+l_linenumber seq", "cast((l_partkey*37)%3000 as bigint) x", "cast((l_suppkey*53+l_linenumber*11)%900 as bigint) y",
        "cast(10+l_partkey%290 as bigint) w", "cast(10+l_suppkey%190 as bigint) h", "cast((l_partkey*7)%256 as bigint) b", "cast((l_suppkey*11)%256 as bigint) g", "cast((l_orderkey*13)%256 as bigint) r",
    )


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(
        spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber",
        "concat('(240)',lpad(cast(l_partkey as string),14,'0'),'(11)',date_format(l_shipdate,'yyMMdd'),case when l_orderkey%3=0 then concat('(10)L',cast(l_suppkey as string)) else '' end) gs1",
        "concat(']d2240',lpad(cast(l_partkey as string),14,'0'),char(29),'11',date_format(l_shipdate,'yyMMdd'),'99',char(29),'77X',cast(l_suppkey as string)) compact",
        "concat('https://id.ikea.com/240/',lpad(cast(l_partkey as string),14,'0'),'?11=',date_format(l_shipdate,'yyMMdd'),'&11=000000') url",
        "concat(lpad(cast(l_partkey as string),8,'0'),lpad(cast(l_suppkey as string),5,'0'),'0') itf",
    )


def zone_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "part", *_ZONE_TEXT)


_ZONE_TEXT = (
    "p_partkey label_id",
    "concat(upper(split_part(p_name,' ',1)),' ',upper(split_part(p_name,' ',2)),' ',cast(10+p_size as varchar(20)),'x',cast(20+p_size as varchar(20)),' cm Gross ',cast(1+p_size%9 as varchar(20)),' kg') identity_text",
    "concat('803.',substr(lpad(cast(p_partkey as varchar(20)),6,'0'),1,3),'.',substr(lpad(cast(p_partkey as varchar(20)),6,'0'),5,2)) barcode_text",
    "case p_partkey%6 when 0 then 'Made in China' when 1 then 'Assembled in People''s Republic of China' when 2 then 'Made in Vietnam' when 3 then 'Made in Poland' when 4 then 'Made in Indiana' else 'no origin' end address_text",
    "concat_ws(' ',case when p_partkey%2=0 then 'CE' end,case when p_partkey%3=0 then 'TSCA' end,case when p_partkey%5=0 then 'rohs' end,case when p_partkey%7=0 then '12 M+' end) compliance_text",
    "case p_partkey%4 when 0 then concat('DATE: ',cast(2401+p_partkey%52 as varchar(20))) when 1 then concat('ATE ',cast(2401+p_partkey%52 as varchar(20)),' 898') when 2 then concat(cast(2401+p_partkey%52 as varchar(20)),' qwed 898') else 'nodate' end date_text",
)

_FIELD_ROWS = (
    ("article_number", "case when p_partkey%11=0 then null when p_partkey%7=0 then concat('A',cast(p_partkey as varchar(20))) else concat('000.',substr(lpad(cast(p_partkey as varchar(20)),5,'0'),1,3),'.',substr(lpad(cast(p_partkey as varchar(20)),5,'0'),4,2)) end"),
    ("product_name", "case when p_partkey%13=0 then '  ' else upper(p_brand) end"),
    ("date_stamp", "case when p_partkey%3=0 then null else cast(2401+p_partkey%52 as varchar(20)) end"),
    ("ai_13", "case when p_partkey%4=0 then '24-01-05' end"),
    ("ai_240", "case when p_partkey%8=0 then concat('0000',substr(lpad(cast(p_partkey as varchar(20)),5,'0'),1,5),'11') when p_partkey%8=1 then '0299' end"),
    ("human_readable_date", "case when p_partkey%8=0 then '24-01-05' when p_partkey%8=4 then '24-01-06' end"),
    ("origin_text", "case when p_partkey%5=0 then 'Made in Poland' when p_partkey%5=1 then 'made in poland' when p_partkey%15=2 then 'MADE in Straße' when p_partkey%15=7 then 'made in strasse' end"),
    ("gross_weight", "case when p_size%2=0 then concat(cast(p_size as varchar(20)),' kg') end"),
    ("age_rating", "case when p_partkey%9=0 then '12M+' end"),
    ("package_number", "case when p_partkey%6=0 then '43' end"),
    ("plant_identifier", "case when p_partkey%10=3 then 'PI-200948-2' end"),
    ("datamatrix_barcode", "case when p_partkey%6=0 then '(240)1(13)240105' when p_partkey%2=0 then '(240)1' end"),
    ("itf14_barcode", "case when p_partkey%3<>1 then '12345678901234' end"),
    ("itf14_human_readable", "case when p_partkey%3=0 then '123.456.78' when p_partkey%3=2 then '999.456.78' end"),
    ("weight", "case when p_partkey%4=1 then '2 kg' end"),
)
_CODES_OF = "('datamatrix_barcode','itf14_barcode','ean_barcode')"


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label_id, field_id, value, confidence: one row for each field; null where it was not found."""
    stack = ",".join(f"'{f}',{v}" for f, v in _FIELD_ROWS)
    return _view(spark, sf_dir, "part", "p_partkey label_id", "cast(p_size%50 as double)/50D confidence", f"stack({len(_FIELD_ROWS)},{stack}) as (field_id,value)").select("label_id", "field_id", "value", "confidence")


def full_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fields with raw_text, zone, source, pattern_match, bbox and symbology; some boxes have no size, some are outside."""
    has_box = "value is not null and length(field_id)%3<>0"
    return fields(spark, sf_dir).selectExpr(
        "label_id", "field_id", "value", "concat('raw ',value) raw_text", "confidence", "case when length(field_id)%2=0 then 'left_identity' else 'center_barcode' end zone",
        f"case when field_id in {_CODES_OF} then 'barcode' else 'ocr' end source", f"case when field_id not in {_CODES_OF} then label_id%2=0 end pattern_match",
        f"case when {has_box} then struct(label_id*3%4000 x, label_id*7%900 y, label_id%5*20 w, cast(length(field_id) as bigint) h) end bbox",
        f"case when field_id in {_CODES_OF} then 'I25' end symbology",
    )


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label_id, field_id, value (null: nothing to do; empty: cleared), bbox (null: none drawn). `other` is no field that is known."""
    return _view(
        spark, sf_dir, "labels", "doc_id label_id", "case doc_id%6 when 0 then 'article_number' when 1 then 'itf14_barcode' when 2 then 'copy_count' when 3 then 'origin_text' when 4 then 'ean_barcode' else 'other' end field_id",
        "case when doc_id%10=0 then null when doc_id%10=1 then '' else concat('C',cast(doc_id as string),'  ') end value",
        "case when doc_id%4<>0 then struct(doc_id%3000 x, doc_id%700 y, doc_id%7*10 w, doc_id%5 h) end bbox",
    ).selectExpr("label_id", "field_id", "value", "bbox")


TAG_ZONES = ("left_identity", "center_barcode", "center_datamatrix", "center_address", "right_compliance", "right_date", "right_copy_count")
_TAGS = (  # zone, line, text of the words on a label
    (0, 0, "case p_partkey%9 when 0 then 'MADE' when 1 then concat(upper(split_part(p_name,' ',1)),' ',upper(split_part(p_name,' ',2))) else upper(split_part(p_name,' ',1)) end"),
    (0, 0, "case when p_partkey%7=0 then upper(concat(split_part(p_name,' ',1),split_part(p_name,' ',2))) when p_partkey%7=1 then 'x1' else concat(upper(split_part(p_name,' ',2)),',') end"),
    (0, 0, "case when p_partkey%4=0 then 'pcs' when p_partkey%4=1 then upper(split_part(p_name,' ',1)) when p_partkey%4=2 then 'IKEA' end"),
    (0, 1, "case p_partkey%5 when 0 then '20x30x10 cm' when 1 then '20x30' when 2 then '75 cm' when 3 then '45' else '7/8x9\"' end"),
    (0, 1, "case when p_partkey%5=1 then 'cm' when p_partkey%3=0 then '12′ 4″' end"),
    (0, 2, "case p_partkey%6 when 0 then 'Gross 5 kg' when 1 then 'Gross' when 2 then 'Gross weight (11 lbs)' when 3 then '4.5 kg (10 lbs)' when 4 then '9 lbs' end"),
    (0, 2, "case when p_partkey%6=1 then cast(1+p_partkey%8 as varchar(20)) when p_partkey%12=0 then 'gross 6 k' end"),
    (0, 2, "case when p_partkey%6=1 then 'kg' end"),
    (0, 3, "case p_partkey%4 when 0 then 'Net 3 kg' when 1 then 'Net' when 2 then 'net weight (6 lbs)' end"),
    (0, 3, "case when p_partkey%4=1 then '2 k' end"),
    (0, 4, "case when p_partkey%3=0 then 'X 4' when p_partkey%3=1 then 'x 12' end"),
    (0, 4, "case p_partkey%5 when 0 then 'Not RTS Regular' when 1 then 'RTS Box' when 2 then 'Special' end"),
    (0, 4, "cast(10+p_partkey%990 as varchar(20))"),
    (0, 5, "case p_partkey%4 when 0 then '1(2)' when 1 then 'l (3)' when 2 then '|(4)' end"),
    (0, 5, "case p_partkey%3 when 0 then 'IKEA' when 1 then 'Design and Quality' end"),
    (1, 0, "case p_partkey%3 when 0 then concat('803.',substr(lpad(cast(p_partkey as varchar(20)),6,'0'),1,3),'.64') when 1 then '803' end"),
    (1, 0, "case when p_partkey%3=1 then '804' end"),
    (1, 0, "case when p_partkey%3=1 then '64' end"),
    (1, 1, "cast(10000+p_partkey*7%90000 as varchar(20))"),
    (1, 1, "'22714'"),
    (2, 0, "case p_partkey%4 when 0 then 'AI (240)0299999' when 1 then '(240)0299999(10)L7' end"),
    (2, 0, "case when p_partkey%5=0 then '(13)240105' when p_partkey%5=1 then '(11)240302x' end"),
    (2, 1, "case p_partkey%3 when 0 then '24-06-19 (YY-MM-DD)' when 1 then '24.06.19' end"),
    (2, 1, "case when p_partkey%3=1 then '(YYMMDD)' end"),
    (2, 2, "case p_partkey%4 when 0 then 'PI-200948-2' when 1 then 'P1 : 2009 482' end"),
    (3, 0, "case p_partkey%4 when 0 then '© Inter IKEA Systems B.V. 2019' when 1 then '12 IKEA of Sweden AB' when 2 then 'Inter IKEA' end"),
    (3, 1, "case p_partkey%3 when 0 then 'IKEA of Sweden AB' when 1 then 'PI-7777-1' end"),
    (3, 2, "case when p_partkey%3<>1 then 'SE - 34381 Almhult' end"),
    (3, 3, "case p_partkey%6 when 0 then 'Made in China' when 1 then 'Assembled in Vietnam' when 2 then 'Made in Poland' when 3 then 'design by B.V. 2021' else 'B.V.' end"),
    (3, 4, "case when p_partkey%5=0 then 'IKEA.com' else 'www' end"),
    (4, 0, "case when p_partkey%2=0 then 'CE' else 'none' end"),
    (4, 0, "case when p_partkey%3=0 then 'TSCA' end"),
    (4, 1, "case when p_partkey%4=0 then '12 M+' else 'rohs' end"),
    (5, 0, "case p_partkey%4 when 0 then concat('DATE: ',cast(2401+p_partkey%52 as varchar(20))) when 1 then concat('ATE ',cast(2401+p_partkey%52 as varchar(20))) when 2 then cast(2401+p_partkey%52 as varchar(20)) else 'nodate' end"),
    (5, 1, "case when p_partkey%3=0 then 'qwed 898' else 'QWED' end"),
    (5, 1, "case when p_partkey%3=1 then '898' end"),
    (5, 2, "case when p_partkey%5=0 then 'abcd-2415-x99' end"),
    (6, 0, "case p_partkey%3 when 0 then '2' when 1 then 'lI' end"),
    (6, 1, "case when p_partkey%5=0 then '17 of 20' end"),
)


def _tag_columns() -> list[tuple[int, int, int, str]]:
    """zone, line, x, text of each word."""
    out, places = [], {}
    for zone, line, text in _TAGS:
        k = places[zone, line] = places.get((zone, line), -1) + 1
        out.append((zone, line, zone * 600 + 40 + 130 * k, text))
    return out


_TAG_REST = (
    "label_id", "k word_idx", "text", "x", "20+40*line+(label_id+k)%5 y", "cast(10*length(text) as bigint) w", "18+(label_id+k)%5 h", "cast(20+(label_id*31+k*17)%81 as double)/100 conf",
    "case when label_id%10=0 then 'circle_mid' else zone end zone",
)


def tags(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Words of printed labels by zone, a tenth of the labels without zones that the extractors know.

    together: a label's words lie in one partition by label_id. Labels are dealt out before they become words, so what needs
    a label's words in one place shuffles none, and a small file of many labels makes many tasks.
    """
    stack = ",".join(f"{k}L,'{TAG_ZONES[z]}',{line}L,{x}L,{text}" for k, (z, line, x, text) in enumerate(_tag_columns()))
    parts = _view(spark, sf_dir, "part", "p_partkey", "p_name")
    if together:
        parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    rows = parts.selectExpr("p_partkey label_id", f"stack({len(_TAGS)},{stack}) as (k,zone,line,x,text)")
    return rows.where("text is not null").selectExpr(*_TAG_REST)


_TAG_CODES = (
    "p_partkey label_id", "case when p_partkey%4<>3 then concat('12345678',lpad(cast(p_partkey as varchar(20)),5,'0'),'0') when p_partkey%8=3 then '1234567' end itf",
    "case when p_partkey%5=0 then '4006381333931' end ean", "case p_partkey%3 when 0 then '(240)0299999710973(13)260402' when 1 then 'https://www.ikea.com/240/0299999710973?13=260402&10=AB%2F1&10=C' end matrix",
)


def tag_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "part", *_TAG_CODES)


SCHEMAS = (  # label_type_id, order, name, has_itf, has_ean, has_dmv
    ("A1", 0, "plain", True, False, False),
    ("A2", 1, "matrix", True, False, True),
    ("B1", 2, "dated", False, False, False),
    ("B2", 3, "dated twin", False, False, False),
    ("C1", 4, "full", True, True, True),
    ("D1", 5, "bare", False, False, False),
    ("E1", 6, "without rules", False, False, False),
)
SCHEMA_FIELDS = (  # label_type_id, field, tenths of weight
    ("A1", "article_number", 10), ("A1", "product_name", 10), ("A1", "weight_compact", 4),
    ("A2", "article_number", 10), ("A2", "ai_13", 4), ("A2", "origin_text", 4),
    ("B1", "date_stamp_yyww", 10), ("B1", "origin_text", 4), ("B2", "date_stamp", 10), ("B2", "origin_text", 4),
    ("C1", "article_number", 10), ("C1", "product_name", 10), ("C1", "date_stamp", 10), ("C1", "ai_13", 10), ("C1", "ca_code", 4),
    ("E1", "plant_identifier", 10), ("E1", "gross_weight", 4),
)
FIELD_ALIAS = (("date_stamp_yyww", "date_stamp"), ("weight_compact", "gross_weight"), ("legal_symbols", "compliance_marks"), ("dimensions_metric", "product_dimensions_metric"))
RULES = (  # label_type_id, order, rule_id, field, check, severity, pattern, value, ai, pattern_valid
    ("A1", 0, "A1-1", "article_number", "regex_match", "error", r"\d{3}\.\d{3}\.\d{2}", None, None, True),
    ("A1", 1, "A1-2", "product_name", "present", "error", None, None, None, True),
    ("A1", 2, "A1-3", "weight_compact", "regex_match", "warning", r"\d+ kg", None, None, True),
    ("A1", 3, "A1-4", "article_number", "one_of", "error", None, None, None, True),
    ("A2", 0, "A2-1", "datamatrix", "ai_field_present", "error", None, None, "13", True),
    ("A2", 1, "A2-2", "origin_text", "exact_match", "warning", None, "Made in Poland", None, True),
    ("A2", 2, "A2-3", "datamatrix", "ai_field_present", "error", None, None, "37", True),
    ("B1", 0, "B1-1", "date_stamp_yyww", "regex_match", "error", r"\d{4}", None, None, True),
    ("B1", 1, "B1-2", "date_stamp", "regex_match", "error", "(", None, None, False),
    ("B1", 2, "B1-3", "date_stamp", "range_mm", "info", None, None, None, True),
    ("B2", 0, "B2-1", "date_stamp", "present", "odd", None, None, None, True),
    ("C1", 0, "C1-1", "product_name", "present", "error", None, None, None, True),
    ("C1", 1, "C1-2", "origin_text", "exact_match", "info", None, "Made in Poland", None, True),
    ("B2", 1, "B2-2", "origin_text", "exact_match", "warning", None, "Made in Strasse", None, True),
    ("A1", 4, "A1-5", "origin_text", "exact_match", "error", None, "MADE IN STRASSE", None, True),
)


def dim(spark: SparkSession, rows: tuple, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def schemas(spark: SparkSession) -> DataFrame:
    return dim(spark, SCHEMAS, "label_type_id string, schema_ord int, name string, has_itf boolean, has_ean boolean, has_dmv boolean")


def schema_fields(spark: SparkSession) -> DataFrame:
    return dim(spark, SCHEMA_FIELDS, "label_type_id string, field string, tenths int")


def aliases(spark: SparkSession) -> DataFrame:
    return dim(spark, FIELD_ALIAS, "field string, field_id string")


def rules(spark: SparkSession) -> DataFrame:
    return dim(spark, RULES, "label_type_id string, rule_ord int, rule_id string, field string, check string, severity string, pattern string, value string, ai string, pattern_valid boolean")


def _values(rows: tuple, columns: str) -> str:
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns})"


SQL = {
    "fx_labels": "SELECT doc_id AS label_id, 2400+(doc_id%5)*500 AS img_w, CASE doc_id%4 WHEN 0 THEN 600 WHEN 1 THEN 2400+(doc_id%5)*500 WHEN 2 THEN 7000 ELSE 1800 END AS img_h FROM documents",
    "fx_words": "SELECT label_id, word_idx, text, 40+(word_idx%10)*220+(label_id%7)*3 AS x, 30+(word_idx//10)*45+(word_idx*7)%5 AS y, CAST(20+8*length(text) AS BIGINT) AS w, "
    "12+(label_id+word_idx)%9 AS h, ((label_id*31+word_idx*17)%101)::DOUBLE/100 AS conf FROM (SELECT doc_id AS label_id, unnest(string_split(text,' ')) AS text, "
    "unnest(range(len(string_split(text,' ')))) AS word_idx FROM documents) WHERE text<>''",
    "fx_boxes": "SELECT DISTINCT l_orderkey%5000 AS label_id, l_partkey*10+l_linenumber AS seq, (l_partkey*37)%3000 AS x, (l_suppkey*53+l_linenumber*11)%900 AS y, 10+l_partkey%290 AS w, "
    "10+l_suppkey%190 AS h, (l_partkey*7)%256 AS b, (l_suppkey*11)%256 AS g, (l_orderkey*13)%256 AS r FROM lineitem",
    "fx_codes": "SELECT l_orderkey, l_linenumber, concat('(240)',lpad(l_partkey::VARCHAR,14,'0'),'(11)',strftime(l_shipdate,'%y%m%d'),CASE WHEN l_orderkey%3=0 THEN concat('(10)L',l_suppkey::VARCHAR) ELSE '' END) AS gs1, "
    "concat(']d2240',lpad(l_partkey::VARCHAR,14,'0'),chr(29),'11',strftime(l_shipdate,'%y%m%d'),'99',chr(29),'77X',l_suppkey::VARCHAR) AS compact, "
    "concat('https://id.ikea.com/240/',lpad(l_partkey::VARCHAR,14,'0'),'?11=',strftime(l_shipdate,'%y%m%d'),'&11=000000') AS url, concat(lpad(l_partkey::VARCHAR,8,'0'),lpad(l_suppkey::VARCHAR,5,'0'),'0') AS itf FROM lineitem",
    "fx_zone_texts": "SELECT " + ", ".join(_ZONE_TEXT) + " FROM part",
    "fx_fields": " UNION ALL ".join(f"SELECT p_partkey AS label_id, '{f}' AS field_id, {v} AS value, (p_size%50)::DOUBLE/50 AS confidence FROM part" for f, v in _FIELD_ROWS),
    "fx_corrections": "SELECT doc_id AS label_id, CASE doc_id%6 WHEN 0 THEN 'article_number' WHEN 1 THEN 'itf14_barcode' WHEN 2 THEN 'copy_count' WHEN 3 THEN 'origin_text' WHEN 4 THEN 'ean_barcode' ELSE 'other' END AS field_id, "
    "CASE WHEN doc_id%10=0 THEN NULL WHEN doc_id%10=1 THEN '' ELSE concat('C',doc_id::VARCHAR,'  ') END AS value, CASE WHEN doc_id%4<>0 THEN doc_id%3000 END AS kx, CASE WHEN doc_id%4<>0 THEN doc_id%700 END AS ky, "
    "CASE WHEN doc_id%4<>0 THEN doc_id%7*10 END AS kw, CASE WHEN doc_id%4<>0 THEN doc_id%5 END AS kh FROM labels",
    "fx_full": f"SELECT *, 'raw '||value AS raw_text, CASE WHEN length(field_id)%2=0 THEN 'left_identity' ELSE 'center_barcode' END AS zone, CASE WHEN field_id IN {_CODES_OF} THEN 'barcode' ELSE 'ocr' END AS source, "
    f"CASE WHEN field_id NOT IN {_CODES_OF} THEN label_id%2=0 END AS pattern_match, CASE WHEN value IS NOT NULL AND length(field_id)%3<>0 THEN label_id*3%4000 END AS x, CASE WHEN value IS NOT NULL AND length(field_id)%3<>0 THEN label_id*7%900 END AS y, "
    f"CASE WHEN value IS NOT NULL AND length(field_id)%3<>0 THEN label_id%5*20 END AS w, CASE WHEN value IS NOT NULL AND length(field_id)%3<>0 THEN length(field_id) END AS h, CASE WHEN field_id IN {_CODES_OF} THEN 'I25' END AS symbology FROM fx_fields",
    "fx_tags": "SELECT " + ", ".join(c.replace("as double)/100 conf", "as double)/100 AS conf") for c in _TAG_REST) + " FROM ("
    + " UNION ALL ".join(f"SELECT p_partkey AS label_id, {k}::BIGINT AS k, '{TAG_ZONES[z]}' AS zone, {line}::BIGINT AS line, {x}::BIGINT AS x, {text} AS text FROM part" for k, (z, line, x, text) in enumerate(_tag_columns())) + ") WHERE text IS NOT NULL",
    "fx_tagcodes": "SELECT " + ", ".join(_TAG_CODES) + " FROM part",
    "fx_schemas": _values(SCHEMAS, "label_type_id, schema_ord, name, has_itf, has_ean, has_dmv"),
    "fx_schema_fields": _values(SCHEMA_FIELDS, "label_type_id, field, tenths"),
    "fx_alias": _values(FIELD_ALIAS, "field, field_id"),
    "fx_rules": _values(RULES, 'label_type_id, rule_ord, rule_id, field, "check", severity, pattern, value, ai, pattern_valid'),
}


def ctes(body: str, *more: tuple[str, str]) -> str:
    """body with the CTEs that it, or a further CTE, names."""
    text, own = body + " ".join(x for _, x in more), []
    for _ in SQL:
        own = [(k, v) for k, v in SQL.items() if k in text]
        text = " ".join([body, *(x for _, x in more), *(v for _, v in own)])
    return ("WITH " + ", ".join(f"{k} AS ({v})" for k, v in [*own, *more]) + " " if own or more else "") + body
