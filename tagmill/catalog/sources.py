"""Queries over files, passes and label records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill import fixtures as fx
from tagmill import sources
from tagmill.catalog.registry import add
from tagmill.fixtures import ctes
from tagmill.operators import fields, passes, records

add("file_hash", lambda s, d: fx._view(s, d, "pages", "page_id", "encode(html,'UTF-8') content").select("page_id", fields.file_hash(F.col("content"), F.lit(600)).alias("file_hash")), "SELECT page_id, substr(sha256(concat(html,'600')),1,16) AS file_hash FROM pages")
add("sniff", lambda s, d: fx._view(s, d, "part", "p_partkey", "unhex(case p_partkey%6 when 0 then '255044462D' when 1 then 'FFD8FFE0' when 2 then '89504E470D' when 3 then '49492A00' when 4 then '424D00' else '00' end) head").select("p_partkey", fields.sniffed(F.col("head")).alias("suffix")),
     "SELECT p_partkey, CASE p_partkey%6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.jpg' WHEN 2 THEN '.png' WHEN 3 THEN '.tif' WHEN 4 THEN '.bmp' END AS suffix FROM part")
_suffix = "element_at(array('.pdf','.PNG','.jpeg','.gif','.tif','.txt','.BMP'), cast(p_partkey%7+1 as int)) suffix"
add("file_kind", lambda s, d: fx._view(s, d, "part", "p_partkey", _suffix).select("p_partkey", passes.kind(F.col("suffix")).alias("kind")), "SELECT p_partkey, CASE p_partkey%7 WHEN 0 THEN 'first_page' WHEN 3 THEN NULL WHEN 5 THEN NULL ELSE 'picture' END AS kind FROM part")
add("upload_plan", lambda s, d: fx._view(s, d, "part", "p_partkey", "unhex(case p_partkey%5 when 0 then '255044462D31' when 1 then 'FFD8FFE0' when 2 then '0001' when 3 then '' when 4 then '424D00' end) head").select("p_partkey", passes.upload(F.col("head"), fields.sniffed(F.col("head"))).alias("u")).select("p_partkey", "u.*"),
    "SELECT p_partkey, CASE p_partkey%5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.jpg' WHEN 2 THEN '.png' WHEN 4 THEN '.bmp' END AS suffix, p_partkey%5=2 AS encode, CASE WHEN p_partkey%5=3 THEN 'empty' END AS error FROM part")

# passes
_rects = lambda s, d: fx.boxes(s, d).selectExpr("label_id", "seq", "x", "y", "case when seq%7=0 then '  ' else concat(' t',seq,' ') end text", "x/7D x0", "y/3D y0", "x/7D+w/500D x1", "y/3D+h/9D y1", "w/7D size", "cast(seq%32 as int) flags")
_RECTS = ("rects", "SELECT label_id, seq, x, y, CASE WHEN seq%7=0 THEN '  ' ELSE concat(' t',seq,' ') END AS text, x/7::DOUBLE AS x0, y/3::DOUBLE AS y0, x/7::DOUBLE+w/500::DOUBLE AS x1, y/3::DOUBLE+h/9::DOUBLE AS y1, w/7::DOUBLE AS size, seq%32 AS flags FROM fx_boxes")
_PX = "trunc(x0*(300/72::DOUBLE))::BIGINT AS x, trunc(y0*(300/72::DOUBLE))::BIGINT AS y, greatest(1,trunc((x1-x0)*(300/72::DOUBLE))::BIGINT) AS w, greatest(1,trunc((y1-y0)*(300/72::DOUBLE))::BIGINT) AS h"
add("text_spans", lambda s, d: passes.text_spans(_rects(s, d).drop("x", "y"), 300), ctes(f"SELECT label_id, seq, 'text_pdf' AS type, trim(text) AS content, {_PX}, 1::DOUBLE AS confidence, round(size,2) AS font_size, (flags&16)<>0 AS bold, (flags&2)<>0 AS italic FROM (SELECT * EXCLUDE (x,y) FROM rects) WHERE trim(text)<>''", _RECTS))
_images = lambda s, d: _rects(s, d).selectExpr("label_id", "seq%5 xref", "concat(lpad(cast(seq as string),9,'0'),'/',x,'/',y,'/',x0,'/',y1) rect_ord", "x0", "y0", "x1", "y1").groupBy("label_id", "xref", "rect_ord").agg(*(F.min(c).alias(c) for c in ("x0", "y0", "x1", "y1")))
add("embedded_images", lambda s, d: passes.images(fx.boxes(s, d).selectExpr("label_id", "seq%5 xref", "seq*1000000000+x*100000+y rect_ord", "x/7D x0", "y/3D y0", "x/7D+w/500D x1", "y/3D+h/9D y1"), 300), ctes(
    f"SELECT label_id, xref, 'image_pdf' AS type, {_PX}, 1::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY label_id, xref ORDER BY rect_ord, x0, y0, x1, y1) AS k FROM (SELECT label_id, seq%5 AS xref, seq*1000000000+x*100000+y AS rect_ord, x0, y0, x1, y1 FROM rects)) WHERE k=1", _RECTS))
_part = lambda s, d, k: fx.boxes(s, d).where(f"seq%3={k}").groupBy("label_id", "seq").agg(F.min("x").alias("x"), F.min("y").alias("y"))
add("merged_passes", lambda s, d: passes.merged_elements(*(_part(s, d, k) for k in range(3))), ctes(
    "SELECT label_id, seq, x, y, (seq%3)::INT AS pass, row_number() OVER (PARTITION BY label_id ORDER BY y//10, x, seq%3, seq) AS place FROM (SELECT label_id, seq, min(x) AS x, min(y) AS y FROM fx_boxes GROUP BY ALL)"))
_pixel = "(x*7+y*13+c*29+p_partkey*31)%256"
_image = "unhex(array_join(transform(sequence(0,12*10*3-1), i -> lpad(hex(((int(i/3)%12)*7+int(i/36)*13+(i%3)*29+p_partkey*31)%256),2,'0')),'')) pixels"
_SEEN = "p_partkey%9-2 AS kx, p_partkey%7-1 AS ky, 1+p_partkey%8 AS kw, 1+p_partkey%5 AS kh"
add("region_colours", lambda s, d: fx._view(s, d, "part", "p_partkey", _image, *(x.replace(" AS ", " ") for x in _SEEN.split(", "))).select("p_partkey", passes.mean_colour(F.col("pixels"), F.lit(12), *(F.col(c) for c in ("kx", "ky", "kw", "kh"))).alias("m")).select("p_partkey", *(F.round(f"m.{c}", 6).alias(c) for c in "bgr")),
    f"SELECT p.p_partkey, round(avg({_pixel}) FILTER (c=0 AND inside),6) AS b, round(avg({_pixel}) FILTER (c=1 AND inside),6) AS g, round(avg({_pixel}) FILTER (c=2 AND inside),6) AS r FROM (SELECT *, x>=kx AND x<kx+kw AND y>=ky AND y<ky+kh AS inside FROM (SELECT p_partkey, {_SEEN} FROM part), (SELECT unnest(range(12)) AS x), (SELECT unnest(range(10)) AS y), (SELECT unnest(range(3)) AS c)) p GROUP BY p.p_partkey")
_grey = "unhex(array_join(transform(sequence(0,12*10-1), i -> lpad(hex(((i%12)*7+int(i/12)*13+p_partkey*31)%256),2,'0')),'')) grey"
add("dark_shares", lambda s, d: fx._view(s, d, "part", "p_partkey", _grey).select("p_partkey", passes.dark_shares(F.col("grey"), F.lit(12)).alias("m")).select("p_partkey", *(F.round(f"m.{c}", 9).alias(f"{c}_share") for c in ("whole", "left", "right"))),
    "SELECT p_partkey, round(avg(dark),9) AS whole_share, round(avg(dark) FILTER (x<6),9) AS left_share, round(avg(dark) FILTER (x>=6),9) AS right_share FROM (SELECT p_partkey, x, ((x*7+y*13+p_partkey*31)%256<128)::INT AS dark FROM part, (SELECT unnest(range(12)) AS x), (SELECT unnest(range(10)) AS y)) GROUP BY p_partkey")

# specification files: whether they parse
_value = "case p_partkey%4 when 0 then concat('{\"template_id\":\"T',p_partkey,'\"}') when 1 then concat('{\"template_id\":',p_partkey) when 2 then '[1]' else concat(' {\"a\":{\"b\":[',p_partkey,']}}') end"
add("spec_files", lambda s, d: sources.specs(fx._view(s, d, "part", "'template' kind", "concat('t',p_partkey) name", f"{_value} value")), "SELECT 'template' AS kind, concat('t',p_partkey) AS name, CASE WHEN p_partkey%4 IN (0,3) THEN v END AS json, CASE WHEN p_partkey%4 IN (1,2) THEN 'PARSE_ERROR' END AS error FROM "
    "(SELECT p_partkey, CASE p_partkey%4 WHEN 0 THEN concat('{\"template_id\":\"T',p_partkey,'\"}') ELSE concat(' {\"a\":{\"b\":[',p_partkey,']}}') END AS v FROM part)")  # fmt: skip

# label records
_label = lambda s, d: fx._view(s, d, "part", "p_partkey label_id", "concat('f',p_partkey,'.png') source_file", "'2026-01-01' extracted_at", "3000L img_w", "600L img_h", "300L dpi", "cast(p_size%50 as double)/50D overall_confidence")


def _emitted(s: SparkSession, d: str) -> DataFrame:
    return records.emitted(_label(s, d), fx.full_fields(s, d))


_get = {
    "name": "$.elements.product_name.value", "conf": "$.elements.product_name.confidence", "raw": "$.elements.origin_text.raw_text", "x_frac": "$.elements.origin_text.bbox.x_frac", "code": "$.elements.itf14_barcode.raw_data", "symbology": "$.elements.itf14_barcode.symbology",
    "matrix": "$.elements.datamatrix_block.barcode.raw_data", "encoding": "$.elements.datamatrix_block.content.encoding", "item": "$.elements.datamatrix_block.content.ai_fields['240'].value", "packed": "$.elements.datamatrix_block.content.ai_fields['13'].formatted",
    "promoted": "$.elements.datamatrix_block.ai_fields['13'].value", "width": "$.extraction_metadata.image_width_px", "file": "$.extraction_metadata.source_file", "ean": "$.elements.ean_barcode",
}
_of = lambda f, c: f"max({c}) FILTER (field_id='{f}' AND value IS NOT NULL)"
_number = lambda c: F.round(F.col(c).cast("double"), 9).alias(c)
add("label_json", lambda s, d: _emitted(s, d).select("label_id", *(F.get_json_object("json", p).alias(c) for c, p in _get.items())).select("label_id", *(c for c in _get if c not in ("conf", "x_frac", "width")), *map(_number, ("conf", "x_frac", "width"))), ctes(
    f"SELECT label_id, {_of('product_name', 'value')} AS name, round({_of('product_name', 'confidence')},9) AS conf, {_of('origin_text', 'raw_text')} AS raw, round({_of('origin_text', 'x')}/3000::DOUBLE,9) AS x_frac, {_of('itf14_barcode', 'value')} AS code, {_of('itf14_barcode', 'symbology')} AS symbology, "
    f"{_of('datamatrix_barcode', 'value')} AS matrix, CASE WHEN label_id%2=0 THEN 'GS1' END AS encoding, CASE WHEN label_id%2=0 THEN '1' END AS item, CASE WHEN label_id%6=0 THEN '24-01-05' END AS packed, {_of('ai_13', 'value')} AS promoted, 3000::DOUBLE AS width, concat('f',label_id,'.png') AS file, NULL::VARCHAR AS ean FROM fx_full GROUP BY label_id"))  # fmt: skip
_back = lambda s, d: records.parsed(_emitted(s, d))
add("label_parse", lambda s, d: records.fields(_back(s, d)).select("label_id", "field_id", "value", "raw_text", "confidence", "zone", "source", "pattern_match", "symbology", "bbox.x", "bbox.y", "bbox.w", "bbox.h"), ctes(
    "SELECT label_id, field_id, value, raw_text, confidence, CASE WHEN symbology IS NULL THEN zone END AS zone, source, pattern_match, symbology, x, y, w, h FROM fx_full WHERE value IS NOT NULL"))
add("label_metadata", lambda s, d: records.metadata(records.parsed(_emitted(s, d).select("label_id", F.when(F.col("label_id") % 5 == 0, F.lit('{"elements":{}}')).when(F.col("label_id") % 5 == 1, F.lit('{"extraction_metadata":{"render_dpi":0},"date_label_present":true}')).when(F.col("label_id") % 5 == 2, F.lit("{nope")).otherwise(F.col("json")).alias("json")))).drop("warnings", "errors"), ctes(
    "SELECT p_partkey AS label_id, CASE WHEN p_partkey%5=1 THEN '' ELSE concat('f',p_partkey,'.png') END AS source_file, CASE WHEN p_partkey%5=1 THEN '' ELSE '2026-01-01' END AS extracted_at, CASE WHEN p_partkey%5=1 THEN 0 ELSE 3000 END::BIGINT AS image_width_px, CASE WHEN p_partkey%5=1 THEN 0 ELSE 600 END::BIGINT AS image_height_px, "
    "CASE WHEN p_partkey%5=1 THEN 600 ELSE 300 END::BIGINT AS render_dpi, CASE WHEN p_partkey%5=1 THEN 0 ELSE (p_size%50)::DOUBLE/50 END AS overall_confidence, p_partkey%5=1 OR (p_partkey%3<>0 AND p_partkey%2=0) AS date_label_present FROM part WHERE p_partkey%5 NOT IN (0,2)"))  # fmt: skip
