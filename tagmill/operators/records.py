"""Labels as JSON records, and back.

A record holds the file's metadata, the elements by their field id (the matrix code and its identifiers in a block of their
own), the zones, the words and the elements of the passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions import mapping
from tagmill.operators import gs1
from tagmill.values import LEGACY_FIELDS, TEXT_FIELDS

_BOX = "struct<x:bigint,y:bigint,w:bigint,h:bigint,x_frac:double,y_frac:double,w_frac:double,h_frac:double,zone:string>"
_FIELD = f"struct<value:string,raw_text:string,confidence:double,zone:string,bbox:{_BOX},source:string,pattern_match:boolean>"
_CODE = f"struct<symbology:string,raw_data:string,decoded_text:string,bbox:{_BOX},confidence:double,source:string>"
_AI = "struct<ai_code:string,name:string,description:string,value:string,formatted:string,present:boolean>"
_ZONE = "struct<zone_id:string,raw_lines:array<string>,word_count:bigint,avg_confidence:double>"
_WORD = "struct<text:string,x:bigint,y:bigint,w:bigint,h:bigint,conf:double,zone:string>"
_ELEMENT = "struct<type:string,content:string,x:bigint,y:bigint,w:bigint,h:bigint,confidence:double,font:string,font_size:double,bold:boolean,italic:boolean,zone:string,meta:map<string,string>>"
_AIS = ("240", "13", "11", "10")
_PLAIN = tuple(f for f, _ in TEXT_FIELDS if not f.startswith("ai_")) + LEGACY_FIELDS
_META = (
    "struct<source_file:string,extracted_at:string,image_width_px:bigint,image_height_px:bigint,render_dpi:bigint,libraries_used:map<string,string>,overall_confidence:double,"
    "warnings:array<string>,errors:array<string>>"
)
_BLOCK = f"struct<barcode:{_CODE},content:struct<raw_data:string,encoding:string,ai_fields:map<string,{_AI}>>,ai_fields:struct<" + ",".join(f"`{a}`:{_FIELD}" for a in _AIS) + ">>"
_ELEMENTS = "struct<" + ",".join([*(f"{f}:{_FIELD}" for f in _PLAIN), *(f"ai_{a}:{_FIELD}" for a in _AIS), f"ean_barcode:{_CODE}", f"itf14_barcode:{_CODE}", f"datamatrix_block:{_BLOCK}", "date_label_present:boolean"]) + ">"
RECORD = f"extraction_metadata {_META}, elements {_ELEMENTS}, zones map<string,{_ZONE}>, raw_words array<{_WORD}>, raw_elements array<{_ELEMENT}>, date_label_present boolean"


def parsed(records: DataFrame, column: str = "json") -> DataFrame:
    """records with label: the record as a struct; null where it doesn't parse or has no metadata."""
    label = F.from_json(F.col(column), RECORD)
    return records.withColumn("label", F.when(label["extraction_metadata"].isNotNull(), label))


def metadata(labels: DataFrame, key: str = "label_id") -> DataFrame:
    """A row per record that parses, with what is missing filled in."""
    m = F.col("label.extraction_metadata")
    text = lambda c: F.coalesce(m[c], F.lit("")).alias(c)
    number = lambda c, default: F.coalesce(F.nullif(m[c], F.lit(0)), F.lit(default)).alias(c)
    listed = lambda c: F.coalesce(m[c], F.array().cast("array<string>")).alias(c)
    e = F.col("label.elements")
    dated = F.coalesce(e["date_label_present"], F.col("label.date_label_present"), F.lit(False)).alias("date_label_present")
    return labels.where("label is not null").select(
        key, text("source_file"), text("extracted_at"), number("image_width_px", 0), number("image_height_px", 0), number("render_dpi", 600),
        F.coalesce(m["overall_confidence"], F.lit(0.0)).alias("overall_confidence"), listed("warnings"), listed("errors"), dated,
    )


def fields(labels: DataFrame, key: str = "label_id") -> DataFrame:
    """A row per field of the records: value, raw_text, confidence, zone, source, pattern_match, bbox, symbology (of codes)."""
    e = F.col("label.elements")
    block = e["datamatrix_block"]
    box = lambda b: F.when(b.isNotNull(), F.struct(*(b[c].alias(c) for c in "xywh")))

    def row(name: str, value: Column, f: Column, source: str, symbology: Column, match: Column, zone: Column, raw: Column) -> Column:
        return F.when(
            f.isNotNull(),
            F.struct(
                F.lit(name).alias("field_id"), value.alias("value"), raw.alias("raw_text"), F.coalesce(f["confidence"], F.lit(0.0)).alias("confidence"), zone.alias("zone"),
                F.coalesce(F.nullif(f["source"], F.lit("")), F.lit(source)).alias("source"), match.alias("pattern_match"), box(f["bbox"]).alias("bbox"), symbology.alias("symbology"),
            ),
        )

    none, unsure = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    text = lambda name, f: row(name, f["value"], f, "ocr", none, f["pattern_match"], f["zone"], f["raw_text"])
    code = lambda name, f: row(name, F.coalesce(f["raw_data"], F.lit("")), f, "barcode", F.coalesce(f["symbology"], F.lit("")), unsure, none, F.coalesce(f["decoded_text"], f["raw_data"]))
    every = [
        *(text(f, e[f]) for f in _PLAIN), *(text(f"ai_{a}", F.coalesce(block["ai_fields"][a], e[f"ai_{a}"])) for a in _AIS),
        code("ean_barcode", e["ean_barcode"]), code("itf14_barcode", e["itf14_barcode"]), code("datamatrix_barcode", block["barcode"]),
    ]
    return labels.where("label is not null").select(key, F.inline(F.array_compact(F.array(*every))))


def emitted(labels: DataFrame, fields: DataFrame, host: str = gs1.HOST) -> DataFrame:
    """label_id, json: the records of labels (label_id, source_file, extracted_at, img_w, img_h, dpi, overall_confidence) with their fields.

    The matrix code's own content is parsed again from its raw text, as it stands in the block.
    """
    kept = fields.where("value is not null")
    entry = F.struct("field_id", F.struct("value", "raw_text", "confidence", "zone", "bbox", "source", "pattern_match", "symbology").alias("f"))
    maps = kept.groupBy("label_id").agg(F.map_from_entries(F.collect_list(entry)).alias("by"))
    rows = labels.join(maps, "label_id", "left")
    get = lambda name: F.try_element_at("by", F.lit(name))
    share = lambda at, of: F.when(F.col(of) != 0, at / F.col(of)).otherwise(0.0)

    def box(b: Column, zone: Column) -> Column:
        sides = [b[c].cast("long").alias(c) for c in "xywh"]
        shares = [share(b[c], "img_w" if c in "xw" else "img_h").alias(f"{c}_frac") for c in "xywh"]
        return F.when(b.isNotNull(), F.struct(*sides, *shares, zone.alias("zone")))

    def text(name: str) -> Column:
        f = get(name)
        return F.when(f.isNotNull(), F.struct(f["value"].alias("value"), f["raw_text"].alias("raw_text"), f["confidence"].alias("confidence"), f["zone"].alias("zone"), box(f["bbox"], f["zone"]).alias("bbox"), f["source"].alias("source"), f["pattern_match"].alias("pattern_match")))

    def code(name: str) -> Column:
        f = get(name)
        return F.when(f.isNotNull(), F.struct(F.coalesce(f["symbology"], F.lit("")).alias("symbology"), f["value"].alias("raw_data"), F.coalesce(f["raw_text"], f["value"]).alias("decoded_text"), box(f["bbox"], f["zone"]).alias("bbox"), f["confidence"].alias("confidence"), F.lit("barcode").alias("source")))

    raw = get("datamatrix_barcode")["value"]
    ais = F.transform(gs1.latest(gs1.detected(raw, host)), lambda p: gs1.field(p["ai"], p["raw"]))
    ais = F.map_from_entries(F.transform(ais, lambda a: F.struct(a["ai_code"], F.struct(a["ai_code"].alias("ai_code"), a["name"].alias("name"), F.lit("").alias("description"), a["value"].alias("value"), a["formatted"].alias("formatted"), a["present"].alias("present")))))
    content = F.when(raw.isNotNull(), F.struct(raw.alias("raw_data"), F.when(F.size(ais) > 0, "GS1").otherwise("raw").alias("encoding"), ais.alias("ai_fields")))
    block = F.struct(code("datamatrix_barcode").alias("barcode"), content.alias("content"), F.struct(*(text(f"ai_{a}").alias(a) for a in _AIS)).alias("ai_fields"))
    stamp = get("date_stamp")
    elements = F.struct(
        *(text(f).alias(f) for f in _PLAIN), code("ean_barcode").alias("ean_barcode"), code("itf14_barcode").alias("itf14_barcode"), block.alias("datamatrix_block"),
        F.coalesce(stamp["pattern_match"], F.lit(False)).alias("date_label_present"),
    )
    meta = F.struct(
        "source_file", "extracted_at", F.col("img_w").alias("image_width_px"), F.col("img_h").alias("image_height_px"), F.col("dpi").alias("render_dpi"), mapping({"engine": "tables"}).alias("libraries_used"),
        "overall_confidence", F.array().cast("array<string>").alias("warnings"), F.array().cast("array<string>").alias("errors"),
    )
    return rows.select("label_id", F.to_json(F.struct(meta.alias("extraction_metadata"), elements.alias("elements")), {"ignoreNullFields": "false"}).alias("json"))
