"""Human corrections: merge into extracted fields, rows for training, edits of the printed file.

fields: label_id, field_id, value (null: not found), raw_text, confidence, zone, source, pattern_match, bbox, symbology.
corrections: label_id, field_id, value (null: nothing to do; empty: cleared), bbox (null: none drawn).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions import stripped
from tagmill.values import BARCODE_FIELDS, BARCODES, TEXT_FIELDS

_TEXTS = tuple(f for f, _ in TEXT_FIELDS)
_KNOWN = (*_TEXTS, *BARCODES)


def catalogue() -> list[tuple[str, str, bool]]:
    """field_id, the choice shown for it, whether it is a barcode; in order."""
    return [(f, f"{name}  [{f}]", f in BARCODES) for f, name in (*TEXT_FIELDS, *BARCODE_FIELDS)]


def applied(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Upsert of the fields that the catalogue knows.

    A corrected value counts fully. A text field comes from a human then and keeps zone and pattern_match; a barcode keeps
    its symbology (`Unknown` if it is new) and source. A box replaces the field's only where one was drawn.
    """
    given = corrections.where("value is not null").where(F.col("field_id").isin(*_KNOWN))
    given = given.select("label_id", "field_id", F.col("value").alias("new"), F.col("bbox").alias("new_bbox"))
    kept = fields.where("value is not null")
    both = kept.join(given, ["label_id", "field_id"], "full_outer")
    new, code = F.col("new").isNotNull(), F.col("field_id").isin(*BARCODES)
    put = lambda name, value: F.when(new, value).otherwise(F.col(name)).alias(name)
    return both.select(
        "label_id", "field_id", F.coalesce("new", "value").alias("value"), put("raw_text", F.col("new")), put("confidence", F.lit(1.0)),
        "zone", F.when(new & ~code, "human").when(new, "barcode").otherwise(F.col("source")).alias("source"), "pattern_match",
        F.coalesce("new_bbox", "bbox").alias("bbox"), F.when(new & code, F.coalesce("symbology", F.lit("Unknown"))).otherwise(F.col("symbology")).alias("symbology"),
    )


def training_rows(labels: DataFrame, fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Each correction with what the model had; a field that the catalogue doesn't know has nothing. Empty values stay, missing ones go.

    labels: label_id, file_hash, dpi, img_w, img_h. The model's fields are never broadcast: they are by far the larger side, and
    Spark guesses their size from the table that they were unpacked from.
    """
    model = fields.where("value is not null").where(F.col("field_id").isin(*_KNOWN)).select("label_id", "field_id", F.col("value").alias("model_value"), F.col("bbox").alias("model_bbox"))
    rows = corrections.where("value is not null").join(model.hint("merge"), ["label_id", "field_id"], "left").join(labels, "label_id")
    return rows.select(
        "label_id", "file_hash", "dpi", F.col("img_w").alias("image_width"), F.col("img_h").alias("image_height"), "field_id", F.col("value").alias("corrected_value"),
        F.col("bbox").alias("corrected_bbox"), "model_value", "model_bbox", F.col("field_id").isin(*BARCODES).alias("is_barcode"),
    )


def found_count(fields: DataFrame) -> DataFrame:
    """Per label: n_found (fields of the catalogue with a text; for a matrix code that there is one), n_objects (that there is a field at all), total."""
    known = F.col("field_id").isin(*_KNOWN)
    found = F.when(F.col("field_id") == "datamatrix_barcode", F.col("value").isNotNull()).otherwise(F.coalesce(F.col("value") != "", F.lit(False)))
    return fields.groupBy("label_id").agg(F.count_if(known & found).alias("n_found"), F.count_if(known & F.col("value").isNotNull()).alias("n_objects"), F.lit(len(_KNOWN)).cast("long").alias("total"))


def _drawn(box: Column) -> Column:
    return F.coalesce((box["w"] > 0) & (box["h"] > 0), F.lit(False))


def picked_box(correction: Column, field: Column) -> Column:
    """The box to outline: the correction's, else the field's, if they have a size."""
    return F.when(_drawn(correction), correction).when(_drawn(field), field)


def shown(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """label_id, field_id, shown (the value or an empty text) and the box to outline, for the fields of the catalogue."""
    drawn = corrections.select("label_id", "field_id", F.col("bbox").alias("new_bbox"))
    rows = fields.where(F.col("field_id").isin(*_KNOWN)).join(drawn, ["label_id", "field_id"], "left")
    return rows.select("label_id", "field_id", F.coalesce("value", F.lit("")).alias("shown"), picked_box(F.col("new_bbox"), F.col("bbox")).alias("bbox"))


def percents(width: Column, height: Column, correction: Column, field: Column) -> Column:
    """STRUCT left, top, width, height in percent of the image: of the drawn box, else the field's, else a default."""
    sized = lambda b: F.coalesce((b["w"] != 0) & (b["h"] != 0), F.lit(False))
    of = lambda b: F.struct((100.0 * b["x"] / width).alias("left_pct"), (100.0 * b["y"] / height).alias("top_pct"), (100.0 * b["w"] / width).alias("w_pct"), (100.0 * b["h"] / height).alias("h_pct"))
    default = F.struct(F.lit(2.0).alias("left_pct"), F.lit(2.0).alias("top_pct"), F.lit(18.0).alias("w_pct"), F.lit(6.0).alias("h_pct"))
    return F.when(sized(correction), of(correction)).when(sized(field), of(field)).otherwise(default)


def from_percents(width: Column, height: Column, left: Column, top: Column, w: Column, h: Column) -> Column:
    """STRUCT x, y, w, h in pixels, cut to the image."""
    x = F.greatest(F.lit(0.0), F.least(width - 1, width * left / 100.0)).cast("long")
    y = F.greatest(F.lit(0.0), F.least(height - 1, height * top / 100.0)).cast("long")
    wide, high = F.greatest(F.lit(1.0), width * w / 100.0).cast("long"), F.greatest(F.lit(1.0), height * h / 100.0).cast("long")
    return F.struct(x.alias("x"), y.alias("y"), F.least(wide, width - x).alias("w"), F.least(high, height - y).alias("h"))


def edits(corrections: DataFrame) -> DataFrame:
    """What can be written into the printed file: text fields with a box and a text."""
    text = stripped(F.col("value"))
    rows = corrections.where(F.col("field_id").isin(*_TEXTS)).where("bbox is not null").where(F.coalesce(text != "", F.lit(False)))
    return rows.select("label_id", "field_id", "bbox.x", "bbox.y", "bbox.w", "bbox.h", text.alias("text"))


def points(edits: DataFrame, dpi: int = 600) -> DataFrame:
    """Edits in points, as rectangles to clear and to fill; those without a size are skipped."""
    at = lambda c: c / (dpi / 72.0)
    x, y, w, h = (F.col(c) for c in "xywh")
    return edits.where((w > 0) & (h > 0)).select("label_id", "field_id", at(x).alias("x0"), at(y).alias("y0"), at(x + w).alias("x1"), at(y + h).alias("y1"), "text")


def sections(fields: DataFrame, section: Column) -> DataFrame:
    """Per label and section: fields found, all of the section's, and the band of their share."""
    found, total = F.count_if(F.col("value").isNotNull()), F.count("*")
    rows = fields.where(F.col("field_id").isin(*_KNOWN)).groupBy("label_id", section.alias("section")).agg(found.alias("found"), total.alias("total"))
    return rows.withColumn("band", F.when(F.col("found") == F.col("total"), "green").when(F.col("found") > 0, "amber").otherwise("red"))
