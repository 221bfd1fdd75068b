"""Which boxes to show for a field's value: its own, or those of the words that make it up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions import mapping
from tagmill.operators.fields import category, highlight_tokens
from tagmill.values import COLOURS, REPORT_SECTION


def _agree(token: Column, word: Column) -> Column:
    """Short tokens must be equal, longer ones may hold each other."""
    return (token == word) | ((F.length(token) >= 5) & (F.contains(word, token) | F.contains(token, word)))


def word_boxes(fields: DataFrame, words: DataFrame) -> DataFrame:
    """label_id, field_id, word_idx, x, y, w, h: words that hold a token of the value, one for each 12 pixel cell.

    Words of the field's zone are asked first; where none fits, all are. A label's words are gathered once, so no pair of
    token and word becomes a row.
    """
    clean = F.lower(F.regexp_replace("text", r"(?U)[^\w.\-]", ""))
    listed = words.select("label_id", F.struct("word_idx", clean.alias("clean"), "x", "y", "w", "h", F.coalesce("zone", F.lit("")).alias("zone")).alias("word")).where("word.clean <> ''")
    listed = listed.groupBy("label_id").agg(F.collect_list("word").alias("ws"))
    rows = fields.where("value <> ''").select("label_id", "field_id", "zone", highlight_tokens(F.col("value")).alias("tokens")).join(listed, "label_id")
    fit = F.filter("ws", lambda w: F.exists("tokens", lambda t: _agree(t, w["clean"])))
    rows = rows.select("label_id", "field_id", "zone", fit.alias("fit"))
    near = F.filter("fit", lambda w: (F.coalesce("zone", F.lit("")) == "") | (w["zone"] == "") | (w["zone"] == F.col("zone")))
    rows = rows.select("label_id", "field_id", F.explode(F.when(F.size(near) > 0, near).otherwise(F.col("fit"))).alias("w"))
    cells = rows.groupBy("label_id", "field_id", F.floor(F.col("w.x") / 12), F.floor(F.col("w.y") / 12)).agg(F.min(F.struct("w.word_idx", "w.x", "w.y", "w.w", "w.h")).alias("w"))
    return cells.select("label_id", "field_id", "w.*")


def overlays(fields: DataFrame, words: DataFrame) -> DataFrame:
    """label_id, field_id, x, y, w, h, colour: the rectangles that show all fields.

    A decoded field with a box shows it; others show the boxes of their words, or their own box where no word fits.
    """
    have = fields.where("value <> ''")
    direct = F.coalesce((F.col("source") == "barcode") & F.col("bbox").isNotNull(), F.lit(False))
    found = word_boxes(have.where(~direct), words)
    own = have.where(direct).select("label_id", "field_id", "bbox.*")
    rest = have.where(~direct & F.col("bbox").isNotNull()).join(found.select("label_id", "field_id").distinct(), ["label_id", "field_id"], "left_anti").select("label_id", "field_id", "bbox.*")
    section = F.coalesce(F.try_element_at(mapping(REPORT_SECTION), F.col("field_id")), category(F.col("field_id")))
    colour = F.try_element_at(mapping({s: "#{:02x}{:02x}{:02x}".format(*rgb) for s, rgb in COLOURS.items()}), section)
    rows = own.unionByName(found.drop("word_idx")).unionByName(rest)
    return rows.where("w > 0 and h > 0").withColumn("colour", colour)


def sized_words(words: DataFrame) -> DataFrame:
    return words.where("w > 0 and h > 0").select("label_id", "word_idx", "x", "y", "w", "h")


def region_boxes(elements: DataFrame) -> DataFrame:
    """Boxes of the elements that are regions and have a size."""
    return elements.where("type = 'region' and w > 0 and h > 0").select("label_id", "seq", "x", "y", "w", "h")
