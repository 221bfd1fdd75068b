"""Layout checks and validation targets against what a label shows (all documented only by the original)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.functions import present, stripped
from tagmill.operators.fields import origin


def layout_issues(fields: DataFrame, expected: DataFrame, labels: DataFrame) -> DataFrame:
    """Fields outside the zone that their label's type names (warning) or the image altogether (error).

    fields (label_id, field_id, value, zone, bbox), expected (label_type_id, field_id, expected_zone), labels (label_id, label_type_id, img_w, img_h).
    """
    found = fields.where("value is not null").join(labels, "label_id").join(expected, ["label_type_id", "field_id"], "left")
    box = F.col("bbox")
    outside = F.coalesce((box["x"] >= F.col("img_w")) | (box["y"] >= F.col("img_h")) | (box["x"] + box["w"] <= 0) | (box["y"] + box["h"] <= 0), F.lit(False))
    moved = F.coalesce(F.col("expected_zone") != F.col("zone"), F.lit(False))
    issue = lambda code, severity: F.struct(F.lit(code).alias("issue"), F.lit(severity).alias("severity"))
    issues = F.array_compact(F.array(F.when(moved, issue("zone", "warning")), F.when(outside, issue("outside", "error"))))
    return found.select("label_id", "field_id", "expected_zone", F.col("zone").alias("actual_zone"), F.inline(issues))


def zone_sequence(elements: DataFrame) -> DataFrame:
    """label_id, zones: the zones that a label shows, in the order of their leftmost element."""
    at = elements.where("zone is not null").groupBy("label_id", "zone").agg(F.min("x").alias("x"))
    return at.groupBy("label_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "zone"))), lambda z: z["zone"]).alias("zones"))


def zones_in_order(shown: Column, expected: Column) -> Column:
    """Whether those of the expected zones that are shown come in the expected order, whatever else is between."""
    return F.filter(shown, lambda z: F.array_contains(expected, z)) == F.filter(expected, lambda z: F.array_contains(shown, z))


def out_of_order(elements: DataFrame, expected: Column) -> DataFrame:
    """Neighbouring zones of a label (by their leftmost element) that the expected order has the other way round: zone, next_zone."""
    at = elements.where("zone is not null").groupBy("label_id", "zone").agg(F.min("x").alias("x"))
    at = at.withColumn("rank", F.array_position(expected, F.col("zone"))).where("rank > 0")
    order = Window.partitionBy("label_id").orderBy("x", "zone")
    rows = at.select("label_id", "zone", "rank", F.lead("zone").over(order).alias("next_zone"), F.lead("rank").over(order).alias("next_rank"))
    return rows.where("next_rank < rank").select("label_id", "zone", "next_zone")


#: Of these elements each must be set larger than the next.
HIERARCHY = ("product_name", "article_number", "article_code")


def hierarchy_issues(elements: DataFrame) -> DataFrame:
    """Neighbours of the hierarchy that a label has both of and that are not set larger to smaller."""
    rank = F.array_position(F.array(*map(F.lit, HIERARCHY)), F.col("element_id"))
    rows = elements.withColumn("rank", rank).where("rank > 0 and font_size is not null").groupBy("label_id", "element_id", "rank").agg(F.max("font_size").alias("font_size"))
    order = Window.partitionBy("label_id").orderBy("rank")
    rows = rows.select("label_id", "element_id", "rank", "font_size", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("element_id", "rank", "font_size")))
    return rows.where("next_rank = rank + 1 and font_size <= next_font_size").select("label_id", "element_id", F.col("next_element_id").alias("related_element_id"), "font_size", "next_font_size")


def checked(labels: DataFrame, targets: DataFrame, elements: DataFrame) -> DataFrame:
    """A row per label and target of its template: status pass, fail, or skip where the target's element isn't there.

    labels (label_id, template_id); targets (template_id, check_id, check_type, element_id, severity, expected,
    related_element_id); elements (label_id, element_id, text, zone, orientation, spec, font_size, x). expected holds a
    zone, an orientation, a specification, patterns or zones, the last two with line feeds between them.
    """
    found = elements.groupBy("label_id", "element_id").agg(F.min(F.struct("x", "text", "zone", "orientation", "spec", "font_size")).alias("e"))
    related = found.select("label_id", F.col("element_id").alias("related_element_id"), F.col("e").alias("r"))
    rows = labels.join(targets, "template_id").join(found, ["label_id", "element_id"], "left").join(related, ["label_id", "related_element_id"], "left")
    rows = rows.join(zone_sequence(elements), "label_id", "left")
    e, r, expected = F.col("e"), F.col("r"), F.col("expected")
    verdict = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")
    have = lambda ok, *needed: F.when(sum((c.isNull().cast("int") for c in needed), F.lit(0)) > 0, "skip").otherwise(verdict(ok))
    matches = F.exists(F.split(expected, "\n"), lambda p: F.rlike(stripped(e["text"]), F.concat(F.lit("^(?:"), p, F.lit(r")\z"))))
    named = F.regexp_replace(F.concat(F.lit("in "), origin(e["text"])), r"^in \w+ in ", "")
    other = F.regexp_replace(F.concat(F.lit("in "), origin(r["text"])), r"^in \w+ in ", "")
    status = (
        F.when(F.col("check_type") == "element_presence", F.when(present(e["text"]), "pass").when(F.col("severity") == "must", "fail").otherwise("skip"))
        .when(F.col("check_type") == "element_orientation", have(e["orientation"] == expected, e))
        .when(F.col("check_type") == "element_content_format", have(matches, e))
        .when(F.col("check_type") == "barcode_spec", have(e["spec"] == expected, e))
        .when(F.col("check_type") == "element_placement", have(e["zone"] == expected, e))
        .when(F.col("check_type") == "cross_element_consistency", have(F.coalesce(named == other, F.lit(True)), e, r))
        .when(F.col("check_type") == "visual_hierarchy", have(e["font_size"] > r["font_size"], e, r))
        .when(F.col("check_type") == "zone_order", have(zones_in_order(F.col("zones"), F.split(expected, "\n")), F.col("zones")))
        .otherwise("skip")
    )
    return rows.select("label_id", "template_id", "check_id", "check_type", "element_id", "severity", status.alias("status"))
