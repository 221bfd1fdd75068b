"""Operators put together: from the words and codes of labels to their reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.operators import extract, geometry, lines, rules


@dataclass
class Analysis:
    """zones, fields, type_scores, shortlist, results, reports and confidence of all labels, each a frame that nothing has run yet."""

    zones: DataFrame
    fields: DataFrame
    type_scores: DataFrame
    shortlist: DataFrame
    results: DataFrame
    reports: DataFrame
    confidence: DataFrame


def analyze(words: DataFrame, codes: DataFrame, labels: DataFrame, schemas: DataFrame, schema_fields: DataFrame, aliases: DataFrame, rule_rows: DataFrame, boxes: DataFrame | None = None) -> Analysis:
    """words (label_id, word_idx, text, x, y, w, h, conf), codes (label_id, itf, ean, matrix), labels (label_id, img_w, img_h).

    boxes (label_id, itf_box, matrix_box) anchors the zones of wide labels to their codes.
    """
    if boxes is None:
        zoned = geometry.zoned(words, labels)
    else:
        zoned = geometry.zoned_by(words, geometry.calibrated(labels.join(boxes, "label_id", "left"), F.col("itf_box"), F.col("matrix_box")))
    fields = extract.extracted(lines.gated(zoned), codes)
    types = rules.types_of(schemas, schema_fields, aliases)
    judged = rules.validated(fields, types, rules.Rules(rule_rows, aliases))
    return Analysis(lines.zone_summary(zoned, labels), fields, rules.type_scores(judged), rules.shortlist(judged), rules.evaluated(judged), rules.compliance(judged), rules.overall_confidence(fields))
