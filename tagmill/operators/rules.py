"""Label types, rules and scores.

A label's fields are gathered into one map, the only shuffle. Types and rules are dimensions of a checked size that stand in
the plan as literals, so scoring, ranking and evaluation are expressions on that row. Only labels whose exactly matched
values hold characters beyond ASCII visit Python, for the case folding that no built-in function does.

Dimensions: schemas (label_type_id, schema_ord, has_itf, has_ean, has_dmv), schema_fields (label_type_id, field, tenths),
aliases (field, field_id), rules (label_type_id, rule_ord, rule_id, field, check, severity, pattern, value, ai, pattern_valid).
"""

from __future__ import annotations

import json
import unicodedata
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions import first, mapping, mean3, nano, present, stripped
from tagmill.operators import gs1
from tagmill.values import CORE, STANDARD

#: Most rows of a dimension: it is collected and stands in the plan.
MOST_DIM_ROWS = 100_000
#: Identifiers that a rule may ask for.
RULE_AIS = ("240", "11", "13", "10")
_MATRIX = "datamatrix_barcode"


def dimension(dim: DataFrame) -> list[dict]:
    rows = dim.limit(MOST_DIM_ROWS + 1).collect()
    if len(rows) > MOST_DIM_ROWS:
        raise ValueError(f"a dimension of more than {MOST_DIM_ROWS} rows")
    return [r.asDict() for r in rows]


def _literal(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _names(aliases: DataFrame) -> dict[str, str]:
    return {a["field"]: a["field_id"] for a in dimension(aliases)}


def types_of(schemas: DataFrame, schema_fields: DataFrame, aliases: DataFrame) -> Column:
    """The types, each with the fields that it wants and its highest score."""
    names, wanted = _names(aliases), defaultdict(list)
    for f in dimension(schema_fields):
        wanted[f["label_type_id"]].append({"field": f["field"], "field_id": names.get(f["field"], f["field"]), "tenths": f["tenths"]})
    types = [s | {"wanted": wanted[s["label_type_id"]], "most": max(10, 30 + sum(f["tenths"] for f in wanted[s["label_type_id"]]))} for s in dimension(schemas)]
    kind = "label_type_id:string,schema_ord:int,has_itf:boolean,has_ean:boolean,has_dmv:boolean,most:int,wanted:array<struct<field:string,field_id:string,tenths:int>>"
    return _literal(types, f"array<struct<{kind}>>")


def folded(value: str | None) -> str | None:
    """Compatibility decomposition and case folding."""
    return None if value is None else unicodedata.normalize("NFKD", value).casefold()


class Rules:
    """The rules of each type as a literal, and the fields whose values are matched exactly."""

    def __init__(self, rules: DataFrame, aliases: DataFrame):
        names, of = _names(aliases), defaultdict(list)
        for r in sorted(dimension(rules), key=lambda r: r["rule_ord"]):
            field = names.get(r["field"], r["field"])
            of[r["label_type_id"]].append(r | {"field_id": field, "read": f"ai_{r['ai']}" if r["check"] == "ai_field_present" else field, "folded": folded(r["value"])})
        self.exact = sorted({r["field_id"] for rs in of.values() for r in rs if r["check"] == "exact_match"})
        kind = "rule_ord:int,rule_id:string,check:string,severity:string,pattern:string,ai:string,pattern_valid:boolean,field_id:string,read:string,folded:string"
        self.of = _literal(of, f"map<string,array<struct<{kind}>>>")


def gathered(fields: DataFrame) -> DataFrame:
    """label_id, vals: the map of a label's values, of a field that comes twice the last. The one shuffle of this module."""
    found = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("field_id", "value"))))
    rows = fields.groupBy("label_id").agg(found.alias("e"))
    once = F.filter("e", lambda x, i: ~F.exists(F.slice("e", i + 2, F.size("e")), lambda y: y["field_id"] == x["field_id"]))
    unique = F.size("e") == F.size(F.array_distinct(F.transform("e", lambda x: x["field_id"])))
    return rows.select("label_id", F.map_from_entries(F.when(unique, F.col("e")).otherwise(once)).alias("vals"))


def _value(field: Column | str) -> Column:
    return F.try_element_at("vals", F.lit(field) if isinstance(field, str) else field)


def typed(labels: DataFrame, types: Column) -> DataFrame:
    """labels (label_id, vals) with types: score, order and name of each, best first.

    The score is the tenths of weight of the fields that are present, and of the barcodes, over the type's maximum, rounded.
    """
    here = F.col("here")
    code = lambda need, field: F.when(need, F.when(_value(field).isNotNull(), 10).otherwise(-5)).otherwise(0)

    def score(t: Column) -> Column:
        got = F.aggregate(t["wanted"], F.lit(0), lambda total, f: total + F.when(F.array_contains(here, f["field_id"]), f["tenths"]).otherwise(0))
        total = got + code(t["has_itf"], "itf14_barcode") + code(t["has_dmv"], _MATRIX) + code(t["has_ean"], "ean_barcode")
        return F.round(F.greatest(total / t["most"], F.lit(0.0)), 3)

    ranked = F.array_sort(F.transform(types, lambda t: F.struct((-score(t)).alias("minus"), t["schema_ord"].alias("schema_ord"), t["label_type_id"].alias("label_type_id"))))
    ranked = F.transform(ranked, lambda t: F.struct(t["label_type_id"].alias("label_type_id"), t["schema_ord"].alias("schema_ord"), F.abs(t["minus"]).alias("score")))
    found = labels.withColumn("here", F.map_keys(F.map_filter("vals", lambda _, v: present(v))))
    return found.withColumn("types", ranked).drop("here")


def type_scores(labels: DataFrame) -> DataFrame:
    """A row per label and type."""
    return labels.select("label_id", F.inline("types"))


def shortlist(labels: DataFrame, k: int = 5) -> DataFrame:
    best = F.posexplode(F.slice("types", 1, k)).alias("at", "t")
    return labels.select("label_id", best).select("label_id", "t.*", (F.col("at") + 1).alias("rank"))


def best_type(labels: DataFrame) -> DataFrame:
    best = first(F.col("types"))
    return labels.select("label_id", best["label_type_id"].alias("label_type_id"), best["score"].alias("score"))


def _folded(values: Column) -> Column:
    @F.pandas_udf("array<string>")
    def fold(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else [folded(v) for v in x])

    return fold.asNondeterministic()(values)  # else it would be moved into the expression over the rules


def _with_folded(labels: DataFrame, exact: list[str]) -> DataFrame:
    """labels with same: the folded values of the fields that are matched exactly. ASCII ones, nearly all, stay on the JVM side."""
    own = F.transform_values(F.map_filter("vals", lambda k, _: k.isin(*exact) if exact else F.lit(False)), lambda _, v: stripped(v))
    odd = F.exists(F.map_values(own), lambda v: v.rlike(r"[^\x00-\x7F]"))
    plain = labels.where(~odd).withColumn("same", F.transform_values(own, lambda _, v: F.lower(v)))
    beyond = labels.where(odd).withColumn("same", F.map_from_arrays(F.map_keys(own), _folded(F.map_values(own))))
    return plain.unionByName(beyond) if exact else plain


def judged(labels: DataFrame, rules: Rules, host: str = gs1.HOST) -> DataFrame:
    """labels (label_id, vals, label_type_id, ...) with results: rule_ord, rule_id, severity and status (pass, fail, not_found or skip) of each rule."""
    raw = _value(_MATRIX)
    pairs = F.filter(gs1.latest(gs1.detected(raw, host)), lambda p: gs1.field(p["ai"], p["raw"])["present"])
    known = F.coalesce(F.transform(pairs, lambda p: p["ai"]), F.array().cast("array<string>"))
    rows = _with_folded(labels.withColumn("ais", known), rules.exact)
    verdict = lambda ok: F.when(ok, "pass").otherwise("fail")

    def status(r: Column) -> Column:
        found = _value(r["read"])
        full = F.rlike(stripped(found), F.concat(F.lit("^(?:"), r["pattern"], F.lit(r")\z")))
        ai = F.when(F.coalesce(found != "", F.lit(False)) | F.array_contains("ais", r["ai"]), "pass").when(raw.isNotNull(), "fail").otherwise("not_found")
        return (
            F.when(r["check"] == "present", verdict(present(found)))
            .when(r["check"] == "ai_field_present", F.when(r["ai"].isin(*RULE_AIS), ai).otherwise("skip"))
            .when(r["check"] == "regex_match", F.when(found.isNull(), "not_found").when(~r["pattern_valid"], "skip").otherwise(verdict(full)))
            .when(r["check"] == "exact_match", F.when(found.isNull(), "not_found").otherwise(verdict(F.try_element_at("same", r["field_id"]) == r["folded"])))
            .otherwise("skip")
        )

    own = F.coalesce(F.try_element_at(rules.of, F.col("label_type_id")), F.filter(first(F.map_values(rules.of)), lambda _: F.lit(False)))
    results = F.transform(own, lambda r: F.struct(r["rule_ord"].alias("rule_ord"), r["rule_id"].alias("rule_id"), r["severity"].alias("severity"), status(r).alias("status")))
    return rows.withColumn("results", results).drop("ais", "same")


def validated(fields: DataFrame, types: Column, rules: Rules) -> DataFrame:
    """Labels with their types and the results of the best one's rules: label_id, vals, types, label_type_id, results."""
    return judged(typed(gathered(fields), types).withColumn("label_type_id", first(F.col("types"))["label_type_id"]), rules)


def evaluated(labels: DataFrame) -> DataFrame:
    """A row per rule of judged labels."""
    return labels.select("label_id", "label_type_id", F.inline("results"))


def compliance(labels: DataFrame) -> DataFrame:
    """Per judged label: weighted share of passed rules among those that ran, and counters. 1 where all are skipped, 0 without rules."""
    weight = lambda r: F.when(r["severity"] == "error", 20).when(r["severity"] == "warning", 10).when(r["severity"] == "info", 5).otherwise(10)
    total = lambda keep: F.aggregate(F.filter("results", keep), F.lit(0), lambda n, r: n + weight(r))
    count = lambda keep: F.size(F.filter("results", keep)).cast("long")
    ran, passed = total(lambda r: r["status"] != "skip"), total(lambda r: r["status"] == "pass")
    score = F.when(F.size("results") == 0, 0.0).when(ran == 0, 1.0).otherwise(F.round(passed / ran, 3))
    failed = lambda severity: count(lambda r: (r["status"] == "fail") & (r["severity"] == severity))
    return labels.select(
        "label_id", "label_type_id", score.alias("compliance_score"), count(lambda r: r["status"] == "pass").alias("n_pass"), failed("error").alias("n_error"),
        failed("warning").alias("n_warning"), count(lambda r: r["status"] == "skip").alias("n_skip"),
    )


def overall_confidence(fields: DataFrame) -> DataFrame:
    """Weighted mean of the confidence of found fields: core fields weigh double, the standard ones once, others not at all; 0 without any."""
    weights = mapping({**dict.fromkeys(CORE, 2), **dict.fromkeys(STANDARD, 1)})
    weight = F.when(F.col("value").isNotNull(), F.try_element_at(weights, F.col("field_id")))
    found = fields.groupBy("label_id").agg(F.sum(nano(F.col("confidence")) * weight).alias("total"), F.sum(weight).alias("n"))
    return found.select("label_id", F.coalesce(mean3(F.col("total"), F.col("n")), F.lit(0.0)).alias("overall_confidence"))


def missing(labels: DataFrame, types: Column) -> DataFrame:
    """Fields of the best type that were not found: error if required, else warning (documented only by the original)."""
    best = first(F.filter(types, lambda t: t["label_type_id"] == F.col("label_type_id")))
    gone = F.filter(best["wanted"], lambda f: ~present(_value(f["field_id"])))
    rows = F.transform(gone, lambda f: F.struct(f["field"].alias("field"), F.when(f["tenths"] == 10, "error").otherwise("warning").alias("severity")))
    return labels.select("label_id", "label_type_id", F.inline(rows))


#: Pairs of fields that must agree (documented only by the original), and how: equal digits, or the second's within the first's.
AGREEMENTS = (
    ("itf14_barcode", "itf14_human_readable", "within", "error"),
    ("ai_13", "human_readable_date", "equal", "error"),
    ("ai_240", "article_number", "within", "warning"),
    ("ean_barcode", "ean_barcode_value", "equal", "error"),
)


def consistency(labels: DataFrame) -> DataFrame:
    """A row per pair of present fields that disagree: field_a, field_b, value_a, value_b, severity."""
    issues = []
    for a, b, how, severity in AGREEMENTS:
        x, y = (F.regexp_replace(_value(f), r"\D", "") for f in (a, b))
        agree = x == y if how == "equal" else F.contains(x, y)
        issue = F.struct(F.lit(a).alias("field_a"), F.lit(b).alias("field_b"), _value(a).alias("value_a"), _value(b).alias("value_b"), F.lit(severity).alias("severity"))
        issues.append(F.when(present(_value(a)) & present(_value(b)) & ~agree, issue))
    return labels.select("label_id", F.inline(F.array_compact(F.array(*issues))))


def report_counts(issues: DataFrame) -> DataFrame:
    """Errors and warnings of a report (layout, overlaps, completeness) per label."""
    return issues.groupBy("label_id").agg(F.count_if(F.col("severity") == "error").alias("n_error"), F.count_if(F.col("severity") == "warning").alias("n_warning"))
