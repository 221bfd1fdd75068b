"""Queries over the specification catalogue: elements are derived from part, one template for each size; files to lint are a few literal ones."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill import fixtures as fx
from tagmill.catalog.registry import add
from tagmill.fixtures import ctes
from tagmill.operators import checks, spec

_IDS = "['product_name','article_number','article_code','origin_text','address_block','logo','E6','E7','E8','E9']"
_ELEMENTS = f"SELECT concat('T',p_size) AS template_id, p_partkey AS element_ord, {_IDS}[p_partkey%10+1] AS element_id, p_partkey, CASE WHEN p_partkey%5=0 THEN 'f9' WHEN p_partkey%3=0 THEN 'f1' END AS ref FROM part"


def _flat(s: SparkSession, d: str) -> DataFrame:
    part = fx._view(
        s, d, "part", "concat('T',p_size) template_id", "p_partkey element_ord", f"element_at(array({_IDS[1:-1]}), cast(p_partkey%10+1 as int)) element_id", "case when p_partkey%5=0 then 'f9' when p_partkey%3=0 then 'f1' end ref",
        "map_filter(map('placement.zone',case when p_partkey%4<>0 then concat('z',p_partkey%4) end,'shared_spec_ref',case p_partkey%7 when 0 then 's1' when 1 then 's9' end,'font.size',case when p_partkey%6<>0 then '3' end,'required',case when p_partkey%9<>0 then cast(p_partkey%2=0 as string) end),(k,v)->v is not null) props",
    )
    family = s.sql("select 'f1' ref, map('placement.zone','z0','required','true','orientation','vertical','font.case','upper') base")
    over = s.sql("select concat('T',id) template_id, 'origin_text' element_id, map('required','false','shared_spec_ref','s3') over from range(1,60)")
    visuals = s.sql("select 'product_name' element_id, map('font.size','9','font.weight','bold','placement.zone','z8','placement.alignment','left','allowed_patterns','^A+$') enrichment union all select 'E7', map('orientation','vertical_cw90','placement.alignment','right')")
    return spec.flattened(part, family, over, visuals)


_PROPS = ("placement.zone", "placement.alignment", "shared_spec_ref", "font.size", "font.weight", "font.case", "required", "orientation", "allowed_patterns")
_FLAT = ("flat", "SELECT template_id, element_ord, element_id, coalesce(ref='f9', false) AS unresolved, coalesce(CASE WHEN ref='f1' THEN 'z0' WHEN ref IS NULL AND p_partkey%4<>0 THEN concat('z',p_partkey%4) END, CASE WHEN element_id='product_name' THEN 'z8' END) AS placement_zone, "
         "CASE element_id WHEN 'product_name' THEN 'left' WHEN 'E7' THEN 'right' END AS placement_alignment, CASE WHEN ref IS NOT NULL THEN CASE WHEN element_id='origin_text' THEN 's3' END WHEN p_partkey%7=0 THEN 's1' WHEN p_partkey%7=1 THEN 's9' END AS shared_spec_ref, "
         "CASE WHEN ref IS NULL AND p_partkey%6<>0 THEN '3' WHEN element_id='product_name' AND coalesce(ref,'f9')='f9' THEN '9' END AS font_size, CASE WHEN element_id='product_name' AND ((ref IS NULL AND p_partkey%6=0) OR ref='f9') THEN 'bold' END AS font_weight, CASE WHEN ref='f1' THEN 'upper' END AS font_case, "
         "CASE WHEN ref IS NOT NULL AND element_id='origin_text' THEN 'false' WHEN ref='f1' THEN 'true' WHEN ref IS NULL AND p_partkey%9<>0 THEN (p_partkey%2=0)::VARCHAR END AS required, CASE WHEN ref='f1' THEN 'vertical' WHEN element_id='E7' THEN 'vertical_cw90' END AS orientation, "
         "CASE WHEN element_id='product_name' THEN '^A+$' END AS allowed_patterns FROM (" + _ELEMENTS + ")")  # fmt: skip
add("flatten_template", lambda s, d: _flat(s, d).select("template_id", "element_ord", "element_id", "unresolved", *(F.try_element_at("props", F.lit(k)).alias(k.replace(".", "_")) for k in _PROPS)), ctes("SELECT * FROM flat", _FLAT))
_TARGETS = ("targets", "SELECT template_id, format('{}-CHK-{:03d}', template_id, row_number() OVER (PARTITION BY template_id ORDER BY part, element_ord, k)) AS check_id, element_id, related_element_id, check_type, severity, expected FROM ("
            "SELECT template_id, 0 AS part, element_ord, 0 AS k, element_id, NULL AS related_element_id, 'element_presence' AS check_type, CASE WHEN coalesce(required,'true')='true' THEN 'must' ELSE 'may' END AS severity, NULL AS expected FROM flat "
            "UNION ALL SELECT template_id, 0, element_ord, 1, element_id, NULL, 'element_orientation', 'must', orientation FROM flat WHERE orientation<>'horizontal' UNION ALL SELECT template_id, 0, element_ord, 2, element_id, NULL, 'element_content_format', 'must', allowed_patterns FROM flat WHERE allowed_patterns IS NOT NULL "
            "UNION ALL SELECT template_id, 0, element_ord, 3, element_id, NULL, 'barcode_spec', 'must', shared_spec_ref FROM flat WHERE shared_spec_ref IS NOT NULL UNION ALL SELECT template_id, 0, element_ord, 4, element_id, NULL, 'element_placement', 'must', placement_zone FROM flat WHERE placement_zone IS NOT NULL "
            "UNION ALL SELECT template_id, 1, 0, 0, 'origin_text', 'address_block', 'cross_element_consistency', 'must', NULL FROM flat GROUP BY template_id HAVING bool_or(element_id='origin_text') AND bool_or(element_id='address_block') "
            "UNION ALL SELECT template_id, 1, 0, 1, 'layout', NULL, 'zone_order', 'must', string_agg(z, chr(10) ORDER BY o) FROM (SELECT template_id, placement_zone AS z, min(element_ord) AS o FROM flat WHERE placement_zone IS NOT NULL GROUP BY ALL) GROUP BY template_id HAVING count(*)>1 "
            "UNION ALL SELECT template_id, 1, 0, 2, 'product_name', 'article_number', 'visual_hierarchy', 'must', NULL FROM flat GROUP BY template_id HAVING bool_or(element_id='product_name') AND bool_or(element_id='article_number') "
            "UNION ALL SELECT template_id, 1, 0, 3, 'article_number', 'article_code', 'visual_hierarchy', 'must', NULL FROM flat GROUP BY template_id HAVING bool_or(element_id='article_number') AND bool_or(element_id='article_code'))")  # fmt: skip
add("targets", lambda s, d: spec.targets(_flat(s, d)), ctes("SELECT * FROM targets", _FLAT, _TARGETS))

# targets against what labels show
_shown = lambda s, d: fx._view(
    s, d, "part", "p_partkey label_id",
    "stack(6,'product_name','AAA',4.0D,'article_number','803',3.0D,'article_code','1',case when p_partkey%3=0 then 5.0D else 2.0D end,'origin_text',case p_partkey%3 when 0 then 'Made in China' when 1 then 'Made in Poland' else 'x' end,1.0D,'address_block',case p_partkey%2 when 0 then 'made in china' else 'Almhult' end,1.0D,'E7',' ',1.0D) as (element_id,text,font_size)",
).selectExpr("label_id", "element_id", "case when (label_id+length(element_id))%4<>0 then text end text", "concat('z',(label_id*7+length(element_id))%4) zone", "case when label_id%2=0 then 'vertical' else 'horizontal' end orientation", "'s1' spec", "font_size", "(label_id*13+length(element_id)*101)%500 x").where("(label_id*3+length(element_id))%11<>0")
_SHOWN = ("shown", "SELECT label_id, element_id, CASE WHEN (label_id+length(element_id))%4<>0 THEN text END AS text, concat('z',(label_id*7+length(element_id))%4) AS zone, CASE WHEN label_id%2=0 THEN 'vertical' ELSE 'horizontal' END AS orientation, 's1' AS spec, font_size, (label_id*13+length(element_id)*101)%500 AS x FROM ("
          + " UNION ALL ".join(f"SELECT p_partkey AS label_id, '{e}' AS element_id, {t} AS text, {f}::DOUBLE AS font_size FROM part" for e, t, f in (
              ("product_name", "'AAA'", "4"), ("article_number", "'803'", "3"), ("article_code", "'1'", "(CASE WHEN p_partkey%3=0 THEN 5 ELSE 2 END)"), ("origin_text", "CASE p_partkey%3 WHEN 0 THEN 'Made in China' WHEN 1 THEN 'Made in Poland' ELSE 'x' END", "1"),
              ("address_block", "CASE p_partkey%2 WHEN 0 THEN 'made in china' ELSE 'Almhult' END", "1"), ("E7", "' '", "1"))) + ") WHERE (label_id*3+length(element_id))%11<>0")
_ORDERED = ("ordered", "SELECT label_id, list(zone ORDER BY x, zone) AS zones FROM (SELECT label_id, zone, min(x) AS x FROM shown GROUP BY ALL) GROUP BY label_id")
_COUNTRY = lambda t: f"CASE WHEN contains(lower({t}),'china') THEN 'china' WHEN contains(lower({t}),'poland') THEN 'poland' END"
_CHECKED = ("checked", "SELECT l.label_id, t.template_id, t.check_id, t.check_type, t.element_id, t.severity, CASE t.check_type WHEN 'element_presence' THEN CASE WHEN trim(coalesce(e.text,''))<>'' THEN 'pass' WHEN t.severity='must' THEN 'fail' ELSE 'skip' END "
            "WHEN 'element_orientation' THEN CASE WHEN e.label_id IS NULL THEN 'skip' WHEN e.orientation=expected THEN 'pass' ELSE 'fail' END WHEN 'element_content_format' THEN CASE WHEN e.label_id IS NULL THEN 'skip' WHEN regexp_full_match(trim(e.text),'A+') THEN 'pass' ELSE 'fail' END "
            "WHEN 'barcode_spec' THEN CASE WHEN e.label_id IS NULL THEN 'skip' WHEN e.spec=expected THEN 'pass' ELSE 'fail' END WHEN 'element_placement' THEN CASE WHEN e.label_id IS NULL THEN 'skip' WHEN e.zone=expected THEN 'pass' ELSE 'fail' END "
            f"WHEN 'cross_element_consistency' THEN CASE WHEN e.label_id IS NULL OR r.label_id IS NULL THEN 'skip' WHEN coalesce(({_COUNTRY('e.text')})=({_COUNTRY('r.text')}),true) THEN 'pass' ELSE 'fail' END "
            "WHEN 'visual_hierarchy' THEN CASE WHEN e.label_id IS NULL OR r.label_id IS NULL THEN 'skip' WHEN e.font_size>r.font_size THEN 'pass' ELSE 'fail' END WHEN 'zone_order' THEN CASE WHEN z.zones IS NULL THEN 'skip' "
            "WHEN list_filter(z.zones, lambda a: list_contains(string_split(expected,chr(10)),a))=list_filter(string_split(expected,chr(10)), lambda a: list_contains(z.zones,a)) THEN 'pass' ELSE 'fail' END ELSE 'skip' END AS status "
            "FROM (SELECT p_partkey AS label_id, concat('T',p_partkey%7+1) AS template_id FROM part) l JOIN targets t USING (template_id) LEFT JOIN shown e ON e.label_id=l.label_id AND e.element_id=t.element_id LEFT JOIN shown r ON r.label_id=l.label_id AND r.element_id=t.related_element_id LEFT JOIN ordered z ON z.label_id=l.label_id")  # fmt: skip
_labels = lambda s, d: fx._view(s, d, "part", "p_partkey label_id", "concat('T',p_partkey%7+1) template_id")
add("targets_checked", lambda s, d: checks.checked(_labels(s, d), spec.targets(_flat(s, d)), _shown(s, d)), ctes("SELECT * FROM checked", _FLAT, _TARGETS, _SHOWN, _ORDERED, _CHECKED))
add("zone_sequence", lambda s, d: checks.zone_sequence(_shown(s, d)).select("label_id", F.array_join("zones", ",").alias("zones")), ctes("SELECT label_id, array_to_string(zones,',') AS zones FROM ordered", _SHOWN, _ORDERED))
add("zone_order", lambda s, d: checks.out_of_order(_shown(s, d), F.array(*(F.lit(f"z{k}") for k in range(4)))), ctes(
    "SELECT label_id, zone, next_zone FROM (SELECT label_id, zone, lead(zone) OVER (PARTITION BY label_id ORDER BY x, zone) AS next_zone FROM (SELECT label_id, zone, min(x) AS x FROM shown GROUP BY ALL)) WHERE next_zone<zone", _SHOWN))
add("visual_hierarchy", lambda s, d: checks.hierarchy_issues(_shown(s, d)), ctes(
    "SELECT a.label_id, a.element_id, b.element_id AS related_element_id, a.font_size, b.font_size AS next_font_size FROM shown a JOIN shown b ON a.label_id=b.label_id AND ((a.element_id='product_name' AND b.element_id='article_number') OR (a.element_id='article_number' AND b.element_id='article_code')) WHERE a.font_size<=b.font_size", _SHOWN))

# files to lint, each with a few faults, and the findings that they must give
_EV = {"page": 3, "evidence_type": "label_spec_text"}
_EL = {"label": "l", "semantic_role": "r", "type": "text", "required": True, "content_type": "c", "placement": {"zone": "z"}, "evidence": _EV}
_RU = {"rule_type": "presence_rule", "scope": "s", "condition": "c", "target": "t", "actions": [{"action_type": "a", "description": "d"}], "severity": "must", "normalized_text": "n", "evidence": _EV}
_SP = {"spec_type": "itf", "standard": "x", "evidence": _EV, "size_variants": [1]}
_FILES = (
    ("template", "t1", {"template_id": "T1", "display_name": "one", "family": "F1", "inherits_from": "F1", "source_evidence": _EV, "review_state": {"confidence": 0.8},
                        "elements": [{"element_id": "a", **_EL}, {"element_id": "a", **_EL, "shared_spec_ref": "s9"}, {"$ref_family_element": "b"}, {"label": "nameless"}, {"element_id": "c", "label": "l"}, {"element_id": "d", **_EL, "evidence": {"page": "three"}, "shared_spec_ref": "s1"}],
                        "rules": [{"rule_id": "r1", **_RU}, {"rule_id": "r1", **_RU, "rule_type": "odd", "severity": "maybe"}, {"rule_id": "r2", **_RU, "actions": [{"x": 1}]}, {"rule_id": "r3", **_RU, "actions": "none"}, {"scope": "s"}, {"rule_id": "r4", "evidence": {}}]}),
    ("template", "t2", {"template_id": "T2", "display_name": "two", "family": "F9", "inherits_from": "T0", "source_evidence": "page 3", "review_state": {"confidence": 1.5}, "rules": [{"rule_id": "r1", **_RU}]}),
    ("template", "t3", {"template_id": "T1", "family": "F1", "review_state": {}}),
    ("template", "t4", {"display_name": "nameless", "family": "F1", "source_evidence": {"evidence_type": "x"}, "review_state": {}}),
    ("family", "f1", {"family_id": "F1", "variant_ids": ["T1", "T7"]}),
    ("family", "f2", {"variant_ids": []}),
    ("spec", "specs", {"specs": [{"spec_id": "s1", **_SP}, {"spec_id": "s1", **_SP}, {"spec_id": "s2", **_SP, "spec_type": "ean13"}, {"spec_type": "datamatrix_square", "x_dim_variants": []}]}),
    ("index", "index", {"templates": [{"template_id": "T1"}, {"template_id": "T1"}, {"template_id": "T5"}], "total_templates": 15}),
)
_missing = lambda kind, name, context, have, every: [(kind, name, "MISSING_FIELD", "err", f"{context}:{f}") for f in every if f not in have]
_WANT = (
    *_missing("template", "t1", "t1/c", ("element_id", "label"), spec.ELEMENT_FIELDS), *_missing("template", "t1", "t1/r4", ("rule_id", "evidence"), spec.RULE_FIELDS),
    ("template", "t1", "BROKEN_REF", "err", "t1/a:s9"), ("template", "t1", "DUPLICATE_ELEMENT_ID", "err", "t1:a"), ("template", "t1", "MISSING_FIELD", "err", "t1/?:element_id"), ("template", "t1", "MISSING_EVIDENCE", "err", "t1/c"),
    ("template", "t1", "BAD_EVIDENCE", "err", "t1/d"), ("template", "t1", "WEAK_EVIDENCE", "warn", "t1/d"), ("template", "t1", "DUPLICATE_RULE_ID", "err", "t1:r1"), ("template", "t1", "INVALID_VALUE", "err", "t1/r1:rule_type"),
    ("template", "t1", "INVALID_VALUE", "err", "t1/r1:severity"), ("template", "t1", "MISSING_FIELD", "err", "t1/r2/action:action_type"), ("template", "t1", "WEAK_SPEC", "warn", "t1/r2/action:description"),
    ("template", "t1", "INVALID_VALUE", "err", "t1/r3:actions"), ("template", "t1", "MISSING_FIELD", "err", "t1/?:rule_id"), ("template", "t1", "MISSING_EVIDENCE", "err", "t1/r4"), ("template", "t1", "GLOBAL_DUPLICATE_RULE_ID", "warn", "r1:T1+T1"),
    ("template", "t2", "GLOBAL_DUPLICATE_RULE_ID", "warn", "r1:T1+T2"), ("template", "t2", "BROKEN_REF", "err", "t2:F9"), ("template", "t2", "BROKEN_REF", "warn", "t2:T0"), ("template", "t2", "MISSING_EVIDENCE", "err", "t2/source_evidence"),
    ("template", "t2", "INVALID_VALUE", "err", "t2:confidence"), ("template", "t2", "INVENTORY_MISMATCH", "warn", "t2:T2"),
    ("template", "t3", "MISSING_FIELD", "err", "t3:display_name"), ("template", "t3", "MISSING_FIELD", "err", "t3:source_evidence"), ("template", "t3", "DUPLICATE_TEMPLATE_ID", "err", "t3:T1"),
    ("template", "t4", "MISSING_FIELD", "err", "t4:template_id"), ("template", "t4", "MISSING_EVIDENCE", "err", "t4/source_evidence"),
    ("family", "f1", "BROKEN_REF", "err", "f1:T7"), ("family", "f2", "MISSING_FIELD", "err", "f2:family_id"),
    ("spec", "specs", "DUPLICATE_SPEC_ID", "err", "specs:s1"), ("spec", "specs", "WEAK_SPEC", "warn", "specs/s2:height_variants"), *_missing("spec", "specs", "specs/?", ("spec_type",), spec.SPEC_FIELDS),
    ("spec", "specs", "MISSING_EVIDENCE", "err", "specs/?"), ("spec", "specs", "WEAK_SPEC", "warn", "specs/?:x_dim_variants"),
    ("index", "index", "INVENTORY_MISMATCH", "err", "index:T5"), ("index", "index", "INVENTORY_COUNT", "warn", "index"),
)
_found = lambda s: spec.findings(fx.dim(s, tuple((k, n, json.dumps(j)) for k, n, j in _FILES), "kind string, name string, json string"))
_FOUND = fx._values(_WANT, "kind, name, code, severity, context")
add("spec_lint", lambda s, d: _found(s), _FOUND)
add("spec_verdict", lambda s, d: spec.verdict(_found(s)), f"SELECT count(*) FILTER (severity='err') AS n_err, count(*) FILTER (severity='warn') AS n_warn, CASE WHEN count(*) FILTER (severity='err')=0 THEN 'PASSED' ELSE 'FAILED' END AS verdict FROM ({_FOUND})")
