"""Queries over label types, rules, reports and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill import fixtures as fx
from tagmill.catalog.registry import add
from tagmill.fixtures import ctes
from tagmill.operators import boxes, checks, corrections, fields, passes, rules
from tagmill.values import COLOURS, CORE, SECTIONS, STANDARD

_SCORES = ("scores", "SELECT c.label_id, s.label_type_id, s.schema_ord, round(greatest((coalesce(got,0)+CASE WHEN has_itf THEN CASE WHEN itf THEN 10 ELSE -5 END ELSE 0 END+CASE WHEN has_dmv THEN CASE WHEN dm THEN 10 ELSE -5 END ELSE 0 END"
           "+CASE WHEN has_ean THEN -5 ELSE 0 END)::DOUBLE/(coalesce(most,0)+30),0),3) AS score FROM (SELECT label_id, bool_or(field_id='itf14_barcode' AND value IS NOT NULL) AS itf, bool_or(field_id='datamatrix_barcode' AND value IS NOT NULL) AS dm FROM fx_fields GROUP BY label_id) c "
           "CROSS JOIN fx_schemas s LEFT JOIN (SELECT label_type_id, sum(tenths)::BIGINT AS most FROM fx_schema_fields GROUP BY 1) m USING (label_type_id) LEFT JOIN (SELECT f.label_id, sf.label_type_id, sum(tenths)::BIGINT AS got FROM fx_fields f JOIN "
           "(SELECT label_type_id, coalesce(field_id, field) AS field_id, tenths FROM fx_schema_fields LEFT JOIN fx_alias USING (field)) sf USING (field_id) WHERE trim(f.value)<>'' GROUP BY ALL) h ON h.label_id=c.label_id AND h.label_type_id=s.label_type_id")  # fmt: skip
_RANKED = ("ranked", "SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY score DESC, schema_ord)::INT AS rank FROM scores")
_RESULTS = ("results", "SELECT b.label_id, b.label_type_id, r.rule_ord, r.rule_id, r.severity, CASE WHEN r.\"check\"='present' THEN CASE WHEN trim(coalesce(f.value,''))<>'' THEN 'pass' ELSE 'fail' END WHEN r.\"check\"='ai_field_present' THEN CASE WHEN r.ai NOT IN ('240','11','13','10') THEN 'skip' "
            "WHEN coalesce(f.value,'')<>'' OR contains(d.value,concat('(',r.ai,')')) THEN 'pass' WHEN d.label_id IS NOT NULL THEN 'fail' ELSE 'not_found' END WHEN r.\"check\"='regex_match' THEN CASE WHEN f.value IS NULL THEN 'not_found' WHEN NOT pattern_valid THEN 'skip' WHEN regexp_full_match(trim(f.value), CASE WHEN pattern_valid THEN pattern ELSE '' END) THEN 'pass' ELSE 'fail' END "
            "WHEN r.\"check\"='exact_match' THEN CASE WHEN f.value IS NULL THEN 'not_found' WHEN replace(lower(trim(f.value)),'ß','ss')=replace(lower(r.value),'ß','ss') THEN 'pass' ELSE 'fail' END ELSE 'skip' END AS status FROM (SELECT * FROM ranked WHERE rank=1) b JOIN fx_rules r USING (label_type_id) LEFT JOIN fx_alias a ON a.field=r.field "
            "LEFT JOIN fx_fields f ON f.label_id=b.label_id AND f.field_id=CASE WHEN r.\"check\"='ai_field_present' THEN concat('ai_',r.ai) ELSE coalesce(a.field_id,r.field) END LEFT JOIN (SELECT label_id, value FROM fx_fields WHERE field_id='datamatrix_barcode' AND value IS NOT NULL) d ON d.label_id=b.label_id")  # fmt: skip




def _types(s: SparkSession):
    return rules.types_of(fx.schemas(s), fx.schema_fields(s), fx.aliases(s))


def _typed(s: SparkSession, d: str) -> DataFrame:
    return rules.typed(rules.gathered(fx.fields(s, d)), _types(s))


def _judged(s: SparkSession, d: str) -> DataFrame:
    return rules.validated(fx.fields(s, d), _types(s), rules.Rules(fx.rules(s), fx.aliases(s)))


_BEST = ("best", "SELECT * FROM ranked WHERE rank=1")
add("type_score", lambda s, d: rules.type_scores(_typed(s, d)), ctes("SELECT * FROM scores", _SCORES))
add("type_topk", lambda s, d: rules.shortlist(_typed(s, d)), ctes("SELECT * FROM ranked WHERE rank<=5", _SCORES, _RANKED))
add("best_type", lambda s, d: rules.best_type(_typed(s, d)), ctes("SELECT label_id, label_type_id, score FROM ranked WHERE rank=1", _SCORES, _RANKED))
add("rule_eval", lambda s, d: rules.evaluated(_judged(s, d)), ctes("SELECT * FROM results", _SCORES, _RANKED, _RESULTS))
add("compliance_score", lambda s, d: rules.compliance(_judged(s, d)), ctes(
    "SELECT b.label_id, b.label_type_id, CASE WHEN count(r.rule_id)=0 THEN 0 ELSE coalesce(round((coalesce(sum(w) FILTER (status='pass'),0))::DOUBLE/(sum(w) FILTER (status<>'skip')),3),1) END AS compliance_score, count(*) FILTER (status='pass') AS n_pass, "
    "count(*) FILTER (status='fail' AND severity='error') AS n_error, count(*) FILTER (status='fail' AND severity='warning') AS n_warning, count(*) FILTER (status='skip') AS n_skip FROM best b LEFT JOIN "
    "(SELECT *, CASE severity WHEN 'error' THEN 20 WHEN 'warning' THEN 10 WHEN 'info' THEN 5 ELSE 10 END AS w FROM results) r ON r.label_id=b.label_id GROUP BY b.label_id, b.label_type_id", _SCORES, _RANKED, _RESULTS, _BEST))  # fmt: skip
_list = lambda names: ", ".join(map(repr, names))
_CONF = f"SELECT label_id, coalesce(round(sum(round(confidence*1000)::BIGINT*k)::DOUBLE/sum(k)/1000,3),0) AS overall_confidence FROM (SELECT *, CASE WHEN value IS NULL THEN NULL WHEN field_id IN ({_list(CORE)}) THEN 2 WHEN field_id IN ({_list(STANDARD)}) THEN 1 END AS k FROM {{0}}) GROUP BY label_id"
add("overall_confidence", lambda s, d: rules.overall_confidence(fx.fields(s, d).withColumn("confidence", F.col("confidence") / F.length("field_id"))), ctes(
    f"SELECT label_id, coalesce(floor((total*2+n*1000000)::DOUBLE/(n*2000000))/1000,0) AS overall_confidence FROM (SELECT label_id, sum(round(confidence/length(field_id)*1000000000)::BIGINT*k)::BIGINT AS total, sum(k)::BIGINT AS n FROM (SELECT *, CASE WHEN value IS NULL THEN NULL WHEN field_id IN ({_list(CORE)}) THEN 2 "
    f"WHEN field_id IN ({_list(STANDARD)}) THEN 1 END AS k FROM fx_fields) GROUP BY label_id)"))  # fmt: skip
add("missing_required", lambda s, d: rules.missing(_judged(s, d), _types(s)), ctes(
    "SELECT b.label_id, b.label_type_id, sf.field, CASE WHEN tenths=10 THEN 'error' ELSE 'warning' END AS severity FROM best b JOIN fx_schema_fields sf USING (label_type_id) LEFT JOIN fx_alias a ON a.field=sf.field "
    "WHERE NOT EXISTS (SELECT 1 FROM fx_fields f WHERE f.label_id=b.label_id AND f.field_id=coalesce(a.field_id,sf.field) AND trim(f.value)<>'')", _SCORES, _RANKED, _BEST))  # fmt: skip
_ISSUES = ("issues", "SELECT a.label_id, field_a, field_b, a.value AS value_a, b.value AS value_b, severity FROM (VALUES ('itf14_barcode','itf14_human_readable',true,'error'),('ai_13','human_readable_date',false,'error'),('ai_240','article_number',true,'warning'),('ean_barcode','ean_barcode_value',false,'error')) p(field_a,field_b,within,severity) "
           "JOIN fx_fields a ON a.field_id=field_a JOIN fx_fields b ON b.label_id=a.label_id AND b.field_id=field_b WHERE trim(a.value)<>'' AND trim(b.value)<>'' AND NOT CASE WHEN within THEN contains(regexp_replace(a.value,'\\D','','g'),regexp_replace(b.value,'\\D','','g')) "
           "ELSE regexp_replace(a.value,'\\D','','g')=regexp_replace(b.value,'\\D','','g') END")  # fmt: skip
add("field_consistency", lambda s, d: rules.consistency(rules.gathered(fx.fields(s, d))), ctes("SELECT * FROM issues", _ISSUES))
add("completeness_report", lambda s, d: rules.report_counts(rules.missing(_judged(s, d), _types(s)).select("label_id", "severity").union(rules.consistency(rules.gathered(fx.fields(s, d))).select("label_id", "severity"))), ctes(
    "SELECT label_id, count(*) FILTER (severity='error') AS n_error, count(*) FILTER (severity='warning') AS n_warning FROM (SELECT label_id, severity FROM issues UNION ALL SELECT b.label_id, CASE WHEN tenths=10 THEN 'error' ELSE 'warning' END FROM best b JOIN fx_schema_fields sf USING (label_type_id) LEFT JOIN fx_alias a ON a.field=sf.field "
    "WHERE NOT EXISTS (SELECT 1 FROM fx_fields f WHERE f.label_id=b.label_id AND f.field_id=coalesce(a.field_id,sf.field) AND trim(f.value)<>'')) GROUP BY label_id", _ISSUES, _SCORES, _RANKED, _BEST))  # fmt: skip

# corrections
_BOX = ["bbox.x", "bbox.y", "bbox.w", "bbox.h"]
_KNOWN = "('" + "','".join(f for f, _, _ in corrections.catalogue()) + "')"
_TEXTS = "('" + "','".join(f for f, _, code in corrections.catalogue() if not code) + "')"
add("apply_corrections", lambda s, d: corrections.applied(fx.full_fields(s, d), fx.corrections(s, d)).select("label_id", "field_id", "value", "raw_text", "confidence", "zone", "source", "pattern_match", "symbology", *_BOX), ctes(
    "SELECT label_id, field_id, coalesce(c.value, f.value) AS value, CASE WHEN c.value IS NULL THEN f.raw_text ELSE c.value END AS raw_text, CASE WHEN c.value IS NOT NULL THEN 1 ELSE f.confidence END AS confidence, f.zone, "
    "CASE WHEN c.value IS NULL THEN f.source WHEN field_id LIKE '%_barcode' THEN 'barcode' ELSE 'human' END AS source, f.pattern_match, CASE WHEN c.value IS NOT NULL AND field_id LIKE '%_barcode' THEN coalesce(f.symbology,'Unknown') ELSE f.symbology END AS symbology, "
    "CASE WHEN c.kx IS NOT NULL THEN kx ELSE x END AS x, CASE WHEN c.kx IS NOT NULL THEN ky ELSE y END AS y, CASE WHEN c.kx IS NOT NULL THEN kw ELSE w END AS w, CASE WHEN c.kx IS NOT NULL THEN kh ELSE h END AS h "
    "FROM (SELECT * FROM fx_full WHERE value IS NOT NULL) f FULL JOIN (SELECT * FROM fx_corrections WHERE value IS NOT NULL AND field_id<>'other') c USING (label_id, field_id)"))  # fmt: skip
_files = lambda s, d: fx.labels(s, d).selectExpr("label_id", "concat('h',label_id) file_hash", "300 dpi", "img_w", "img_h")
add("training_rows", lambda s, d: corrections.training_rows(_files(s, d), fx.full_fields(s, d), fx.corrections(s, d)).selectExpr("* except (corrected_bbox, model_bbox)", "corrected_bbox.x cx", "corrected_bbox.h ch", "model_bbox.x mx", "model_bbox.h mh"), ctes(
    "SELECT c.label_id, concat('h',c.label_id) AS file_hash, 300 AS dpi, img_w AS image_width, img_h AS image_height, c.field_id, c.value AS corrected_value, kx AS cx, kh AS ch, f.value AS model_value, f.x AS mx, f.h AS mh, c.field_id LIKE '%_barcode' AS is_barcode "
    f"FROM fx_corrections c JOIN fx_labels l ON l.label_id=c.label_id LEFT JOIN (SELECT * FROM fx_full WHERE value IS NOT NULL AND field_id IN {_KNOWN}) f ON f.label_id=c.label_id AND f.field_id=c.field_id WHERE c.value IS NOT NULL"))  # fmt: skip
add("field_count", lambda s, d: corrections.found_count(fx.fields(s, d)), ctes(
    f"SELECT label_id, count(*) FILTER (field_id IN {_KNOWN} AND CASE WHEN field_id='datamatrix_barcode' THEN value IS NOT NULL ELSE value<>'' END) AS n_found, count(*) FILTER (field_id IN {_KNOWN} AND value IS NOT NULL) AS n_objects, 36::BIGINT AS total FROM fx_fields GROUP BY label_id"))
add("field_choices", lambda s, d: s.createDataFrame(corrections.catalogue(), "field_id string, choice string, is_barcode boolean"), "SELECT * FROM (VALUES " + ", ".join(
    f"('{f}', '{n}  [{f}]', {f.endswith('_barcode')})" for f, n in (*corrections.TEXT_FIELDS, *corrections.BARCODE_FIELDS)) + ") t(field_id, choice, is_barcode)")
add("shown_values", lambda s, d: corrections.shown(fx.full_fields(s, d), fx.corrections(s, d)).select("label_id", "field_id", "shown", *_BOX), ctes(
    "SELECT label_id, field_id, shown, CASE k WHEN 1 THEN kx WHEN 2 THEN x END AS x, CASE k WHEN 1 THEN ky WHEN 2 THEN y END AS y, CASE k WHEN 1 THEN kw WHEN 2 THEN w END AS w, CASE k WHEN 1 THEN kh WHEN 2 THEN h END AS h FROM (SELECT f.*, c.*, coalesce(f.value,'') AS shown, "
    f"CASE WHEN kw>0 AND kh>0 THEN 1 WHEN w>0 AND h>0 THEN 2 END AS k FROM fx_full f LEFT JOIN (SELECT label_id AS cl, field_id AS cf, kx, ky, kw, kh FROM fx_corrections) c ON cl=f.label_id AND cf=f.field_id WHERE f.field_id IN {_KNOWN})"))  # fmt: skip
add("file_edits", lambda s, d: corrections.points(corrections.edits(fx.corrections(s, d)), 300), ctes(
    f"SELECT label_id, field_id, kx/(300/72::DOUBLE) AS x0, ky/(300/72::DOUBLE) AS y0, (kx+kw)/(300/72::DOUBLE) AS x1, (ky+kh)/(300/72::DOUBLE) AS y1, trim(value) AS text FROM fx_corrections WHERE field_id IN {_TEXTS} AND trim(value)<>'' AND kw>0 AND kh>0"))
_section = "CASE " + " ".join(f"WHEN field_id IN ({_list(fs)}) THEN '{k}'" for k, fs in SECTIONS.items()) + " END"
add("section_tally", lambda s, d: corrections.sections(fx.fields(s, d), fields.category(F.col("field_id"))), ctes(
    f"SELECT *, CASE WHEN found=total THEN 'green' WHEN found>0 THEN 'amber' ELSE 'red' END AS band FROM (SELECT label_id, {_section} AS section, count(value) AS found, count(*) AS total FROM fx_fields WHERE field_id IN {_KNOWN} GROUP BY ALL)"))
_names = ["plant_identifier", "package_number", "package_type", "copyright_notice", "ai_99", "my_barcode", "some_stamp", "new_plant", "age_of", "copyist", "thing", "Origin"]
add("field_category", lambda s, d: fx.fields(s, d).select("field_id").union(fx.dim(s, tuple((n,) for n in _names), "field_id string")).distinct().select("field_id", fields.category(F.col("field_id")).alias("category")), ctes(
    f"SELECT DISTINCT field_id, coalesce({_section}, CASE WHEN field_id IN ('ai_99','my_barcode') THEN 'barcodes' WHEN field_id='some_stamp' THEN 'date' WHEN field_id IN ('new_plant','Origin') THEN 'address' WHEN field_id='age_of' THEN 'compliance' WHEN field_id='copyist' THEN 'copy' ELSE 'identity' END) AS category "
    f"FROM (SELECT field_id FROM fx_fields UNION ALL SELECT unnest([{_list(_names)}]))"))  # fmt: skip
for _name, _column, _high, _low in (("confidence_band", "confidence", 0.85, 0.60), ("score_band", "confidence", 0.90, 0.65), ("type_match_band", "confidence", 0.60, 0.35)):
    add(_name, lambda s, d, c=_column, h=_high, w=_low: fx.fields(s, d).select("label_id", "field_id", fields.band(F.col(c), h, w).alias("band")), ctes(f"SELECT label_id, field_id, CASE WHEN {_column}>={_high} THEN 'green' WHEN {_column}>={_low} THEN 'amber' ELSE 'red' END AS band FROM fx_fields"))
_hex = {k: "#{:02x}{:02x}{:02x}".format(*v) for k, v in COLOURS.items()}
add("overlay_boxes", lambda s, d: boxes.overlays(fx.full_fields(s, d), fx.tags(s, d).where("false")), ctes(
    f"SELECT label_id, field_id, x, y, w, h, CASE section {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in _hex.items())} END AS colour FROM (SELECT *, CASE WHEN field_id='weight' THEN 'identity' ELSE {_section} END AS section FROM fx_full) WHERE value<>'' AND x IS NOT NULL AND w>0 AND h>0"))

# marks that pixels hint at
add("marks_seen", lambda s, d: fx.boxes(s, d).selectExpr("label_id", "seq", "x", "y", "b/2560D a", "g/2560D l", "r/2560D t").select("label_id", "seq", "x", "y", F.array_join(passes.marks_seen(F.col("a"), F.col("l"), F.col("t")), "+").alias("marks")), ctes(
    "SELECT label_id, seq, x, y, CASE WHEN b/2560::DOUBLE>0.05 THEN CASE WHEN g/2560::DOUBLE>0.04 AND r/2560::DOUBLE>0.04 THEN 'compliance_symbols_detected+CE' ELSE 'compliance_symbols_detected' END ELSE '' END AS marks FROM fx_boxes"))
_seen = "case p_partkey%3 when 0 then array('compliance_symbols_detected','CE') when 1 then array('compliance_symbols_detected') else cast(array() as array<string>) end"
add("marks_added", lambda s, d: fx._view(s, d, "part", "p_partkey", "case p_partkey%4 when 0 then 'TSCA, CE' when 1 then '' when 2 then 'CERTIFIED' end existing", f"{_seen} seen").select("p_partkey", passes.with_marks(F.col("existing"), F.col("seen")).alias("marks")),
    "SELECT p_partkey, CASE p_partkey%3 WHEN 2 THEN e ELSE concat_ws(', ', nullif(e,''), 'compliance_symbols_detected', CASE WHEN p_partkey%3=0 AND NOT contains(coalesce(e,''),'CE') THEN 'CE' END) END AS marks FROM (SELECT p_partkey, CASE p_partkey%4 WHEN 0 THEN 'TSCA, CE' WHEN 1 THEN '' WHEN 2 THEN 'CERTIFIED' END AS e FROM part)")

# layout
_zones = lambda s: fx.dim(s, (("A1", "article_number", "center_barcode"), ("A2", "article_number", "left_identity"), ("B1", "date_stamp", "left_identity"), ("C1", "product_name", "right_date")), "label_type_id string, field_id string, expected_zone string")
_of_type = lambda s, d: fx._view(s, d, "part", "p_partkey label_id", "element_at(array('A1','A2','B1','C1','Z9'), cast(p_partkey%5+1 as int)) label_type_id", "3000L img_w", "600L img_h")
_LAYOUT = ("layout", "SELECT f.label_id, f.field_id, expected_zone, f.zone AS actual_zone, unnest([CASE WHEN expected_zone<>f.zone THEN 'zone' END, CASE WHEN x>=3000 OR y>=600 OR x+w<=0 OR y+h<=0 THEN 'outside' END]) AS issue FROM fx_full f JOIN (SELECT p_partkey AS label_id, ['A1','A2','B1','C1','Z9'][p_partkey%5+1] AS label_type_id FROM part) t ON t.label_id=f.label_id "
           "LEFT JOIN (VALUES ('A1','article_number','center_barcode'),('A2','article_number','left_identity'),('B1','date_stamp','left_identity'),('C1','product_name','right_date')) e(label_type_id, field_id, expected_zone) ON e.label_type_id=t.label_type_id AND e.field_id=f.field_id WHERE f.value IS NOT NULL")  # fmt: skip
_layout = lambda s, d: checks.layout_issues(fx.full_fields(s, d), _zones(s), _of_type(s, d))
add("layout_issues", _layout, ctes("SELECT *, CASE issue WHEN 'zone' THEN 'warning' ELSE 'error' END AS severity FROM layout WHERE issue IS NOT NULL", _LAYOUT))
add("layout_report", lambda s, d: rules.report_counts(_layout(s, d)), ctes("SELECT label_id, count(*) FILTER (issue='outside') AS n_error, count(*) FILTER (issue='zone') AS n_warning FROM layout WHERE issue IS NOT NULL GROUP BY label_id", _LAYOUT))
