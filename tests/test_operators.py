"""Edge cases derived by hand, and brute force where there is no SQL form."""

import json
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagmill import __main__ as command
from tagmill import catalog
from tagmill import fixtures as fx
from tagmill import functions as fn
from tagmill.operators import boxes, checks, corrections, extract, fields, geometry, gs1, lines, merge, passes, records, rules, spec
from tagmill.plans import analyze
from tagmill.sources import append_rows, read_files, read_labels, read_rules, read_specs, write_labels, write_specs
from tagmill.streaming import arriving, distinct_files

SF = "/root/testdata/sf0.001"


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_shape_edges(spark):
    for w, h, want in ((70, 100, "landscape"), (69, 100, "portrait"), (85, 100, "circular"), (115, 100, "circular"), (180, 100, "landscape"), (5, 0, "landscape")):
        assert one(spark, geometry.shape(F.lit(float(w)), F.lit(float(h)))) == want


def test_origin_ladder(spark):
    cases = {"Made in PEOPLES REPUBLIC": "Made in People's Republic of China", "republic of china": "Made in Republic of China", "assembled in India": "Assembled in India", "Indiana": None, "the usa": "Made in United States"}
    for text, want in cases.items():
        assert one(spark, fields.origin(F.lit(text))) == want


def test_date_ladder(spark):
    for text, want in (("DATE: 2415", ("2415", 1.0, True)), ("ATE 2415", ("2415", 0.9, True)), ("x 2415 y", ("2415", 0.7, False)), ("none", None)):
        got = one(spark, fields.date_stamp(F.lit(text), F.lit(1.0)))
        assert (tuple(got) if got else None) == want


def test_gs1_repeats_and_remainders(spark):
    df = spark.createDataFrame([(1, "(10)A(10)B(11)240105x"), (2, "AI(99)z")], "id int, t string")
    got = {(r["id"], r["ai_code"]): (r["value"], r["formatted"]) for r in gs1.fields(df, ["id"], gs1.parenthesised(F.col("t"))).collect()}
    assert got == {(1, "10"): ("B", None), (1, "11"): ("240105", "24-01-05"), (2, "99"): ("z", None)}
    df = spark.createDataFrame([("]d211240105EXTRA\x1d\x1d55abc\x1dx",)], "t string")
    got = {r["ai_code"]: r["value"] for r in gs1.fields(df, ["t"], gs1.compact(F.col("t"))).collect()}
    assert got == {"11": "240105", "55": "abc"}


def test_gs1_links(spark):
    df = spark.createDataFrame([("https://x.ikea.com/240/A%2F1/11/9?13=240105&10=a+b&10=c&x=1&240=Q#13=9",)], "t string")
    got = {r["ai_code"]: r["value"] for r in gs1.fields(df, ["t"], gs1.detected(F.col("t"))).collect()}
    assert got == {"240": "Q", "13": "240105", "10": "a b"}  # the first step alone, repeated keys once, later ones win over the path
    plan = gs1.fields(df, ["t"], gs1.detected(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_folding():
    for a, b, same in (("Älmhult", "Almhult", False), ("STRASSE", "straße", True), ("ﬁ", "fi", True), ("abc", "ABC", True)):
        assert (rules.folded(a) == rules.folded(b)) == same


RULE = "label_type_id string, rule_ord int, rule_id string, field string, check string, severity string, pattern string, value string, ai string, pattern_valid boolean"


def judged(spark, found, best, rule_rows):
    labels = rules.gathered(spark.createDataFrame(found, "label_id long, field_id string, value string, confidence double")).join(spark.createDataFrame(best, "label_id long, label_type_id string"), "label_id")
    alias = spark.createDataFrame([("q", "x")], "field string, field_id string")
    return rules.judged(labels, rules.Rules(spark.createDataFrame(rule_rows, RULE), alias))


def test_rules_of_a_label(spark):
    rows = [("A", 0, "r0", "q", "regex_match", "error", "ab?", None, None, True), ("A", 1, "r1", "x", "regex_match", "error", "(", None, None, False), ("A", 2, "r2", "gone", "present", "error", None, None, None, True),
            ("A", 3, "r3", "gone", "regex_match", "warning", "a", None, None, True), ("A", 4, "r4", "m", "ai_field_present", "error", None, None, "13", True)]
    found = [(1, "x", " ab\n", 1.0), (2, "x", "abc", 1.0), (2, "datamatrix_barcode", "z", 1.0), (3, "datamatrix_barcode", "(240)1(13)240105", 1.0), (3, "x", "ab", 1.0)]
    out = judged(spark, found, [(1, "A"), (2, "A"), (3, "A")], rows)
    got = {(r["label_id"], r["rule_id"]): r["status"] for r in rules.evaluated(out).collect()}
    want = {1: ("pass", "skip", "fail", "not_found", "not_found"), 2: ("fail", "skip", "fail", "not_found", "fail"), 3: ("pass", "skip", "fail", "not_found", "pass")}
    assert got == {(k, f"r{n}"): status for k, v in want.items() for n, status in enumerate(v)}
    assert {r["label_id"]: r["compliance_score"] for r in rules.compliance(out).collect()} == {1: round(20 / 70, 3), 2: 0.0, 3: round(40 / 70, 3)}


def test_scores_without_rules_and_with_skips_alone(spark):
    out = judged(spark, [(1, "x", "a", 1.0), (2, "x", "a", 1.0)], [(1, "A"), (2, "none")], [("A", 0, "r", "x", "range_mm", "odd", None, None, None, True)])
    assert {r["label_id"]: r["compliance_score"] for r in rules.compliance(out).collect()} == {1: 1.0, 2: 0.0}


def test_exact_values_beyond_ascii(spark):
    rows = [("A", k, f"r{k}", "x", "exact_match", "error", None, v, None, True) for k, v in enumerate(("Almhult", "Älmhult", "strasse", "fi"))]
    found = [(1, "x", " Älmhult ", 1.0), (2, "x", "STRAßE", 1.0), (3, "x", "ﬁ", 1.0), (4, "x", "Almhult", 1.0)]
    got = {(r["label_id"], r["rule_id"]) for r in rules.evaluated(judged(spark, found, [(k, "A") for k in range(1, 5)], rows)).where("status = 'pass'").collect()}
    assert got == {(1, "r1"), (2, "r2"), (3, "r3"), (4, "r0")}


def test_rules_need_one_shuffle_and_python_for_few(spark):
    types = rules.types_of(fx.schemas(spark), fx.schema_fields(spark), fx.aliases(spark))
    out = rules.compliance(rules.validated(fx.fields(spark, SF), types, rules.Rules(fx.rules(spark).where("check <> 'exact_match'"), fx.aliases(spark))))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ArrowEvalPython" not in plan and "Join" not in plan


def test_dimensions_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(rules, "MOST_DIM_ROWS", 2)
    with pytest.raises(ValueError):
        rules.dimension(fx.schemas(spark))


def test_repeated_fields_of_a_label(spark):
    df = spark.createDataFrame([(1, "x", "a"), (1, "x", "b"), (1, "x", "b"), (1, "y", None)], "label_id long, field_id string, value string")
    assert rules.gathered(df).first()["vals"] == {"x": "b"}


def test_confidence_counts_named_fields_alone(spark):
    rows = [(1, "product_name", "a", 0.5), (1, "origin_text", "b", 0.2), (1, "ai_13", "c", 0.9), (1, "age_rating", "d", 1.0), (1, "article_number", None, 1.0), (2, "ai_13", "c", 0.9)]
    got = {r[0]: r[1] for r in rules.overall_confidence(spark.createDataFrame(rows, "label_id long, field_id string, value string, confidence double")).collect()}
    assert got == {1: 0.4, 2: 0.0}


def test_name_tokens(spark):
    for token, fit in (("BILLY", True), ("KG", False), ("CM", False), ("LACK,", True), ("(LACK)", False), ("'LACK|", True), ("IKEA", False), ("A", False), ("LACK-TV/X", True), ("lack", False), ("ÄPPLARÖ", True), ("", False)):
        assert one(spark, fields.is_name_token(F.lit(token))) == fit, token


def test_corrections(spark):
    box = "struct<x:bigint,y:bigint,w:bigint,h:bigint>"
    schema = f"label_id long, field_id string, value string, raw_text string, confidence double, zone string, source string, pattern_match boolean, bbox {box}, symbology string"
    found = spark.createDataFrame([(1, "article_number", "111.222.33", "111.222.33", 0.5, "identity", "ocr", True, None, None), (1, "itf14_barcode", "1", "1", 0.7, None, "barcode", None, (1, 1, 1, 1), "I25")], schema)
    given = spark.createDataFrame([(1, "product_name", "BILLY", (10, 20, 30, 12)), (1, "article_number", "803.804.64", (1, 1, 5, 5)), (1, "itf14_barcode", "9", None), (1, "ean_barcode", "4", None), (1, "other", "x", None), (1, "origin_text", None, (1, 1, 1, 1))], f"label_id long, field_id string, value string, bbox {box}")
    got = {r["field_id"]: r for r in corrections.applied(found, given).collect()}
    assert set(got) == {"product_name", "article_number", "itf14_barcode", "ean_barcode"}
    assert (got["product_name"]["value"], got["product_name"]["source"], got["product_name"]["bbox"]["x"], got["product_name"]["zone"]) == ("BILLY", "human", 10, None)
    changed = got["article_number"]
    assert (changed["value"], changed["raw_text"], changed["confidence"], changed["zone"], changed["pattern_match"], changed["bbox"]["w"]) == ("803.804.64", "803.804.64", 1.0, "identity", True, 5)
    assert (got["itf14_barcode"]["symbology"], got["itf14_barcode"]["source"], got["itf14_barcode"]["bbox"]["x"]) == ("I25", "barcode", 1)
    assert (got["ean_barcode"]["symbology"], got["ean_barcode"]["source"], got["ean_barcode"]["bbox"]) == ("Unknown", "barcode", None)
    files = spark.createDataFrame([(1, "abc123", 300, 200, 200)], "label_id long, file_hash string, dpi int, img_w int, img_h int")
    rows = {r["field_id"]: r for r in corrections.training_rows(files, found, given).collect()}
    assert (rows["article_number"]["model_value"], rows["article_number"]["corrected_value"], rows["article_number"]["file_hash"]) == ("111.222.33", "803.804.64", "abc123")
    assert (rows["other"]["model_value"], rows["other"]["model_bbox"], rows["other"]["is_barcode"]) == (None, None, False) and rows["ean_barcode"]["is_barcode"]


def test_percent_boxes_at_the_border(spark):
    got = one(spark, corrections.from_percents(F.lit(200), F.lit(100), F.lit(99.9), F.lit(-5.0), F.lit(50.0), F.lit(0.0)))
    assert tuple(got) == (199, 0, 1, 1)


def test_calibrated_zones(spark):
    df = spark.createDataFrame([(1, 4000, 600, (300,), (900, 400)), (2, 4000, 600, None, (900, 400)), (3, 600, 4000, (300,), (900, 400))], "label_id long, img_w long, img_h long, itf struct<x:long>, dm struct<x:long,w:long>")
    got = {r["label_id"]: [(z["name"], round(z["start"], 6), round(z["end"], 6)) for z in r["zones"]] for r in geometry.calibrated(df, F.col("itf"), F.col("dm")).collect()}
    assert got[1][:4] == [("left_identity", 0.0, 0.065), ("center_barcode", 0.06375, 0.215), ("center_datamatrix", 0.215, 0.445), ("center_address", 0.445, 0.72)]
    assert got[2][0] == ("left_identity", 0.0, 0.18) and got[3][0] == ("top_identity", 0.0, 0.28)


def test_overlaps_in_a_grid(spark):
    rng = random.Random(3)
    rows = [(1, k, rng.randrange(3000), rng.randrange(900), rng.randrange(1, 700), rng.randrange(1, 300)) for k in range(60)]
    got = {(r["seq1"], r["seq2"]): r["area"] for r in geometry.overlaps(spark.createDataFrame(rows, "label_id int, seq int, x int, y int, w int, h int")).collect()}
    want = {}
    for i, (_, a, x, y, w, h) in enumerate(rows):
        for _, b, x2, y2, w2, h2 in rows[i + 1 :]:
            across, down = min(x + w, x2 + w2) - max(x, x2), min(y + h, y2 + h2) - max(y, y2)
            if across > 0 and down > 0:
                want[a, b] = across * down
    assert got == want


def test_repeated_boxes_meet_in_one_shuffle(spark, tmp_path):
    rows = [(1, 1, 0, 0, 600, 20, 5), (1, 1, 0, 0, 600, 20, 5), (1, 1, 0, 0, 600, 20, 6), (1, 2, 500, 10, 300, 600, 5), (1, 2, 500, 10, 300, 600, 5), (2, 3, 500, 10, 300, 600, 5), (None, 4, 0, 0, 9, 9, 5), (None, 5, 0, 0, 9, 9, 5)]
    spark.createDataFrame(rows, "label_id int, seq int, x int, y int, w int, h int, b int").write.parquet(str(tmp_path / "boxes"))
    pairs = geometry.overlaps(spark.read.parquet(str(tmp_path / "boxes")), distinct=True)
    assert sorted(tuple(r)[:4] for r in pairs.collect()) == [(1, 1, 2, 1000), (1, 1, 2, 1000)]  # once for each colour
    plan = catalog.queries()["overlap_pairs"](spark, SF)
    assert plan.count() == plan.distinct().count()
    shuffles = plan._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(")[1:]
    assert len(shuffles) == 2 and len({x.split(")")[0].count(",") for x in shuffles}) == 1 and all("REPARTITION_BY_NUM" in x.split("\n")[0] for x in shuffles)  # alike, so the second is the first's


@pytest.mark.parametrize("kinds", ["seq long, x int, y int, w int, h int, b int", "seq long, x long, y long, w int, h short, b long, g byte, r short, s int, name string", "seq long, x double, y int, w int, h int, b int", "seq long, x int, y int, w int, h int"])
def test_packed_boxes_lose_no_pair(spark, tmp_path, kinds):
    rng = random.Random(11)
    columns = kinds.split(", ")
    some = {"seq": (1, 2, 3, 4, -5, 2**48 - 1, 2**48, 2**62), "x": (-3000, -7, 0, 500, 509, 16380, 16383, 16384, 70000), "y": (-40, 0, 505, 16383, 16384, 30000), "w": (1, 20, 600, 16383, 20000), "h": (-2, 1, 30, 600, 16384), "b": (None, -1, 0, 255, 256, 5), "g": (None, 7, -7), "s": (1, 2)}
    near = {"seq": range(90), "x": range(1200), "y": range(700), "w": range(1, 300), "h": range(1, 200)}
    value = lambda c, kind, of: str(rng.randrange(2)) if kind == "string" else (float if kind == "double" else lambda v: v)(rng.choice((*of.get(c, some.get(c, (0, 255, 256, None))),)))
    rows = [(rng.randrange(2), *(value(*c.split(), of) for c in columns)) for of in (some, near) for _ in range(150)]
    rows += [(1, *(None if k == gone else v for k, v in enumerate(rows[-1][1:]))) for gone in range(5)] + [(None, *rows[-1][1:])] * 2
    rows = [(r[0], *((v if v is None or not c.endswith("double") else float(v)) for c, v in zip(columns, r[1:], strict=True))) for r in rows * 2]
    spark.createDataFrame(rows, f"label_id int, {kinds}").write.parquet(str(tmp_path / "boxes"))
    boxes = spark.read.parquet(str(tmp_path / "boxes"))
    got, want = geometry.overlaps(boxes, distinct=True), geometry.overlaps(boxes.distinct())
    assert got.dtypes == want.dtypes
    got, want = (sorted(tuple(r) for r in x.collect()) for x in (got, want))
    assert len(want) > 500 and got == want


def test_boxes_are_packed_for_their_shuffle(spark):
    plan = catalog.queries()["overlap_pairs"](spark, SF)
    told = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    sent = re.findall(r"\) Exchange\nInput \[(\d+)\]: \[(.*)\]", told)
    assert sent and {n for n, _ in sent} == {"6"} and all(re.sub(r"#\d+L?", "", names) == "label_id, cx, cy, _p0, _p1, _wide" for _, names in sent)  # a label's key, its cell and two longs


def test_lines_match_a_scan(spark):
    rng = random.Random(5)
    rows = [(label, k, f"t{k}", rng.randrange(900), rng.randrange(200), 20, rng.randrange(0, 30), 0.5) for label in range(30) for k in range(rng.randrange(1, 15))]
    got = {(r["label_id"], r["word_idx"]): r["line_no"] for r in lines.line_groups(spark.createDataFrame(rows, "label_id int, word_idx int, text string, x int, y int, w int, h int, conf double")).collect()}
    for label in range(30):
        own = sorted((r for r in rows if r[0] == label), key=lambda r: (r[4], r[3], r[1]))
        heights = sorted(r[6] for r in own if r[6] > 0)
        gap = max(4, int(heights[len(heights) // 2] * 0.7)) if heights else 8
        bottom, line = own[0][4] + own[0][6], 0
        for r in own:
            line += r[4] > bottom + gap
            bottom = max(bottom, r[4] + r[6])
            assert got[label, r[1]] == line


def test_merge_is_greedy(spark):
    words = pd.DataFrame({"label_id": [1] * 4, "engine": list("aabb"), "rank": [0, 0, 1, 1], "word_idx": [0, 1, 0, 1], "text": ["p", "q", "r", "s"], "cx": [0.0, 50.0, 10.0, 60.0], "cy": [0.0] * 4, "conf": [0.5, 0.5, 0.9, 0.1]})
    df = spark.createDataFrame(words)
    assert [r["text"] for r in merge.merged_words(df).orderBy("place").collect()] == ["r", "q"]
    assert [r["text"] for r in merge.deduplicated(df).orderBy("place").collect()] == ["p", "q"]


def scan(first, more, near, replace):
    """The merge as a plain scan of the whole list for each word."""
    out = list(first)
    for word in more:
        at = next((i for i, w in enumerate(out) if abs(w[2] - word[2]) < near and abs(w[3] - word[3]) < near), None)
        if at is None:
            out.append(word)
        elif replace and word[4] > out[at][4]:
            out[at] = word
    return out


def test_merges_match_a_scan(spark):
    rng = random.Random(7)
    rows = [(label, "ab"[k > 25], int(k > 25), k, f"t{k}", float(rng.randrange(-40, 120)), float(rng.randrange(60)), rng.randrange(10) / 10) for label in range(25) for k in range(rng.randrange(20, 60))]
    df = spark.createDataFrame(rows, "label_id long, engine string, rank int, word_idx long, text string, cx double, cy double, conf double")
    for query, near, replace in ((merge.merged_words, 15.0, True), (merge.deduplicated, 20.0, False)):
        got = query(df).orderBy("label_id", "place").collect()
        for label in range(25):
            own = [[r[1], r[4], r[5], r[6], r[7]] for r in rows if r[0] == label]
            ranks = [r[2] for r in rows if r[0] == label]
            want = scan([w for w, k in zip(own, ranks, strict=True) if k == 0], [w for w, k in zip(own, ranks, strict=True) if k], near, replace)
            assert [r["text"] for r in got if r["label_id"] == label] == [w[1] for w in want]


def test_passes_match_a_scan(spark):
    rng = random.Random(8)
    rows = []
    for label in range(30):
        asked = [p for p in merge.PASSES if rng.random() < 0.7] or ["second"]
        rows += [(label, rng.choice(asked), "e", k, f"t{k}", float(rng.randrange(200)), float(rng.randrange(60)), rng.randrange(10) / 10, rng.choice(["z1", "z2", "z3", "right_copy_count"])) for k in range(rng.randrange(1, 50))]
    got = merge.in_pass_order(spark.createDataFrame(rows, "label_id long, pass string, engine string, word_idx long, text string, cx double, cy double, conf double, zone string")).orderBy("label_id", "place").collect()
    for label in range(30):
        of = {p: [[r[2], r[4], r[5], r[6], r[7], r[8]] for r in rows if r[0] == label and r[1] == p] for p in merge.PASSES}
        words = of["first"]
        if of["whole"]:
            words = scan(words, of["whole"], 15, True) if words else of["whole"]
            n = {z: sum(w[5] == z for w in words) for z in ("z1", "z2", "z3")}
            words = scan(words, [w for w in of["zones"] if n.get(w[5], 3) < 3], 15, True) + of["strip"]
            words = scan(words, of["second"], 20, True)
        elif of["second"]:
            words = of["second"]
        if of["file"]:
            words = scan(of["file"], words, 20, False)
        assert [r["text"] for r in got if r["label_id"] == label] == [w[1] for w in words], label


def test_word_boxes(spark):
    words = spark.createDataFrame([(1, 0, "BILLY!", 0, 0, 5, 5, "a"), (1, 1, "billy", 1, 1, 5, 5, "a"), (1, 2, "BILLYs", 100, 0, 5, 5, "b"), (1, 3, "red", 50, 50, 5, 5, "b"), (1, 4, "redder", 90, 90, 5, 5, "b")], "label_id long, word_idx long, text string, x long, y long, w long, h long, zone string")
    asked = spark.createDataFrame([(1, "near", "Billy x", "a"), (1, "far", "billy", "c"), (1, "short", "red", None), (1, "none", "xy", None)], "label_id long, field_id string, value string, zone string")
    got = {}
    for r in boxes.word_boxes(asked, words).collect():
        got.setdefault(r["field_id"], set()).add(r["word_idx"])
    assert got == {"near": {0}, "far": {0, 2}, "short": {3}}


def test_pixels(spark):
    df = spark.createDataFrame([(bytearray([1, 2, 3, 4, 5, 6]), 2), (None, 2)], "p binary, n int")
    got = [r[0] for r in df.select(passes.mean_colour(F.col("p"), F.col("n"), F.lit(1), F.lit(0), F.lit(5), F.lit(5))).collect()]
    assert tuple(got[0]) == (4.0, 5.0, 6.0) and got[1] is None
    assert one(spark, passes.with_marks(F.lit(None).cast("string"), F.array(F.lit("CE")))) == "CE"


def test_records_round_trip(spark):
    label = fx._view(spark, SF, "part", "p_partkey label_id", "'f.png' source_file", "'' extracted_at", "200L img_w", "0L img_h", "300L dpi", "0.5D overall_confidence").where("label_id < 3")
    out = records.emitted(label, fx.full_fields(spark, SF).where("label_id < 2"))
    read = [json.loads(r["json"]) for r in out.orderBy("label_id").collect()]
    assert read[0]["elements"]["ean_barcode"] is None and set(read[0]["elements"]) >= {"product_name", "datamatrix_block", "patent_info"}
    assert read[2]["elements"]["product_name"] is None  # a label without fields
    again = records.fields(records.parsed(out))
    assert again.where("label_id = 0").count() == fx.full_fields(spark, SF).where("label_id = 0 and value is not null").count()
    assert records.parsed(spark.createDataFrame([(1, "{}"), (2, None), (3, "[")], "label_id long, json string")).where("label is not null").isEmpty()


def test_specs_and_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.json").write_text('{"template_id":\n "A"}')
    (tmp_path / "t/b.json").write_text("{nope")
    files = read_specs(spark, str(tmp_path / "t"), "template")
    assert {(r["name"], r["error"]) for r in files.collect()} == {("a", None), ("b", "PARSE_ERROR")}
    write_specs(files.where("error is null"), str(tmp_path / "new"))
    assert spark.read.text(str(tmp_path / "new")).count() > 0 and (tmp_path / "t/a.json").read_text().endswith('"A"}')
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "y.gif").write_bytes(b"GI")
    got = {r["path"][-5:]: r for r in read_files(spark, str(tmp_path / "*.*")).collect()}
    assert (got["x.pdf"]["kind"], got["x.pdf"]["upload"]["suffix"], got["y.gif"]["kind"], got["y.gif"]["upload"]["encode"]) == ("first_page", ".pdf", None, True)
    assert spec.verdict(spec.findings(spark.createDataFrame([], "kind string, name string, json string"))).first()["verdict"] == "PASSED"


def test_zone_orders(spark):
    expected = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    for shown, good in ((["a", "c"], True), (["x", "a", "b", "c"], True), (["b", "a"], False), ([], True)):
        assert one(spark, checks.zones_in_order(F.array(*map(F.lit, shown)).cast("array<string>"), expected)) == good


def test_analysis(spark):
    words, labels = fx.tags(spark, SF).drop("zone"), fx._view(spark, SF, "part", "p_partkey label_id", "4500L img_w", "300L img_h")
    every = analyze(words, fx.tag_codes(spark, SF), labels, fx.schemas(spark), fx.schema_fields(spark), fx.aliases(spark), fx.rules(spark))
    n = labels.count()
    assert every.reports.count() == every.confidence.count() == n and every.zones.count() == 8 * n and every.shortlist.count() == 5 * n
    assert every.fields.groupBy("label_id", "field_id").count().where("count > 1").isEmpty()
    assert every.type_scores.count() == n * len(fx.SCHEMAS) and not every.results.isEmpty()


def test_command(spark, tmp_path, capsys):
    tables = {"words": fx.tags(spark, SF).drop("zone"), "codes": fx.tag_codes(spark, SF), "labels": fx._view(spark, SF, "part", "p_partkey label_id", "4500L img_w", "300L img_h")}
    for name, table in tables.items():
        table.where("label_id < 3").write.parquet(str(tmp_path / name))
    paths = [str(tmp_path / name) for name in tables]
    assert command.main([*paths, "--out", str(tmp_path / "out")]) == 0
    assert read_labels(spark, str(tmp_path / "out")).where("label is not null").count() == 3
    assert command.main([*paths, "--indent", "1"]) == 0
    assert capsys.readouterr().out.count('"extraction_metadata"') == 3
    assert command.main([paths[0], str(tmp_path / "gone"), paths[2]]) == 1


def test_means_round_halves_up(spark):
    df = spark.createDataFrame([(0.0005,), (0.0006,)], "v double")
    assert one(spark, fn.mean3(F.lit(2_500_000), F.lit(5))) == 0.001 and df.agg(fn.mean3(F.sum(fn.nano(F.col("v"))), F.count("*"))).first()[0] == 0.001


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules/B1.json").write_text('{"label_type_name": "b",\n "required_fields": ["x"]}')
    (tmp_path / "rules/index.json").write_text("{}")
    (tmp_path / "rules/bad.json").write_text("{nope")
    assert [r["label_type_id"] for r in read_rules(spark, str(tmp_path / "rules")).collect()] == ["B1"]
    rows = spark.createDataFrame([("h1", "2026-01-01 00:00:00"), ("h1", "2026-01-01 00:00:01"), ("h2", "2026-01-01 00:00:02")], "file_hash string, arrived string")
    append_rows(rows, str(tmp_path / "drop"))
    append_rows(rows, str(tmp_path / "drop"))
    stream = distinct_files(arriving(spark, str(tmp_path / "drop"), "file_hash string, arrived timestamp"))
    q = stream.writeStream.format("memory").queryName("arrived_once").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["file_hash"] for r in spark.table("arrived_once").collect()) == ["h1", "h2"]


@pytest.mark.parametrize("name", ["address_block", "supplier", "plant_or_patent", "copyright_notice", "origin_ladder"])
def test_words_stay_off_the_driver(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize(("name", "other"), [("address_block", "origin_text"), ("supplier", "origin_text"), ("plant_or_patent", "origin_text"), ("copyright_notice", "origin_text"), ("origin_ladder", "supplier_name")])
def test_labels_are_dealt_out_before_their_words(spark, name, other):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("Generate stack") < plan.index("Exchange") and plan.count("Exchange") == 1  # what stands below runs first
    assert other not in plan  # fields that nobody asks for are not made


def plan_of(spark, name):
    """The windows of the executed plan and the names in the analysed one."""
    ran = catalog.queries()[name](spark, SF)._jdf.queryExecution()
    return ran.executedPlan().toString().count("Window ["), set(re.findall(r"\w+(?=#\d)", ran.analyzed().toString()))


def test_plant_or_patent_plans_nothing_of_other_fields(spark):
    windows, names = plan_of(spark, "plant_or_patent")
    assert windows == 4 and {"role_line", "plant_m", "patent_a"} <= names  # before: 7, with the lines of both zones together
    assert not names & {"ls", "notice", "block", "anchors", "supplier_a", "place_a"}


def test_origin_ladder_numbers_no_zone_apart(spark):
    windows, names = plan_of(spark, "origin_ladder")
    assert windows == 4 and "ls" in names  # before: 7, with the lines of each zone
    assert not names & {"role_line", "a_ws", "m_text", "notice"}


def test_copyright_notice_plans_the_zone_it_reads(spark):
    names = plan_of(spark, "copyright_notice")[1]
    assert {"notice", "a_text", "a_ws", "text"} <= names
    assert not names & {"m_ws", "m_ls", "m_text", "block", "anchors", "plant_m", "supplier_a"}


def test_line_groups_by_the_upper_median(spark):
    words = spark.createDataFrame([(1, 0, 0, 0, 10), (1, 1, 0, 20, 20), (1, 2, 0, 55, -1), (2, 0, 0, 0, 0), (2, 1, 0, 5, 0), (None, 0, 0, 0, 9)], "label_id int, word_idx int, x int, y int, h int")
    got = {(r["label_id"], r["word_idx"]): r["line_no"] for r in lines.line_groups(words).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (2, 0): 0, (2, 1): 1}  # gaps 14 and 4; a word without a label is in no line


def test_the_models_fields_are_not_broadcast(spark):
    plan = catalog.queries()["training_rows"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan and "rightHint=(strategy=merge)" in plan
