"""Queries over shapes, boxes, zones and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill import fixtures as fx
from tagmill.catalog.registry import add
from tagmill.fixtures import ctes
from tagmill.operators import boxes, corrections, geometry, lines, merge, rules

_SHAPE = "CASE WHEN img_h=0 THEN 'landscape' WHEN img_w::DOUBLE/img_h>1.8 THEN 'landscape' WHEN img_w::DOUBLE/img_h BETWEEN 0.85 AND 1.15 THEN 'circular' WHEN img_w::DOUBLE/img_h<0.7 THEN 'portrait' ELSE 'landscape' END"
_PAGE = ("page", "SELECT label_id, seq, x, y, w, h, 3000 AS img_w, label_id%3*500 AS img_h FROM fx_boxes")
_page = lambda s, d: fx.boxes(s, d).selectExpr("label_id", "seq", "x", "y", "w", "h", "3000L img_w", "label_id%3*500 img_h")

add("label_shape", lambda s, d: geometry.with_shape(fx.labels(s, d)), ctes(f"SELECT *, {_SHAPE} AS shape FROM fx_labels"))
add("resize", lambda s, d: geometry.resized(fx.labels(s, d)), ctes(
    "SELECT label_id, CASE WHEN img_w<2400 THEN 2400 WHEN img_w>4500 THEN 4500 ELSE img_w END AS new_w, CASE WHEN img_w<2400 THEN CAST(trunc(img_h*(2400::DOUBLE/img_w)) AS BIGINT) "
    "WHEN img_w>4500 THEN CAST(trunc(img_h*(4500::DOUBLE/img_w)) AS BIGINT) ELSE img_h END AS new_h FROM fx_labels"))  # fmt: skip
add("bbox_norm", lambda s, d: geometry.normalised(_page(s, d)), ctes(
    "SELECT label_id, seq, x::DOUBLE/img_w AS x_frac, CASE WHEN img_h<>0 THEN y::DOUBLE/img_h ELSE 0 END AS y_frac, w::DOUBLE/img_w AS w_frac, CASE WHEN img_h<>0 THEN h::DOUBLE/img_h ELSE 0 END AS h_frac FROM page", _PAGE))
add("bbox_clamp", lambda s, d: geometry.clamped(_page(s, d)), ctes(
    "SELECT label_id, seq, cx, cy, greatest(1, least(w, img_w-cx)) AS cw, greatest(1, least(h, img_h-cy)) AS ch FROM (SELECT *, greatest(0, least(x, img_w-1)) AS cx, greatest(0, least(y, img_h-1)) AS cy FROM page)", _PAGE))
add("bbox_derived", lambda s, d: geometry.derived(_page(s, d)), ctes("SELECT label_id, seq, x+w/2 AS center_x, y+h/2 AS center_y, x+w AS \"right\", y+h AS bottom FROM page", _PAGE))
add("bbox_union", lambda s, d: geometry.union_box(fx.boxes(s, d), "label_id"), ctes("SELECT label_id, min(x) AS ux, min(y) AS uy, max(x+w)-min(x) AS uw, max(y+h)-min(y) AS uh FROM fx_boxes GROUP BY label_id"))
add("reading_order", lambda s, d: geometry.reading_order(fx.boxes(s, d)), ctes("SELECT label_id, seq, x, y, row_number() OVER (PARTITION BY label_id ORDER BY y//10, x, seq, y, w, h) AS place FROM fx_boxes"))
add("grid_dedup", lambda s, d: geometry.grid_distinct(fx.boxes(s, d)), ctes(
    "SELECT label_id, seq, x, y, w, h FROM (SELECT *, row_number() OVER (PARTITION BY label_id, x//10, y//10, w//10, h//10 ORDER BY seq, x, y, w, h) AS k FROM fx_boxes) WHERE k=1"))
add("region_class", lambda s, d: geometry.regions(fx.boxes(s, d)), ctes(
    "SELECT label_id, seq, x, y, CASE WHEN r>180 AND g<80 AND b<80 THEN 'red_zone' WHEN b>150 AND r<80 AND g<120 THEN 'blue_zone' WHEN r>200 AND g>200 AND b<80 THEN 'yellow_zone' "
    "WHEN r>230 AND g>230 AND b>230 THEN 'white_zone' WHEN r<60 AND g<60 AND b<60 THEN 'black_zone' ELSE 'neutral_zone' END AS region FROM fx_boxes WHERE w*h>=2000 AND w*h<=2720000"))  # fmt: skip
add("line_kind", lambda s, d: geometry.line_kind(fx.boxes(s, d)), ctes("SELECT label_id, seq, CASE WHEN w>h THEN 'horizontal' ELSE 'vertical' END AS direction FROM fx_boxes WHERE w>=20 OR h>=20"))
add("overlap_pairs", lambda s, d: geometry.overlaps(fx.repeated_boxes(s, d), distinct=True), ctes(
    "SELECT a.label_id, a.seq AS seq1, b.seq AS seq2, (least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x))*(least(a.y+a.h,b.y+b.h)-greatest(a.y,b.y)) AS area, "
    "((least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x))*(least(a.y+a.h,b.y+b.h)-greatest(a.y,b.y)))::DOUBLE/least(a.w*a.h,b.w*b.h) AS ratio FROM fx_boxes a JOIN fx_boxes b ON a.label_id=b.label_id AND a.seq<b.seq "
    "AND a.x<b.x+b.w AND b.x<a.x+a.w AND a.y<b.y+b.h AND b.y<a.y+a.h"))  # fmt: skip


def _zone_case(name: str, at: str) -> str:
    start, out = 0.0, "CASE"
    for zone, end in geometry.ZONES[name]:
        out += f" WHEN {at}>={start}::DOUBLE AND {at}<{end}::DOUBLE THEN '{zone}'"
        start = end
    return f"{out} ELSE '{geometry.ZONES[name][-1][0]}' END"


_ZONED = ("zoned", f"SELECT w.*, CASE l.shape WHEN 'landscape' THEN {_zone_case('landscape', '((x+w/2)/img_w)')} WHEN 'portrait' THEN {_zone_case('portrait', '((y+h/2)/img_h)')} "
          f"ELSE {_zone_case('circular', '((y+h/2)/img_h)')} END AS zone FROM fx_words w JOIN (SELECT *, {_SHAPE} AS shape FROM fx_labels) l USING (label_id)")  # fmt: skip
_zoned = lambda s, d: geometry.zoned(fx.words(s, d), fx.labels(s, d))
add("zone_assign", lambda s, d: _zoned(s, d).select("label_id", "word_idx", "zone"), ctes("SELECT label_id, word_idx, zone FROM zoned", _ZONED))


def grouped(source: str, name: str, *by: str) -> list[tuple[str, str]]:
    """CTEs that number the lines of a table of words within its groups: gaps_, numbered_, lines_ and texts_ with the name."""
    keys = ", ".join(by or ("label_id",))
    return [
        (f"gaps_{name}", f"SELECT {keys}, hs[len(hs)//2+1] AS median_h, coalesce(greatest(4, floor(hs[len(hs)//2+1]*0.7::DOUBLE)::BIGINT), 8) AS gap FROM (SELECT {keys}, list_sort(list(h) FILTER (h>0)) AS hs FROM {source} GROUP BY ALL)"),
        (f"numbered_{name}", f"SELECT *, sum(opened) OVER (PARTITION BY {keys} ORDER BY y, x, word_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS line_no FROM (SELECT w.*, CASE WHEN y > max(y+h) OVER "
         f"(PARTITION BY {keys} ORDER BY y, x, word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)+gap THEN 1 ELSE 0 END AS opened FROM {source} w JOIN gaps_{name} USING ({keys}))"),
        (f"lines_{name}", f"SELECT {keys}, line_no, string_agg(text, ' ' ORDER BY x, y, word_idx) AS line FROM numbered_{name} GROUP BY ALL"),
        (f"texts_{name}", f"SELECT {keys}, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines_{name} GROUP BY ALL"),
    ]


_ALL = grouped("fx_words", "all")
add("upper_median", lambda s, d: lines.line_gap(fx.words(s, d)), ctes("SELECT label_id, median_h, gap FROM gaps_all", *_ALL))
add("line_group", lambda s, d: lines.line_groups(fx.words(s, d)).select("label_id", "word_idx", "line_no"), ctes("SELECT label_id, word_idx, line_no FROM numbered_all", *_ALL))
add("line_text", lambda s, d: lines.line_texts(fx.words(s, d)), ctes("SELECT * FROM lines_all", *_ALL))
add("conf_gate", lambda s, d: lines.gated(fx.words(s, d)).select("label_id", "word_idx"), ctes("SELECT label_id, word_idx FROM fx_words WHERE conf>=0.25 OR conf=1"))
add("first_match", lambda s, d: lines.first_match(fx.words(s, d), fx.labels(s, d).selectExpr("label_id", "case label_id%3 when 0 then 'the' when 1 then 'de' else 'er' end target")), ctes(
    "SELECT label_id, target, word_idx, text FROM (SELECT w.label_id, target, word_idx, text, row_number() OVER (PARTITION BY w.label_id ORDER BY word_idx) AS k FROM fx_words w JOIN "
    "(SELECT label_id, CASE label_id%3 WHEN 0 THEN 'the' WHEN 1 THEN 'de' ELSE 'er' END AS target FROM fx_labels) USING (label_id) WHERE contains(text, target) OR contains(target, text)) WHERE k=1"))  # fmt: skip

add("words_text", lambda s, d: lines.texts(fx.words(s, d)).select("label_id", "text"), ctes("SELECT * FROM texts_all", *_ALL))
_BY_ZONE = grouped("zoned", "zone", "label_id", "zone")
_ZONE_LISTS = "CASE shape " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(z) for z, _ in v)}, 'unknown']" for k, v in geometry.ZONES.items()) + " END"
add("zone_summary", lambda s, d: lines.zone_summary(_zoned(s, d), fx.labels(s, d)).withColumn("raw_lines", F.array_join("raw_lines", "\n")), ctes(
    f"SELECT l.label_id, l.zone, coalesce(t.text,'') AS raw_lines, coalesce(n,0) AS word_count, coalesce(floor((hundredths*20+n)::DOUBLE/(n*2))/1000,0) AS avg_confidence FROM (SELECT label_id, unnest({_ZONE_LISTS}) AS zone FROM (SELECT *, {_SHAPE} AS shape FROM fx_labels)) l "
    "LEFT JOIN texts_zone t USING (label_id, zone) LEFT JOIN (SELECT label_id, zone, count(*) AS n, sum(round(conf*100)::BIGINT)::BIGINT AS hundredths FROM zoned GROUP BY ALL) c USING (label_id, zone)", _ZONED, *_BY_ZONE))  # fmt: skip
_scored = lambda s, d: fx.words(s, d).selectExpr("label_id", "word_idx", "case when word_idx%11=0 then ' ' else text end text", "x", "w", "cast(conf*100 as int) score")
_SCORED = ("scored", "SELECT label_id, word_idx, CASE WHEN word_idx%11=0 THEN ' ' ELSE text END AS text, x, w, trunc(conf*100)::INT AS score FROM fx_words")
add("engine_gate", lambda s, d: lines.engine_gate(_scored(s, d)).select("label_id", "word_idx"), ctes("SELECT label_id, word_idx FROM scored WHERE score>=10 AND trim(text)<>''", _SCORED))
_ACROSS = "((x+w/2)/2400::DOUBLE)"
add("zone_across", lambda s, d: fx.words(s, d).select("label_id", "word_idx", geometry.zone_across((F.col("x") - 300 + F.col("w") / 2) / 2400).alias("zone")), ctes(
    f"SELECT label_id, word_idx, CASE WHEN x-300+w/2<0 THEN 'left_identity' ELSE {_zone_case('landscape', '((x-300+w/2)/2400::DOUBLE)')} END AS zone FROM fx_words"))
add("engine_zones", lambda s, d: geometry.engine_zones(_scored(s, d), F.lit(2400)).withColumn("raw_lines", F.array_join("raw_lines", " ")), ctes(
    f"SELECT l.label_id, l.zone, coalesce(listed,'') AS raw_lines, coalesce(n,0) AS word_count, coalesce(total::DOUBLE/(n*100),0) AS avg_confidence FROM (SELECT DISTINCT label_id, unnest([{', '.join(repr(z) for z, _ in geometry.ZONES['landscape'])}, 'unknown']) AS zone FROM scored) l "
    f"LEFT JOIN (SELECT label_id, {_zone_case('landscape', _ACROSS)} AS zone, string_agg(trim(text), ' ' ORDER BY word_idx) AS listed, count(*) AS n, sum(score)::BIGINT AS total FROM scored WHERE score>=5 AND trim(text)<>'' GROUP BY ALL) c USING (label_id, zone)", _SCORED))  # fmt: skip
add("sparse_zones", lambda s, d: lines.sparse_zones(_zoned(s, d), 40), ctes("SELECT label_id, zone, count(*) AS n FROM zoned GROUP BY ALL HAVING count(*)<40", _ZONED))
add("sized_words", lambda s, d: boxes.sized_words(fx.words(s, d).selectExpr("label_id", "word_idx", "x", "y", "w", "h-12 h")), ctes("SELECT label_id, word_idx, x, y, w, h-12 AS h FROM fx_words WHERE h-12>0 AND w>0"))
add("region_boxes", lambda s, d: boxes.region_boxes(fx.boxes(s, d).selectExpr("label_id", "seq", "x", "y", "w", "h-11 h", "case when seq%3=0 then 'line' else 'region' end type")), ctes(
    "SELECT label_id, seq, x, y, w, h-11 AS h FROM fx_boxes WHERE seq%3<>0 AND h-11>0"))

_polygon = "array(array(x*1.5D,y*1.25D),array(x+w*0.3D,y-2.5D),array(x+w+0.9D,y+h*0.2D),array(x-0.7D,y+h+0.0D)) polygon"
add("polygon_box", lambda s, d: fx.boxes(s, d).selectExpr("label_id", "seq", "x", "y", "w", "h", _polygon).select("label_id", "seq", "x", "y", geometry.polygon_box(F.col("polygon")).alias("p")).selectExpr("label_id", "seq", "x x0", "y y0", "p.*"), ctes(
    "SELECT label_id, seq, x0, y0, trunc(lx)::BIGINT AS x, trunc(ly)::BIGINT AS y, greatest(1, trunc(hx-trunc(lx))::BIGINT) AS w, greatest(1, trunc(hy-trunc(ly))::BIGINT) AS h FROM (SELECT label_id, seq, x AS x0, y AS y0, "
    "least(x*1.5::DOUBLE, x+w*0.3::DOUBLE, x+w+0.9::DOUBLE, x-0.7::DOUBLE) AS lx, greatest(x*1.5::DOUBLE, x+w*0.3::DOUBLE, x+w+0.9::DOUBLE, x-0.7::DOUBLE) AS hx, "
    "least(y*1.25::DOUBLE, y-2.5::DOUBLE, y+h*0.2::DOUBLE, y+h+0.0::DOUBLE) AS ly, greatest(y*1.25::DOUBLE, y-2.5::DOUBLE, y+h*0.2::DOUBLE, y+h+0.0::DOUBLE) AS hy FROM fx_boxes)"))  # fmt: skip
_pct = lambda s, d: fx.boxes(s, d).selectExpr("label_id", "seq", "x", "y", "cast(x%130-10 as double) lp", "cast(y%110 as double) tp", "w/4D wp", "h/50D hp")
add("percent_box", lambda s, d: _pct(s, d).select("label_id", "seq", "x", "y", corrections.from_percents(F.lit(3000), F.lit(900), *(F.col(c) for c in ("lp", "tp", "wp", "hp"))).alias("p")).selectExpr("label_id", "seq", "x x0", "y y0", "p.*"), ctes(
    "SELECT label_id, seq, x0, y0, x, y, least(greatest(1, trunc(3000*wp/100))::BIGINT, 3000-x) AS w, least(greatest(1, trunc(900*hp/100))::BIGINT, 900-y) AS h FROM (SELECT label_id, seq, x AS x0, y AS y0, w/4::DOUBLE AS wp, h/50::DOUBLE AS hp, "
    "trunc(greatest(0, least(2999, 3000*(x%130-10)::DOUBLE/100)))::BIGINT AS x, trunc(greatest(0, least(899, 900*(y%110)::DOUBLE/100)))::BIGINT AS y FROM fx_boxes)"))  # fmt: skip
_two = lambda s, d: fx.boxes(s, d).selectExpr("label_id", "seq", "x", "y", "case when seq%3<>0 then struct(x,y,w,case when seq%5=0 then 0L else h end h) end a", "case when seq%2=0 then struct(x+1 x,y+1 y,w,h) end b")
add("box_percents", lambda s, d: _two(s, d).select("label_id", "seq", "x", "y", corrections.percents(F.lit(3000), F.lit(900), F.col("a"), F.col("b")).alias("p")).select("label_id", "seq", "x", "y", "p.*"), ctes(
    "SELECT label_id, seq, x, y, CASE k WHEN 1 THEN 100::DOUBLE*x/3000 WHEN 2 THEN 100::DOUBLE*(x+1)/3000 ELSE 2 END AS left_pct, CASE k WHEN 1 THEN 100::DOUBLE*y/900 WHEN 2 THEN 100::DOUBLE*(y+1)/900 ELSE 2 END AS top_pct, "
    "CASE k WHEN 0 THEN 18 ELSE 100::DOUBLE*w/3000 END AS w_pct, CASE k WHEN 0 THEN 6 ELSE 100::DOUBLE*h/900 END AS h_pct FROM (SELECT *, CASE WHEN seq%3<>0 AND seq%5<>0 THEN 1 WHEN seq%2=0 THEN 2 ELSE 0 END AS k FROM fx_boxes)"))  # fmt: skip

# zones anchored to the codes
_anchors = lambda s, d: fx.labels(s, d).selectExpr("label_id", "img_w", "img_h", "case when label_id%3<>0 then struct(300+label_id%400 x) end itf", "case when label_id%4<>1 then struct(700+label_id%600 x, 200+label_id%300 w) end dm")
_own = lambda s, d: geometry.calibrated(_anchors(s, d), F.col("itf"), F.col("dm"))
_OWN = ("own", "SELECT label_id, img_w, img_h, shape, CASE WHEN shape='landscape' AND l IS NOT NULL AND m IS NOT NULL THEN [{'name':'left_identity','start':0::DOUBLE,'end':least(greatest(l*0.85::DOUBLE,least(0.18::DOUBLE,l-0.01::DOUBLE)),l-0.005::DOUBLE)},"
        "{'name':'center_barcode','start':l*0.85::DOUBLE,'end':m-0.01::DOUBLE},{'name':'center_datamatrix','start':m-0.01::DOUBLE,'end':r},{'name':'center_address','start':r,'end':0.72::DOUBLE},{'name':'right_compliance','start':0.72::DOUBLE,'end':0.84::DOUBLE},"
        "{'name':'right_date','start':0.84::DOUBLE,'end':0.95::DOUBLE},{'name':'right_copy_count','start':0.95::DOUBLE,'end':1::DOUBLE}] " + " ".join(
            f"WHEN shape='{k}' THEN [" + ",".join(f"{{'name':'{n}','start':{a}::DOUBLE,'end':{b}::DOUBLE}}" for a, (n, b) in zip((0, *(e for _, e in v)), v, strict=False)) + "]" for k, v in geometry.ZONES.items())
        + f" END AS zones FROM (SELECT *, {_SHAPE} AS shape, CASE WHEN label_id%3<>0 THEN (300+label_id%400)/img_w::DOUBLE END AS l, CASE WHEN label_id%4<>1 THEN (700+label_id%600)/img_w::DOUBLE END AS m, "
        "least((700+label_id%600+200+label_id%300)/img_w::DOUBLE+0.12::DOUBLE, 0.58::DOUBLE) AS r FROM fx_labels)")  # fmt: skip
add("zone_calibration", lambda s, d: _own(s, d).select("label_id", F.posexplode("zones").alias("ord", "z")).select("label_id", "ord", "z.name", F.round("z.start", 9).alias("f0"), F.round("z.end", 9).alias("f1")), ctes(
    "SELECT label_id, generate_subscripts(zones,1)::INT-1 AS ord, unnest(zones).name AS name, round(unnest(zones).start,9) AS f0, round(unnest(zones).end,9) AS f1 FROM own", _OWN))
add("zone_by_anchors", lambda s, d: geometry.zoned_by(fx.words(s, d), _own(s, d)).select("label_id", "word_idx", "zone"), ctes(
    "SELECT label_id, word_idx, coalesce(list_filter(zones, lambda z: z.start<=c AND c<z.end)[1].name, zones[-1].name) AS zone FROM (SELECT w.label_id, word_idx, zones, CASE WHEN shape='landscape' THEN (x+w/2)/img_w ELSE (y+h/2)/img_h END AS c FROM fx_words w JOIN own USING (label_id))", _OWN))

# reports on overlaps
_OVERLAPS = ("pairs", "SELECT label_id, ratio FROM (SELECT a.label_id, ((least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x))*(least(a.y+a.h,b.y+b.h)-greatest(a.y,b.y)))::DOUBLE/least(a.w*a.h,b.w*b.h) AS ratio FROM fx_boxes a JOIN fx_boxes b ON a.label_id=b.label_id AND a.seq<b.seq "
             "AND a.x<b.x+b.w AND b.x<a.x+a.w AND a.y<b.y+b.h AND b.y<a.y+a.h) WHERE ratio>=0.05::DOUBLE")  # fmt: skip
add("overlap_report", lambda s, d: rules.report_counts(geometry.overlap_issues(geometry.overlaps(fx.boxes(s, d)))), ctes(
    "SELECT label_id, count(*) FILTER (ratio>=0.25) AS n_error, count(*) FILTER (ratio<0.25) AS n_warning FROM pairs GROUP BY label_id", _OVERLAPS))

# greedy merges: the order of words decides, so there is no SQL form
_engines = lambda s, d: fx.words(s, d).selectExpr("label_id", "case word_idx%2 when 0 then 'one' else 'two' end engine", "word_idx%2 rank", "word_idx", "text", "cast(x-(word_idx%2)*215 as double) cx", "cast(y as double) cy", "conf")
add("merge_words", lambda s, d: merge.merged_words(_engines(s, d)))
add("dedup_words", lambda s, d: merge.deduplicated(_engines(s, d)))
_passes = lambda s, d: _zoned(s, d).selectExpr("label_id", "element_at(array('first','whole','zones','strip','second','file'), cast((word_idx*7+label_id)%6+1 as int)) pass", "concat('e',word_idx%3) engine", "word_idx", "text", "cast(x-(word_idx%4)*210 as double) cx", "cast(y as double) cy", "conf", "zone")
add("pass_order", lambda s, d: merge.in_pass_order(_passes(s, d)))
