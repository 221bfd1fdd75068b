"""Boxes, shapes, zones and regions."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Zone name and the end of its half-open share of the axis, in order; each zone starts where the last ended.
ZONES = {
    "landscape": (("left_identity", 0.18), ("center_barcode", 0.40), ("center_datamatrix", 0.58), ("center_address", 0.72), ("right_compliance", 0.84), ("right_date", 0.95), ("right_copy_count", 1.0)),
    "portrait": (("top_identity", 0.28), ("mid_barcode", 0.55), ("mid_address", 0.75), ("bot_compliance", 0.90), ("bot_date", 1.0)),
    "circular": (("circle_top", 0.33), ("circle_mid", 0.67), ("circle_bot", 1.0)),
}


def shape(w: Column, h: Column) -> Column:
    """landscape, circular or portrait by the aspect ratio; landscape where the height is 0."""
    ratio = w / h
    return F.when(h == 0, "landscape").when(ratio > 1.8, "landscape").when(ratio.between(0.85, 1.15), "circular").when(ratio < 0.7, "portrait").otherwise("landscape")


def with_shape(labels: DataFrame) -> DataFrame:
    return labels.withColumn("shape", shape(F.col("img_w"), F.col("img_h")))


def resized(labels: DataFrame, least: int = 2400, most: int = 4500) -> DataFrame:
    """Raster sizes clamped to the allowed widths, heights truncated in proportion."""
    target = F.when(F.col("img_w") < least, least).when(F.col("img_w") > most, most)
    return labels.select("label_id", F.coalesce(target, "img_w").cast("long").alias("new_w"), F.coalesce((F.col("img_h") * (target / F.col("img_w"))).cast("long"), "img_h").alias("new_h"))


def normalised(boxes: DataFrame) -> DataFrame:
    """Fractions of the image; 0 where a dimension is 0."""
    share = lambda c, d: F.when(F.col(d) != 0, F.col(c) / F.col(d)).otherwise(0.0).alias(f"{c}_frac")
    return boxes.select("label_id", "seq", share("x", "img_w"), share("y", "img_h"), share("w", "img_w"), share("h", "img_h"))


def clamped(boxes: DataFrame) -> DataFrame:
    """Boxes cut to the image, at least one pixel wide and high."""
    inside = lambda c, d: F.greatest(F.lit(0), F.least(F.col(c), F.col(d) - 1))
    rest = lambda c, at, d: F.greatest(F.lit(1), F.least(F.col(c), F.col(d) - F.col(at)))
    moved = boxes.withColumns({"cx": inside("x", "img_w"), "cy": inside("y", "img_h")})
    return moved.select("label_id", "seq", "cx", "cy", rest("w", "cx", "img_w").alias("cw"), rest("h", "cy", "img_h").alias("ch"))


def derived(boxes: DataFrame) -> DataFrame:
    return boxes.select("label_id", "seq", (F.col("x") + F.col("w") / 2).alias("center_x"), (F.col("y") + F.col("h") / 2).alias("center_y"), (F.col("x") + F.col("w")).alias("right"), (F.col("y") + F.col("h")).alias("bottom"))


def union_box(boxes: DataFrame, *by: str) -> DataFrame:
    """The box around all boxes of a group."""
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return boxes.groupBy(*by).agg(F.min("x").alias("ux"), F.min("y").alias("uy"), (right - F.min("x")).alias("uw"), (bottom - F.min("y")).alias("uh"))


def _zone(shape_name: str, at: Column) -> Column:
    """First zone that holds the share; the last one where none does. A chain of conditions instead of a range join."""
    out = F.when((at >= 0) & (at < ZONES[shape_name][0][1]), ZONES[shape_name][0][0])
    for (_, start), (name, end) in zip(ZONES[shape_name], ZONES[shape_name][1:], strict=False):
        out = out.when((at >= start) & (at < end), name)
    return out.otherwise(ZONES[shape_name][-1][0])


def zoned(words: DataFrame, labels: DataFrame) -> DataFrame:
    """words with the zone of their centre, along x on landscape labels, else along y."""
    rows = words.join(with_shape(labels), "label_id")
    across, down = (F.col("x") + F.col("w") / 2) / F.col("img_w"), (F.col("y") + F.col("h") / 2) / F.col("img_h")
    zone = F.when(F.col("shape") == "landscape", _zone("landscape", across)).when(F.col("shape") == "portrait", _zone("portrait", down)).otherwise(_zone("circular", down))
    return rows.withColumn("zone", zone).select(*words.columns, "zone")


def reading_order(boxes: DataFrame) -> DataFrame:
    """seq's place by rows of 10 pixels, then x."""
    order = Window.partitionBy("label_id").orderBy(F.floor(F.col("y") / 10), "x", "seq", "y", "w", "h")
    return boxes.select("label_id", "seq", "x", "y", F.row_number().over(order).cast("long").alias("place"))


def grid_distinct(boxes: DataFrame) -> DataFrame:
    """The first box of each 10 pixel grid cell of place and size: a struct minimum, so no group is sorted or collected."""
    cell = [F.floor(F.col(c) / 10).alias(f"g{c}") for c in ("x", "y", "w", "h")]
    first = boxes.groupBy("label_id", *cell).agg(F.min(F.struct("seq", "x", "y", "w", "h")).alias("f"))
    return first.select("label_id", "f.*")


def region_class(b: Column, g: Column, r: Column) -> Column:
    return (
        F.when((r > 180) & (g < 80) & (b < 80), "red_zone").when((b > 150) & (r < 80) & (g < 120), "blue_zone").when((r > 200) & (g > 200) & (b < 80), "yellow_zone")
        .when((r > 230) & (g > 230) & (b > 230), "white_zone").when((r < 60) & (g < 60) & (b < 60), "black_zone").otherwise("neutral_zone")
    )


def regions(boxes: DataFrame, page: int = 3200 * 1000) -> DataFrame:
    """Regions of a sensible area with their colour class."""
    area = F.col("w") * F.col("h")
    return boxes.where((area >= 2000) & (area <= 0.85 * page)).select("label_id", "seq", "x", "y", region_class(F.col("b"), F.col("g"), F.col("r")).alias("region"))


def _packed(boxes: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """boxes with their whole numbers in two longs for a shuffle; and what gives seq, x, y, w and h again.

    Places and sizes have 14 bits, up to three other columns 8 bits each and seq 48 bits. Where a value has no room, `_wide` holds the
    columns as they are and the longs are 0, so equal boxes stay equal and no others become so. Those five must not be null.
    """
    types = dict(boxes.dtypes)
    whole = [c for c in boxes.columns if types[c] in ("tinyint", "smallint", "int", "bigint") and c.isidentifier() and c not in ("label_id", "cx", "cy")]
    small = [c for c in whole if c not in ("seq", *"xywh")][:3]
    words = {"_p0": dict.fromkeys("xywh", 14) | dict.fromkeys(small[2:], 8), "_p1": dict.fromkeys(small[:2], 8) | {"seq": 48}}
    put = [(p, c, n, at) for p, word in words.items() for (c, n), at in zip(word.items(), accumulate(word.values(), initial=0), strict=False)]
    names = [c for _, c, *_ in put]
    if not set(names) <= set(whole):
        return boxes, {}
    none = F.lit(0).cast("long")
    fits = reduce(Column.__and__, (F.coalesce(F.col(c).between(0, (1 << n) - 1), F.lit(False)) for _, c, n, _ in put))
    longs = {p: reduce(Column.bitwiseOR, (F.shiftleft(F.col(c).cast("long"), at) for of, c, _, at in put if of == p)) for p in words}
    rows = boxes.withColumns({p: F.when(fits, x).otherwise(none) for p, x in longs.items()} | {"_wide": F.when(~fits, F.struct(*names))}).drop(*names)
    part = lambda p, n, at: F.shiftrightunsigned(F.coalesce(p, none), at).bitwiseAND(F.lit((1 << n) - 1))  # noqa: E731  # never null, so no filter for nulls is made of it
    return rows, {c: F.coalesce(F.col("_wide")[c], part(p, n, at).cast(types[c])) for p, c, n, at in put if c not in small}


def overlaps(boxes: DataFrame, cell: int = 512, distinct: bool = False) -> DataFrame:
    """Pairs of one label's boxes that overlap, with the share of the smaller one (documented only by the original).

    Boxes meet in the cells of a grid that they touch, so a label with very many boxes is no single task; a pair counts in
    the cell of its overlap's corner alone. distinct: boxes that are equal in all columns count once; they are dealt to their
    cells first, packed, and meet their equals there, so both sides of the join share one shuffle (a cell is then one task).
    """
    span = lambda at, size: F.sequence(F.floor(F.col(at) / cell), F.floor((F.col(at) + F.greatest(F.col(size) - 1, F.lit(0))) / cell))
    rows = boxes.where(" and ".join(f"{c} is not null" for c in ("seq", *"xywh"))) if distinct else boxes.select("label_id", "seq", "x", "y", "w", "h")
    listed = rows.withColumn("cx", F.explode(span("x", "w"))).withColumn("cy", F.explode(span("y", "h")))
    if distinct:
        listed, columns = _packed(listed)
        listed = listed.repartition(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "label_id", "cx", "cy").distinct().withColumns(columns)
    one, two = (listed.select("label_id", "cx", "cy", *(F.col(c).alias(f"{c}{k}") for c in ("seq", "x", "y", "w", "h"))) for k in (1, 2))
    both = one.join(two, ["label_id", "cx", "cy"]).where("seq1 < seq2 and x1 < x2 + w2 and x2 < x1 + w1 and y1 < y2 + h2 and y2 < y1 + h1")
    both = both.where((F.floor(F.greatest("x1", "x2") / cell) == F.col("cx")) & (F.floor(F.greatest("y1", "y2") / cell) == F.col("cy")))
    across = F.least(F.col("x1") + F.col("w1"), F.col("x2") + F.col("w2")) - F.greatest("x1", "x2")
    down = F.least(F.col("y1") + F.col("h1"), F.col("y2") + F.col("h2")) - F.greatest("y1", "y2")
    smaller = F.least(F.col("w1") * F.col("h1"), F.col("w2") * F.col("h2"))
    return both.select("label_id", "seq1", "seq2", (across * down).alias("area"), ((across * down) / smaller).alias("ratio"))


def overlap_issues(pairs: DataFrame) -> DataFrame:
    """Overlaps worth a report: a twentieth of the smaller box is a warning, a quarter an error (documented only by the original)."""
    return pairs.where(F.col("ratio") >= 0.05).withColumn("severity", F.when(F.col("ratio") >= 0.25, "error").otherwise("warning"))


def line_kind(lines: DataFrame) -> DataFrame:
    """Strokes of 20 pixels or more, horizontal or vertical by the longer side."""
    return lines.where((F.col("w") >= 20) | (F.col("h") >= 20)).select("label_id", "seq", F.when(F.col("w") > F.col("h"), "horizontal").otherwise("vertical").alias("direction"))


def polygon_box(polygon: Column) -> Column:
    """STRUCT x, y, w, h around a polygon (array of [x, y]), in whole pixels, one at least each way."""
    side = lambda k: F.transform(polygon, lambda p: F.get(p, F.lit(k)))
    xs, ys = side(0), side(1)
    x, y = F.array_min(xs).cast("long"), F.array_min(ys).cast("long")
    size = lambda of, at: F.greatest(F.lit(1), (F.array_max(of) - at).cast("long"))
    return F.struct(x.alias("x"), y.alias("y"), size(xs, x).alias("w"), size(ys, y).alias("h"))


def line_direction(dx: Column, dy: Column) -> Column:
    """horizontal or vertical by the longer side; null for strokes too short both ways."""
    return F.when((dx >= 20) | (dy >= 20), F.when(dx > dy, "horizontal").otherwise("vertical"))


def calibrated(labels: DataFrame, itf: Column, matrix: Column) -> DataFrame:
    """labels (label_id, img_w, img_h) with shape and zones (name, start, end): where a wide label shows both codes, its zones are anchored to them.

    itf and matrix are the codes' boxes, null where there is none. Anchored zones may overlap; the first one counts.
    """
    zone = lambda name, start, end: F.struct(F.lit(name).alias("name"), start.cast("double").alias("start"), end.cast("double").alias("end"))

    def fixed(shape_name: str) -> Column:
        starts = (0.0, *(end for _, end in ZONES[shape_name]))
        return F.array(*(zone(n, F.lit(a), F.lit(b)) for a, (n, b) in zip(starts, ZONES[shape_name], strict=False)))

    width = F.col("img_w")
    left, middle = itf["x"] / width, matrix["x"] / width
    right = F.least((matrix["x"] + matrix["w"]) / width + 0.12, F.lit(0.58))
    end = F.least(F.greatest(left * 0.85, F.least(F.lit(0.18), left - 0.01)), left - 0.005)
    lit = F.lit
    anchored = F.array(
        zone("left_identity", lit(0.0), end), zone("center_barcode", left * 0.85, middle - 0.01), zone("center_datamatrix", middle - 0.01, right), zone("center_address", right, lit(0.72)),
        zone("right_compliance", lit(0.72), lit(0.84)), zone("right_date", lit(0.84), lit(0.95)), zone("right_copy_count", lit(0.95), lit(1.0)),
    )
    zones = F.when((F.col("shape") == "landscape") & itf.isNotNull() & matrix.isNotNull(), anchored).when(F.col("shape") == "landscape", fixed("landscape"))
    return with_shape(labels).withColumn("zones", zones.when(F.col("shape") == "portrait", fixed("portrait")).otherwise(fixed("circular")))


def zoned_by(words: DataFrame, labels: DataFrame) -> DataFrame:
    """words with the first of their label's own zones that holds their centre, else its last; labels as calibrated() gives them."""
    rows = words.join(labels.select("label_id", "img_w", "img_h", "shape", "zones"), "label_id")
    across, down = (F.col("x") + F.col("w") / 2) / F.col("img_w"), (F.col("y") + F.col("h") / 2) / F.col("img_h")
    at = F.when(F.col("shape") == "landscape", across).otherwise(down)
    inside = F.filter("zones", lambda z: (z["start"] <= at) & (at < z["end"]))
    return rows.select(*words.columns, F.coalesce(F.get(inside, F.lit(0)), F.element_at("zones", -1))["name"].alias("zone"))


def zone_across(share: Column) -> Column:
    """The wide labels' zone at a share of the width; the first one before the beginning, else the last."""
    return F.when(share < 0, ZONES["landscape"][0][0]).otherwise(_zone("landscape", share))


def engine_zones(words: DataFrame, width: Column, least: int = 5) -> DataFrame:
    """Words of an engine (word_idx, text, score to 100, x, w) by the zone across the width: a row per zone and for `unknown`, with its words and mean confidence as it is."""
    kept = words.where((F.col("score") >= least) & (F.trim("text") != "")).withColumn("zone", zone_across((F.col("x") + F.col("w") / 2) / width))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("word_idx", F.trim("text").alias("text")))), lambda w: w["text"])
    found = kept.groupBy("label_id", "zone").agg(listed.alias("raw_lines"), F.count("*").alias("word_count"), (F.sum("score") / (F.count("*") * 100)).alias("avg_confidence"))
    names = F.array(*(F.lit(z) for z, _ in ZONES["landscape"]), F.lit("unknown"))
    every = words.select("label_id").distinct().select("label_id", F.explode(names).alias("zone"))
    return every.join(found, ["label_id", "zone"], "left").select(
        "label_id", "zone", F.coalesce("raw_lines", F.array().cast("array<string>")).alias("raw_lines"), F.coalesce("word_count", F.lit(0)).alias("word_count"), F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence")
    )
