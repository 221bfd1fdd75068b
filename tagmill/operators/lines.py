"""Words to lines, texts and zone summaries.

A group's gap is made of its heights alone, once a group by a window, so lines and what is made of them need one shuffle by
the group and no join. A group is the words of one label or of one of its zones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.functions import mean3, nano
from tagmill.operators.geometry import ZONES, with_shape


def _gap(median: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(4), F.floor(median * 0.7)), F.lit(8)).cast("long")


def line_gap(words: DataFrame, *by: str) -> DataFrame:
    """Per group: the upper median of positive heights and the gap that opens a new line."""
    by = by or ("label_id",)
    ordered = F.array_sort(F.filter("hs", lambda h: h > 0))
    median = F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))
    return words.groupBy(*by).agg(F.collect_list("h").alias("hs")).select(*by, median.alias("median_h"), _gap(median).alias("gap"))


def line_groups(words: DataFrame, *by: str) -> DataFrame:
    """words with line_no from 0: a word opens a line if its top is under all earlier bottoms by more than the gap. Words without a group are left out.

    The upper median is the discrete one from the top. Windows of one group share a shuffle and a sort.
    """
    by = by or ("label_id",)
    group, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("y", "x", "word_idx")
    rows = words.dropna(subset=list(by)).withColumn("line_above", F.max(F.col("y") + F.col("h")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("line_gap", _gap(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN h > 0 THEN h END DESC)").over(group)))
    rows = rows.withColumn("opened", F.when(F.col("y") > F.col("line_above") + F.col("line_gap"), 1).otherwise(0))
    return rows.withColumn("line_no", F.sum("opened").over(order.rowsBetween(Window.unboundedPreceding, 0))).select(*words.columns, "line_no")


def line_words(words: DataFrame, *by: str) -> DataFrame:
    """A row per line: ws, its words by x."""
    by = by or ("label_id",)
    ordered = F.array_sort(F.collect_list(F.struct("x", "y", "word_idx", "text", "w", "h", "conf")))
    return line_groups(words, *by).groupBy(*by, "line_no").agg(ordered.alias("ws"))


def line_texts(words: DataFrame, *by: str) -> DataFrame:
    """A row per line, its words by x."""
    by = by or ("label_id",)
    return line_words(words, *by).select(*by, "line_no", F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("line"))


def joined(placed: Column) -> tuple[Column, Column]:
    """lines and text of words placed by line and x: structs that begin with line_no."""
    joint = lambda w, i: F.when(i == 0, "").when(w["line_no"] != F.get(placed, i - 1)["line_no"], "\n").otherwise(" ")
    text = F.array_join(F.transform(placed, lambda w, i: F.concat(joint(w, i), w["text"])), "")
    number = F.sequence(F.lit(0).cast("long"), F.array_max(F.transform(placed, lambda w: w["line_no"])))
    lines = F.transform(number, lambda k: F.array_join(F.transform(F.filter(placed, lambda w: w["line_no"] == k), lambda w: w["text"]), " "))
    return lines, text


def texts(words: DataFrame, *by: str) -> DataFrame:
    """A row per group: ws (its words as listed), lines (words by line and x), text (lines joined)."""
    by = by or ("label_id",)
    word = F.struct("word_idx", "text", "x", "y", "w", "h", "conf")
    placed = F.struct("line_no", "x", "y", "word_idx", "text")
    rows = line_groups(words, *by).groupBy(*by).agg(F.array_sort(F.collect_list(word)).alias("ws"), F.array_sort(F.collect_list(placed)).alias("ls"))
    lines, text = joined(F.col("ls"))
    return rows.select(*by, "ws", lines.alias("lines"), text.alias("text"))


def gated(words: DataFrame, least: float = 0.25) -> DataFrame:
    """Words sure enough for matching."""
    return words.where((F.col("conf") >= least) | (F.col("conf") == 1.0))


def engine_gate(words: DataFrame, least: int = 10) -> DataFrame:
    """Words of an engine that scores to 100: those with text and a score of at least `least`."""
    return words.where((F.col("score") >= least) & (F.trim("text") != ""))


def sparse_zones(words: DataFrame, least: int = 3) -> DataFrame:
    """label_id, zone, n for the zones with fewer words than `least`."""
    return words.groupBy("label_id", "zone").agg(F.count("*").alias("n")).where(F.col("n") < least)


def zone_summary(words: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each zone of a label's shape and for `unknown`, words or not: raw_lines, word_count, avg_confidence (0 without words)."""
    name = lambda s: F.array(*(F.lit(z) for z, _ in ZONES[s]), F.lit("unknown"))
    zones = F.when(F.col("shape") == "landscape", name("landscape")).when(F.col("shape") == "portrait", name("portrait")).otherwise(name("circular"))
    every = with_shape(labels).select("label_id", F.explode(zones).alias("zone"))
    lines = line_words(words, "label_id", "zone")
    line = F.struct("line_no", F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("line"))
    conf = F.aggregate("ws", F.lit(0).cast("long"), lambda total, w: total + nano(w["conf"]))
    found = lines.groupBy("label_id", "zone").agg(F.array_sort(F.collect_list(line)).alias("ls"), F.sum(F.size("ws")).alias("n"), F.sum(conf).alias("total"))
    found = found.select("label_id", "zone", F.transform("ls", lambda x: x["line"]).alias("raw_lines"), F.col("n").alias("word_count"), mean3(F.col("total"), F.col("n")).alias("avg_confidence"))
    filled = {"raw_lines": F.coalesce("raw_lines", F.array().cast("array<string>")), "word_count": F.coalesce("word_count", F.lit(0)), "avg_confidence": F.coalesce("avg_confidence", F.lit(0.0))}
    return every.join(found, ["label_id", "zone"], "left").withColumns(filled)


def first_match(words: DataFrame, targets: DataFrame) -> DataFrame:
    """For each label's target the first word that holds it or lies within it."""
    found = F.contains("text", "target") | F.contains("target", "text")
    return words.join(targets, "label_id").where(found).groupBy("label_id", "target").agg(F.min(F.struct("word_idx", "text")).alias("f")).select("label_id", "target", "f.*")
