"""What the passes over a file give: text spans, images, regions, decoded codes and pixel statistics.

Decoders and engines are outside; these operators take the rows that they give.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions import stripped
from tagmill.values import SYMBOLS


def _scaled(dpi: int) -> list[Column]:
    """Corners in points as x, y, w, h in pixels; sizes are 1 at least."""
    at = lambda c: (c * (dpi / 72.0)).cast("long")
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    return [at(x0).alias("x"), at(y0).alias("y"), F.greatest(F.lit(1), at(x1 - x0)).alias("w"), F.greatest(F.lit(1), at(y1 - y0)).alias("h")]


def text_spans(spans: DataFrame, dpi: int = 600) -> DataFrame:
    """Spans (label_id, seq, text, x0, y0, x1, y1, size, flags) as elements in pixels; blank ones go. Bit 4 is bold, bit 1 italic."""
    text = stripped(F.col("text"))
    bit = lambda k: F.col("flags").bitwiseAND(F.lit(1 << k)) != 0
    rows = spans.where(text != "")
    return rows.select("label_id", "seq", F.lit("text_pdf").alias("type"), text.alias("content"), *_scaled(dpi), F.lit(1.0).alias("confidence"), F.round("size", 2).alias("font_size"), bit(4).alias("bold"), bit(1).alias("italic"))


def images(rects: DataFrame, dpi: int = 600) -> DataFrame:
    """The first place (by rect_ord) of each embedded image (label_id, xref) in pixels."""
    first = rects.groupBy("label_id", "xref").agg(F.min(F.struct("rect_ord", "x0", "y0", "x1", "y1")).alias("r")).select("label_id", "xref", "r.*")
    return first.select("label_id", "xref", F.lit("image_pdf").alias("type"), *_scaled(dpi), F.lit(1.0).alias("confidence"))


def merged_elements(*passes: DataFrame) -> DataFrame:
    """All elements of several passes, one pass after another, in reading order: rows of 10 pixels, then x."""
    tagged = [p.withColumn("pass", F.lit(k)) for k, p in enumerate(passes)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    from pyspark.sql import Window

    order = Window.partitionBy("label_id").orderBy(F.floor(F.col("y") / 10), "x", "pass", "seq")
    return both.withColumn("place", F.row_number().over(order).cast("long"))


def slot(symbol: Column) -> Column:
    out = None
    for name, symbols in SYMBOLS.items():
        out = F.when(symbol.isin(*symbols), name) if out is None else out.when(symbol.isin(*symbols), name)
    return out


def first_codes(decoded: DataFrame) -> DataFrame:
    """Of all decoding tries (label_id, try, symbol, raw, bbox ...) the first hit of each slot; other symbols go."""
    rows = decoded.withColumn("slot", slot(F.col("symbol"))).where("slot is not null")
    rest = [c for c in decoded.columns if c not in ("label_id", "try")]
    return rows.groupBy("label_id", "slot").agg(F.min(F.struct("try", *rest)).alias("f")).select("label_id", "slot", "f.*")


_MEANS = pa.struct([("b", pa.float64()), ("g", pa.float64()), ("r", pa.float64())])


def mean_colour(pixels: Column, width: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """STRUCT of the mean blue, green and red of a box of an image (rows of BGR bytes); null where the box holds no pixel."""

    def means(pixels: pa.Array, width: pa.Array, x: pa.Array, y: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        out = []
        for p, n, a, b, c, d in zip(pixels, *(v.to_pylist() for v in (width, x, y, w, h)), strict=True):
            image = np.frombuffer(p.as_buffer(), np.uint8).reshape(-1, n, 3) if p.is_valid else np.zeros((0, 1, 3))
            part = image[max(0, b) : max(0, b + d), max(0, a) : max(0, a + c)].reshape(-1, 3)
            out.append(dict(zip("bgr", part.mean(0).tolist(), strict=True)) if len(part) else None)
        return pa.array(out, _MEANS)

    return F.arrow_udf(means, "struct<b:double,g:double,r:double>")(pixels, width.cast("int"), *(c.cast("int") for c in (x, y, w, h)))


_DARK = pa.struct([("whole", pa.float64()), ("left", pa.float64()), ("right", pa.float64())])


def dark_shares(grey: Column, width: Column) -> Column:
    """STRUCT of the share of pixels under 128 in a grey crop and in its halves."""

    def shares(grey: pa.Array, width: pa.Array) -> pa.Array:
        out = []
        for p, n in zip(grey, width.to_pylist(), strict=True):
            dark = np.frombuffer(p.as_buffer(), np.uint8).reshape(-1, n) < 128 if p.is_valid else np.zeros((0, 2), bool)
            share = lambda x: float(x.mean()) if x.size else 0.0
            out.append({"whole": share(dark), "left": share(dark[:, : n // 2] if p.is_valid else dark), "right": share(dark[:, n // 2 :] if p.is_valid else dark)})
        return pa.array(out, _DARK)

    return F.arrow_udf(shares, "struct<whole:double,left:double,right:double>")(grey, width.cast("int"))


def marks_seen(whole: Column, left: Column, right: Column) -> Column:
    """Marks that the pixels hint at: a general one in a dark crop, and a second where both halves are dark."""
    return F.when(whole > 0.05, F.array_compact(F.array(F.lit("compliance_symbols_detected"), F.when((left > 0.04) & (right > 0.04), "CE")))).otherwise(F.array().cast("array<string>"))


def with_marks(existing: Column, seen: Column) -> Column:
    """The marks read with those seen that the text doesn't hold yet."""
    text = F.coalesce(existing, F.lit(""))
    new = F.filter(seen, lambda m: ~F.contains(text, m))
    return F.when(F.size(seen) > 0, F.array_join(F.filter(F.concat(F.array(text), new), lambda m: m != ""), ", ")).otherwise(existing)


def kind(suffix: Column) -> Column:
    """How a file is loaded: its first page, or as a picture; null for what isn't supported."""
    low = F.lower(suffix)
    return F.when(low == ".pdf", "first_page").when(low.isin(".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp"), "picture")


def upload(content: Column, sniffed: Column) -> Column:
    """STRUCT of what becomes of an uploaded file: the suffix that it is kept under, whether it must be encoded anew, an error."""
    empty = F.coalesce(F.octet_length(content) == 0, F.lit(True))
    return F.struct(F.when(~empty, F.coalesce(sniffed, F.lit(".png"))).alias("suffix"), (~empty & sniffed.isNull()).alias("encode"), F.when(empty, "empty").alias("error"))


def unioned(tables: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
