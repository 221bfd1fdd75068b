"""python -m tagmill WORDS CODES LABELS [--dpi N] [--out FOLDER] [--indent N]: fields of labels as JSON records, printed or written.

WORDS, CODES and LABELS are Parquet tables as tagmill.plans.analyze() takes them. Exit 1: a table is missing; 2: extraction failed.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tagmill.operators import extract, geometry, lines, records, rules
from tagmill.sources import write_labels


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tagmill", description="Fields of labels as JSON records.")
    for name in ("words", "codes", "labels"):
        parser.add_argument(name)
    parser.add_argument("--dpi", type=int, default=600)
    parser.add_argument("--out")
    parser.add_argument("--indent", type=int, default=2)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        words, codes, labels = (spark.read.parquet(p) for p in (args.words, args.codes, args.labels))
    except AnalysisException as e:
        print(f"ERROR: table not found: {e}", file=sys.stderr)
        return 1
    try:
        fields = extract.extracted(lines.gated(geometry.zoned(words, labels)), codes).withColumn("symbology", F.lit(None).cast("string"))
        known = labels.join(rules.overall_confidence(fields), "label_id", "left").fillna(0.0, "overall_confidence")
        known = known.select("label_id", F.col("label_id").cast("string").alias("source_file"), F.current_timestamp().cast("string").alias("extracted_at"), "img_w", "img_h", F.lit(args.dpi).alias("dpi"), "overall_confidence")
        out = records.emitted(known, fields)
        if args.out:
            write_labels(out, args.out)
        else:
            for row in out.toLocalIterator():
                print(json.dumps(json.loads(row["json"]), indent=args.indent, ensure_ascii=False))
    except PySparkException as e:
        print(f"ERROR: extraction failed: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
