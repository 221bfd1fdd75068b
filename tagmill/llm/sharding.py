"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, with DataFrame functions only.

Each shard owns many points of a ring of 2^16 places; a document's id gives its place, and the next point clockwise
owns it. No shard takes more than its bound: what overflows continues clockwise to the next shard with room. Bounds are
in documents, floor(n / shards) or one more, so shard sizes differ by one at most (law `rows`). With slack above 0 the
bound is (1 + slack) times the mean, which moves fewer documents when a shard is added.

The walk around the ring is done on counts per point (shards x points rows, however many documents there are). A
document is told apart within its point by a rank by a hash of its id, size and CRC, so shards don't depend on how the rows
are laid out in files. Ranks are made of ranks in small groups, ranges of the hash, and running totals of the groups; rows
that are equal and too many for a group are parted by their place, which tells equal rows apart alone.

Defined cases: a null text has size 1 and CRC 0, a null id lies at one fixed place; repeated rows are placed one by one;
an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.llm.common import saved

PLACES = 1 << 16
SHARDS = 16
POINTS = 128
GROUP_ROWS = 100_000


def ring(shards: int = SHARDS, points: int = POINTS) -> list[tuple[int, int]]:
    """(place, shard) of all points in ring order; a shard's points don't depend on how many shards there are."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for k in range(points):
            place = int.from_bytes(hashlib.sha256(f"{shard}/{k}".encode()).digest()[:8], "big") % PLACES
            while place in taken:
                place = (place + 1) % PLACES
            taken[place] = shard
    return sorted(taken.items())


def owners(points: list[tuple[int, int]]) -> list[int]:
    """For each place the index of the point that owns it: the next one clockwise, itself included."""
    at = [p for p, _ in points]
    return [bisect.bisect_left(at, place) % len(at) for place in range(PLACES)]


def bounds(n: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most documents of each shard."""
    if slack:
        return [int(-(-n * (1 + slack) // shards))] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def walk(points: list[tuple[int, int]], counts: dict[int, int], limits: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(point, first rank, end rank, shard, first slot) for the counts of documents at each point.

    Points fill their own shards first, in ring order; then what is left over goes clockwise from its point.
    """
    room, used, parts, over = list(limits), [0] * len(limits), [], []

    def put(point: int, first: int, n: int, shard: int) -> None:
        parts.append((point, first, first + n, shard, used[shard]))
        used[shard] += n
        room[shard] -= n

    for point in sorted(counts):
        shard = points[point][1]
        n = min(counts[point], room[shard])
        if n:
            put(point, 0, n, shard)
        if n < counts[point]:
            over.append((point, n))
    for point, first in over:
        step = 0
        while first < counts[point]:
            step += 1
            shard = points[(point + step) % len(points)][1]
            n = min(counts[point] - first, room[shard])
            if n:
                put(point, first, n, shard)
                first += n
    return parts


def place(docs: DataFrame, shards: int = SHARDS, points: int = POINTS, slack: float = 0.0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, home (shard that the ring alone names), shard, slot (gapless in its shard).

    The text is read once, for its size and CRC; the small columns are written to the shared folder, so that counts and
    ranks come from the same rows even if an executor is lost. Broadcast are the ring's places and the walk's parts,
    whose sizes depend on the parameters alone.
    """
    spark = docs.sparkSession
    on_ring = ring(shards, points)
    owner = F.broadcast(spark.createDataFrame([(i, p, on_ring[p][1]) for i, p in enumerate(owners(on_ring))], "_place int, _point int, home int"))
    base = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)).cast("int").alias("_place"),
        F.monotonically_increasing_id().alias("_row"),
    )
    base = base.join(owner, "_place").drop("_place").withColumn("_hash", F.xxhash64("doc_id", "text_crc32", "size", F.lit(3)))
    base = saved(base, "ring", "snappy")
    groups = max(1, base.count() // group_rows)
    many = base.groupBy("_hash").agg(F.count("*").alias("_c")).where(F.col("_c") > group_rows)  # n / group_rows rows at most
    many = many.select("_hash", F.ceil(F.col("_c") / group_rows).alias("_parts_of"))
    range_ = F.expr(f"shiftrightunsigned(_hash, 33) * {groups}L div {1 << 31}L")
    keyed = base.join(F.broadcast(many), "_hash", "left").withColumns(
        {"_range": range_, "_hot": F.when(F.col("_parts_of").isNotNull(), F.col("_hash")), "_salt": F.coalesce(F.pmod("_row", "_parts_of"), F.lit(0))}
    ).drop("_parts_of")
    group = ["_point", "_range", "_hot", "_salt"]
    sums = keyed.groupBy(*group).agg(F.count("*").alias("_n"))
    counts = {r[0]: r[1] for r in sums.groupBy("_point").agg(F.sum("_n")).collect()}
    parts = walk(on_ring, counts, bounds(sum(counts.values()), shards, slack))
    before = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy("_point").orderBy("_range", "_hot", "_salt")) - F.col("_n")).drop("_n")
    before = before.select("_point", "_range", F.col("_hot").alias("_hot_b"), "_salt", "_before")
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy("_hash", "_row")) - 1)
    ranked = ranked.join(before, ["_point", "_range", "_salt"]).where(F.col("_hot").eqNullSafe(F.col("_hot_b"))).withColumn("_rank", F.col("_rank") + F.col("_before"))
    by_point: dict[int, list] = {}
    for point, first, end, shard, slot in parts:
        by_point.setdefault(point, []).append((first, end, shard, slot))
    parts_of = F.broadcast(spark.createDataFrame(list(by_point.items()), "_point int, _parts array<struct<first:long,end:long,shard:int,slot:long>>"))
    part = F.get(F.filter("_parts", lambda p: (p["first"] <= F.col("_rank")) & (F.col("_rank") < p["end"])), F.lit(0))
    return ranked.join(parts_of, "_point").withColumn("_part", part).select(
        "doc_id", "size", "text_crc32", "home", F.col("_part.shard").alias("shard"), (F.col("_part.slot") + F.col("_rank") - F.col("_part.first")).alias("slot")
    )


def sharding_query(docs: DataFrame) -> DataFrame:
    return place(docs.select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home"
    )
