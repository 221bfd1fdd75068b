"""Near-duplicate grouping: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

1. Every whole text is hashed to its shingles and a SuperMinHash signature of 128 places. Each shingle deals its ranks
   to the places as a random permutation, one rank a level, for all texts of a batch at once; a text stops at the level
   at which all of its places are filled, since later ranks are larger (the early stop).
2. Equal texts become one node, a number, with the smallest doc_id. Nodes that agree in all 4 places of any of 32 bands are
   candidates: at a similarity of 0.8 a pair is missed with a chance of 5e-8.
3. A shingle that only one candidate has cannot be common. Members that have too few others for any partner in their
   bucket are dropped from it; this is exact, and it clears buckets of texts that only share a passage.
4. In each bucket all members are compared with one hub, in two rounds with different hubs, so a round makes as many pairs
   as there are members. Confirmed links join nodes, and members of one component need no more comparisons.
5. What is left, buckets with members of several components, is compared in blocks of bounded size: a task gets two blocks
   and multiplies their incidence matrices, so pairs are never rows, and a large component is not compared with itself.
   In the end every candidate pair has been confirmed, refuted, or made needless by a join.
6. Components are found by label propagation with pointer jumping on tables; nothing is collected to the driver.

Confirmation compares the sets of word shingles themselves, in integers: 100 * common >= percent * all.

Defined cases: null texts and texts without words have no shingles and stand alone, also if equal; texts of fewer words
than a shingle are one shingle; repeated rows fall together; a null doc_id comes after all others, and a group that has no
other has a null component_id and keeps one row; a doc_id with several texts counts for each of them by itself; empty tables
give empty results; columns other than doc_id and text are carried only by kept(), whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import ASCII_LOWER, give_back, giving_back, runs, saved, unused, utf8

WORDS = 5
PERCENT = 80
PLACES = 128
ROWS = 4
HUB_ROUNDS = 2
#: Members of a block, about.
BLOCK = 400

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D  # odd: it has an inverse modulo 2**64
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word shingles of all texts, repeats included, and how many each text has."""
    n = len(offsets) - 1
    gap = _GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    solid = ~gap
    first = np.flatnonzero(solid & (np.concatenate(([True], gap[:-1])) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    last = np.flatnonzero(solid & (np.concatenate((gap[1:], [True])) | edge[1:])) + 1 if len(data) else first
    inverse = pow(_BASE, -1, 1 << 64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((ASCII_LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers(len(data), _BASE)[:-1])))
    hashes = _mix((total[last] - total[first]) * _powers(len(data), inverse)[first] + (last - first).astype(np.uint64) * _GOLDEN)
    of = np.searchsorted(first, offsets)  # words before each text
    per = np.diff(of)
    shingles = np.where(per >= words, per - words + 1, per > 0)
    out = np.zeros(int(shingles.sum()), np.uint64)
    text = np.repeat(np.arange(n), shingles)
    start = np.concatenate(([0], np.cumsum(shingles)))[:-1]
    at = of[:-1][text] + (np.arange(len(out)) - start[text])
    short = per[text] < words
    for k in range(words):
        here = ~short | (k < per[text])
        out[here] = _mix(out[here] * _GOLDEN + hashes[at[here] + k] + np.uint64(k + 1))
    return out, shingles


def super_min_hash(hashes: np.ndarray, counts: np.ndarray, places: int = PLACES) -> np.ndarray:
    """SuperMinHash signatures, len(counts) x places, of 32-bit numbers: 2**24 times the least rank plus fraction; all ones for no shingles.

    Level j deals rank j of every shingle: step j of a Fisher-Yates shuffle, whose swaps are traced back by the earlier
    levels' choices instead of being stored as permutations.
    """
    n = len(counts)
    best = np.full(n * places, 0xFFFFFFFF, np.uint32)
    text = np.repeat(np.arange(n), counts)
    active = counts > 0
    chosen: list[np.ndarray] = []
    for level in range(places):
        if not len(text):
            break
        random = _mix(hashes + np.uint64((level + 1) * int(_GOLDEN) % (1 << 64)))
        choice = (level + ((random >> np.uint64(32)) * np.uint64(places - level) >> np.uint64(32)).astype(np.int64)).astype(np.uint8)
        place = choice.copy()
        for earlier in range(level - 1, -1, -1):
            place[chosen[earlier] == place] = earlier
        rank = (random & np.uint64(0xFFFFFF)).astype(np.uint32) + np.uint32(level << 24)
        np.minimum.at(best, text * places + place, rank)
        filled = (best.reshape(n, places) < np.uint32((level + 1) << 24)).all(1) if level + 1 < places else np.ones(n, bool)
        chosen.append(choice)
        if (filled & active).any():
            active &= ~filled
            stay = active[text]
            hashes, text, chosen = hashes[stay], text[stay], [c[stay] for c in chosen]
    return best.reshape(n, places)


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of `rows` places, different between bands."""
    n, places = signatures.shape
    keys = np.zeros((n, places // rows), np.uint64)
    part = signatures.reshape(n, places // rows, rows).astype(np.uint64)
    for k in range(rows):
        keys = _mix(keys * _GOLDEN + part[:, :, k] + np.uint64(1))
    return _mix(keys + np.arange(places // rows, dtype=np.uint64) * _GOLDEN).view(np.int64)


_SIGNED = pa.struct([("n", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _signer(words: int, places: int, rows: int):
    def sign(texts: pa.Array) -> pa.Array:
        data, offsets = utf8(texts)
        sizes, bands = [np.zeros(0, np.int64)], [np.zeros((0, places // rows), np.int64)]
        for i, j in runs(offsets):
            hashes, counts = shingle_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
            ends = np.cumsum(counts)
            sizes.append(np.array([len(np.unique(hashes[e - c : e])) for e, c in zip(ends, counts, strict=True)], np.int64))
            bands.append(band_keys(super_min_hash(hashes, counts, places), rows))
        size, band = np.concatenate(sizes), np.concatenate(bands)
        width = band.shape[1] * (size > 0)  # nothing to link with without shingles
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(width))), pa.int32()), pa.array(band[size > 0].reshape(-1)))
        return pa.StructArray.from_arrays([pa.array(size), lists], fields=list(_SIGNED))

    return F.arrow_udf(giving_back(sign), "struct<n:bigint,bands:array<bigint>>")


def shingles(text: str | None, words: int) -> set[str]:
    found = _WORD.findall((text or "").translate(_LOWER))
    return {" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def _confirmer(words: int, percent: int):
    """Of rows (a, b, a_text, b_text) those whose texts' whole shingle sets are similar enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, own = None, set()
        for batch in batches:
            good = []
            for x, y in zip(batch["a_text"], batch["b_text"], strict=True):
                x, y = x.as_py(), y.as_py()
                if x != seen:  # rows come by hub
                    seen, own = x, shingles(x, words)
                other = shingles(y, words)
                common = len(own & other)
                good.append(100 * common >= percent * (len(own) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(good, pa.bool_()))
        give_back()

    return confirm


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for the ends of edges (a, b), a < b.

    Every round hooks the root of each node's larger neighbours to the smallest one and then jumps pointers, so long
    chains shorten by half. A round writes one table to the shared folder; one that changes nothing is the last.
    """
    links = saved(edges.select("a", "b").distinct(), "links")
    roots = links.union(links.select("b", "a")).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"), F.lit(True).alias("changed"))
    roots = saved(roots, "roots")
    while not roots.where("changed").isEmpty():
        left, right = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        across = links.join(left, "a").join(right, "b").where("ra <> rb")
        hooks = across.groupBy(F.greatest("ra", "rb").alias("root")).agg(F.min(F.least("ra", "rb")).alias("to"))
        jumps = roots.select(F.col("node").alias("root"), F.col("root").alias("up")).where("up < root")
        found = F.least("root", F.coalesce("to", "root"), F.coalesce("up", "root"))
        roots = saved(roots.drop("changed").join(hooks, "root", "left").join(jumps, "root", "left").select("node", found.alias("root"), (found < F.col("root")).alias("changed")), "roots")
    return roots.drop("changed")


def _distinct_hashes(words: int):
    def hashes(texts: pa.Array) -> pa.Array:
        data, offsets = utf8(texts)
        found, ends = [np.zeros(0, np.uint64)], [0]
        for i, j in runs(offsets):
            own, counts = shingle_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
            for e, c in zip(np.cumsum(counts), counts, strict=True):
                found.append(np.unique(own[e - c : e]))
                ends.append(ends[-1] + len(found[-1]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).view(np.int64)))

    return F.arrow_udf(giving_back(hashes), "array<bigint>")


def _possible(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """members with `shared` (shingles that another candidate has too), without those that no member of their bucket can match.

    Two sets of sizes n and m are similar if they share percent / (100 + percent) of n + m, and they share `shared` at most.
    """
    held = texts.select("node", F.explode(_distinct_hashes(words)("text")).alias("shingle"))
    alone = held.groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    alone = alone.groupBy("node").agg(F.count("*").alias("alone"))
    members = members.join(alone, "node", "left").select("bucket", "node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))
    members = saved(members, "shared")
    least = members.groupBy("bucket").agg(F.min("n").alias("least_n"))
    fits = F.expr(f"{100 + percent} * shared >= {percent} * (n + greatest(least_n, n * {percent} div 100))")
    members = members.join(least, "bucket").where(fits).drop("least_n")
    buckets = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    return saved(members.join(buckets, "bucket"), "possible")


def _links(nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (a, b), a < b, that connect all similar nodes.

    nodes (node, key, doc_id, n, bands); docs (doc_id, key, text) has the nodes' texts.
    """
    rows = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    members = saved(rows.join(shared, "bucket"), "buckets")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("key").alias("own_key"), F.col("doc_id").alias("own_id"))
    texts = docs.join(wanted, (F.col("key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).select("node", "text")
    texts = saved(texts.dropDuplicates(["node"]), "texts")
    members = _possible(members, texts, words, percent).withColumn("root", F.col("node"))
    similar = f"100 * least(a_n, n) >= {percent} * greatest(a_n, n) and {100 + percent} * least(a_shared, shared) >= {percent} * (a_n + n)"
    links = nodes.sparkSession.createDataFrame([], "a long, b long")
    for done in range(HUB_ROUNDS):
        if members.isEmpty():
            return links
        # the hub has the least masked number, another mask each round; plain numbers need no sort to be aggregated
        masked = F.col("node").bitwiseXOR(F.lit((done * 0x5DEECE66D1CE4E5B) & 0x7FFFFFFFFFFFFFFF))
        hubs = members.groupBy("bucket").agg(*(F.min_by(c, masked).alias(f"a{x}") for c, x in (("node", ""), ("n", "_n"), ("shared", "_shared"), ("root", "_root"))))
        pairs = members.join(hubs, "bucket").where("root <> a_root").where(similar).select("a", F.col("node").alias("b")).distinct()
        pairs = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
        pairs = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b").sortWithinPartitions("a")
        found = pairs.select("a", "b", "a_text", "b_text").mapInArrow(_confirmer(words, percent), "a long, b long")
        links = saved(links.union(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), "confirmed")
        members = members.drop("root").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = members.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("bucket")
        members = saved(members.join(mixed, "bucket"), "left")
    return links if members.isEmpty() else saved(links.union(_block_links(members, texts, words, percent)), "confirmed")


def _compare_blocks(words: int, percent: int):
    """For the members of two blocks: links that join all those of different components whose sets are similar enough."""

    def compare(group: pa.Table) -> pa.Table:
        keys, roots = group["key"].to_pylist(), group["root"].to_pylist()
        number: dict[str, int] = {}
        rows = [np.array([number.setdefault(x, len(number)) for x in shingles(t, words)], np.int64) for t in group["text"].to_pylist()]
        sizes = np.array([len(r) for r in rows])
        of, columns = np.repeat(np.arange(len(rows)), sizes), np.concatenate(rows)
        common = np.bincount(columns, minlength=len(number)) > 1
        dense = np.cumsum(common) - 1
        of, columns = of[common[columns]], dense[columns[common[columns]]]
        both = np.zeros((len(rows), len(rows)), np.float32)  # counts below 2**24 are exact
        for start in range(0, int(common.sum()), 4096):
            part = (columns >= start) & (columns < start + 4096)
            matrix = np.zeros((len(rows), 4096), np.float32)
            matrix[of[part], columns[part] - start] = 1
            both += matrix @ matrix.T
        inter = both.astype(np.int64)
        similar = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
        parent: dict = {}

        def find(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(np.triu(similar, 1)), strict=True):
            x, y = find(roots[i]), find(roots[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((min(keys[i], keys[j]), max(keys[i], keys[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return compare


def _block_links(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links that join all similar members of different components that share a bucket."""
    first = members.groupBy("bucket").agg(F.min("node").alias("a"))
    star = members.select("bucket", F.col("node").alias("b")).join(first, "bucket").where("a < b").select("a", "b")
    nodes = components(star).withColumnRenamed("root", "cluster")
    nodes = nodes.join(members.select("node", "root").distinct(), "node")
    by_root = nodes.groupBy("cluster", "root").agg(F.count("*").alias("m"))
    small = by_root.where(f"m <= {BLOCK}").groupBy("cluster").agg(F.sum("m").alias("small"))
    nodes = nodes.join(by_root, ["cluster", "root"]).join(small, "cluster", "left")
    large = F.col("m") > BLOCK
    block = F.when(large, F.concat(F.col("root").cast("string"), F.lit("/"), F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / BLOCK)).cast("string")))
    block = block.otherwise(F.concat(F.lit("/"), F.pmod(F.xxhash64("root"), F.ceil(F.col("small") / BLOCK)).cast("string")))
    nodes = saved(nodes.select("cluster", "node", "root", block.alias("block"), F.when(large, F.col("root")).alias("of")), "blocks")
    blocks = nodes.select("cluster", "block", "of").distinct()
    one, two = (blocks.select("cluster", F.col("block").alias(x), F.col("of").alias(f"{x}_of")) for x in ("x", "y"))
    tasks = one.join(two, "cluster").where("x <= y and coalesce(x_of <> y_of, true)")
    tasks = tasks.select("cluster", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    held = nodes.join(tasks, ["cluster", "block"]).join(texts, "node")
    return held.select("cluster", "x", "y", F.col("node").alias("key"), "root", "text").groupBy("cluster", "x", "y").applyInArrow(_compare_blocks(words, percent), "a long, b long")


def _key(text: Column | str = "text") -> Column:
    return F.unhex(F.md5(text))


def _decided(docs: DataFrame, words: int, percent: int, places: int = PLACES, rows: int = ROWS) -> DataFrame:
    """doc_id, key (null without words), n, component_id, kept. A row per document.

    The kept rows of a group have its smallest doc_id and one text: of two texts with that doc_id the one of the smaller key.
    """
    docs = docs.select("doc_id", _key().alias("key"), "text")
    signed = docs.select("doc_id", "key", _signer(words, places, rows)("text").alias("s"))
    signed = saved(signed.select("doc_id", F.when(F.col("s.n") > 0, F.col("key")).alias("key"), F.col("s.n").alias("n"), F.col("s.bands").alias("bands")), "signed")
    nodes = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # equal texts have equal n and bands
    roots = components(_links(nodes, docs, words, percent))
    of = nodes.select("node", F.col("key").alias("own_key"), F.col("doc_id").alias("own_id"))
    smallest = F.min(F.struct(F.col("own_id").isNull().alias("no_id"), "own_id", "own_key")).alias("s")  # null ids last
    owners = roots.join(of, "node").groupBy("root").agg(smallest).select("root", "s.own_id", "s.own_key")
    better = roots.join(owners, "root").select("node", F.col("own_id").alias("group_id"), F.col("own_key").alias("group_key"))
    owner = nodes.select("node", "key", "doc_id").join(better, "node", "left")
    alone = F.col("group_key").isNull()
    owner = owner.select("key", F.when(alone, F.col("doc_id")).otherwise(F.col("group_id")).alias("component_id"), F.coalesce("group_key", "key").alias("owner_key"))
    out = signed.drop("bands").join(owner, "key", "left")
    kept = F.expr("key is null or (key = owner_key and doc_id <=> component_id)")
    return out.select("doc_id", "key", "n", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), kept.alias("kept"))


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, places: int = PLACES, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of its group), kept. A row per document."""
    return _decided(docs, words, percent, places, rows).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def kept(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row for each group: the first of the smallest doc_id. Documents without words all stay.

    Texts move once, for the anti-join with the ids and digests of what goes. Rows that repeat both are few or equal: only
    they are grouped, and of them the one with the smallest hash of its other columns stays.
    """
    decided = saved(_decided(docs, words, percent).where("key is not null").select("doc_id", "key", "kept"), "decided")
    no_id, key = unused(docs, "id"), unused(docs, "key")
    named = [F.col("doc_id").alias(no_id), F.col("key").alias(key)]
    same = F.col("doc_id").eqNullSafe(F.col(no_id)) & (_key() == F.col(key))
    repeated = decided.where("kept").groupBy("doc_id", "key").agg(F.count("*").alias("c")).where("c > 1").select(*named)
    gone = decided.where("not kept").select(*named).distinct()
    if repeated.isEmpty():
        return docs.join(gone, same, "left_anti")
    others = [c for c in docs.columns if c != "text"]
    row = F.min_by(F.struct(*docs.columns), F.xxhash64(*others)).alias("row")
    first = docs.join(repeated, same, "left_semi").groupBy("doc_id", _key().alias(key)).agg(row).select("row.*")
    return docs.join(gone.union(repeated), same, "left_anti").unionByName(first.select(docs.columns))


def neardup_query(docs: DataFrame) -> DataFrame:
    return groups(docs, words=4)
