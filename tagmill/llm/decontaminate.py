"""Benchmark decontamination with DataFrame functions only.

Test items are normalised and cut into windows of n words (an item of fewer words is one window). Each window is keyed
by its longest word (the smallest of equals), so every occurrence of a window in a training text holds that anchor word
at a known place. Training texts are scanned for anchors, the words around each are looked up in the broadcast hash set
of windows, and a hit counts once all words agree. Anchors only save work: whatever they drop cannot match.

The anchors and windows are sent to the executors only while there are at most `most_windows` of them, which is checked
by a count. Beyond that, numbers alone are shuffled: the hash and place of every training window meets the hashes of the
benchmark's, and the words are looked at again only where a hash was found. Both ways give the same rows.

Defined cases: null and empty texts have no words and no hits; null items have no windows; repeated items count each by
its own id; repeated rows give repeated results; other columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import lower_az, unused

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
MOST_WINDOWS = 50_000


def words(text: Column) -> Column:
    """The words of a text: what lies between ASCII characters that are neither digits nor lower-case letters."""
    return F.filter(F.split(lower_az(F.coalesce(text, F.lit(""))), WORD_GAP), lambda w: w != "")


def _anchor(window: Column) -> Column:
    """Place (from 0) of the longest word of a window; of equals, the smallest word, then the first."""
    best = F.array_max(F.transform(window, lambda w, i: F.struct(F.length(w).alias("n"), F.hash(w).alias("h"), w.alias("w"), (-i).alias("i"))))
    return -best["i"]


def windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Distinct windows: window array<string>, anchor string, place int (of the anchor), items array<item_id>."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(1))), lambda i: F.slice("words", i, n))
    found = items.select("item_id", F.explode(cut).alias("window")).groupBy("window").agg(F.collect_set("item_id").alias("items"))
    found = found.withColumn("place", _anchor(F.col("window")))
    return found.withColumn("anchor", F.get("window", "place"))


def _covered(spans: Column) -> Column:
    """Words covered by the distinct (start, n) spans, counted once each."""
    step = lambda acc, s: F.struct(
        (acc["words"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(acc["end"], s["start"]))).cast("int").alias("words"),
        F.greatest(acc["end"], s["start"] + s["n"]).cast("int").alias("end"),
    )
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("words"), F.lit(0).alias("end")), step, lambda acc: acc["words"])


def _cuts(k: int) -> Column:
    """Start, words and hash of all windows of k words; null where the text has fewer."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - (k - 1), F.lit(1)))
    return F.when(F.size("_words") >= k, F.transform(starts, lambda i: F.struct((i - 1).alias("start"), F.lit(k).alias("n"), F.xxhash64(F.slice("_words", i, k)).alias("h"))))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, most_windows: int = MOST_WINDOWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: doc_id, kept columns, n_words, spans array<struct<start,n>> (in words), n_hit, items (sorted).

    The text is read once and left behind before the only shuffle, which carries a few numbers for each document.
    """
    tests = windows(benchmark, n)
    few = tests.limit(most_windows + 1).count() <= most_windows
    base = docs.withColumns({"_words": words(F.col("text"))}).select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", *keep, F.size("_words").cast("long").alias("n_words"), "_words"
    )
    if few:
        anchors = [r[0] for r in tests.select("anchor").distinct().collect()]
        known = lambda w: w.isin(anchors) if anchors else F.lit(False)
        places = F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("anchor"), i.alias("at"))), lambda x: known(x["anchor"]))
        places = F.when(F.exists("_words", known), places)  # most texts hold no anchor; exists() makes no copies
        around = F.transform(
            places,
            lambda p: F.struct(
                p["anchor"].alias("anchor"), p["at"].alias("at"), F.least(p["at"], F.lit(n - 1)).alias("before"),
                F.slice("_words", F.greatest(p["at"] - (n - 2), F.lit(1)), F.least(p["at"], F.lit(n - 1)) + n).alias("near"),
            ),
        )
        base = base.withColumn("_near", around).drop("_words")
        by_anchor = F.broadcast(tests.groupBy("anchor").agg(F.collect_list(F.struct("window", "place", "items")).alias("tests")))
        rows = base.withColumn("_near", F.explode_outer("_near")).join(by_anchor, F.col("_near.anchor") == F.col("anchor"), "left")
        start = lambda t: F.col("_near.at") - t["place"]
        fits = lambda t: (F.col("_near.before") >= t["place"]) & (F.slice("_near.near", F.col("_near.before") - t["place"] + 1, F.size(t["window"])) == t["window"])
        hits = F.transform(F.filter("tests", fits), lambda t: F.struct(start(t).alias("start"), F.size(t["window"]).alias("n"), t["items"].alias("items")))
        rows = rows.withColumn("_hits", hits)
    else:
        sizes = sorted(r[0] for r in tests.select(F.size("window")).distinct().collect())  # 1 to n at most
        empty = F.array().cast("array<struct<start:int,n:int,h:bigint>>")
        every = reduce(F.concat, [F.coalesce(_cuts(k), empty) for k in sizes], empty)
        hashes = tests.select(F.xxhash64("window").alias("h")).distinct()
        found = base.select("_row", F.explode(every).alias("c")).select("_row", "c.*").join(hashes, "h", "left_semi")
        found = found.groupBy("_row").agg(F.collect_set(F.struct("start", "n")).alias("_found"))
        cut = F.transform("_found", lambda c: F.struct(c["start"].alias("start"), F.slice("_words", c["start"] + 1, c["n"]).alias("window")))
        rows = base.join(found, "_row", "left").withColumn("_cut", F.explode_outer(cut)).drop("_words", "_found")
        rows = rows.withColumn("_key", F.xxhash64("_cut.window")).join(tests.select(F.xxhash64("window").alias("_key"), "window", "items"), "_key", "left")
        hit = F.when(F.col("_cut.window") == F.col("window"), F.array(F.struct(F.col("_cut.start").alias("start"), F.size("window").alias("n"), F.col("items"))))
        rows = rows.withColumn("_hits", hit)
    hits = F.coalesce("_hits", F.array().cast("array<struct<start:int,n:int,items:array<bigint>>>"))
    rows = rows.select("_row", "doc_id", *keep, "n_words", hits.alias("_hits"))
    found = rows.groupBy("_row").agg(
        *(F.first(c).alias(c) for c in ("doc_id", *keep, "n_words")),
        F.flatten(F.collect_list(F.when(F.size("_hits") > 0, F.col("_hits")))).alias("_hits"),
    )
    return found.select(
        "doc_id", *keep, "n_words",
        F.array_distinct(F.transform("_hits", lambda h: F.struct(h["start"].alias("start"), h["n"].alias("n")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.transform(h["items"], lambda x: x.cast("string")))))).alias("items"),
    ).withColumn("n_hit", _covered(F.col("spans")).cast("long"))


def without_words(text: Column, inside: Callable[[Column], Column]) -> Column:
    """The text without the words whose numbers are inside, and without what stands between two of these; all else as it is."""
    found = F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    gaps = F.split(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1)  # one more than words
    gap = lambda i: F.when((i > 0) & inside(i - 1) & inside(i), "").otherwise(F.get(gaps, i))
    parts = F.transform(gaps, lambda _, i: F.concat(gap(i), F.when(inside(i), "").otherwise(F.coalesce(F.get(found, i), F.lit("")))))
    return F.array_join(parts, "")


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, remove: str = "documents", most_windows: int = MOST_WINDOWS) -> DataFrame:
    """docs without contaminated documents, or with the hit words cut out of their texts (remove="spans"), whatever their columns' names.

    Only the ids and digests of contaminated texts are joined with docs, so texts are never copied for each hit.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove}")
    no_id, key, at = (unused(docs, c) for c in ("id", "key", "spans"))
    digest = F.unhex(F.md5("text"))
    found = contamination(docs.select("doc_id", "text", digest.alias("_digest")), benchmark, n, most_windows, keep=("_digest",)).where(F.col("n_hit") > 0)
    found = found.select(F.col("doc_id").alias(no_id), F.col("_digest").alias(key), F.col("spans").alias(at)).dropDuplicates([no_id, key])
    same = F.col("doc_id").eqNullSafe(F.col(no_id)) & (digest == F.col(key))
    if remove == "documents":
        return docs.join(found, same, "left_anti")
    inside = lambda i: F.exists(at, lambda s: (s["start"] <= i) & (i < s["start"] + s["n"]))
    joined = docs.join(found, same, "left")
    return joined.withColumn("text", F.when(F.col(at).isNotNull(), without_words(F.col("text"), inside)).otherwise(F.col("text"))).select(docs.columns)


def decontamination_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The counts and digests of every document."""
    return contamination(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM d),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: list_slice(ws, i, i + 9))) AS win FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT len(win) AS k FROM bw),
dw AS (SELECT r, k, unnest(range(1, len(ws) - k + 2)) AS i, ws FROM w, sizes WHERE len(ws) >= k),
dh AS (SELECT r, i, k, list_slice(ws, i, i + k - 1) AS win FROM dw),
h AS (SELECT dh.r, dh.i, dh.k, bw.item_id FROM dh JOIN bw ON dh.win = bw.win),
p AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS q FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS js FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.js, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN p USING (r) LEFT JOIN it USING (r)
"""
