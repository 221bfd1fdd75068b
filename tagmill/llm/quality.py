"""Quality classifier by co-training.

Two logistic classifiers see different views of a document: the text itself (kinds of characters, words, repeats, hashed
words) and its metadata (language, source, length). In each round both score every unlabelled document; those of which one
is most sure, a share that grows with the rounds, become labels for the other. Both are then calibrated on a held-out fold
of labelled documents, and a third logistic function combines the calibrated views.

The features of all documents are made once and kept as a table. Shares and thresholds come from counts over all unlabelled
documents, by thousandths of the scores. A fit takes at most LABELLED labelled documents and in each round PSEUDO of those
that the other view labelled, the smallest by a hash, so that it is the same in each run. A document is kept if its score is
at least the threshold: 0.5, or less where more than LOST of the good documents of the held-out fold would be lost.

Defined cases: null or empty text has the features of no words; null metadata is a value of its own; conflicting labels of
one doc_id count by their majority, ties as good; a label counts for all rows of its doc_id; without labels of both kinds all
documents score 0.5 and are kept; columns of other names are carried, those named like the result are replaced in scored().
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import giving_back, saved, unused

LABELLED = 8_000
PSEUDO = 4_000
ROUNDS = 3
#: Share of the unlabelled documents that a view labels for the other, times the round's number, and how sure it must be.
CONFIDENT = 0.05
SURE = 0.8
LOST = 0.005
WORD_BUCKETS = 128
META_BUCKETS = 128

_CLASS = np.zeros((256, 9))
for _k, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), (32,), (10,), map(ord, "!?"), map(ord, ".,;:'\"-"), range(128, 256))):
    _CLASS[list(_chars), _k] = 1
_CLASS[_CLASS.sum(1) == 0, 8] = 1  # signs, controls


def text_features(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    share = np.bincount(raw, minlength=256) @ _CLASS / max(1, len(raw))
    found = (text or "").split()
    n = max(1, len(found))
    counts: dict[str, int] = {}
    for w in found:
        counts[w] = counts.get(w, 0) + 1
    lines = (text or "").split("\n")
    repeat = sum(a == b for a, b in zip(found, found[1:], strict=False)) / n
    shape = [np.log1p(len(found)), len(raw) / n / 10, len(counts) / n, max(counts.values(), default=0) / n, repeat, len(set(lines)) / len(lines), len(lines) / n]
    hashed = np.bincount([zlib.crc32(w.encode()) % WORD_BUCKETS for w in {x.strip(".,!?").lower() for x in counts}], minlength=WORD_BUCKETS) if counts else np.zeros(WORD_BUCKETS)
    return np.concatenate((share * 4, shape, hashed / max(1.0, hashed.sum()) * 8))


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META_BUCKETS)
    for name, value in (("lang", lang), ("source", source), ("size", None if n_chars is None else int(np.log2(1 + max(0, n_chars)) * 2))):
        out[zlib.crc32(f"{name}={value!r}".encode()) % META_BUCKETS] += 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (the last is the bias) by Newton's method; classes weigh the same."""
    x = np.concatenate((x, np.ones((len(x), 1))), 1)
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    keep, w = np.eye(x.shape[1]) * ridge, np.zeros(x.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + keep, x.T @ (each * (p - y)) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class Views:
    """Weights of both views, their calibrations, the combination and the threshold."""

    def __init__(self, text, meta, calibrate_text, calibrate_meta, combine, threshold):
        self.text, self.meta, self.calibrate_text, self.calibrate_meta, self.combine, self.threshold = text, meta, calibrate_text, calibrate_meta, combine, threshold

    def score(self, xt: np.ndarray, xm: np.ndarray) -> np.ndarray:
        """Columns: the calibrated text view, the calibrated metadata view, both combined."""
        zt, zm = (np.clip(_logit(z[:, None], c), -30, 30) for z, c in ((_logit(xt, self.text), self.calibrate_text), (_logit(xm, self.meta), self.calibrate_meta)))
        return np.stack((_sigmoid(zt), _sigmoid(zm), _sigmoid(_logit(np.stack((zt, zm), 1), self.combine))), 1)


class CoTraining:
    """The fits of both views on labelled documents and on what the other view has labelled."""

    def __init__(self, xt: np.ndarray, xm: np.ndarray, y: np.ndarray, seed: int = 3):
        order = np.random.default_rng(seed).permutation(len(y))
        self.held, self.used = order[: len(y) // 4], order[len(y) // 4 :]
        if len(set(y[self.held].tolist())) < 2 or len(set(y[self.used].tolist())) < 2:
            self.held = self.used = order
        self.x, self.y = {"text": xt, "meta": xm}, y
        self.base = float(y[self.used].mean())
        self.extra = {k: (np.zeros((0, x.shape[1])), np.zeros(0)) for k, x in self.x.items()}

    def weights(self, view: str) -> np.ndarray:
        x, y = self.extra[view]
        return logistic(np.concatenate((self.x[view][self.used], x)), np.concatenate((self.y[self.used], y)))

    def views(self) -> Views:
        wt, wm, y = self.weights("text"), self.weights("meta"), self.y[self.held]
        zt, zm = _logit(self.x["text"][self.held], wt), _logit(self.x["meta"][self.held], wm)
        ct, cm = logistic(zt[:, None], y, 0.01), logistic(zm[:, None], y, 0.01)
        both = np.stack((np.clip(_logit(zt[:, None], ct), -30, 30), np.clip(_logit(zm[:, None], cm), -30, 30)), 1)
        combine = logistic(both, y, 0.01)
        good = np.sort(_sigmoid(_logit(both, combine))[y == 1])
        return Views(wt, wm, ct, cm, combine, float(min(0.5, good[int(LOST * len(good))])))


def thresholds(counts: np.ndarray, many: float, base: float) -> tuple[int, int]:
    """Of counts by thousandth of a score: the highest place that is labelled bad and the lowest that is labelled good.

    From each end places are taken until the share of `many` is reached (the last one whole), while they are sure enough.
    """
    low, high, n = -1, len(counts), 0.0
    while low + 1 <= round((1 - SURE) * 1000) and n < many * (1 - base):
        low += 1
        n += counts[low]
    n = 0.0
    while high - 1 >= round(SURE * 1000) and n < many * base:
        high -= 1
        n += counts[high]
    return low, high


def _view_features(texts: pa.Array, langs: pa.Array, sources: pa.Array, sizes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rows = list(zip(texts, langs, sources, sizes, strict=True))
    xt = np.array([text_features(t.as_py()) for t, *_ in rows]).reshape(len(rows), -1)
    xm = np.array([meta_features(*(x.as_py() for x in r[1:])) for r in rows]).reshape(len(rows), -1)
    return xt, xm


_FEATURES = pa.struct([("t", pa.binary()), ("m", pa.binary())])


def _featurize(texts: pa.Array, langs: pa.Array, sources: pa.Array, sizes: pa.Array) -> pa.Array:
    out: tuple[list[bytes], list[bytes]] = [], []
    for i in range(0, len(texts), 512):
        for x, rows in zip(_view_features(*(c.slice(i, 512) for c in (texts, langs, sources, sizes))), out, strict=True):
            rows += [r.tobytes() for r in x.astype("<f4")]
    return pa.StructArray.from_arrays([pa.array(x, pa.binary()) for x in out], fields=list(_FEATURES))


def _matrix(rows: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = rows.to_pylist()
    return np.frombuffer(b"".join(values), "<f4").reshape(len(values), -1).astype(float)


_COLUMNS = ("text", "lang", "source", "n_chars")


def _columns():
    return [F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars").cast("long")]


def featured(docs: DataFrame, column: str) -> DataFrame:
    """docs with the features of both views (t and m) in a column, as a table: the one pass over the whole texts."""
    return saved(docs.withColumn(column, F.arrow_udf(giving_back(_featurize), "struct<t:binary,m:binary>")(*_columns())), "featured")


def labelled(made: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, y (null: unlabelled), rank (a hash), t and m of rows (doc_id, t, m): a row each, as a table."""
    votes = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    return saved(made.join(votes, "doc_id", "left").select("doc_id", "y", F.xxhash64("doc_id", F.lit(11)).alias("rank"), "t", "m"), "features")


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """labelled() of the features of all documents, which no other table holds."""
    made = docs.select("doc_id", F.arrow_udf(giving_back(_featurize), "struct<t:binary,m:binary>")(*_columns()).alias("f"))
    return labelled(made.select("doc_id", "f.t", "f.m"), labels)


def _drawn(rows: DataFrame, n: int, most: int) -> pa.Table:
    """`most` of the n rows (all, if there are no more), those with the smallest ranks; equal rows count once."""
    some = rows.where(F.pmod("rank", F.lit(1_000_000)) < 2_000_000 * most / max(1, n))
    place = [F.pmod("rank", F.lit(1_000_000)), "rank", F.xxhash64("t", "m")]
    return some.dropDuplicates(["doc_id", "t", "m"]).orderBy(*place).limit(most).toArrow()


def _placer(wt: np.ndarray, wm: np.ndarray):
    """STRUCT of both views' scores in thousandths."""

    def places(t: pa.Array, m: pa.Array) -> pa.Array:
        found = [np.floor(_sigmoid(_logit(_matrix(x), w)) * 1000).astype(np.int32) if len(x) else np.zeros(0, np.int32) for x, w in ((t, wt), (m, wm))]
        return pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in found], names=["t", "m"])

    return F.arrow_udf(giving_back(places), "struct<t:int,m:int>")


def fit(table: DataFrame) -> Views | None:
    """The views, from a table of features()."""
    n_rows, n_known = table.agg(F.count("*"), F.count("y")).first()
    known = _drawn(table.where("y is not null"), n_known, LABELLED) if n_known else None
    if known is None or len(set(known["y"].to_pylist())) < 2:
        return None
    training = CoTraining(_matrix(known["t"]), _matrix(known["m"]), np.array(known["y"].to_pylist()))
    free = table.where("y is null")
    for round_ in range(1, ROUNDS + 1 if n_rows > n_known else 1):
        scored_ = free.withColumn("p", _placer(training.weights("text"), training.weights("meta"))("t", "m"))
        pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("v"), F.col(f"p.{v}").alias("place")) for v in "tm"))).alias("x")
        counted = scored_.select(pairs).groupBy("x.v", "x.place").agg(F.count("*").alias("n")).collect()  # a thousand rows for each view
        for view, to in (("t", "meta"), ("m", "text")):
            counts = np.zeros(1001, np.int64)
            for r in counted:
                if r["v"] == view:
                    counts[r["place"]] = r["n"]
            low, high = thresholds(counts, CONFIDENT * round_ * counts.sum(), training.base)
            at = F.col(f"p.{view}")
            sure = _drawn(scored_.where((at <= low) | (at >= high)).select("doc_id", "rank", "t", "m", (at >= high).cast("int").alias("y")), int(counts[: low + 1].sum() + counts[high:].sum()), PSEUDO)
            training.extra[to] = _matrix(sure["m" if to == "meta" else "t"]) if len(sure) else training.extra[to][0][:0], np.array(sure["y"].to_pylist(), float)
    return training.views()


def _scorer(views: Views | None):
    """STRUCT of the calibrated views and both combined, from the columns of a document."""
    fields = pa.struct([(k, pa.float64()) for k in ("p_text", "p_meta", "quality_score")])

    def score(texts: pa.Array, langs: pa.Array, sources: pa.Array, sizes: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(texts), 512):
            xt, xm = _view_features(*(x.slice(i, 512) for x in (texts, langs, sources, sizes)))
            out.append(views.score(xt.astype("<f4").astype(float), xm) if views else np.full((len(xt), 3), 0.5))
        values = np.concatenate(out) if out else np.zeros((0, 3))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values[:, k])) for k in range(3)], fields=list(fields))

    return F.arrow_udf(giving_back(score), "struct<p_text:double,p_meta:double,quality_score:double>")(*_columns())


def scored(docs: DataFrame, views: Views | None) -> DataFrame:
    """docs with p_text, p_meta, quality_score and keep. One narrow pass over the whole texts."""
    own = unused(docs, "s")
    docs = docs.withColumn(own, _scorer(views))
    found = {k: F.col(f"{own}.{k}") for k in ("p_text", "p_meta", "quality_score")}
    return docs.withColumns(found | {"keep": F.col(f"{own}.quality_score") >= (views.threshold if views else 0.0)}).drop(own)


def _feature_scorer(views: Views | None):
    """STRUCT like _scorer()'s, from the features."""

    def score(t: pa.Array, m: pa.Array) -> pa.Array:
        values = (views.score(_matrix(t), _matrix(m)) if views else np.full((len(t), 3), 0.5)) if len(t) else np.zeros((0, 3))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values[:, k])) for k in range(3)], names=["p_text", "p_meta", "quality_score"])

    return F.arrow_udf(giving_back(score), "struct<p_text:double,p_meta:double,quality_score:double>")


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The scores of all documents, from the features that the fit has read too."""
    table = features(docs.select("doc_id", *_COLUMNS), labels)
    views = fit(table)
    rows = table.select("doc_id", _feature_scorer(views)("t", "m").alias("s")).select("doc_id", "s.*")
    return rows.withColumn("keep", F.col("quality_score") >= (views.threshold if views else 0.0))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects; the texts are read once by Python and kept beside their features."""
    own = unused(docs, "f")
    table = featured(docs, own)
    views = fit(labelled(table.select("doc_id", f"{own}.t", f"{own}.m"), labels))
    score = _feature_scorer(views)(f"{own}.t", f"{own}.m")["quality_score"]
    return table.where(score >= (views.threshold if views else 0.0)).select(docs.columns)
