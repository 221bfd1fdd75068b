"""Language identification: averaged hashed subword embeddings with a linear softmax, calibrated rejection.

Subwords are all runs of 2, 3 and 4 bytes of the text in lower case, with everything in ASCII that is no letter taken as a
gap. Their hashed embeddings are averaged and fed to a softmax; both are trained by stochastic gradient descent in numpy
on a bounded sample of labelled documents: PER_LANG of each language, fewer where SAMPLE in all would be passed, one of each
language at least; the smallest by a hash of the id. Every language of the usable documents can be predicted. A fifth of the sample
sets the temperature and the score under which a prediction is rejected.

Defined cases: text that is null or holds no letter gives `und` with score 0, rejected; a null id is not held out; without labelled documents all
predictions are `und`; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.llm.common import runs, utf8

BUCKETS = 1 << 13
DIM = 16
GRAMS = (2, 3, 4)
#: Labelled documents that the fit takes of a language, and of all.
PER_LANG = 1_000
SAMPLE = 4_000
EPOCHS = 4
#: Share of right predictions among those accepted, on the calibration fifth.
ACCEPTED = 0.995

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def gram_buckets(data: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(length, bucket of the run that starts at each byte) for each of GRAMS."""
    b, out = _FOLD[data], []
    for n in GRAMS:
        h = np.full(max(0, len(b) - n + 1), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ b[k : len(b) - n + 1 + k]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        out.append((n, h * np.uint32(0x85EBCA6B) >> np.uint32(32 - BUCKETS.bit_length() + 1)))
    return out


def _features(texts: pa.Array) -> pa.Array:
    """Buckets of each text's subwords and their shares."""
    data, offsets = utf8(texts)
    out = []
    for a, b in zip(offsets, offsets[1:], strict=False):
        counts = np.zeros(BUCKETS)
        for _, h in gram_buckets(data[a:b]):
            counts += np.bincount(h, minlength=BUCKETS)
        at = np.flatnonzero(counts)
        out.append({"at": at.astype(np.int16), "w": (counts[at] / max(1, counts.sum())).astype(np.float32)})
    return pa.array(out, pa.struct([("at", pa.list_(pa.int16())), ("w", pa.list_(pa.float32()))]))


class Model:
    """langs, and for each bucket its pull towards each of them (embedding times softmax weights)."""

    def __init__(self, langs: list[str], pull: np.ndarray, bias: np.ndarray, temperature: float = 1.0, least: float = 0.0):
        self.langs, self.pull, self.bias, self.temperature, self.least = langs, pull, bias, temperature, least

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = (logits + self.bias) / self.temperature
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], seed: int = 7) -> Model | None:
    """rows: (buckets, shares, language)."""
    langs = sorted({r[2] for r in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(r[2]) for r in rows])
    order = rng.permutation(len(rows))
    held, used = order[: len(rows) // 5], order[len(rows) // 5 :]
    embed, weights, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    steps, done = EPOCHS * len(used), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            at, w, _ = rows[i]
            rate = 2.0 * (1 - done / steps)
            done += 1
            v = w @ embed[at]
            z = np.exp((s := v @ weights + bias) - s.max())
            g = z / z.sum()
            g[y[i]] -= 1
            embed[at] -= np.outer(w, rate * 5 * (weights @ g))
            weights -= rate * np.outer(v, g)
            bias -= rate * 0.1 * g
    model = Model(langs, embed @ weights, bias)
    if len(held):
        logits = np.array([rows[i][1] @ model.pull[rows[i][0]] for i in held])
        loss = []
        for t in (grid := np.geomspace(0.05, 8, 40)):
            model.temperature = t
            loss.append(-np.log(np.maximum(model.probabilities(logits)[np.arange(len(held)), y[held]], 1e-12)).mean())
        model.temperature = float(grid[int(np.argmin(loss))])
        p = model.probabilities(logits)
        by_score = np.argsort(-p.max(1), kind="stable")
        right = np.cumsum(p.argmax(1)[by_score] == y[held][by_score]) / np.arange(1, len(held) + 1)
        good = np.flatnonzero(right >= ACCEPTED)
        model.least = float(p.max(1)[by_score][good[-1]]) if len(good) else 1.0
    return model


def learned() -> Column:
    """Whether a document may be learned from: crc32 of its id as text, modulo 4, is not 2. A null id has none, so it may."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(True))


def fit(docs: DataFrame) -> Model | None:
    usable = docs.select("doc_id", "text", "lang").where(learned()).where("lang is not null and text is not null")
    counts = usable.groupBy("lang").count().collect()  # a row per language
    if not counts:
        return None
    each = max(1, min(PER_LANG, SAMPLE // len(counts)))
    share = F.create_map(*(F.lit(x) for r in counts for x in (r[0], min(1.0, 2 * each / r[1]))))
    rank = F.xxhash64("doc_id", F.lit(5))
    few = usable.where(F.pmod(rank, F.lit(1_000_000)) / 1_000_000 < F.try_element_at(share, F.col("lang")))  # twice what is needed, about
    few = few.dropDuplicates(["doc_id", "lang", "text"]).withColumn("_rank", rank).withColumn("_text", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy("_rank", "doc_id", "_text")
    sample = few.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= each).select("doc_id", "lang", "_rank", "_text", F.arrow_udf(_features, "struct<at:array<short>,w:array<float>>")("text").alias("f"))
    rows = sample.select("lang", "_rank", "_text", "f.*").toArrow()
    lang, order = rows["lang"].to_pylist(), sorted(range(len(rows)), key=list(zip(rows["_rank"].to_pylist(), rows["_text"].to_pylist(), rows["lang"].to_pylist(), strict=True)).__getitem__)
    at, w = (rows[k].combine_chunks() for k in ("at", "w"))
    ends, buckets, shares = at.offsets.to_numpy(), at.values.to_numpy(), w.values.to_numpy()  # slices of two arrays, no lists of numbers
    return train([(buckets[ends[i] : ends[i + 1]], shares[ends[i] : ends[i + 1]], lang[i]) for i in order if ends[i] < ends[i + 1]])


_PREDICTED = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def _predictor(model: Model | None):
    def predict(texts: pa.Array) -> pa.Array:
        data, offsets = utf8(texts)
        langs, scores = [], []
        for i, j in runs(offsets):
            own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            sums, total = np.zeros((j - i, len(model.langs) if model else 1)), np.zeros(j - i)
            if model:
                for n, h in gram_buckets(own):
                    ends = np.maximum(at[1:] - n + 1, at[:-1])
                    some = ends > at[:-1]
                    if some.any():
                        pairs = np.stack((at[:-1][some], ends[some]), 1).reshape(-1)
                        values = np.concatenate((model.pull[h], np.zeros((1, len(model.langs)))))
                        sums[some] += np.add.reduceat(values, np.minimum(pairs, len(h)), axis=0)[::2]
                        total[some] += (ends - at[:-1])[some]
                p = model.probabilities(sums / np.maximum(total, 1)[:, None])
            letters = np.concatenate(([0], np.cumsum(_LETTER[own])))
            for k in range(j - i):
                lettered = letters[at[k + 1]] > letters[at[k]] or any(c.isalpha() for c in own[at[k] : at[k + 1]].tobytes().decode())
                langs.append(model.langs[int(p[k].argmax())] if model and lettered else "und")
                scores.append(float(p[k].max()) if model and lettered else 0.0)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(_PREDICTED))

    return F.arrow_udf(predict, "struct<lang:string,score:double>")


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected (score under the calibrated least). One narrow pass."""
    out = docs.withColumn("_p", _predictor(model)(F.col(text)))
    least = model.least if model else 1.0
    return out.withColumns({"lang_pred": F.col("_p.lang"), "score": F.col("_p.score"), "rejected": (F.col("_p.score") < least) | (F.col("_p.lang") == "und")}).drop("_p")


def langid_query(docs: DataFrame) -> DataFrame:
    model = fit(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (~learned()).alias("held_out"), "lang_pred", "score", "rejected")
