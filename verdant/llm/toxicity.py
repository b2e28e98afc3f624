"""Toxicity scoring by a factorization machine over hashed terms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from verdant.llm import textgrid
from verdant.llm.common import held_out, whole_text

BUCKETS = 1 << 17
STEMS = (3, 4, 5)        # leading letters of a word that are terms of their own, beside the word
FACTORS = 4
TRAIN_DOCS = 4_000      # learning documents of each label: those of least hash, so many at most
EPOCHS = 12
BATCH = 128
RATE = 0.05
PENALTY = 1e-3
MIN_DOCS = 10           # terms of fewer learning documents keep weight 0
SEED = 6


def _hash(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A bucket for each run codes[start : start + length], by one pass over the codes."""
    power = np.cumprod(np.full(len(codes), 0x9E3779B97F4A7C15, np.uint64))
    value = codes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    value ^= value >> np.uint64(31)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * power)))
    run = total[start + length] - total[start]
    inverse = np.cumprod(np.full(len(codes), pow(0x9E3779B97F4A7C15, -1, 2 ** 64), np.uint64))
    run *= inverse[start]  # the same run has the same hash wherever it stands
    run ^= length.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    run ^= run >> np.uint64(32)
    run *= np.uint64(0xD6E8FEB86659FD93)
    return (run >> np.uint64(47)).astype(np.int64)


def features(texts: list[str], is_letter: np.ndarray):
    """(doc, bucket, value) of the texts' terms, sorted by doc. Terms are the words and their stems; a
    term's value grows with the logarithm of its share of the words, so length alone changes nothing."""
    w = textgrid.Words(texts, is_letter)
    if not len(w.start):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.float32)
    length = w.end - w.start
    docs, terms = [w.doc], [_hash(w.code, w.start, length)]
    for n in STEMS:
        long = length > n
        docs.append(w.doc[long])
        terms.append(_hash(w.code, w.start[long], np.full(int(long.sum()), n)))
    pair, count = np.unique(np.concatenate(docs) * BUCKETS + np.concatenate(terms), return_counts=True)
    doc, term = pair // BUCKETS, pair % BUCKETS
    words = np.bincount(w.doc, minlength=w.docs)
    return doc, term, np.log1p(100.0 * count / words[doc]).astype(np.float32)


class Model:
    """score = logistic(bias + sum w x + 1/2 sum over factors of (sum v x)^2 - sum (v x)^2)."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = float(bias), w.astype(np.float32), v.astype(np.float32)

    def margins(self, doc: np.ndarray, term: np.ndarray, x: np.ndarray, n_docs: int) -> np.ndarray:
        """The sums over each document's terms; ``doc`` is sorted."""
        out = np.full(n_docs, self.bias)
        if not len(doc):
            return out
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        vx = self.v[term] * x[:, None]
        linear = np.add.reduceat(self.w[term] * x, first)
        crossed = (np.add.reduceat(vx, first) ** 2 - np.add.reduceat(vx * vx, first)).sum(axis=1)
        out[doc[first]] += linear + 0.5 * crossed
        return out

    def scores(self, texts: list[str], is_letter: np.ndarray) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in textgrid.chunks(texts):
            m = self.margins(*features(texts[a:b], is_letter), b - a)
            out[a:b] = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        return out


def fit(doc, term, x, y, seed: int = SEED) -> Model:
    """Logistic loss, AdaGrad over mini-batches, weight decay on the terms that a batch touches.

    The classes count equally. Terms that fewer than MIN_DOCS documents of the sample hold take no part: their
    weights and factors are zero.
    """
    rng = np.random.default_rng(seed)
    n = len(y)
    common = np.bincount(term, minlength=BUCKETS)[term] >= MIN_DOCS
    doc, term, x = doc[common], term[common], x[common]
    begin = np.searchsorted(doc, np.arange(n + 1))
    w, v = np.zeros(BUCKETS, np.float32), rng.normal(0, 0.01, (BUCKETS, FACTORS)).astype(np.float32)
    gw, gv, bias, gb = np.full(BUCKETS, 1e-6, np.float32), np.full((BUCKETS, FACTORS), 1e-6, np.float32), 0.0, 1e-6
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            rows = np.concatenate([np.arange(begin[d], begin[d + 1]) for d in part])
            size = begin[part + 1] - begin[part]
            at, t, xs = np.repeat(np.arange(len(part)), size), term[rows], x[rows]
            vx = v[t] * xs[:, None]
            sums = np.stack([np.bincount(at, vx[:, f], minlength=len(part)) for f in range(FACTORS)], axis=1)
            own = np.stack([np.bincount(at, vx[:, f] ** 2, minlength=len(part)) for f in range(FACTORS)], axis=1)
            m = bias + np.bincount(at, w[t] * xs, minlength=len(part)) + 0.5 * (sums ** 2 - own).sum(axis=1)
            error = ((1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[part]) * weight[part] / len(part)).astype(np.float32)
            touched, where = np.unique(t, return_inverse=True)
            e = error[at] * xs
            dw = np.bincount(where, e, minlength=len(touched)) + PENALTY * w[touched]
            push = e[:, None] * (sums[at] - vx)
            dv = np.stack([np.bincount(where, push[:, f], minlength=len(touched)) for f in range(FACTORS)], axis=1)
            dv += PENALTY * v[touched]
            gw[touched] += dw ** 2
            gv[touched] += dv ** 2
            w[touched] -= RATE * dw / np.sqrt(gw[touched])
            v[touched] -= RATE * dv / np.sqrt(gv[touched])
            gb += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(gb)
    v[np.bincount(term, minlength=BUCKETS) == 0] = 0  # terms that were not learned
    return Model(bias, w, v)


def _extract(frames):
    is_letter = textgrid.letters()
    for pdf in frames:
        texts = list(pdf["text"])
        for a, b in textgrid.chunks(texts):
            doc, term, x = features(texts[a:b], is_letter)
            cut = np.searchsorted(doc, np.arange(b - a + 1))
            yield pd.DataFrame({"h": pdf["h"].iloc[a:b], "toxic": pdf["toxic"].iloc[a:b],
                                "terms": [term[i:j].astype(np.int32).tobytes() for i, j in zip(cut, cut[1:])],
                                "x": [x[i:j].tobytes() for i, j in zip(cut, cut[1:])]})


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``train_docs`` documents of each label, those of least hash among the rows that are
    not held out and have a label of 0 or 1. A document with several labels has the largest.

    Their terms are extracted where the texts lie; the fit runs in one task on the bounded sample. With no
    document of one of the labels every score is the share of the other.
    """
    spark = docs.sparkSession
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id")))
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        share = 1 - 1e-6 if n1 else 1e-6
        return Model(np.log(share / (1 - share)), np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS)))
    picked = None
    for label in (0, 1):
        some = marks.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(train_docs)
        picked = some if picked is None else picked.unionByName(some)
    picked = F.broadcast(picked.select(F.col("doc_id").alias("m_id"), "toxic", "h"))  # at most 2 x train_docs rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.join(picked, F.col("doc_id") == F.col("m_id")).select("h", "toxic", "text")
    found = rows.mapInPandas(_extract, "h long, toxic int, terms binary, x binary")

    def train(frames):
        got = pd.concat(list(frames)).sort_values(["h", "terms"])
        size = [len(t) // 4 for t in got["terms"]]
        doc = np.repeat(np.arange(len(got)), size)
        term = np.frombuffer(b"".join(got["terms"]), np.int32).astype(np.int64)
        x = np.frombuffer(b"".join(got["x"]), np.float32)
        m = fit(doc, term, x, got["toxic"].to_numpy(np.float64))
        yield pd.DataFrame({"bias": [m.bias], "w": [m.w.tobytes()], "v": [m.v.tobytes()]})

    row = found.repartition(1).mapInPandas(train, "bias double, w binary, v binary").first()
    return Model(row["bias"], np.frombuffer(row["w"], np.float32), np.frombuffer(row["v"], np.float32).reshape(BUCKETS, FACTORS))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``, in one pass over the whole texts.

    Null counts as the empty text, whose score is the bias alone. Repeated rows get equal scores; only
    the text is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v))

    def rate(frames):
        is_letter, own = textgrid.letters(), Model(*shared.value)
        for pdf in frames:
            s = own.scores(list(pdf["text"]), is_letter)
            yield pd.DataFrame({"key": pdf["key"], "score": s})

    rows = docs.select(F.col("doc_id").cast("string").alias("key"), whole_text().alias("text"))
    found = rows.mapInPandas(rate, "key string, score double")
    return found.select(F.col("key").cast("long").alias("doc_id"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
