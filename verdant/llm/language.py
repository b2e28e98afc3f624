"""Language identification: script ranges, per-word scores and Viterbi spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from verdant.llm import textgrid
from verdant.llm.common import held_out, staged, whole_text

# First code point of a range and the script that letters from there on have.
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
)
NAMES = tuple(sorted({name for _, name in SCRIPTS}))

TRAIN_DOCS = 20_000     # learning documents: those of least hash, so many at most
BUCKETS = 1 << 16       # hashed runs of one to three letters
SMOOTHING = 0.5
SWITCH = 12.0           # what a change of language between two words costs, in log likelihood
SCRIPT_SHARE = 0.01     # a language is a candidate for a script that has this share of its letters
UNKNOWN = "und"


def _script_table() -> np.ndarray:
    starts = np.array([s for s, _ in SCRIPTS])
    ids = np.array([NAMES.index(n) for _, n in SCRIPTS], np.int8)
    return ids[np.maximum(np.searchsorted(starts, np.arange(0x110000), side="right") - 1, 0)]


def _features(words: textgrid.Words):
    """Bucket of the letter run of three that ends at each code, word edges included."""
    code = words.code.astype(np.uint64)
    run = code * np.uint64(0x9E3779B97F4A7C15)
    run[1:] += code[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
    run[2:] += code[:-2] * np.uint64(0x165667B19E3779F9)
    run ^= run >> np.uint64(29)
    run *= np.uint64(0xBF58476D1CE4E5B9)
    return (run >> np.uint64(48)).astype(np.int64)


def _count(frames):
    """(lang, kind, key, n): letter runs and scripts of the learning documents of a task."""
    is_letter, script = textgrid.letters(), _script_table()
    runs: dict = {}
    scripts: dict = {}
    for pdf in frames:
        for lang, part in pdf.groupby("lang"):
            texts = [t for t in part["text"] if t]
            for a, b in textgrid.chunks(texts):
                w = textgrid.Words(texts[a:b], is_letter)
                inside = w.code > 0
                inside[1:] |= inside[:-1]  # the edge after a word counts too
                runs[lang] = runs.get(lang, 0) + np.bincount(_features(w)[inside], minlength=BUCKETS)
                scripts[lang] = scripts.get(lang, 0) + np.bincount(script[w.code[w.code > 0]], minlength=len(NAMES))
    for kind, counts in (("run", runs), ("script", scripts)):
        for lang, n in counts.items():
            key = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "kind": kind, "key": key, "n": n[key]})


class Model:
    """``score[bucket, lang]`` log likelihoods and ``candidate[script, lang]``."""

    def __init__(self, langs: list[str], score: np.ndarray, candidate: np.ndarray):
        self.langs, self.score, self.candidate = langs, score, candidate


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on the ``train_docs`` learning documents of least hash (all, if there are fewer).

    A learning document has a text, a language and a doc_id that is not held out. The documents are
    counted where they lie; only the table of counts, bounded by languages times buckets, reaches the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = F.xxhash64("doc_id", "lang")
    last = rows.select(order.alias("h")).orderBy("h").limit(train_docs).agg(F.max("h")).first()[0]
    if last is None:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    counted = rows.where(order <= last).select("lang", "text").mapInPandas(_count, "lang string, kind string, key long, n long")
    table = counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    at = {k: i for i, k in enumerate(langs)}
    score, share = np.full((BUCKETS, len(langs)), SMOOTHING), np.zeros((len(NAMES), len(langs)))
    for kind, into in (("run", score), ("script", share)):
        part = table[table["kind"] == kind]
        into[part["key"].to_numpy(), part["lang"].map(at).to_numpy()] += part["n"].to_numpy()
    score = np.log(score / score.sum(axis=0))
    share = share / np.maximum(share.sum(axis=0), 1)
    return Model(langs, score.astype(np.float32), share >= SCRIPT_SHARE)


def word_scores(words: textgrid.Words, model: Model, script: np.ndarray) -> np.ndarray:
    """Log likelihood of every word in every language; the script of its first letter narrows the
    candidates, unless no language uses that script."""
    bucket = _features(words)
    # a word's runs end at its letters and at the edge after it
    per_code = model.score[bucket]
    bounds = np.empty(2 * len(words.start), np.int64)
    bounds[0::2], bounds[1::2] = words.start, words.end + 1
    score = np.add.reduceat(per_code, bounds, axis=0)[0::2] if len(bounds) else np.zeros((0, len(model.langs)), np.float32)
    allowed = model.candidate[script[words.code[words.start]]]
    allowed = allowed | ~allowed.any(axis=1, keepdims=True)
    score -= score.max(axis=1, keepdims=True)
    return np.where(allowed, score, score.min(axis=1, keepdims=True) - 2 * SWITCH)


def viterbi(score: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """The best language of every word under a switching penalty, all documents in step.

    ``doc`` is sorted. The documents are ordered by length, so at step t the first ones are those that
    have a t-th word. A path either stays in its language or switches to the best at the cost SWITCH.
    """
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    steps = int(count[0]) if n_docs else 0
    live = np.searchsorted(-count, -np.arange(steps), side="left")  # documents with more than t words
    kind = np.int8 if score.shape[1] <= 127 else np.int32
    came = np.full(len(score), -1, kind)        # the language before, for paths that switched
    stayed = np.ones(score.shape, bool)
    best = np.zeros((n_docs, score.shape[1]), np.float32)
    label = np.zeros(len(score), kind)
    for t in range(steps):
        n = live[t]
        at, now = first[:n] + t, best[:n]
        if t:
            top = now.argmax(axis=1)
            switch = now[np.arange(n), top] - SWITCH
            stay = now >= switch[:, None]
            stayed[at], came[at] = stay, top
            now = np.where(stay, now, switch[:, None])
        now = now + score[at]
        best[:n] = now - now.max(axis=1, keepdims=True)
    last = best.argmax(axis=1).astype(kind)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        at, here = first[:n] + t, last[:n]
        label[at] = here
        last[:n] = np.where(stayed[at, here], here, came[at])
    return label


class Labeller:
    def __init__(self, model: Model):
        self.model, self.letter, self.script = model, textgrid.letters(), _script_table()

    def words(self, texts: list[str]):
        w = textgrid.Words(texts, self.letter)
        if not len(w.start) or not self.model.langs:
            return w, np.zeros(len(w.start), np.int8)
        return w, viterbi(word_scores(w, self.model, self.script), w.doc, w.docs)

    def documents(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language with most letters in each text and its share of the letters."""
        k = len(self.model.langs)
        names, share = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not k:
            return names, share
        for a, b in textgrid.chunks(texts):
            w, label = self.words(texts[a:b])
            length = (w.end - w.start).astype(float)
            total = np.bincount(w.doc * k + label, length, minlength=(b - a) * k).reshape(-1, k)
            some = total.sum(axis=1) > 0
            top = total.argmax(axis=1)
            share[a:b] = np.where(some, total.max(axis=1) / np.maximum(total.sum(axis=1), 1), 0)
            for i in np.flatnonzero(some):
                names[a + i] = self.model.langs[top[i]]
        return names, share


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``: the language of most letters by the Viterbi
    spans, and its share of the letters. ``und`` with score 0 if the text is null or has no letter, or
    nothing was learned. Ties go to the first language by name. Only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.score, model.candidate))

    def label(frames):
        labeller = Labeller(Model(*shared.value))
        for pdf in frames:
            names, share = labeller.documents(list(pdf["text"]))
            yield pd.DataFrame({"key": pdf["key"], "lang_pred": names, "score": share})

    rows = docs.select(F.col("doc_id").cast("string").alias("key"), whole_text().alias("text"))
    found = rows.mapInPandas(label, "key string, lang_pred string, score double")
    return found.select(F.col("key").cast("long").alias("doc_id"), "lang_pred", "score")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, lang): the spans of one language in each text, in code points of the lower-cased
    text, from the first letter of a span's first word to the last letter of its last."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.score, model.candidate))

    def cut(frames):
        labeller = Labeller(Model(*shared.value))
        for pdf in frames:
            for key, text in zip(pdf["key"], pdf["text"]):
                w, label = labeller.words([text])
                if not len(label) or not labeller.model.langs:
                    continue
                new = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
                end = np.concatenate((new[1:], [len(label)])) - 1
                yield pd.DataFrame({"key": key, "start": w.start[new] - 1, "end": w.end[end] - 1,
                                    "lang": [labeller.model.langs[x] for x in label[new]]})

    rows = docs.select(F.col("doc_id").cast("string").alias("key"), whole_text().alias("text"))
    found = rows.mapInPandas(cut, "key string, start long, end long, lang string")
    return found.select(F.col("key").cast("long").alias("doc_id"), "start", "end", "lang")


MIN_SHARE = 0.4  # a document is kept if one language has this share of its letters


def keep_identified(docs: DataFrame, model: Model, min_share: float = MIN_SHARE, langs: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` whose text has a language with ``min_share`` of its letters, one of ``langs`` if given.

    All columns stay, in one pass and without a shuffle: the text is labelled next to its row.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.score, model.candidate))

    @F.pandas_udf("struct<lang: string, share: double>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(Model(*shared.value))
        for texts in batches:
            names, share = labeller.documents([t or "" for t in texts])
            yield pd.DataFrame({"lang": names, "share": share})

    found: Column = label(F.col("text"))
    good = (found["lang"] != UNKNOWN) & (found["share"] >= min_share)
    if langs is not None:
        good = good & found["lang"].isin(langs)
    return docs.where(good)
