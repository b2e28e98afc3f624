"""Language ID and toxicity: held-out accuracy, exact Viterbi and the margin against brute force."""

import itertools
import random
import zlib

import numpy as np
import pytest

from helpers import frame
from verdant.llm import language, textgrid, toxicity

SF = "/root/testdata/sf0.01"


def brute_viterbi(score, switch):
    best = None
    for path in itertools.product(range(score.shape[1]), repeat=len(score)):
        total = sum(score[i, k] for i, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))
        best = max(best or (-1e18,), (total, path))
    return best[0]


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    counts = [0, 5, 1, 7, 0, 6]
    doc = np.repeat(np.arange(len(counts)), counts)
    score = rng.normal(0, language.SWITCH, (len(doc), 3)).astype(np.float32)
    label = language.viterbi(score, doc, len(counts))
    for d in range(len(counts)):
        own, path = score[doc == d], label[doc == d]
        if len(own):
            got = own[np.arange(len(own)), path].sum() - language.SWITCH * (path[1:] != path[:-1]).sum()
            assert got == pytest.approx(brute_viterbi(own, language.SWITCH), rel=1e-4)


LANGS = {"en": "the and of that with from this which have been were will".split(),
         "de": "der und nicht werden sich auch über für könnte große zwischen".split(),
         "ru": "что этот для когда который может после между через".split(),
         "el": "και του που για από με αυτό είναι μια ήταν".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(LANGS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, k, 40), k) for i, k in enumerate(list(LANGS) * 60)]
    return language.learn(frame(spark, rows + [(900, None, "en"), (901, "x", None), (None, "der", "en")]))


def test_language_of_mixed_and_odd_texts(spark, model):
    rng = random.Random(2)
    mixed = prose(rng, "en", 30) + " " + prose(rng, "de", 60) + ". " + prose(rng, "ru", 10)
    rows = [(1, mixed), (2, None), (3, ""), (4, "123 -- 45"), (5, "über"), (5, "über"), (None, "который"), (6, prose(rng, "el", 40_000)), (7, "漢字"),
            (2 ** 60 + 1, "the"), (8, "İstanbul ile " + "the and " * 9)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(frame(spark, rows), model).collect()}
    assert got[1][0] == "de" and 0.4 < got[1][1] < 0.8
    assert [got[i] for i in (2, 3, 4)] == [("und", 0.0)] * 3
    assert [got[i][0] for i in (5, None, 6, 2 ** 60 + 1, 8)] == ["de", "ru", "el", "en", "en"] and got[7][0] in LANGS
    spans = language.spans(frame(spark, rows[:1]), model).orderBy("start").collect()
    assert [s.lang for s in spans] == ["en", "de", "ru"]
    low = mixed.lower()
    assert low[spans[0].start:spans[0].end] == " ".join(mixed.split()[:30]) and spans[-1].end == len(low)
    kept = language.keep_identified(frame(spark, rows), model)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 5, 5, None, 6, 7, 2 ** 60 + 1, 8], key=str)
    assert kept.columns == frame(spark, rows).columns
    assert language.predict(frame(spark, []), model).collect() == []


def test_language_without_learning_rows(spark):
    empty = language.learn(frame(spark, []))
    assert [tuple(r) for r in language.predict(frame(spark, [(1, "the")]), empty).collect()] == [(1, "und", 0.0)]
    assert language.keep_identified(frame(spark, [(1, "the")]), empty).collect() == []


def test_language_accuracy_on_held_out_documents(spark):
    from verdant.llm.queries import QUERIES
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op5_language_id"](spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_factorization_machine_margin():
    rng = np.random.default_rng(3)
    m = toxicity.Model(0.3, rng.normal(size=toxicity.BUCKETS), rng.normal(size=(toxicity.BUCKETS, toxicity.FACTORS)))
    letters = textgrid.letters()
    texts = ["You are a fool you", "", "123", "über alles und über"]
    doc, term, x = toxicity.features(texts, letters)
    got = m.margins(doc, term, x, len(texts))
    for d in range(len(texts)):
        t, v = term[doc == d], x[doc == d]
        want = m.bias + sum(m.w[a] * b for a, b in zip(t, v))
        want += sum(float(m.v[t[i]] @ m.v[t[j]]) * v[i] * v[j] for i in range(len(t)) for j in range(i))
        assert got[d] == pytest.approx(want, rel=1e-3)


def test_terms_do_not_depend_on_their_place():
    letters = textgrid.letters()
    one = toxicity.features(["alpha beta"], letters)[1]
    two = toxicity.features(["x y z", "Beta -- alpha"], letters)
    assert set(one) == set(two[1][two[0] == 1])


def test_pairs_that_weights_alone_cannot_tell():
    """Toxic if exactly one of an insult and a group is there: no linear score separates these."""
    rng = random.Random(4)
    texts, y = [], []
    for _ in range(1200):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        own = ["insultword"] * insult + ["groupword"] * group + [f"f{rng.choice('abcdefgh')}x" for _ in range(8)]
        rng.shuffle(own)
        texts.append(" ".join(own))
        y.append(float(insult != group))
    letters, y = textgrid.letters(), np.array(y)
    m = toxicity.fit(*toxicity.features(texts[:1000], letters), y[:1000])
    assert ((m.scores(texts[1000:], letters) >= 0.5) == y[1000:]).mean() > 0.95
    linear = toxicity.Model(m.bias, m.w, np.zeros_like(m.v))
    assert ((linear.scores(texts[1000:], letters) >= 0.5) == y[1000:]).mean() < 0.7


def test_terms_that_were_not_learned_weigh_nothing():
    letters = textgrid.letters()
    texts = ["good word here"] * 40 + ["bad word here"] * 40 + ["rareterm word here"]
    m = toxicity.fit(*toxicity.features(texts, letters), np.array([0.0] * 40 + [1.0] * 40 + [1.0]))
    term = set(toxicity.features(["rareterm"], letters)[1]) - set(toxicity.features(texts[:80], letters)[1])
    assert term and all(m.w[t] == 0 and not m.v[t].any() for t in term)


def test_two_hundred_languages():
    """Every language of a long list can be the label."""
    rng = np.random.default_rng(6)
    want = np.repeat(rng.permutation(200), 12)
    score = np.full((len(want), 200), -30.0, np.float32)
    score[np.arange(len(want)), want] = 0
    assert (language.viterbi(score, np.zeros(len(want), np.int64), 1) == want).all()


def test_toxicity_on_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["idiot", "scum"] if i % 4 == 0 else ["nice", "fine"]) for _ in range(6)) + f" {prose(rng, 'en', 30)}") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0), "x") for i in range(400)] + [(None, 1, 1, "x"), (3, None, None, "x"), (5, 1, 0, "x")],
                                   "doc_id long, quality int, toxic int, score string")
    model = toxicity.learn(frame(spark, rows), labels)
    odd = [(1000, None), (1001, ""), (None, "idiot scum idiot"), (1002, "nice " * 50_000), (1003, "idiot scum idiot"), (1003, "idiot scum idiot")]
    got = toxicity.score(frame(spark, rows + odd), model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 400)
    assert {r.predicted for r in got if r.doc_id in (None, 1003)} == {1} and {r.predicted for r in got if r.doc_id == 1002} == {0}
    assert toxicity.score(frame(spark, []), model).collect() == []
    none = toxicity.learn(frame(spark, rows), labels.limit(0))
    assert {r.predicted for r in toxicity.score(frame(spark, rows), none).collect()} == {0}


def test_toxicity_ranks_held_out_documents(spark):
    from verdant.llm.queries import QUERIES
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    got = [(r.score, r.toxic) for r in QUERIES["op6_toxicity"](spark, SF).join(labels, "doc_id").where("held_out").collect()]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in got if x for b, y in got if not y]
    assert sum(pairs) / len(pairs) > 0.8
