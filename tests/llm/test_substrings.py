"""Substring deduplication against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import frame
from verdant.llm import substrings


def expected(rows, size):
    docs = [(d, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for d, t in rows]
    seen = Counter(tuple(w[i:i + size]) for _, w in docs for i in range(len(w) - size + 1))
    out = []
    for d, w in docs:
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i:i + size])] > 1 for j in range(i, i + size)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def got(spark, rows, parts=4, **kw):
    out = substrings.remove_repeats(frame(spark, rows).repartition(parts), **kw)
    return sorted((tuple(r) for r in out.collect()), key=str)


def text(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    shared = [text(rng, n) for n in (34, 35, 36, 50, 70, 200)]
    rows = [(i, " ".join(rng.choice([text(rng, rng.randrange(60)), rng.choice(shared)]) for _ in range(rng.randrange(6)))) for i in range(120)]
    same = text(rng, 90)
    rows += [(200 + i, same) for i in range(30)]                                    # copies
    words = same.split()
    rows += [(300 + i, " ".join(words[:i] + ["edit"] + words[i + 1:])) for i in range(0, 90, 3)]  # near copies
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (None, same), (None, None), (5, "an id used twice")]
    rows += [(404, "tick " * 100), (405, "a b " * 40), (406, "tock " * 35), (407, "tack " * 34)]  # repeats within one
    rows += [(408, shared[3].replace(" ", "\r\n \t")), (409, shared[3].upper())]
    rows += [(410, text(rng, 60_000, 50)), (411, "漢字 é " * 10 + "end " + "漢字 é " * 30)]
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_every_repeated_window_goes_and_nothing_else(spark, parts):
    rows = corpus()
    assert got(spark, rows, parts) == expected(rows, 35)


def test_other_lengths(spark):
    rows = corpus(2)[:150]
    for size, first in ((2, 9), (8, 3), (50, 1)):
        assert got(spark, rows, words=size, first=first) == expected(rows, size)


def test_small_alphabet(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, rng.randrange(40), 2)) for i in range(200)]
    assert got(spark, rows, words=10, first=2) == expected(rows, 10)


def test_empty_and_single_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, "just one text")]) == [(1, 3, 0, "just one text")]


def test_levels_double():
    assert substrings.levels(35, 9) == [9, 18, 35] and substrings.levels(5, 9) == [5]
    for words in range(1, 200):
        steps = substrings.levels(words, 4)
        assert steps[-1] == words and all(a < b <= 2 * a for a, b in zip(steps, steps[1:]))


def test_least_inside_takes_the_first_of_equals():
    h = np.random.default_rng(1).integers(0, 5, 300).astype(np.uint64)
    for run in (1, 2, 5, 8, 27):
        at = substrings.least_inside(h, run)
        assert list(at) == [i + int(np.argmin(h[i:i + run])) for i in range(300 - run + 1)]


def test_a_hot_window_sends_one_row_a_batch(spark):
    """Copies within a batch are settled there, so a window of every document is no hot key."""
    same = text(random.Random(4), 60)
    docs = spark.range(0, 4000, 1, 4).selectExpr("id AS row", f"'{same}' AS words")
    asked = docs.mapInArrow(substrings._ask(35, 35), substrings.ASKED)
    assert asked.where("known = 0").count() == 0
    assert asked.where("known = 2").count() == 4 * 26


def test_texts_move_once(spark):
    """The joins of the levels read the numbered texts in place."""
    numbered = substrings.numbered_words(frame(spark, corpus()))
    held = spark.createDataFrame([(0, [1], [2])], substrings.RUNS)
    for how in ("inner", "left"):
        plan = numbered.join(held.hint("merge"), "row", how)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1, plan
