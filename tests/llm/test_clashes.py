"""Rows are never confused, and columns of any name pass through unchanged."""

from collections import Counter

import pytest
from helpers import CLASHING, frame
from verdant.llm import decontam, jaccard, line_dedup, mixing, sharding

ODD = [(None, "5:a b c"), (5, "a b c"), (None, ":x y"), (None, "x y"), (7, None), (7, ""), (8, "same words"), (8, "same words")]


def test_mix_never_replaces_a_row(spark):
    docs = frame(spark, [(*r, "en", f"s{i % 2}") for i, r in enumerate(ODD)])
    took = Counter((r.doc_id, r.text, r.source) for r in mixing.take(docs).collect())
    want = Counter()
    texts = {(r.doc_id, r.text, r.source): 0 for r in docs.collect()}
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    got = Counter()
    for (d, t, s), n in took.items():
        assert (d, t, s) in texts
        got[d, s, len((t or "").split())] += n
    assert got == +want


def test_mix_tells_rows_apart_by_every_column(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1, [1]), (1, "a b", "s", 2, [1]), (1, "a b", "s", None, None), (1, "a b", "s", 1, [1])],
                                 "doc_id long, text string, source string, other int, more array<int>")
    assert Counter((r.other, tuple(r.more or ())) for r in mixing.take(docs).collect()) == {(1, (1,)): 2, (2, (1,)): 1, (None, ()): 1}


def test_targets_do_not_overflow(spark):
    sizes = spark.range(2_000_000).selectExpr("cast(id as string) AS source", "CASE WHEN id = 5 THEN 2000000000000 ELSE 10 END AS size")
    out = mixing.source_targets(sizes)
    assert out.where("target > 3 * source_size").isEmpty() and out.count() == 2_000_000


def test_boilerplate_of_a_twin_stays(spark):
    many = [(100 + i, "boiler plate line", "en", f"s{i}") for i in range(12)]
    rows = [(None, "5:boiler plate line"), (5, "boiler plate line")]
    out = {(r.doc_id, r.text) for r in line_dedup.remove_boilerplate(frame(spark, many + rows)).collect() if r.doc_id in (None, 5)}
    assert out == {(None, "5:boiler plate line"), (5, "")}


@pytest.mark.parametrize("stage", [
    mixing.take, jaccard.keep_one, lambda d: sharding.assign_shards(d, d.sparkSession),
    lambda d: decontam.decontaminate(d, d.sparkSession.createDataFrame([(1, "one two three four five six")], "item_id long, text string"))])
def test_columns_of_any_name_pass(spark, stage):
    rows = [(i, f"{t} some words of their own {i} here") for i, t in enumerate("alpha beta gamma delta".split())] + [(2, "twin"), (None, "none")]
    docs = frame(spark, rows)
    out = stage(docs)
    assert [c for c in out.columns if c not in ("slot", "shard")] == [c for c in docs.columns if c not in ("slot", "shard")]
    for r in out.collect():
        assert all(r[c] == f"x{c}" for c in CLASHING if c not in ("slot", "shard"))
