"""Line dedup, exact dedup and the n-gram Jaccard join against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from helpers import components, frame, jaccard_links, shingles
from verdant.llm import exact_dedup as exact
from verdant.llm import jaccard, line_dedup
from verdant.llm.components import connected_components

EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (None, "a"), (5, "word " * 60_000), (6, None, None, None)]


def brute_exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), d is None, d))
    out = []
    for d, t in rows:
        norm = re.sub("[\x20\x09-\x0d]", "", t or "")
        keep = min(groups[norm], key=lambda x: x[:2] + (x[2] or 0,))[2]
        out.append((d, keep, len(groups[norm]), d == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def run_exact(spark, rows, first):
    new = exact.digest_rows(frame(spark, [r for r in rows if not first(r)]))
    return [tuple(r) for r in exact.exact_dedup(new, exact.digest_rows(frame(spark, [r for r in rows if first(r)]))).collect()]


@pytest.mark.parametrize("first", [lambda r: (r[0] or 0) % 2, lambda r: True, lambda r: False])
def test_exact_dedup(spark, first):
    rng = random.Random(3)
    rows = [r[:2] for r in EDGE] + [(i, rng.choice(["é  x", "éx", "é\tx ", f"t {i % 40}", f"t{i % 40}"])) for i in range(10, 400)]
    assert sorted(run_exact(spark, rows, first), key=str) == sorted(brute_exact(rows), key=str)


def test_exact_dedup_keeps_large_ids(spark):
    big = 2 ** 62 + 1
    got = run_exact(spark, [(big, "a"), (big + 2, "a b"), (None, "ab"), (7, "c")], lambda r: r[0] == big)
    assert {(r[0], r[1]) for r in got} == {(big, big), (big + 2, big + 2), (None, big + 2), (7, 7)}


def test_exact_dedup_of_empty_tables(spark):
    assert run_exact(spark, [], lambda r: True) == []


def test_perfect_hash_is_minimal_and_perfect():
    raw = np.random.default_rng(1).integers(0, 256, (5000, 32), dtype=np.uint8)
    sizes, bits, slot = exact.perfect_hash(raw)
    assert sorted(slot) == list(range(5000))
    assert (exact.probe(raw, sizes, bits) == slot).all()
    other = exact.probe(np.random.default_rng(2).integers(0, 256, (5000, 32), dtype=np.uint8), sizes, bits)
    assert ((other >= -1) & (other < 5000)).all()


def brute_lines(rows, min_sites):
    sites = defaultdict(set)
    for d, t, _, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(" \t\r") and s is not None:
                sites[line.strip(" \t\r")].add(s)
    bad = {k for k, v in sites.items() if len(v) >= min_sites}
    out = []
    for d, t, _, s in rows:
        lines = [] if t is None else t.split("\n")
        gone = [x for x in lines if x.strip(" \t\r") in bad]
        kept = None if t is None else "\n".join(x for x in lines if x.strip(" \t\r") not in bad)
        out.append((d, kept, len(lines), len(gone)))
    return out


@pytest.mark.parametrize("min_sites", [2, 10, 60])
def test_line_dedup(spark, min_sites):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["", " foot er\r", "foot er", f"l{rng.randrange(30)}", f"own {i}", f"r{rng.randrange(300)}"])
                          for _ in range(rng.randrange(6))), "en", rng.choice([None] + [f"s{k}" for k in range(80)])) for i in range(1500)]
    rows += [(9001, None, None, None), (9002, "", "en", "s1"), (9003, "foot er", "en", "s2"), (9003, "foot er", "en", "s2"),
             (None, "foot er\nx", "en", "s3"), (9004, "line\n" * 20_000, "en", "s4")]
    got = [tuple(r) for r in line_dedup.remove_boilerplate(frame(spark, rows), min_sites=min_sites).collect()]
    assert sorted(got, key=str) == sorted(brute_lines(rows, min_sites), key=str)


def test_line_dedup_of_empty_table(spark):
    assert line_dedup.remove_boilerplate(frame(spark, [])).collect() == []


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(400)]
    docs, n = [], 0
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 150))]
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((n, rng.choice([" ", "\n", "  "]).join(copy)))
            n += 1
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    docs += [(n + i, shared + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 40)))) for i in range(40)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    docs = corpus(random.Random(seed)) + [(5000, None), (5001, ""), (5002, "one two"), (5003, "One  two"), (5004, "a " * 30_000)]
    nodes = [d for d, _ in docs]
    want = components(nodes, jaccard_links(docs))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(frame(spark, docs)).collect()}
    assert got == {d: (len(shingles(t)), want[d]) for d, t in docs}


def test_jaccard_at_the_threshold(spark):
    # 8 of 10 shingles shared: exactly 80 per cent; 7 of 9: less
    a = [f"a{i}" for i in range(13)]
    docs = [(3, " ".join(a)), (2, " ".join(a[:-1] + ["z"])), (1, " ".join(["y"] + a[1:-1] + ["q"]))]
    want = components([1, 2, 3], jaccard_links(docs))
    assert {r.doc_id: r.component_id for r in jaccard.join_components(frame(spark, docs)).collect()} == want


def test_jaccard_nulls_repeats_and_empty(spark):
    long = "p q r s t u v w x y z"
    got = sorted(map(tuple, jaccard.join_components(frame(spark, [(7, long), (7, long), (9, long), (None, long), (None, None)])).collect()), key=str)
    assert got == sorted([(7, 7, 7), (7, 7, 7), (9, 7, 7), (None, 7, None), (None, 0, None)], key=str)
    assert jaccard.join_components(frame(spark, [])).collect() == []
    kept = jaccard.keep_one(frame(spark, [(7, long), (7, long), (9, long), (None, long), (3, None), (4, None)]))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 4, 7, None]
    assert "keep_id" in kept.columns


def test_every_filter_is_safe():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2 ** 64, rng.integers(1, 300), dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 2 ** 64, rng.integers(0, 40), dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        want = len(b) > 0 and 100 * both >= 80 * (len(a) + len(b) - both)
        assert jaccard.similar(a, b, 80) == want
        if want:
            assert jaccard._suffix_filter(a, b, 80)


def test_shingle_hash_does_not_depend_on_place():
    h = jaccard.Hasher()
    assert h.shingles("x y a b c d e")[-1] == h.shingles("A  b\tC d e")[0]
    assert len(set(h.shingles(" ".join(map(str, range(5000))))))== 4996


def test_connected_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (999, 999)]
    df = spark.createDataFrame(links + [(None, 4)], "u long, v long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == components({x for e in links for x in e}, links)
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
