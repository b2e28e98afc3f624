"""run() against a brute-force version of all stages, and what every stage must keep."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from helpers import components, frame, jaccard_links, shingles, words
from test_scan_and_filter import brute_leaks, brute_table, fill
from verdant.llm import language, mixing, sharding
from verdant.llm.common import read_table

SF = "/root/testdata/sf0.001"


def brute(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    labeller = language.Labeller(language.learn(docs))
    names, share = labeller.documents([r.text or "" for r in rows.values()])
    rows = {d: r for (d, r), n, s in zip(rows.items(), names, share) if n != "und" and s >= language.MIN_SHARE}
    at = components(rows, jaccard_links([(d, r.text) for d, r in rows.items()]))
    rows = {d: r for d, r in rows.items() if at[d] == d}
    items = [(r.item_id, r.text) for r in read_table(spark, sf_dir, "benchmark").collect()]
    leaks = {x[0] for x in brute_leaks([(d, r.text) for d, r in rows.items()], items)}
    rows = {d: r for d, r in rows.items() if d not in leaks}
    sizes, groups = Counter(), defaultdict(list)
    for d, r in rows.items():
        n = len(words(r.text))
        sizes[r.source] += n
        groups[r.source].append((-n, hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest(), d))
    target, copies = fill(dict(sizes)), {}
    for s, group in groups.items():
        rate = target[s] / sizes[s] if sizes[s] else 0
        part = rate - math.floor(rate)
        start = 0.4 + 0.2 * int(hashlib.md5(f"{mixing.SEED}:start:{s}".encode()).hexdigest()[:12], 16) / 16 ** 12
        for k, (_, _, d) in enumerate(sorted(group)):
            copies[d] = math.floor(rate) + math.floor((k + 1) * part + start) - math.floor(k * part + start)
    table = brute_table(sharding.SHARDS, sharding.TABLE_SIZE)
    out = Counter()
    for d, n in copies.items():
        slot = int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        out[d, rows[d].text, rows[d].lang, rows[d].source, rows[d].n_chars, slot, table[slot]] += n
    return +out


def test_run_equals_brute_force(spark):
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == brute(spark, SF)


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "mixing", "sharding"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    text = "the and of that with from this which have been"
    rows = [(1, text), (2, None, None, None), (3, ""), (4, "x " * 30_000), (None, text), (5, text + " more"), (5, text + " more")]
    docs = frame(spark, rows)
    out = stage(spark, docs, SF)
    assert [c for c in out.columns if c not in ("slot", "shard")] == [c for c in docs.columns if c not in ("slot", "shard")]
    assert {r.doc_id for r in out.select("doc_id").collect()} <= {1, 2, 3, 4, 5, None}
    assert stage(spark, docs.limit(0), SF).collect() == []
