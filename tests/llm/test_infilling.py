"""Fill-in-middle against a plain Python version."""

import hashlib
import re

from helpers import frame
from pyspark.sql import functions as F
from verdant.llm import infilling


def expected(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


ROWS = [(None, "a null id, twice"), (None, "a null id, twice"), (1, None), (2, ""), (3, " "), (4, "word"), (5, "é漢😀 mixed\r\n\x00\x0b text"),
        (6, "has <S> inside"), (7, "<P"), (8, "S><<P<M"), (9, "ends in <"), (-4, "a negative id"), (2 ** 62, "a large id"),
        (10, "long words and 123 " * 40_000), (11, "x" * 3_000_000), (12, "漢" * 300_000)]
ROWS += [(i, f"row {i}: <{'<' * (i % 3)}M some words, S>") for i in range(100, 400)]


def test_forms_and_round_trip(spark):
    out = infilling.fill_in_middle(frame(spark, ROWS).repartition(3))
    got = [tuple(r) for r in out.collect()]
    key = (lambda r: (str(r[0]), r[5]))
    assert sorted(got, key=key) == sorted((expected(*r) for r in ROWS), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = out.select("doc_id", infilling.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted((str(r.doc_id), r.t) for r in back) == sorted((str(d), t or "") for d, t in ROWS)


def test_settings_change_the_draws(spark):
    docs = frame(spark, [(i, "one two three four") for i in range(200)])
    forms = lambda **kw: [r.form for r in infilling.fill_in_middle(docs, **kw).orderBy("doc_id").collect()]
    assert set(forms(percent=0)) == {"plain"}
    assert set(forms(percent=100, spm_percent=100)) == {"spm"}
    assert forms(seed=2) != forms(seed=3) and forms(seed=2) == forms(seed=2)


def test_empty_table(spark):
    assert infilling.fill_in_middle(frame(spark, [])).collect() == []
