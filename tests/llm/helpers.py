"""Small fixtures and brute-force versions for the training-data operators."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside: an input may have columns called so
CLASHING = ["keep_id", "digest", "token", "rank", "size", "slot", "shard", "line", "word", "u", "v", "component", "hs", "key", "copies",
            "_key", "_rows", "_copies", "_row", "_again", "_leak", "_gone", "_at", "_slot", "_shard", "doc", "id", "gone", "leak", "at",
            "name", "of", "rows", "again", "n", "row", "run", "words", "los", "his", "band", "draw", "target", "known"]


def frame(spark, rows, extra=True):
    """``rows`` of (doc_id, text[, lang, source]) as documents, with clashing extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if extra:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit(f"x{c}") for c in CLASHING})
    return df


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(nodes, links):
    at = {n: n for n in nodes}

    def find(a):
        while at[a] != a:
            a = at[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            at[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_links(docs):
    sets = {d: shingles(t) for d, t in docs}
    return [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
            and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
