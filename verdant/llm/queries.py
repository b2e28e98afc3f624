"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdant.llm import exact_dedup as exact
from verdant.llm import (decontam, infilling, jaccard, language, line_dedup, mixing, secrets, sharding, substrings, toxicity, url_filter,
                         whitening)
from verdant.llm.common import SIMILARITY_PERCENT, UPPER, held_out, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return register


@query(f"""
WITH lines AS (
  SELECT doc_id, source, i, string_split(text, chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
bad AS (
  SELECT trim(line, ' ' || chr(9) || chr(13)) AS line FROM lines
  WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
kept AS (
  SELECT doc_id, i, l.line, b.line IS NOT NULL AS gone
  FROM lines l LEFT JOIN bad b ON trim(l.line, ' ' || chr(9) || chr(13)) = b.line),
texts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS text FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       length(coalesce(t.text, '')) AS n_chars_kept, sha256(coalesce(t.text, '')) AS kept_sha256
FROM documents d LEFT JOIN texts t USING (doc_id)
""")
def op1_line_dedup(spark, sf_dir):
    out = line_dedup.remove_boilerplate(read_table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("n_chars_kept"),
                      F.sha2(text, 256).alias("kept_sha256"))


@query()
def op2_secret_scan(spark, sf_dir):
    return secrets.scan(read_table(spark, sf_dir, "documents"))


@query("""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS kept, text_sha256
FROM d
""")
def op3_exact_dedup(spark, sf_dir):
    """The table arrives in two batches by a hash bit of doc_id: the index is built over the distinct
    digests of the first, the second is looked up in it, and the result covers both."""
    docs = read_table(spark, sf_dir, "documents")
    first = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(True))
    rows = exact.staged(exact.digest_rows(docs).withColumn("first", first), "digest-rows")
    return exact.exact_dedup(rows.where(~F.col("first")), rows.where("first"))


@query(f"""
WITH RECURSIVE pref AS (
  SELECT s AS shard,
         ('0x' || substr(md5('offset:' || s), 1, 15))::BIGINT % {sharding.TABLE_SIZE} AS off,
         ('0x' || substr(md5('skip:' || s), 1, 15))::BIGINT % {sharding.TABLE_SIZE - 1} + 1 AS skip
  FROM range({sharding.SHARDS}) AS t(s)),
orders AS (
  SELECT shard, list((off + k * skip) % {sharding.TABLE_SIZE} ORDER BY k) AS slots
  FROM pref, range({sharding.TABLE_SIZE}) AS r(k) GROUP BY shard),
claims AS (
  SELECT 0::BIGINT AS turn, (SELECT slots[1] FROM orders WHERE shard = 0) AS slot,
         [(SELECT slots[1] FROM orders WHERE shard = 0)] AS taken
  UNION ALL
  SELECT turn + 1, pick, list_append(taken, pick) FROM (
    SELECT c.turn, c.taken, list_filter(o.slots, lambda s: NOT list_contains(c.taken, s))[1] AS pick
    FROM claims c JOIN orders o ON o.shard = (c.turn + 1) % {sharding.SHARDS}
    WHERE c.turn + 1 < {sharding.TABLE_SIZE}))
SELECT doc_id, slot::INTEGER AS slot, (turn % {sharding.SHARDS})::INTEGER AS shard
FROM documents JOIN claims
  ON claims.slot = ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.TABLE_SIZE}
""")
def op4_sharding(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(docs, spark)


@query()
def op5_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    found = language.predict(docs, language.learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query()
def op6_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query(f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM benchmark),
ds AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' ')) END) AS s FROM d),
sh AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' ')) END) AS s FROM i),
n AS (SELECT item_id, count(*) AS n_shingles FROM sh GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN sh USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared FROM shared JOIN n USING (item_id)
WHERE n_shared * 100 >= n_shingles * {SIMILARITY_PERCENT}
""")
def op7_decontamination(spark, sf_dir):
    return decontam.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query(r"""
WITH RECURSIVE p0 AS (
  SELECT page_id, html, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, html, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM p0),
rules(rule_host, rule_path, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (
  SELECT page_id, rule_host || rule_path AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS k
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (SELECT page_id, rule, v FROM fit WHERE k = 1),
keyed AS (
  SELECT p.*, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS key
  FROM (SELECT *, coalesce(array_to_string(list_sort(list_filter(string_split(
      regexp_extract(regexp_replace(url, '(?s)#.*', ''), '(?s)\?(.*)', 1), '&'),
      lambda x: NOT starts_with(x, 'utm_') AND x <> '')), '&'), '') AS q FROM p) p),
targets AS (
  SELECT key AS u, regexp_extract(html, '(?is)<link[^>]*rel\s*=\s*["'']?canonical[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1) AS t
  FROM keyed WHERE contains(lower(html), 'canonical')),
edges AS (
  SELECT u, regexp_replace(regexp_replace(t, '^[^:]*://', ''), '/+$', '') AS w FROM targets WHERE t <> '' AND u IS NOT NULL),
both_ways AS (SELECT u, w FROM edges UNION SELECT w, u FROM edges),
reach AS (
  SELECT DISTINCT key AS a, key AS b FROM keyed WHERE key IS NOT NULL
  UNION SELECT r.a, e.w FROM reach r JOIN both_ways e ON r.b = e.u),
comp AS (SELECT a AS key, min(b) AS component FROM reach GROUP BY a),
decision AS (
  SELECT component, coalesce(bool_or(v = 'block'), false) AND NOT coalesce(bool_or(v = 'allow'), false) AS blocked
  FROM keyed JOIN comp USING (key) LEFT JOIN best USING (page_id) GROUP BY component)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(v, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, component
FROM keyed LEFT JOIN best USING (page_id) LEFT JOIN comp USING (key) LEFT JOIN decision USING (component)
""")
def op8_url_filter(spark, sf_dir):
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


@query(f"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{mixing.SEED}' || CASE WHEN doc_id IS NULL THEN '' ELSE ':' || doc_id END) AS draw FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight
  FROM sizes GROUP BY source),
total AS (SELECT sum(source_size)::BIGINT AS t FROM sources),
levels AS (
  SELECT 0 AS round, (SELECT t FROM total) AS spare, (SELECT sum(weight)::BIGINT FROM sources) AS shares
  UNION ALL
  SELECT round + 1, spare2, shares2 FROM (
    SELECT l.round, l.spare, l.shares,
           (SELECT t FROM total) - sum(CASE WHEN weight * l.spare > 3 * source_size * l.shares THEN 3 * source_size ELSE 0 END)::BIGINT AS spare2,
           sum(CASE WHEN weight * l.spare > 3 * source_size * l.shares THEN 0 ELSE weight END)::BIGINT AS shares2
    FROM levels l, sources GROUP BY l.round, l.spare, l.shares)
  WHERE (spare2, shares2) <> (spare, shares) AND shares2 > 0),
level AS (SELECT spare, shares FROM levels ORDER BY round DESC LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN weight * spare > 3 * source_size * shares THEN (3 * source_size)::DOUBLE
              ELSE (weight * spare)::DOUBLE / shares::DOUBLE END AS target
  FROM sources, level),
plan AS (
  SELECT *, floor(rate) AS whole, rate - floor(rate) AS part,
         0.4e0 + 0.2e0 * (('0x' || substr(md5(concat_ws(':', '{mixing.SEED}', 'start', source)), 1, 12))::BIGINT::DOUBLE / 281474976710656e0) AS start
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0e0 END AS rate FROM targets)),
ranks AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY size DESC, draw, doc_id) - 1)::DOUBLE AS rank FROM sizes)
SELECT r.doc_id, r.size, p.source_size, p.target,
       ((whole + floor((rank + 1) * part + start) - floor(rank * part + start))::BIGINT * r.size) AS taken
FROM ranks r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
""")
def op9_mixing(spark, sf_dir):
    out = mixing.mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query(f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_in JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= {SIMILARITY_PERCENT} * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)
""")
def op10_jaccard_join(spark, sf_dir):
    return jaccard.join_components(read_table(spark, sf_dir, "documents"))


@query(f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
w AS (
  SELECT r, i, sha256(array_to_string(ws[i:i + {substrings.WINDOW_WORDS - 1}], ' ')) AS h
  FROM d, unnest(range(1, len(ws) - {substrings.WINDOW_WORDS - 2})) AS u(i)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
covered AS (SELECT DISTINCT r, i + k AS i FROM repeated, range({substrings.WINDOW_WORDS}) AS t(k)),
gone AS (SELECT r, list(i) AS gone FROM covered GROUP BY r),
kept AS (
  SELECT doc_id, ws, CASE WHEN gone IS NULL THEN ws
    ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda k: NOT list_contains(gone, k)), lambda k: ws[k]) END AS ks
  FROM d LEFT JOIN gone USING (r))
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - len(ks))::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(ks, ' '), '')) AS kept_sha256 FROM kept
""")
def op11_substring_dedup(spark, sf_dir):
    out = substrings.remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op12_whitening(spark, sf_dir):
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


@query(f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{infilling.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]', 0, 's') AS u FROM documents),
p AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS e FROM t),
q AS (
  SELECT doc_id, text, n,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= {infilling.TRANSFORMED} THEN 'plain'
              WHEN e < {infilling.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form,
         coalesce(array_to_string(u[1:least(a, b)], ''), '') AS prefix,
         coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS middle,
         coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') AS suffix FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM q
""")
def op13_infilling(spark, sf_dir):
    out = infilling.fill_in_middle(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(infilling.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
