"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair, and its components."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from verdant.llm.common import SHINGLE_WORDS, SIMILARITY_PERCENT, carried, fit_to_broadcast, staged, whole_text
from verdant.llm.components import connected_components

SKETCH_BITS = 18            # counters of the frequency sketch that orders the shingles
BROADCAST_ROWS = 1_000_000  # ids, of one long each
PARTNERS = 256              # partners of one document that one key deals to a task
FLUSH = 1 << 20             # shingles that a task holds before it counts them
SUFFIX_LOAD = 8             # shingles in a part of the suffix filter

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2 ** 64)


class Hasher:
    """64-bit hashes of a text's word shingles, by polynomial sums over its bytes.

    The words are lower-cased (A-Z) and joined by one space; a shingle's hash depends on its bytes only,
    not on where it stands. The byte values are drawn at random, so structure in the text does not carry over.
    """

    def __init__(self):
        self.value = np.random.default_rng(10).integers(0, 2 ** 64, 256, dtype=np.uint64)
        self.power = self.inverse = np.ones(1, np.uint64)

    @staticmethod
    def _series(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power))
            self.power = self._series(_BASE, n)
            self.inverse = self._series(_INVERSE, n)

    def shingles(self, text: str) -> np.ndarray:
        """In the order of the text, repeats included."""
        data = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
        if not data:
            return np.zeros(0, np.uint64)
        raw = np.frombuffer(data, np.uint8)
        self._powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.value[raw] * self.power[:len(raw)], out=sums[1:])
        gaps = np.flatnonzero(raw == 32)
        start, end = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(raw)]))
        run = min(SHINGLE_WORDS, len(start))
        start, end = start[:len(start) - run + 1], end[run - 1:]
        h = (sums[end] - sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


READ = "doc_id long, n long, d1 long, d2 long, bucket int"


def _read(frames):
    """For each document its set's size and digest; for the task the counts (n) of the sketch's buckets."""
    hasher, count, held, size = Hasher(), np.zeros(1 << SKETCH_BITS, np.int64), [], 0
    for pdf in frames:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            h = np.unique(hasher.shingles(text))
            d1, d2 = np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), np.int64)
            rows.append((doc_id, len(h), d1, d2, -1))
            held.append(_bucket(h))
            size += len(h)
            if size > FLUSH:
                count += np.bincount(np.concatenate(held), minlength=len(count))
                held, size = [], 0
        yield pd.DataFrame(rows, columns=["doc_id", "n", "d1", "d2", "bucket"])
    if held:
        count += np.bincount(np.concatenate(held), minlength=len(count))
    at = np.flatnonzero(count)
    yield pd.DataFrame({"doc_id": 0, "n": count[at], "d1": 0, "d2": 0, "bucket": at})


def read_sets(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, d1, d2) for each row of ``docs``: size and 128-bit digest of its shingle set; and how many
    sets each bucket of the sketch occurs in.

    The sketch is one counter for each of 2 ** SKETCH_BITS buckets, whatever the input; a shingle that many
    documents share lifts its bucket above the others. The counts only order the shingles: any one order
    gives the same links, a rare-first one the fewest candidates.
    """
    read = staged(docs.mapInPandas(_read, READ), "shingle-sets")
    table = read.where("bucket >= 0").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    order = np.zeros(1 << SKETCH_BITS, np.int64)
    order[table["bucket"].to_numpy(np.int64)] = table["n"].to_numpy(np.int64)
    return read.where("bucket < 0").drop("bucket"), order


def prefix_length(n: int, percent: int) -> int:
    """Two sets of ``percent`` similarity share a shingle within their first so many, in any one order."""
    return n - -(-n * percent // 100) + 1


def prefixes(docs: DataFrame, order: np.ndarray, percent: int) -> DataFrame:
    """(token, doc_id, pos, n): the rarest shingles of each document, with their places in its order and the
    size of its set."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def cut(frames):
        hasher, count = Hasher(), shared.value
        for pdf in frames:
            tokens, ids, places, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                h = np.unique(hasher.shingles(text))
                keep = prefix_length(len(h), percent) if len(h) else 0
                # h is in order, so a stable sort by count settles ties by hash
                tokens.append(h[np.argsort(count[_bucket(h)], kind="stable")[:keep]].view(np.int64))
                ids.append(np.full(keep, doc_id))
                places.append(np.arange(keep))
                sizes.append(np.full(keep, len(h)))
            yield pd.DataFrame({"token": np.concatenate(tokens), "doc_id": np.concatenate(ids),
                                "pos": np.concatenate(places), "n": np.concatenate(sizes)})

    return docs.mapInPandas(cut, "token long, doc_id long, pos int, n int")


def _promising(percent: int):
    """Length and positional filter on a pair of rows (n, pos) and (n2, pos2) with one token: neither set
    is too small for the other, and the shingles from this one on can still make up the overlap."""
    n, n2 = F.col("n").cast("long"), F.col("n2").cast("long")
    rest = F.least(n - F.col("pos"), n2 - F.col("pos2"))
    return ((n * 100 >= n2 * percent) & (n2 * 100 >= n * percent)
            & (rest * (100 + percent) >= (n + n2) * percent))


def _length_band(percent: int):
    """Sets of ``percent`` similarity lie in one band of sizes or in adjacent ones: a band's sizes grow by
    100 / ``percent``, with a margin for the rounding of logarithms."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent) * (1 + 1e-9) + 1e-9)).cast("long")


def _suffix_filter(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the sets can still be similar by the sizes of their parts: hash space is cut into equal parts
    of about SUFFIX_LOAD shingles, and what two parts differ in size is missing from the overlap."""
    total = len(a) + len(b)
    bits = max(0, (total // (2 * SUFFIX_LOAD)).bit_length() - 1)
    if not bits:
        return True
    shift, parts = np.uint64(64 - bits), 1 << bits
    apart = np.abs(np.bincount((a >> shift).astype(np.int64), minlength=parts)
                   - np.bincount((b >> shift).astype(np.int64), minlength=parts)).sum()
    return (total - apart) // 2 * (100 + percent) >= total * percent


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two distinct sorted sets have ``percent`` similarity; two empty ones have not."""
    if not len(a) or not len(b) or not _suffix_filter(a, b, percent):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def plausible(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` whose prefixes share enough. ``tokens``: (id, n, ts), the shared prefix tokens.

    In the one order of shingles, what two sets share lies in both prefixes or, beyond the prefix that ends
    first, among that set's remaining shingles; so the overlap is at most the tokens that the prefixes share
    and the longer remainder.
    """
    a = tokens.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("ts").alias("t1"))
    b = tokens.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("ts").alias("t2"))
    rest = F.ceil(F.greatest("n1", "n2") * F.lit(percent) / F.lit(100)) - 1
    most = F.size(F.array_intersect("t1", "t2")) + rest
    both = pairs.join(a, F.col("u") == F.col("a")).join(b, F.col("v") == F.col("b"))
    return both.where(most * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent).select("u", "v")


def verify(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` (distinct, staged) whose texts are similar.

    The texts of the paired documents are dealt by the pair's first document, its own text first and
    its partners after it, PARTNERS to a key, so a document with very many partners spreads over tasks and
    a task holds one set at a time. Documents without a pair never move.
    """
    many = pairs.groupBy(F.col("u").alias("w")).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(PARTNERS))).alias("parts"))
    parted = pairs.join(many, F.col("u") == F.col("w")).select("u", "v", F.pmod(F.xxhash64("v"), F.col("parts")).alias("part"))
    goes = parted.select("u", "part", F.col("v").alias("id"), F.lit(1).alias("role")).unionByName(
        parted.select("u", "part", F.col("u").alias("id"), F.lit(0).alias("role")).distinct())
    goes = staged(goes, "pair-places")
    dealt = docs.join(fit_to_broadcast(goes, BROADCAST_ROWS), F.col("doc_id") == F.col("id")).select("u", "part", "id", "role", "text")

    def check(frames):
        hasher, key, sets = Hasher(), None, []
        for pdf in frames:
            us, vs = [], []
            for u, part, v, text, role in pdf[["u", "part", "id", "text", "role"]].itertuples(index=False):
                mine = np.unique(hasher.shingles(text))
                if role == 0:
                    if key != (u, part):
                        key, sets = (u, part), []
                    sets.append(mine)
                elif key == (u, part) and any(similar(s, mine, percent) for s in sets):
                    us.append(u)
                    vs.append(v)
            yield pd.DataFrame({"u": us, "v": vs}, dtype="int64")

    dealt = dealt.repartition("u", "part").sortWithinPartitions("u", "part", "role")
    return dealt.mapInPandas(check, "u long, v long").distinct()


def join_components(docs: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Two documents link when the Jaccard similarity of their distinct five-word shingles is at least
    ``percent`` per cent; component_id is the least doc_id reachable by links. Candidates are documents that
    share a prefix shingle and pass the length and positional filters and the bound by their whole
    prefixes; a pair is verified on the whole sets once, after the suffix filter. Verification goes in two steps that skip what is already settled: in each group of documents
    with one prefix shingle, first all of them against the one where that shingle stands foremost (the
    least edited of a group of near copies); then every pair that still lies in different components. So
    a group of many near copies costs its size, not its square, and no link between components is lost.
    Documents of one normalised text are one node from the start.

    Null counts as the empty text; a text without words has n_shingles 0 and is linked with nothing.
    Repeated rows get equal answers, and rows of one doc_id with different texts are one document whose
    links are those of any of its texts. What is known of a group (its hub, whether it lies in several components)
    is aggregated, written and joined back, so a group's rows never meet in one task; pairs are formed only between
    adjacent bands of sizes. A null doc_id has a null component and links nothing. Other
    columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = docs.where("doc_id is not null")
    read, order = read_sets(rows)

    # documents of one set: the least doc_id stands for all of them
    heads = staged(read.groupBy("doc_id").agg(F.max("d1").alias("d1"), F.max("d2").alias("d2"), F.max("n").alias("n_shingles"),
                                              F.count(F.lit(1)).alias("rows")), "sets")
    sets = staged(heads.where("n_shingles > 0").groupBy(F.col("d1").alias("s1"), F.col("d2").alias("s2"))
                  .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("docs")).where("docs > 1").drop("docs"), "set-heads")
    same = heads.where("n_shingles > 0").join(sets, (F.col("d1") == F.col("s1")) & (F.col("d2") == F.col("s2"))).where("rep < doc_id")
    copies = fit_to_broadcast(staged(same.select(F.col("doc_id").alias("copy"), "rep"), "copies"), BROADCAST_ROWS)
    reps = rows.join(copies.select("copy"), F.col("doc_id") == F.col("copy"), "left_anti")

    # groups of documents with one prefix shingle; a group's hub is the document where it stands foremost
    rare = staged(prefixes(reps, order, percent), "prefixes")
    foremost = F.min(F.struct("pos", "n", "doc_id"))
    groups = rare.groupBy(F.col("token").alias("t")).agg(foremost.alias("first"), F.count(F.lit(1)).alias("docs")).where("docs > 1")
    groups = staged(groups.select("t", F.col("first.doc_id").alias("hub"), F.col("first.n").alias("n2"),
                                  F.col("first.pos").alias("pos2")), "groups")
    members = staged(rare.join(groups, F.col("token") == F.col("t")).drop("t"), "members")
    tokens = staged(members.groupBy(F.col("doc_id").alias("id")).agg(
        F.first("n").cast("long").alias("n"), F.collect_set("token").alias("ts")), "prefix-tokens")

    to_hub = staged(members.where((F.col("doc_id") != F.col("hub")) & _promising(percent))
                    .select(F.col("hub").alias("u"), F.col("doc_id").alias("v")).distinct(), "hub-pairs")
    links = staged(verify(staged(plausible(to_hub, tokens, percent), "hub-pairs"), rows, percent), "links")
    labels = fit_to_broadcast(staged(connected_components(links), "labels"), BROADCAST_ROWS)

    # what is left: pairs of one group whose ends still lie in different components
    side = staged(members.where("doc_id <> hub").join(labels, F.col("doc_id") == F.col("node"), "left")
                  .select("token", "doc_id", "pos", "n", F.coalesce("component", "doc_id").alias("c")), "group-labels")
    mixed = side.groupBy(F.col("token").alias("t")).agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    mixed = staged(mixed.where("lo <> hi").select("t"), "mixed-groups")
    side = side.join(mixed, F.col("token") == F.col("t")).drop("t").withColumn("band", _length_band(percent))
    side = staged(side, "open-groups")
    near = F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1))
    other = side.select(F.col("token").alias("t2"), F.col("doc_id").alias("v"), F.col("pos").alias("pos2"),
                        F.col("n").alias("n2"), F.col("c").alias("c2"), near.alias("band2"))
    met = ((F.col("token") == F.col("t2")) & (F.col("band") == F.col("band2")) & (F.col("doc_id") < F.col("v"))
           & (F.col("c") != F.col("c2")) & _promising(percent))
    cross = side.join(other, met).select(F.col("doc_id").alias("u"), "v").distinct()
    done = to_hub.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    cross = staged(cross.join(done, (F.col("u") == F.col("a")) & (F.col("v") == F.col("b")), "left_anti"), "open-pairs")
    more = staged(verify(staged(plausible(cross, tokens, percent), "open-pairs"), rows, percent), "links")
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more))

    named = heads.join(copies, F.col("doc_id") == F.col("copy"), "left").select(
        "doc_id", "n_shingles", "rows", F.coalesce("rep", "doc_id").alias("rep"))
    found = named.join(labels, F.col("rep") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"),
        F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("one")).drop("one")
    nameless = docs.where("doc_id is null").withColumn("doc_id", F.lit(0).cast("long")).mapInPandas(_read, READ).where("bucket < 0")
    return found.unionByName(nameless.select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"),
                                             F.lit(None).cast("long").alias("component_id")))


def keep_one(docs: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does, the least doc_id.

    All columns stay, whatever their names. Documents without words and rows without a doc_id are left alone.
    Of rows that repeat a doc_id one stays.
    """
    found = join_components(docs, percent)
    gone = staged(found.where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct(), "near-duplicates")
    rows = carried(docs, id=F.col("doc_id").cast("long"))
    kept = rows.join(fit_to_broadcast(gone, BROADCAST_ROWS), F.col("id") == F.col("gone"), "left_anti")
    again = rows.where("id is not null").groupBy(F.col("id").alias("again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = staged(again.select("again"), "repeated-ids")
    if again.isEmpty():
        return kept.select("doc.*")
    hint = fit_to_broadcast(again, BROADCAST_ROWS)
    on = F.col("id") == F.col("again")
    return kept.join(hint, on, "left_anti").unionByName(kept.join(hint, on, "left_semi").dropDuplicates(["id"])).select("doc.*")
