"""Exact deduplication against a minimal perfect hash of the digests seen before."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from verdant.llm.common import BLANKS, follow_leaders, staged, whole_text

DIGEST_BYTES = 32
BUCKET_DIGESTS = 8192  # expected digests in one bucket of the index
LEVELS = 64

GROUP = "digest binary, points long, doc_id long, n long"


def digest_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, points) per row: SHA-256 of the text without white space, code points of the
    original text. Null counts as the empty text; other columns of ``docs`` are not looked at."""
    text = whole_text()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.unhex(F.sha2(F.translate(text, BLANKS, ""), 256)).alias("digest"),
                       F.length(text).cast("long").alias("points"))


def winners(rows: DataFrame) -> DataFrame:
    """One row per digest: the winner (most code points, then least doc_id, a null id last) and the group size.

    The aggregation combines before the shuffle, so a digest with a third of all rows is no hot key.
    """
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d")))
    return (rows.groupBy("digest").agg(best.alias("w"), F.count(F.lit(1)).alias("n"))
            .select("digest", (-F.col("w.p")).alias("points"), F.col("w.d").alias("doc_id"), "n"))


def _bucket(n_buckets: int):
    return F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long") % n_buckets


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of each digest, from which every level derives its position."""
    w = np.ascontiguousarray(raw).view(np.uint64)
    return w[:, 1], w[:, 2] | np.uint64(1)


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    h = a + np.uint64(level + 1) * b
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return (h % np.uint64(size)).astype(np.int64)


def perfect_hash(raw: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, bit map and the slot of each of the distinct digests ``raw`` (n x 32 bytes).

    At each level the remaining digests are thrown at as many positions; those that are alone keep
    theirs (a set bit), the others go to the next level. A digest's slot is the number of set bits
    before its own, so n digests fill the slots 0..n-1.
    """
    a, b = _words(raw)
    left = np.arange(len(raw))
    sizes, maps, position, start = [], [], np.zeros(len(raw), np.int64), 0
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("digests are not distinct")
        size = len(left)
        at = _place(a[left], b[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        ok = alone[at]
        position[left[ok]] = start + at[ok]
        sizes.append(size)
        maps.append(alone)
        start += size
        left = left[~ok]
    bits = np.concatenate(maps) if maps else np.zeros(0, bool)
    rank = np.cumsum(bits) - 1
    return sizes, bits, (rank[position] if len(raw) else position)


def probe(raw: np.ndarray, sizes, bits: np.ndarray) -> np.ndarray:
    """The slot that the index gives each digest, -1 if no level has its bit. A slot is only a
    claim: a digest outside the index may get one, so the caller compares the digest kept there."""
    a, b = _words(raw)
    rank = np.cumsum(bits) - 1
    slot, left, start = np.full(len(raw), -1, np.int64), np.arange(len(raw)), 0
    for level, size in enumerate(sizes):
        at = start + _place(a[left], b[left], level, size)
        hit = bits[at]
        slot[left[hit]] = rank[at[hit]]
        left = left[~hit]
        start += size
    return slot


def _matrix(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, DIGEST_BYTES)


INDEX = ("bucket long, digest binary, points long, doc_id long, n long, sizes array<long>, bits binary, "
         "digests binary, slot_points binary, slot_ids binary, slot_n binary")
NO_ID = -(2 ** 63)  # stands for a null doc_id inside the tasks: pandas has no null among 64-bit integers


def _build(key, pdf: pd.DataFrame) -> pd.DataFrame:
    raw = _matrix(pdf["digest"])
    sizes, bits, slot = perfect_hash(raw)
    order = np.argsort(slot)

    def column(name):
        return pdf[name].to_numpy(np.int64)[order].tobytes()

    return pd.DataFrame({"bucket": [key[0]], "digest": [b""], "points": [0], "doc_id": [0], "n": [0],
                         "sizes": [sizes], "bits": [np.packbits(bits).tobytes()], "digests": [raw[order].tobytes()],
                         "slot_points": [column("points")], "slot_ids": [column("doc_id")], "slot_n": [column("n")]})


def _id():
    return F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")


def build_index(history: DataFrame) -> tuple[DataFrame, int]:
    """Index of ``history`` (one ``winners`` row per digest), written to the shared folder, and its buckets.

    A digest's leading bytes choose its bucket; the bucket count follows the number of digests, so a
    bucket stays near BUCKET_DIGESTS at any size. Each bucket's row has the perfect hash and, per
    slot, the full digest, the winner's doc_id and code points, and the group size.
    """
    n_buckets = max(1, math.ceil(history.count() / BUCKET_DIGESTS))
    rows = history.select(_bucket(n_buckets).alias("bucket"), "digest", "points", _id(), "n")
    return staged(rows.groupBy("bucket").applyInPandas(_build, INDEX), "digest-index"), n_buckets


FOUND = GROUP + ", known boolean, h_points long, h_doc_id long, h_n long"


def _look(frames):
    bucket, index = None, None
    for pdf in frames:
        for (at, role), run in pdf.groupby(["bucket", "role"]):
            if role == 0:
                row = run.iloc[0]
                raw = np.frombuffer(row["digests"], np.uint8).reshape(-1, DIGEST_BYTES)
                bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sum(row["sizes"]))).astype(bool)
                slots = [np.frombuffer(row[c], np.int64) for c in ("slot_points", "slot_ids", "slot_n")]
                bucket, index = at, (row["sizes"], bits, raw, slots)
                continue
            out = run[["digest", "points", "doc_id", "n"]].copy()
            known = np.zeros(len(run), bool)
            old = [np.full(len(run), NO_ID if c == "id" else 0, np.int64) for c in ("points", "id", "n")]
            if bucket == at:
                sizes, bits, raw, slots = index
                asked = _matrix(run["digest"])
                slot = probe(asked, sizes, bits)
                known = slot >= 0
                known[known] = (raw[slot[known]] == asked[known]).all(axis=1)
                for mine, kept in zip(old, slots):
                    mine[known] = kept[slot[known]]
            out["known"], out["h_points"], out["h_doc_id"], out["h_n"] = known, *old
            yield out


def lookup(groups: DataFrame, index: DataFrame, n_buckets: int) -> DataFrame:
    """``groups`` (one row per digest) with ``known`` and, where the byte check agrees, what the slot holds.

    Each bucket's index row leads the digests of that bucket through one task; digests stream by.
    """
    asked = groups.select(_bucket(n_buckets).alias("bucket"), "digest", "points", _id(), "n",
                          *[F.lit(None).cast(t).alias(c) for c, t in (
                              ("sizes", "array<long>"), ("bits", "binary"), ("digests", "binary"),
                              ("slot_points", "binary"), ("slot_ids", "binary"), ("slot_n", "binary"))])
    found = follow_leaders(index, asked, ["bucket"], _look, FOUND)
    return found.withColumns({c: F.when(F.col(c) != NO_ID, F.col(c)) for c in ("doc_id", "h_doc_id")})


def exact_dedup(new: DataFrame, history: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``history`` and ``new``
    (both of ``digest_rows``).

    New digests that the index of historical digests knows join the historical group; the others
    form groups among themselves. In either case the row with the most code points, then the least
    doc_id, stays. Rows that repeat a doc_id and its text share one fate: each is reported, with the
    same answer. A null doc_id loses every tie and is never reported as kept unless its whole group is null.
    """
    old = staged(winners(history), "digest-history")
    index, n_buckets = build_index(old)
    looked = lookup(winners(new), index, n_buckets)
    mine = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"))
    theirs = F.struct((-F.col("h_points")).alias("p"), F.col("h_doc_id").isNull().alias("z"), F.col("h_doc_id").alias("d"))
    best = F.when(F.col("known"), F.least(mine, theirs)).otherwise(mine)
    joined = looked.select("digest", best.alias("w"), (F.col("n") + F.col("h_n")).alias("n"))
    groups = (old.select("digest", mine.alias("w"), "n").unionByName(joined)
              .groupBy("digest").agg(F.min("w").alias("w"), F.max("n").alias("n")))
    groups = groups.select(F.col("digest").alias("group_digest"), F.col("w.d").alias("keep_id"),
                           F.col("n").alias("group_size"))
    rows = history.select("doc_id", "digest").unionByName(new.select("doc_id", "digest"))
    return (rows.join(groups, F.col("digest") == F.col("group_digest"))
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))
