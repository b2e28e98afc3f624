"""Substring deduplication: word windows that repeat, found level by level on windows of doubling length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from verdant.llm.common import BLANKS, WORD_BREAK, staged, staged_by_key, whole_text

WINDOW_WORDS = 35
FIRST_WORDS = 9        # the first level's length, reached by halving WINDOW_WORDS

SLICE_BYTES = 1 << 21  # text that a task hashes at once; a longer text is hashed on its own

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2 ** 64)
SPACE, LINE = 32, 10   # between words and between documents


def levels(words: int = WINDOW_WORDS, first: int = FIRST_WORDS) -> list[int]:
    """The lengths from about ``first`` up to ``words``, each at most twice the one before."""
    out = [words]
    while out[0] > first:
        out.insert(0, -(-out[0] // 2))
    return out


class WindowHasher:
    """64-bit hashes of all runs of words in a block of text, from one running sum over its bytes.

    A run's hash depends on its bytes only, words joined by one space. The byte values are drawn at random.
    """

    def __init__(self):
        self.value = np.random.default_rng(11).integers(0, 2 ** 64, 256, dtype=np.uint64)
        self.power = self.inverse = np.ones(1, np.uint64)

    @staticmethod
    def _series(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def read(self, text: bytes) -> None:
        """Take a block: documents of words with one space between, separated by line feeds."""
        raw = np.frombuffer(text, np.uint8)
        if len(self.power) <= len(raw):
            n = max(len(raw) + 1, 2 * len(self.power))
            self.power, self.inverse = self._series(_BASE, n), self._series(_INVERSE, n)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.value[raw] * self.power[:len(raw)], out=self.sums[1:])
        gaps = np.flatnonzero((raw == SPACE) | (raw == LINE))
        self.start = np.concatenate(([0], gaps + 1))
        self.end = np.concatenate((gaps, [len(raw)]))
        self.doc = np.concatenate(([0], np.cumsum(raw[gaps] == LINE)))

    def windows(self, length: int) -> np.ndarray:
        """The hash of the ``length`` words from each word on; windows may run over documents."""
        n = max(0, len(self.start) - length + 1)
        start, end = self.start[:n], self.end[length - 1:length - 1 + n]
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def least_inside(h: np.ndarray, run: int) -> np.ndarray:
    """For each i the place of the least of h[i:i + run], the first of equal ones."""
    at, width = np.arange(len(h)), 1
    while width < run:
        step = min(width, run - width)
        left, right = at[:len(at) - step], at[step:]
        at = np.where(h[right] < h[left], right, left)
        width += step
    return at


def _blocks(rows: list, hasher: WindowHasher) -> Iterator[list]:
    """Runs of ``rows`` (text last) of about SLICE_BYTES, read by the hasher."""
    held, size = [], 0
    for row in rows:
        if held and size + len(row[-1]) > SLICE_BYTES:
            hasher.read(b"\n".join(r[-1] for r in held))
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[-1])
    if held:
        hasher.read(b"\n".join(r[-1] for r in held))
        yield held


ASKED = "h long, row long, run long, known int"


def _ask(length: int, words: int):
    """Task function over (row, words[, los, his]): the windows to look up at this level.

    Each window of ``words`` words that is still open is looked up by one of the ``length``-word windows
    inside it, the one of least hash, so equal windows ask for equal ones; neighbours mostly ask for the
    same. A row (h, row, run): the windows from lo to hi of a document ask for h; run is lo * 2^32 + hi.
    What already repeats within the batch is ``known`` 1 and needs no partner; one such row more,
    ``known`` 2, tells the others. So of a window that very many documents hold each batch sends one row.
    """
    def run(batches):
        hasher = WindowHasher()
        for batch in batches:
            open_runs = "los" in batch.schema.names
            cols = [batch.column("row").to_pylist()]
            if open_runs:
                cols += [batch.column("los").to_pylist(), batch.column("his").to_pylist()]
            cols.append(batch.column("words").cast(pa.large_binary()).to_pylist())
            out = [[], [], []]
            for held in _blocks(list(zip(*cols)), hasher):
                n = len(hasher.start) - words + 1
                if n <= 0:
                    continue
                first = np.searchsorted(hasher.doc, np.arange(len(held)))  # each document's first word
                if open_runs:
                    # +1 where an open run begins, -1 after its end
                    change = np.zeros(len(hasher.start) + 1, np.int64)
                    counts = np.array([len(r[1]) for r in held])
                    base = np.repeat(first, counts)
                    np.add.at(change, base + np.concatenate([r[1] for r in held]).astype(np.int64), 1)
                    np.add.at(change, base + np.concatenate([r[2] for r in held]).astype(np.int64) + 1, -1)
                    is_open = np.cumsum(change)[:n] > 0
                else:
                    is_open = hasher.doc[:n] == hasher.doc[words - 1:]
                q = np.flatnonzero(is_open)
                if not len(q):
                    continue
                h = hasher.windows(length)
                p = least_inside(h, words - length + 1)[q]
                new = np.concatenate(([True], (p[1:] != p[:-1]) | (q[1:] != q[:-1] + 1) | (hasher.doc[q[1:]] != hasher.doc[q[:-1]])))
                begin = np.flatnonzero(new)
                last = np.concatenate((begin[1:], [len(q)])) - 1
                doc = hasher.doc[q[begin]]
                out[0].append(h[p[begin]])
                out[1].append(np.array([r[0] for r in held], np.int64)[doc])
                out[2].append(((q[begin] - first[doc]) << 32) + q[last] - first[doc])
            if not out[0]:
                continue
            h, row, runs = (np.concatenate(x) for x in out)
            _, one, place, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            known = (count[place] > 1).astype(np.int32)
            tell = one[count > 1]
            h, row, runs = (np.concatenate((x, x[tell])) for x in (h, row, runs))
            known = np.concatenate((known, np.full(len(tell), 2, np.int32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(row), pa.array(runs), pa.array(known)], ["h", "row", "run", "known"])

    return run


RUNS = "row long, los array<int>, his array<int>"


def _merge(batches):
    """(row, runs) -> (row, los, his): the runs of a document joined where they touch."""
    for batch in batches:
        lists = batch.column("runs")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((flat, owner))
        flat, owner = flat[order], owner[order]
        lo, hi = flat >> 32, flat & 0xFFFFFFFF
        # runs of one document do not overlap, so the end before is the greatest so far
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (lo[1:] > hi[:-1] + 1)))
        begin = np.flatnonzero(new)
        last = np.concatenate((begin[1:], [len(flat)])) - 1
        count = np.bincount(owner[begin], minlength=len(sizes))
        offsets = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.ListArray.from_arrays(offsets, pa.array(lo[begin].astype(np.int32))),
             pa.ListArray.from_arrays(offsets, pa.array(hi[last].astype(np.int32)))], ["row", "los", "his"])


def survivors(docs: DataFrame, length: int, words: int, name: str) -> DataFrame:
    """(row, los, his): the open windows of ``docs`` (row, words[, los, his]) whose window of this level also
    occurs elsewhere, as runs of starts per document.

    The rows of one hash meet in one task; what repeats within a batch was settled before, so no hash has
    more rows than there are batches.
    """
    asked = docs.mapInArrow(_ask(length, words), ASKED)
    # settled rows only pass through, dealt by themselves
    key = F.when(F.col("known") == 1, F.xxhash64("row", "run")).otherwise(F.col("h"))
    found = (asked.select(key.alias("key"), "row", "run", "known")
             .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
             .where((F.col("known") == 1) | ((F.col("known") == 0) & (F.col("n") > 1))))
    runs = found.groupBy("row").agg(F.collect_list("run").alias("runs"))
    return staged(runs.mapInArrow(_merge, RUNS), name)


def numbered_words(docs: DataFrame) -> DataFrame:
    """(row, doc_id, words) for every row of ``docs``: a number of its own, its words joined by one space.

    Written to the shared folder, so the numbers stand whatever is read again, and bucketed by them, so the
    texts move this once and the levels read them in place.
    """
    words = F.regexp_replace(F.btrim(whole_text(), F.lit(BLANKS)), WORD_BREAK, " ")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    return staged_by_key(rows, "row", "numbered-words")


def repeated_windows(numbered: DataFrame, words: int = WINDOW_WORDS, first: int = FIRST_WORDS) -> DataFrame:
    """(row, los, his): for every document of ``numbered`` with a repeated window of ``words`` words the runs
    of starts of such windows."""
    held = None
    for length in levels(words, first):
        docs = numbered.select("row", "words")
        if held is not None:
            docs = docs.join(held, "row")
        held = survivors(docs, length, words, f"repeated-{length}")
    return held


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _cut(words: int):
    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, los, his in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "words", "los", "his"))):
                parts = text.split(" ") if text else []
                n, kept, at = len(parts), [], 0
                for lo, hi in zip(los or [], his or []):
                    kept += parts[at:lo]
                    at = max(at, hi + words)
                if los:
                    kept += parts[at:]
                    text = " ".join(kept)
                else:
                    kept = parts
                out.append((doc_id, n, n - len(kept), text))
            ids, ns, gone, texts = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, words: int = WINDOW_WORDS, first: int = FIRST_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of ``docs``: its text without the words that a repeated
    window of ``words`` words covers.

    A window is repeated if its word sequence also starts anywhere else, in any row. Windows are found level by
    level: short windows (9 words) first; only windows of the full length all of whose looked-up parts repeat at
    one length are looked up at twice that length, until none survive or the full length is reached. Longer
    windows would remove nothing more. At each level a window is looked up by the least hash among its parts, so
    the first level moves one row for about fourteen words, and the last only what nearly certainly repeats.
    Sequences are compared by 64-bit hashes at every level.

    Words are maximal runs without white space, compared unchanged; kept words are joined by one space. Null and
    empty texts have no words; rows that repeat a document repeat each other and keep nothing of 35 words or
    more; a null doc_id is reported as null. Other columns of ``docs`` are not looked at.
    """
    numbered = numbered_words(docs)
    held = repeated_windows(numbered, words, first)
    rows = numbered.join(held, "row", "left").select("doc_id", "words", "los", "his")
    return rows.mapInArrow(_cut(words), KEPT)
