"""Benchmark decontamination: short test items found inside long documents by containment.

DataFrame functions only. A document's sketch is a one-permutation MinHash: hash space is cut into
bins and each bin keeps its least shingle hash. Documents are partitioned by size: the number of bins
follows the power of two above a document's shingle count, so a bin holds one to two shingles at any
length, and a contained item meets the sketch of a long document as well as that of a short one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from verdant.llm.common import (BLANKS, SHINGLE_WORDS, SIMILARITY_PERCENT, WORD_BREAK, ascii_lower, carried, fit_to_broadcast, staged,
                                whole_text)

# Finer bins for shorter items: (least number of shingles an item must share, further bits). A shared
# shingle is the least of its bin with chance (1 - exp(-x)) / x at x shingles a bin, x <= 2 ** (1 - bits),
# so that no item is missed with more than a chance of about a millionth; below five, bins hold one
# shingle each and nothing is missed.
FINER = ((24, 0), (5, 4), (0, 64))
BROADCAST_ROWS = 1_000_000  # candidate pairs, of two longs each


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: Spark may copy an expression that is used many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; one empty word without any."""
    return F.split(F.btrim(ascii_lower(text), F.lit(BLANKS)), WORD_BREAK)


def _windows(words: Column, of) -> Column:
    """``of(columns of the words)`` for every run of five words; of a shorter text, for all its words."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - SHINGLE_WORDS),
                       lambda i: of([F.get(words, i + k) for k in range(SHINGLE_WORDS)]))
    some = (n > 1) | (F.get(words, F.lit(0)) != "")
    return F.when(n >= SHINGLE_WORDS, runs).when(some, F.array(of([F.get(words, F.lit(k)) for k in range(SHINGLE_WORDS - 1)])))


def shingle_hashes(text: Column) -> Column:
    """The distinct 64-bit hashes of a text's word shingles in order; null without words."""
    return _once(words(text), lambda w: F.sort_array(F.array_distinct(_windows(w, lambda ws: F.xxhash64(*ws)))))


def shingles(text: Column) -> Column:
    """The distinct word shingles of a text, as texts; null without words."""
    return _once(words(text), lambda w: F.array_distinct(_windows(w, lambda ws: F.concat_ws(" ", *ws))))


def _bits_needed(hashes: Column) -> Column:
    """(h, bits) per hash: the least number of leading bits that set its bin apart from the hash before,
    that is, with which it is the least of its bin."""
    def one(h, i):
        differ = h.bitwiseXOR(F.get(hashes, i - 1))
        return F.struct(h.alias("h"), F.when(i == 0, 0).otherwise(65 - F.length(F.bin(differ))).alias("bits"))
    return F.transform(hashes, one)


def _least_of_bins(hashes: Column, bits: Column) -> Column:
    """The hashes that are the least of their bins, when the leading ``bits`` bits name the bin."""
    shift = F.greatest(64 - bits, F.lit(0)).cast("int")
    return F.filter(hashes, lambda h, i: (i == 0) | (
        F.call_function("shiftright", h, shift) != F.call_function("shiftright", F.get(hashes, i - 1), shift)))


def needed(n: Column, percent: int) -> Column:
    """The number of an item's n shingles that make ``percent`` of them."""
    return F.ceil(n * percent / F.lit(100)).cast("long")


def item_sketch(items: DataFrame, percent: int) -> DataFrame:
    """(item_id, h, bits, finer) per shingle of every item."""
    rows = items.select("item_id", shingle_hashes(whole_text()).alias("hs")).where("hs is not null")
    least = needed(F.size("hs"), percent)
    finer = F.lit(FINER[-1][1])
    for n, bits in reversed(FINER[:-1]):
        finer = F.when(least >= n, bits).otherwise(finer)
    return (rows.select("item_id", finer.alias("finer"), F.explode(_bits_needed(F.col("hs"))).alias("s"))
            .select("item_id", F.col("s.h").alias("h"), F.col("s.bits").alias("bits"), "finer"))


def candidates(docs: DataFrame, items: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """Distinct (doc_id, item_id) whose sketches share a bin's least hash, bins cut for the document's size."""
    item = staged(item_sketch(items, percent), "item-sketch")
    finest = item.agg(F.max("finer")).first()[0]
    if finest is None:
        finest = 0
    rows = docs.select("doc_id", shingle_hashes(whole_text()).alias("hs")).where("hs is not null")
    # a document of up to 2 ** c shingles has 2 ** (c - 1) bins
    own = F.length(F.bin(F.size("hs") - 1)) - 1
    rows = rows.select("doc_id", "hs", (own + finest).alias("bin_bits"))
    sketch = rows.select("doc_id", "bin_bits", F.explode(_least_of_bins(F.col("hs"), F.col("bin_bits"))).alias("doc_h"))
    meet = (F.col("doc_h") == F.col("h")) & (F.col("bits") <= F.col("bin_bits"))
    return sketch.join(item, meet).select("doc_id", "item_id").distinct()


def contained_items(docs: DataFrame, items: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared) for every item of which a document has at least ``percent``
    per cent of the distinct five-word shingles, anywhere in its whole text.

    Candidates come from the sketches; each is verified on the shingles themselves. An item that very
    many documents contain is no hot group: the item side has one row for each shingle, and the
    documents are the side that is split. Documents and items without words, or with a null id, match
    nothing; those of fewer than five words have their whole sequence as one shingle. Repeated rows
    are one document or item; other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    pairs = staged(candidates(docs, items, percent), "leak-candidates")
    pairs = fit_to_broadcast(pairs, BROADCAST_ROWS).withColumnRenamed("doc_id", "c_doc")
    wanted = docs.join(pairs, F.col("doc_id") == F.col("c_doc")).select("doc_id", "item_id", "text")
    test = items.select(F.col("item_id").alias("i_id"), shingles(whole_text()).alias("item"))
    both = wanted.select("doc_id", "item_id", shingles(whole_text()).alias("doc")).join(test, F.col("item_id") == F.col("i_id"))
    shared = F.size(F.array_intersect("item", "doc"))
    found = both.select("doc_id", "item_id", F.size("item").cast("long").alias("n_shingles"), shared.cast("long").alias("n_shared"))
    return found.where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """``docs`` without the rows whose document contains an item; all columns stay, whatever their names."""
    leaks = staged(contained_items(docs, items, percent).select(F.col("doc_id").alias("leak")).distinct(), "leaks")
    rows = carried(docs, id=F.col("doc_id").cast("long"))
    return rows.join(fit_to_broadcast(leaks, BROADCAST_ROWS), F.col("id") == F.col("leak"), "left_anti").select("doc.*")
