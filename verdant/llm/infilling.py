"""Fill-in-middle transformation of texts: a prefix, a middle and a suffix, marked and put in another order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from verdant.llm.common import whole_text

# The marks, and in a hundred draws how many are transformed and, of those, suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED = 90
SUFFIX_FIRST = 20
SEED = 1

SLICE_BYTES = 1 << 22  # text of one step of the pipeline; a longer text is a step of its own

# A unit is a run of letters or any other code point, written as the bytes of UTF-8, in which 0xFF never occurs.
UNIT = r"([A-Za-z]+|[\x00-\x7F]|[\xC2-\xF4][\x80-\xBF]+)"
MARK = b"\xff"

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed and doc_id (a null id as the empty text)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _mod(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _joined(units: pa.Array, parents: pa.Array, mask: pa.Array, sizes: pa.Array) -> pa.Array:
    """The units that ``mask`` keeps, joined row by row; ``sizes``: how many each row keeps."""
    ends = pc.cumulative_sum(sizes)
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), ends.cast(pa.int64())])
    lists = pa.LargeListArray.from_arrays(offsets, pc.filter(units, mask))
    return pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))


def _transform(ids: pa.Array, text: pa.Array, h: list[pa.Array], percent: int, spm_percent: int) -> pa.RecordBatch:
    """One step: split units into lists, number them by their row's start, filter by role, rebuild and join."""
    raw = text.cast(pa.large_binary())
    lists = pc.split_pattern(pc.replace_substring_regex(raw, pattern=UNIT, replacement=b"\\1" + MARK), pattern=MARK)
    # every unit ends with a mark, so each list has one empty element more than units
    n = pc.subtract(pc.list_value_length(lists).cast(pa.int64()), 1)
    units = pc.list_flatten(lists)
    parents = pc.list_parent_indices(lists).cast(pa.int64())
    starts = pc.subtract(pc.cumulative_sum(pc.add(n, 1)), pc.add(n, 1))
    ordinals = pc.subtract(pa.array(np.arange(len(units))), pc.take(starts, parents))

    places = pc.add(n, 1)
    first, second = _mod(h[0], places), _mod(h[1], places)
    low, high = pc.min_element_wise(first, second), pc.max_element_wise(first, second)
    low_of, high_of, n_of = (pc.take(x, parents) for x in (low, high, n))
    in_prefix = pc.less(ordinals, low_of)
    in_suffix = pc.and_(pc.greater_equal(ordinals, high_of), pc.less(ordinals, n_of))
    in_middle = pc.and_(pc.greater_equal(ordinals, low_of), pc.less(ordinals, high_of))
    prefix = _joined(units, parents, in_prefix, low)
    middle = _joined(units, parents, in_middle, pc.subtract(high, low))
    suffix = _joined(units, parents, in_suffix, pc.subtract(n, high))

    hundred = pa.scalar(100, pa.int64())
    marked = pc.match_substring(raw, PREFIX)
    for mark in (SUFFIX, MIDDLE):
        marked = pc.or_(marked, pc.match_substring(raw, mark))
    plain = pc.or_(pc.or_(pc.equal(n, 0), marked), pc.greater_equal(_mod(h[2], hundred), percent))
    spm = pc.less(_mod(h[3], hundred), spm_percent)

    def mark(name):
        return pa.scalar(name.encode(), pa.large_binary())

    none = pa.scalar(b"", pa.large_binary())
    psm = pc.binary_join_element_wise(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle, none)
    turned = pc.binary_join_element_wise(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle, none)
    output = pc.if_else(plain, raw, pc.if_else(spm, turned, psm))
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    nothing = pa.scalar(None, pa.int64())

    def points(piece):
        return pc.if_else(plain, nothing, pc.utf8_length(piece.cast(pa.large_string())).cast(pa.int64()))

    return pa.RecordBatch.from_arrays(
        [ids, n, form.cast(pa.string()), points(prefix), points(middle), output.cast(pa.large_string())],
        ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _slices(sizes: list[int]):
    """(start, length) of the rows of a batch in steps of about SLICE_BYTES."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > SLICE_BYTES:
            yield start, i - start
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield start, len(sizes) - start


def fill_in_middle(docs: DataFrame, seed: int = SEED, percent: int = TRANSFORMED,
                   spm_percent: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``.

    A text of n units is cut at two places drawn from doc_id, 0 to n units from its start; its output is
    ``<P>`` prefix ``<S>`` suffix ``<M>`` middle (form psm), ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
    (spm), or the text itself (plain): empty texts, texts that hold a mark, and the share of draws that
    ``percent`` leaves. ``restored`` gives the text back.

    One pass without a shuffle: each batch goes through the compute functions of Arrow, some megabytes of
    text at a time. Null text is the empty text, a null doc_id draws as an empty id, repeated rows are
    transformed alike; other columns of ``docs`` are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"),
                       *_draws(F.col("doc_id").cast("long"), seed))

    def run(batches):
        for batch in batches:
            text = batch.column("text").cast(pa.large_string())
            sizes = pc.binary_length(text).to_pylist()
            for at, length in _slices(sizes):
                part = batch.slice(at, length)
                yield _transform(part.column("doc_id"), text.slice(at, length),
                                 [part.column(f"h{i}") for i in range(1, 5)], percent, spm_percent)

    return rows.mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made of. Outputs other than plain hold each mark once."""
    pieces = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    piece = [F.get(pieces, F.lit(i)) for i in range(1, 4)]
    return (F.when(form == "psm", F.concat(piece[0], piece[2], piece[1]))
            .when(form == "spm", F.concat(piece[1], piece[2], piece[0])).otherwise(output))
