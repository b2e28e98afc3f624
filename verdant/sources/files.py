"""File listings (S7, S14) and the size-capped sampler."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from verdant.operators.windows import in_ranges, range_totals, running_total
from verdant.session import partitions_for, pin

IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff")


def image_folder(spark: SparkSession, root: str, extensions=IMAGE_EXTENSIONS) -> DataFrame:
    """Labelled file tree ``<split>/<class>/<file>`` as (path, length, modificationTime, label, split, class_index).

    Only metadata columns are selected, so the binary content is never read. Class index =
    rank of the sorted class names (a small distinct set).
    """
    patterns = ",".join(sorted({e.lower() for e in extensions} | {e.upper() for e in extensions}))
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", f"*.{{{patterns}}}").load(root)
             .select("path", "length", "modificationTime"))
    parts = F.split(F.col("path"), "/")
    files = files.withColumn("label", F.element_at(parts, -2)).withColumn("split", F.element_at(parts, -3))
    classes = [r.label for r in files.select("label").distinct().orderBy("label").collect()]
    idx = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1 if classes else F.lit(None)
    return files.withColumn("class_index", idx.cast("int"))


def dir_size(listing: DataFrame, length: str = "length") -> DataFrame:
    """Total bytes, GiB and file count of a listing."""
    return listing.agg(F.sum(length).cast("bigint").alias("total_bytes"),
                       (F.sum(length) / F.lit(float(1024 ** 3))).alias("total_gib"),
                       F.count(F.lit(1)).alias("n_files"))


def with_shuffle_key(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.withColumn("_sk", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))))


FEW_FILES = 10_000  # so many are walked through on the driver


def sample_by_size(listing: DataFrame, key: str, cap: int, seed: int = 42, length: str = "length",
                   greedy: bool = True) -> DataFrame:
    """Files (key, length) in a seeded random order, taken while they fit ``cap``.

    ``greedy=False``: the longest prefix whose running size fits. ``greedy=True`` (the reference rule): every
    file is taken iff it still fits, files that do not fit are skipped and the scan goes on.

    Exact, by halving. While the room left lies between a power of two, the edge, and its double, every file
    below the edge fits, and of the larger ones none or one: the first that fits brings the room below the edge.
    So one running sum of the small files finds where the band ends, and the decisions of a band are two bounds
    and an edge. The bands are as many as the halvings of the cap, whatever the files; what is left when at most
    ``FEW_FILES`` files can still fit is walked through in order, by the same rule. The result is one filter of
    the listing. ``key`` is unique; a null length counts as 0.
    """
    order = ["_sk", key]
    files = with_shuffle_key(listing.select(key, F.coalesce(length, F.lit(0)).cast("bigint").alias(length)), key, seed)
    if not greedy:
        return running_total(files, length, order, name="_run").filter(F.col("_run") <= F.lit(cap)).select(key, length)
    n = partitions_for(files)
    taken = F.lit(False)
    for start, end, edge in _bands(pin(in_ranges(files, order, n)), order, length, int(cap), n):
        small = F.col(length) < edge
        within = F.lit(True) if start is None else _after(order, start)
        if end is not None:
            last = (F.col(order[0]) == end[0]) & (F.col(order[1]) == end[1])
            within, small = within & (~_after(order, end) | last), small | last
        taken = taken | (within & small)
    return files.filter(taken).select(key, length)


def _after(order: list[str], at: tuple) -> Column:
    (a, b), (x, y) = order, at
    return (F.col(a) > F.lit(x)) | ((F.col(a) == F.lit(x)) & (F.col(b) > F.lit(y)))


def _edge(room: int) -> int:
    """The greatest power of two that is not above ``room``; 1 for none."""
    return 1 << max(room.bit_length() - 1, 0)


def _bands(files: DataFrame, order: list[str], length: str, room: int, n: int):
    """(start, end, edge) of each band: between the positions ``start`` (not in it) and ``end`` the files below ``edge``
    are taken, and the one at ``end``. None: from the first, or to the last file."""
    start, fits = None, None
    while room > 0 and (fits is None or fits > FEW_FILES):
        edge = _edge(room)
        rest = files.filter(F.col(length) <= room)
        rest = rest if start is None else rest.filter(_after(order, start))
        small = F.col(length) < edge
        run = range_totals(rest.withColumn("_small", F.when(small, F.col(length)).otherwise(F.lit(0))), "_small", order, n, "_run")
        left = F.lit(room) - F.col("_run")
        ends = F.when(small, left < edge).otherwise(F.col(length) <= left)
        found = run.agg(F.count(F.lit(1)).alias("fits"), F.min(F.when(ends, F.struct(*order, length, "_run"))).alias("end")).first()
        if found["end"] is None:
            yield start, None, edge
            return
        *end, size, used = found["end"]
        yield start, tuple(end), edge
        start, fits = tuple(end), found["fits"]
        room -= used + (0 if size < edge else size)
    if room < 0:
        return
    if room > 0:
        rest = files.filter((F.col(length) <= room) & _after(order, start))
        for a, b, size in rest.orderBy(*order).select(*order, length).collect():
            edge = _edge(room)
            if size <= room:
                room -= size
                if room < edge:
                    yield start, (a, b), edge
                    start = (a, b)
            if not room:
                break
    yield start, None, _edge(room)
