"""Row positions and window operators.

Global order without a global window: ``in_ranges`` deals the rows to ranges of the (group, order)
key, so one hot group is spread over many tasks. The ranges' bounds are keys of a hashed sample of the
input, a scalar subquery, and a row's range is a plain expression of its key and the bounds. So the same
rows always fall in the same range, wherever and however often they are computed: the counts that give a
range its offset come from the key columns alone, and the rows themselves move once. Nothing is
written, nothing reaches the driver, and no job runs before an action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from verdant.session import partitions_for, pin

SAMPLED_KEYS = 1_000_000  # at most so many keys are looked at for the bounds
KEYS_PER_RANGE = 20       # and at most so many for each range


def _cols(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def _as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _range_bounds(keys: DataFrame, n: int) -> DataFrame:
    """One row with one array: the n - 1 inner bounds of n ranges of about equal size of the column ``_range_key``.

    A key is sampled by its hash, so the bounds depend on the keys only, not on how they are dealt.
    """
    rows = keys.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("rows")).scalar()
    sample = keys.where(F.pmod(F.xxhash64("_range_key"), rows) < min(KEYS_PER_RANGE * n, SAMPLED_KEYS))
    sample = sample.agg(F.sort_array(F.collect_list("_range_key")).alias("keys"))
    at = lambda i: F.get("keys", F.floor(i * F.size("keys") / F.lit(n)).cast("int"))
    return sample.select(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), at).alias("bounds"))


def in_ranges(df: DataFrame, by: list, n: int) -> DataFrame:
    """Add ``_range``, 0 to n - 1: the range of a row's ``by`` (ascending, nulls first) among n of about equal size.

    ``_range`` is the number of bounds that are not above the row's key, found by halving.
    """
    key = F.struct(*[_as_column(c).alias(f"_{i}") for i, c in enumerate(by)])
    out = df.withColumn("_range", F.lit(0))
    if n < 2:
        return out
    bounds = _range_bounds(df.select(key.alias("_range_key")), n)
    out = out.withColumn("_range_key", key)
    for j in reversed(range((n - 1).bit_length())):
        bound = F.get(bounds.scalar(), F.col("_range") + (2 ** j - 1))
        out = out.withColumn("_range", F.when(bound <= F.col("_range_key"), F.col("_range") + 2 ** j).otherwise(F.col("_range")))
    return out.drop("_range_key")


def _before(sizes: DataFrame, n: int, group: list[str], after: bool = False) -> DataFrame:
    """One row with one array of n structs (group, before) from ``sizes`` (_range, group columns, _n).

    Ranges follow the group, so a range continues at most one group of the ranges before it; the struct
    names that group and the sum of its ``_n`` in those ranges. All other groups of the range begin in it.
    ``after``: the same of the ranges that follow.
    """
    frame = (1, Window.unboundedFollowing) if after else (Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(*frame)
    at = sizes.select("_range", F.struct(F.lit(0).alias("_"), *group).alias("group"), F.sum("_n").over(earlier).alias("before"))
    at = at.where("before is not null")
    ranges = sizes.sparkSession.range(n).join(at, F.col("id") == F.col("_range"), "left")
    return ranges.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "group", "before"))),
                                  lambda r: F.struct(r["group"].alias("group"), r["before"].alias("before"))).alias("ranges"))


def _offset(sizes: DataFrame, n: int, group: list[str], after: bool = False) -> Column:
    """The sum of ``_n`` of a row's group in the ranges before (after) the row's own; null if there are none."""
    mine = F.get(_before(sizes, n, group, after).scalar(), F.col("_range"))
    return F.when(mine["group"].eqNullSafe(F.struct(F.lit(0).alias("_"), *group)), mine["before"])


def dense_index(df: DataFrame, order, group=None, name: str = "row_idx",
                num_partitions: int | None = None, with_group_size: bool = False) -> DataFrame:
    """0-based position of each row in ``order`` (within the columns ``group`` if given).

    ``order`` is ascending, nulls first, and must be a total order (end it with a unique key), or rows that tie
    get any order, and another one when they are computed again. Null is a group like others. Lazy; the input
    is read for its rows, and for the key columns alone by the bounds and the offsets of the ranges.
    """
    order_cols, group_cols = _cols(order), _cols(group)
    n = num_partitions or partitions_for(df)
    tagged = in_ranges(df, group_cols + order_cols, n)
    sizes = tagged.groupBy("_range", *group_cols).agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy("_range", *group_cols).orderBy(*order_cols)
    out = tagged.repartitionById(n, F.col("_range")).withColumn(name, (F.row_number().over(within) - 1).cast("bigint"))
    out = out.withColumn(name, F.col(name) + F.coalesce(_offset(sizes, n, group_cols), F.lit(0)))
    if with_group_size:
        here = F.count(F.lit(1)).over(Window.partitionBy("_range", *group_cols))
        others = [F.coalesce(_offset(sizes, n, group_cols, after), F.lit(0)) for after in (False, True)]
        out = out.withColumn(f"{name}_group_size", here + others[0] + others[1])
    return out.drop("_range")


def every_nth(df: DataFrame, n: int, order, group=None) -> DataFrame:
    """Keep every n-th row (1-based positions n, 2n, ...) in the declared order."""
    idx = dense_index(df, order, group, name="_w8")
    return idx.filter((F.col("_w8") + 1) % n == 0).drop("_w8")


def running_total(df: DataFrame, value: str, order, name: str = "running_total",
                  num_partitions: int | None = None) -> DataFrame:
    """Running sum of ``value`` over a global order (as in ``dense_index``): per range, and the ranges before."""
    n = num_partitions or partitions_for(df)
    return range_totals(in_ranges(df, _cols(order), n), value, order, n, name).drop("_range")


def range_totals(tagged: DataFrame, value: str, order, n: int, name: str) -> DataFrame:
    """``running_total`` of a table that ``in_ranges`` has tagged by the same ``order``."""
    sums = tagged.groupBy("_range").agg(F.sum(value).alias("_n"))
    within = Window.partitionBy("_range").orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = tagged.repartitionById(n, F.col("_range")).withColumn(name, F.sum(value).over(within))
    before = _offset(sums, n, [])
    return out.withColumn(name, F.when(before.isNull(), F.col(name)).otherwise(before + F.coalesce(F.col(name), F.lit(0))))


def sliding_windows(df: DataFrame, features: list[str], order, group, length: int = 30,
                    include_current: bool = False, chunk_rows: int = 1_000_000,
                    name: str = "window") -> DataFrame:
    """Array of the ``length`` previous rows' feature structs per row, per group.

    W1 (``include_current=False``): rows i-L..i-1 for the target at row i, n-L windows per group.
    W2 (``include_current=True``): rows i-L+1..i, n-L+1 windows per group.
    Only full windows are kept. Hot groups are cut into chunks of ``chunk_rows`` positions;
    the last rows of each chunk are copied into the next one as a halo so every window
    stays exact while no task holds more than ``chunk_rows + length`` rows of a group.
    The output keeps ``_pos``, the row's 0-based position within its group.
    """
    chunk_rows = max(chunk_rows, length + 1)  # a halo must come from the previous chunk only
    group_cols = _cols(group)
    pos = dense_index(df, order, group_cols, name="_pos")
    halo = length if not include_current else length - 1
    chunk = F.floor(F.col("_pos") / F.lit(chunk_rows)).cast("bigint")
    last = (F.col("_pos") % chunk_rows) >= chunk_rows - halo
    rows = pos.withColumn("_chunk", F.explode(F.when(last, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
    rows = rows.withColumn("_halo", F.col("_chunk") > chunk)
    lo, hi = (-(length - 1), 0) if include_current else (-length, -1)
    w = Window.partitionBy(*group_cols, "_chunk").orderBy("_pos").rowsBetween(lo, hi)
    feats = F.struct(*[F.col(c) for c in features])
    out = (rows.withColumn(name, F.collect_list(feats).over(w))
               .filter(~F.col("_halo") & (F.size(name) == length)))
    return out.drop("_chunk", "_halo")


def window_runs(df: DataFrame, features: list[str], order, group, length: int = 30, run_rows: int | None = None) -> DataFrame:
    """The full windows of W2 before they are cut: one row per run of at most ``run_rows`` rows of a group in order, led
    by the ``length - 1`` rows before them. ``run`` has the rows' ``features``, ``rows`` all their columns.

    A table of windows holds each row ``length`` times, a table of runs little more than once. Short runs keep a hot
    group spread and the cut of a window, which looks through its run, cheap.
    """
    run_rows = max(run_rows or 4 * length, length)  # the rows before a run come from the previous run only
    group_cols = _cols(group)
    pos = dense_index(df, order, group_cols, name="_pos")
    chunk = F.floor(F.col("_pos") / F.lit(run_rows)).cast("bigint")
    last = (F.col("_pos") % run_rows) >= run_rows - (length - 1)
    rows = pos.withColumn("_chunk", F.explode(F.when(last, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
    row = F.struct("_pos", F.struct(*features).alias("run"), F.struct(*df.columns).alias("rows"))
    runs = rows.groupBy(*group_cols, "_chunk").agg(F.sort_array(F.collect_list(row)).alias("_run"))
    return runs.where(F.size("_run") >= length).select("_run.run", "_run.rows")


def stored_windows(df: DataFrame, features: list[str], order, group, length: int = 30, include_current: bool = False,
                   path: str | None = None, name: str = "window") -> DataFrame:
    """``sliding_windows`` of rows that are written once, to ``path`` if given: as runs, each row little more than once,
    from which the windows are cut whenever they are read. Nothing that is as wide as a window is moved or stored.

    Next to ``_pos`` stand ``_first`` and ``_last``, the positions of the group's first and last window.
    """
    group_cols, lead = _cols(group), length - 1 if include_current else length
    run_rows = 4 * length
    pos = dense_index(df, order, group_cols, name="_pos", with_group_size=True)
    chunk = F.floor(F.col("_pos") / F.lit(run_rows)).cast("bigint")
    last = (F.col("_pos") % run_rows) >= run_rows - lead
    rows = pos.withColumn("_chunk", F.explode(F.when(last, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
    runs = rows.groupBy(*group_cols, "_chunk").agg(F.sort_array(F.collect_list(F.struct("_pos", F.struct(*df.columns).alias("row")))).alias("_run"),
                                                   F.max("_pos_group_size").alias("_size"))
    runs = runs.where(F.size("_run") > lead).select("_run", "_size")
    if path is None:
        kept = pin(runs)
    else:
        runs.write.mode("overwrite").parquet(path)
        kept = df.sparkSession.read.schema(runs.schema).parquet(path)
    readings = F.transform("_run", lambda r: F.struct(*[r["row"][c].alias(c) for c in features]))

    def ending(i):
        return F.struct(F.get("_run", i).alias("at"), F.slice("_readings", i - (lead - 1), F.lit(length)).alias(name))

    cut = F.explode_outer(F.transform(F.sequence(F.lit(lead), F.size("_run") - 1), ending))
    # the readings of a run are made once: a generator's output is not written out in each expression that names it
    cuts = kept.select("_run", "_size", F.explode_outer(F.array(readings)).alias("_readings")).select("_size", cut.alias("_w"))
    return cuts.select("_w.at.row.*", F.col("_w.at._pos").alias("_pos"), F.lit(lead).cast("bigint").alias("_first"),
                       (F.col("_size") - 1).alias("_last"), f"_w.{name}")


def cut_windows(runs: DataFrame, length: int = 30, name: str = "window") -> DataFrame:
    """The rows of ``window_runs`` that end a full window, each with its window."""
    def ending(i):
        return F.struct(F.get("rows", i).alias("row"), F.slice("run", i - (length - 2), F.lit(length)).alias(name))

    # outer: no filter that would cut the windows once more
    cut = F.explode_outer(F.transform(F.sequence(F.lit(length - 1), F.size("run") - 1), ending))
    return runs.select(cut.alias("_w")).select("_w.row.*", f"_w.{name}")


def top_per_group(df: DataFrame, group, order, k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group by ``order`` (a total order), with 1-based rank.

    ``row_number() <= k`` lets the planner insert a partial WindowGroupLimit before the
    shuffle, so a hot group sends at most k rows per map task to the final ranking.
    """
    w = Window.partitionBy(*_cols(group)).orderBy(*_cols(order))
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def best_so_far(df: DataFrame, metric: str, order: str, group=None, higher_is_better: bool = True,
                name: str = "is_best") -> DataFrame:
    """Flag rows strictly better than every earlier row (the checkpoint rule)."""
    group_cols = _cols(group)
    w = Window.partitionBy(*group_cols).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if higher_is_better:
        prev = F.max(metric).over(w)
        flag = F.col(metric) > F.coalesce(prev, F.lit(0.0))
    else:
        prev = F.min(metric).over(w)
        flag = prev.isNull() | (F.col(metric) < prev)
    return df.withColumn(name, flag)


def plateau(df: DataFrame, loss: str, order: str, group=None, patience: int = 10,
            lr_patience: int = 5, min_delta: float = 1e-4, initial_lr: float = 1e-3,
            factor: float = 0.2, min_lr: float = 1e-4) -> DataFrame:
    """Early stopping and learning-rate cuts along each run of epochs.

    Two rules run side by side. Stopping: any drop below the best loss is a gain; after ``patience``
    epochs without one the run stops, and stays stopped (``epochs_since_gain``, ``stop``). Rate: only a drop
    of more than ``min_delta`` below its own best counts; after ``lr_patience`` epochs without one the rate is
    multiplied by ``factor`` (never below ``min_lr``) and the wait starts again; the rate never rises
    (``lr_cuts``, ``learning_rate``). The state depends on the epochs before, so each run, a list as long as
    its epochs, is folded in order.
    """
    group_cols = _cols(group)
    names = [c for c in df.columns if c not in group_cols]
    runs = df.groupBy(*group_cols).agg(F.sort_array(F.collect_list(F.struct(
        F.col(order).alias("_o"), F.col(loss).cast("double").alias("_l"), F.struct(*names).alias("_row")))).alias("_run"))
    state = F.struct(
        F.lit(float("inf")).alias("best"), F.lit(0).alias("wait"), F.lit(False).alias("stop"),
        F.lit(float("inf")).alias("lr_best"), F.lit(0).alias("lr_wait"), F.lit(0).alias("cuts"),
        F.lit(float(initial_lr)).alias("lr"))
    done = "array<struct<best double, wait int, stop boolean, lr_best double, lr_wait int, cuts int, lr double>>"

    def step(seen, epoch):
        s = F.element_at(F.concat(F.array(state), seen), -1)
        x = epoch["_l"]
        gain, lr_gain = x < s["best"], x < s["lr_best"] - F.lit(min_delta)
        wait = F.when(gain, 0).otherwise(s["wait"] + 1)
        waited = F.when(lr_gain, 0).otherwise(s["lr_wait"] + 1)
        cut = (waited >= lr_patience) & (s["lr"] > F.lit(min_lr))
        return F.concat(seen, F.array(F.struct(
            F.least(x, s["best"]).alias("best"), wait.alias("wait"), (s["stop"] | (wait >= patience)).alias("stop"),
            F.when(lr_gain, x).otherwise(s["lr_best"]).alias("lr_best"), F.when(cut, 0).otherwise(waited).alias("lr_wait"),
            (s["cuts"] + cut.cast("int")).alias("cuts"),
            F.when(cut, F.greatest(s["lr"] * F.lit(factor), F.lit(float(min_lr)))).otherwise(s["lr"]).alias("lr"))))

    folded = runs.withColumn("_s", F.aggregate("_run", F.array().cast(done), step))
    rows = folded.select(*group_cols, F.explode(F.arrays_zip("_run", "_s")).alias("_e"))
    s = F.col("_e._s")
    return rows.select(*group_cols, "_e._run._row.*", s["wait"].alias("epochs_since_gain"), s["stop"].alias("stop"),
                       s["cuts"].alias("lr_cuts"), s["lr"].alias("learning_rate"))
