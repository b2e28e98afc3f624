"""Named queries: each is ``(spark, sf_dir) -> DataFrame`` with an optional DuckDB oracle.

The oracle SQL runs on the driver's pre-registered base-table views; reference-shaped views
are prepended as CTEs from the same expression lists the Spark side uses
(``verdant.sources.adapters``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
# Model-training and streaming-replay queries: run by the correctness check, left out of the
# default benchmark (their time is MLlib iteration / micro-batch overhead, not data volume).
HEAVY: set[str] = set()

# Aggregated doubles are reported to this many decimals in both engines: sums in another
# order differ in the last bits, which the value-hash compare would otherwise see.
DIGITS = 6
# Results of transcendental functions (sin, exp, log) differ by an ulp between the JVM and C.
TDIGITS = 9


def query(key: str, sql: str | None = None, heavy: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        if heavy:
            HEAVY.add(key)
        return fn
    return deco


def rounded(df: DataFrame, cols: list[str] | None = None, digits: int = DIGITS) -> DataFrame:
    """Round the given (default: all double) columns for reporting."""
    names = cols if cols is not None else [f.name for f in df.schema.fields
                                           if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.round(F.col(c), digits) for c in names}) if names else df


# --- SQL fragment helpers for the oracle -------------------------------------------------------

def dlit(v) -> str:
    """A DOUBLE literal in both dialects (plain ``0.1`` is DECIMAL in Spark and DuckDB)."""
    s = repr(float(v))
    return s if "e" in s else s + "e0"


def case_map(col: str, mapping: dict, default=None) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {dlit(v)}" for k, v in mapping.items())
    tail = f" ELSE {dlit(default)}" if default is not None else ""
    return f"(CASE {col} {whens}{tail} END)"


def floor0(x: str) -> str:
    return f"(CASE WHEN ({x}) < 0e0 THEN 0e0 ELSE ({x}) END)"


def clip_sql(x: str, lo=None, hi=None) -> str:
    parts = []
    if lo is not None:
        parts.append(f"WHEN ({x}) < {dlit(lo)} THEN {dlit(lo)}")
    if hi is not None:
        parts.append(f"WHEN ({x}) > {dlit(hi)} THEN {dlit(hi)}")
    return f"(CASE {' '.join(parts)} ELSE ({x}) END)"


def rnd(x: str, digits: int = DIGITS) -> str:
    return f"round({x}, {digits})"
