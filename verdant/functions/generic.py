"""Generic scalar functions as JVM-side Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(key: ColumnOrName, mapping: dict, strict: bool = True, default=None) -> Column:
    """Dictionary lookup as a CASE chain (codegen, no join).

    A null key gives null. An unknown non-null key raises like the reference's dict access
    when ``strict``; otherwise ``default`` is returned.
    """
    k = _c(key)
    expr = None
    for name, value in mapping.items():
        expr = (F.when(k == F.lit(name), F.lit(value)) if expr is None
                else expr.when(k == F.lit(name), F.lit(value)))
    if strict:
        fallback = F.when(k.isNull(), F.lit(None)).otherwise(
            F.raise_error(F.concat(F.lit("unknown lookup key: "), k.cast("string"))))
    else:
        fallback = F.lit(default)
    return expr.otherwise(fallback)


def floor_at(x: ColumnOrName, lo: float) -> Column:
    """G1: max(lo, x) with numpy semantics (null stays null; ``greatest`` would skip it)."""
    c = _c(x)
    return F.when(c < F.lit(lo), F.lit(float(lo))).otherwise(c)


def cap_at(x: ColumnOrName, hi: float) -> Column:
    c = _c(x)
    return F.when(c > F.lit(hi), F.lit(float(hi))).otherwise(c)


def clip(x: ColumnOrName, lo: float | None = None, hi: float | None = None) -> Column:
    """G1: numpy.clip; null stays null."""
    c = _c(x)
    out = F.when(c < F.lit(lo), F.lit(float(lo))) if lo is not None else None
    if hi is not None:
        out = F.when(c > F.lit(hi), F.lit(float(hi))) if out is None else out.when(c > F.lit(hi), F.lit(float(hi)))
    return c if out is None else out.otherwise(c)


def snake_name(x: ColumnOrName) -> Column:
    """Lower case, '-' and ' ' become '_'."""
    return F.translate(F.lower(_c(x)), "- ", "__")


def title_case(x: ColumnOrName) -> Column:
    """Capitalise every run of letters and lower the rest of it; other characters stay."""
    parts = F.regexp_extract_all(_c(x), F.lit(r"[^\p{L}]+|\p{L}+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(p.substr(F.lit(2), F.length(p))))), "")


def path_parts(url: ColumnOrName) -> dict[str, Column]:
    """Path pieces of a URL or file path: base name, stem, extension, parent, last id segment."""
    u = _c(url)
    path = F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), r"^[a-zA-Z]+://[^/]*", "")
    base = F.substring_index(path, "/", -1)
    has_ext = base.contains(".")
    return {
        "path": path,
        "base_name": base,
        "stem": F.when(has_ext, F.regexp_extract(base, r"^(.*)\.[^.]*$", 1)).otherwise(base),
        "extension": F.when(has_ext, F.lower(F.substring_index(base, ".", -1))).otherwise(F.lit("")),
        "parent": F.regexp_extract(path, r"^(.*)/[^/]*$", 1),
        "host": F.regexp_extract(u, r"^[a-zA-Z]+://([^/?#]*)", 1),
        "flat_name": F.regexp_replace(F.regexp_replace(path, r"^/", ""), "/", "_"),
    }


def json_field(text: ColumnOrName, field: str) -> Column:
    """One field out of a JSON text column (JVM-side, no Python)."""
    return F.get_json_object(_c(text), f"$.{field}")


def datetime_parts(ts: ColumnOrName) -> dict[str, Column]:
    """Day of year, hour, ISO text and the ``%Y%m%d_%H%M%S`` stamp."""
    t = _c(ts)
    return {
        "day_of_year": F.dayofyear(t),
        "hour_of_day": F.hour(t),
        "iso_text": F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"),
        "stamp": F.date_format(t, "yyyyMMdd_HHmmss"),
    }


def argmax_class(scores: ColumnOrName) -> Column:
    """0-based index of the largest score, first one on ties."""
    a = _c(scores)
    return (F.array_position(a, F.array_max(a)) - F.lit(1)).cast("int")


def normalise_array(values: ColumnOrName, means: list[float], stds: list[float]) -> Column:
    """(x - mean[c]) / std[c] per channel, channel = position mod len(means)."""
    k = len(means)
    m = F.array(*[F.lit(float(v)) for v in means])
    s = F.array(*[F.lit(float(v)) for v in stds])
    return F.transform(_c(values), lambda x, i: (x.cast("double") - F.element_at(m, (i % k) + 1))
                       / F.element_at(s, (i % k) + 1))


# Per-channel image normalisation constants of the reference's CNN input.
IMAGE_MEAN = [0.485, 0.456, 0.406]
IMAGE_STD = [0.229, 0.224, 0.225]


def indicator(x: ColumnOrName, value=None) -> Column:
    """1 when ``x == value`` (or, without value, when x is truthy non-zero), else 0."""
    c = _c(x)
    cond = (c == F.lit(value)) if value is not None else (c.isNotNull() & (c != F.lit(0)))
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def bytes_to_gib(x: ColumnOrName) -> Column:
    """Bytes / 1024^3."""
    return _c(x) / F.lit(float(1024 ** 3))


def percent(x: ColumnOrName) -> Column:
    return F.lit(100.0) * _c(x)


def per_thousand(x: ColumnOrName) -> Column:
    return _c(x) / F.lit(1000.0)


TWO_PI = 2 * math.pi
