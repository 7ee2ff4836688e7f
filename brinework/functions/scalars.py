"""Scalar expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vrr(inj: Column, prod: Column) -> Column:
    """Injected over produced reservoir volume; null where nothing is produced."""
    return inj / F.nullif(prod, F.lit(0.0))


def same(a: Column, b: Column) -> Column:
    """Whether two sums are equal but for the order of their terms: within 1e-9 of the larger one."""
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * 1e-9


def log_mean(a: Column, b: Column) -> Column:
    """(b - a) / ln(b / a); a where they are the same, 0 where either is not positive or null."""
    ok = (a > 0) & (b > 0)
    return F.when(ok & same(a, b), a).when(ok, (b - a) / F.ln(F.when(ok, b / a))).otherwise(F.lit(0.0))


def weighted(value: Column, weight: Column) -> Column:
    """Aggregate: sum of value * weight over the sum of all weights; a null value drops from the numerator only."""
    return F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays in double precision; null where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def comparable(x: Column, places: int = 4) -> Column:
    """A double rounded for comparison between engines: a small bias keeps sums in different orders off rounding ties."""
    return F.round(x + F.lit(3.17e-8), places) + F.lit(0.0)


def hex_id(*parts: Column) -> Column:
    """A 16-digit upper-case hexadecimal identifier of the parts."""
    return F.upper(F.substring(F.sha2(F.concat_ws("\x1f", F.lit("brinework"), *parts), 256), 1, 16))


def is_hex_id(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9A-F]{16}$"), F.lit(False))


def json_or_marker(value: Column, limit: int = 100_000) -> Column:
    """The value as JSON; where that is longer than limit, a marker with its length in its place."""
    text = F.to_json(value)
    return F.when(F.length(text) > limit, F.to_json(F.struct(F.lit(True).alias("truncated"), F.length(text).alias("chars")))).otherwise(text)
