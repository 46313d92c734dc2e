"""Scalar functions, all as Spark SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, VariantType

INCONCLUSIVE, NEGATIVE, POSITIVE = "inconclusive", "negative", "positive"
#: A change is negative from a fall of this share on.
NEGATIVE_FROM = -0.15


def stable_key(source: Column | str, key: Column | str) -> Column:
    """The identity of a finding: SHA-256 of source:key, in hexadecimal."""
    return F.sha2(F.concat_ws(":", source, key), 256)


def link_key(source_slug: Column | str, target_slug: Column | str) -> Column:
    """The identity of a link suggestion."""
    return F.sha2(F.concat_ws(":", F.lit("internalLinking"), source_slug, target_slug), 256)


def content_hash(text: Column | str) -> Column:
    return F.sha2(text, 256)


def unit(v: Column) -> Column:
    """v over its Euclidean length, in doubles; null if the length is 0. The length is
    put beside each number, as within transform it would be summed up for each."""
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: x / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one has length 0, so it matches nothing."""
    return dot(unit(a), unit(b))


def outcome(before: Column, after: Column) -> Column:
    """Without a baseline nothing can be said; a fall of 15 % or more is negative."""
    return F.when(before == 0, INCONCLUSIVE).when((after - before) / before <= NEGATIVE_FROM, NEGATIVE).otherwise(POSITIVE)


def priority(impact: Column, effort: Column) -> Column:
    return impact.cast("double") / effort


def decline(prior: Column, recent: Column) -> Column:
    return (prior - recent) / prior


def ratio_or_zero(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def collapsed(text: Column) -> Column:
    """Runs of any white space (Unicode, byte-order mark included) as one space; trimmed."""
    one = F.regexp_replace(text, r"(?U)[\s\x{FEFF}]+", " ")
    return F.regexp_replace(one, "^ | $", "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def string_array(column: Column, kind: DataType) -> Column:
    """A column of the given type as array<string>: arrays as they are, JSON texts and
    variants where they hold an array; anything else is an empty array."""
    none = F.array().cast("array<string>")
    if isinstance(kind, ArrayType):
        return F.coalesce(column.cast("array<string>"), none)
    if isinstance(kind, StringType):
        is_array = F.regexp_like(column, F.lit(r"^\s*\["))
        return F.coalesce(F.when(is_array, F.from_json(column, "array<string>")), none)
    if isinstance(kind, VariantType):
        return F.coalesce(F.try_variant_get(column, "$", "array<string>"), none)
    return none


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def fixed(x: Column, places: int) -> Column:
    """Text with a fixed number of decimals, half rounded up."""
    return F.format_string(f"%.{places}f", F.round(x, places))


def shown(x: Column) -> Column:
    """A number as text, whole ones without decimals."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def link_slug(href: Column) -> Column:
    """What follows /blog/ in an address, up to a query, fragment, quote or white
    space, without one closing slash; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(href, r'/blog/([^"?#\s]+)', 1), "/$", "")


def url_slug(url: Column, base: str) -> Column:
    """What follows base/blog/ in url; null elsewhere or if empty."""
    head = f"{base}/blog/"
    return F.when(url.startswith(head) & (F.length(url) > len(head)), F.substring(url, F.lit(len(head) + 1), F.length(url)))


def compact_date(text: Column) -> Column:
    """yyyymmdd as a date; null if it is none."""
    return F.try_to_date(text, "yyyyMMdd")


def excerpt(text: Column, n: int = 2000) -> Column:
    return F.substring(text, 1, n)
