"""Scalar functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(x: Column) -> Column:
    """NaN is a missing value: it must not win a maximum or spread through a sum."""
    return F.when(~F.isnan(x), x)


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or missing."""
    return F.try_divide(a, b)


def round_half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def key_part(key: Column, n: int) -> Column:
    """The n-th of the parts of a key that '|' separates, in lower case, without outer blanks; empty is null."""
    return F.nullif(F.lower(F.trim(F.split_part(key, F.lit("|"), F.lit(n)))), F.lit(""))


def short_hash(x: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(x.cast("string"), 256), 1, digits)


def first_of(metadata: Column, *names: str) -> Column:
    """The first of several keys that a map has."""
    return F.coalesce(*[metadata[n] for n in names])


def reply_json(text: Column) -> Column:
    """The JSON object in a reply: thoughts and code fences go, then all from the first brace to the last; null without one."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def json_number(text: Column, name: str) -> Column:
    """A number of a JSON object; null if the object or the number is missing or malformed."""
    return F.get_json_object(text, f"$.{name}").try_cast("double")
