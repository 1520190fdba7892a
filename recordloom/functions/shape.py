"""Guards for values of unknown shape (VARIANT), and reusable checks."""

from __future__ import annotations

import json
import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What stands for NaN and the infinities in a value read a second time: VARIANT can't read them, and no null must come of a number.
NAN, INFINITE = 5e-324, 1.7976931348623157e308
#: Deeper arrays and objects are empty in a value read a second time.
DEEPEST = 100


def _plain(x, depth: int = 0):
    if isinstance(x, dict):
        return {k: _plain(v, depth + 1) for k, v in x.items()} if depth < DEEPEST else {}
    if isinstance(x, list):
        return [_plain(v, depth + 1) for v in x] if depth < DEEPEST else []
    if isinstance(x, int) and not -(1 << 63) <= x < 1 << 63:
        x = float(x) if abs(x) < 10**300 else INFINITE if x > 0 else -INFINITE
    if isinstance(x, float) and not math.isfinite(x):
        return NAN if math.isnan(x) else math.copysign(INFINITE, x)
    return x


@F.pandas_udf(StringType())
def _reread(texts: pd.Series) -> pd.Series:
    """JSON as Python's reader takes it (repeated keys: the last one; NaN; any depth), rewritten so that every session's VARIANT takes it."""
    def one(t):
        try:
            return None if t is None else json.dumps(_plain(json.loads(t)))
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


def with_json(df: DataFrame, text: str, into: str, ok: str) -> DataFrame:
    """Adds a text's JSON as VARIANT and whether it is JSON at all, whatever the session's settings.

    The VARIANT parser stops behind the first value, so the text is parsed between two kinds of brackets: only if exactly one
    value stands there do both close. What it refuses (repeated keys, unless the session allows them; NaN and the infinities; over 1,000
    levels; numbers of over 1,000 digits) is read a second time in Python, which gets nulls for all other rows. Of those, repeated
    keys lose nothing; NaN and the infinities are the numbers NAN and INFINITE, integers beyond 64 bits are doubles, and levels below
    DEEPEST are empty. Texts that are nested deeper than Python's own limit (some thousands) are no JSON.
    """
    t = F.col(text)
    d = df.withColumn("_list", F.try_parse_json(F.concat(F.lit('{"v":['), t, F.lit("]}")))).withColumn("_object", F.try_parse_json(F.concat(F.lit('[{"v":'), t, F.lit("}]"))))
    plain = F.col("_list").isNotNull() & F.col("_object").isNotNull()
    d = d.withColumn("_again", _reread(F.when(~plain, t)))
    again = F.coalesce(F.try_parse_json("_again"), F.parse_json(F.when(F.col("_again").isNotNull(), F.raise_error(F.concat(F.lit("JSON that VARIANT can't hold: "), F.substring(t, 1, 200))).cast("string"))))
    d = d.withColumn(into, F.when(plain, F.try_variant_get("_list", '$["v"][0]', "variant")).otherwise(again)).withColumn(ok, plain | F.col("_again").isNotNull())
    return d.drop("_list", "_object", "_again")


def at(v: Column, *keys: str) -> Column:
    """A nested value; null if it is absent."""
    return F.try_variant_get(v, "$" + "".join(f'["{k}"]' for k in keys), "variant")


def is_kind(v: Column, *kinds: str) -> Column:
    """Whether a value is a STRING, BIGINT, OBJECT, ARRAY, BOOLEAN, VOID and so on; an absent value is none. No kind may begin another's name."""
    return F.coalesce(reduce(Column.__or__, (F.startswith(F.schema_of_variant(v), F.lit(k)) for k in kinds)), F.lit(False))


def text_at(v: Column, *keys: str) -> Column:
    """A nested value that is a JSON string; numbers and the like are null rather than text."""
    x = at(v, *keys)
    return F.when(is_kind(x, "STRING"), x.cast("string"))


def first_text(v: Column, *keys: str) -> Column:
    return F.coalesce(*(text_at(v, k) for k in keys))


def items(v: Column) -> Column:
    """Members of a JSON array; null for another value."""
    return F.when(is_kind(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def keys_are(json: Column, names: tuple[str, ...]) -> Column:
    """Whether a JSON object has exactly these keys."""
    found = F.json_object_keys(json)
    return F.coalesce(F.array_sort(F.array_distinct(found)) == F.array(*map(F.lit, sorted(names))), F.lit(False))


def non_blank(c: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]", "")) > 0, F.lit(False))


def non_empty(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def all_strings(c: Column) -> Column:
    """An array without nulls."""
    return F.coalesce(F.forall(c, lambda x: x.isNotNull()), F.lit(False))


def some_strings(c: Column) -> Column:
    """A non-empty array of non-empty strings."""
    return F.coalesce((F.size(c) > 0) & F.forall(c, non_empty), F.lit(False))


def unique(c: Column) -> Column:
    return F.size(F.array_distinct(c)) == F.size(c)


def add_counts(a: Column, b: Column) -> Column:
    """Two maps of counts, added by key."""
    zero = lambda x: F.coalesce(x, F.lit(0))
    return F.map_zip_with(a, b, lambda _, x, y: zero(x) + zero(y))


def first_code(*rules: tuple[str, Column]) -> Column:
    """The message of the first broken rule, in order; null if none is."""
    return F.coalesce(*(F.when(~F.coalesce(good, F.lit(False)), F.lit(message)) for message, good in rules))
