"""Differences between two copies of a dataset.

Both copies are tagged and put in one table, which is grouped once by the key; the newest state of each side
survives as one struct, so the shuffle combines map-side and no group is ever collected.  The two structs are
then compared field by field with generated higher-order expressions.  Only states whose text differs reach
Python, to compare geometries as point sets and attributes as JSON values.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.geometry.exact import topologically_equal

NOT_AN_OBJECT = "attributes"


def canonical_number(text: str) -> str:
    """The one writing of a decimal number's value."""
    try:
        value = Decimal(text)
    except InvalidOperation:
        return "t" + text
    if not value.is_finite():
        return "t" + text
    sign, digits, e = value.as_tuple()
    body = "".join(map(str, digits)).lstrip("0")
    short = body.rstrip("0")
    if not short:
        return "0"
    return f"{'-' if sign else ''}{short}e{e + len(body) - len(short)}"


class WrittenNumber(str):
    """A JSON number as it was written."""

    __slots__ = ()


def canonical_value(value) -> str | None:
    """A JSON value as text that is equal exactly for equal values: the kind is the first letter."""
    if value is None:
        return None
    if value is True or value is False:
        return "b" + str(value).lower()
    if isinstance(value, WrittenNumber):
        return "n" + canonical_number(value)
    if isinstance(value, str):
        return "s" + value
    return "j" + json.dumps(_canonical_nested(value), sort_keys=True, ensure_ascii=True)


def _canonical_nested(value):
    if isinstance(value, dict):
        return {k: _canonical_nested(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_canonical_nested(v) for v in value]
    return canonical_value(value)


def surrogate_free(text: str) -> str:
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


_DECODER = json.JSONDecoder(parse_float=WrittenNumber, parse_int=WrittenNumber, parse_constant=WrittenNumber)


def read_object(text: str) -> dict | None:
    """The object's values with numbers kept as written; None for text that is no JSON object."""
    try:
        value = _DECODER.decode(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def canonical_object(text: str | None) -> dict[str, str]:
    """Non-null fields of a JSON object as canonical values; text that is no object counts as one field `attributes`."""
    if text is None:
        return {}
    value = read_object(text)
    if value is None:
        return {NOT_AN_OBJECT: "x" + text}
    return {surrogate_free(k): surrogate_free(c) for k, v in value.items() if (c := canonical_value(v)) is not None}


def json_fields(texts: pd.Series) -> pd.Series:
    """Null stays null (the caller passes null where nothing is to be compared)."""
    return pd.Series([None if t is None else canonical_object(t) for t in texts], dtype=object)


def same_geometry(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([topologically_equal(a, b) for a, b in zip(left, right)], dtype=bool)


def changed_fields(left: Column, right: Column) -> Column:
    """Sorted names of the keys at which two string maps differ; a missing key equals null. Two null maps do not differ."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(left, empty), F.coalesce(right, empty)
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.array_sort(F.filter(keys, lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k))))


def compare_copies(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: Sequence[str] = ("dataset_name", "feature_key"),
    order: str = "revision",
    geometry: str | None = "geometry_wkt",
    attributes: str | None = "attributes",
    fields: Sequence[str] = (),
) -> DataFrame:
    """Every difference of the current rows of two copies: keys, difference_kind, field_name.

    The current row of a key is the one with the highest ``order``; a null order is the lowest, and rows that tie
    with different content are settled by the greatest content, so repeated rows change nothing.  Rows with a null
    in a key column take no part.  ``removed`` and ``added`` have field_name ''; ``modified`` has one row for each
    differing field: ``geometry`` for another point set, the name of an attribute for another value in the JSON
    object (absent equals null; null attributes are an empty object), the name of any column in ``fields``.
    Two empty copies give no rows.  Other columns, whatever their names, are not read.
    """
    parts = {"g": geometry, "a": attributes, **{f"f{i}": c for i, c in enumerate(fields)}}

    def tagged(df: DataFrame, side: int) -> DataFrame:
        state = F.struct(*[df[c].cast("string").alias(k) if c else F.lit(None).cast("string").alias(k) for k, c in parts.items()])
        return df.where(F.lit(True) if not keys else ~_any_null(df, keys)).select(
            *[df[k].alias(f"k{i}") for i, k in enumerate(keys)],
            F.lit(side).alias("side"),
            F.struct(df[order].alias("o"), state.alias("s")).alias("v"),
        )

    both = tagged(left, 0).unionByName(tagged(right, 1))
    # One max over a struct for each side: combines map-side, whatever the number of superseded or repeated rows.
    newest = both.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(
        F.max(F.when(F.col("side") == 0, F.col("v"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("r")
    )
    here, there = F.col("l").isNotNull(), F.col("r").isNotNull()
    out = newest.select(
        *[F.col(f"k{i}").alias(f"k{i}") for i in range(len(keys))],
        F.when(~there, "removed").when(~here, "added").otherwise("modified").alias("difference_kind"),
        F.col("l.s").alias("l"),
        F.col("r.s").alias("r"),
    ).where(~F.col("l").eqNullSafe(F.col("r")))
    both_here = F.col("difference_kind") == "modified"
    found = []
    if geometry:
        unlike = both_here & ~F.col("l.g").eqNullSafe(F.col("r.g"))
        two = unlike & F.col("l.g").isNotNull() & F.col("r.g").isNotNull()
        out = out.withColumn("same", F.pandas_udf(same_geometry, "boolean")(F.when(two, F.col("l.g")), F.when(two, F.col("r.g"))))
        found.append(F.when(unlike & ~(two & F.col("same")), F.array(F.lit("geometry"))).otherwise(F.array().cast("array<string>")))
    if attributes:
        unlike = both_here & ~F.col("l.a").eqNullSafe(F.col("r.a"))
        out = out.withColumns({s + "m": F.pandas_udf(json_fields, "map<string,string>")(F.when(unlike, F.col(f"{s}.a"))) for s in "lr"})
        found.append(changed_fields(F.col("lm"), F.col("rm")))
    for i, name in enumerate(fields):
        found.append(F.when(both_here & ~F.col(f"l.f{i}").eqNullSafe(F.col(f"r.f{i}")), F.array(F.lit(name))).otherwise(F.array().cast("array<string>")))
    names = F.when(both_here, F.array_distinct(F.concat(*found)) if found else F.array().cast("array<string>")).otherwise(F.array(F.lit("")))
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "difference_kind", F.explode(names).alias("field_name"))


def _any_null(df: DataFrame, columns: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | df[c].isNull()
    return out


def difference_summary(differences: DataFrame) -> DataFrame:
    """Counts of differences by kind and field."""
    return differences.groupBy("difference_kind", "field_name").agg(F.count(F.lit(1)).alias("differences"))
