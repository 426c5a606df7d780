"""Scan of typed tables against an attribute schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.operators.profile import ColumnRule

ISSUE = "issue_type string, column_name string, row_positions array<bigint>, detail string"
# Which column types hold which logical type; float accepts integers, integer and float no booleans.
HOLDS = {
    "string": (T.StringType,),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType),
    "boolean": (T.BooleanType,),
    "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType),
}
VARIANT_KINDS = {"string": r"STRING", "integer": r"BIGINT|DECIMAL\([0-9]+,0\)", "float": r"BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9]+,[0-9]+\)", "boolean": r"BOOLEAN", "datetime": r"TIMESTAMP|TIMESTAMP_NTZ|DATE"}


def schema_drift(columns: Sequence[str], rules: Sequence[ColumnRule]) -> list[tuple[str, str | None, str]]:
    """(issue_type, column, detail): a row for each missing column and one for the drift as a whole."""
    wanted, actual = {r.column_name for r in rules}, set(columns)
    missing, added = sorted(wanted - actual), sorted(actual - wanted)
    out = [("missing_column", c, "column is missing") for c in missing]
    if missing or added:
        out.append(("schema_drift", None, f"missing={missing}, added={added}"))
    return out


def scan_attributes(frame: DataFrame, rules: Sequence[ColumnRule], position: str = "row_position") -> DataFrame:
    """issue_type, column_name, row_position, detail; the position is null for issues of the whole table.

    Column issues: missing_column, schema_drift. Row issues: null_value in columns that are not nullable,
    invalid_data_type (per value for VARIANT columns, for all non-null values of a typed column of another type),
    duplicate_id for every row of an id that repeats. Nothing stops at the first fault. ``position`` is the row's
    zero-based place and no attribute; an empty frame has column issues only.
    """
    columns = [c for c in frame.columns if c != position]
    spark = frame.sparkSession
    out = spark.createDataFrame([(i, c, None, d) for i, c, d in schema_drift(columns, rules)], "issue_type string, column_name string, row_position bigint, detail string")
    cells = []
    for rule in rules:
        if rule.column_name not in columns:
            continue
        value, kind = frame[rule.column_name], frame.schema[rule.column_name].dataType

        def fault(condition, issue, rule=rule):
            cells.append(F.when(condition, F.struct(F.lit(issue).alias("issue_type"), F.lit(rule.column_name).alias("column_name"))))

        null = value.isNull() if not isinstance(kind, T.VariantType) else value.isNull() | F.is_variant_null(value)
        if not rule.nullable:
            fault(null, "null_value")
        if isinstance(kind, T.VariantType):
            fault(~null & ~F.schema_of_variant(value).rlike(rf"\A({VARIANT_KINDS[rule.data_type]})\z"), "invalid_data_type")
        elif not isinstance(kind, HOLDS[rule.data_type]):
            fault(value.isNotNull(), "invalid_data_type")
    if cells:
        found = frame.select(F.col(position).cast("bigint").alias("row_position"), F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c"))
        out = out.unionByName(found.select("c.issue_type", "c.column_name", "row_position", F.lit(None).cast("string").alias("detail")))
    for rule in rules:
        if rule.is_id and rule.column_name in columns:
            key = frame[rule.column_name].cast("string")
            again = frame.select(key.alias("of_id")).where("of_id is not null").groupBy("of_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            hit = frame.select(F.col(position).cast("bigint").alias("row_position"), key.alias("of_id")).join(again, "of_id", "left_semi")
            out = out.unionByName(hit.select(F.lit("duplicate_id").alias("issue_type"), F.lit(rule.column_name).alias("column_name"), "row_position", F.lit(None).cast("string").alias("detail")))
    return out
