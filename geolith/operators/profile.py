"""Column profiles kept as value-count tables.

The state of the profile is one table, ``(load_id, column_name, value, n)``, kept under a path (ValueCounts): how often
each value of each column occurs in each load.  A delivery is a set of signed deltas to that table, so adding,
correcting or withdrawing rows never rescans what was counted before.  Null rates, distinct counts, ranges, entropy, repeated ids and the
distance between two loads' distributions are all derived from the counts.

Values are written with a leading kind letter: ``v`` text, ``b`` bin number, ``x`` text of invalid form in a
binned column, ``i`` integer id in its shortest form, ``0`` null.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.storage import file_system, remove

INTEGER = r"\A[+-]?[0-9]+\z"
FLOAT = r"\A[+-]?[0-9]+(\.[0-9]+)?\z"
BOOLEAN = r"\A(true|false)\z"
DATETIME = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z\z"
WHOLE_LOAD = -1
LEAST_CHANGE_NUM, LEAST_CHANGE_DEN = 1, 4
NULL_VALUE = "0"
COUNTS = "load_id bigint, column_name string, value string, n bigint"


@dataclass(frozen=True)
class ColumnRule:
    """What a column is expected to hold. min_value and max_value are texts of the column's own form."""

    column_name: str
    data_type: str = "string"
    nullable: bool = True
    is_id: bool = False
    value_pattern: str | None = None
    min_value: str | None = None
    max_value: str | None = None
    bin_width: float | None = None
    compare_loads: bool = False


def column_rules(table: DataFrame) -> list[ColumnRule]:
    """The rules of a column table (one row for each column of the schema, so bounded by the schema, not by data)."""
    names = list(ColumnRule.__dataclass_fields__)
    rows = {r["column_name"]: r for r in table.select(*names).distinct().collect() if r["column_name"] is not None}
    return [ColumnRule(**{n: rows[c][n] if rows[c][n] is not None or n not in ("nullable", "is_id", "compare_loads") else n == "nullable" for n in names}) for c in sorted(rows)]


def valid_form(value: Column, data_type: str) -> Column:
    """Whether non-null text has the form of a type; true for strings and types not known."""
    if data_type == "integer":
        return value.rlike(INTEGER)
    if data_type == "float":
        return value.rlike(FLOAT)
    if data_type == "boolean":
        return value.rlike(BOOLEAN)
    if data_type == "datetime":
        day = F.substring(value, 1, 10).try_cast("date")
        return value.rlike(DATETIME) & ~value.startswith("0000") & day.isNotNull()
    return F.lit(True)


def _sign_of(value: Column, bound: str) -> Column:
    """Sign of value - bound for numeric text, exact also where doubles tie."""
    near = value.try_cast("decimal(38,14)") - F.lit(bound).cast("decimal(38,14)")
    far = value.try_cast("double") - F.lit(float(bound))
    return F.when((far != 0) | near.isNull(), far).otherwise(near.cast("double"))


def out_of_range(value: Column, rule: ColumnRule) -> Column:
    """Whether text of valid form is outside the rule's range."""
    checks = []
    for bound, below in ((rule.min_value, True), (rule.max_value, False)):
        if bound is None:
            continue
        if rule.data_type in ("integer", "float"):
            sign = _sign_of(value, bound)
            checks.append(sign < 0 if below else sign > 0)
        else:  # texts of one fixed form order as their values
            checks.append(value < F.lit(bound) if below else value > F.lit(bound))
    if not checks:
        return F.lit(False)
    return checks[0] if len(checks) == 1 else checks[0] | checks[1]


def shortest_integer(value: Column) -> Column:
    """The integer in text of integer form without sign plus and leading zeros."""
    digits = F.regexp_replace(F.regexp_replace(value, r"\A[+-]", ""), r"\A0+(?=[0-9])", "")
    return F.when(value.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)


def counted_value(value: Column, rule: ColumnRule) -> Column:
    """The value under which a text is counted for a comparison of distributions."""
    if rule.bin_width is None:
        counted = F.concat(F.lit("v"), value)
    else:
        share = value.try_cast("double") / F.lit(float(rule.bin_width))
        number = F.when(F.abs(share) < 9e15, F.floor(share).cast("string")).otherwise(share.cast("string"))
        form = rule.data_type if rule.data_type in ("integer", "float") else "float"
        counted = F.when(valid_form(value, form), F.concat(F.lit("b"), number)).otherwise("x")
    return F.when(value.isNull(), NULL_VALUE).otherwise(counted)


def id_value(value: Column) -> Column:
    """The value under which an id is counted; null where the text is no integer."""
    return F.when(value.rlike(INTEGER), F.concat(F.lit("i"), shortest_integer(value)))


def row_faults(rules: Sequence[ColumnRule], row: DataFrame) -> Column:
    """Array of (column_name, issue_type) of one row."""
    faults = []
    for rule in rules:
        value = row[rule.column_name]

        def fault(condition, issue, rule=rule):
            faults.append(F.when(condition, F.struct(F.lit(rule.column_name).alias("column_name"), F.lit(issue).alias("issue_type"))))

        if not rule.nullable:
            fault(value.isNull(), "null_value")
        good = valid_form(value, rule.data_type)
        if rule.data_type in ("integer", "float", "boolean", "datetime"):
            fault(value.isNotNull() & ~good, "invalid_data_type")
        if rule.value_pattern is not None:
            fault(value.isNotNull() & ~value.rlike("(?d)" + rule.value_pattern), "pattern_violation")
        if rule.min_value is not None or rule.max_value is not None:
            fault(value.isNotNull() & good & out_of_range(value, rule), "out_of_range")
    return F.filter(F.array(*faults), lambda x: x.isNotNull()) if faults else F.array().cast("array<struct<column_name:string,issue_type:string>>")


def delivered_once(rows: DataFrame, rules: Sequence[ColumnRule], load: str = "load_id", position: str = "row_position", first: str | None = None) -> DataFrame:
    """One row for each (load, position). Rows delivered again count once; should their content differ, the greatest counts.

    first: a column of times; the least of a row's is returned as ``_received``.
    """
    present = [r.column_name for r in rules]
    times = [rows[first].alias("_received")] if first else []
    kept = rows.select(rows[load].alias("load_id"), rows[position].alias("row_position"), F.struct(*[rows[c].cast("string").alias(c) for c in present]).alias("v"), *times)
    kept = kept.groupBy("load_id", "row_position").agg(F.max("v").alias("v"), *[F.min("_received").alias("_received") for _ in times])
    return kept.select("load_id", "row_position", *[F.col("v")[c].alias(c) for c in present], *["_received" for _ in times])


def repeated_deliveries(rows: DataFrame, load: str = "load_id", position: str = "row_position") -> DataFrame:
    """The rows whose (load, position) was delivered more than once, each as often as it was."""
    again = rows.groupBy(rows[load].alias("_load"), rows[position].alias("_position")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return rows.join(again, rows[load].eqNullSafe(F.col("_load")) & rows[position].eqNullSafe(F.col("_position")), "left_semi")


def value_deltas(rows: DataFrame, values: dict[str, Column], sign: int = 1) -> DataFrame:
    """Signed counts (load_id, column_name, value, n) of rows that arrive (sign 1) or are withdrawn (-1).

    values: what to count, by the name it is counted under; null is not counted.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("column_name"), value.alias("value")) for name, value in values.items()])
    cells = rows.select("load_id", F.explode(F.filter(cells, lambda c: c["value"].isNotNull())).alias("c"))
    return cells.groupBy("load_id", F.col("c.column_name").alias("column_name"), F.col("c.value").alias("value")).agg((F.count(F.lit(1)) * sign).alias("n"))


def timely_and_late(rows: DataFrame, values: dict[str, Column], late: Column) -> DataFrame:
    """The deltas of rows in time (n) and of late ones (late_n) in one pass: load_id, column_name, value, n, late_n."""
    cells = F.array(*[F.struct(F.lit(name).alias("column_name"), value.alias("value")) for name, value in values.items()])
    cells = rows.select("load_id", late.alias("_late"), F.explode(F.filter(cells, lambda c: c["value"].isNotNull())).alias("c"))
    counts = [F.count(F.when(~F.col("_late"), 1)).alias("n"), F.count(F.when(F.col("_late"), 1)).alias("late_n")]
    return cells.groupBy("load_id", F.col("c.column_name").alias("column_name"), F.col("c.value").alias("value")).agg(*counts)


def apply_deltas(state: DataFrame | None, *deltas: DataFrame) -> DataFrame:
    """The value counts after the deltas. A value whose count reaches zero leaves the table."""
    tables = [t.select("load_id", "column_name", "value", "n") for t in (state, *deltas) if t is not None]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("load_id", "column_name", "value").agg(F.sum("n").alias("n")).where("n <> 0")


class ValueCounts:
    """The maintained value counts: numbered versions of the table under a path, the newest complete one counts.

    ``apply`` writes the next version, the sum of the present one and the deltas, and removes versions older than the one
    before, which readers may still hold.  A version that was not finished is never read and is written again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _complete(self) -> list[int]:
        fs, at = file_system(self.spark, self.path)
        if not fs.exists(at):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(file_system(self.spark, f"{self.path}/{n}/_SUCCESS")[1]))

    @property
    def version(self) -> int:
        """0 before the first delta."""
        return max(self._complete(), default=0)

    @property
    def counts(self) -> DataFrame | None:
        return self.spark.read.schema(COUNTS).parquet(f"{self.path}/v{self.version}") if self.version else None

    def apply(self, *deltas: DataFrame, summed: bool = False) -> DataFrame:
        """The counts after the deltas. summed: a first and only delta that has one row for each value is written as it is."""
        done = self._complete()
        now = max(done, default=0)
        if summed and not now and len(deltas) == 1:
            after = deltas[0].select("load_id", "column_name", "value", "n").where("n <> 0")
        else:
            after = apply_deltas(self.counts, *deltas)
        after.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/v{now + 1}")
        for old in done:
            if old < now:
                remove(self.spark, f"{self.path}/v{old}")
        return self.counts


def profile_metrics(counts: DataFrame) -> DataFrame:
    """One row for each load and column: rows, nulls, distinct values, repeated values, most frequent count, entropy in bits, least and greatest text.

    Exact, from value counts whose values are ``v`` texts and ``0`` for null. The null value takes part in the
    entropy and not in distinct_values. An empty table of counts gives no rows.
    """
    null = F.col("value") == NULL_VALUE
    n = F.col("n").cast("double")
    # Entropy of counts: log2 N - (sum n log2 n) / N, so no second pass over the counts is needed.
    sums = counts.groupBy("load_id", "column_name").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("nulls"),
        F.count(F.when(~null, 1)).alias("distinct_values"),
        F.count(F.when(~null & (F.col("n") > 1), 1)).alias("repeated_values"),
        F.max("n").alias("most_frequent"),
        F.sum(n * F.log2(n)).alias("nlogn"),
        F.min(F.when(~null, F.col("value"))).alias("lo"),
        F.max(F.when(~null, F.col("value"))).alias("hi"),
    )
    total = F.col("rows").cast("double")
    return sums.select(
        "load_id", "column_name", "rows", "nulls", F.round(F.col("nulls") / total, 6).alias("null_rate"), "distinct_values", "repeated_values", "most_frequent",
        F.round(F.abs(F.log2(total) - F.col("nlogn") / total), 6).alias("entropy_bits"),
        F.substring("lo", 2, 2**31 - 1).alias("least_text"), F.substring("hi", 2, 2**31 - 1).alias("greatest_text"),
    )


def changed_distributions(counts: DataFrame, baselines: DataFrame) -> DataFrame:
    """Columns of a load spread differently from its baseline: (load_id, column_name).

    counts: value counts of the columns to compare, null and invalid values included, so that they add up to the
    load's rows.  baselines: (load_id, baseline_load_id).  The load's counts and the baseline's, the latter with
    negative sign, are summed by value; half the sum of the absolute differences of shares is compared with a
    quarter in whole numbers, so nothing rounds.  A load without rows or whose baseline has none is not compared.
    """
    totals = counts.groupBy("load_id", "column_name").agg(F.sum("n").alias("total"))
    pairs = baselines.where("baseline_load_id is not null and load_id is not null").select("load_id", "baseline_load_id").distinct()
    sized = (
        pairs.join(totals, "load_id")
        .join(totals.select(F.col("load_id").alias("baseline_load_id"), "column_name", F.col("total").alias("base_total")), ["baseline_load_id", "column_name"])
        .select("load_id", "baseline_load_id", "column_name", *[F.col(c).cast("decimal(19,0)").alias(c) for c in ("total", "base_total")])
    )
    up = sized.join(counts, ["load_id", "column_name"]).select("load_id", "baseline_load_id", "column_name", "value", "total", "base_total", (F.col("n").cast("decimal(19,0)") * F.col("base_total")).alias("w"))
    down = sized.join(counts.withColumnRenamed("load_id", "baseline_load_id"), ["baseline_load_id", "column_name"]).select(
        "load_id", "baseline_load_id", "column_name", "value", "total", "base_total", (-F.col("n").cast("decimal(19,0)") * F.col("total")).alias("w")
    )
    key = ["load_id", "baseline_load_id", "column_name", "total", "base_total"]
    apart = up.unionByName(down).groupBy(*key, "value").agg(F.sum("w").alias("w")).groupBy(*key).agg(F.sum(F.abs("w")).alias("apart"))
    # apart / (total * base_total) / 2 >= num / den
    bound = (F.col("total") * F.col("base_total")).cast("decimal(38,0)")
    enough = F.col("apart").cast("decimal(38,0)") * LEAST_CHANGE_DEN >= bound * (2 * LEAST_CHANGE_NUM)
    return apart.where(enough).select("load_id", "column_name").distinct()


def attribute_issues(rows: DataFrame, rules: Sequence[ColumnRule], loads: DataFrame, scratch, *, received: str | None = None, started: str | None = None, late_hours: float = 24.0) -> DataFrame:
    """Every fault of landed rows, with its position: load_id, column_name, issue_type, row_position.

    rows: load_id, row_position and the rules' columns as text; loads: load_id, baseline_load_id.  Issue types:
    null_value, invalid_data_type, pattern_violation, out_of_range, duplicate_id, and distribution_change with
    row_position -1.  Empty text is a value, not a null.  Rows are deduplicated and counted in one pass whose
    result, faults and value counts, is written once; the rest reads only what it needs of that table.  Columns
    of ``rows`` that no rule names are not read.  No rows or no rules give no issues.

    The counts of the compared columns go as signed deltas into the maintained table under the scratch root: first those
    of the rows received (column ``received``) within late_hours of their load's start (``started`` of loads), then those
    of the late ones; without these columns all are one delta.  Repeated ids are counted in the same pass.
    """
    rules = list(rules)
    timed = received is not None and started is not None
    once = delivered_once(rows, rules, first=received if timed else None)
    compared = [r for r in rules if r.compare_loads]
    ids = [r for r in rules if r.is_id]
    text, long = "string", "bigint"
    late = F.lit(False)
    if timed:
        begun = loads.where("load_id is not null").groupBy("load_id").agg(F.min(started).alias("_begun"))  # metadata: one row a load
        once = once.join(begun, "load_id", "left")
        late = F.coalesce(F.col("_received") > F.col("_begun") + F.expr(f"interval {int(late_hours * 3600)} seconds"), F.lit(False))
    once = once.withColumn("_late", late)

    def cell(kind, column, issue, value, position):
        return F.struct(kind.alias("kind"), column.alias("column_name"), issue.alias("issue_type"), value.alias("value"), position.alias("row_position"))

    null_text, null_long = F.lit(None).cast(text), F.lit(None).cast(long)
    cells = [cell(F.lit("count"), F.lit(r.column_name), null_text, counted_value(once[r.column_name], r), null_long) for r in compared]
    cells += [F.when(id_value(once[r.column_name]).isNotNull(), cell(F.lit("id"), F.lit(r.column_name), null_text, id_value(once[r.column_name]), null_long)) for r in ids]
    faults = F.transform(row_faults(rules, once), lambda x: cell(F.lit("fault"), x["column_name"], x["issue_type"], null_text, once["row_position"]))
    # Faults are one row each; values are pre-summed map-side and then summed by the same shuffle.
    landed = (
        once.select("load_id", "_late", F.explode(F.concat(faults, F.filter(F.array(*cells), lambda c: c.isNotNull())) if cells else faults).alias("c"))
        .groupBy("load_id", "c.kind", "c.column_name", "c.issue_type", "c.value", "c.row_position")
        .agg(F.count(F.when(~F.col("_late"), 1)).alias("n"), F.count(F.when(F.col("_late"), 1)).alias("late_n"))
        .where("kind <> 'id' or n + late_n > 1")  # of the id counts, only the repeated ones matter here
    )
    state = scratch.save(landed, by=("kind",))
    found = state.where("kind = 'fault'").select("load_id", "column_name", "issue_type", "row_position")
    if compared:
        delta = lambda n: state.where(f"kind = 'count' and {n} > 0").select("load_id", "column_name", "value", F.col(n).alias("n"))
        kept = ValueCounts(rows.sparkSession, f"{scratch.root}/counts")
        counts = kept.apply(delta("n"), summed=True)
        if timed:
            counts = kept.apply(delta("late_n"))
        changed = changed_distributions(counts, loads)
        found = found.unionByName(changed.select("load_id", "column_name", F.lit("distribution_change").alias("issue_type"), F.lit(WHOLE_LOAD).cast(long).alias("row_position")))
    for rule in ids:
        repeated = state.where((F.col("kind") == "id") & (F.col("column_name") == rule.column_name)).select(F.col("load_id").alias("of_load"), F.col("value").alias("of_value"))
        # Only the two numbers and the id travel here; a position delivered twice is removed after the filter, when few rows are left.
        value = id_value(rows[rule.column_name].cast(text))
        at = rows.select(rows["load_id"].alias("load_id"), rows["row_position"].alias("row_position"), value.alias("value")).where(F.col("value").isNotNull())
        hit = at.join(repeated, F.col("load_id").eqNullSafe(F.col("of_load")) & (F.col("value") == F.col("of_value")), "left_semi").select("load_id", "row_position").distinct()
        found = found.unionByName(hit.select("load_id", F.lit(rule.column_name).alias("column_name"), F.lit("duplicate_id").alias("issue_type"), "row_position"))
    return found
