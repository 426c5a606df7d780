"""Schemas that drift between the files of a series.

Each file has a fingerprint: its fields and their types, derived from the records.  A series' fingerprints are its
schema versions; where a file's fingerprint is not that of the file before it, explicit migration steps (added,
removed, renamed, type_changed) lead from the one to the other.  Fingerprints and steps are kept as tables under a
path (SchemaHistory).  A file's records are routed through the chained renames, defaults and casts to the form of the
series' newest version, and what each rule did to each value is recorded beside it.

Records are parsed where they stand, in Arrow batches: once for the kinds of their values, which leave Python already
aggregated, and once more for the few fields that may have been renamed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from datetime import date

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolith.operators.differences import WrittenNumber, canonical_number, canonical_value, surrogate_free
from geolith.operators.profile import DATETIME
from geolith.storage import Scratch

RENAME_NUM, RENAME_DEN = 9, 10
KINDS = ("boolean", "integer", "float", "datetime", "string", "other")
BIT = {k: 1 << i for i, k in enumerate(KINDS)}
CHANGES = ("added", "removed", "renamed", "type_changed")
MOST_HELD = 50_000
_DATETIME = re.compile(DATETIME.replace(r"\z", r"\Z"))


class _Whole(WrittenNumber):
    """A JSON number as written, without point or exponent."""

    __slots__ = ()


class _Point(_Whole):
    """A JSON number as written, with point or exponent."""

    __slots__ = ()


_DECODER = json.JSONDecoder(parse_float=_Point, parse_int=_Whole, parse_constant=_Whole)
_BIT_OF = {type(None): 0, bool: BIT["boolean"], _Whole: BIT["integer"], _Point: BIT["float"]}


def read_record(text: str | None) -> dict:
    """The fields of a JSON object, numbers as written; none for null and for text that is no object."""
    try:
        value = _DECODER.decode(text) if text is not None else None
    except (ValueError, RecursionError):
        return {}
    return value if isinstance(value, dict) else {}


def is_datetime(text: str) -> bool:
    """Whether text is of the datetime form, a real date included."""
    if len(text) != 20 or text[10] != "T" or not _DATETIME.match(text):
        return False
    try:
        return bool(date(int(text[:4]), int(text[5:7]), int(text[8:10])))
    except ValueError:
        return False


def kind_bit(value) -> int:
    """The bit of a value's kind; 0 for null."""
    bit = _BIT_OF.get(type(value))
    if bit is None:
        bit = BIT["other"] if not isinstance(value, str) else BIT["datetime"] if is_datetime(value) else BIT["string"]
    return bit


def canonical(value) -> str | None:
    """A value as text that is equal exactly for equal values."""
    if isinstance(value, _Whole):
        if value.isdigit() and value[0] != "0":  # the common case, without Decimal
            short = value.rstrip("0")
            return f"n{short}e{len(value) - len(short)}"
        return "n" + canonical_number(value)
    found = canonical_value(value)
    return found if found is None else surrogate_free(found)


def _kinds(batches):
    """file_id, payload -> file_id, field, kinds (bits), summed up over what a task has seen."""
    seen: dict[tuple[int, str], int] = {}

    def flush():
        out = pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.int64()), pa.array([surrogate_free(k[1]) for k in seen], pa.string()), pa.array(seen.values(), pa.int32())], ["file_id", "field", "kinds"]
        )
        seen.clear()
        return out

    for batch in batches:
        for file, text in zip(batch.column("file_id").to_pylist(), batch.column("payload").to_pylist()):
            for name, value in read_record(text).items():
                key = (file, name)
                seen[key] = seen.get(key, 0) | kind_bit(value)
        if len(seen) > MOST_HELD:
            yield flush()
    yield flush()


def _lone_values(batches):
    """record_no, payload, wants (JSON: [file, now, fields] ...) -> file_id, now, record_no, id, fields (field, value).

    fields has a last entry without name, so that a product of two sides' fields also counts each side's own.
    """
    known: dict[str, list] = {}
    for batch in batches:
        files, sides, numbers, ids, ends, names, values = [], [], [], [], [0], [], []
        for number, text, wants in zip(*(batch.column(c).to_pylist() for c in ("record_no", "payload", "wants"))):
            if wants not in known:
                if len(known) > MOST_HELD:
                    known.clear()
                known[wants] = [(w["file_id"], w["now"], w["fields"]) for w in json.loads(wants)]
            record = read_record(text)
            own = canonical(record.get("id"))
            if own is None:
                continue
            free = record if all(k.isascii() for k in record) else {surrogate_free(k): v for k, v in record.items()}
            for file, now, fields in known[wants]:
                for f in fields:
                    if (value := canonical(free.get(f))) is not None:
                        names.append(f)
                        values.append(value)
                names.append(None)
                values.append(None)
                ends.append(len(names))
                files.append(file)
                sides.append(now)
                numbers.append(number)
                ids.append(own)
        fields = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], ["field", "value"]))
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(sides, pa.bool_()), pa.array(numbers, pa.int64()), pa.array(ids, pa.string()), fields], ["file_id", "now", "record_no", "id", "fields"])


def _cells(batches):
    """file_id, record_no, payload -> one row for each field: file_id, record_no, field, kind, value (canonical; null for null)."""
    by_bit = {v: k for k, v in BIT.items()}
    for batch in batches:
        files, numbers, names, kinds, values = [], [], [], [], []
        for file, number, text in zip(*(batch.column(c).to_pylist() for c in ("file_id", "record_no", "payload"))):
            for name, value in read_record(text).items():
                files.append(file)
                numbers.append(number)
                names.append(surrogate_free(name))
                kinds.append(by_bit.get(kind_bit(value)))
                values.append(canonical(value))
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(numbers, pa.int64()), *[pa.array(x, pa.string()) for x in (names, kinds, values)]], ["file_id", "record_no", "field", "kind", "value"])


def file_versions(files: DataFrame) -> DataFrame:
    """file_id, series_name, file_seq and the id of the file before it in the series (next lower file_seq); rows given twice count once.

    Files without series or file_seq have no predecessor and are none.
    """
    kept = files.select(files["file_id"].cast("bigint").alias("file_id"), files["series_name"].alias("series_name"), files["file_seq"].cast("bigint").alias("file_seq"))
    kept = kept.where("file_id is not null and series_name is not null and file_seq is not null").distinct()
    # Metadata only: a window holds the file names of one series, never their records.
    return kept.withColumn("previous_id", F.lag("file_id").over(Window.partitionBy("series_name").orderBy("file_seq", "file_id")))


def delivered_records(records: DataFrame) -> DataFrame:
    """file_id, record_no, payload of each record. Records given twice count once; should they differ, the greatest counts."""
    once = records.select(records["file_id"].cast("bigint").alias("file_id"), records["record_no"].cast("bigint").alias("record_no"), records["payload"].alias("payload"))
    return once.groupBy("file_id", "record_no").agg(F.max("payload").alias("payload"))


def field_types(once: DataFrame) -> DataFrame:
    """file_id, field, type of each file's fields. Integers with floats are float, any other mixture string, no values no type."""
    found = once.where("file_id is not null").select("file_id", "payload").mapInArrow(_kinds, "file_id bigint, field string, kinds int")
    kinds = found.groupBy("file_id", "field").agg(F.bit_or("kinds").alias("k"))
    only = lambda *names: F.col("k").bitwiseAND(F.lit(sum(BIT.values()) - sum(BIT[n] for n in names))) == 0
    kind = F.when(F.col("k") == 0, F.lit(None).cast("string")).when(only("integer"), "integer").when(only("integer", "float"), "float").when(only("boolean"), "boolean").when(only("datetime"), "datetime").otherwise("string")
    return kinds.select("file_id", "field", kind.alias("type"))


def fingerprints(types: DataFrame) -> DataFrame:
    """file_id, fields, fingerprint: a digest of the sorted (field, type) list."""
    sorted_fields = F.array_sort(F.collect_list(F.struct("field", F.coalesce("type", F.lit("")).alias("type"))))  # the fields of one file
    return types.groupBy("file_id").agg(sorted_fields.alias("f")).select("file_id", F.size("f").alias("fields"), F.sha2(F.to_json("f"), 256).alias("fingerprint"))


def schema_versions(versions: DataFrame, prints: DataFrame) -> DataFrame:
    """The files with their fingerprint, the one before, and the number of the schema version within the series, from 1.

    A file without records has an empty fingerprint. Metadata only: one row a file.
    """
    named = versions.join(prints, "file_id", "left").select("series_name", "file_seq", "file_id", "previous_id", F.coalesce("fields", F.lit(0)).alias("fields"), F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))
    order = Window.partitionBy("series_name").orderBy("file_seq", "file_id")
    before = named.withColumn("previous_fingerprint", F.lag("fingerprint").over(order))
    new = F.when(F.col("previous_fingerprint").eqNullSafe(F.col("fingerprint")), 0).otherwise(1)
    return before.withColumn("version", F.sum(new).over(order))


def migration_steps(history: DataFrame, once: DataFrame, types: DataFrame, scratch: Scratch) -> DataFrame:
    """What leads from a file's predecessor to it, where their fingerprints differ: file_id, issue_type, field_name, previous_name, old_type, new_type.

    history: schema_versions. A name only before and a name only now are one field renamed if, of the ids in both files
    at which one of the two has a value, at least nine tenths have equal values (there must be one). Numbers compare by
    value, and a number never equals a string or boolean. If a file holds an id more than once, the record of the lowest
    number counts. Records without id take no part in that. A file without records has no fields.
    """
    pairs = history.where("previous_id is not null and not (fingerprint <=> previous_fingerprint)").select("file_id", "previous_id")
    old_side, new_side = F.lit(None).cast("struct<t:string>"), F.struct(F.col("type").alias("t"))
    now = pairs.join(types, "file_id").select("file_id", "previous_id", "field", old_side.alias("old"), new_side.alias("new"))
    before = pairs.join(types.withColumnRenamed("file_id", "previous_id"), "previous_id").select("file_id", "previous_id", "field", new_side.alias("old"), old_side.alias("new"))
    sides = now.unionByName(before).groupBy("file_id", "previous_id", "field").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    sides = scratch.save(sides.select("file_id", "previous_id", "field", F.col("old").isNotNull().alias("before"), F.col("new").isNotNull().alias("now"), F.col("old.t").alias("old_type"), F.col("new.t").alias("new_type")))  # metadata: a row for each file and field
    # Files whose pair has names on both sides only are looked into: which fields of which record, by the file it is in.
    lone = sides.where("before <> now").groupBy("file_id", "previous_id").agg(*[F.collect_list(F.when(F.col("now") == F.lit(is_now), F.col("field"))).alias(name) for name, is_now in (("gone", False), ("come", True))])
    lone = lone.where((F.size("gone") > 0) & (F.size("come") > 0))
    want = lambda now, of, fields: F.struct(F.col(of).alias("of_file"), F.col("file_id").alias("file_id"), F.lit(now).alias("now"), F.col(fields).alias("fields"))
    wants = lone.select(F.explode(F.array(want(True, "file_id", "come"), want(False, "previous_id", "gone"))).alias("w"))
    wants = wants.groupBy(F.col("w.of_file").alias("file_id")).agg(F.to_json(F.collect_list(F.struct("w.file_id", "w.now", "w.fields"))).alias("wants"))  # at most two for a file
    values = once.join(wants, "file_id").select("record_no", "payload", "wants").mapInArrow(_lone_values, "file_id bigint, now boolean, record_no bigint, id string, fields array<struct<field:string,value:string>>")
    first = lambda now: F.min_by(F.when(F.col("now") == F.lit(now), F.col("fields")), F.when(F.col("now") == F.lit(now), F.col("record_no")))
    both = values.groupBy("file_id", "id").agg(first(False).alias("o"), first(True).alias("n")).where("o is not null and n is not null")
    # The product is over the lone fields of one record, inside the aggregation; the entries without name count either side alone.
    crossed = both.select("file_id", F.explode("o").alias("o"), "n").select("file_id", "o", F.explode("n").alias("n"))
    equal = F.sum(F.when(F.col("o.value") == F.col("n.value"), 1).otherwise(0))
    counted = scratch.save(crossed.groupBy("file_id", F.col("o.field").alias("old"), F.col("n.field").alias("new")).agg(F.count(F.lit(1)).alias("n"), equal.alias("equal_n")))
    held = lambda name, other: counted.where(F.col(name).isNotNull() & F.col(other).isNull()).select("file_id", name, F.col("n").alias(name + "_n"))
    alike = counted.where("old is not null and new is not null and equal_n > 0").join(held("old", "new"), ["file_id", "old"]).join(held("new", "old"), ["file_id", "new"])
    sure = alike.where(F.col("equal_n") * RENAME_DEN >= (F.col("old_n") + F.col("new_n") - F.col("n")) * RENAME_NUM)
    typed = lambda name: sides.select("file_id", F.col("field").alias(name), F.col(f"{name}_type"))
    renamed = scratch.save(sure.select("file_id", "old", "new").join(typed("old"), ["file_id", "old"]).join(typed("new"), ["file_id", "new"]))
    # Both ends of a rename, so one anti join tells which lone fields are left.
    ends = renamed.select("file_id", F.explode(F.array(F.struct(F.col("old").alias("field"), F.lit(False).alias("now")), F.struct(F.col("new").alias("field"), F.lit(True).alias("now")))).alias("e")).select("file_id", "e.field", "e.now")
    rest = sides.where("before <> now").join(ends, ["file_id", "field", "now"], "left_anti")
    plain = rest.select("file_id", F.when(F.col("now"), "added").otherwise("removed").alias("issue_type"), F.col("field").alias("field_name"), F.lit("").alias("previous_name"), "old_type", "new_type")
    changed = sides.where("before and now").select("file_id", "field", "old_type", "new_type").unionByName(renamed.select("file_id", F.col("new").alias("field"), "old_type", "new_type")).where("old_type <> new_type").distinct()
    out = renamed.select("file_id", F.lit("renamed").alias("issue_type"), F.col("new").alias("field_name"), F.col("old").alias("previous_name"), "old_type", "new_type")
    return out.unionByName(plain).unionByName(changed.select("file_id", F.lit("type_changed").alias("issue_type"), F.col("field").alias("field_name"), F.lit("").alias("previous_name"), "old_type", "new_type"))


class SchemaHistory:
    """The schema versions of all series and the steps between them, as tables kept under a path.

    ``take`` reads delivered files and writes the tables ``records``, ``types``, ``versions`` and ``steps``; they are then
    read from there, by this session or a later one that opens the path again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def take(self, files: DataFrame, records: DataFrame, scratch: Scratch) -> SchemaHistory:
        once = self._keep("records", delivered_records(records))
        types = self._keep("types", field_types(once))
        versions = self._keep("versions", schema_versions(file_versions(files), fingerprints(types)))
        steps = migration_steps(versions, once, types, scratch)
        ends = versions.select("file_id", "series_name", "version", F.col("previous_fingerprint").alias("from_fingerprint"), F.col("fingerprint").alias("to_fingerprint"))
        self._keep("steps", steps.join(ends, "file_id"))
        return self

    @property
    def versions(self) -> DataFrame:
        """series_name, file_seq, file_id, previous_id, fields, fingerprint, previous_fingerprint, version."""
        return self.table("versions")

    @property
    def steps(self) -> DataFrame:
        """file_id, issue_type, field_name, previous_name, old_type, new_type, series_name, version, from_fingerprint, to_fingerprint."""
        return self.table("steps")


def chained_names(frame: pd.DataFrame) -> pd.DataFrame:
    """One series: how each file's fields are called in the newest version. Metadata only: fields and renames of its files.

    A field that was removed before another one was renamed to its name is not that one: it gets the name with ``#`` and
    the last file that held it, and so does the second of two fields that one field replaced: no file has two fields of
    one unified name.
    """
    frame = frame.sort_values(["file_seq", "file_id"])
    order = list(dict.fromkeys(frame["file_id"]))
    fields: dict[int, set[str]] = {f: set() for f in order}
    steps: dict[int, dict[str, str]] = {f: {} for f in order}
    for r in frame.itertuples():
        if r.previous_name:
            steps[r.file_id].setdefault(r.previous_name, r.field)
        elif r.field is not None:
            fields[r.file_id].add(r.field)
    rows, later, taken = [], {}, set()
    for file in reversed(order):
        used: set[str] = set()
        for f in sorted(fields[file], key=lambda f: (f in later, f)):
            if later.get(f, f) in used or (f in taken and f not in later):
                later[f] = f"{f}#{file}"
            used.add(later.get(f, f))
        rows += [(frame["series_name"].iloc[0], file, f, later.get(f, f)) for f in sorted(fields[file])]
        renamed = steps[file]
        taken |= set(renamed.values())
        later = {**{k: v for k, v in later.items() if k not in renamed.values()}, **{old: later.get(new, new) for old, new in renamed.items()}}
    return pd.DataFrame(rows, columns=["series_name", "file_id", "field", "unified"])


def unified_fields(history: DataFrame, types: DataFrame, steps: DataFrame) -> DataFrame:
    """series_name, file_id, field, unified (the field's name in the newest version), unified_type (its type in the newest file that gives it one; string if none does)."""
    fields = history.join(types, "file_id").select("series_name", "file_id", "file_seq", "field", F.lit("").alias("previous_name"))
    renames = history.select("series_name", "file_id", "file_seq").join(steps.where("issue_type = 'renamed'").select("file_id", "field_name", "previous_name"), "file_id").select("series_name", "file_id", "file_seq", F.col("field_name").alias("field"), "previous_name")
    bare = history.select("series_name", "file_id", "file_seq", F.lit(None).cast("string").alias("field"), F.lit("").alias("previous_name"))
    names = fields.unionByName(renames).unionByName(bare).groupBy("series_name").applyInPandas(chained_names, "series_name string, file_id bigint, field string, unified string")
    typed = names.join(types, ["file_id", "field"]).join(history.select("file_id", "file_seq"), "file_id")
    whole = typed.groupBy("series_name", "unified").agg(F.coalesce(F.max_by(F.when(F.col("type").isNotNull(), F.col("type")), F.when(F.col("type").isNotNull(), F.struct("file_seq", "file_id"))), F.lit("string")).alias("unified_type"))
    return names.join(whole, ["series_name", "unified"]).select("series_name", "file_id", "field", "unified", "unified_type")


def _plain_number(canonical: Column) -> Column:
    """A canonical number (digits, e, exponent) in plain decimal writing where that has up to 38 digits, else as it is: no digit is lost."""
    part = lambda k: F.regexp_extract(canonical, "^(-?)([0-9]+)e(-?[0-9]+)$", k)
    sign, digits, e = part(1), part(2), part(3).try_cast("int")
    n = F.length(digits)
    point = n + e
    whole = F.concat(sign, digits, F.repeat(F.lit("0"), e))
    mixed = F.concat(sign, F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    return F.when(e.isNull() | (e > 38) | (e < -38) | (F.greatest(n, point) > 38), canonical).when(e >= 0, whole).when(point > 0, mixed).otherwise(small)


_CASTS = {"integer": ("integer",), "float": ("integer", "float"), "boolean": ("boolean",), "datetime": ("datetime",), "string": ("string", "datetime")}
_FORMS = {"integer": r"\A[+-]?[0-9]+(\.0+)?\z", "float": r"\A[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z", "boolean": r"\A(true|false)\z", "datetime": DATETIME}


def unified_cells(once: DataFrame, names: DataFrame) -> DataFrame:
    """Every record under its series' newest schema: series_name, file_id, record_no, field, type, value, rule, given.

    One row for each record and each field of the series.  rule tells what was done: ``kept`` (the value is of the type),
    ``cast`` (it is written in the form of the type), ``rejected`` (it cannot be: value is null, given keeps the text),
    ``default`` (the file has no such field, the record lacks it or holds null: value is null, the default of all types).
    Types compare as TESTDATA's: a whole number is a float, any value has a text.  No record is lost, also one without
    values.  Records of files that are in no series are left out.
    """
    cells = once.where("file_id is not null").mapInArrow(_cells, "file_id bigint, record_no bigint, field string, kind string, value string").where("value is not null")
    text = F.substring("value", 2, 2**31 - 1)
    plain = F.when(F.col("value").startswith("n"), _plain_number(text)).otherwise(text)
    held = cells.join(names.select("file_id", "field", "unified"), ["file_id", "field"]).select("file_id", "record_no", F.col("unified").alias("field"), "kind", plain.alias("given"))
    held = held.groupBy("file_id", "record_no").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("kind", "given")))).alias("held"))  # the fields of one record
    wanted = names.select("series_name", F.struct(F.col("unified").alias("field"), F.col("unified_type").alias("type")).alias("f")).distinct().groupBy("series_name").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    routes = names.select("series_name", "file_id").distinct().join(wanted, "series_name")  # metadata: one row a file
    rows = once.select("file_id", "record_no").join(routes, "file_id").join(held, ["file_id", "record_no"], "left")
    rows = rows.select("series_name", "file_id", "record_no", F.explode("fs").alias("f"), "held").select("series_name", "file_id", "record_no", "f.field", "f.type", F.try_element_at("held", F.col("f.field")).alias("v"))
    kind, given, type_ = F.col("v.kind"), F.col("v.given"), F.col("type")
    fits = F.lit(False)
    form = F.lit(False)
    for name, kinds in _CASTS.items():
        fits = F.when(type_ == name, kind.isin(*kinds)).otherwise(fits)
        if name in _FORMS:
            form = F.when(type_ == name, given.rlike(_FORMS[name])).otherwise(form)
    form = (type_ == "string") | form
    rule = F.when(given.isNull(), "default").when(fits, "kept").when(form, "cast").otherwise("rejected")
    return rows.select("series_name", "file_id", "record_no", "field", "type", F.when(rule.isin("kept", "cast"), given).alias("value"), rule.alias("rule"), F.when(rule == "rejected", given).alias("given"))


_SQL_TYPES = {"integer": "decimal(38,0)", "float": "double", "boolean": "boolean", "datetime": "timestamp", "string": "string"}


def series_table(unified: DataFrame, names: DataFrame, series: str) -> DataFrame:
    """One series as a table of real types: file_id, record_no and a column for each of its fields. The field list is metadata and collected."""
    fields = {r["unified"]: r["unified_type"] for r in names.where(F.col("series_name") == series).select("unified", "unified_type").distinct().collect()}
    wide = unified.where(F.col("series_name") == series).groupBy("file_id", "record_no").pivot("field", sorted(fields)).agg(F.first("value"))
    return wide.select("file_id", "record_no", *[F.col(f"`{f}`").try_cast(_SQL_TYPES[fields[f]]).alias(f) for f in sorted(fields)])


def field_changes(files: DataFrame, records: DataFrame, scratch: Scratch) -> DataFrame:
    """file_id, issue_type, field_name, previous_name of every file that has a predecessor in its series.

    files: file_id, series_name, file_seq; records: file_id, record_no, payload (a JSON object, identified by its
    field ``id``). Records of files that are not listed are not looked at. Read from the steps of a schema history.
    """
    history = SchemaHistory(records.sparkSession, f"{scratch.root}/history").take(files, records, scratch)
    return history.steps.select("file_id", "issue_type", "field_name", "previous_name")


def all_changes(steps: DataFrame, kinds: Iterable[str] = CHANGES) -> DataFrame:
    """Number of changes by kind."""
    return steps.where(F.col("issue_type").isin(*kinds)).groupBy("issue_type").agg(F.count(F.lit(1)).alias("changes"))
