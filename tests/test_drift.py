import json

from geolith.operators.drift import SchemaHistory, field_changes, series_table, unified_cells, unified_fields

FILES = "file_id long, series_name string, file_seq int, field string"
RECORDS = "file_id long, record_no long, payload string, kind string"


def tables(spark, files, records):
    f = spark.createDataFrame([(*x, "clash") for x in files], FILES)
    r = spark.createDataFrame([(a, b, c if c is None or isinstance(c, str) else json.dumps(c), "clash") for a, b, c in records], RECORDS)
    return f, r


def changes(spark, scratch, files, records):
    return sorted((r.file_id, r.issue_type, r.field_name, r.previous_name) for r in field_changes(*tables(spark, files, records), scratch).collect())


def series(*files):
    """Files 1, 2, ... of one series, each a list of payloads."""
    return [(i + 1, "s", i + 1) for i in range(len(files))], [(i + 1, n, p) for i, f in enumerate(files) for n, p in enumerate(f)]


def test_added_removed_renamed_and_changed(spark, scratch):
    a = [{"id": i, "name": f"n{i}", "h": i, "old": True, "same": 1} for i in range(10)]
    b = [{"id": i, "title": f"n{i}", "h": i + 0.5, "new": "x", "same": 2} for i in range(10)]
    assert changes(spark, scratch, *series(a, b)) == [(2, "added", "new", ""), (2, "removed", "old", ""), (2, "renamed", "title", "name"), (2, "type_changed", "h", "")]


def test_nine_tenths_of_the_values(spark, scratch):
    def pair(equal, of=10, lonely=0):
        a = [{"id": i, "x": i} for i in range(of)] + [{"id": 100 + i, "x": None} for i in range(lonely)]
        b = [{"id": i, "y": float(i) if i < equal else -1} for i in range(of)] + [{"id": 100 + i, "y": 5} for i in range(lonely)]
        return series(a, b)

    assert changes(spark, scratch, *pair(9)) == [(2, "renamed", "y", "x"), (2, "type_changed", "y", "")]
    assert changes(spark, scratch, *pair(8)) == [(2, "added", "y", ""), (2, "removed", "x", "")]
    assert changes(spark, scratch, *pair(10, lonely=2)) == [(2, "added", "y", ""), (2, "removed", "x", "")]
    assert changes(spark, scratch, *pair(10, lonely=1)) == [(2, "renamed", "y", "x"), (2, "type_changed", "y", "")]


def test_no_common_values_is_no_rename(spark, scratch):
    assert changes(spark, scratch, *series([{"id": 1, "x": None}], [{"id": 1, "y": None}])) == [(2, "added", "y", ""), (2, "removed", "x", "")]
    assert changes(spark, scratch, *series([{"id": 1, "x": "1"}], [{"id": 1, "y": 1}])) == [(2, "added", "y", ""), (2, "removed", "x", "")]
    assert changes(spark, scratch, *series([{"id": 1, "x": 1}], [{"id": 2, "y": 1}])) == [(2, "added", "y", ""), (2, "removed", "x", "")]


def test_types_from_values(spark, scratch):
    a = [{"id": 1, "a": 1, "b": 1, "c": "2020-01-01T00:00:00Z", "d": True, "e": None, "f": 1, "g": 1}]
    b = [{"id": 1, "a": 1.5, "b": "x", "c": "2020-02-30T00:00:00Z", "d": None, "e": 5, "f": 2, "g": 1}, {"id": 2, "a": 2, "f": True}, {"id": 3, "g": 1e3}]
    assert changes(spark, scratch, *series(a, b)) == [(2, "type_changed", k, "") for k in "abcfg"]


def test_order_repeats_strangers_and_empty(spark, scratch):
    files = [(3, "s", 1), (1, "s", 9), (1, "s", 9), (2, None, 1), (5, "t", 1)]
    records = [(3, 0, {"id": 1, "x": 1}), (3, 0, {"id": 1, "x": 1}), (1, 0, {"id": 1}), (77, 0, {"id": 1, "z": 1}), (1, 1, "no object"), (1, 2, None), (1, 3, "[1]"), (2, 0, {"q": 1})]
    assert changes(spark, scratch, files, records) == [(1, "removed", "x", "")]
    assert changes(spark, scratch, [], []) == []
    assert changes(spark, scratch, [(1, "s", 1), (2, "s", 2), (3, "s", 3)], [(1, 0, {"id": 1}), (3, 0, {"id": 1})]) == [(2, "removed", "id", ""), (3, "added", "id", "")]


def history(spark, scratch, files, records):
    kept = SchemaHistory(spark, f"{scratch.root}/kept").take(*tables(spark, files, records), scratch)
    kept = SchemaHistory(spark, kept.path)  # opened again by its path
    names = unified_fields(kept.versions, kept.table("types"), kept.steps)
    return kept, names, unified_cells(kept.table("records"), names)


def test_chained_renames_give_one_table(spark, scratch):
    kept, names, out = history(spark, scratch, *series([{"id": i, "a": i, "k": 1} for i in range(4)], [{"id": i, "b": i, "k": 2} for i in range(4)], [{"id": i, "c": float(i), "k": "z"} for i in range(4)]))
    assert {(x.file_id, x.field, x.type, x.rule) for x in out.collect()} == {(n, k, t, "kept" if k != "k" or n == 3 else "cast") for n in (1, 2, 3) for k, t in (("id", "integer"), ("c", "float"), ("k", "string"))}
    assert sorted(x.value for x in out.where("field = 'c' and record_no = 2").collect()) == ["2", "2", "2"]
    versions = kept.versions.collect()
    assert len({x.fingerprint for x in versions}) == 3 and sorted(x.version for x in versions) == [1, 2, 3]
    assert {(x.from_fingerprint, x.to_fingerprint) for x in kept.steps.collect()} == {(x.previous_fingerprint, x.fingerprint) for x in versions if x.previous_id}
    assert sorted(series_table(out, names, "s").collect())[0].asDict() == {"file_id": 1, "record_no": 0, "c": 0.0, "id": 0, "k": "1"}


def test_casts_defaults_and_rejected_values(spark, scratch):
    a = [{"id": 1, "n": "12", "f": "1.50", "b": "true", "gone": 1}, {"id": 2, "n": "x", "f": None}, {}]
    b = [{"id": 1, "n": 3, "f": 2.5, "b": False, "new": "t"}]
    _, _, out = history(spark, scratch, *series(a, b))
    got = {(x.file_id, x.record_no, x.field): (x.type, x.value, x.rule, x.given) for x in out.collect()}
    assert len(got) == 4 * 6
    assert got[1, 0, "n"] == ("integer", "12", "cast", None) and got[1, 1, "n"] == ("integer", None, "rejected", "x")
    assert got[1, 0, "f"] == ("float", "1.50", "cast", None) and got[1, 1, "f"] == ("float", None, "default", None)
    assert got[1, 0, "b"] == ("boolean", "true", "cast", None) and got[2, 0, "b"] == ("boolean", "false", "kept", None)
    assert got[1, 0, "new"] == ("string", None, "default", None) and got[2, 0, "gone"] == ("integer", None, "default", None)
    assert all(got[1, 2, f][2] == "default" for f in ("id", "n", "f", "b", "gone", "new"))


def test_a_name_taken_over_by_another_field(spark, scratch):
    a = [{"id": i, "a": i, "b": f"t{i}"} for i in range(4)]
    b = [{"id": i, "a": i} for i in range(4)]
    c = [{"id": i, "b": i} for i in range(4)]
    _, _, out = history(spark, scratch, *series(a, b, c))
    got = {(x.file_id, x.field): x.value for x in out.where("record_no = 2 and rule <> 'default'").collect()}
    assert got == {(1, "id"): "2", (1, "b"): "2", (1, "b#1"): "t2", (2, "id"): "2", (2, "b"): "2", (3, "id"): "2", (3, "b"): "2"}


def test_equal_fingerprints_need_no_steps(spark, scratch):
    kept, _, _ = history(spark, scratch, *series([{"id": 1, "x": 1}], [{"id": 9, "x": 7}], [{"id": 1, "y": 1}]))
    assert [x.version for x in sorted(kept.versions.collect(), key=lambda x: x.file_id)] == [1, 1, 2]
    assert sorted((x.file_id, x.issue_type) for x in kept.steps.collect()) == [(3, "added"), (3, "removed")]


def test_unified_numbers_keep_every_digit(spark):
    from pyspark.sql import functions as F

    from geolith.operators.differences import canonical_number
    from geolith.operators.drift import _plain_number

    given = ["1.23456789012345", "1e-11", "-0.5", "0", "1200", "-1.20", "1e38", "123456789012345678901234567890.5", "1e400", "-12345678901234567890123456789012345678e-20"]
    rows = spark.createDataFrame([(canonical_number(x),) for x in given], "v string").select(_plain_number(F.col("v"))).collect()
    assert [r[0] for r in rows] == ["1.23456789012345", "0.00000000001", "-0.5", "0", "1200", "-1.2", "1e38", "123456789012345678901234567890.5", "1e400", "-123456789012345678.90123456789012345678"]
