from geolith.operators.profile import ColumnRule, apply_deltas, attribute_issues, column_rules, counted_value, delivered_once, profile_metrics, value_deltas

RULES = [
    ColumnRule("id", "integer", False, True, None, "1", "999"),
    ColumnRule("score", "float", True, False, None, "0", "100", 20.0, True),
    ColumnRule("name", "string", False, False, "^[A-Z]+$"),
    ColumnRule("day", "datetime", True, False, None, "2000-01-01T00:00:00Z", "2030-12-31T23:59:59Z"),
    ColumnRule("ok", "boolean", True, False, None, None, None, None, True),
]
SCHEMA = "load_id long, row_position long, id string, score string, name string, day string, ok string, value string, n string"
LOADS = "load_id long, baseline_load_id long, row_position long"


def issues(spark, scratch, rows, loads=()):
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    out = attribute_issues(frame, RULES, spark.createDataFrame(list(loads), LOADS), scratch)
    return sorted((r.load_id, r.column_name, r.issue_type, r.row_position) for r in out.collect())


def row(load, pos, id="1", score="5", name="A", day="2020-01-01T00:00:00Z", ok="true"):
    return (load, pos, id, score, name, day, ok)


def test_faults_of_single_values(spark, scratch):
    rows = [
        row(1, 0, id="007"), row(1, 1, id=None, score=None), row(1, 2, id="+7", score="1e3"), row(1, 3, id="1000", score="100.0000001", name=None), row(1, 4, id="٤٢", score="100", name="a"),
        row(1, 5, id="8", day="2021-02-29T00:00:00Z"), row(1, 6, id="9", day="1999-12-31T23:59:59Z", ok="True"), row(1, 7, id="-0", day="2020-01-01T24:00:00Z"), row(1, 8, id="0", score="99999999999999999999999999999999999999999999", name="A\n"), row(1, 9, id="", score="12.", name=""),
    ]
    assert issues(spark, scratch, rows) == sorted([
        (1, "id", "duplicate_id", 0), (1, "id", "duplicate_id", 2), (1, "id", "duplicate_id", 7), (1, "id", "duplicate_id", 8), (1, "id", "null_value", 1), (1, "id", "out_of_range", 3), (1, "id", "invalid_data_type", 4),
        (1, "id", "out_of_range", 7), (1, "id", "out_of_range", 8), (1, "id", "invalid_data_type", 9), (1, "score", "invalid_data_type", 2), (1, "score", "out_of_range", 3), (1, "score", "out_of_range", 8), (1, "score", "invalid_data_type", 9),
        (1, "name", "null_value", 3), (1, "name", "pattern_violation", 4), (1, "name", "pattern_violation", 9), (1, "day", "invalid_data_type", 5), (1, "day", "out_of_range", 6), (1, "ok", "invalid_data_type", 6), (1, "day", "invalid_data_type", 7),
    ])


def test_rows_delivered_twice_count_once(spark, scratch):
    rows = [row(1, 0, id="5", name=None)] * 3 + [row(2, 0, id="5")]
    assert issues(spark, scratch, rows) == [(1, "name", "null_value", 0)]


def test_distribution_change_at_exactly_a_quarter(spark, scratch):
    def load(n, high, k):
        return [row(n, i, id=str(k + i), score="50" if i < high else "5") for i in range(8)]

    rows = load(1, 0, 10) + load(2, 2, 20) + load(3, 1, 30) + load(4, 0, 40)
    rows += [row(4, 8, id="70", score=None), row(4, 9, id="71", score="bad"), row(4, 10, id="72", ok=None), row(4, 11, id="73", score=None)]
    found = issues(spark, scratch, rows, [(1, None, 0), (2, 1, 0), (2, 1, 0), (3, 1, 0), (4, 1, 0), (9, 1, 0), (5, 77, 0)])
    assert [f for f in found if f[2] == "distribution_change"] == [(2, "score", "distribution_change", -1), (4, "score", "distribution_change", -1)]


def test_empty_table(spark, scratch):
    assert issues(spark, scratch, []) == []


def test_signed_deltas_equal_a_full_count(spark):
    frame = spark.createDataFrame([(*row(1, i, id=str(i % 3), score=None if i % 4 == 0 else str(i)), "", "") for i in range(20)], SCHEMA)
    rules = [ColumnRule("id"), ColumnRule("score")]
    once = delivered_once(frame, rules)
    deltas = lambda df, sign=1: value_deltas(df, {r.column_name: counted_value(df[r.column_name], r) for r in rules}, sign)
    state = apply_deltas(None, deltas(once.where("row_position < 12")))
    state = apply_deltas(state, deltas(once.where("row_position >= 8")), deltas(once.where("row_position between 8 and 11"), -1))
    key = lambda df: sorted(map(tuple, df.select("load_id", "column_name", "value", "n").collect()))
    assert key(state) == key(apply_deltas(None, deltas(once)))
    assert apply_deltas(state, deltas(once, -1)).isEmpty()
    metrics = {r.column_name: r for r in profile_metrics(state).collect()}
    assert (metrics["score"].rows, metrics["score"].nulls, metrics["score"].distinct_values) == (20, 5, 15)
    assert metrics["id"].distinct_values == 3 and abs(metrics["id"].entropy_bits - 1.581) < 1e-3


def test_rules_from_a_table(spark):
    t = spark.createDataFrame([("b", "float", None, None, None, "0", None, 2.0, True), ("a", "string", False, True, "^x$", None, None, None, None)], "column_name string, data_type string, nullable boolean, is_id boolean, value_pattern string, min_value string, max_value string, bin_width double, compare_loads boolean")
    a, b = column_rules(t)
    assert (a.column_name, a.nullable, a.is_id, a.compare_loads, b.nullable, b.bin_width) == ("a", False, True, False, True, 2.0)


def test_maintained_counts_equal_a_full_count(spark, scratch):
    from geolith.operators.profile import ValueCounts, repeated_deliveries

    schema = "load_id long, row_position long, v string, value string"
    first = [(1, 0, "a", "clash"), (1, 1, "b", "clash"), (1, 1, "b", "clash"), (2, 0, None, "clash")]
    late = [(1, 2, "a", "clash"), (2, 0, None, "clash"), (1, 1, "b", "clash"), (2, 1, "", "clash")]
    gone = [(1, 0, "a", "clash")]
    rule = ColumnRule("v")
    frame = lambda rows: spark.createDataFrame(rows, schema)
    delta = lambda df, sign=1: value_deltas(df, {"v": counted_value(df["v"], rule)}, sign)
    path = f"{scratch.root}/counts"
    kept = ValueCounts(spark, path)
    assert kept.version == 0 and kept.counts is None
    kept.apply(delta(frame(first)))
    kept.apply(delta(frame(late)))
    again = repeated_deliveries(frame(first + late))
    assert again.count() == 5
    kept.apply(delta(again, -1), delta(delivered_once(again, [rule])))
    ValueCounts(spark, path).apply(delta(frame(gone), -1))  # opened again by its path
    got = sorted((r.load_id, r.value, r.n) for r in kept.counts.collect())
    assert kept.version == 4 and got == [(1, "va", 1), (1, "vb", 1), (2, "0", 1), (2, "v", 1)]
    left = [r for r in first + late if r not in gone]
    assert sorted(map(tuple, profile_metrics(kept.counts).collect()), key=repr) == sorted(map(tuple, profile_metrics(delta(delivered_once(frame(left), [rule]))).collect()), key=repr)
