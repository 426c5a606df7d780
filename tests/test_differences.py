import json

from geolith.operators.differences import compare_copies

SCHEMA = "dataset_name string, feature_key long, revision int, geometry_wkt string, attributes string, difference_kind string"
SQ = "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"


def table(spark, *rows):
    """Rows (key, revision, geometry, attributes); the clashing last column is junk."""
    return spark.createDataFrame([("d", k, r, g, a if a is None or isinstance(a, str) else json.dumps(a), "junk") for k, r, g, a in rows], SCHEMA)


def found(spark, left, right):
    return sorted((r.feature_key, r.difference_kind, r.field_name) for r in compare_copies(table(spark, *left), table(spark, *right)).collect())


def test_every_kind_of_difference(spark):
    left = [(1, 1, SQ, {"a": 1}), (2, 1, SQ, {"a": 1}), (3, 1, SQ, {"a": 1, "b": None}), (4, 1, None, {"x": "1"}), (5, 1, SQ, {"a": True})]
    right = [(2, 1, "POLYGON ((1 1, 0 1, 0 0, 0.5 0, 1 0, 1 1))", {"a": 1.0}), (3, 1, "POLYGON ((0 0, 1 0, 1 1, 0 0))", {"a": 2}), (4, 1, None, {"x": 1}), (5, 1, None, {"a": "true", "c": []}), (9, 1, SQ, {})]
    assert found(spark, left, right) == [(1, "removed", ""), (3, "modified", "a"), (3, "modified", "geometry"), (4, "modified", "x"), (5, "modified", "a"), (5, "modified", "c"), (5, "modified", "geometry"), (9, "added", "")]


def test_numbers_compare_by_exact_value(spark):
    left = [(1, 1, SQ, '{"n": 24615836700333627}'), (2, 1, SQ, '{"n": 1e2}'), (3, 1, SQ, '{"n": 0.1}'), (4, 1, SQ, '{"n": -0}')]
    right = [(1, 1, SQ, '{"n": 24615836700333628}'), (2, 1, SQ, '{"n": 100.00}'), (3, 1, SQ, '{"n": 0.1000000000000000055}'), (4, 1, SQ, '{"n": 0.0}')]
    assert found(spark, left, right) == [(1, "modified", "n"), (3, "modified", "n")]


def test_strings_compare_by_code_points(spark):
    assert found(spark, [(1, 1, SQ, '{"s": "\\u00e9"}'), (2, 1, SQ, '{"s": "é"}')], [(1, 1, SQ, '{"s":"é"}'), (2, 1, SQ, '{"s": "e\\u0301"}')]) == [(2, "modified", "s")]


def test_current_rows_null_keys_and_repeats(spark):
    left = [(1, 1, "POINT (9 9)", {"a": 0}), (1, 2, SQ, {"a": 1}), (1, 2, SQ, {"a": 1}), (None, 5, SQ, {"a": 1}), (2, None, SQ, None)]
    right = [(1, 3, SQ, {"a": 1}), (1, 2, SQ, {"a": 7}), (2, 1, SQ, {})]
    assert found(spark, left, right) == []
    assert found(spark, [], []) == []
    assert found(spark, [], [(1, 1, None, None)]) == [(1, "added", "")]


def test_text_that_is_no_object_and_long_values(spark):
    long = "x" * 200_000
    assert found(spark, [(1, 1, SQ, "{broken"), (2, 1, SQ, {"a": long})], [(1, 1, SQ, "{other"), (2, 1, SQ, {"a": long + "y"})]) == [(1, "modified", "attributes"), (2, "modified", "a")]
    assert found(spark, [(1, 1, "", '{"a": {"b": [1, 2.0]}}')], [(1, 1, "", '{"a": {"b": [1.0, 2]}}')]) == []


def test_partitioning_changes_nothing(spark):
    left = [(k, 1, SQ, {"a": k % 3}) for k in range(60)]
    right = [(k, 1, SQ, {"a": k % 4}) for k in range(5, 70)]
    a, b = table(spark, *left), table(spark, *right)
    one = sorted(map(tuple, compare_copies(a.coalesce(1), b.coalesce(1)).collect()))
    assert one == sorted(map(tuple, compare_copies(a.repartition(7), b.repartition(5)).collect())) and one
