import random

from geolith.llm.groups import group_sizes, linked_groups, match_pairs

SCHEMA = "left_index long, right_index long, similarity_percent double, w long, m string"


def groups(spark, scratch, pairs):
    frame = spark.createDataFrame([(a, b, s, 0, "clash") for a, b, s in pairs], SCHEMA)
    return sorted((r.group_index, r.feature_index) for r in linked_groups(match_pairs(frame), scratch).collect())


def union_find(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return sorted((find(x), x) for x in list(root))


def test_chains_loops_nulls_and_disagreeing_evaluations(spark, scratch):
    pairs = [(3, 2, 90.0), (2, 1, 85.0), (2, 3, 10.0), (9, 9, 99.0), (None, 1, 99.0), (5, None, 99.0), (6, 7, None), (7, 8, float("nan")), (10, 11, 84.999), (3, 2, 90.0), (3, 3, 90.0)]
    assert groups(spark, scratch, pairs) == [(1, 1), (1, 2), (1, 3), (9, 9)]
    assert groups(spark, scratch, []) == []
    assert groups(spark, scratch, [(4, 4, 100.0)]) == [(4, 4)]


def test_random_graphs_a_path_and_a_hub(spark, scratch):
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    order = list(range(1000, 1120))
    rng.shuffle(order)
    pairs += list(zip(order, order[1:]))  # a path in random order of labels
    pairs += [(5000, 5001 + i) for i in range(150)] + [(5000 - 1, 5060)]  # a hub that is not the least vertex
    assert groups(spark, scratch, [(a, b, 100.0) for a, b in pairs]) == union_find(pairs)


def test_sizes(spark, scratch):
    frame = spark.createDataFrame([(1, 2, 99.0, 0, ""), (2, 3, 99.0, 0, ""), (8, 9, 99.0, 0, "")], SCHEMA)
    out = group_sizes(linked_groups(match_pairs(frame), scratch))
    assert sorted((r.features, r.groups) for r in out.collect()) == [(2, 1), (3, 1)]
