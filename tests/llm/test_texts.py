import random

import numpy as np
import pandas as pd
import pytest
import regex

from geolith.llm.packing import Levels, pack_items, pack_window, packing_report, pieces_of, sum_of_squares
from geolith.llm.repetition import host_rates, judge_repetition, repeated_words, with_host_verdicts
from geolith.llm.tokens import VOCABULARY, decode_tree, encode_tree, encoder, token_counts, token_ids

ODD = [None, "", " ", "\n\n\n", "a", "it's  the　end", "<|endoftext|>", "é" * 50, "哥倎勧" * 400, "x" * 3000, "😀 ok\r\n\t" * 200, ("word " * 5000)]


def test_any_tree_gives_the_ids_of_the_whole_text():
    encode = encoder(VOCABULARY).encode_ordinary
    rng = random.Random(1)
    letters = " \n\t'sd　é哥1.,!the😀"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 250)))
        whole = encode(text)
        for leaf in (1, 3, 17, 60, 1000):
            assert encode_tree(text, encode, leaf) == whole
        assert decode_tree(whole) == text


def test_ids_of_odd_texts(spark):
    frame = spark.createDataFrame([(i, t, [7]) for i, t in enumerate(ODD)], "doc_id long, text string, ids array<int>")
    encode = encoder(VOCABULARY).encode_ordinary
    out = {r.doc_id: r.ids for r in token_ids(frame, leaf=64).collect()}
    assert out == {i: encode(t) if t else [] for i, t in enumerate(ODD)}
    counts = {r.doc_id: r.n_tokens for r in token_counts(frame).collect()}
    assert counts == {i: len(ids) for i, ids in out.items()}
    assert token_ids(frame.limit(0)).count() == 0


def slow_sum_of_squares(sizes, capacity):
    levels, out = [], []
    for s in sizes:
        squares = lambda ls: sum(n * n for n in np.bincount([x for x in ls if 0 < x < capacity], minlength=1).tolist())
        options = [(squares([*levels, s]), 0, None)]
        for at, level in enumerate(levels):
            if level + s <= capacity and level:
                options.append((squares([*levels[:at], level + s, *levels[at + 1 :]]), -level, at))
        best = min(options, key=lambda o: o[:2])
        if best[2] is None:
            levels.append(s)
            out.append(len(levels) - 1)
        else:
            levels[best[2]] += s
            out.append(best[2])
    return levels


def test_the_rule_against_its_definition():
    rng = random.Random(9)
    for _ in range(40):
        capacity = rng.randint(3, 20)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 40))]
        placed = sum_of_squares(np.array(sizes), capacity)
        fills = np.bincount(placed, weights=sizes)
        assert sorted(fills) == sorted(slow_sum_of_squares(sizes, capacity)) and fills.max() <= capacity


def test_whole_items_and_pieces():
    assert pieces_of(5, 4) == [4, 1] and pieces_of(8, 4) == [4, 4] and pieces_of(4, 4) == [4] and pieces_of(0, 4) == [0]
    frame = pd.DataFrame({"shard": 0, "item": [1, 2, 3, 3, 4], "n_tokens": [0, 9, 3, 3, 1]})
    out = pack_window(frame, Levels(4))
    assert out.groupby("container").piece_tokens.sum().max() <= 4
    assert sorted(out.piece_tokens) == [0, 1, 1, 3, 3, 4, 4] and out.container.nunique() == 4


def test_packing_is_near_the_bound_and_loses_nothing(spark):
    rng = np.random.default_rng(0)
    sizes = np.minimum(rng.lognormal(5.5, 1.2, 4000).astype(int), 9000)
    frame = spark.createDataFrame([(i, int(s), "clash") for i, s in enumerate(sizes)], "doc_id long, n_tokens long, shard string")
    placed = pack_items(frame)
    report = packing_report(placed).first()
    assert report.tokens == sizes.sum() and report.fullest <= 2048 and report.containers <= 1.02 * report.least_containers
    parts = placed.toPandas().groupby("doc_id").piece_tokens.agg(["sum", "count"])
    assert (parts["sum"].to_numpy() == sizes).all() and (parts["count"].to_numpy() == np.maximum(1, -(-sizes // 2048))).all()


def test_windows_and_partitions_lose_nothing(spark):
    import random

    rng = random.Random(5)
    rows = [(k % 7 if k % 3 else None, rng.choice([0, 5, 700, 1500, 2048, 5000])) for k in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, n_tokens long").repartition(3).cache()
    placed = pack_items(frame, window=64).collect()
    assert sum(r.piece_tokens for r in placed) == sum(n for _, n in rows) and len(placed) == sum(len(pieces_of(n, 2048)) for _, n in rows)
    fills = {}
    for r in placed:
        fills[r.container_id] = fills.get(r.container_id, 0) + r.piece_tokens
    assert max(fills.values()) <= 2048 and len({c >> 40 for c in fills}) == 3
    whole = Levels(2048)
    sizes = [n for _, n in rows if n <= 2048]
    assert [*whole.place(sizes[:100]), *whole.place(sizes[100:])] == list(sum_of_squares(sizes, 2048))


def test_packing_of_nulls_and_nothing(spark):
    frame = spark.createDataFrame([(1, None), (2, -5), (None, 3), (4, 2048)], "doc_id long, n_tokens long")
    assert sorted(r.piece_tokens for r in pack_items(frame).collect()) == [0, 0, 3, 2048]
    empty = packing_report(pack_items(frame.limit(0))).first()
    assert (empty.containers, empty.tokens, empty.unused_share) == (0, 0, 0.0)


def slow_repeated(text):
    words = [w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", text)]
    seen, marked = set(), set()
    for i in range(len(words) - 7):
        run = tuple(words[i : i + 8])
        if run in seen:
            marked |= set(range(i, i + 8))
        seen.add(run)
    return len(words), len(marked)


def test_repeated_words_against_the_definition():
    rng = random.Random(6)
    for _ in range(200):
        text = " ".join(rng.choice(["a", "B", "b", "é", "7"][: rng.randint(1, 5)]) for _ in range(rng.randint(0, 60)))
        assert repeated_words(text) == slow_repeated(text)
    phrase = "One two three, four five six seven eight nine."
    assert repeated_words(phrase + " x " + phrase.upper()) == (19, 9)
    assert repeated_words("İstanbul " * 9) == slow_repeated("İstanbul " * 9)


def test_documents_and_hosts(spark):
    spam = "buy this very cheap thing now from us today " * 20
    rows = [(i, "spam.example", spam) for i in range(6)] + [(10 + i, "good.example", f"page {i} says hello") for i in range(30)] + [(50, None, spam), (51, "x", None), (52, "x", ""), (53, "x", " \n"), (54, "good.example", spam)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, host string, text string, share string")
    judged = judge_repetition(frame).cache()
    out = {r.doc_id: r for r in with_host_verdicts(judged).collect()}
    assert len(out) == len(rows)
    assert sorted(k for k, r in out.items() if r.fails) == [0, 1, 2, 3, 4, 5, 50, 54]
    assert out[51].share is None and not out[52].fails and out[10].share == 0
    hosts = {r.host: r for r in host_rates(judged).collect()}
    assert hosts["spam.example"].bad_host and not hosts["good.example"].bad_host and hosts[None].documents == 1
    assert 1 / 31 < hosts["good.example"].shrunk_rate < 8 / 41 < hosts["spam.example"].shrunk_rate < 1
    assert with_host_verdicts(judge_repetition(frame.limit(0))).count() == 0


@pytest.mark.parametrize("word", ["x" * 200_000, "ab " * 60_000])
def test_very_long_texts(word):
    assert repeated_words(word) == slow_repeated(word)
    encode = encoder(VOCABULARY).encode_ordinary
    if " " in word:
        assert encode_tree(word, encode) == encode(word)
