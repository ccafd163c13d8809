"""Exact search and chat formatting."""

import math
import random

from pyspark.sql import functions as F

from meshloom.llm import chat, topk


def test_search_against_all_scores(spark):
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, list(rows[5][1])) for i in range(60)]
    rows += [(900, None), (901, [1.0, None] + [0.0] * 4), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (None, [0.5] * 6), (904, [3.0])]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5))
    good = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and i < 900 or i == 904}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {(q, n + 1, c, s) for q in good if q % 50 == 0 for n, (s, c) in enumerate(sorted(((dot(good[q], v), c) for c, v in good.items() if c != q), key=lambda x: (-x[0], x[1]))[:10])}
    got = topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors, tile_rows=3, shard_rows=40)
    assert {tuple(r) for r in got.collect()} == want


def test_search_on_few_and_large_numbers(spark):
    large = spark.createDataFrame([(0, [2**30, 3]), (100, [2**30 - 1, 5]), (7, [-(2**30), 1])], "vec_id long, v array<long>")
    got = topk.top_k(large.filter("vec_id = 0"), large).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(100, 2**30 * (2**30 - 1) + 15), (7, -(2**60) + 3)]
    assert topk.top_k(large.filter("false"), large).isEmpty() and topk.top_k(large, large.filter("false")).isEmpty()


def messages(spark, rows):
    return spark.createDataFrame(rows, "tree_id long, message_id long, parent_id long, role string, text string, score double")


def back(done):
    rows = done.select("tree_id", "leaf", "formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("turns")).collect()
    return {(r["tree_id"], r["leaf"]): ([tuple(t) for t in r["turns"]], [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]]) for r in rows}


def test_branches_of_a_tree(spark):
    rows = [
        (1, 10, None, "user", "q", 0.0),
        (1, 11, 10, "assistant", "weak", 0.1),
        (1, 12, 10, "assistant", "good", 0.9),
        (1, 13, 12, "user", "more", 0.0),
        (1, 14, 13, "assistant", "end", 0.2),
        (1, 15, 12, "user", "other", -0.5),
        (2, 20, 99, "user", None, None),
        (3, 30, 31, "user", "loop", 1.0),
        (3, 31, 30, "user", "loop", 1.0),
    ]
    every = back(chat.format_branches(messages(spark, rows), top=None))
    assert set(every) == {(1, 11), (1, 14), (1, 15), (2, 20)}
    assert every[1, 14] == ([("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "end")], ["good", "end"])
    assert every[2, 20] == ([("user", "")], [])
    assert set(back(chat.format_branches(messages(spark, rows), top=1))) == {(1, 14), (2, 20)}
    assert chat.format_branches(messages(spark, []), top=1).isEmpty()


def test_long_threads_and_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\</s>", "[\\INST]", "<s", "s>", "", "[INST[INST]]", "a\\[/INST]\n", "\U0001f600é"]
    rows = [(5, i, i - 1 if i else None, ["user", "assistant", "</s>", None][i % 4], texts[i % 10], 0.0) for i in range(70)]
    turns, loss = back(chat.format_branches(messages(spark, rows)))[5, 69]
    assert turns == [(r[3] or "", r[4]) for r in rows]
    plain = spark.createDataFrame([(x,) for x in loss], "x string").select(chat.unescape(F.col("x"))).collect()
    assert [r[0] for r in plain] == [r[4] for r in rows if r[3] == "assistant"]


def test_threads_with_ties_and_nulls(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "assistant", None), (None, 0, None, "x")]
    made = chat.thread_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["tree_id"]: r["n_turns"] for r in chat.format_branches(made).collect()}
    assert got == {1: 3, None: 1}
