"""Benchmark search next to a plain search for every window."""

import random
import re

from meshloom.llm import benchmatch

COLUMNS = ("n_words", "hit_spans", "items")


def words_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def plain(docs, items, width):
    out = []
    for doc_id, text in docs:
        w, hit, names = words_of(text), set(), set()
        for name, item in items:
            b = words_of(item)
            m = min(width, len(b))
            windows = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if m else set()
            for i in range(len(w) - m + 1 if m else 0):
                if tuple(w[i : i + m]) in windows:
                    hit.update(range(i, i + m))
                    names.add("" if name is None else str(name))
        out.append((doc_id, len(w), len(hit), sorted(names)))
    return sorted(out, key=repr)


def found(docs, items, width, **more):
    rows = benchmatch.find_items(docs, items, width, **more).collect()
    return sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["hit_spans"]), list(r["items"])) for r in rows), key=repr)


def test_against_all_windows(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "dé", "e5"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(0, 12))) for i in range(30)] + [(7, text(9)), (None, text(6)), (99, None)]
    docs = [(i, text(rng.randint(0, 60)) + rng.choice(["", "\n", ", "]) + rng.choice(items[:30])[1].upper() if i % 3 else text(40)) for i in range(60)]
    docs += [(None, None), (None, items[3][1]), (3, ""), (3, items[4][1])]
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    for width in (1, 2, 4, 6):
        assert found(left, right, width) == plain(docs, items, width)


def test_blocks_and_pieces_change_nothing(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randint(0, 40)}" for _ in range(n))
    items = [(i, text(rng.randint(1, 90))) for i in range(25)]
    docs = [(i, f"{text(30)} {' '.join(items[i % 25][1].split()[3:40])} {text(20)} {items[(i * 7) % 25][1]}") for i in range(40)]
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items, 10)
    assert any(names for *_, names in want)
    assert found(left, right, 10, block_bytes=900, piece_words=7) == want
    assert found(left, right, 10) == want


def test_long_texts_clashing_columns_and_empty_tables(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten"
    long = "filler words here " * 3000 + item + " and " + item.upper()
    docs = spark.createDataFrame([(1, long, 5, "x"), (2, "no", 6, "y")], "doc_id long, text string, n_words int, items string")
    items = spark.createDataFrame([("q", item, 1), ("short", "eight nine", 2)], "item_id string, text string, block int")
    monkeypatch.setattr(benchmatch, "SLICE_BYTES", 64)
    assert len(benchmatch.word_numbers(long, {}.get)) == 9021
    got = {r["doc_id"]: r for r in benchmatch.find_items(docs, items).collect()}
    assert [tuple(s) for s in got[1]["hit_spans"]] == [(9000, 9010), (9011, 9021)] and got[1]["items"] == ["q", "short"]
    assert got[2]["n_words"] == 1 and got[2]["items"] == []
    nothing = benchmatch.find_items(docs, items.filter("false"))
    assert [list(r["items"]) for r in nothing.collect()] == [[], []]
    assert benchmatch.find_items(docs.filter("false"), items).isEmpty()
    assert set(COLUMNS) <= set(nothing.columns) and len(nothing.columns) == 5


def test_awkward_rows(docs, awkward, spark):
    items = spark.createDataFrame([(1, "One, TWO. three"), (2, "\U0001f600")], "item_id long, text string")
    rows = benchmatch.find_items(docs(awkward), items).collect()
    assert len(rows) == len(awkward)
    hits = sorted((r["doc_id"], list(r["items"])) for r in rows if r["items"])
    assert hits == [(5, ["1"]), (6, ["1"]), (6, ["1"])]
