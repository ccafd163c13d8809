"""Near-duplicate groups against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from meshloom.llm import graph, neardup


def shingles(text, size=4):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows):
    """Smallest id reachable over links of 0.8 and more, by repeated relabelling."""
    sets = [(d, shingles(t)) for d, t, *_ in rows]
    label = {d: d for d, _ in sets if d is not None}
    links = [
        (a, b)
        for i, (a, x) in enumerate(sets)
        for b, y in sets[i + 1 :]
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y)
    ]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sorted(((d, len(s), label.get(d), d is None or label[d] == d) for d, s in sets), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def family(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_against_all_pairs(spark, docs):
    rng = random.Random(5)
    rows = []
    for group in range(8):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 40, 120]))]
        for _ in range(12):
            rows.append((len(rows) * 7 % 1009, family(rng, base, rng.randrange(4)), "en", "s"))
    rows += [(2000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(30)), "en", "s") for i in range(20)]
    rng.shuffle(rows)
    assert result(neardup.near_duplicates(docs(rows).repartition(4))) == brute(rows)


@pytest.mark.parametrize("block", [7, 2048])
def test_barely_similar_group(spark, docs, monkeypatch, block):
    """A large group of copies that are barely similar to each other, in one block and in many."""
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", block)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, family(rng, base, rng.choice([1, 2, 3, 4, 5])), "en", "s") for i in range(90)]
    assert result(neardup.near_duplicates(docs(rows).repartition(3))) == brute(rows)


def test_awkward_rows(spark, docs, awkward):
    assert result(neardup.near_duplicates(docs(awkward).withColumns({"rep": F.lit(1), "key": F.lit("x")}))) == brute(awkward)
    assert neardup.near_duplicates(docs([])).isEmpty()


def test_one_id_over_two_classes(spark, docs):
    """Id 1 is the smallest of two classes of unlike texts; near copies of each link with it."""
    rng = random.Random(3)
    first, second = ([f"{c}{i}" for i in range(80)] for c in "ab")
    rows = [(1, " ".join(first), "en", "s"), (1, " ".join(second), "en", "s"), (5, " ".join(first), "en", "s"), (6, " ".join(second), "en", "s")]
    rows += [(7 + i, family(rng, (first, second)[i % 2], 1), "en", "s") for i in range(8)]
    assert {r[2] for r in result(neardup.near_duplicates(docs(rows)))} == {1}


def test_guaranteed_distance():
    """Any two signatures that differ in 15 symbols share a chunk with at most one error."""
    rng = random.Random(1)
    for _ in range(2000):
        wrong = rng.sample(range(neardup.INDEXED), 2 * neardup.CHUNKS - 1)
        errors = [sum(w // neardup.CHUNK_SYMBOLS == c for w in wrong) for c in range(neardup.CHUNKS)]
        assert min(errors) <= 1


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (200, 200)], "a long, b long")
    want = {i: 0 for i in range(31)} | {50: 50, 70: 50, 100: 50}
    assert {r["node"]: r["component"] for r in graph.components(edges).collect()} == want
