"""Suffix arrays and repeated bytes against direct comparison."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.llm import suffixes


def brute(rows, n):
    data = [(d, (t or "").encode()) for d, t, *_ in rows]
    found = Counter(b[i : i + n] for _, b in data for i in range(len(b) - n + 1))
    out = []
    for d, b in data:
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if found[b[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["first"])
    rows = df.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect()
    return sorted(map(tuple, rows), key=repr)


def test_suffix_array_is_sorted():
    rng = random.Random(3)
    for _ in range(150):
        text = [rng.randint(1, rng.randint(1, 3)) for _ in range(rng.randint(1, 60))] + [0]
        want = sorted(range(len(text) - 1), key=lambda i: text[i:])
        assert suffixes.suffix_array(np.array(text, np.int16)).tolist() == want


def test_starts_of_repeats():
    rng = random.Random(4)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 60))) for _ in range(40)] + [b"a" * 32] * 2
    begin, _, several = suffixes.repeated_starts(parts, 12)
    found = Counter(p[i : i + 12] for p in parts for i in range(len(p) - 11))
    for at, p in zip(begin, parts):
        assert [bool(several[at + i]) for i in range(len(p) - 11)] == [found[p[i : i + 12]] > 1 for i in range(len(p) - 11)]


@pytest.mark.parametrize("shard_runs", [3, 2_000])
def test_against_counts(spark, docs, monkeypatch, shard_runs):
    """With 3 runs a shard every shared passage is spread over several shards."""
    monkeypatch.setattr(suffixes, "SHARD_RUNS", shard_runs)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, short = prose(90), prose(60)[:399]
    rows = [(i, prose(40) + passage + prose(40) if i % 3 else prose(60) + short, "en", "s") for i in range(24)]
    rows += [(100, rows[1][1], "en", "s"), (101, "z" * 900, "en", "s"), (102, prose(150) * 2, "en", "s"), (103, passage[:-1] + "!", "en", "s")]
    assert result(suffixes.remove_repeats(docs(rows).repartition(5))) == brute(rows, 400)


def test_awkward_rows(spark, docs, awkward):
    rows = [r for r in awkward if r[0] != 4] + [(4, "lorem ipsum dolor sit amet " * 60, "en", "b")]
    named = docs(rows).withColumns({"rid": F.lit("mine"), "first": F.lit(0)})
    assert result(suffixes.remove_repeats(named)) == brute(rows, 400)
    assert suffixes.remove_repeats(docs([])).isEmpty()


@pytest.mark.parametrize("bits", [9, 10, 13])
def test_anchors_do_not_depend_on_place_bits(monkeypatch, bits):
    rng = random.Random(11)
    data = np.frombuffer(rng.randbytes(20_000) + b"ab" * 4_000 + rng.randbytes(9_000), np.uint8)
    ends = np.array([300, 21_000, 27_000, len(data)])
    whole = suffixes.anchor_runs(data, ends)
    monkeypatch.setattr(suffixes, "PLACE_BITS", bits)
    for a, b in zip(suffixes.anchor_runs(data, ends), whole):
        assert a.tolist() == b.tolist()


def test_repeat_past_16_mib_of_a_document(spark, docs):
    rng = random.Random(12)
    head, passage = rng.randbytes(8_450_000).hex(), rng.randbytes(300).hex()
    rows = docs([(1, head + "<" + passage + ">", "en", "s"), (2, "(" + passage + ")", "en", "s")])
    got = {r["doc_id"]: [(s["first"], s["end"]) for s in r["spans"]] for r in suffixes.remove_repeats(rows).collect()}
    assert got == {1: [(len(head) + 1, len(head) + 601)], 2: [(1, 601)]}


def test_query_tells_documents_with_repeats(spark, docs, tmp_path):
    """Planted passages of over 50 words are repeats from 400 bytes on, and not before; sizes of documents don't matter."""
    rng = random.Random(13)
    prose = lambda n, size: " ".join("".join(rng.choices("abcdefghij", k=size)) for _ in range(n))
    long, short = [prose(52, 8) for _ in range(10)], [prose(52, 6)[:399] for _ in range(10)]
    rows = [(i, f"{prose(rng.randint(5, 300), 7)} <{long[i // 3]}> {prose(20, 7)}", "en", "s") for i in range(30)]
    rows += [(100 + i, f"{prose(rng.randint(5, 300), 7)}{i}-{short[i // 3]}-{i}{prose(20, 7)}", "en", "s") for i in range(30)]
    rows += [(200 + i, prose(rng.randint(5, 600), 7), "en", "s") for i in range(30)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in suffixes.op9_suffix_dedup(spark, str(tmp_path)).collect()}
    assert {i for i, r in got.items() if r["has_repeats"]} == set(range(30)) and len(got) == 90
    assert all(r["has_repeats"] == (r["n_removed"] > 0) for r in got.values())
