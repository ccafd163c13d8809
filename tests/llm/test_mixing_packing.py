"""Source mixing and token packing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meshloom.llm import mixing, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def water_level(sizes, weights):
    """Targets by resharing what stands above twice a source's size, one round after the other."""
    total, capped = 1.5 * sum(sizes), set()
    while True:
        rest = total - sum(2 * sizes[i] for i in capped)
        open_ = sum(w for i, w in enumerate(weights) if i not in capped)
        target = [2.0 * s if i in capped else (rest * weights[i] / open_ if open_ else 0.0) for i, s in enumerate(sizes)]
        above = {i for i, s in enumerate(sizes) if target[i] > 2 * s} - capped
        if not above:
            return target
        capped |= above


def test_targets_and_totals(spark):
    rng = random.Random(2)
    rows = [(i, f"s{rng.choice([0, 0, 0, 1, 2, 3, 4])}", rng.randint(1, 300)) for i in range(6000)] + [(7000 + i, None, 10) for i in range(500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(3)).collect()
    names = [f"s{i}" for i in range(5)] + [None]
    sizes = [sum(s for _, n, s in rows if n == name) for name in names]
    want = water_level(sizes, [3, 1, 2, 3, 1, 2])
    for name, size, target in zip(names, sizes, want):
        mine = [r for r in got if r["source"] == name]
        assert mine[0]["source_size"] == size and mine[0]["target"] == pytest.approx(target)
        assert sum(r["copies"] * r["size"] for r in mine) == pytest.approx(target, rel=0.03)
    assert all(0 <= r["copies"] <= 2 for r in got) and len(got) == len(rows)
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, source string, size long")).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in again) == sorted((r["doc_id"], r["copies"]) for r in got)


def test_mixing_awkward_rows(spark, docs, awkward):
    sized = docs(awkward).withColumns({"size": mixing.text_size(F.col("text")), "target": F.lit("mine"), "_cell": F.lit(1)})
    got = mixing.mix(sized).collect()
    assert len(got) == len(awkward)
    assert {r["doc_id"]: r["size"] for r in got}[4] == 20000
    assert mixing.mix(docs([]).withColumn("size", F.lit(0).cast("long"))).isEmpty()
    nothing = mixing.mix(docs(["", None]).withColumn("size", F.lit(0).cast("long"))).collect()
    assert [r["target"] for r in nothing] == [0.0, 0.0]


def whole(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_pieces_encode_like_the_tokenizer():
    texts = ["", " ", "a", " a  b", "tail ", "line\n end\n", "a\x1cb  !\x1c! x", " \n\n a  b\n \n", "x\u00a0 \u3000 y  ", "don't we'll 's  's", "\t\tq\r\n"]
    texts += ["x <|endoftext|> y", "\u00e9 \u65e5\u672c \u8a9e \U0001f600 ok", "a" * 3000, "x   y\x85 z", "1234 5678 !! ,,", "  lead", "\n \n"]
    assert [x.tolist() for x in packing.PieceEncoder(PATH).encode(texts)] == whole(texts)


def test_packing_round_trip(spark, docs, awkward):
    rows = awkward + [(50 + i, f"text number {i} " * (i * 5), "en", "a") for i in range(60)]
    got = packing.pack(docs(rows).withColumn("part", F.lit("mine")).repartition(4), PATH).collect()
    stream = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in stream:
        assert r["sequence_id"] * 1024 + r["offset"] == at and r["length"] * 4 == len(r["ids"])
        at += r["length"]
    want = sorted(((d, tuple([*ids, 0])) for (d, *_), ids in zip(rows, whole([t for _, t, *_ in rows]))), key=repr)
    assert at == sum(len(ids) for _, ids in want)
    docs_back, open_ = [], []
    for r in stream:
        open_.extend(np.frombuffer(r["ids"], "<u4").tolist())
        if r["start"] + r["length"] == r["doc_tokens"]:
            docs_back.append((r["doc_id"], tuple(open_)))
            open_ = []
    assert sorted(docs_back, key=repr) == want
    assert packing.pack(docs([]), PATH).isEmpty()


def test_sequences_and_padding(spark, docs):
    pieces = packing.pack(docs([f"some words {i} " * 90 for i in range(9)]), PATH)
    full = packing.sequences(pieces).orderBy("sequence_id").collect()
    assert all(r["length"] == r["padded"] == 1024 for r in full[:-1])
    last = full[-1]
    assert last["padded"] & (last["padded"] - 1) == 0 and last["padded"] // 2 < last["length"] <= last["padded"]
    joined = b"".join(r["tokens"] for r in full)
    assert zlib.crc32(joined) == zlib.crc32(b"".join(r["ids"] for r in sorted(pieces.collect(), key=lambda r: (r["sequence_id"], r["offset"]))))
