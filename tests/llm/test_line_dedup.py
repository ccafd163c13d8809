"""Line dedup against a dictionary count."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from meshloom.llm import linededup

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, least):
    found = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if found[key(x)] < least]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", digest).collect()), key=repr)


def test_against_counts(spark, docs):
    rows = [(i, "\n".join([f"own {i}", " Shared Line\t" if i % 2 else "shared line", f"pair {i // 2}", ""]), "en", "s") for i in range(40)]
    assert result(linededup.dedup_lines(docs(rows).repartition(5), 20)) == brute(rows, 20)
    assert result(linededup.dedup_lines(docs(rows).repartition(5), 2)) == brute(rows, 2)


def test_awkward_rows(spark, docs, awkward):
    assert result(linededup.dedup_lines(docs(awkward), 2)) == brute(awkward, 2)
    named = docs(awkward).withColumns({"key": F.lit("k"), "line": F.lit(1), "n_lines": F.lit("mine")})
    assert result(linededup.dedup_lines(named, 2)) == brute(awkward, 2)
    assert linededup.dedup_lines(docs([])).isEmpty()


def test_keep_first(spark, docs):
    got = linededup.dedup_lines(docs(["x\nu0", "u1\nx\nx", "x"]), 3, keep_first=True).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["x\nu0", "u1", ""]


def test_few_filter_bits_only_cost_suspects(spark, docs, monkeypatch):
    """A filter that is far too small still gives the same lines."""
    monkeypatch.setattr(linededup, "FILTER_BYTES", 1)
    rows = [(i, f"own {i}\nshared", "en", "s") for i in range(30)]
    assert result(linededup.dedup_lines(docs(rows), 10)) == brute(rows, 10)
