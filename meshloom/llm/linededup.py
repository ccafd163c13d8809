"""Dropping lines that many documents share, with two Bloom filters before any exact count.

1. Every task hashes its distinct line keys; a hash that a batch holds twice or more is sent
   as "twice". Only hashes move, to the shard that their low bits name.
2. A shard streams its hashes through a once-seen filter; what it sees again, or is told was
   seen twice, enters its twice-seen filter. The once-seen filters never leave their shards.
   The twice-seen filters together have a fixed size bound (`FILTER_BYTES`), whatever the
   input, so they are broadcast; more repeats only mean more false suspects.
3. Only suspected lines are emitted with their whole key, counted exactly and joined back.

A line's key is the line without the six ASCII white-space characters at its ends and with
A-Z in lower case. Keys of at least `min_chars` code points in at least `min_docs` documents
are confirmed; their lines go everywhere, or, with `keep_first`, all but the first line of
the first document (smallest id, nulls last) stay out. A row is a document: repeated rows
count as often as they appear, but all rows of one id lose the same lines. A null text stays
null and counts as one empty line. Columns named like an added one are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.shared import cut_lineage, table

SPACE = b" \t\n\x0b\x0c\r"
MIN_DOCS = 10
MIN_CHARS = 1
# Bound of all twice-seen filters together, and the hashes and bits of a shard.
FILTER_BYTES = 64 << 20
SHARD_LINES = 1 << 17
SHARD_BITS = 1 << 21
PROBES = 4


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> dict[bytes, int]:
    """The distinct keys of a text that are long enough, with their first line."""
    keys: dict[bytes, int] = {}
    for at, line in enumerate((text or "").encode().split(b"\n")):
        key = line.strip(SPACE).lower()
        if key and (min_chars <= 1 or len(key.decode()) >= min_chars):
            keys.setdefault(key, at)
    return keys


def hashes_of(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES places per hash below the power of two ``bits``."""
    step = (hashes * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes >> np.uint64(29))
    nth = np.arange(PROBES, dtype=np.uint64)
    return (((hashes >> np.uint64(20))[:, None] + nth * ((step >> np.uint64(24)) | np.uint64(1))[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def _line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    def scan(batches):
        for batch in batches:
            found = [hashes_of(line_keys(t, min_chars)) for t in batch.column(0).to_pylist()]
            hashes, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts > 1)], names=["hash", "twice"])

    return docs.select("text").mapInArrow(scan, "hash long, twice boolean")


def twice_seen(docs: DataFrame, min_chars: int = MIN_CHARS) -> tuple[np.ndarray, int]:
    """The twice-seen filters, one row of packed bits per shard, and the bits of each."""
    breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1
    lines = docs.agg(F.sum(breaks)).first()[0] or 0
    shards = 1
    while shards * SHARD_LINES < lines:
        shards *= 2
    bits = SHARD_BITS
    while shards * bits > FILTER_BYTES * 8 and bits > 8:
        bits //= 2
    hashes = _line_hashes(docs, min_chars).withColumn("shard", F.expr(f"hash & {shards - 1}L"))

    def fill(batches):
        once: dict[int, np.ndarray] = {}
        again: dict[int, np.ndarray] = {}
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            twice, shard = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            for s in np.unique(shard).tolist():
                here = shard == s
                values, first, counts = np.unique(hashes[here], return_index=True, return_counts=True)
                if s not in once:
                    once[s], again[s] = np.zeros(SHARD_BITS, bool), np.zeros(bits, bool)
                told = np.zeros(len(values), bool)
                told[np.searchsorted(values, hashes[here][twice[here]])] = True
                at = probes(values, SHARD_BITS)
                repeated = told | (counts > 1) | once[s][at].all(axis=1)
                once[s][at] = True
                again[s][probes(values[repeated], bits)] = True
        names = list(again)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array([np.packbits(again[s]).tobytes() for s in names], pa.binary())],
            names=["shard", "bits"],
        )

    filters = np.zeros((shards, max(1, bits // 8)), np.uint8)
    # At most FILTER_BYTES in all.
    for row in hashes.repartition(min(shards, 1 << 16), "shard").mapInArrow(fill, "shard long, bits binary").toLocalIterator():
        filters[row["shard"]] |= np.frombuffer(row["bits"], np.uint8)
    return filters, bits


def suspected_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, key, line: the distinct keys of each document that may be repeated, with their first line."""
    filters, bits = twice_seen(docs, min_chars)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def scan(batches):
        filters = shared.value
        for batch in batches:
            docs_at, kept, lines = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                keys = line_keys(text, min_chars)
                if not keys:
                    continue
                hashes = hashes_of(keys)
                at = probes(hashes, bits)
                shard = (hashes & np.uint64(len(filters) - 1)).astype(np.int64)
                hit = ((filters[shard[:, None], at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
                for (key, line), suspect in zip(keys.items(), hit.tolist()):
                    if suspect:
                        docs_at.append(i)
                        kept.append(key.decode())
                        lines.append(line)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(docs_at, pa.int64())), pa.array(kept, pa.string()), pa.array(lines, pa.int64())],
                names=["doc_id", "key", "line"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, key string, line long")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """``docs`` with shared lines taken out of text, plus n_lines (before) and n_dropped."""
    suspects = cut_lineage(suspected_lines(docs, min_chars))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line")).alias("first")
    confirmed = suspects.groupBy("key").agg(F.count(F.lit(1)).alias("_docs"), first).filter(F.col("_docs") >= min_docs)
    hits = suspects.join(confirmed, "key")
    stays = F.when(F.lit(keep_first) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")), F.col("first.line"))
    drops = hits.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("key").alias("_keys"), F.collect_list(stays).alias("_stays"))
    plain = docs.drop("n_lines", "n_dropped")
    joined = plain.join(drops, plain["doc_id"].eqNullSafe(drops["_id"]), "left").drop("_id")
    names = plain.columns
    text_at, keys_at, stays_at = names.index("text"), len(names), len(names) + 1

    def drop(batches):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, keys, stays in zip(*(batch.column(i).to_pylist() for i in (text_at, keys_at, stays_at))):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                kept = lines
                if keys:
                    out, keep = {k.encode() for k in keys}, set(stays)
                    kept = [x for i, x in enumerate(lines) if i in keep or x.encode().strip(SPACE).lower() not in out]
                n_dropped.append(len(lines) - len(kept))
                texts.append(text if len(kept) == len(lines) else "\n".join(kept))
            columns = batch.columns[:keys_at]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    schema = plain.withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema
    return joined.mapInArrow(drop, schema)


def op8_line_dedup(spark, sf_dir):
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), c AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), m AS (
  SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
