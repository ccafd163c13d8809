"""Near-duplicate documents: b-bit minwise signatures, a multi-index Hamming join, exact links.

A document's set holds the 64-bit hashes of its distinct word shingles. Equal sets are one
class with a number and one document that stands for it; only classes are compared.

* Signature: the low 16 bits of 64 minwise hashes, one symbol each.
* Multi-index join: the first 32 symbols are split into 8 chunks of 4. Two signatures that
  differ in at most 8 * 2 - 1 = 15 of these have, by pigeonhole, a chunk that differs in at
  most one. The allowed chunk errors are enumerated: a chunk yields four keys, each with one
  symbol masked, so that every pair under that distance shares a key. (At similarity 0.8 a
  pair differs in 6.4 symbols on average and shares no key once in a million.) Of pairs that
  share a key, those that differ in more than 31 of all 64 symbols are passed over.
* Links without pair lists: a key's members are compared with its hub, the member with the
  most company over all its keys, and confirmed on full sets. Where a key's members are in
  several components after that, those outside the largest are compared with all others,
  block against block inside tasks; pairs within a component need no comparison, and only
  pairs that look linked become rows and are confirmed. So no link between two components is lost, and a group
  of thousands of near copies costs one row per member.

Texts without words have an empty set and link with nothing. Rows without an id take part in
nothing: their component is null and they are kept. Repeated rows share a class; different
texts under one id count as linked. An empty table gives an empty result. Only doc_id and
text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.graph import components
from meshloom.llm.shared import cut_lineage, numbered, table

SHINGLE_WORDS = 4
SIMILAR = (80, 100)
CHUNKS, CHUNK_SYMBOLS = 8, 4
INDEXED = CHUNKS * CHUNK_SYMBOLS
# Symbols of a signature; the first INDEXED make the keys, all of them the distance.
SYMBOLS = 64
# Signatures further apart are not confirmed; at similarity 0.8 less than one pair in a million is.
MOST_DIFFERENT = 31
# Members of a block where a key's members are compared with each other.
BLOCK_MEMBERS = 2048
SLICE_CHARS = 1_000_000
CACHED_WORDS = 1_000_000

_RANDOM = np.random.default_rng(20240229)
_ODD = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _RANDOM.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 2**63, SYMBOLS, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, kept for the words of a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_sets(texts: list[str | None], size: int, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted sets of all texts, one after the other, and their lengths."""
    split = [(t or "").encode().lower().split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    words = np.fromiter((cache[w] for s in split for w in s), np.uint64, int(n.sum()))
    first = np.cumsum(n) - n
    whole = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for i in range(size):
        whole += words[i : len(words) - size + 1 + i] * _ODD[i]
    whole = mix64(whole)
    sets = []
    for a, m in zip(first.tolist(), n.tolist()):
        if m >= size:
            sets.append(np.unique(whole[a : a + m - size + 1]))
        elif m:
            sets.append(mix64((words[a : a + m] * _ODD[:m]).sum(keepdims=True, dtype=np.uint64) + np.uint64(m)))
        else:
            sets.append(np.zeros(0, np.uint64))
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), lengths


def signatures(sets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """SYMBOLS minwise symbols of 16 bits per set; zeros for an empty one."""
    out = np.zeros((len(lengths), SYMBOLS), np.uint16)
    filled = np.flatnonzero(lengths)
    starts = (np.cumsum(lengths) - lengths)[filled]
    if len(filled):
        for k in range(SYMBOLS):
            least = np.minimum.reduceat(sets * _TIMES[k] + _PLUS[k], starts)
            out[filled, k] = (mix64(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def digests(sets: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent sums over each set; equal sets have equal sums."""
    ends = np.cumsum(lengths)
    totals = []
    for value in (mix64(sets + _ODD[50]), mix64(sets ^ _ODD[51])):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        totals.append((running[ends] - running[ends - lengths]).view(np.int64))
    return totals[0], totals[1]


def _slices(texts):
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_CHARS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def document_signatures(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digests of the set) and signature per row."""

    def scan(batches):
        cache = WordHashes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                sets, lengths = shingle_sets(texts[a:b], size, cache)
                d1, d2 = digests(sets, lengths)
                symbols = [row.tobytes() for row in signatures(sets, lengths).astype("<u2")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(lengths), pa.array(d1), pa.array(d2), pa.array(symbols, pa.binary())],
                    names=["doc_id", "n_shingles", "d1", "d2", "signature"],
                )

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_shingles long, d1 long, d2 long, signature binary")


def chunk_keys(classes: DataFrame) -> DataFrame:
    """key, rep, n: every chunk of a signature with one symbol masked."""

    def emit(batches):
        for batch in batches:
            rows = batch.num_rows
            symbols = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(rows, SYMBOLS)
            symbols = symbols[:, :INDEXED].reshape(rows, CHUNKS, CHUNK_SYMBOLS).astype(np.uint64)
            keys = np.empty((rows, INDEXED), np.uint64)
            for c in range(CHUNKS):
                for masked in range(CHUNK_SYMBOLS):
                    key = np.full(rows, c * CHUNK_SYMBOLS + masked, np.uint64)
                    for s in range(CHUNK_SYMBOLS):
                        if s != masked:
                            key = (key << np.uint64(16)) | symbols[:, c, s]
                    keys[:, c * CHUNK_SYMBOLS + masked] = key
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64))] + [pa.array(np.repeat(batch.column(i).to_numpy(), INDEXED)) for i in (0, 1)],
                names=["key", "rep", "n"],
            )

    return classes.select("rep", "n", "signature").mapInArrow(emit, "key long, rep long, n long")


def _close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most MOST_DIFFERENT symbols."""
    signed = classes.select("rep", "signature")
    both = pairs.join(signed.toDF("a", "sa"), "a").join(signed.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def near(batches):
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, SYMBOLS) for i in (2, 3))
            keep = pa.array((sa != sb).sum(axis=1) <= MOST_DIFFERENT)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(near, "a long, b long")


def _close_in_blocks(there: DataFrame, classes: DataFrame, docs: DataFrame, size: int, similar) -> DataFrame:
    """Pairs (a, b) of different components, among the members of each key of ``there``, that look linked.

    Members outside the key's main component, in blocks, meet all members, in blocks; every
    pair of blocks is one row with its members' signatures and folded sets. A pair is looked
    at under the first key that it shares, and leaves the task only if its folded sets are
    similar enough, a little less at most. A key of any size is spread over as many rows as
    it has pairs of blocks.
    """
    least, of = similar
    outside = F.col("component") != F.col("main")
    sizes = there.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.count_if(outside).alias("outside"))
    blocks = lambda c: F.ceil(F.col(c) / F.lit(BLOCK_MEMBERS)).cast("int")
    sizes = sizes.select("key", blocks("members").alias("columns"), blocks("outside").alias("rows"))
    sets = _sets(there.select("rep").distinct(), classes, docs, size, folded=True)
    known = classes.select("rep", "signature").join(sets, "rep")
    dealt = there.join(sizes, "key").join(known, "rep").withColumn("hash", F.xxhash64("rep"))
    entry = F.struct("rep", "n", "component", outside.cast("int").alias("outside"), "signature", "set").alias("entry")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    x = dealt.filter(outside).select("key", F.pmod("hash", "rows").cast("int").alias("row"), upto("columns").alias("column"), F.lit(True).alias("x"), entry)
    y = dealt.select("key", F.pmod("hash", "columns").cast("int").alias("column"), upto("rows").alias("row"), F.lit(False).alias("x"), entry)
    tiles = x.unionByName(y).groupBy("key", "row", "column")
    tiles = tiles.agg(F.collect_list(F.when(F.col("x"), F.col("entry"))).alias("xs"), F.collect_list(F.when(~F.col("x"), F.col("entry"))).alias("ys"))

    def parts(lists):
        flat = lists.flatten()
        rep, n, component, out = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        signature = np.frombuffer(b"".join(flat.field(4).to_pylist()), "<u2").reshape(-1, SYMBOLS)
        return np.r_[0, np.cumsum(np.diff(lists.offsets.to_numpy()))], rep, n, component, out == 1, signature, flat.field(5)

    def first_keys(equal: np.ndarray) -> np.ndarray:
        """The number of the first key that rows of equal symbols stand for."""
        chunks = equal[:, :INDEXED].reshape(-1, CHUNKS, CHUNK_SYMBOLS)
        chunk = (chunks.sum(axis=2) >= CHUNK_SYMBOLS - 1).argmax(axis=1)
        own = chunks[np.arange(len(chunks)), chunk]
        return chunk * CHUNK_SYMBOLS + np.where(own.all(axis=1), 0, own.argmin(axis=1))

    def compare(batches):
        for batch in batches:
            number = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(16 * (CHUNK_SYMBOLS - 1))
            (x_at, xr, xn, xc, _, xs, x_sets), (y_at, yr, yn, yc, y_out, ys, y_sets) = parts(batch.column(3)), parts(batch.column(4))
            found = [], []
            for tile in range(batch.num_rows):
                high = slice(y_at[tile], y_at[tile + 1])
                for low in range(x_at[tile], x_at[tile + 1]):
                    fits = (yc[high] != xc[low]) & (of * yn[high] >= least * xn[low]) & (of * xn[low] >= least * yn[high])
                    # Of two members outside, the pair comes up twice.
                    some = np.flatnonzero(fits & (~y_out[high] | (xr[low] < yr[high]))) + y_at[tile]
                    equal = ys[some] == xs[low]
                    near = equal.sum(axis=1) >= SYMBOLS - MOST_DIFFERENT
                    some, equal = some[near], equal[near]
                    if not len(some):
                        continue
                    some = some[first_keys(equal) == number[tile]]
                    own = np.frombuffer(x_sets[low].as_py(), np.uint32)
                    for at in some.tolist():
                        other = np.frombuffer(y_sets[at].as_py(), np.uint32)
                        common = len(np.intersect1d(own, other, assume_unique=True))
                        # Folding makes a few hashes of a long set equal.
                        common += 2 + (len(own) + len(other)) // 512
                        if of * common >= least * (xn[low] + yn[at] - common):
                            found[0].append(min(xr[low], yr[at]))
                            found[1].append(max(xr[low], yr[at]))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(f, np.int64)) for f in found], names=["a", "b"])

    return cut_lineage(tiles.mapInArrow(compare, "a long, b long").distinct(), frees=[sets])


def _sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, size: int, folded: bool = False) -> DataFrame:
    """rep and set (64-bit hashes, or their sorted low 32 bits as bytes) of the wanted classes."""
    wanted = classes.select("rep", "doc", "d1", "d2").join(wanted, "rep")
    texts = wanted.join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc").select("rep", "text", "d1", "d2")

    def build(batches):
        cache = WordHashes()
        for batch in batches:
            reps, texts = batch.column(0), batch.column(1).to_pylist()
            w1, w2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for a, b in _slices(texts):
                sets, lengths = shingle_sets(texts[a:b], size, cache)
                d1, d2 = digests(sets, lengths)
                # An id may stand over several texts; only the class's own one counts.
                keep = pa.array((d1 == w1[a:b]) & (d2 == w2[a:b]))
                ends = np.cumsum(lengths)
                if folded:
                    lists = pa.array([np.unique(sets[e - n : e].astype(np.uint32)).tobytes() for e, n in zip(ends, lengths)], pa.binary())
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([reps.slice(a, b - a).filter(keep), lists.filter(keep)], names=["rep", "set"])

    kind = "binary" if folded else "array<long>"
    return cut_lineage(texts.mapInArrow(build, f"rep long, set {kind}").dropDuplicates(["rep"]))


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, similar) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    sets = _sets(wanted, classes, docs, size)
    both = pairs.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")
    shared = both.withColumn("i", F.size(F.array_intersect("left", "right")))
    least, of = similar
    found = shared.filter(of * F.col("i") >= least * (F.size("left") + F.size("right") - F.col("i"))).select("a", "b")
    return cut_lineage(found, frees=[sets])


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, similar=SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    least, of = similar
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut_lineage(document_signatures(docs, size))
    linkable = rows.filter("doc_id is not null and n_shingles > 0")
    same = ["n_shingles", "d1", "d2"]
    # Classes have numbers of their own: one id may stand over the texts of several.
    classes = linkable.groupBy(*same).agg(F.min("doc_id").alias("doc"), F.min("signature").alias("signature"))
    classes = numbered(classes, [F.col(c) for c in same], "rep")
    classes = cut_lineage(classes.select("rep", "doc", F.col("n_shingles").alias("n"), "d1", "d2", "signature"))
    long_enough = lambda x, y: (of * F.col(x) >= least * F.col(y)) & (of * F.col(y) >= least * F.col(x))

    # The hub of a key is its member with the most company over all its keys: of a group of
    # copies, one near their common origin, which is closer to each than they are to each other.
    keys = chunk_keys(classes)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = cut_lineage(keys.join(sizes, "key"))
    company = shared.groupBy("rep").agg(F.sum("members").alias("company"))
    shared = cut_lineage(shared.join(company, "rep").select("key", "rep", "n", "company"), frees=[shared])

    hubs = shared.groupBy("key").agg(F.max_by(F.struct("rep", "n"), F.struct("company", -F.col("rep"))).alias("hub"))
    star = shared.join(hubs, "key").filter((F.col("rep") != F.col("hub.rep")) & long_enough("n", "hub.n"))
    star = star.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()
    star = cut_lineage(_close(star, classes))
    links = _confirmed(star, classes, docs, size, similar)

    # An id over several texts links their classes.
    members = linkable.join(classes.select("rep", F.col("n").alias("n_shingles"), "d1", "d2"), same)
    several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b")
    own = members.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b")
    links = cut_lineage(links.unionByName(own.distinct()), frees=[links])

    found = components(links)
    placed = shared.select("key", "rep", "n").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    placed = cut_lineage(placed.select("key", "rep", "n", F.coalesce("component", "rep").alias("component")), frees=[shared])
    parts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"))
    split = parts.groupBy("key").agg(F.max_by("component", F.struct("members", "component")).alias("main"), F.count(F.lit(1)).alias("parts"))
    # Keys within one component are done.
    there = cut_lineage(placed.join(split.filter("parts > 1").select("key", "main"), "key"), frees=[placed])
    rest = _close_in_blocks(there, classes, docs, size, similar)
    more = _confirmed(rest, classes, docs, size, similar)
    if not more.isEmpty():
        found = components(links.unionByName(more))

    labels = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    lowest = labels.groupBy("component").agg(F.min("doc").alias("component_id"))
    labels = labels.join(lowest, "component").select(F.col("n").alias("n_shingles"), "d1", "d2", "component_id")
    out = rows.join(labels, same, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: list_slice(w, i, i + 3))
                                      WHEN len(w) > 0 THEN [w] END) AS s
  FROM w
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), e AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION
  SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id
), c AS (
  SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""
