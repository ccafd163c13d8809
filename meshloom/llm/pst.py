"""Scoring texts with a probabilistic suffix tree over words.

Tokens are the lower-cased words (A-Z only) of a text and one end. The tree's symbols are the
tokens with MIN_SYMBOL occurrences in training; all others, unknown ones too, are one rare
symbol, whose probability is split among its words as the unigram distribution does. States are
contexts of up to DEPTH symbols (no rare ones), the tree's memory length; the longest suffix of
the history that is a state is used, and no context reaches over the start of a text.

* The root is the unigram distribution with one added count, unknown words being one more.
* The tree grows level by level, until no context of a level is retained. A context is a
  candidate if it occurs MIN_CONTEXT times in training and its suffix, the context without the
  first symbol, is a state (or the root). A candidate is retained if its next-symbol distribution
  diverges from its suffix's: n * KL(context || suffix) must reach DIVERGENCE for each distinct
  next symbol (by chance it is about a half).
* A state's counts are smoothed towards its suffix's distribution with the weight of PRIOR
  counts: P(w | s) = (n(s, w) + PRIOR * P(w | suffix)) / (n(s) + PRIOR). It sums to 1.

Counts cover all training rows. Texts are written in chunks of CHUNK_TOKENS tokens (a longer text
is a chunk of its own), each with its own dictionary, from which symbols are numbered by frequency.
All contexts that end with one context are in its subtree, so a token goes once, with its history,
to the bucket of its last symbol; there the subtrees are grown level by level and every token is
scored, with no exchange of counts. What returns is one sum per document and bucket. A context
with about HEAVY tokens or more would not fit a bucket: its distinct pairs (context, next symbol) go from the
chunks to groups, which return their counts, and its tokens go on with contexts of one symbol more,
until these fit. Tables are deleted once the next one is written. Both minimum counts are absolute:
a larger corpus has more symbols and states.

A null text is an empty one (its only token is the end); a row without an id trains and is not
held out. Repeated rows count as often as they appear. With nothing to train on all tokens
are unknown. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.neardup import mix64
from meshloom.llm.shared import cut_lineage, table
from meshloom.session import drop_cut

# Training counts. What occurs once has nothing to be compared with.
MIN_SYMBOL = 2
MIN_CONTEXT = 2
DIVERGENCE = 1.0
PRIOR = 256.0
# Symbols of the longest context: the memory length of the tree.
DEPTH = 4
CHUNK_TOKENS = 1 << 20
# Tokens of a bucket, on average, and of a context that is counted by exchanged pairs.
BUCKET_TOKENS = 1 << 19
HEAVY = 1 << 19
# Buckets go in turns, so that only a share of the tokens is on disk as rows of buckets.
TURNS = 2
# Tokens whose subtrees are grown together, if no context has more.
PART_TOKENS = 1 << 18
# The end is no word, as a word is not empty.
END = b""
FOLDS, HELD_FOLD = 7, 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(False))


def _pack(values: np.ndarray, kinds: str = "u2 i4 i8") -> bytes:
    """Whole numbers from 0 up, in the narrowest of the kinds, compressed."""
    top = int(values.max(initial=0))
    kind = next(k for k in kinds.split() if top <= np.iinfo(k).max)
    return kind.encode() + zstandard.ZstdCompressor(level=1).compress(values.astype("<" + kind).tobytes())


def _unpack(cell: pa.Scalar) -> np.ndarray:
    raw = cell.as_py()
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[2:]), "<" + raw[:2].decode()).astype(np.int64)


def chunks(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text, held_out) as chunks: dictionary, training counts, token places, documents."""

    def build(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        names: dict[bytes, int] = {}
        tokens, ids, held, sizes, size = [], [], [], [], 0

        def flush():
            at = np.concatenate(tokens)
            # Frequent words first: small numbers compress well.
            order = np.argsort(-np.bincount(at, minlength=len(names)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            at = rank[at]
            train = np.repeat(~np.array(held, bool), sizes)
            words = list(names)
            blob = zstandard.ZstdCompressor(level=1).compress(b"\n".join([words[i] for i in order.tolist()]))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part * (1 << 32) + number]),
                    pa.array([blob], pa.binary()),
                    pa.array([_pack(np.bincount(at[train], minlength=len(words)))], pa.binary()),
                    pa.array([_pack(at)], pa.binary()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([held], pa.list_(pa.bool_())),
                    pa.array([sizes], pa.list_(pa.int64())),
                ],
                names=["chunk", "words", "counts", "tokens", "doc_ids", "held", "sizes"],
            )

        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                some = batch.slice(first, 1000)
                for i, text, out in zip(*(some.column(j).to_pylist() for j in range(3))):
                    words = (text or "").encode().lower().split()
                    words.append(END)
                    tokens.append(np.fromiter((names.setdefault(w, len(names)) for w in words), np.int32, len(words)))
                    ids.append(i)
                    held.append(out)
                    sizes.append(len(words))
                    size += len(words)
                    if size >= CHUNK_TOKENS:
                        yield flush()
                        names, number = {}, number + 1
                        tokens, ids, held, sizes, size = [], [], [], [], 0
        if ids:
            yield flush()

    kind = "chunk long, words binary, counts binary, tokens binary, doc_ids array<long>, held array<boolean>, sizes array<long>"
    return rows.select(F.col("doc_id").cast("long"), "text", "held_out").mapInArrow(build, kind)


def _words(cell: pa.Scalar) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(cell.as_py()).split(b"\n")


def dictionary_rows(parts: DataFrame) -> DataFrame:
    """chunk, place, word, n (training) for every word of every chunk."""

    def rows(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                words, n = _words(batch.column(1)[r]), _unpack(batch.column(2)[r])
                chunk = np.full(len(words), batch.column(0)[r].as_py(), np.int64)
                columns = [pa.array(chunk), pa.array(np.arange(len(words), dtype=np.int32)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "place", "word", "n"])

    return parts.select("chunk", "words", "counts").mapInArrow(rows, "chunk long, place int, word string, n long")


def _by_chunk(rows: DataFrame, order: str, values: dict[str, str]) -> DataFrame:
    """chunk and its values in the order of ``order``: the bytes of one array for each column (name: numpy type)."""
    wanted = list(dict.fromkeys([order, *values]))

    def gather(batches):
        key, held = None, []

        def row():
            columns = {name: np.concatenate([part[i] for part in held]) for i, name in enumerate(wanted)}
            place = np.argsort(columns[order], kind="stable")
            cells = [pa.array([columns[name][place].astype(kind).tobytes()], pa.binary()) for name, kind in values.items()]
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *cells], names=["chunk", *values])

        for batch in batches:
            chunk = batch.column(0).to_numpy()
            columns = [batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(wanted))]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b > a:
                    if held and chunk[a] != key:
                        yield row()
                        held = []
                    key = int(chunk[a])
                    held.append([c[a:b] for c in columns])
        if held:
            yield row()

    placed = rows.select("chunk", *wanted).repartition("chunk").sortWithinPartitions("chunk")
    return placed.mapInArrow(gather, ", ".join(["chunk long", *(f"{name} binary" for name in values)]))


def _list(cell: pa.Scalar) -> np.ndarray:
    """A cell of an array column; no array is an empty one."""
    return cell.values.to_numpy(zero_copy_only=False) if cell.is_valid else np.zeros(0)


def _array(cell: pa.Scalar, kind: str) -> np.ndarray:
    """A cell of a column of bytes; no bytes are an empty array."""
    return np.frombuffer(cell.as_py(), kind) if cell.is_valid else np.zeros(0, kind)


def _compressed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<f8").tobytes())


def _sums(values: np.ndarray, sizes: np.ndarray) -> list[float]:
    """Sums over runs of the given sizes, none of them empty."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes).tolist()


def numbered_symbols(counts: DataFrame, min_symbol: int) -> tuple[DataFrame, DataFrame]:
    """word and symbol, from 1 by falling count (rare words: minus their count), and the table to drop after its use."""
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    spread = counts.repartitionByRange(F.desc("c"), "word").sortWithinPartitions(F.desc("c"))
    spread = cut_lineage(spread.select("word", "c", F.spark_partition_id().alias("part"), place.alias("place")), frees=[counts])
    # One row per partition, as many as the exchange has.
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = spread.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    symbol = F.when(F.col("c") >= min_symbol, F.col("base") + F.col("place") + 1).otherwise(-F.col("c"))
    return spread.join(F.broadcast(base), "part").select("word", symbol.alias("symbol")), spread


class _Root:
    """The unigram distribution: training counts by symbol, as steps of equal counts."""

    def __init__(self, steps: list, total: int, rare: int):
        steps = sorted(steps, reverse=True)
        self.total, self.rare = total, rare
        self.ends = np.cumsum([0, *(n for _, n in steps)])
        self.counts = np.array([rare - 1, *(c for c, _ in steps)], np.float64)

    def count(self, symbols: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.ends, symbols)]

    def probability(self, symbols: np.ndarray) -> np.ndarray:
        return (self.count(symbols) + 1.0) / self.total


def encoded(parts: DataFrame, known: DataFrame, root: _Root, min_context: int) -> DataFrame:
    """Chunks by symbol (0: rare), and what each document owes to single words: n_known, base, and
    score, that of the root. depth is the length of each token's next context (0: none)."""
    total, rare = math.log10(root.total), math.log10(root.rare)

    def encode(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                tokens = _unpack(batch.column(1)[r])
                sizes = _list(batch.column(4)[r])
                number = _array(batch.column(5)[r], "<i8")
                symbol = np.maximum(number, 0)
                c = np.where(number > 0, root.count(symbol), -number)
                single = np.log10(c + 1.0) - total
                # The root's probability of a rare symbol, split among the rare words.
                count = np.where(symbol == 0, root.rare - 1, c)
                whole = np.log10(count + 1.0) - total + np.where(symbol == 0, np.log10(c + 1.0) - rare, 0.0)
                before = ((symbol > 0) & (c >= min_context))[tokens[:-1]]
                depth = np.append(np.zeros(1, np.int64), before.astype(np.int64))
                depth[np.cumsum(sizes) - sizes] = 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(r, 1),
                        batch.column(2).slice(r, 1),
                        batch.column(3).slice(r, 1),
                        batch.column(4).slice(r, 1),
                        pa.array([_sums((c > 0).astype(np.int64)[tokens], sizes)], pa.list_(pa.int64())),
                        pa.array([_sums(single[tokens], sizes)], pa.list_(pa.float64())),
                        pa.array([_sums(whole[tokens], sizes)], pa.list_(pa.float64())),
                        pa.array([_pack(symbol[tokens])], pa.binary()),
                        pa.array([_pack(depth, "u1")], pa.binary()),
                        pa.array([_compressed(np.zeros(0))], pa.binary()),
                    ],
                    names=_STATE,
                )

    wide = parts.select("chunk", "tokens", "doc_ids", "held", "sizes").join(known, "chunk")
    kind = (
        "chunk long, doc_ids array<long>, held array<boolean>, sizes array<long>, known array<long>, base array<double>, "
        "score array<double>, symbols binary, depth binary, parents binary"
    )
    return wide.select("chunk", "tokens", "doc_ids", "held", "sizes", "symbol").mapInArrow(encode, kind)


_STATE = ["chunk", "doc_ids", "held", "sizes", "known", "base", "score", "symbols", "depth", "parents"]
_DOCS = ["chunk", "doc_ids", "held", "sizes", "known", "base", "score"]
_TOKENS = ["chunk", "held", "sizes", "symbols", "depth", "parents"]


def _rows(batches, names: list[str]):
    for batch in batches:
        for r in range(batch.num_rows):
            yield {name: batch.column(i)[r] for i, name in enumerate(names)}


def _joined(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The code of a context with one symbol more, or of a context and its next symbol."""
    return mix64(context * _STEP + symbol.astype(np.uint64))


class _Chunk:
    """The tokens of a chunk: symbols, lengths of their next contexts, probabilities in the context before that."""

    def __init__(self, row: dict, root: _Root):
        self.root = root
        self.sizes = row["sizes"].values.to_numpy().astype(np.int64)
        self.at, self.depth = _unpack(row["symbols"]), _unpack(row["depth"])
        self.late = np.flatnonzero(self.depth > 1)
        self.parents = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["parents"].as_py()), "<f8")

    def parent(self, some: np.ndarray) -> np.ndarray:
        """Probabilities in the context before the next one."""
        out = np.empty(len(some))
        first = self.depth[some] == 1
        out[first] = self.root.probability(self.at[some[first]])
        out[~first] = self.parents[np.searchsorted(self.late, some[~first])]
        return out

    def per_token(self, values: np.ndarray) -> np.ndarray:
        return np.repeat(values, self.sizes)

    def begin(self) -> np.ndarray:
        return self.per_token(np.cumsum(self.sizes) - self.sizes)

    def contexts(self, some: np.ndarray, length: int) -> np.ndarray:
        """The codes of contexts of that length, for tokens that have them."""
        out = np.ones(len(some), np.uint64)
        for k in range(1, length + 1):
            out = _joined(out, self.at[some - k])
        return out

    def next_contexts(self, level: int, heavy: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The tokens whose next context has ``level`` symbols, and is a heavy one if these are given, and its code."""
        some = np.flatnonzero(self.depth == level)
        context = self.contexts(some, level)
        if heavy is not None:
            found = np.isin(context, heavy)
            some, context = some[found], context[found]
        return some, context

    def heavy_pairs(self, level: int, heavy: np.ndarray, groups: int) -> tuple[np.ndarray, ...]:
        """Tokens in heavy contexts; of their distinct pairs (context, next symbol): a token of each, group and context, by group; each token's pair.

        A context has its pairs in a sixteenth of the groups.
        """
        some, context = self.next_contexts(level, heavy)
        pairs, first, back = np.unique(_joined(context, self.at[some]), return_index=True, return_inverse=True)
        group = (((context[first] >> np.uint64(20)) + pairs % np.uint64(-(-groups // 16))) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return some, some[first[order]], group[order], np.searchsorted(heavy, context[first[order]]), place[back]


def _heavy_contexts(state: DataFrame, root: _Root, level: int, number: int) -> np.ndarray:
    """Contexts of ``level`` symbols with HEAVY tokens, and some with half of that; at most 2 a HEAVY tokens.

    A chunk names only contexts with their share of HEAVY / 2, so what all others hold back of one is less than that.
    """
    least = max(1, HEAVY // (2 * number))

    def count(batches):
        for row in _rows(batches, _TOKENS):
            chunk = _Chunk(row, root)
            codes, n = np.unique(chunk.next_contexts(level)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes[n >= least].view(np.int64)), pa.array(n[n >= least])], names=["context", "n"])

    seen = state.select(*_TOKENS).mapInArrow(count, "context long, n long").groupBy("context").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r["context"] for r in seen.filter(F.col("n") >= HEAVY // 2).collect()], np.int64).view(np.uint64))


def _planes(columns: list[np.ndarray]) -> bytes:
    """Columns of small numbers, byte by byte of all rows: high bytes compress to nothing."""
    return np.ascontiguousarray(np.stack(columns).astype("<u4").view(np.uint8).reshape(len(columns), -1, 4).transpose(0, 2, 1)).tobytes()


def _from_planes(raw: bytes, number: int, rows: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, number * 4 * rows).reshape(number, 4, rows)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[:, :, 0]


def heavy_rows(state: DataFrame, root: _Root, level: int, heavy: np.ndarray, groups: int) -> DataFrame:
    """bucket, chunk, n, pairs: the distinct pairs of a chunk in heavy contexts that are in a group, with training counts."""

    def send(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for row in _rows(batches, _TOKENS):
            chunk = _Chunk(row, root)
            some, first, group, number, back = chunk.heavy_pairs(level, heavy, groups)
            train = ~chunk.per_token(_list(row["held"]).astype(bool))[some]
            n = np.bincount(back, weights=train, minlength=len(first)).astype(np.int64)
            parent = chunk.parent(first) if level > 1 else np.zeros(0)
            cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
            ends = [*cuts[1:], len(group)]
            blobs = [packer.compress(_planes([number[a:b], chunk.at[first[a:b]], n[a:b]]) + parent[a:b].tobytes()) for a, b in zip(cuts, ends)]
            columns = [group[cuts], np.full(len(cuts), row["chunk"].as_py(), np.int64), np.diff([*cuts, len(group)]).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "n", "tokens"])

    return state.select(*_TOKENS).mapInArrow(send, "bucket long, chunk long, n long, tokens binary")


def _per_bucket(rows: DataFrame, solve, kind: str) -> DataFrame:
    """The batch that ``solve`` makes of the cells (bucket, chunk, n, tokens) of each bucket."""

    def build(batches):
        held, key = [], None
        for batch in batches:
            for bucket, chunk, n, blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if bucket != key and held:
                    yield solve(held)
                    held = []
                key = bucket
                held.append((bucket, chunk, n, blob))
        if held:
            yield solve(held)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(build, kind)


def heavy_counts(rows: DataFrame, root: _Root, level: int) -> DataFrame:
    """chunk, bucket, counts: the counts of all chunks for each chunk's pairs; and a row a bucket without a chunk,
    with what its pairs add to the sums of each context."""

    def solve(held):
        reader, tables, parents = zstandard.ZstdDecompressor(), [], []
        for _, _, n, blob in held:
            raw = reader.decompress(blob)
            tables.append(_from_planes(raw, 3, n))
            parents.append(root.probability(tables[-1][1]) if level == 1 else np.frombuffer(raw, "<f8", offset=12 * n))
        context, symbol, n = np.concatenate(tables, axis=1).astype(np.int64)
        _, first, back = np.unique((context << 32) + symbol, return_index=True, return_inverse=True)
        all_n = np.bincount(back, weights=n)
        parent, context = np.concatenate(parents)[first], context[first]
        seen = np.flatnonzero(all_n > 0)
        present, at = np.unique(context[seen], return_inverse=True)
        sums = [np.bincount(at, weights=w) for w in (all_n[seen], np.ones(len(seen)), all_n[seen] * np.log(all_n[seen] / parent[seen]))]
        cells = np.split(all_n[back].astype(np.int64), np.cumsum([n for _, _, n, _ in held])[:-1])
        columns = [
            pa.array([chunk for _, chunk, _, _ in held] + [None], pa.int64()),
            pa.array([bucket for bucket, _, _, _ in held] + [held[0][0]], pa.int64()),
            pa.array([_pack(c) for c in cells] + [None], pa.binary()),
            *(pa.array([None] * len(held) + [values], pa.list_(t)) for values, t in zip((present, *sums), (pa.int64(), *[pa.float64()] * 3))),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "bucket", "counts", "contexts", "totals", "kinds", "gains"])

    kind = "chunk long, bucket long, counts binary, contexts array<long>, totals array<double>, kinds array<double>, gains array<double>"
    return _per_bucket(rows, solve, kind)


def _heavy_states(counts: DataFrame, number: int, divergence: float, least: int) -> np.ndarray:
    """The training count of each heavy context that is retained, 0 for the others."""
    parts = counts.filter("chunk is null").select(F.explode(F.arrays_zip("contexts", "totals", "kinds", "gains")).alias("c"))
    sums = parts.groupBy("c.contexts").agg(*(F.sum(f"c.{name}").alias(name) for name in ("totals", "kinds", "gains")))
    # n * KL = sum of n(w) * log(n(w) / (n * parent(w))).
    far = F.col("gains") - F.col("totals") * F.log("totals") >= F.lit(divergence) * F.col("kinds")
    out = np.zeros(number)
    for r in sums.filter(far & (F.col("totals") >= least)).collect():
        out[r["contexts"]] = r["totals"]
    return out


def _answered(
    state: DataFrame, counts: DataFrame, root: _Root, level: int, heavy: np.ndarray, groups: int, totals: np.ndarray, prior: float, longest: int
) -> DataFrame:
    """Chunks with the scores that heavy states of ``level`` symbols give, their tokens at one symbol more."""
    columns = [*_STATE, "found"]
    found = counts.filter("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts")).alias("found"))

    def update(batches):
        for row in _rows(batches, columns):
            chunk = _Chunk(row, root)
            some, first, _, number, back = chunk.heavy_pairs(level, heavy, groups)
            # The heavy contexts that are not retained are no states.
            depth, parent = chunk.depth.copy(), np.zeros(len(chunk.at))
            depth[some] = 0
            parent[chunk.late] = chunk.parents
            if len(some):
                cells = sorted(row["found"], key=lambda cell: cell["bucket"].as_py())
                n = np.concatenate([_unpack(cell["counts"]) for cell in cells])
                value = ((n + prior * chunk.parent(first)) / (totals[number] + prior))[back]
                kept = totals[number][back] > 0
                some, value = some[kept], value[kept]
                more = np.zeros(len(chunk.at))
                more[some] = np.log10(value / chunk.parent(some))
                row["score"] = (_list(row["score"]) + np.array(_sums(more, chunk.sizes))).tolist()
                parent[some] = value
                if level < longest:
                    before = some - level - 1
                    depth[some] = np.where((before >= chunk.begin()[some]) & (chunk.at[before] > 0), level + 1, 0)
            row["depth"], row["parents"] = _pack(depth, "u1"), _compressed(parent[depth > 1])
            cells = [row[name].as_py() if isinstance(row[name], pa.Scalar) else row[name] for name in _STATE]
            yield pa.RecordBatch.from_arrays([pa.array([cell], kind) for cell, kind in zip(cells, kinds)], names=_STATE)

    lists = {"doc_ids": pa.int64(), "held": pa.bool_(), "sizes": pa.int64(), "known": pa.int64(), "base": pa.float64(), "score": pa.float64()}
    kinds = [pa.int64() if name == "chunk" else pa.list_(lists[name]) if name in lists else pa.binary() for name in _STATE]
    return state.join(found, "chunk", "left").select(*columns).mapInArrow(update, state.select(*_STATE).schema)


def heavy_levels(state: DataFrame, root: _Root, tokens: int, number: int, limits: tuple, longest: int) -> DataFrame:
    """Chunks after all contexts with HEAVY tokens, which lie below each other from the root on."""
    divergence, least, prior = limits
    groups = -(-tokens // BUCKET_TOKENS) or 1
    for level in range(1, longest + 1) if tokens >= HEAVY else ():
        heavy = _heavy_contexts(state, root, level, number)
        if not len(heavy):
            break
        counts = cut_lineage(heavy_counts(heavy_rows(state, root, level, heavy, groups), root, level))
        totals = _heavy_states(counts, len(heavy), divergence, least)
        state = cut_lineage(_answered(state, counts, root, level, heavy, groups, totals, prior, longest), frees=[state, counts])
    return state


def bucket_rows(state: DataFrame, root: _Root, buckets: int, turn: int, longest: int) -> DataFrame:
    """bucket, chunk, n, tokens: the tokens of a chunk whose next context is in the bucket, with their histories.

    Only the buckets whose turn it is.
    """

    def send(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for row in _rows(batches, _TOKENS):
            chunk = _Chunk(row, root)
            places, keys = [], []
            for level in range(1, longest + 1):
                some, context = chunk.next_contexts(level)
                bucket = ((context >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                now = bucket % TURNS == turn
                places.append(some[now])
                keys.append(bucket[now])
            some, bucket = np.concatenate(places), np.concatenate(keys)
            order = np.lexsort((some, bucket))
            some, bucket = some[order], bucket[order]
            # The symbols before each token, nearest first; 0 where its history has ended.
            columns, begin, on = [chunk.at[some]], chunk.begin()[some], np.ones(len(some), bool)
            for k in range(1, longest + 1):
                symbol = chunk.at[some - k]
                on &= (some - k >= begin) & (symbol > 0)
                columns.append(np.where(on, symbol, 0))
            doc = chunk.per_token(np.arange(len(chunk.sizes)))[some]
            held = _list(row["held"]).astype(np.int64)[doc]
            depth, parent = chunk.depth[some].astype(np.uint8), chunk.parent(some)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            blobs = []
            for a, b in zip(cuts, [*cuts[1:], len(some)]):
                # Documents are in order: steps between them, and one bit for being held out.
                step = np.diff(doc[a:b], prepend=0) * 2 + held[a:b]
                late = depth[a:b] > 1
                blobs.append(packer.compress(_planes([step, *(c[a:b] for c in columns)]) + depth[a:b].tobytes() + parent[a:b][late].tobytes()))
            keys = bucket[cuts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys),
                    pa.array(np.full(len(keys), row["chunk"].as_py(), np.int64)),
                    pa.array(np.diff([*cuts, len(some)]).astype(np.int64)),
                    pa.array(blobs, pa.binary()),
                ],
                names=["bucket", "chunk", "n", "tokens"],
            )

    return state.select(*_TOKENS).mapInArrow(send, "bucket long, chunk long, n long, tokens binary")


def grown(symbols: np.ndarray, train: np.ndarray, depth: np.ndarray, context: np.ndarray, parent: np.ndarray, limits: tuple) -> np.ndarray:
    """What the states add to the score of each token, for all tokens of the contexts that occur.

    ``symbols`` has a row of tokens and one for each symbol before them; contexts (their codes) start with ``depth`` symbols.
    """
    divergence, least, prior = limits
    longest = len(symbols) - 1
    value = np.zeros(len(depth))
    on, depth = np.arange(len(depth)), depth.astype(np.int64)
    while len(on):
        _, first, back = np.unique(_joined(context, symbols[0, on]), return_index=True, return_inverse=True)
        n = np.bincount(back, weights=train[on], minlength=len(first))
        _, group = np.unique(context[first], return_inverse=True)
        seen = n > 0
        total = np.bincount(group, weights=n)
        # n * KL = sum of n(w) * log(n(w) / (n * parent(w))).
        gain = np.bincount(group[seen], weights=n[seen] * np.log(n[seen] / parent[first[seen]]), minlength=len(total))
        kinds = np.bincount(group[seen], minlength=len(total))
        far = gain - total * np.log(np.maximum(total, 1.0)) >= divergence * kinds
        keep = (far & (total >= max(least, 1)))[group][back]
        probability = ((n[back] + prior * parent) / (total[group][back] + prior))[keep]
        on, context, depth = on[keep], context[keep], depth[keep] + 1
        value[on] += np.log10(probability / parent[keep])
        symbol = np.where(depth <= longest, symbols[np.minimum(depth, longest), on], 0)
        more = symbol > 0
        on, context, depth, parent = on[more], _joined(context[more], symbol[more]), depth[more], probability[more]
    return value


def bucket_sums(rows: DataFrame, root: _Root, limits: tuple, longest: int) -> DataFrame:
    """chunk, docs, sums: what each document's tokens in the bucket add to its score."""

    def solve(held):
        reader, total, at = zstandard.ZstdDecompressor(), sum(n for _, _, n, _ in held), 0
        numbers, depth, parent = np.empty((longest + 2, total), np.uint32), np.empty(total, np.uint8), np.empty(total)
        chunks_, sizes = [chunk for _, chunk, _, _ in held], [n for _, _, n, _ in held]
        # Each cell is let go once it is read.
        held.reverse()
        while held:
            _, _, n, blob = held.pop()
            raw, to = reader.decompress(blob), at + n
            numbers[:, at:to] = _from_planes(raw, longest + 2, n)
            size = 4 * (longest + 2) * n
            depth[at:to] = np.frombuffer(raw, np.uint8, n, size)
            first = depth[at:to] == 1
            parent[at:to][first] = root.probability(numbers[1, at:to][first])
            parent[at:to][~first] = np.frombuffer(raw, "<f8", offset=size + n)
            at = to
        context = np.ones(len(depth), np.uint64)
        for k in range(1, int(depth.max()) + 1):
            some = np.flatnonzero(depth >= k)
            context[some] = _joined(context[some], numbers[k + 1, some])
        order = np.argsort(context)
        edges = np.append(np.flatnonzero(np.diff(context[order])) + 1, len(order))
        cuts = np.unique(edges[np.searchsorted(edges, np.arange(PART_TOKENS, len(order) + PART_TOKENS, PART_TOKENS).clip(max=len(order)))])
        value = np.empty(total)
        for some in np.split(order, cuts[:-1]):
            # In the order of arrival, so that documents stay together in memory.
            some = np.sort(some)
            value[some] = grown(numbers[1:, some], (numbers[0, some] & 1) == 0, depth[some], context[some], parent[some], limits)
        out = [[], [], []]
        at = 0
        for chunk, n in zip(chunks_, sizes):
            step = numbers[0, at : at + n] >> 1
            first = np.flatnonzero(np.append(True, step[1:] > 0))
            sums = np.add.reduceat(value[at : at + n], first)
            docs = np.cumsum(step, dtype=np.int64)[first][sums != 0]
            for column, cell in zip(out, (chunk, _pack(np.diff(docs, prepend=0)), sums[sums != 0].astype("<f8").tobytes())):
                column.append(cell)
            at += n
        types = (pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["chunk", "docs", "sums"])

    return _per_bucket(rows, solve, "chunk long, docs binary, sums binary")


def _scored(docs: DataFrame, sums: DataFrame) -> DataFrame:
    """Documents of chunks with the sums of buckets added to their scores."""
    found = sums.groupBy("chunk").agg(F.collect_list(F.struct("docs", "sums")).alias("found"))

    def add(batches):
        for row in _rows(batches, [*_DOCS, "found"]):
            score = _list(row["score"]).astype(np.float64)
            for part in row["found"] if row["found"].is_valid else ():
                score[np.cumsum(_unpack(part["docs"]))] += _array(part["sums"], "<f8")
            cells = [pa.array([row[name].as_py()], kind) for name, kind in zip(_DOCS[:-1], kinds)]
            yield pa.RecordBatch.from_arrays([*cells, pa.array([score], pa.list_(pa.float64()))], names=_DOCS)

    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
    return docs.join(found, "chunk", "left").select(*_DOCS, "found").mapInArrow(add, docs.select(*_DOCS).schema)


def score_texts(
    rows: DataFrame,
    min_symbol: int = MIN_SYMBOL,
    min_context: int = MIN_CONTEXT,
    divergence: float = DIVERGENCE,
    prior: float = PRIOR,
    depth: int = DEPTH,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for rows (doc_id, text, held_out).

    A tree of contexts of up to ``depth`` symbols is trained on the rows that are not held out and scores all rows.
    """
    parts = cut_lineage(chunks(rows))
    counts = cut_lineage(dictionary_rows(parts).groupBy("word").agg(F.sum("n").alias("c")))
    rare_one = (F.col("c") > 0) & (F.col("c") < min_symbol)
    sums = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.sum(F.when(rare_one, F.col("c") + 1)).alias("rare")).first()
    train = sums["n"] or 0
    # Different counts add up to at most the tokens, so there are few.
    steps = counts.filter(F.col("c") >= min_symbol).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()
    root = _Root([(r["c"], r["n"]) for r in steps], train + (sums["v"] or 0) + 1, (sums["rare"] or 0) + 1)
    symbols, spread = numbered_symbols(counts, min_symbol)
    # Words of a partition fit memory, and hashing them spares sorting all words of the chunks.
    known = _by_chunk(dictionary_rows(parts).join(symbols.hint("shuffle_hash"), "word"), "place", {"symbol": "<i8"})
    state = cut_lineage(encoded(parts, known, root, min_context), frees=[parts, spread])

    size = state.agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()
    limits, tokens = (divergence, min_context, prior), size["n"] or 0
    state = heavy_levels(state, root, tokens, size["chunks"], limits, depth)
    docs = state.select(*_DOCS)
    for turn in range(TURNS):
        sent = bucket_rows(state, root, -(-tokens // BUCKET_TOKENS) or 1, turn, depth)
        docs = cut_lineage(_scored(docs, bucket_sums(sent, root, limits, depth)), frees=[docs])
    drop_cut(state)

    done = docs.select(F.explode(F.arrays_zip("doc_ids", "held", "sizes", "known", "base", "score")).alias("d"))
    return done.select(
        F.col("d.doc_ids").alias("doc_id"),
        F.col("d.held").alias("held_out"),
        F.col("d.sizes").alias("n_tokens"),
        F.col("d.known").alias("n_known"),
        F.col("d.base").alias("base_score"),
        F.col("d.score").alias("score"),
        F.lit(train).cast("long").alias("train_tokens"),
    )


def op1_suffix_tree(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = score_texts(docs.withColumn("held_out", held_out(F.col("doc_id"))))
    return done.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
