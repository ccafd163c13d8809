"""Removing long repeated byte strings: suffix arrays over shards of suspected text.

A byte goes if a string of LENGTH bytes that covers it starts at another place too, in the
same or another document. Strings never cross documents.

1. Anchors. In every start's first WINDOW positions the smallest 16-byte fingerprint is taken
   (the rightmost of equal ones). It depends on those bytes alone, so equal strings have equal
   anchors at equal distance. Successive starts share an anchor and form one run; all of them
   contain the CORE bytes from the anchor on. A run whose core is found nowhere else holds no
   repeat. A run whose neighbourhood (its starts and their whole strings) is found elsewhere is
   all repeats. Both are counts of hashes, summed map-side, however hot a passage is.
2. Shards. Only what is left moves as text, once per distinct neighbourhood, grouped by core.
   A shard's suffix array is built by induced sorting: suffixes are classified, the
   leftmost-smaller ones are sorted by their substrings, named, ordered, and induce all
   others. Every start is compared with its predecessor in that order (the permuted common
   prefix, as far as LENGTH); two that agree are both repeats.
3. A core with more than SHARD_RUNS distinct neighbourhoods would not fit a shard. Its runs are
   cut into blocks of BLOCK starts, placed by their distance from the anchor; a block goes on
   only if the bytes that all of its strings share are found in another block at the same
   distance, and what is left is told apart by one hash per string. These are counts again.

Equal suffixes are only told apart to a depth of LENGTH, which is all that the answer needs.
A null text is an empty one. Rows are told apart by id and text, so repeated rows repeat each
other and go whole. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.neardup import mix64
from meshloom.llm.shared import cut_lineage, table

LENGTH = 400
WINDOW = 192
GRAM = 16
CORE = LENGTH - WINDOW
SHARD_BYTES = 2_000_000
SHARD_RUNS = 2_000
BLOCK = 8
SLICE_BYTES = 4_000_000
SYMBOLS = 258
# Bits of a fingerprint that hold its place in a stretch of text.
PLACE_BITS = 24


def _loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number."""
    return np.ndarray(shape=(max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from every place on, by block-wise running minima."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(grid, axis=1).ravel()
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


def _anchors(data: np.ndarray) -> np.ndarray:
    """The anchor of every start in ``data``, for at most 2^PLACE_BITS fingerprints."""
    loads = _loads(data)
    prints = mix64(loads[:-8] * np.uint64(0x9E3779B97F4A7C15) + loads[8:] * np.uint64(0xC2B2AE3D27D4EB4F))
    place = np.arange(len(prints), dtype=np.uint64)
    # Low bits prefer the rightmost of equal fingerprints.
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = _sliding_min((prints & ~low) | (low - place), WINDOW)
    return (low - (least & low)).astype(np.int64)[: len(data) - LENGTH + 1]


def anchor_runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts (first, last) and their anchors, for documents that end at ``ends`` in ``data``.

    Anchors are looked up in stretches whose places fit their bits, however long a document is.
    A start's anchor depends on the LENGTH bytes from it on, so stretches overlap by those.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none
    step = min(SLICE_BYTES, 1 << PLACE_BITS) - LENGTH + 1
    anchor = np.concatenate([a + _anchors(data[a : a + step + LENGTH - 1]) for a in range(0, len(data) - LENGTH + 1, step)])
    starts = np.arange(len(anchor))
    limit = np.repeat(ends, np.diff(ends, prepend=0))[: len(anchor)]
    valid = starts + LENGTH <= limit
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (limit[1:] != limit[:-1])
    first = np.flatnonzero(new & valid)
    stop = np.ones(len(anchor), bool)
    stop[:-1] = new[1:] | ~valid[1:]
    last = np.flatnonzero(stop & valid)
    return first, last, anchor[first]


def document_runs(docs: DataFrame) -> DataFrame:
    """rid, first, last, anchor, core, whole: the runs of every row, with the hashes of core and neighbourhood."""

    def scan(batches):
        for batch in batches:
            rids = batch.column(0).to_numpy()
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for a, b in _slices(texts):
                data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
                sizes = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
                ends = np.cumsum(sizes)
                first, last, anchor = anchor_runs(data, ends)
                raw = memoryview(data)
                whole = np.fromiter((xxhash.xxh3_64_intdigest(raw[i : j + LENGTH]) for i, j in zip(first.tolist(), last.tolist())), np.uint64, len(first))
                core = np.fromiter((xxhash.xxh3_64_intdigest(raw[p : p + CORE]) for p in anchor.tolist()), np.uint64, len(first))
                doc = np.searchsorted(ends, first, side="right")
                begin = (ends - sizes)[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rids[a + doc]),
                        pa.array((first - begin).astype(np.int32)),
                        pa.array((last - begin).astype(np.int32)),
                        pa.array((anchor - begin).astype(np.int32)),
                        pa.array(core.view(np.int64)),
                        pa.array(whole.view(np.int64)),
                    ],
                    names=["rid", "first", "last", "anchor", "core", "whole"],
                )

    return docs.select("rid", "text").mapInArrow(scan, "rid long, first int, last int, anchor int, core long, whole long")


def _slices(texts: list[bytes]):
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_BYTES:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def _is_smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last counts as smaller."""
    n = len(text)
    change = np.where(text[:-1] != text[1:], np.arange(n - 1), n)
    change = np.minimum.accumulate(change[::-1])[::-1]
    out = np.ones(n, bool)
    at = np.minimum(change, n - 2)
    out[:-1] = text[at] < text[at + 1]
    return out


def _push(buckets: list[list[np.ndarray]], text: np.ndarray, places: np.ndarray) -> None:
    """Append places to the buckets of their symbols, in order."""
    if len(places):
        symbols = text[places]
        order = np.argsort(symbols, kind="stable")
        places, symbols = places[order], symbols[order]
        cuts = np.flatnonzero(np.diff(symbols)) + 1
        for s, part in zip(symbols[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts)):
            buckets[s].append(part)


def _induced(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> list[np.ndarray]:
    """All suffixes but the last, by bucket: larger ones induced from ``seeds``, then smaller ones from those.

    Buckets are taken in order; what a bucket induces in itself is queued behind, which is the
    order of the one-by-one scan.
    """
    cuts = np.searchsorted(text[seeds], np.arange(1, SYMBOLS))
    seeded = np.split(seeds, cuts)
    larger: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]
    for s in range(SYMBOLS):
        for part in larger[s]:
            before = part[part > 0] - 1
            _push(larger, text, before[~smaller[before]])
        before = seeded[s][seeded[s] > 0] - 1
        _push(larger, text, before[~smaller[before]])
    found: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in larger]
    for s in range(SYMBOLS - 1, -1, -1):
        for part in found[s]:
            before = part[part > 0] - 1
            _push(found, text, before[smaller[before]])
        back = joined[s][::-1]
        before = back[back > 0] - 1
        _push(found, text, before[smaller[before]])
    empty = [np.zeros(0, np.int64)]
    return [np.concatenate([joined[s], np.concatenate(found[s] or empty)[::-1]]) for s in range(SYMBOLS)]


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of ``text`` (small whole numbers, the last one the only 0) in order as far as ``depth``.

    The last suffix is left out.
    """
    smaller = _is_smaller(text)
    leftmost = np.zeros(len(text), bool)
    leftmost[1:] = smaller[1:] & ~smaller[:-1]
    marks = np.flatnonzero(leftmost)
    if len(marks) < 2:
        return np.concatenate(_induced(text, smaller, marks))
    rough = marks[np.argsort(text[marks], kind="stable")]
    places = np.concatenate(_induced(text, smaller, rough))
    order = np.concatenate([marks[-1:], places[leftmost[places]]])
    # Names: equal substrings from one mark to the next have equal names.
    size = np.zeros(len(text), np.int64)
    size[marks] = np.diff(marks, append=len(text)) + 1
    differs = np.ones(len(order), bool)
    open_ = 1 + np.flatnonzero(size[order[1:]] == size[order[:-1]])
    step = 0
    while len(open_):
        a, b = order[open_ - 1], order[open_]
        ended = size[b] <= step
        differs[open_[ended]] = False
        inside = open_[~ended]
        a, b = a[~ended] + step, b[~ended] + step
        edge = (a >= len(text)) | (b >= len(text))
        a, b = np.minimum(a, len(text) - 1), np.minimum(b, len(text) - 1)
        open_ = inside[~edge & (text[a] == text[b])]
        step += 1
    rank = np.empty(len(text), np.int64)
    rank[order] = np.cumsum(differs) - 1
    rank = rank[marks]
    # Order the string of names: ranks of pairs, doubling in length.
    reach = 1
    while reach < depth and rank.max() + 1 < len(rank):
        second = np.zeros(len(rank), np.int64)
        second[:-reach] = rank[reach:] + 1
        key = rank * (len(rank) + 1) + second
        order = np.argsort(key, kind="stable")
        ranks = np.empty(len(rank), np.int64)
        ranks[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        rank, reach = ranks, reach * 2
    return np.concatenate(_induced(text, smaller, marks[np.argsort(rank, kind="stable")]))


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all parts, one after the other with a separator each: where a string starts, the
    class of equal strings it belongs to (-1: none starts), and whether its class has two or more."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = np.frombuffer(b"\0".join(parts) + b"\0" * (length + 8), np.uint8)
    n = int(sizes.sum()) + len(parts)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = raw[:n].astype(np.int16) + 2
    text[begin + sizes] = 1
    text = np.append(text, np.int16(0))
    room = np.repeat(begin + sizes, sizes + 1) - np.arange(n)
    valid = np.append(room >= length, False)
    order = suffix_array(text, length)
    order = order[valid[order]]
    # Permuted: each start's predecessor, compared in text order.
    before = np.full(n + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    same = np.flatnonzero(before >= 0)
    loads = _loads(raw)
    for step in [*range(0, length - 7, 8), length - 8]:
        same = same[loads[same + step] == loads[before[same] + step]]
    equal = np.zeros(n + 1, bool)
    equal[same] = True
    group = np.full(n + 1, -1, np.int64)
    group[order] = np.cumsum(~equal[order]) - 1
    several = np.zeros(n + 1, bool)
    counts = np.bincount(group[order], minlength=1)
    several[order] = counts[group[order]] > 1
    return begin, group[:n], several[:n]


def _intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _shards(rows: DataFrame) -> DataFrame:
    """Runs (core, rid, first, part), sorted by core, as repeats: rid, first, last (of starts)."""

    def solve(held):
        rids, firsts, parts = map(list, zip(*held))
        begin, _, several = repeated_starts(parts)
        out: list[tuple] = []
        for rid, first, part, at in zip(rids, firsts, parts, begin.tolist()):
            a, b = _intervals(several[at : at + len(part)])
            out.extend((rid, first + int(i), first + int(j)) for i, j in zip(a, b))
        types = (pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["rid", "first", "last"])

    def build(batches):
        held, size, key = [], 0, None
        for batch in batches:
            for core, rid, first, part in zip(*(batch.column(i).to_pylist() for i in range(4))):
                # A shard ends between two cores.
                if core != key and size >= SHARD_BYTES:
                    yield solve(held)
                    held, size = [], 0
                key = core
                held.append((rid, first, part))
                size += len(part)
        if held:
            yield solve(held)

    return rows.mapInArrow(build, "rid long, first int, last int")


def _run_texts(runs: DataFrame, docs: DataFrame) -> DataFrame:
    """core, rid, first, last, anchor and the bytes of each run's neighbourhood."""
    wanted = runs.groupBy("rid").agg(F.collect_list(F.struct("core", "first", "last", "anchor")).alias("runs"))
    texts = wanted.join(docs, "rid").select("rid", "text", "runs")

    def extract(batches):
        for batch in batches:
            rows = [[] for _ in range(6)]
            for rid, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = (text or "").encode()
                for run in wanted:
                    values = (run["core"], rid, run["first"], run["last"], run["anchor"], data[run["first"] : run["last"] + LENGTH])
                    for column, value in zip(rows, values):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            names = ["core", "rid", "first", "last", "anchor", "part"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    return texts.mapInArrow(extract, "core long, rid long, first int, last int, anchor int, part binary")


def _hot_repeats(runs: DataFrame) -> DataFrame:
    """Repeats of runs with their texts, by counts alone: blocks of starts first, then single strings."""

    def blocks(batches):
        names = ["core", "distance", "shared", "rid", "first", "last", "part"]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            rows = [[] for _ in names]
            for core, rid, first, last, anchor, part in zip(*(batch.column(i).to_pylist() for i in range(6))):
                for q in range((anchor - last) // BLOCK, (anchor - first) // BLOCK + 1):
                    # Starts at distances q * BLOCK to q * BLOCK + BLOCK - 1; their strings share these bytes.
                    at = anchor - q * BLOCK - first
                    shared = xxhash.xxh3_64_intdigest(part[at : at + LENGTH - BLOCK + 1]) - (1 << 63)
                    a, b = max(0, at - BLOCK + 1), min(at, last - first)
                    for column, value in zip(rows, (core, q, shared, rid, first + a, first + b, part[a : b + LENGTH])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    def strings(batches):
        for batch in batches:
            rows = [[], [], []]
            for rid, first, last, part in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for i in range(last - first + 1):
                    for column, value in zip(rows, (rid, first + i, xxhash.xxh3_64_intdigest(part[i : i + LENGTH]) - (1 << 63))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64()))], names=["rid", "first", "code"])

    cut = cut_lineage(runs.mapInArrow(blocks, "core long, distance int, shared long, rid long, first int, last int, part binary"))
    key = ["core", "distance", "shared"]
    again = cut.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key)
    left = cut.join(again, key, "left_semi").select("rid", "first", "last", "part")
    codes = cut_lineage(left.mapInArrow(strings, "rid long, first int, code long"), frees=[cut])
    several = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("code")
    return codes.join(several, "code", "left_semi").select("rid", "first", F.col("first").alias("last"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """rid and its repeated starts (first, last) for ``docs`` (rid, text)."""
    runs = cut_lineage(document_runs(docs))
    found = runs.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core")
    runs = cut_lineage(runs.join(found, "core"), frees=[runs])
    kinds = cut_lineage(
        runs.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "first", "last", "anchor")).alias("at"))
    )
    several = kinds.filter("n > 1").select("core", "whole")
    sure = cut_lineage(runs.join(several, ["core", "whole"], "left_semi").select("rid", "first", "last"), frees=[runs])
    groups = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("single"))
    groups = groups.filter("kinds > 1 and single > 0").select("core", (F.col("kinds") > SHARD_RUNS).alias("hot"))
    left = cut_lineage(kinds.join(groups, "core").select("core", "hot", "at.rid", "at.first", "at.last", "at.anchor"), frees=[kinds])
    cold = _run_texts(left.filter("not hot"), docs).select("core", "rid", "first", "part")
    solved = cut_lineage(_shards(cold.repartition("core").sortWithinPartitions("core")))
    if left.filter("hot").isEmpty():
        return sure.unionByName(solved)
    return sure.unionByName(solved).unionByName(_hot_repeats(_run_texts(left.filter("hot"), docs)))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (binary), spans (first, end in bytes of maximal removed runs), n_bytes."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("rid", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(keyed.select("rid", "text"))
    per_row = spans.groupBy("rid").agg(F.collect_set(F.struct("first", "last")).alias("found"))
    joined = keyed.join(per_row, "rid", "left").select("doc_id", "text", "found")

    def cut(batches):
        for batch in batches:
            kept, spans, sizes = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode()
                merged: list[list[int]] = []
                for first, end in sorted((x["first"], x["last"] + LENGTH) for x in found or ()):
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([first, end])
                edges = [0, *(x for span in merged for x in span), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append([{"first": a, "end": b} for a, b in merged])
                sizes.append(len(data))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), pa.array(spans, kind), pa.array(sizes, pa.int64())],
                names=["doc_id", "kept", "spans", "n_bytes"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, kept binary, spans array<struct<first:long,end:long>>, n_bytes long")


def op9_suffix_dedup(spark, sf_dir):
    done = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["first"])
    spans = F.size("spans").cast("long")
    return done.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (spans > 0).alias("has_repeats")
    )
