"""A vocabulary as minimal acyclic transducers, and an audit of how sources differ with it.

Terms are runs of letters (A-Z in lower case, everything from U+0080 up). A language keeps
the terms in at least `MIN_DOCS` of its documents. Sorted by language and bytes they are
numbered from 0; the numbers are the ordinals. Runs of at most `SHARD_TERMS` neighbouring
terms of a language become one transducer each, built in the executors from the sorted terms:
a state is frozen as soon as no later term can change it, and equal frozen states are one.
An edge carries how many terms of its state come before those behind it, so the sum along a
term's path is its place among the shard's terms. Edges are packed into displaced rows: a
step is one look-up at ``base[state] + byte``.

Whole texts are then streamed through the transducers: all words of a block take a step at a
time, and what comes out is counted per language, source and ordinal in the task before
anything is exchanged. Transducers are broadcast in passes of at most `PASS_BYTES`, which is
measured before they are collected; a larger vocabulary takes more passes over the texts.

The audit compares exact smoothed shares p = 1 + floor(10**9 * (count + 1) / (N + V)) by
f(p, q) = floor((p - q)**2 / q). Terms that neither of two sources has all give the same
value, and those that one of them has give a value per distinct count, so only terms that
both have are worked on term by term: inside a task, for the sources of one term, with sums
per pair of sources leaving it. A pair of sources of one language is a row of the result.

Null text, lang and source are the empty text. Every row is a document, repeated ids and rows
included; ids are not read. A group without terms, and a language that keeps none, have
pairs (value 0 if nothing is kept) but no terms. Very long texts are worked on in slices;
a term of any length takes part. Ties go to the smaller source or term. Empty tables give an
empty result. Further columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.shared import cut_lineage, numbered, table

MIN_DOCS = 3
TOP_TERMS = 200
UNIT = 1_000_000_000
# Terms of a shard, bytes of transducers that are broadcast at once.
SHARD_TERMS = 1 << 14
PASS_BYTES = 64 << 20
# What a task holds before it hands rows on: terms, counts, bytes of text, pairs of sources.
HELD_TERMS = 1 << 20
HELD_COUNTS = 1 << 21
BLOCK_BYTES = 4 << 20
BLOCK_PAIRS = 1 << 20
# Bytes of letters stay, A-Z become a-z, all others become spaces.
_FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def folded(text: str | None, most: int = BLOCK_BYTES):
    """The text's bytes with one space or more between terms, in slices that end between terms."""
    data = (text or "").encode().translate(_FOLD)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + most) if len(data) - start > most else -1
        end = len(data) if end < 0 else end
        yield data[start:end]
        start = end


class Transducer:
    """The minimal transducer of sorted distinct terms, as arrays."""

    def __init__(self, terms: list[bytes]):
        self.known: dict[tuple, int] = {}
        self.states: list[tuple[int, bytes, tuple[int, ...]]] = []
        self.below: list[int] = []
        open_states: list[list] = [[0, bytearray(), []]]
        before = b""
        for term in terms:
            same, most = 0, min(len(before), len(term))
            while same < most and before[same] == term[same]:
                same += 1
            self._freeze(open_states, same + 1)
            for byte in term[same:]:
                open_states[-1][1].append(byte)
                open_states.append([0, bytearray(), []])
            open_states[-1][0] = 1
            before = term
        self._freeze(open_states, 1)
        self.root = self._number(open_states[0])
        del self.known

    def _number(self, state: list) -> int:
        key = (state[0], bytes(state[1]), tuple(state[2]))
        number = self.known.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(key)
            self.below.append(key[0] + sum(self.below[c] for c in key[2]))
        return number

    def _freeze(self, open_states: list, keep: int) -> None:
        while len(open_states) > keep:
            number = self._number(open_states.pop())
            open_states[-1][2].append(number)

    def arrays(self) -> dict[str, np.ndarray]:
        """base and final by state; check, target and skip by slot."""
        base = np.full(len(self.states), 256, np.int32)
        taken = bytearray(1024)
        owner: list[tuple[int, int, int, int]] = []
        first_free = 256
        taken[:256] = b"\x01" * 256
        for state in sorted((i for i, s in enumerate(self.states) if s[1]), key=lambda i: -len(self.states[i][1])):
            final, labels, children = self.states[state]
            at = first_free
            for attempt in range(1 << 62):
                at = taken.find(0, at)
                if at < 0:
                    at = len(taken)
                if at + 512 > len(taken):
                    taken.extend(bytes(len(taken)))
                row = at - labels[0]
                if not any(taken[row + b] for b in labels[1:]):
                    break
                at += 1
                if attempt == 64:  # what stays free is left to states with one edge
                    at = taken.rfind(1) + 1
            base[state] = row
            before = final
            for byte, child in zip(labels, children):
                taken[row + byte] = 1
                owner.append((row + byte, state, child, before))
                before += self.below[child]
            if len(labels) == 1:
                first_free = at
        slots = int(base.max(initial=256)) + 256
        check, target, skip = np.full(slots, -1, np.int32), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        if owner:
            at, states, children, before = (np.array(x) for x in zip(*owner))
            check[at], target[at], skip[at] = states, children, before
        final = np.array([s[0] for s in self.states], np.int32)
        return {"base": base, "final": final, "check": check, "target": target, "skip": skip}


_PARTS = ("base", "final", "check", "target", "skip")


def to_bytes(terms: list[bytes]) -> bytes:
    """A shard's transducer: sizes and root, then its arrays."""
    made = Transducer(terms)
    parts = made.arrays()
    head = np.array([len(parts["base"]), len(parts["check"]), made.root], "<i4")
    return head.tobytes() + b"".join(parts[p].astype("<i4").tobytes() for p in _PARTS)


def _prefix(term: bytes) -> int:
    return int.from_bytes(term[:8].ljust(8, b"\0"), "big")


class Vocabulary:
    """Transducers of several shards side by side."""

    def __init__(self, shards: list[tuple[str, bytes, int, bytes]]):
        """shards: (lang, first term, first ordinal, transducer), sorted."""
        parts: dict[str, list[np.ndarray]] = {p: [] for p in _PARTS}
        self.langs: dict[str, list[list[int]]] = {}
        states = slots = 0
        for lang, first, ordinal, blob in shards:
            n, m, root = np.frombuffer(blob, "<i4", 3).tolist()
            flat = np.frombuffer(blob, "<i4", offset=12)
            for p, piece in zip(_PARTS, np.split(flat, np.cumsum([n, n, m, m]))):
                parts[p].append(piece + {"base": slots, "target": states}.get(p, 0) if p != "check" else np.where(piece < 0, -1, piece + states))
            self.langs.setdefault(lang, []).append([_prefix(first), root + states, ordinal])
            states, slots = states + n, slots + m
        for p in _PARTS:
            setattr(self, p, np.concatenate(parts[p]).astype(np.int32) if shards else np.zeros(0, np.int32))
        self.shards = {lang: (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows], np.int64)) for lang, rows in self.langs.items()}
        del self.langs

    def walk(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """The place of each word among the terms behind its root, -1 for other words."""
        out = np.full(len(starts), -1, np.int64)
        at, place, end, state = np.arange(len(starts)), starts, ends, roots
        total = np.zeros(len(starts), np.int32)
        while len(at):
            slot = self.base[state] + data[place]
            good = self.check[slot] == state
            at, place, end, slot, total = at[good], place[good] + 1, end[good], slot[good], total[good]
            state, total = self.target[slot], total + self.skip[slot]
            over = place == end
            accepted = over & (self.final[state] == 1)
            out[at[accepted]] = total[accepted]
            on = ~over
            at, place, end, state, total = at[on], place[on], end[on], state[on], total[on]
        return out

    def ordinals(self, lang: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ordinals of words of a language, -1 for those it doesn't keep; data has 8 bytes more at its end."""
        found = np.full(len(starts), -1, np.int64)
        if lang not in self.shards or not len(starts):
            return found
        firsts, roots, bases = self.shards[lang]
        eight = np.lib.stride_tricks.sliding_window_view(data, 8)[starts] * (np.arange(8) < (ends - starts)[:, None])
        key = np.ascontiguousarray(eight.astype(np.uint8)).view(">u8").reshape(-1).astype(np.uint64)
        shard = np.searchsorted(firsts, key, "right") - 1
        lowest = np.maximum(np.searchsorted(firsts, key, "left") - 1, 0)
        open_words = np.flatnonzero(shard >= 0)
        while len(open_words):  # more than once only where a shard starts with the same eight bytes
            some = shard[open_words]
            place = self.walk(data, starts[open_words], ends[open_words], roots[some])
            hit = place >= 0
            found[open_words[hit]] = bases[some[hit]] + place[hit]
            rest = open_words[~hit]
            shard[rest] -= 1
            open_words = rest[shard[rest] >= lowest[rest]]
        return found


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, docs: the terms in at least ``min_docs`` documents of a language."""

    def scan(batches):
        held: dict[str, Counter] = {}
        size = 0

        def rows():
            for lang, counts in held.items():
                terms = pa.array(list(counts), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), terms, pa.array(list(counts.values()), pa.int64())], names=["lang", "term", "docs"])

        for batch in batches:
            for i in range(batch.num_rows):
                counts = held.setdefault(batch.column(0)[i].as_py(), Counter())
                size -= len(counts)
                distinct: set[bytes] = set()
                for piece in folded(batch.column(1)[i].as_py()):
                    distinct.update(piece.split())
                counts.update(distinct)
                size += len(counts)
                if size > HELD_TERMS:
                    yield from rows()
                    held, size = {}, 0
        yield from rows()

    found = docs.select("lang", "text").mapInArrow(scan, "lang string, term string, docs long")
    return found.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)


def shard_table(terms: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """lang, first, base, size, transducer of every shard of a (lang, term, ordinal) table."""

    def build(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("ordinal")
        sorted_terms = batch.column("term").cast(pa.binary()).to_pylist()
        blob = to_bytes(sorted_terms)
        lang, base = batch.column("lang")[0], batch.column("ordinal")[0]
        return pa.table({"lang": [lang.as_py()], "first": pa.array([sorted_terms[0]], pa.binary()), "base": [base.as_py()], "size": [len(blob)], "transducer": pa.array([blob], pa.binary())})

    shards = terms.withColumn("shard", F.expr(f"ordinal div {shard_terms}"))
    return shards.groupBy("lang", "shard").applyInArrow(build, "lang string, first binary, base long, size long, transducer binary")


def passes_of(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """First and last base of consecutive shards (base, size) of at most ``most`` bytes together."""
    out: list[tuple[int, int]] = []
    held = 0
    for base, size in sizes:
        if out and held + size <= most:
            out[-1], held = (out[-1][0], base), held + size
        else:
            out.append((base, base))
            held = size
    return out


def recount(docs: DataFrame, shards: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """lang, source, ordinal, count: what the transducers find in all texts; tasks give partial counts."""
    context = docs.sparkSession.sparkContext
    # One row per shard of many terms.
    sizes = [(r["base"], r["size"]) for r in shards.select("base", "size").orderBy("base").collect()]
    schema = "lang string, source string, ordinal long, count long"
    found = docs.sparkSession.createDataFrame([], schema)
    for first, last in passes_of(sizes, pass_bytes):
        some = shards.filter(F.col("base").between(first, last)).orderBy("base").collect()  # at most pass_bytes
        shared = context.broadcast(Vocabulary([(r["lang"], bytes(r["first"]), r["base"], bytes(r["transducer"])) for r in some]))

        def stream(batches, shared=shared):
            vocabulary = shared.value
            groups: dict[tuple[str, str], int] = {}
            held: list[tuple[np.ndarray, np.ndarray]] = []
            waiting: dict[str, list[tuple[bytes, int]]] = {}

            def merged():
                keys = np.concatenate([k for k, _ in held]) if held else np.zeros((0, 2), np.int64)
                counts = np.concatenate([c for _, c in held]) if held else np.zeros(0, np.int64)
                order = np.lexsort((keys[:, 1], keys[:, 0]))
                keys, counts = keys[order], counts[order]
                new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, np.int64)
                return keys[new], np.add.reduceat(counts, new) if len(new) else counts

            def count(lang: str):
                pieces = waiting.pop(lang)
                lengths = np.array([len(p) + 1 for p, _ in pieces])
                data = np.frombuffer(b" ".join(p for p, _ in pieces) + b" " * 9, np.uint8)
                letter = (data != 32).astype(np.int8)
                edges = np.flatnonzero(np.diff(letter, prepend=np.int8(0)))
                starts, ends = edges[0::2], edges[1::2]
                per_piece = np.diff(np.searchsorted(starts, np.r_[0, np.cumsum(lengths)]))
                group = np.repeat(np.array([g for _, g in pieces], np.int64), per_piece)
                ordinal = vocabulary.ordinals(lang, data, starts, ends)
                good = ordinal >= 0
                group, ordinal = group[good], ordinal[good]
                if len(group):
                    low, span = int(ordinal.min()), int(ordinal.max() - ordinal.min()) + 1
                    numbers, group = np.unique(group, return_inverse=True)
                    keys, counts = np.unique(group * span + (ordinal - low), return_counts=True)
                    held.append((np.stack([numbers[keys // span], keys % span + low], axis=1), counts))

            def rows():
                keys, counts = merged()
                held.clear()
                names = list(groups)
                pick = pa.array(keys[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n[0] for n in names], pa.string()).take(pick), pa.array([n[1] for n in names], pa.string()).take(pick), pa.array(keys[:, 1]), pa.array(counts)],
                    names=["lang", "source", "ordinal", "count"],
                )

            size = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    lang, source = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    if lang not in vocabulary.shards:
                        continue
                    group = groups.setdefault((lang, source), len(groups))
                    for piece in folded(batch.column(2)[i].as_py()):
                        waiting.setdefault(lang, []).append((piece, group))
                        size[lang] = size.get(lang, 0) + len(piece)
                        if size[lang] >= BLOCK_BYTES:
                            count(lang)
                            size[lang] = 0
                full = sum(len(c) for _, c in held) > HELD_COUNTS
                if full or sum(size.values()) >= 4 * BLOCK_BYTES:
                    for lang in list(waiting):
                        count(lang)
                    size = {}
                if full:
                    held[:] = [merged()]
                    if len(held[0][1]) > HELD_COUNTS // 2:
                        yield from rows()
                        groups.clear()
            for lang in list(waiting):
                count(lang)
            yield from rows()

        part = docs.select("lang", "source", "text").mapInArrow(stream, schema)
        found = part if first == sizes[0][0] else found.unionByName(part)
    return found


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / (n + v)) in whole numbers."""
    top = (count + 1).cast("decimal(20,0)") * F.lit(UNIT)
    return (F.call_function("div", top, (n + v).cast("decimal(20,0)")) + 1).cast("long")


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q) in whole numbers."""
    return F.call_function("div", (p - q) * (p - q), q)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def shared_sums(terms: DataFrame) -> DataFrame:
    """a, b, n, value: over the terms that both of two groups have, how many there are and the
    sum of f(p, q) - f(p, q0) - f(p0, q), where p0 and q0 are the shares of a count of 0.

    ``terms`` has an array of (g, p, p0) per term. Sums leave a task per block and pair.
    """

    def pairs(g, p, p0, lengths):
        starts = np.cumsum(lengths) - lengths
        others = np.repeat(lengths, lengths)  # partners of every entry
        left = np.repeat(np.arange(len(g)), others)
        first = np.repeat(np.cumsum(others) - others, others)
        right = np.repeat(np.repeat(starts, lengths), others) + np.arange(len(left)) - first
        return summed(g, p, p0, left, right)

    def summed(g, p, p0, left, right):
        unlike = left != right
        left, right = left[unlike], right[unlike]
        value = _gaps(p[left], p[right]) - _gaps(p[left], p0[right]) - _gaps(p0[left], p[right])
        names, local = np.unique(g, return_inverse=True)
        key = local[left] * len(names) + local[right]
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.r_[new, len(key)])
        total = np.add.reduceat(value, new) if len(new) else value
        return pa.RecordBatch.from_arrays([pa.array(names[key[new] // len(names)]), pa.array(names[key[new] % len(names)]), pa.array(n), pa.array(total)], names=["a", "b", "n", "value"])

    def work(batches):
        for batch in batches:
            lists = batch.column(0)
            if not len(lists):
                continue
            flat = lists.flatten()
            g, p, p0 = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
            row, begin = 0, 0
            while row < len(ends):
                lengths = np.diff(np.r_[begin, ends[row:]])
                rows = int(np.searchsorted(np.cumsum(lengths**2), BLOCK_PAIRS, "right"))
                if rows:
                    stop = int(ends[row + rows - 1])
                    yield pairs(g[begin:stop], p[begin:stop], p0[begin:stop], lengths[:rows])
                else:  # one term of very many groups, by slices of them
                    rows, stop = 1, int(ends[row])
                    step = max(1, BLOCK_PAIRS // (stop - begin))
                    for low in range(begin, stop, step):
                        mine = np.arange(low, min(low + step, stop)) - begin
                        yield summed(g[begin:stop], p[begin:stop], p0[begin:stop], np.repeat(mine, stop - begin), np.tile(np.arange(stop - begin), len(mine)))
                row, begin = row + rows, stop

    found = terms.select("entries").mapInArrow(work, "a long, b long, n long, value long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))


def pair_part(terms: DataFrame, groups: DataFrame, salt: int = 32) -> DataFrame:
    """lang, source, item, value for every two different groups of one language."""
    entries = terms.select(F.inline("entries"))
    steps = entries.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"))
    known = groups.select("g", "lang", "source", "p0", "v")
    # A language's groups meet all its steps; steps are salted and groups copied to every salt.
    steps = steps.join(known.select("g", "lang"), "g").withColumn("salt", F.pmod(F.xxhash64("g", "p"), F.lit(salt)))
    copies = known.select(F.col("g").alias("h"), F.col("lang"), F.col("p0").alias("q0")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
    met = steps.join(copies, ["lang", "salt"]).filter("g <> h")
    own = F.struct(F.col("g").alias("a"), F.col("h").alias("b"), (F.col("n") * _gap(F.col("p"), F.col("q0"))).alias("value"), F.col("n").alias("n"))
    theirs = F.struct(F.col("h").alias("a"), F.col("g").alias("b"), (F.col("n") * _gap(F.col("q0"), F.col("p"))).alias("value"), F.col("n").alias("n"))
    one_sided = met.select(F.inline(F.array(own, theirs))).groupBy("a", "b").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    # Terms of one group or of both are counted twice in n where both have them.
    both = shared_sums(terms).select("a", "b", F.col("n").alias("both"), F.col("value").alias("extra"))
    left = known.select(F.col("g").alias("a"), "lang", "source", F.col("p0").alias("p"), "v")
    right = known.select(F.col("g").alias("b"), "lang", F.col("source").alias("item"), F.col("p0").alias("q"))
    pairs = left.join(right, "lang").filter("a <> b").join(one_sided, ["a", "b"], "left").join(both, ["a", "b"], "left")
    zero = F.lit(0).cast("long")
    neither = F.col("v") - F.coalesce("n", zero) + F.coalesce("both", zero)
    value = neither * _gap(F.col("p"), F.col("q")) + F.coalesce("value", zero) + F.coalesce("extra", zero)
    return pairs.select("lang", "source", "item", F.when(F.col("v") > 0, value).otherwise(zero).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, shard_terms: int = SHARD_TERMS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank of a documents table."""
    plain = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    terms = numbered(kept_terms(plain, min_docs), [F.col("lang"), F.col("term")], "ordinal")
    terms = cut_lineage(terms.select("lang", "term", "ordinal"))
    shards = cut_lineage(shard_table(terms, shard_terms))
    counts = recount(plain, shards, pass_bytes).repartition("ordinal")
    counts = cut_lineage(counts.groupBy("ordinal", "lang", "source").agg(F.sum("count").alias("count")))

    sizes = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = plain.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").fillna({"n": 0})
    whole = groups.groupBy("lang").agg(F.sum("n").alias("lang_n")).join(kept, "lang", "left").fillna({"v": 0})
    groups = numbered(groups.join(whole, "lang"), [F.col("lang"), F.col("source")], "g")
    groups = cut_lineage(groups.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("n"), F.col("v"))).otherwise(1)))

    known = counts.join(groups.select("lang", "source", "g", "n", "v", "lang_n", "p0"), ["lang", "source"])
    entry = F.struct("g", _share(F.col("count"), F.col("n"), F.col("v")).alias("p"), "p0")
    by_term = known.groupBy("ordinal").agg(
        F.collect_list(entry).alias("entries"),
        _share(F.sum("count"), F.first("lang_n"), F.first("v")).alias("q"),
    )
    by_term = cut_lineage(by_term, frees=[counts])

    def ranked(rows: DataFrame, by: list[str], tie: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("value").desc(), tie))
        return rows.withColumn("rank", place)

    pairs = ranked(pair_part(by_term, groups), ["lang", "source"], "item").select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    each = by_term.select("ordinal", "q", F.inline("entries")).filter("p > q").select("g", "ordinal", _gap(F.col("p"), F.col("q")).alias("value"))
    best = ranked(each, ["g"], "ordinal").filter(F.col("rank") <= top)
    best = best.join(terms.select("ordinal", F.col("term").alias("item")), "ordinal").join(groups.select("g", "lang", "source"), "g")
    return pairs.unionByName(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op12_source_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS MATERIALIZED (
  SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
), k AS MATERIALIZED (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(*) >= 3
), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (
  SELECT lang, source, term, sum(n)::BIGINT AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term
), f AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS MATERIALIZED (
  SELECT lang, source, term, f.n AS n,
         (1 + 1000000000::HUGEINT * (f.n + 1) // (sum(f.n) OVER (PARTITION BY lang, source) + v.v)) AS p
  FROM f JOIN v USING (lang)
), q AS (
  SELECT lang, term, (1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang) + v.v)) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM f GROUP BY lang, term) JOIN v USING (lang)
), a AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
) WHERE part = 'pair' OR rank <= 200
"""
