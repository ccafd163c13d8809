"""Finding benchmark passages in documents: Wu-Manber search for many patterns at once, over words.

A symbol is a word: A-Z in lower case, then runs of digits, letters a-z and everything from
U+0080 up. A window is ``width`` consecutive words of an item; an item with fewer words, but
not none, is one window. Windows of one length form a class with three tables:

* SHIFT, by a hash of a block of two words: how far every window lets the search move when
  that block stands at its end. Blocks of no window, and words of no item, move it furthest.
* HASH, by a hash of a window's last words: the windows to test where the shift is zero, with
  a hash of their first words beside it.
* The windows' words themselves, which are compared directly before anything counts as found.

Items are cut into pieces that overlap by ``width - 1`` words and dealt to blocks whose size
is measured; only a block is collected and broadcast at a time, and the documents are
searched once for every block. Documents are never exchanged. With one block, the usual
case, a search is a single pass of the scan.

Null texts have no words. Every row is a document of its own, also one that repeats an id or
has none; very long texts are split into words by slices, so only a number per word is held
of a whole text. Rows of one item id are one item, an item without an id is named ''. A window
of many items names them all. Empty tables give rows without hits, or no rows. Columns named
like an added one (`ADDED`) are replaced, all others stay.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.shared import cut_lineage, table

WIDTH = 10
# Bytes of item words in a block, which bound what is collected and broadcast at once, and
# the words of a piece.
BLOCK_BYTES = 16 << 20
PIECE_WORDS = 4096
SUFFIX_WORDS = 4
SLICE_BYTES = 1 << 20
ADDED = ("n_words", "hit_spans", "items")
# Multipliers of the hashes.
_A, _B, _H, _LOW = 0x9E3779B1, 0x85EBCA77, 0x9E3779B97F4A7C15, (1 << 64) - 1
# Bytes of words stay, A-Z become a-z, all others become spaces.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def text_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def word_numbers(text: str | None, number) -> array:
    """One number per word of a text, 0 for words of no item."""
    data = (text or "").encode().translate(_FOLD)
    out, start = array("i"), 0
    while start < len(data):
        end = data.find(b" ", start + SLICE_BYTES) if len(data) - start > SLICE_BYTES else -1
        end = len(data) if end < 0 else end
        out.extend(map(number, data[start:end].split(), repeat(0)))
        start = end
    return out


def _rolled(numbers) -> int:
    h = 0
    for x in numbers:
        h = (h * _H + x + 1) & _LOW
    return h


class WindowClass:
    """The tables of all windows of ``m`` words that start at ``starts`` of ``flat``."""

    def __init__(self, flat: array, starts: np.ndarray, m: int):
        words = np.frombuffer(flat, np.int32).astype(np.uint64)
        self.m, self.flat = m, flat
        self.suffix = min(SUFFIX_WORDS, m)
        size = 1 << max(10, (8 * len(starts)).bit_length())
        self.mask = size - 1
        furthest = m - 1 if m > 1 else 1
        shift = np.full(size, min(furthest, 255), np.uint8)
        for back in range(m - 2, -1, -1):  # nearer the end comes later and wins
            end = starts + m - 1 - back
            block = (words[end - 1] * np.uint64(_A)) ^ (words[end] * np.uint64(_B))
            shift[(block & np.uint64(self.mask)).astype(np.int64)] = min(back, 255)
        self.shift = shift.tobytes()
        with np.errstate(over="ignore"):
            first, last = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
            for k in range(m):
                side = first if k < m - self.suffix else last
                side *= np.uint64(_H)
                side += words[starts + k] + np.uint64(1)
        order = np.lexsort((starts, first, last))
        self.last, self.first, self.places = (array(t, x[order].tobytes()) for t, x in (("Q", last), ("Q", first), ("q", starts)))

    def search(self, text: array, hit: bytearray, found: set[int]) -> None:
        """Marks the words of every occurrence and adds the windows' places to ``found``."""
        m, shift, mask, suffix, last, n = self.m, self.shift, self.mask, self.suffix, self.last, len(text)
        i = m - 1
        while i < n:
            b = text[i]
            if not b:
                i += m
                continue
            if m > 1:
                step = shift[((text[i - 1] * _A) ^ (b * _B)) & mask]
                if step:
                    i += step
                    continue
            tail = _rolled(text[i - suffix + 1 : i + 1])
            at = bisect_left(last, tail)
            if at < len(last) and last[at] == tail:
                head = _rolled(text[i - m + 1 : i - suffix + 1])
                stop = bisect_right(last, tail, at)
                at = bisect_left(self.first, head, at, stop)
                window = text[i - m + 1 : i + 1]
                while at < stop and self.first[at] == head:
                    place = self.places[at]
                    if self.flat[place : place + m] == window:
                        hit[i - m + 1 : i + 1] = b"\x01" * m
                        if place in found:  # so are all other places of this window
                            break
                        found.add(place)
                    at += 1
            i += 1


class Patterns:
    """All classes of a block of item pieces, given as (item, words joined by spaces)."""

    def __init__(self, pieces: list[tuple[str, bytes]], width: int):
        self.numbers: dict[bytes, int] = {}
        number = self.numbers.setdefault
        flat, ends, by_length = array("i"), [], {}
        for _, joined in pieces:
            begin = len(flat)
            flat.extend(number(w, len(self.numbers) + 1) for w in joined.split())
            ends.append(len(flat))
            m = min(width, len(flat) - begin)
            by_length.setdefault(m, []).append((begin, len(flat) - m + 1))
        self.flat, self.ends, self.items = flat, ends, [item for item, _ in pieces]
        self.classes = [WindowClass(flat, np.concatenate([np.arange(a, b) for a, b in spans]), m) for m, spans in sorted(by_length.items()) if m]

    def search(self, text: str | None) -> tuple[int, bytearray, set[str]]:
        """Words, a mark per hit word (empty without hits), and the items found in a text."""
        numbers = word_numbers(text, self.numbers.get)
        hit, found = bytearray(len(numbers)), set()
        for windows in self.classes:
            windows.search(numbers, hit, found)
        return len(numbers), hit if found else bytearray(), {self.items[bisect_right(self.ends, place)] for place in found}


def spans_of(hit: bytearray) -> list[tuple[int, int]]:
    """The runs of marked words."""
    out, at = [], hit.find(1)
    while at >= 0:
        end = hit.find(0, at)
        end = len(hit) if end < 0 else end
        out.append((at, end))
        at = hit.find(1, end)
    return out


def item_pieces(benchmark: DataFrame, width: int, item_id: str, text: str, piece_words: int) -> DataFrame:
    """item, words: overlapping pieces of the items' words, each once."""

    def cut(batches):
        for batch in batches:
            names, pieces = [], []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text_words(value)
                for start in range(0, max(1, len(words) - width + 1), piece_words):
                    if words:
                        names.append(name)
                        pieces.append(b" ".join(words[start : start + piece_words + width - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pieces, pa.binary())], names=["item", "words"])

    named = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return named.mapInArrow(cut, "item string, words binary").distinct()


def blocks_of(pieces: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """``pieces`` with a block number, and how many blocks; each is measured to hold at most ``block_bytes`` or one piece."""
    size = F.length("words") + F.length("item")
    total = pieces.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    while True:
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).cast("int"))
        if blocks == 1:
            return dealt, blocks
        sums = dealt.groupBy("block").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n"))
        if sums.filter((F.col("bytes") > block_bytes) & (F.col("n") > 1)).isEmpty():
            return dealt, blocks
        blocks *= 2


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    item_id: str = "item_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    piece_words: int = PIECE_WORDS,
) -> DataFrame:
    """``docs`` plus n_words, hit_spans (runs of hit words, end exclusive) and items (found ids as strings, sorted)."""
    context = docs.sparkSession.sparkContext
    pieces, blocks = blocks_of(cut_lineage(item_pieces(benchmark, width, item_id, text, piece_words)), block_bytes)
    plain = docs.drop(*ADDED)
    names = plain.columns
    text_at = names.index("text")
    kinds = "array<struct<start: int, end: int>>"
    found = plain.withColumns({"n_words": F.lit(0).cast("long"), "hit_spans": F.array().cast(kinds), "items": F.array().cast("array<string>")})
    schema = found.schema
    spans_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    earlier = None
    for block in range(blocks):
        some = pieces.filter(F.col("block") == block).select("item", "words").collect()  # at most block_bytes
        shared = context.broadcast([(r["item"], bytes(r["words"])) for r in some])

        def search(batches, shared=shared):
            patterns = Patterns(shared.value, width)
            for batch in batches:
                counts, spans, items = [], [], []
                for i in range(batch.num_rows):
                    n, hit, now = patterns.search(batch.column(text_at)[i].as_py())
                    before = batch.column(len(names) + 1)[i].as_py()
                    if before:
                        hit = hit or bytearray(n)
                        for s in before:
                            hit[s["start"] : s["end"]] = b"\x01" * (s["end"] - s["start"])
                    counts.append(n)
                    spans.append([{"start": a, "end": b} for a, b in spans_of(hit)])
                    items.append(sorted(now.union(batch.column(len(names) + 2)[i].as_py())))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(names)], pa.array(counts, pa.int64()), pa.array(spans, spans_kind), pa.array(items, pa.list_(pa.string()))],
                    names=[*names, *ADDED],
                )

        found = found.mapInArrow(search, schema)
        if block + 1 < blocks:
            found = earlier = cut_lineage(found, frees=[earlier])
    return found


def op11_benchmark_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_items(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), p AS MATERIALIZED (
  SELECT DISTINCT item, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
  FROM (SELECT item, w, least(len(w), 10) AS m, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), t AS (
  SELECT r, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
  FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM p))
), h AS MATERIALIZED (SELECT DISTINCT r, i, t.m, item FROM t JOIN p USING (m, win)),
n AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS place FROM h) GROUP BY r
), s AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)
"""
