"""Packing token ids: concatenate all documents and cut the stream into fixed windows.

Texts are tokenised once and written with their place inside their partition. The token
totals of the partitions are summed up (one row per partition), which gives every document
its global offset. Each task then cuts its documents at multiples of the window: sequence
ids and offsets follow from the global offset alone, so a window that spans partitions needs
no exchange for its pieces. `sequences` joins such boundary pieces and pads.

Every sequence but the last is full; the last is padded to the next power of two.

A null text is an empty one: its document is the single end id. Repeated rows are packed as
often as they appear. An empty table gives an empty result. Only doc_id and the text column
are read; other columns are ignored.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.shared import cut_lineage, table

WINDOW = 1024
END_ID = 0
# Characters of text that are encoded at once.
SLICE_CHARS = 8_000_000
# Fixed value: how this vocabulary splits text before it merges bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable bytes for
    themselves, the others in turn from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PieceEncoder:
    """Encodes many texts by their distinct pieces.

    A byte-level tokenizer never joins a space with the character before it, unless that is
    white space too. So a text is cut before every space, equal pieces are encoded once, and
    ids are put together by position. Texts with white space before a space, or with a special
    token's string, are encoded whole.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        alphabet = _byte_alphabet()
        special = [t["content"] for t in model["added_tokens"]]
        tokens = {bytes(map(alphabet.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.whole = Tokenizer.from_file(path)
        # The same vocabulary by rank; its ids are the tokenizer's, as the tests check.
        self.fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=tokens, special_tokens={})
        self.width = np.zeros(max(tokens.values()) + 1, np.int64)
        for token, i in tokens.items():
            self.width[i] = len(token)
        self.odd = re.compile("|".join([r"[\s\x1c-\x1f\x85] ", *map(re.escape, special)]))

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of " " + piece for all pieces, one after the other, and their numbers."""
        # Pieces that are empty or end in white space cannot stand before another one.
        joins = pc.match_substring_regex(pieces, r"[^\s\x0b\x1c-\x1f\x{85}\pZ]$").to_numpy(zero_copy_only=False)
        where, apart = np.flatnonzero(joins), np.flatnonzero(~joins)
        together = pieces.take(pa.array(where)) if len(apart) else pieces
        flat = self._ids("".join([" ", " ".join(together.to_pylist())])) if len(where) else np.zeros(0, np.uint32)
        sizes = pc.binary_length(together).to_numpy().astype(np.int64) + 1
        lengths = np.zeros(len(pieces), np.int64)
        bounds = np.searchsorted(np.cumsum(self.width[flat]), np.cumsum(sizes)) + 1
        lengths[where] = np.diff(bounds, prepend=0)
        if len(apart):
            alone = [self._ids(" " + t) for t in pieces.take(pa.array(apart)).to_pylist()]
            lengths[apart] = [len(x) for x in alone]
            start = np.cumsum(lengths) - lengths
            ids, flat = flat, np.zeros(int(lengths.sum()), np.uint32)
            flat[_spread(start[where], lengths[where])] = ids
            flat[_spread(start[apart], lengths[apart])] = np.concatenate(alone)
        return flat, lengths

    def _ids(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = [bool(self.odd.search(t)) for t in texts]
        split = pc.split_pattern(pa.array(["" if o else t for o, t in zip(odd, texts)], pa.string()), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        values = split.values.dictionary_encode()
        flat, lengths = self._pieces(values.dictionary)
        found = values.indices.to_numpy().astype(np.int64)
        n = lengths[found]
        # The first piece of a text has no space before it.
        heads = [self._ids(t) for t in split.values.take(pa.array(offsets[:-1])).to_pylist()]
        n[offsets[:-1]] = 0
        stream = flat[_spread((np.cumsum(lengths) - lengths)[found], n)]
        bounds = np.concatenate([[0], np.cumsum(n)])[offsets]
        out = [np.concatenate([h, stream[a:b]]) for h, a, b in zip(heads, bounds[:-1].tolist(), bounds[1:].tolist())]
        for i, o in enumerate(odd):
            if o:
                out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def _slices(texts: list[str]):
    """Ranges of texts with about SLICE_CHARS characters each."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE_CHARS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def tokenized(docs: DataFrame, path: str, text: str = "text", end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), and each row's place: part, row, ids before it in the part."""

    def encode(batches):
        from pyspark import TaskContext

        part, row, before = TaskContext.get().partitionId(), 0, 0
        encoder = PieceEncoder(path)
        for batch in batches:
            doc_ids = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _slices(texts):
                ids = [np.append(x, np.uint32(end_id)) for x in encoder.encode(texts[a:b])]
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                starts = before + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.slice(a, b - a),
                        pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                        pa.array(n),
                        pa.array(np.full(len(ids), part, np.int32)),
                        pa.array(row + np.arange(len(ids))),
                        pa.array(starts),
                    ],
                    names=["doc_id", "ids", "doc_tokens", "part", "row", "before"],
                )
                row, before = row + len(ids), before + int(n.sum())

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids binary, doc_tokens long, part int, row long, before long"
    return docs.select("doc_id", text).mapInArrow(encode, schema)


def pack(docs: DataFrame, path: str, window: int = WINDOW, text: str = "text", end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ids holds the piece's ids as little-endian unsigned 32-bit numbers.
    """
    rows = cut_lineage(tokenized(docs, path, text, end_id))
    totals = rows.groupBy("part").agg(F.max(F.col("before") + F.col("doc_tokens")).alias("total"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per input partition, so its size is bounded by their number.
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    placed = rows.join(F.broadcast(bases), "part").select(
        "doc_id", "ids", "doc_tokens", (F.col("base") + F.col("before")).alias("at")
    )

    def cut(batches):
        for batch in batches:
            at = batch.column(3).to_numpy()
            n = batch.column(2).to_numpy()
            pieces = (at + n - 1) // window - at // window + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = at[doc] // window + nth
            begin = np.maximum(sequence * window, at[doc])
            end = np.minimum((sequence + 1) * window, at[doc] + n[doc])
            ids = batch.column(1)
            views = [memoryview(ids[i].as_buffer()) for i in range(len(n))]
            start, length = begin - at[doc], end - begin
            cuts = [views[d][4 * s : 4 * (s + m)] for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(doc)),
                    pa.array(start),
                    pa.array(length),
                    pa.array([bytes(c) for c in cuts], pa.binary()),
                    pa.array(n[doc]),
                    pa.array(sequence),
                    pa.array(begin - sequence * window),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(cut, schema)


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """sequence_id, tokens (ids, binary), length, padded: the pieces of each window joined.

    A group is at most one window. The padded size is the window, or the next power of two
    where less is filled.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    grouped = pieces.groupBy("sequence_id").agg(joined.alias("tokens"), F.sum("length").alias("length"))
    power = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("length")))).cast("long")
    return grouped.withColumn("padded", F.least(F.lit(window).cast("long"), power))


def op10_pack_tokens(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
