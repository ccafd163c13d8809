"""From raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as
Parquet and read again as the next stage's docs. All stages but the last return the columns
of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm import linededup, mixing, neardup, packing, quality
from meshloom.llm.shared import cut_lineage, table

# The result is made of token ids, which SQL cannot express.
ORACLE_SQL = None


# Words of a shingle of the near-duplicate stage, the usual five; the operator's own query is
# asked for four. Similarity as in the operator, 0.8.
SHINGLE_WORDS = 5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or the risk-controlled cutoffs reject.

    A null text has no words and goes. Every row is judged on its own text, repeated ids too.
    """
    judged = quality.quality_rules(docs, table(spark, sf_dir, "labels"))
    return judged.filter("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines that ten documents or more share out of every text.

    Null texts stay null. Rows of one id lose the same lines; ties do not arise.
    """
    shorter = linededup.dedup_lines(docs).select(*docs.columns)
    return shorter.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else shorter


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, the one with the smallest id.

    Of several rows with that id the one with the smallest text stays, null first, then by the
    other columns. Rows without an id stay. Repeated rows, ties and empty tables need no more.
    """
    found = neardup.near_duplicates(docs, SHINGLE_WORDS)
    stay = found.filter("kept and doc_id is not null").select("doc_id").distinct()
    order = ["text", *(c for c in docs.columns if c not in ("doc_id", "text"))]
    kept = docs.join(stay, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*order)).alias("row"))
    return kept.select("doc_id", "row.*").unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources reach their target weights.

    A null text has size 0 and a null source is the last one; rows of no size are left out.
    """
    sized = cut_lineage(docs.withColumn("_size", mixing.text_size(F.col("text"))))
    mixed = mixing.mix(sized, size="_size")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return mixed.filter(F.col("copies") > 0).withColumn("_copy", copies).select(*docs.columns)


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of at most 1024."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_filter),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("token packing", token_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), frees=[docs])
    return STAGES[-1][1](spark, docs, sf_dir)
