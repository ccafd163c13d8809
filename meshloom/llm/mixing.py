"""Mixing sources to target weights by systematic sampling.

Every source gets a target size; each of its documents is expected target / source size
times. The documents of a source are laid out in a fixed order, their expected copies are
summed up from the left, one offset per source is added, and a document is emitted once per
whole number that its interval crosses. Expected copies are whole multiples of 2**-24, so
the sums are exact and reruns agree.

The order is by size class first (eight classes per power of two), then by a digest of the
document id: each class is then sampled in proportion, which keeps the taken words near the
target. Places in that order come from counts per (source, class, digest prefix); longer
prefixes are used for more documents, so that no group is sorted in one task, however hot a
source is. Nothing but built-in functions is used.

Null sources form one source of their own, after all others. Null texts have size 0. Rows
are judged one by one, so repeated rows and repeated ids count as often as they appear. An
empty table gives an empty result. Columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.shared import WORD, cut_lineage, numbered, table

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)
LIMIT = 2
SEED = 17
# One expected copy.
UNIT_BITS = 24
ROWS_PER_CELL = 20_000


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _digest_bits(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, limit=LIMIT) -> DataFrame:
    """``sizes`` (_source, source, source_size) plus target.

    ``weights`` repeat over the sources in code-point order, null last. The sources share
    ``share`` of all sizes; a target stops at ``limit`` times its source's size, and what is
    left over is shared again by weight until none is above. Only three totals per round
    reach the driver.
    """
    placed = numbered(sizes, [F.col("source").asc_nulls_last()], "_place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    placed = cut_lineage(
        placed.withColumns({"_weight": weight.cast("long"), "_cap": (F.col("source_size") * limit).cast("long")}).drop("_place")
    )
    numerator, denominator = share
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    capped_size, open_weight, capped = 0, None, -1
    target = None
    while True:
        if open_weight is None:
            open_weight = placed.agg(F.sum("_weight")).first()[0] or 0
        rest = numerator * total - denominator * capped_size
        level = F.lit(float(rest)) * F.col("_weight") / F.lit(float(denominator * max(open_weight, 1)))
        full = F.col("_cap").cast("double") <= level
        target = F.when(full, F.col("_cap").cast("double")).otherwise(level)
        row = placed.agg(
            F.count_if(full).alias("n"),
            F.sum(F.when(full, F.col("_cap"))).alias("size"),
            F.sum(F.when(~full, F.col("_weight"))).alias("weight"),
        ).first()
        if row["n"] == capped or not row["weight"]:
            break
        capped, capped_size, open_weight = row["n"], row["size"] or 0, row["weight"]
    return placed.withColumn("target", target).drop("_weight", "_cap")


def mix(docs: DataFrame, size: str = "size", weights=WEIGHTS, share=SHARE, limit=LIMIT, seed: int = SEED) -> DataFrame:
    """``docs`` plus source_size, target and copies, how often the mix takes the row.

    ``docs`` needs doc_id, source and the column ``size`` of whole numbers. All columns move
    through one shuffle.
    """
    length = F.length(F.bin(F.col(size)))
    top = F.call_function("shiftright", F.col(size), F.greatest(length - 4, F.lit(0)))
    rows = docs.drop("source_size", "target", "copies").withColumns(
        {
            "_source": _source_key(F.col("source")),
            "_class": length * 8 + top.bitwiseAND(F.lit(7)).cast("int"),
            "_digest": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
        }
    )
    groups = cut_lineage(
        rows.groupBy("_source", "source", "_class", F.substring("_digest", 1, 4).alias("_prefix")).agg(
            F.count(F.lit(1)).alias("_rows"), F.sum(size).alias("_size")
        )
    )
    count = groups.agg(F.sum("_rows")).first()[0] or 0
    digits = 1
    while digits < 4 and count > ROWS_PER_CELL * 16**digits:
        digits += 1
    cells = groups.groupBy("_source", "_class", F.substring("_prefix", 1, digits).alias("_cell")).agg(F.sum("_rows").alias("_rows"))
    earlier = Window.unboundedPreceding, -1

    def running(column: str, order: str, *by: str) -> Column:
        return F.coalesce(F.sum(column).over(Window.partitionBy(*by).orderBy(order).rowsBetween(*earlier)), F.lit(0))

    classes = cells.groupBy("_source", "_class").agg(F.sum("_rows").alias("_rows"))
    classes = classes.select("_source", "_class", running("_rows", "_class", "_source").alias("_classes"))
    sizes = groups.groupBy("_source", "source").agg(F.sum("_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, limit).drop("source")
    ratio = F.least(F.col("target") / F.col("source_size"), F.lit(float(limit)))
    targets = targets.withColumns(
        {
            "_each": F.when(F.col("source_size") > 0, F.floor(ratio * F.lit(float(1 << UNIT_BITS)))).otherwise(F.lit(0)).cast("long"),
            "_offset": _digest_bits(F.concat(F.lit(f"{seed}:"), "_source"), UNIT_BITS // 4),
        }
    )
    cells = (
        cells.withColumn("_cells", running("_rows", "_cell", "_source", "_class"))
        .drop("_rows")
        .join(classes, ["_source", "_class"])
        .join(targets, "_source")
        .withColumn("_before", F.col("_cells") + F.col("_classes"))
        .drop("_cells", "_classes")
    )
    inside = Window.partitionBy("_source", "_class", "_cell").orderBy("_digest", "doc_id", size)
    placed = rows.withColumn("_cell", F.substring("_digest", 1, digits)).withColumn("_row", F.row_number().over(inside).cast("long"))
    placed = placed.join(cells, ["_source", "_class", "_cell"])
    end = (F.col("_before") + F.col("_row")) * F.col("_each") + F.col("_offset")
    crossed = lambda at: F.call_function("shiftright", at, F.lit(UNIT_BITS))
    placed = placed.withColumn("copies", crossed(end) - crossed(end - F.col("_each")))
    return placed.drop(*[c for c in placed.columns if c.startswith("_") and c not in docs.columns])


def op4_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", text_size(F.col("text")).alias("size"))
    return mix(cut_lineage(docs)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS s,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), g AS (
  SELECT s, source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1, 2
), w AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w FROM g
), c AS (
  SELECT *, 3 * sum(source_size) OVER () - 2 * coalesce(sum(2 * source_size) OVER f, 0) AS rest, sum(w) OVER t AS open
  FROM w
  WINDOW f AS (ORDER BY source_size / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         t AS (ORDER BY source_size / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), k AS (
  SELECT *, 2.0::DOUBLE * source_size <= rest::DOUBLE * w / (2 * open)::DOUBLE AS full_ FROM c
), l AS (
  SELECT 3 * sum(source_size) - 2 * coalesce(sum(2 * source_size) FILTER (full_), 0) AS rest,
         sum(w) FILTER (NOT full_) AS open
  FROM k
), targets AS (
  SELECT k.s, k.source_size,
         CASE WHEN full_ THEN (2 * source_size)::DOUBLE ELSE l.rest::DOUBLE * w / (2 * l.open)::DOUBLE END AS target
  FROM k, l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(least(target / source_size, 2.0) * 16777216)::BIGINT ELSE 0 END AS each_,
         ('0x' || substr(md5('17:' || s), 1, 6))::BIGINT AS offset_
  FROM targets
), p AS (
  SELECT doc_id, size, s,
         row_number() OVER (PARTITION BY s ORDER BY length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)) & 7),
                            md5(coalesce(doc_id::VARCHAR, '')), doc_id, size) AS r
  FROM d
)
SELECT doc_id, size, source_size, target,
       size * (((r * each_ + offset_) >> 24) - (((r - 1) * each_ + offset_) >> 24)) AS taken
FROM p JOIN e USING (s)
"""
