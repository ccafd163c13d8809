"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshloom.session import cut_lineage

# A word: a run without the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` plus ``out``: each row's place from 0 in ``order``, without a global window.

    The rows are range partitioned and written; only the row counts of the partitions are
    summed up in one place. Meant for unique keys: equal keys share a partition.
    """
    spread = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the exchange above, so its size is bounded by their number.
    base = parts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        spread.withColumn(out, inside.cast("long") - 1)
        .join(F.broadcast(base), "_part")
        .withColumn(out, F.col(out) + F.col("_base"))
        .drop("_part", "_base")
    )
