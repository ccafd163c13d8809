"""Transient memory of the assembly methods, estimated before running them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.functions.text import memory_string
from meshloom.model import MeshFrames

# Bytes per contribution, per owner task, per private value, and per
# element for its colour and its group entry.
COO_ENTRY_BYTES = 16
OWNER_TASK_BYTES = 12
VALUE_BYTES = 8
COLOR_BYTES = 8


def assembly_cost(mesh: MeshFrames, nnz: int, threads: int, limit_bytes: int) -> DataFrame:
    """(algorithm, bytes, status, message) from one aggregate over the elements."""
    width = F.size("nodes").cast("long") * 3
    totals = mesh.elements.agg(
        F.count(F.lit(1)).alias("elements"), F.coalesce(F.sum(width * width), F.lit(0).cast("long")).alias("entries")
    )
    zero = F.lit(0).cast("long")
    estimates = [
        ("cpu_serial", zero),
        ("cpu_atomic", zero),
        ("cpu_private_csr", F.lit(VALUE_BYTES * threads * nnz).cast("long")),
        ("cpu_coo_sort_reduce", F.col("entries") * COO_ENTRY_BYTES),
        ("cpu_graph_coloring", F.col("elements") * COLOR_BYTES),
        ("cpu_row_owner", F.col("entries") * OWNER_TASK_BYTES),
    ]
    # Colouring has no admission check; it is listed for its size only.
    checked = F.col("algorithm") != "cpu_graph_coloring"
    rows = totals.select(
        F.inline(F.array(*[F.struct(F.lit(name).alias("algorithm"), size.alias("bytes")) for name, size in estimates]))
    )
    above = checked & (F.col("bytes") > F.lit(limit_bytes))
    message = F.concat(
        F.col("algorithm"),
        F.when(F.col("algorithm") == "cpu_private_csr", F.lit(" requires ")).otherwise(F.lit(" requires about ")),
        memory_string(F.col("bytes")),
        F.lit(" transient memory, above limit "),
        memory_string(F.lit(limit_bytes).cast("long")),
    )
    return rows.select(
        "algorithm",
        "bytes",
        F.when(above, F.lit("SKIP")).otherwise(F.lit("PASS")).alias("status"),
        F.when(above, message).otherwise(F.lit("")).alias("message"),
    )
