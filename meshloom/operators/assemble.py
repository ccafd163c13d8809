"""Assembly: sum element contributions into one global sparse matrix.

All methods return the same matrix; they differ in plan and guarantees:

``atomic``    one aggregate on node blocks (default)
``private``   two aggregates: private sums per element slice, then a merge; splits hot blocks
``serial``    bit-reproducible sums: any order of the elements gives the same doubles
``sorted``    the default sum, delivered range-partitioned and sorted like a CSR
``owner``     elements move to the owner of their rows, contributions never move
``coloring``  the same reproducible sums, element by conflict-free batch

All but ``owner``, which has ranges of its own, send elements to the tasks of their nodes (``shares``)
and sum whole rows of blocks there.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.functions.kernels import ElementKernel, simplified
from meshloom.model import BLOCK, MeshFrames
from meshloom.operators.contributions import BLOCK_ARRAY, PLACES, block_contributions, block_entries, blocks_of, prepared_elements
from meshloom.operators.shares import RowPlan, corner_pairs, corner_shares, hot_pairs, in_passes, plan_rows

KEYS = ["ni", "nj"]
# Bits of each of the two whole numbers that a value is split into; 2**33 values can be summed.
SPLIT_BITS = 30


def quantize(blocks: DataFrame, quanta: float | None) -> DataFrame:
    """Block values as whole numbers of 1 / ``quanta``; integer sums ignore row order.

    With ``quanta`` every method returns bit-identical values on any cluster layout, as
    long as a sum stays below 2**63 quanta (beyond that the job fails, it never wraps).
    """
    if quanta is None:
        return blocks
    others = [c for c in blocks.columns if c not in BLOCK]
    return blocks.selectExpr(*others, *[f"cast(floor({k} * {quanta!r}D + 0.5D) AS bigint) AS {k}" for k in BLOCK])


def restore(blocks: DataFrame, quanta: float | None) -> DataFrame:
    """Undo ``quantize`` after the sums."""
    if quanta is None:
        return blocks
    others = [c for c in blocks.columns if c not in BLOCK]
    return blocks.selectExpr(*others, *[f"{k} / {quanta!r}D AS {k}" for k in BLOCK])


def sum_blocks(contributions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sum blocks per node pair. Map-side partial sums absorb a hot node's own block."""
    return contributions.groupBy(*(keys or KEYS)).agg(*[F.sum(k).alias(k) for k in BLOCK])


def assemble_blocks(
    mesh: MeshFrames, kernel: ElementKernel | None = None, quanta: float | None = None
) -> DataFrame:
    """The default method on node blocks, upper triangle (ni <= nj).

    Nine sums share one hash key, and symmetry halves the keys, so the shuffle carries
    about one eighteenth of the keys a scalar (row, col) aggregate would.
    """
    rows = quantize(block_contributions(mesh, kernel or simplified()), quanta)
    return restore(sum_blocks(rows), quanta)


def row_contributions(df: DataFrame, kernel: ElementKernel, plan: RowPlan, keep: list[str] | None = None, ranged: bool = False) -> list[DataFrame]:
    """Unsummed blocks of prepared elements in both triangles: (ni, nj, keep..., a, b, k00..k22).

    The first part has each node's blocks in one task; a second one, if any node is hot, has the
    blocks of hot nodes where their elements are.
    """
    keep = keep or []
    columns = [*keep, *kernel.state]
    parts = [corner_pairs(corner_shares(df, columns, plan, ranged), columns)]
    if plan.hot:
        parts.append(hot_pairs(df, columns, plan))
    return [block_entries(pairs, kernel, keep) for pairs in parts]


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def row_parts(df: DataFrame, kernel: ElementKernel, plan: RowPlan, quanta: float | None = None, ranged: bool = False) -> list[DataFrame]:
    """Summed blocks in both triangles of prepared elements: each node's in one task, then those of hot nodes, if any."""
    return [restore(sum_blocks(quantize(part, quanta)), quanta) for part in row_contributions(df, kernel, plan, ranged=ranged)]


def sum_rows(df: DataFrame, kernel: ElementKernel, plan: RowPlan, quanta: float | None = None, ranged: bool = False) -> DataFrame:
    """Summed blocks in both triangles of prepared elements; a node's blocks are in one task unless it is hot."""
    return _together(row_parts(df, kernel, plan, quanta, ranged))


def assemble_rows(mesh: MeshFrames, kernel: ElementKernel | None = None, quanta: float | None = None, plan: RowPlan | None = None) -> DataFrame:
    """Summed blocks in both triangles, by rows: what the scalar matrix is unfolded from without an exchange."""
    return _together(assemble_parts(mesh, kernel, quanta, plan))


def assemble_parts(mesh: MeshFrames, kernel: ElementKernel | None = None, quanta: float | None = None, plan: RowPlan | None = None) -> list[DataFrame]:
    """``assemble_rows`` by the parts of ``row_parts``. Parts of one plan hold the same node pairs in the same tasks."""
    kernel = kernel or simplified()
    return row_parts(prepared_elements(mesh, kernel), kernel, plan or plan_rows(mesh.elements), quanta)


def digest_rows(mesh: MeshFrames, digest: Callable[[DataFrame], DataFrame], kernel: ElementKernel | None = None, quanta: float | None = None, plan: RowPlan | None = None) -> DataFrame:
    """``digest`` of the summed blocks, in both triangles: a frame with rows of nodes, made in passes over the nodes of a large mesh."""
    kernel = kernel or simplified()
    plan = plan or plan_rows(mesh.elements)
    return in_passes(prepared_elements(mesh, kernel), plan, lambda df, some: digest(sum_rows(df, kernel, some, quanta)))


def assemble_private(
    mesh: MeshFrames, kernel: ElementKernel | None = None, copies: int = 8, quanta: float | None = None, plan: RowPlan | None = None
) -> DataFrame:
    """Private sums per hashed element slice, then a merge by node pair, in both triangles.

    The slice is part of the first key: the contributions of one hot node pair
    are spread over ``copies`` tasks and meet again as at most ``copies`` rows.
    """
    kernel = kernel or simplified()
    parts = row_contributions(prepared_elements(mesh, kernel), kernel, plan or plan_rows(mesh.elements), ["elem_id"])
    sliced = [quantize(rows, quanta).withColumn("copy", F.pmod(F.xxhash64("elem_id"), F.lit(copies))) for rows in parts]
    return restore(_together([sum_blocks(sum_blocks(rows, ["copy", *KEYS])) for rows in sliced]), quanta)


def reproducible_sum(rows: DataFrame, top: float | None = None) -> DataFrame:
    """Block sums per node pair that do not depend on order, layout, salting or spilling.

    The largest value fixes two quanta, 2**-30 and 2**-60 of the power of two above it. Every
    value is a whole number of the first plus one of the second (what is smaller is cut off),
    both are summed as longs and put together once. So partial sums combine map-side, a hot
    pair is one row per task, and no size constant selects the result. A sum beyond 63 bits
    fails; it never wraps. ``top`` is the largest value, if it is known.
    """
    top = largest_value(rows) if top is None else top
    above = math.frexp(top or 1.0)[1]
    large, small = 2.0 ** (above - SPLIT_BITS), 2.0 ** (above - 2 * SPLIT_BITS)
    high = rows.selectExpr(*KEYS, *BLOCK, *[f"bigint(floor({k} / {large!r}D)) AS hi_{k}" for k in BLOCK])
    split = high.selectExpr(*KEYS, *[f"hi_{k}" for k in BLOCK], *[f"bigint(floor(({k} - hi_{k} * {large!r}D) / {small!r}D)) AS lo_{k}" for k in BLOCK])
    summed = split.groupBy(*KEYS).agg(*[F.sum(f"{part}_{k}").alias(f"{part}_{k}") for part in ("hi", "lo") for k in BLOCK])
    return summed.selectExpr(*KEYS, *[f"double(hi_{k}) * {large!r}D + double(lo_{k}) * {small!r}D AS {k}" for k in BLOCK])


def largest_value(rows: DataFrame) -> float:
    """The largest absolute value of unsummed blocks, 0 without any; an error if it is not finite."""
    top = rows.select(F.greatest(*[F.abs(k) for k in BLOCK]).alias("top")).agg(F.max("top")).first()[0]
    if top is not None and not math.isfinite(top):
        raise ValueError("a contribution is not finite")
    return top or 0.0


def _reproducible_rows(df: DataFrame, kernel: ElementKernel, plan: RowPlan, quanta: float | None) -> DataFrame:
    if quanta is not None:
        return sum_rows(df, kernel, plan, quanta)
    top = largest_value(blocks_of(df, kernel, []))
    return _together([reproducible_sum(part, top) for part in row_contributions(df, kernel, plan)])


def assemble_ordered(mesh: MeshFrames, kernel: ElementKernel | None = None, quanta: float | None = None, plan: RowPlan | None = None) -> DataFrame:
    """The baseline that the other methods are checked against: reproducible at every size; both triangles."""
    kernel = kernel or simplified()
    return _reproducible_rows(prepared_elements(mesh, kernel), kernel, plan or plan_rows(mesh.elements), quanta)


def assemble_by_batch(
    mesh: MeshFrames, batches: DataFrame, kernel: ElementKernel | None = None, quanta: float | None = None, plan: RowPlan | None = None
) -> DataFrame:
    """Sums over ``batches`` (elem_id, batch) with no conflicts inside a batch, in both triangles.

    Only elements with a batch count; each batch adds at most once to a node pair.
    """
    kernel = kernel or simplified()
    df = prepared_elements(mesh, kernel).join(batches.hint("merge"), "elem_id")
    return _reproducible_rows(df, kernel, plan or plan_rows(mesh.elements), quanta)


def blocks_to_matrix(blocks: DataFrame) -> DataFrame:
    """Scalar (row, col, value) entries of an upper-triangle block table; no shuffle.

    Places 0..8 are the block itself and 9..17 its transpose in the lower triangle.
    """
    placed = blocks.selectExpr("ni", "nj", BLOCK_ARRAY, "explode(if(ni = nj, sequence(0, 8), sequence(0, 17))) AS place")
    split = placed.selectExpr("*", "ni * 3 + (place % 9) div 3 AS near", "nj * 3 + place % 3 AS far")
    return split.selectExpr(
        "if(place < 9, near, far) AS row", "if(place < 9, far, near) AS col", "k[place % 9] AS value"
    )


def rows_to_matrix(blocks: DataFrame) -> DataFrame:
    """Scalar (row, col, value) entries of blocks in both triangles; no shuffle."""
    placed = blocks.selectExpr("ni", "nj", BLOCK_ARRAY, PLACES)
    return placed.selectExpr("ni * 3 + place div 3 AS row", "nj * 3 + place % 3 AS col", "k[place] AS value")


def sort_matrix(matrix: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range-partition and sort by (row, col): files come out in CSR order."""
    keys = [F.col("row"), F.col("col")]
    ranged = matrix.repartitionByRange(partitions, *keys) if partitions else matrix.repartitionByRange(*keys)
    return ranged.sortWithinPartitions("row", "col")


def _atomic(mesh, kernel, **options):
    return rows_to_matrix(assemble_rows(mesh, kernel, **options))


def _private(mesh, kernel, **options):
    return rows_to_matrix(assemble_private(mesh, kernel, **options))


def _serial(mesh, kernel, **options):
    return rows_to_matrix(assemble_ordered(mesh, kernel, **options))


def _sorted(mesh, kernel, partitions=None, quanta=None, plan=None):
    plan = plan or plan_rows(mesh.elements)
    if plan.hot:
        # A hot node's row may exceed a task: ranges are cut by (row, col) then.
        return sort_matrix(rows_to_matrix(assemble_rows(mesh, kernel, quanta, plan)), partitions)
    # Elements are ranged by node, so that a task's sums are a range of rows.
    plan = RowPlan(partitions, plan.hot) if partitions else plan
    matrix = rows_to_matrix(sum_rows(prepared_elements(mesh, kernel), kernel, plan, quanta, ranged=True))
    return matrix.sortWithinPartitions("row", "col")


def _owner(mesh, kernel, owners=None, **options):
    from meshloom.operators.owners import assemble_by_owner

    return assemble_by_owner(mesh, kernel, owners, **options).select("row", "col", "value")


def _coloring(mesh, kernel, order="random", **options):
    from meshloom.operators.batches import conflict_free_batches

    return rows_to_matrix(assemble_by_batch(mesh, conflict_free_batches(mesh, order=order), kernel, **options))


# Canonical method names in their fixed listing order.
METHODS: dict[str, Callable[..., DataFrame]] = {
    "cpu_serial": _serial,
    "cpu_atomic": _atomic,
    "cpu_private_csr": _private,
    "cpu_coo_sort_reduce": _sorted,
    "cpu_graph_coloring": _coloring,
    "cpu_row_owner": _owner,
}


def assemble(
    mesh: MeshFrames, kernel: ElementKernel | None = None, method: str = "cpu_atomic", **options
) -> DataFrame:
    """The global matrix as (row, col, value), by a method name or one of its aliases."""
    from meshloom.functions.names import canonical_method

    return METHODS[canonical_method(method)](mesh, kernel or simplified(), **options)
