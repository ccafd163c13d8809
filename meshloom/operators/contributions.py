"""Per-element contributions: node pairs with their 3x3 blocks, or scalar entries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meshloom.functions.kernels import ElementKernel
from meshloom.model import BLOCK, NEAR_ZERO, MeshFrames
from meshloom.operators.corners import BROADCAST_NODES, gather_corners

# The nine places of a block in row-major order, and the block as an array.
PLACES = "explode(sequence(0, 8)) AS place"
BLOCK_ARRAY = f"array({', '.join(BLOCK)}) AS k"


def local_pairs(df: DataFrame, keep: list[str], upper: bool = True) -> DataFrame:
    """All ordered pairs of an element's own nodes as (ni, nj, a, b): at most 64 a row.

    The pair numbers are a literal array, so nothing but two integers is added per row.
    ``upper`` keeps ni <= nj. For a repeated node both orders survive, as they must:
    the two contributions land on the same diagonal block.
    """
    numbered = df.selectExpr(
        "nodes", *keep, "explode(if(size(nodes) = 4, sequence(0, 15), sequence(0, 63))) AS pair"
    )
    placed = numbered.selectExpr(
        "nodes",
        *keep,
        "if(size(nodes) = 4, shiftright(pair, 2), shiftright(pair, 3)) AS a",
        "if(size(nodes) = 4, pair & 3, pair & 7) AS b",
    )
    out = placed.selectExpr("nodes[a] AS ni", "nodes[b] AS nj", "a", "b", *keep)
    return out.filter("ni <= nj") if upper else out


def prepared_elements(mesh: MeshFrames, kernel: ElementKernel, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """Elements with the kernel's state columns, and nothing else besides id and nodes."""
    df = kernel.prepare(gather_corners(mesh, kernel.slots, broadcast_nodes))
    return df.select("elem_id", "nodes", *kernel.state)


def blocks_of(df: DataFrame, kernel: ElementKernel, keep: list[str], upper: bool = True) -> DataFrame:
    """Unsummed node blocks of prepared elements: (ni, nj, keep..., a, b, k00..k22)."""
    return block_entries(local_pairs(df, [*keep, *kernel.state], upper), kernel, keep)


def block_entries(pairs: DataFrame, kernel: ElementKernel, keep: list[str]) -> DataFrame:
    """The nine entries of each pair (ni, nj, a, b) with its element's kernel state."""
    local = kernel.localise(pairs)
    entries = [f"{kernel.entry(i, j)} AS k{i}{j}" for i in range(3) for j in range(3)]
    return local.selectExpr("ni", "nj", *keep, "a", "b", *entries)


def block_contributions(
    mesh: MeshFrames,
    kernel: ElementKernel,
    keep: list[str] | None = None,
    upper: bool = True,
    broadcast_nodes: int = BROADCAST_NODES,
) -> DataFrame:
    """Gather, prepare and explode in one narrow stage (or two shuffles for huge node tables)."""
    return blocks_of(prepared_elements(mesh, kernel, broadcast_nodes), kernel, keep or [], upper)


def scalar_contributions(mesh: MeshFrames, kernel: ElementKernel, drop_near_zero: bool = False) -> DataFrame:
    """One row per element entry: (elem_id, i, j, row, col, value).

    ``drop_near_zero`` leaves out entries below 1e-15, and with them pattern entries.
    """
    blocks = block_contributions(mesh, kernel, ["elem_id"], upper=False)
    placed = blocks.selectExpr("elem_id", "ni", "nj", "a", "b", BLOCK_ARRAY, PLACES)
    out = placed.selectExpr("*", "int(place div 3) AS p", "place % 3 AS q").selectExpr(
        "elem_id", "a * 3 + p AS i", "b * 3 + q AS j", "ni * 3 + p AS row", "nj * 3 + q AS col", "k[place] AS value"
    )
    return out.filter(f"abs(value) >= {NEAR_ZERO!r}D") if drop_near_zero else out


def near_zero_counts(mesh: MeshFrames, kernel: ElementKernel) -> DataFrame:
    """(row, entries, kept): unsummed entries per matrix row, and those that ``drop_near_zero`` keeps.

    Whole blocks are counted per node, in one pass; a node is unfolded to its three rows last.
    """
    blocks = block_contributions(mesh, kernel, upper=False)
    kept = [" + ".join(f"int(abs(k{p}{q}) >= {NEAR_ZERO!r}D)" for q in range(3)) + f" AS kept{p}" for p in range(3)]
    counted = blocks.selectExpr("ni", "3L AS entries", *kept).groupBy("ni").agg({c: "sum" for c in ("entries", "kept0", "kept1", "kept2")})
    rows = ", ".join(f"struct(ni * 3 + {p} AS row, `sum(entries)` AS entries, `sum(kept{p})` AS kept)" for p in range(3))
    return counted.selectExpr(f"inline(array({rows}))")
