"""Element kernels as numpy functions over whole batches, summed before anything is exchanged.

A batch kernel gets the ids, nodes and corners of all elements of one width and returns
their dense matrices, which must be symmetric. Elements are sent to the tasks of their nodes, which
sum whole rows of 3x3 blocks (``shares``). Kernels are found by name; a user's own is added with
`register_kernel`. A kernel whose ``slots`` are empty gets NaN for corners, and none are looked up.
The code-generated kernels stay the default.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.functions.kernels import lame_constants
from meshloom.model import BLOCK, MIN_PIVOT, MIN_VOLUME, POISSON_RATIO, YOUNG_MODULUS, MeshFrames
from meshloom.operators.assemble import restore, rows_to_matrix, sum_blocks
from meshloom.operators.corners import BROADCAST_NODES, check_mesh, gather_corners
from meshloom.operators.shares import RowPlan, corner_shares, in_passes, plan_rows

# ids (n), nodes (n, w) and corners (n, w, 3) to symmetric matrices (n, 3w, 3w).
BatchKernel = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
_KERNELS: dict[str, BatchKernel] = {}
# Elements whose matrices a task holds at once.
BATCH_ELEMENTS = 4096
CORNERS = tuple(range(8))


def register_kernel(name: str, kernel: BatchKernel) -> None:
    """Make ``kernel`` known by a name that none has yet."""
    if name in _KERNELS:
        raise ValueError(f"a kernel is already called {name}")
    _KERNELS[name] = kernel


def batch_kernel(name: str) -> BatchKernel:
    if name not in _KERNELS:
        raise ValueError(f"unknown kernel: {name}")
    return _KERNELS[name]


def simplified_matrices(ids: np.ndarray, nodes: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The synthetic kernel: depends on the element id and local positions only."""
    size = 3 * nodes.shape[1]
    scale = (1.0 + ((ids % 97) * 17 % 97) * 1.0e-4)[:, None, None]
    at = np.arange(size)
    out = 0.02 * scale / (1 + np.abs(at[:, None] - at[None, :]))
    out[:, at, at] = 2.0 * scale[:, 0] + 0.01 * (at % 3)
    return out


def simplified_rows(ids: np.ndarray, nodes: np.ndarray, corners: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The three rows of corner ``at`` of each element's ``simplified_matrices``: (n, 3, 3w)."""
    size = 3 * nodes.shape[1]
    scale = (1.0 + ((ids % 97) * 17 % 97) * 1.0e-4)[:, None, None]
    row = 3 * at[:, None] + np.arange(3)
    out = 0.02 * scale / (1 + np.abs(row[:, :, None] - np.arange(size)))
    out[np.arange(len(ids))[:, None], np.arange(3), row] = 2.0 * scale[:, 0] + 0.01 * (row % 3)
    return out


# No corners are looked up, and a task computes the rows of its own nodes only.
simplified_matrices.slots = ()
simplified_matrices.rows = simplified_rows


def smallest_pivots(edges: np.ndarray) -> np.ndarray:
    """The smallest pivot of each (3, 3) table of edges by partial pivoting, as `kernels.smallest_pivot` has it."""
    left, every = edges.copy(), np.arange(len(edges))
    least = np.full(len(edges), np.inf)
    for column in range(3):
        top = np.abs(left[:, :, column]).argmax(axis=1)
        row = left[every, top]
        left[every, top] = left[:, 0]
        left = left[:, 1:]
        least = np.fmin(least, np.abs(row[:, column]))
        with np.errstate(divide="ignore", invalid="ignore"):
            left = left - left[:, :, column, None] * (row / row[:, column, None])[:, None, :]
    return least


def physics_matrices(young: float = YOUNG_MODULUS, poisson: float = POISSON_RATIO) -> BatchKernel:
    """Linear elasticity on tet4; flat and singular elements and other types get the simplified kernel."""
    lam, mu = lame_constants(young, poisson)

    def matrices(ids, nodes, corners):
        out = simplified_matrices(ids, nodes, corners)
        if nodes.shape[1] != 4:
            return out
        edges = corners[:, 1:] - corners[:, :1]
        normals = np.stack([np.cross(edges[:, 1], edges[:, 2]), np.cross(edges[:, 2], edges[:, 0]), np.cross(edges[:, 0], edges[:, 1])], axis=1)
        det = (edges[:, 0] * normals[:, 0]).sum(axis=1)
        volume = np.abs(det) / 6.0
        twin = np.zeros(len(ids), bool)
        for s in range(4):
            for t in range(s + 1, 4):
                twin |= (corners[:, s] == corners[:, t]).all(axis=1)
        good = (volume > MIN_VOLUME) & (smallest_pivots(edges) >= MIN_PIVOT) & ~twin
        grad = np.empty((good.sum(), 4, 3))
        grad[:, 1:] = normals[good] / det[good, None, None]
        grad[:, 0] = -grad[:, 1:].sum(axis=1)
        outer = np.einsum("eai,ebj->eaibj", grad, grad)
        shear = np.einsum("eai,ebi->eab", grad, grad)
        block = lam * outer + mu * np.einsum("eajbi->eaibj", outer) + mu * np.einsum("eab,ij->eaibj", shear, np.eye(3))
        out[good] = (volume[good, None, None, None, None] * block).reshape(-1, 12, 12)
        return out

    return matrices


register_kernel("simplified", simplified_matrices)
register_kernel("physics_tet4", physics_matrices())


def batch_blocks(mesh: MeshFrames, kernel: BatchKernel, quanta: float | None = None) -> DataFrame:
    """Blocks (ni <= nj) summed per node pair and batch; whole numbers of 1 / ``quanta`` if given."""
    gathered = gather_corners(mesh, CORNERS)
    flat = F.array(*[F.coalesce(f"{c}{s}", F.lit(float("nan"))) for s in CORNERS for c in "xyz"])
    work = gathered.select("elem_id", "nodes", flat.alias("corners"))
    kind = "double" if quanta is None else "long"

    def pairs(ids, nodes, corners):
        width = nodes.shape[1]
        dense = kernel(ids, nodes, corners)
        if quanta is not None:
            dense = np.floor(dense * quanta + 0.5).astype(np.int64)
        # (n, a, i, b, j) to one row of nine values per pair of local nodes.
        values = dense.reshape(-1, width, 3, width, 3).transpose(0, 1, 3, 2, 4).reshape(-1, 9)
        ni, nj = np.repeat(nodes, width, axis=1).ravel(), np.tile(nodes, (1, width)).ravel()
        upper = ni <= nj
        return ni[upper], nj[upper], values[upper]

    def assemble_batch(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ELEMENTS):
                part = batch.slice(start, BATCH_ELEMENTS)
                ids, lists = part.column(0).to_numpy(), part.column(1)
                widths = np.diff(lists.offsets.to_numpy())
                first = np.cumsum(widths) - widths
                nodes, corners = lists.flatten().to_numpy(), part.column(2).flatten().to_numpy().reshape(-1, 8, 3)
                found = []
                for width in np.unique(widths).tolist():
                    some = np.flatnonzero(widths == width)
                    found.append(pairs(ids[some], nodes[first[some, None] + np.arange(width)], corners[some, :width]))
                ni, nj, values = (np.concatenate(x) for x in zip(*found))
                ni, nj, sums = _summed(ni, nj, values)
                yield pa.RecordBatch.from_arrays([pa.array(ni), pa.array(nj), *(pa.array(np.ascontiguousarray(sums[:, k])) for k in range(9))], names=["ni", "nj", *BLOCK])

    return work.mapInArrow(assemble_batch, "ni long, nj long, " + ", ".join(f"{k} {kind}" for k in BLOCK))


def _summed(ni: np.ndarray, nj: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by node pair, one per pair."""
    order = np.lexsort((nj, ni))
    ni, nj, values = ni[order], nj[order], values[order]
    new = np.flatnonzero(np.r_[True, (ni[1:] != ni[:-1]) | (nj[1:] != nj[:-1])])
    return ni[new], nj[new], np.add.reduceat(values, new, axis=0)


def _located_shares(mesh: MeshFrames, kernel: BatchKernel, plan: RowPlan) -> DataFrame:
    """(elem_id, nodes, a, ni, corners) per corner in the task of its node; corners is null for a kernel that needs none.

    Corners are looked up where the shares are, as long as the nodes can be broadcast, and are sent along otherwise.
    """
    keep, slots = ["elem_id"], getattr(kernel, "slots", CORNERS)
    known = check_mesh(mesh) <= BROADCAST_NODES
    flat = F.array(*[F.coalesce(f"{c}{s}", F.lit(float("nan"))) for s in CORNERS for c in "xyz"]) if slots else F.lit(None).cast("array<double>")
    if slots and not known:
        gathered = gather_corners(mesh, CORNERS, strict=False).select("elem_id", "nodes", flat.alias("corners"))
        return corner_shares(gathered, [*keep, "corners"], plan)
    shares = corner_shares(mesh.elements, keep, plan)
    if slots:
        shares = gather_corners(MeshFrames(mesh.nodes, shares), CORNERS, strict=False)
    return shares.select("elem_id", "nodes", "a", "ni", flat.alias("corners"))


def batch_rows(mesh: MeshFrames, kernel: BatchKernel, quanta: float | None = None, plan: RowPlan | None = None) -> DataFrame:
    """Summed blocks in both triangles: a task sums all blocks of its nodes, so no block is exchanged.

    An element's matrix is computed in the task of each of its corners. Shares come sorted by node;
    what the last node of a batch has so far is carried into the next one.
    """
    plan = plan or plan_rows(mesh.elements)
    kind = "double" if quanta is None else "long"

    def pairs(ids, nodes, at, corners):
        width = nodes.shape[1]
        # (n, a, i, b, j) at the share's own corner a to one row of nine values per neighbour.
        rows = kernel.rows(ids, nodes, corners, at) if hasattr(kernel, "rows") else kernel(ids, nodes, corners).reshape(-1, width, 3, 3 * width)[np.arange(len(ids)), at]
        values = rows.reshape(-1, 3, width, 3).transpose(0, 2, 1, 3).reshape(-1, 9)
        if quanta is not None:
            values = np.floor(values * quanta + 0.5).astype(np.int64)
        return np.repeat(nodes[np.arange(len(ids)), at], width), nodes.ravel(), values

    def block(ni, nj, values):
        return pa.RecordBatch.from_arrays([pa.array(ni), pa.array(nj), *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(9))], names=["ni", "nj", *BLOCK])

    def sum_shares(batches):
        left = None
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ELEMENTS):
                part = batch.slice(start, BATCH_ELEMENTS)
                ids, lists, at = part.column(0).to_numpy(), part.column(1), part.column(2).to_numpy()
                widths = np.diff(lists.offsets.to_numpy())
                first = np.cumsum(widths) - widths
                nodes = lists.flatten().to_numpy()
                corners = np.full((1, 8, 3), np.nan) if part.column(4).null_count else part.column(4).flatten().to_numpy().reshape(-1, 8, 3)
                corners = np.broadcast_to(corners, (len(ids), 8, 3))
                found = [] if left is None else [left]
                for width in np.unique(widths).tolist():
                    some = np.flatnonzero(widths == width)
                    found.append(pairs(ids[some], nodes[first[some, None] + np.arange(width)], at[some], corners[some, :width]))
                ni, nj, sums = _summed(*(np.concatenate(x) for x in zip(*found)))
                whole = int(np.searchsorted(ni, ni[-1]))
                left = ni[whole:], nj[whole:], sums[whole:]
                if whole:
                    yield block(ni[:whole], nj[:whole], sums[:whole])
        if left is not None:
            yield block(*left)

    shares = _located_shares(mesh, kernel, plan).sortWithinPartitions("ni")
    out = shares.select("elem_id", "nodes", "a", "ni", "corners").mapInArrow(sum_shares, "ni long, nj long, " + ", ".join(f"{k} {kind}" for k in BLOCK))
    if plan.hot:
        # Blocks of hot nodes are summed where their elements are and exchanged by pair.
        hot = batch_blocks(mesh, kernel, quanta)
        turned = hot.filter("ni <> nj").select(F.col("nj").alias("ni"), F.col("ni").alias("nj"), *[F.col(f"k{j}{i}").alias(f"k{i}{j}") for i in range(3) for j in range(3)])
        out = out.unionByName(sum_blocks(hot.unionByName(turned).filter(plan.here(F.col("ni")) & plan.is_hot(F.col("ni")))))
    return out


def digest_batched(
    mesh: MeshFrames, digest: Callable[[DataFrame], DataFrame], kernel: str | BatchKernel = "simplified", quanta: float | None = None, plan: RowPlan | None = None
) -> DataFrame:
    """``digest`` of the summed blocks of a batch kernel: a frame with rows of nodes, made in passes over the nodes of a large mesh."""
    kernel = batch_kernel(kernel) if isinstance(kernel, str) else kernel
    plan = plan or plan_rows(mesh.elements)
    return in_passes(mesh.elements, plan, lambda some, at: digest(restore(batch_rows(MeshFrames(mesh.nodes, some), kernel, quanta, at), quanta)))


def assemble_batched(mesh: MeshFrames, kernel: str | BatchKernel = "simplified", quanta: float | None = None, plan: RowPlan | None = None) -> DataFrame:
    """The global matrix (row, col, value) by a batch kernel or the name of one."""
    kernel = batch_kernel(kernel) if isinstance(kernel, str) else kernel
    return rows_to_matrix(restore(batch_rows(mesh, kernel, quanta, plan), quanta))
