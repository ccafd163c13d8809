"""Structured meshes generated on the executors from ``spark.range``."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshloom.model import MeshFrames

# Cell corners as (x, y, z) steps. CORNERS lists the hex8 corner order;
# each tet names four corner steps. Changing an order changes the element matrices.
CORNERS = ["000", "100", "110", "010", "001", "101", "111", "011"]
CUBE_TETS = [
    ["000", "100", "110", "111"],
    ["000", "110", "010", "111"],
    ["000", "010", "011", "111"],
    ["000", "011", "001", "111"],
    ["000", "001", "101", "111"],
    ["000", "101", "100", "111"],
]
# The script split by corner number 0..7; its last tet is coplanar.
SCRIPT_TETS = [
    [0, 1, 3, 4],
    [1, 2, 3, 6],
    [1, 4, 5, 6],
    [3, 4, 6, 7],
    [1, 3, 4, 6],
    [0, 1, 4, 5],
]


def _check_dims(*dims: int) -> None:
    if any(d <= 0 for d in dims):
        raise ValueError("cube dimensions must be positive")


def _grid_index(size_x: int, size_y: int) -> tuple[Column, Column, Column]:
    """The (i, j, k) position encoded in ``id`` for an i-fastest numbering."""
    plane = size_x * size_y
    return F.col("id") % size_x, F.expr(f"(id div {size_x}) % {size_y}"), F.expr(f"id div {plane}")


def _slices(rows: int, per_task: int = 250_000) -> int | None:
    """Enough range slices to keep a task near ``per_task`` rows; small grids use the default."""
    wanted = math.ceil(rows / per_task)
    return wanted if wanted > 8 else None


def _range(spark: SparkSession, rows: int) -> DataFrame:
    slices = _slices(rows)
    return spark.range(0, rows, 1, slices) if slices else spark.range(rows)


def _grid_nodes(spark: SparkSession, dims: tuple[int, int, int], coord) -> DataFrame:
    nx, ny, nz = dims
    position = _grid_index(nx + 1, ny + 1)
    xyz = [coord(position[axis], axis).alias(name) for axis, name in enumerate("xyz")]
    return _range(spark, (nx + 1) * (ny + 1) * (nz + 1)).select(F.col("id").alias("node_id"), *xyz)


def _grid_coordinates(dims: tuple[int, int, int], coord) -> Callable[[Column], list[Column]]:
    """x, y and z from a node id, by the expressions of ``_grid_nodes``; null outside the grid."""
    nx, ny, nz = dims

    def of(node: Column) -> list[Column]:
        div = lambda by: F.call_function("div", node, F.lit(by).cast("long"))
        position = node % (nx + 1), div(nx + 1) % (ny + 1), div((nx + 1) * (ny + 1))
        inside = (node >= 0) & (node < (nx + 1) * (ny + 1) * (nz + 1))
        return [F.when(inside, coord(position[axis], axis)) for axis in range(3)]

    return of


def _grid_elements(spark: SparkSession, dims: tuple[int, int, int], kind: str, shapes: list[list[str]]) -> DataFrame:
    """One row per (cell, shape); corner ids are the cell's base id plus literal offsets.

    The offsets are the same for every cell, so the shapes are one literal array that
    is exploded in place: no join and no shuffle.
    """
    nx, ny, nz = dims
    steps = {c: int(c[0]) + (int(c[1]) + int(c[2]) * (ny + 1)) * (nx + 1) for c in CORNERS}
    width = len(shapes[0])
    shape = [
        "struct({}L AS t, {})".format(t, ", ".join(f"{steps[c]}L AS o{s}" for s, c in enumerate(corners)))
        for t, corners in enumerate(shapes)
    ]
    i, j, k = f"id % {nx}", f"(id div {nx}) % {ny}", f"id div {nx * ny}"
    cells = _range(spark, nx * ny * nz).selectExpr("id", f"(({k}) * {ny + 1} + {j}) * {nx + 1} + {i} AS base")
    placed = cells.selectExpr("id", "base", f"inline(array({', '.join(shape)}))")
    corners = ", ".join(f"base + o{s}" for s in range(len(shapes[0])))
    return placed.selectExpr(f"id * {len(shapes)} + t AS elem_id", f"'{kind}' AS type", f"array({corners}) AS nodes")


def _cube(spark, kind, shapes, dims, lengths) -> MeshFrames:
    _check_dims(*dims)

    def coord(index: Column, axis: int) -> Column:
        return F.lit(float(lengths[axis])) * index / F.lit(float(dims[axis]))

    return MeshFrames(
        _grid_nodes(spark, dims, coord),
        _grid_elements(spark, dims, kind, shapes),
        "cube_{}_{}x{}x{}".format(kind, *dims),
        _grid_coordinates(dims, coord),
    )


def cube_tet4(spark: SparkSession, nx: int, ny: int, nz: int, lx=1.0, ly=1.0, lz=1.0) -> MeshFrames:
    """A box of ``nx*ny*nz`` cells, six tets per cell around one diagonal."""
    return _cube(spark, "tet4", CUBE_TETS, (nx, ny, nz), (lx, ly, lz))


def cube_hex8(spark: SparkSession, nx: int, ny: int, nz: int, lx=1.0, ly=1.0, lz=1.0) -> MeshFrames:
    """A box of ``nx*ny*nz`` hexahedra."""
    return _cube(spark, "hex8", [CORNERS], (nx, ny, nz), (lx, ly, lz))


# Marks along an edge of a graded box that are still broadcast to the nodes.
BROADCAST_MARKS = 1_000_000


def edge_marks(spark: SparkSession, dims: tuple[int, int, int], spacing: DataFrame) -> DataFrame:
    """axis, at, offset, total: prefix sums of the cell lengths along the three edges of a box.

    ``spacing`` holds (axis, cell, length): whole relative lengths of the cells of axis 0, 1 and 2,
    one row per cell; a cell without a row, or with a null, has length 1. A length below 1 is an
    error. The window sees one edge at a time, never the cells of the box.
    """
    places = None
    for axis, cells in enumerate(dims):
        one = _range(spark, cells + 1).select(F.lit(axis).alias("axis"), F.col("id").alias("at"))
        places = one if places is None else places.unionByName(one)
    lengths = spacing.select(F.col("axis").cast("int").alias("axis"), (F.col("cell") + 1).alias("at"), F.col("length").cast("long").alias("length"))
    known = F.coalesce("length", F.lit(1).cast("long"))
    checked = F.when(known >= 1, known).otherwise(F.raise_error(F.lit("cell lengths must be positive")).cast("long"))
    step = F.when(F.col("at") == 0, F.lit(0).cast("long")).otherwise(checked)
    edge = Window.partitionBy("axis")
    return places.join(lengths, ["axis", "at"], "left").select(
        "axis", "at", F.sum(step).over(edge.orderBy("at")).alias("offset"), F.sum(step).over(edge).alias("total")
    )


def graded_cube(spark: SparkSession, kind: str, dims: tuple[int, int, int], spacing: DataFrame, lengths=(1.0, 1.0, 1.0)) -> MeshFrames:
    """A box like ``cube_tet4`` or ``cube_hex8`` whose cells have the relative lengths of ``spacing`` (see ``edge_marks``)."""
    plain = {"tet4": cube_tet4, "hex8": cube_hex8}[kind](spark, *dims)
    nx, ny, nz = dims
    marks = edge_marks(spark, dims, spacing)
    position = _grid_index(nx + 1, ny + 1)
    nodes = _range(spark, (nx + 1) * (ny + 1) * (nz + 1)).select("id", *[p.alias(f"at_{c}") for p, c in zip(position, "xyz")])
    for axis, c in enumerate("xyz"):
        place = (F.lit(float(lengths[axis])) * F.col("offset") / F.col("total")).alias(c)
        edge = marks.filter(F.col("axis") == axis).select(F.col("at").alias(f"at_{c}"), place)
        nodes = nodes.join(F.broadcast(edge) if dims[axis] < BROADCAST_MARKS else edge, f"at_{c}")
    return MeshFrames(nodes.select(F.col("id").alias("node_id"), *"xyz"), plain.elements, f"graded_{plain.name}")


def script_resolution(target_dof: int) -> int:
    """Cells per edge for a wanted number of degrees of freedom."""
    return int((target_dof / 3) ** (1 / 3))


def script_mesh(spark: SparkSession, kind: str, target_dof: int, lx=1.0, ly=1.0, lz=1.0) -> MeshFrames:
    """The sized cube of the mesh script: other tet split, coordinates ``i * (l / n)``."""
    if kind not in ("tet4", "hex8"):
        raise ValueError(f"unknown mesh type: {kind}")
    n = script_resolution(target_dof)
    _check_dims(n)
    lengths = (lx, ly, lz)
    shapes = [[CORNERS[c] for c in tet] for tet in SCRIPT_TETS] if kind == "tet4" else [CORNERS]

    def coord(index: Column, axis: int) -> Column:
        return index * F.lit(lengths[axis] / n)

    dims = (n, n, n)
    return MeshFrames(
        _grid_nodes(spark, dims, coord),
        _grid_elements(spark, dims, kind, shapes),
        f"script_{kind}_{target_dof}",
        _grid_coordinates(dims, coord),
    )
