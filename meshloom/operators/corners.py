"""Gather corner coordinates: elements joined with nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.model import MeshFrames

# Largest node table that is broadcast (about 100 bytes a row once hashed).
BROADCAST_NODES = 2_000_000


def check_mesh(mesh: MeshFrames) -> int:
    """The number of nodes; an error if node ids repeat or a corner's node does not exist.

    Both sides are counted map-side. Ids without gaps need no more than their range; only
    otherwise corners are looked up.
    """
    ids = mesh.nodes.agg(F.count("node_id").alias("n"), F.count_distinct("node_id").alias("distinct"), F.min("node_id").alias("low"), F.max("node_id").alias("high")).first()
    if ids["n"] != ids["distinct"]:
        raise ValueError("node ids repeat")
    corners = mesh.elements.agg(F.min(F.array_min("nodes")).alias("low"), F.max(F.array_max("nodes")).alias("high")).first()
    if corners["low"] is None:
        return ids["n"]
    inside = ids["n"] and ids["low"] <= corners["low"] and corners["high"] <= ids["high"]
    if inside and ids["high"] - ids["low"] + 1 == ids["n"]:
        return ids["n"]
    unknown = missing_nodes(mesh).select("elem_id").first()
    if unknown is not None:
        raise ValueError(f"element references unknown node, elem_id {unknown['elem_id']}")
    return ids["n"]


def gather_corners(
    mesh: MeshFrames, slots: tuple[int, ...], broadcast_nodes: int = BROADCAST_NODES, strict: bool = True
) -> DataFrame:
    """``elements`` plus columns x0, y0, z0, ... for the corner numbers in ``slots``.

    A generated grid's corners are computed from their ids. Otherwise the node table is counted first: up to ``broadcast_nodes`` rows it is broadcast once and probed
    per corner, so the elements do not move; beyond that corners are sent to the nodes and their
    coordinates back to the elements, whose ids must be unique. A hot node is one row on its side
    of the join, so the adaptive skew join can split its corners. ``strict`` checks the mesh first; otherwise a corner whose
    node does not exist is NULL.
    """
    count = check_mesh(mesh) if strict else None
    if not slots:
        return mesh.elements
    if mesh.coordinates is not None:
        corner = {s: mesh.coordinates(F.get("nodes", F.lit(s))) for s in slots}
        return mesh.elements.select("*", *[at.alias(f"{c}{s}") for s in slots for c, at in zip("xyz", corner[s])])
    small = (mesh.nodes.count() if count is None else count) <= broadcast_nodes
    if not small:
        return _gather_by_exchange(mesh, slots)
    out = mesh.elements
    for s in slots:
        side = mesh.nodes.select(F.col("node_id").alias("_node"), *[F.col(c).alias(f"{c}{s}") for c in "xyz"])
        out = out.join(F.broadcast(side), F.get("nodes", F.lit(s)) == F.col("_node"), "left").drop("_node")
    return out


def _gather_by_exchange(mesh: MeshFrames, slots: tuple[int, ...]) -> DataFrame:
    """Corners of a node table too large to broadcast: (element, slot, node) rows meet the nodes in one join.

    What comes back is one row of coordinates per corner, summed up to a row per element, so an
    element's own columns move once, not with every corner.
    """
    asked = F.array(*[F.struct(F.lit(s).alias("_slot"), F.get("nodes", F.lit(s)).alias("_node")) for s in slots])
    corners = mesh.elements.select("elem_id", F.inline(F.filter(asked, lambda c: c["_node"].isNotNull())))
    found = corners.join(mesh.nodes.select(F.col("node_id").alias("_node"), *"xyz"), "_node").select("elem_id", "_slot", *"xyz")
    at = [F.max(F.when(F.col("_slot") == s, F.col(c))).alias(f"{c}{s}") for s in slots for c in "xyz"]
    # One row per corner is sent; sums per task would only widen it.
    wide = found.repartition("elem_id").groupBy("elem_id").agg(*at)
    return mesh.elements.join(wide, "elem_id", "left").select(*mesh.elements.columns, *[f"{c}{s}" for s in slots for c in "xyz"])


def missing_nodes(mesh: MeshFrames) -> DataFrame:
    """(elem_id, node_id) pairs whose node is not in the node table."""
    pairs = mesh.elements.select("elem_id", F.explode("nodes").alias("node_id")).distinct()
    return pairs.join(mesh.nodes.select("node_id"), "node_id", "left_anti").select("elem_id", "node_id")
