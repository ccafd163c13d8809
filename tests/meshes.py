"""Small meshes as Python lists, their frames, and brute-force results."""

import math
import random

import numpy as np

from meshloom.model import MeshFrames


def frames(spark, coords, elements):
    """coords: list of (x, y, z); elements: list of (elem_id, [nodes])."""
    nodes = spark.createDataFrame(
        [(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(coords)], "node_id long, x double, y double, z double"
    )
    rows = [(e, "tet4" if len(n) == 4 else "hex8", list(n)) for e, n in elements]
    return MeshFrames(nodes, spark.createDataFrame(rows, "elem_id long, type string, nodes array<bigint>"))


def random_mesh(seed, n_nodes=20, n_tets=25, n_hexes=6, repeat=True):
    rng = random.Random(seed)
    coords = [tuple(rng.uniform(-1, 1) for _ in range(3)) for _ in range(n_nodes)]
    elements = []
    for e in range(n_tets + n_hexes):
        size = 4 if rng.random() < n_tets / (n_tets + n_hexes) else 8
        elements.append((e, rng.sample(range(n_nodes - 1), size)))
    if repeat:
        elements.append((len(elements), [1, 2, 2, 3]))
    return coords, elements


def simplified(elem_id, width):
    scale = 1.0 + ((elem_id * 17) % 97) * 1.0e-4
    return [
        [2.0 * scale + 0.01 * (i % 3) if i == j else 0.02 * scale / (1 + abs(i - j)) for j in range(width)] for i in range(width)
    ]


def physics(points, young, poisson):
    """V * B' D B from the inverse of the 4x4 coordinate matrix; None where degenerate."""
    p = np.array(points, dtype=float)
    volume = abs(np.linalg.det(p[1:] - p[0])) / 6.0
    twins = len({tuple(q) for q in points}) < 4
    if math.isnan(volume) or not volume > 1.0e-30 or twins:
        return None
    inverse = np.linalg.inv(np.hstack([np.ones((4, 1)), p]))
    b = np.zeros((6, 12))
    for n in range(4):
        dx, dy, dz = inverse[1:, n]
        b[:, 3 * n : 3 * n + 3] = [[dx, 0, 0], [0, dy, 0], [0, 0, dz], [dy, dx, 0], [0, dz, dy], [dz, 0, dx]]
    lam = young * poisson / ((1 + poisson) * (1 - 2 * poisson))
    mu = young / (2 * (1 + poisson))
    d = np.diag([2 * mu] * 3 + [mu] * 3)
    d[:3, :3] += lam
    return volume * b.T @ d @ b


def dofs(nodes):
    return [3 * n + c for n in nodes for c in range(3)]


def assemble(coords, elements, kernel="simplified", young=210.0e9, poisson=0.3):
    """The serial left fold in element order: {(row, col): value}."""
    out = {}
    for elem_id, nodes in sorted(elements):
        ke = None
        if kernel == "physics" and len(nodes) == 4:
            ke = physics([coords[n] for n in nodes], young, poisson)
        if ke is None:
            ke = simplified(elem_id, 3 * len(nodes))
        at = dofs(nodes)
        for i, row in enumerate(at):
            for j, col in enumerate(at):
                out[row, col] = out.get((row, col), 0.0) + ke[i][j]
    return out


def first_fit(elements):
    used, colors = {}, {}
    for elem_id, nodes in sorted(elements):
        busy = set().union(*[used.get(n, set()) for n in nodes])
        color = next(c for c in range(len(elements) + 1) if c not in busy)
        colors[elem_id] = color
        for n in nodes:
            used.setdefault(n, set()).add(color)
    return colors


def as_dict(matrix):
    return {(r["row"], r["col"]): r["value"] for r in matrix.collect()}
