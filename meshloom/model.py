"""Table shapes and constants shared by all operators.

Every table is a plain DataFrame:

    nodes     node_id LONG, x, y, z DOUBLE
    elements  elem_id LONG, type STRING ('tet4' | 'hex8'), nodes ARRAY<LONG>
    blocks    ni LONG, nj LONG, k00 .. k22 DOUBLE      one 3x3 block per node pair
    matrix    row LONG, col LONG, value DOUBLE         scalar coordinates
    csr       row, band, offset LONG, cols ARRAY<LONG>, vals ARRAY<DOUBLE>
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

# Degrees of freedom per node, nodes per element type, material
# defaults, and the tolerances that decide degenerate volumes and a passed check.
DOFS_PER_NODE = 3
NODES_PER_TYPE = {"tet4": 4, "hex8": 8}
YOUNG_MODULUS = 210.0e9
POISSON_RATIO = 0.30
MIN_VOLUME = 1.0e-30
MIN_PIVOT = 1.0e-30
CHECK_REL_L2 = 1.0e-8
NEAR_ZERO = 1.0e-15

# Names of the nine entries of a node block, row-major.
BLOCK = [f"k{i}{j}" for i in range(3) for j in range(3)]


@dataclass(frozen=True)
class MeshFrames:
    """A mesh as two DataFrames; tet4 and hex8 rows may be mixed.

    ``coordinates``, if given, computes a node's x, y and z from its id, null where there is no such
    node, as the node table has them; then corners need no join.
    """

    nodes: DataFrame
    elements: DataFrame
    name: str = "mesh"
    coordinates: Callable[[Column], list[Column]] | None = None
