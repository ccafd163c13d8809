"""Mesh-to-matrix analytics as Spark DataFrame jobs."""

from meshloom.model import MeshFrames
from meshloom.operators.assemble import METHODS, assemble
from meshloom.sources.decks import read_deck
from meshloom.sources.grids import cube_hex8, cube_tet4, script_mesh

__all__ = [
    "METHODS",
    "MeshFrames",
    "assemble",
    "cube_hex8",
    "cube_tet4",
    "read_deck",
    "script_mesh",
]
