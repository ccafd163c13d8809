"""Batch kernels next to the plain sums and the code-generated kernels."""

import numpy as np
import pytest

from meshloom.functions.kernels import physics_tet4
from meshloom.operators import arrowkernels
from meshloom.operators.assemble import assemble
from meshloom.sources.grids import cube_tet4
from tests import meshes


@pytest.mark.parametrize("name", ["simplified", "physics_tet4"])
def test_against_plain_sums(spark, name):
    coords, elements = meshes.random_mesh(5)
    mesh = meshes.frames(spark, coords, elements)
    got = meshes.as_dict(arrowkernels.assemble_batched(mesh, name))
    want = meshes.assemble(coords, elements, "physics" if name == "physics_tet4" else name)
    assert got.keys() == want.keys()
    top = max(map(abs, want.values()))
    assert all(abs(got[k] - v) <= 1e-9 * top for k, v in want.items())


def test_equals_the_native_kernel(spark):
    mesh = cube_tet4(spark, 3, 2, 2)
    native = meshes.as_dict(assemble(mesh, physics_tet4(210.0), quanta=1e6))
    batched = meshes.as_dict(arrowkernels.assemble_batched(mesh, arrowkernels.physics_matrices(210.0), quanta=1e6))
    # Values that rounding decides may differ by a quantum per element.
    assert native.keys() == batched.keys()
    assert max(abs(native[k] - batched[k]) for k in native) <= 24e-6


def test_own_kernel_and_rows_exchanged(spark):
    def ones(ids, nodes, corners):
        return np.ones((len(ids), 3 * nodes.shape[1], 3 * nodes.shape[1]))

    arrowkernels.register_kernel("ones", ones)
    with pytest.raises(ValueError, match="already"):
        arrowkernels.register_kernel("ones", ones)
    with pytest.raises(ValueError, match="unknown kernel"):
        arrowkernels.batch_kernel("none")
    mesh = cube_tet4(spark, 4, 4, 4)
    one_task = type(mesh)(mesh.nodes, mesh.elements.coalesce(1))
    rows = arrowkernels.batch_blocks(one_task, ones)
    pairs = rows.select("ni", "nj").distinct().count()
    # 384 elements give 3 840 upper pairs; a batch hands on each distinct one once.
    assert rows.count() == pairs < 1500
    total = arrowkernels.assemble_batched(mesh, "ones").agg({"value": "sum"}).first()[0]
    assert total == 384 * 144
    assert arrowkernels.assemble_batched(type(mesh)(mesh.nodes, mesh.elements.filter("false")), "ones").isEmpty()


def test_small_pivots_fall_back(spark):
    coords = [(0.0, 0.0, 0.0), (1000.0, 0.0, 0.0), (0.0, 1000.0, 0.0), (0.0, 0.0, 1e-31), (0.0, 0.0, 1e-29)]
    mesh = meshes.frames(spark, coords, [(0, [0, 1, 2, 3]), (1, [3, 2, 1, 0]), (2, [0, 1, 2, 4])])
    native = meshes.as_dict(assemble(mesh, physics_tet4(210.0)))
    batched = meshes.as_dict(arrowkernels.assemble_batched(mesh, arrowkernels.physics_matrices(210.0)))
    # The first two give matrices of size one, the third one of 1e-24 / 1e-58.
    assert batched[0, 0] == pytest.approx(native[0, 0], rel=1e-12)
    assert batched[9, 9] == native[9, 9] == pytest.approx(4.0, abs=0.1)
