import math

import pytest
from pyspark.sql import functions as F

from meshloom.functions.kernels import coupling, edge_vectors, falls_back, kernel_by_name, physics_tet4, simplified, tet_determinant
from meshloom.operators import batches, compare
from meshloom.operators.assemble import METHODS, assemble, assemble_blocks, assemble_by_batch, blocks_to_matrix
from meshloom.operators.contributions import scalar_contributions
from meshloom.operators.corners import gather_corners, missing_nodes
from meshloom.operators.owners import _salts, assemble_by_owner, owner_load, owner_replication
from meshloom.sources.grids import cube_tet4
from tests import meshes


@pytest.mark.parametrize("method", list(METHODS))
@pytest.mark.parametrize("kernel", ["simplified", "physics"])
def test_methods_agree_with_brute_force(spark, method, kernel):
    coords, elements = meshes.random_mesh(7)
    mesh = meshes.frames(spark, coords, elements)
    used = simplified() if kernel == "simplified" else physics_tet4()
    got = meshes.as_dict(assemble(mesh, used, method))
    want = meshes.assemble(coords, elements, kernel)
    assert got.keys() == want.keys()
    scale = max(abs(v) for v in want.values())
    assert max(abs(got[k] - want[k]) for k in want) <= 1e-12 * scale


def test_serial_and_owner_are_near_the_left_fold(spark):
    coords, elements = meshes.random_mesh(11)
    mesh = meshes.frames(spark, coords, elements)
    want = meshes.assemble(coords, elements)
    for method, options in (("serial", {}), ("row_owner", {"owners": 5})):
        got = meshes.as_dict(assemble(mesh, method=method, **options))
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k], rel_tol=1e-14) for k in want)


def test_serial_sums_do_not_depend_on_order(spark):
    coords, elements = meshes.random_mesh(13)
    once = meshes.as_dict(assemble(meshes.frames(spark, coords, elements), method="serial"))
    again = meshes.as_dict(assemble(meshes.frames(spark, coords, elements[::-1]), method="serial"))
    assert once == again
    want = meshes.assemble(coords, elements)
    assert all(math.isclose(once[k], want[k], rel_tol=1e-14) for k in want)


def test_serial_sums_of_one_hot_pair(spark):
    """More elements on one node pair than any size constant of the library."""
    count = 150_000
    ids = spark.range(count, numPartitions=5)
    exact = math.fsum(2.0 * (1.0 + (e * 17 % 97) * 1e-4) for e in range(count))
    sums = set()
    for elements in (ids, spark.range(count - 1, -1, -1, numPartitions=3)):
        mesh = meshes.MeshFrames(
            spark.range(4).selectExpr("id AS node_id", "double(id) AS x", "0D AS y", "0D AS z"),
            elements.selectExpr("id AS elem_id", "'tet4' AS type", "array(0L, 1L, 2L, 3L) AS nodes"),
        )
        sums.add(assemble(mesh, method="serial").filter("row = 0 and col = 0").first()["value"])
    assert len(sums) == 1 and math.isclose(sums.pop(), exact, rel_tol=1e-15)


def test_quanta_make_all_methods_identical(spark):
    coords, elements = meshes.random_mesh(17)
    mesh = meshes.frames(spark, coords, elements)
    results = [meshes.as_dict(assemble(mesh, physics_tet4(210.0), m, quanta=1e6)) for m in METHODS]
    assert all(r == results[0] for r in results)


def test_broadcast_and_shuffle_gather_agree(spark):
    coords, elements = meshes.random_mesh(19)
    mesh = meshes.frames(spark, coords, elements)
    small = gather_corners(mesh, (0, 1, 2, 3, 4))
    large = gather_corners(mesh, (0, 1, 2, 3, 4), broadcast_nodes=0)
    columns = sorted(small.columns)
    assert sorted(map(repr, small.select(columns).collect())) == sorted(map(repr, large.select(columns).collect()))


def test_missing_node_is_an_error(spark):
    mesh = meshes.frames(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, [0, 1, 2, 9])])
    assert [tuple(r) for r in missing_nodes(mesh).collect()] == [(0, 9)]
    for limit in (0, 100):
        with pytest.raises(Exception, match="unknown node"):
            gather_corners(mesh, (0, 1, 2, 3), broadcast_nodes=limit).collect()
        assert gather_corners(mesh, (0, 1, 2, 3), broadcast_nodes=limit, strict=False).count() == 1
    with pytest.raises(Exception, match="unknown node"):
        assemble(mesh)


def test_gather_keeps_columns_and_rejects_repeated_nodes(spark):
    coords, elements = meshes.random_mesh(19)
    mesh = meshes.frames(spark, coords, elements)
    tagged = meshes.MeshFrames(mesh.nodes, mesh.elements.withColumn("tag", F.col("elem_id") * 2))
    for limit in (0, 100_000):
        got = gather_corners(tagged, (0, 5), broadcast_nodes=limit)
        assert {(r["elem_id"], r["tag"]) for r in got.collect()} == {(e, 2 * e) for e, _ in elements}
        with pytest.raises(ValueError, match="repeat"):
            gather_corners(meshes.MeshFrames(mesh.nodes.unionByName(mesh.nodes), mesh.elements), (0,), broadcast_nodes=limit)


def test_fallbacks(spark):
    flat = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), (0, 0, float("nan"))]
    elements = [(0, [0, 1, 2, 3]), (1, [0, 1, 2, 4])]
    mesh = meshes.frames(spark, flat, elements)
    got = meshes.as_dict(assemble(mesh, physics_tet4()))
    want = meshes.assemble(flat, elements, "simplified")
    assert got == pytest.approx(want, rel=1e-14)


def test_small_pivots_fall_back(spark):
    """Volumes above the limit with a pivot below it, in either order of the corners; a pivot above stays."""
    far = 1000.0
    coords = [(0, 0, 0), (far, 0, 0), (0, far, 0), (0, 0, 1e-31), (0, 0, 1e-29), (0, 1e-31, 0), (0, 0, far)]
    elements = [(0, [0, 1, 2, 3]), (1, [3, 2, 1, 0]), (2, [0, 1, 2, 4]), (3, [0, 1, 6, 5])]
    mesh = meshes.frames(spark, [tuple(float(c) for c in p) for p in coords], elements)
    rows = tet_determinant(edge_vectors(gather_corners(mesh, (0, 1, 2, 3)))).select("elem_id", "volume", falls_back().alias("out")).collect()
    assert all(r["volume"] > 1e-30 for r in rows)
    assert {r["elem_id"]: r["out"] for r in rows} == {0: True, 1: True, 2: False, 3: True}


def test_pivots_equal_plain_elimination(spark):
    coords, elements = meshes.random_mesh(23)
    tets = [(e, n) for e, n in elements if len(n) == 4]
    rows = tet_determinant(edge_vectors(gather_corners(meshes.frames(spark, coords, tets), (0, 1, 2, 3)))).select("elem_id", "pivot").collect()
    got = {r["elem_id"]: r["pivot"] for r in rows}
    for e, n in tets:
        left = [list(map(float, (1, *coords[c]))) for c in n]
        least = float("inf")
        for column in range(4):
            top = max(range(len(left)), key=lambda s: (abs(left[s][column]), -s))
            left[0], left[top] = left[top], left[0]
            row = left.pop(0)
            least = min(least, abs(row[column])) if column else least
            if row[column] == 0:
                break
            left = [[v - r[column] * (p / row[column]) for v, p in zip(r, row)] for r in left]
        assert got[e] == pytest.approx(least, rel=1e-9, abs=1e-12)


def test_physics_is_symmetric_and_blind_to_translation(spark):
    matrix = assemble(cube_tet4(spark, 4, 4, 4), physics_tet4(210.0)).cache()
    mirrored = matrix.selectExpr("col AS row", "row AS col", "value")
    assert compare.compare(matrix, mirrored).first()["rel_l2"] == 0.0
    sums = matrix.groupBy("row", F.col("col") % 3).agg(F.abs(F.sum("value")).alias("s")).agg(F.max("s")).first()[0]
    assert sums < 1e-9
    matrix.unpersist()


def test_kernel_names():
    assert kernel_by_name("Synthetic").name == "simplified"
    assert kernel_by_name("c3d4").name == "physics_tet4"
    assert kernel_by_name("coupling").name == "coupling"
    with pytest.raises(ValueError, match="unsupported kernel"):
        kernel_by_name("none")


def test_hot_node(spark):
    """A third and more of all elements share node 0."""
    coords = [(math.cos(i), math.sin(i * 1.7), i % 7) for i in range(200)]
    elements = [(e, [0, 1 + e % 190, 2 + e % 190, 3 + (e * 7) % 190]) for e in range(150)]
    elements += [(150 + e, [10 + e % 150, 11 + e % 150, 12 + e % 150, 13 + e % 150]) for e in range(150)]
    mesh = meshes.frames(spark, coords, elements)
    want = meshes.assemble(coords, elements)
    assert _salts(mesh, 8, 600)
    for got in (assemble_by_owner(mesh, owners=8), assemble(mesh, method="private"), assemble(mesh, method="coloring")):
        assert meshes.as_dict(got) == pytest.approx(want, rel=1e-13)
    found = batches.conflict_free_batches(mesh)
    assert found.count() == found.select("elem_id").distinct().count() == 300
    assert batches.batch_conflicts(mesh, found).isEmpty()


def test_owner_reports(spark):
    coords, elements = meshes.random_mesh(23)
    mesh = meshes.frames(spark, coords, elements)
    n, owners = 3 * len(coords), 7
    owner = lambda d: min(owners - 1, d * owners // n)
    load = {r["owner"]: (r["elements"], r["tasks"]) for r in owner_load(mesh, owners).collect()}
    want = {}
    for _, nodes in elements:
        at = [owner(d) for d in meshes.dofs(nodes)]
        for o in set(at):
            e, t = want.get(o, (0, 0))
            want[o] = (e + 1, t + at.count(o) * len(at))
    assert load == want
    assert sum(r["elements"] for r in owner_replication(mesh, owners).collect()) == len(elements)


def test_batch_fold_only_depends_on_batches(spark):
    coords, elements = meshes.random_mesh(29)
    mesh = meshes.frames(spark, coords, elements)
    found = batches.conflict_free_batches(mesh, order="element")
    got = meshes.as_dict(blocks_to_matrix(assemble_by_batch(mesh, found)))
    colors = meshes.first_fit(elements)
    assert {r["elem_id"]: r["batch"] for r in found.collect()} == colors
    want = meshes.as_dict(assemble(mesh, method="serial"))
    assert got == want


def test_coupling_entries(spark):
    coords = [(0, 0, 0), (2, 0, 0), (0, 3, 0), (0, 0, 5), (0, 0, 7), (1, 1, 1), (2, 2, 2), (3, 3, 3)]
    mesh = meshes.frames(spark, coords, [(0, [0, 1, 2, 3]), (1, [0, 1, 6, 2, 4, 5, 7, 3])])
    rows = scalar_contributions(mesh, coupling()).collect()
    for r in rows:
        volume = 5.0 if r["elem_id"] == 0 else 2.0 * 3.0 * 7.0
        if r["i"] == r["j"]:
            want = (4.0 if r["elem_id"] == 0 else 8.0) / volume
        else:
            want = -0.5 / volume if r["i"] % 3 == r["j"] % 3 else 0.0
        assert r["value"] == pytest.approx(want, rel=1e-14)
    kept = scalar_contributions(mesh, coupling(), drop_near_zero=True)
    assert kept.count() == sum(abs(r["value"]) >= 1e-15 for r in rows) < len(rows)


def test_negative_box_volume_is_clamped(spark):
    coords = [(0, 0, 0), (-1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    mesh = meshes.frames(spark, coords, [(0, list(range(8)))])
    assert meshes.as_dict(blocks_to_matrix(assemble_blocks(mesh, coupling())))[0, 0] == 8.0 * (1.0 / 1e-10)
