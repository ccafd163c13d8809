import pytest
from pyspark.sql import functions as F

from meshloom.functions.kernels import edge_vectors, falls_back, tet_determinant
from meshloom.operators import symbolic, topology
from meshloom.operators.corners import gather_corners
from meshloom.sources.grids import cube_hex8, cube_tet4, graded_cube, script_mesh, script_resolution


def test_cube_counts(spark):
    tets, hexes = cube_tet4(spark, 5, 5, 5), cube_hex8(spark, 5, 5, 5)
    assert tuple(topology.mesh_stats(tets).first()) == (216, 750, 648, "tet4")
    assert tuple(topology.mesh_stats(hexes).first()) == (216, 125, 648, "hex8")


def test_summary_line(spark):
    line = topology.mesh_summary(cube_hex8(spark, 2, 1, 1)).first()[0]
    assert line == "name=cube_hex8_2x1x1, nodes=12, elements=2, dofs=36, dominant_element=Hex8"


def test_golden_cube(spark):
    mesh = cube_tet4(spark, 8, 8, 8)
    assert tuple(topology.mesh_stats(mesh).first()) == (729, 3072, 2187, "tet4")
    assert symbolic.pattern(mesh).count() == 81_873


def test_uneven_cube_numbering(spark):
    mesh = cube_tet4(spark, 2, 3, 1, 4.0, 3.0, 2.0)
    nodes = {r["node_id"]: (r["x"], r["y"], r["z"]) for r in mesh.nodes.collect()}
    for k in range(2):
        for j in range(4):
            for i in range(3):
                assert nodes[(k * 4 + j) * 3 + i] == (4.0 * i / 2, 3.0 * j / 3, 2.0 * k / 1)
    first = mesh.elements.filter("elem_id < 6").orderBy("elem_id").collect()
    n = lambda i, j, k: (k * 4 + j) * 3 + i
    assert [list(r["nodes"]) for r in first[:2]] == [
        [n(0, 0, 0), n(1, 0, 0), n(1, 1, 0), n(1, 1, 1)],
        [n(0, 0, 0), n(1, 1, 0), n(0, 1, 0), n(1, 1, 1)],
    ]
    assert mesh.name == "cube_tet4_2x3x1"


def test_graded_cube_follows_its_spacing(spark):
    spacing = spark.createDataFrame([(0, 0, 1), (0, 1, 3), (2, 0, 5), (1, 2, None)], "axis int, cell long, length long")
    mesh = graded_cube(spark, "hex8", (2, 3, 1), spacing, (4.0, 3.0, 2.0))
    nodes = {r["node_id"]: (r["x"], r["y"], r["z"]) for r in mesh.nodes.collect()}
    assert nodes == {(k * 4 + j) * 3 + i: ((0.0, 1.0, 4.0)[i], float(j), 2.0 * k) for k in range(2) for j in range(4) for i in range(3)}
    even = graded_cube(spark, "tet4", (3, 2, 4), spacing.limit(0), (2.0, 1.0, 3.0))
    assert sorted(even.nodes.collect()) == sorted(cube_tet4(spark, 3, 2, 4, 2.0, 1.0, 3.0).nodes.collect())
    with pytest.raises(Exception, match="cell lengths must be positive"):
        graded_cube(spark, "hex8", (2, 3, 1), spacing.selectExpr("axis", "cell", "0L AS length")).nodes.collect()


def volumes(mesh):
    return tet_determinant(edge_vectors(gather_corners(mesh, (0, 1, 2, 3))))


def test_cube_fills_its_volume(spark):
    total = volumes(cube_tet4(spark, 3, 2, 4, 2.0, 1.0, 3.0)).agg(F.sum("volume")).first()[0]
    assert total == pytest.approx(6.0, rel=1e-12)


def test_script_mesh_has_one_flat_tet_per_cell(spark):
    mesh = script_mesh(spark, "tet4", 81 * 3)
    n = script_resolution(81 * 3)
    assert n == 4
    rows = volumes(mesh).groupBy(F.col("elem_id") % 6).agg(F.count_if(falls_back()).alias("flat"), F.sum("volume").alias("v"))
    by_slot = {r[0]: (r["flat"], r["v"]) for r in rows.collect()}
    assert [by_slot[s][0] for s in range(6)] == [0, 0, 0, 0, 0, n**3]
    assert by_slot[4][1] == pytest.approx(1 / 3, rel=1e-12)


@pytest.mark.parametrize("dims", [(0, 1, 1), (1, -1, 1), (1, 1, 0)])
def test_bad_dimensions(spark, dims):
    with pytest.raises(ValueError, match="positive"):
        cube_tet4(spark, *dims)
    with pytest.raises(ValueError, match="positive"):
        cube_hex8(spark, *dims)
