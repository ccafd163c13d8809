"""What large jobs exchange and write, and the same results from the plans that keep it small."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meshloom.model import BLOCK
from meshloom.operators import arrowkernels, batches, compare, symbolic, topology
from meshloom.operators.assemble import assemble, assemble_blocks, assemble_parts
from meshloom.operators.corners import gather_corners
from meshloom.operators.shares import plan_rows
from meshloom.session import remove_cuts
from meshloom.sinks.writers import write_row_store
from meshloom.sources import decks
from meshloom.sources.grids import cube_tet4, script_mesh
from meshloom.sources.matrices import read_row_slice
from tests import meshes


def test_random_batches_write_one_table(spark, monkeypatch):
    """Rounds over what is left wrote a table each; slices are coloured once."""
    mesh = cube_tet4(spark, 6, 6, 6)
    for slice_elements in (batches.SLICE_ELEMENTS, 100):
        monkeypatch.setattr(batches, "SLICE_ELEMENTS", slice_elements)
        remove_cuts(spark)
        found = batches.conflict_free_batches(mesh)
        again = batches.conflict_free_batches(type(mesh)(mesh.nodes, mesh.elements.repartition(3)))
        assert found.count() == found.select("elem_id").distinct().count() == 1296
        assert batches.batch_conflicts(mesh, found).isEmpty()
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, again.collect()))
        assert remove_cuts(spark) == 2


def test_one_slice_is_first_fit(spark):
    coords, elements = meshes.random_mesh(43)
    found = batches.conflict_free_batches(meshes.frames(spark, coords, elements))
    assert {r["elem_id"]: r["batch"] for r in found.collect()} == meshes.first_fit(elements)


def exchanges(df) -> list[str]:
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "Exchange" in line and "Reused" not in line]


def test_matrices_of_one_plan_meet_where_they_are(spark):
    mesh = meshes.frames(spark, *meshes.random_mesh(47))
    tets = type(mesh)(mesh.nodes, mesh.elements.filter("type = 'tet4'"))
    whole, some = assemble(mesh, quanta=1e9), assemble(tets, quanta=1e9)
    double = whole.withColumn("value", F.col("value") * 2)
    for hot in (10**6, 10):
        plan = plan_rows(mesh.elements, hot_pairs=hot)
        parts, fewer = assemble_parts(mesh, quanta=1e9, plan=plan), assemble_parts(tets, quanta=1e9, plan=plan)
        twice = [p.withColumns({k: F.col(k) * 2 for k in BLOCK}) for p in parts]
        for b, want in ((parts, whole), (twice, double), (fewer, some)):
            assert tuple(compare.compare_parts(parts, b).first()) == pytest.approx(tuple(compare.compare(whole, want).first()))
            assert compare.same_structure_parts(parts, b).first() == compare.same_structure(whole, want).first()
        assert compare.same_structure_parts(symbolic.pair_parts(mesh, plan), parts).first()[0]
        if not plan.hot:
            for report in (compare.compare_parts(parts, fewer), compare.same_structure_parts(parts, fewer)):
                assert not any("nj" in line for line in exchanges(report))


@pytest.mark.parametrize("name", ["simplified", "physics_tet4"])
def test_batch_kernels_exchange_no_block(spark, name, monkeypatch):
    mesh = meshes.frames(spark, *meshes.random_mesh(53))
    want = meshes.as_dict(arrowkernels.assemble_batched(mesh, name, 1e6))
    digest = arrowkernels.assemble_batched(mesh, name, 1e6).groupBy("row").agg({"value": "sum", "col": "min"})
    assert not any("nj" in line or "k00" in line for line in exchanges(digest))
    plan = plan_rows(mesh.elements, hot_pairs=10)
    assert plan.hot and meshes.as_dict(arrowkernels.assemble_batched(mesh, name, 1e6, plan)) == want
    # Nodes of a batch's end are carried on; corners that cannot be broadcast are sent along.
    monkeypatch.setattr(arrowkernels, "BROADCAST_NODES", 1)
    monkeypatch.setattr(arrowkernels, "BATCH_ELEMENTS", 3)
    assert meshes.as_dict(arrowkernels.assemble_batched(mesh, name, 1e6)) == want


@pytest.mark.parametrize("width", [4, symbolic.PIECE // 4])
def test_csr_from_rows_where_they_are(spark, width):
    coords, elements = meshes.random_mesh(59)
    mesh = meshes.frames(spark, coords, elements)
    want = sorted(map(tuple, symbolic.pack_blocks(assemble_blocks(mesh, quanta=1e9), mesh.nodes, width).collect()))
    for hot in (10**6, 10):
        plan = plan_rows(mesh.elements, hot_pairs=hot)
        csr = symbolic.pack_rows(assemble_parts(mesh, quanta=1e9, plan=plan), mesh.nodes, width)
        assert sorted(map(tuple, csr.collect())) == want
        assert compare.csr_problems(csr, 3 * len(coords)).isEmpty()
        empty = symbolic.pack_rows(symbolic.pair_parts(mesh, plan), mesh.nodes, width)
        assert sorted(tuple(r)[:4] for r in empty.collect()) == [r[:4] for r in want]
        assert empty.selectExpr("sum(aggregate(vals, 0D, (x, y) -> x + abs(y)))").first()[0] == 0
        if not plan.hot:
            assert not any("nj" in line or "entries" in line for line in exchanges(csr))


@pytest.mark.parametrize("hot", [10**6, 10])
def test_conflict_degrees_exchange_no_pair(spark, hot):
    coords, elements = meshes.random_mesh(61)
    mesh = meshes.frames(spark, coords, elements)
    plan = plan_rows(mesh.elements, hot_pairs=hot)
    found = topology.conflict_degree(mesh, plan)
    assert {r["elem_id"]: r["degree"] for r in found.collect()} == {e: sum(f != e and bool(set(n) & set(m)) for f, m in elements) for e, n in elements}
    assert plan.hot or not any("nj" in line for line in exchanges(found))


def test_decks_place_lines_without_moving_them(spark, monkeypatch):
    lines = ["*NODE", "5, 0, 0, 0", "** c", "7, 1, 0, 0", "6, 0, 1, 0", "*NSET", "5", "*ELEMENT, TYPE=C3D4", "1, 5, 6, 7, 8", "2, 8, 7, 6, 5", "*NODE", "8, 0, 0, 1"]
    lines += ["*ELEMENT, TYPE=C3D4", "3, 8, 7, 6, 5", "4, 5, 5, 9, 9", "x", "5, 7, 8, 5, 6"]
    frame = spark.createDataFrame([(1000 * i**3, line) for i, line in enumerate(lines)], "line_no long, line string")

    def read():
        deck = decks.parse_deck(frame)
        mesh, unknown = decks.resolve_labels(deck)
        return [sorted(map(str, df.collect())) for df in (mesh.nodes, mesh.elements, unknown, deck.rejects)]

    found = read()
    assert [len(part) for part in found] == [4, 2, 3, 1]
    monkeypatch.setattr(decks, "BROADCAST_HEADERS", 1)
    monkeypatch.setattr(decks, "BROADCAST_NODES", 1)
    assert read() == found


def test_large_gathers_move_an_element_once(spark):
    """One row per corner meets the nodes; a join per corner moved the whole element each time."""
    grid = cube_tet4(spark, 3, 3, 3)
    mesh = type(grid)(grid.nodes, grid.elements)
    large, small = gather_corners(mesh, (0, 1, 2, 3), broadcast_nodes=0), gather_corners(mesh, (0, 1, 2, 3))
    assert sorted(map(str, large.collect())) == sorted(map(str, small.collect())) and large.columns == small.columns
    assert sum("nodes" in line for line in exchanges(large)) <= 1


@pytest.mark.parametrize("grid", [lambda s: cube_tet4(s, 4, 3, 2, 0.7, 1.3, 2.9), lambda s: script_mesh(s, "hex8", 700, 1.1, 2.3, 0.7)])
def test_grid_corners_are_computed_in_place(spark, grid):
    mesh = grid(spark)
    computed, joined = gather_corners(mesh, (0, 1, 2, 3)), gather_corners(type(mesh)(mesh.nodes, mesh.elements), (0, 1, 2, 3))
    assert sorted(map(str, computed.collect())) == sorted(map(str, joined.collect())) and computed.columns == joined.columns
    assert not exchanges(computed)
    lost = type(mesh)(mesh.nodes, mesh.elements.withColumn("nodes", F.transform("nodes", lambda n: n - 1)), "lost", mesh.coordinates)
    assert gather_corners(lost, (0,), strict=False).filter("x0 is null").count() > 0
    with pytest.raises(ValueError, match="unknown node"):
        gather_corners(lost, (0,))


def test_ordered_matrices_are_stored_as_they_are(spark, tmp_path):
    mesh = meshes.frames(spark, *meshes.random_mesh(67))
    matrix = assemble(mesh, method="coo_sort_reduce", quanta=1e6, partitions=5)
    assert not any("col#" in line for line in exchanges(matrix))
    write_row_store(matrix, str(tmp_path / "store"), ordered=True)
    want = {rc: v for rc, v in meshes.as_dict(assemble(mesh, quanta=1e6)).items() if 7 <= rc[0] <= 19}
    assert meshes.as_dict(read_row_slice(spark, str(tmp_path / "store"), 7, 19)) == want
    files = sorted(map(tuple, spark.read.parquet(str(tmp_path / "store" / "files")).select("first_row", "last_row").collect()))
    assert len(files) > 1 and all(a[1] < b[0] for a, b in zip(files, files[1:]))
