"""Element shares: what is exchanged, and the same results with and without hot nodes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meshloom.functions.dofs import row_owner
from meshloom.functions.kernels import coupling
from meshloom.operators import owners, symbolic, topology
from meshloom.operators.assemble import assemble
from meshloom.operators.contributions import near_zero_counts, scalar_contributions
from meshloom.operators.shares import plan_rows
from tests import meshes

SHARED = ["atomic", "private_csr", "coo_sort_reduce", "graph_coloring", "serial"]


def exchanges(df) -> list[str]:
    """The lines of the plan that move rows."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "Exchange" in line and "Reused" not in line]


@pytest.fixture(scope="module")
def mesh(spark):
    return meshes.frames(spark, *meshes.random_mesh(41))


@pytest.mark.parametrize("method", SHARED)
def test_blocks_are_not_exchanged(mesh, method):
    """Row digests of a matrix move elements and row digests only, never node pairs or entries."""
    digest = assemble(mesh, method=method, quanta=1e9).groupBy("row").agg({"value": "sum", "col": "min"})
    assert not any("nj" in line or "col#" in line for line in exchanges(digest))


@pytest.mark.parametrize("method", SHARED)
def test_hot_nodes_give_the_same_matrix(mesh, method):
    plan = plan_rows(mesh.elements, hot_pairs=10)
    assert plan_rows(mesh.elements).hot == () and 0 < len(plan.hot)
    want = meshes.as_dict(assemble(mesh, method=method, quanta=1e9))
    assert meshes.as_dict(assemble(mesh, method=method, quanta=1e9, plan=plan)) == want


def test_tasks_follow_the_pairs(mesh):
    assert plan_rows(mesh.elements, task_pairs=7).partitions > plan_rows(mesh.elements).partitions


def test_structure_needs_no_exchange_of_pairs(mesh):
    rows = symbolic.pattern(mesh).groupBy("row").count()
    assert not any("nj" in line for line in exchanges(rows))
    assert not any("nj" in line for line in exchanges(symbolic.pair_positions(mesh)))
    assert not any("nj" in line for line in exchanges(symbolic.scatter_plan(mesh)))


def test_structure_with_hot_nodes(mesh):
    plan = plan_rows(mesh.elements, hot_pairs=10)
    asked = symbolic.pattern(mesh).filter("(row + col) % 3 = 0").unionByName(mesh.nodes.selectExpr("node_id * 3 AS row", "10000L AS col"))
    for found in (
        lambda p: symbolic.row_offsets(mesh, p),
        lambda p: symbolic.pair_positions(mesh, plan=p),
        lambda p: symbolic.scatter_plan(mesh, p),
        lambda p: symbolic.locate_by_rows(asked, mesh, p),
    ):
        assert sorted(map(tuple, found(plan).collect())) == sorted(map(tuple, found(None).collect()))
    positions = {(r, c): p for r, c, p in symbolic.entry_positions(mesh).collect()}
    want = sorted((r, c, positions[r, c]) for r, c in map(tuple, asked.collect()) if (r, c) in positions)
    assert sorted(map(tuple, symbolic.locate_by_rows(asked, mesh).collect())) == want


def test_incidence_lists_move_each_corner_once(mesh):
    plan = plan_rows(mesh.elements, hot_pairs=10)
    want = sorted(map(tuple, topology.incidence_lists(mesh, 3).collect()))
    assert sorted(map(tuple, topology.incidence_lists(mesh, 3, plan).collect())) == want
    assert len(exchanges(topology.incidence_lists(mesh))) == 1


def test_near_zero_counts_in_one_pass(mesh):
    entries = scalar_contributions(mesh, coupling())
    want = entries.groupBy("row").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.abs("value") >= 1e-15).alias("kept"))
    found = near_zero_counts(mesh, coupling())
    assert found.columns == want.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert sum("Exchange hash" in line for line in exchanges(near_zero_counts(mesh, coupling()))) == 1


def test_owner_load_moves_no_element(mesh):
    load = owners.owner_load(mesh, 5)
    assert not any("elem_id" in line for line in exchanges(load))
    n = 3 * mesh.nodes.count()
    want: dict[int, list[int]] = {}
    for row in mesh.elements.collect():
        held = [min(4, (3 * v + c) * 5 // n) for v in row["nodes"] for c in range(3)]
        for owner in set(held):
            entry = want.setdefault(owner, [0, 0])
            entry[0], entry[1] = entry[0] + 1, entry[1] + held.count(owner) * len(held)
    assert {o: [e, t] for o, e, t in load.collect()} == want


def test_owner_rows_are_cut_into_ranges(mesh):
    n = 3 * mesh.nodes.count()
    whole = owners.assemble_by_owner(mesh, owners=3, quanta=1e9)
    cut = owners.assemble_by_owner(mesh, owners=3, quanta=1e9, task_pairs=40)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))
    assert cut.filter(F.col("owner") != row_owner(F.col("row"), 3, n)).isEmpty()
    plain = [owners.assemble_by_owner(mesh, owners=3, salting=False, quanta=1e9, task_pairs=pairs) for pairs in (10**6, 40)]
    spread = [len({r[0] for r in m.select(F.spark_partition_id()).distinct().collect()}) for m in plain]
    assert spread[1] > spread[0]
