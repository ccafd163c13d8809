"""Headline timings as one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each
query runs once on tables and meshes a tenth as large to warm up, and once timed. Results go to the no-op sink, so the whole result is computed and nothing
is collected.
"""

from __future__ import annotations

import json
import os
import time

from meshloom.functions.kernels import physics_tet4, simplified
from meshloom.operators import batches, symbolic
from meshloom.operators.assemble import assemble, assemble_blocks, sum_blocks
from meshloom.operators.contributions import blocks_of, prepared_elements
from meshloom.plans.catalog import QUERIES
from meshloom.plans.derived import cube_resolution, order_mesh, table
from meshloom.session import local_session, remove_cuts
from meshloom.sources.grids import cube_tet4

# Cells per edge of a generated mesh as large as the reference's engineering mesh.
HUB_CELLS = 57
REGISTERED = [
    "order_conflict_degree",
    "order_csr",
    "order_row_offsets",
    "order_scatter",
    "vector_physics",
    "run_highlights",
    "run_stage_breakdown",
    "run_summary_layout",
]


def jobs_of(spark, sf_dir: str, cells: int) -> dict:
    n = cube_resolution(table(spark, sf_dir, "lineitem"))
    cube = cube_tet4(spark, n, n, n)
    hub = cube_tet4(spark, cells, cells, cells)
    orders = order_mesh(spark, sf_dir)
    # The numeric phase alone: elements with corners and gradients are already in memory.
    prepared = prepared_elements(hub, physics_tet4()).cache()
    prepared.count()
    physics = physics_tet4()
    methods = ("atomic", "serial", "private_csr", "coo_sort_reduce", "row_owner", "graph_coloring")
    return {
        "hub_size_blocks_simplified": lambda: assemble_blocks(hub),
        "hub_size_blocks_physics": lambda: assemble_blocks(hub, physics),
        "hub_size_blocks_physics_numeric": lambda: sum_blocks(blocks_of(prepared, physics, [])),
        **{f"hub_size_matrix_{method}": lambda method=method: assemble(hub, physics, method) for method in methods},
        "cube_pattern": lambda: symbolic.pattern(cube),
        "cube_batches": lambda: batches.conflict_free_batches(cube),
        "order_mesh_simplified": lambda: assemble(orders, simplified()),
        "order_mesh_physics": lambda: assemble(orders, physics),
        **{name: lambda name=name: QUERIES[name](spark, sf_dir) for name in REGISTERED},
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=16, memory="12g")
    spark.sparkContext.setLogLevel("OFF")
    small = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    warm = jobs_of(spark, small if os.path.isdir(small) else sf_dir, HUB_CELLS // 2)
    for job in warm.values():
        job().write.format("noop").mode("overwrite").save()
    spark.catalog.clearCache()
    timings = {}
    for name, job in jobs_of(spark, sf_dir, HUB_CELLS).items():
        start = time.perf_counter()
        job().write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    remove_cuts(spark)
    result = {
        "metric": "total seconds of headline queries",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "cpus": cpus,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
