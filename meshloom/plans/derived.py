"""Meshes, decks and run logs derived from the analytics tables.

The tables hold no meshes, so the registered queries build them: a distinct pair of order and
part is an element, an embedding is a chain of tets, an event is one timed repeat of a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.model import MeshFrames
from meshloom.operators.runlog import derive_status, derived_metrics, repeat_statistics

RUN_THREADS = [1, 2, 4, 8, 14]
RUN_KEYS = ["case_name", "kernel", "algorithm", "threads"]
RUN_ALGORITHMS = {
    "click": "cpu_serial",
    "view": "cpu_atomic",
    "purchase": "cpu_private_csr",
    "signup": "cpu_row_owner",
    "error": "cpu_graph_coloring",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube_edge(tets: int) -> int:
    """The largest n whose cube has at most ``tets`` elements, 6 * n**3, or 1."""
    n = 1
    while 6 * (n + 1) ** 3 <= tets:
        n += 1
    return n


def cube_resolution(df: DataFrame) -> int:
    """The edge of a cube with a tet for each row of ``df``."""
    return cube_edge(df.count())


def total_edge(df: DataFrame, column: str, divisor: int = 1) -> int:
    """The edge of a cube with a tet for every ``divisor`` of the sum of ``column`` (whole parts)."""
    return cube_edge((df.agg(F.sum(F.floor(column))).first()[0] or 0) // divisor)


def part_spacing(spark: SparkSession, sf_dir: str, cells: int) -> DataFrame:
    """axis, cell, length: each part lengthens a cell by its size along x, its price along y and its type's name along z."""
    parts = table(spark, sf_dir, "part")
    lengths = F.array(F.col("p_size").cast("long"), F.floor("p_retailprice"), F.length("p_type").cast("long"))
    rows = parts.select((F.col("p_partkey") % cells).alias("cell"), F.posexplode(lengths).alias("axis", "more"))
    return rows.groupBy("axis", "cell").agg((F.sum("more") + 1).alias("length"))


def order_shares(spark: SparkSession, sf_dir: str) -> tuple[int, tuple[float, float, float]]:
    """The number of orders, and box lengths: 1 plus the share of orders per customer, fulfilled and urgent."""
    row = (
        table(spark, sf_dir, "orders")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("o_custkey").alias("customers"),
            F.count_if(F.col("o_orderstatus") == "F").alias("fulfilled"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        )
        .first()
    )
    rows = row["n"]
    return rows, tuple(1.0 + row[c] / (rows or 1) for c in ("customers", "fulfilled", "urgent"))


def part_count(spark: SparkSession, sf_dir: str) -> int:
    """One above the largest part key."""
    return (table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] or 0) + 1


def order_mesh(spark: SparkSession, sf_dir: str) -> MeshFrames:
    """Every distinct (order, part) pair is one element, and every part is a node.

    The pair's part is the first corner; the others follow in steps that depend on both keys,
    modulo the part count. The pairs of every fifth order are hexes, the others tets. The
    pairs need one distinct, no window and no list.
    """
    parts = part_count(spark, sf_dir)
    order, part = F.col("l_orderkey"), F.col("l_partkey")
    step = (order * 13 + part * 7) % max(parts // 8, 1) + 1
    corner = lambda slot: (part + step * slot) % parts
    wide = order % 5 == 0
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    elements = pairs.select(
        (order * parts + part).alias("elem_id"),
        F.when(wide, "hex8").otherwise("tet4").alias("type"),
        F.when(wide, F.array(*map(corner, range(8)))).otherwise(F.array(*map(corner, range(4)))).alias("nodes"),
    )
    nodes = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("node_id"),
        F.col("p_size").cast("double").alias("x"),
        (F.col("p_retailprice") / F.lit(100.0)).alias("y"),
        ((F.col("p_partkey") * 37 % 101) / F.lit(10.0)).alias("z"),
    )
    return MeshFrames(nodes, elements, "orders")


def vector_mesh(spark: SparkSession, sf_dir: str) -> MeshFrames:
    """Each embedding is a chain of points in space and the tets of consecutive points.

    All values count: three make a point, and the last point is filled up with zeros. Ids
    leave room for the longest vector.
    """
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.size("embedding").alias("n"))
    room = -(-(vectors.agg(F.max("n")).first()[0] or 0) // 3)
    count = F.ceil(F.col("n") / 3).cast("int")
    at = [F.coalesce(F.get("embedding", F.col("t") * 3 + c).cast("double"), F.lit(0.0)).alias(name) for c, name in enumerate("xyz")]
    points = vectors.filter("n > 0").withColumn("t", F.explode(F.sequence(F.lit(0), count - 1)))
    nodes = points.select((F.col("vec_id") * room + F.col("t")).alias("node_id"), *at)
    chains = vectors.filter(count >= 4).withColumn("t", F.explode(F.sequence(F.lit(0), count - 4)))
    first = F.col("vec_id") * room + F.col("t")
    elements = chains.select(first.alias("elem_id"), F.lit("tet4").alias("type"), F.array(*[first + s for s in range(4)]).alias("nodes"))
    return MeshFrames(nodes, elements, "vectors")


def order_deck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order mesh written as deck lines (line_no, line), with labels 10 * part + 7.

    Line numbers have gaps; a comment follows every node line, and an unrelated section
    separates the two element sections.
    """
    mesh = order_mesh(spark, sf_dir)
    n = part_count(spark, sf_dir)
    m = (table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0] + 1) * n
    tets, sets, hexes = 2 * n + 10, 2 * n + m + 20, 2 * n + 2 * m + 30
    headers = [
        (1, "*Heading"),
        (2, "** derived from orders and parts"),
        (3, "*Node"),
        (tets, "*Element, type=C3D4, elset=SMALL"),
        (sets, "*Nset, nset=PARTS"),
        (hexes, "*ELEMENT, TYPE=C3D8R"),
    ]
    head = spark.createDataFrame(headers, "line_no long, line string")
    at = F.col("node_id") * 2 + 4
    label = (F.col("node_id") * 10 + 7).alias("label")
    node = mesh.nodes.select(at.alias("line_no"), F.concat_ws(", ", label, "x", "y", "z").alias("line"))
    comment = mesh.nodes.select((at + 1).alias("line_no"), F.concat(F.lit("** part "), "node_id").alias("line"))
    member = mesh.nodes.select((F.col("node_id") + sets + 1).alias("line_no"), label.cast("string").alias("line"))
    labels = F.array_join(F.transform("nodes", lambda v: (v * 10 + 7).cast("string")), ", ")
    start = F.when(F.col("type") == "tet4", F.lit(tets)).otherwise(F.lit(hexes)).cast("long")
    element = mesh.elements.select(
        (start + 1 + F.col("elem_id")).alias("line_no"), F.concat_ws(",", F.col("elem_id") + 100, labels).alias("line")
    )
    return head.unionByName(node).unionByName(comment).unionByName(member).unionByName(element)


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timed repeats; times are whole numbers, so their sums are exact."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    algorithm = F.lit("")
    for event_type, name in RUN_ALGORITHMS.items():
        algorithm = F.when(F.col("event_type") == event_type, F.lit(name)).otherwise(algorithm)
    threads = F.array(*[F.lit(t) for t in RUN_THREADS])[(F.col("user_id") % 5).cast("int")]
    ms = F.floor(F.col("value") * F.lit(100.0) + F.lit(0.5)).cast("double")
    base = events.select(
        "event_id",
        F.concat(F.lit("case_"), F.col("event_id") % 3).alias("case_name"),
        F.when(F.col("user_id") % 2 == 0, "simplified").otherwise("physics_tet4").alias("kernel"),
        algorithm.alias("algorithm"),
        F.when(algorithm == "cpu_serial", F.lit(1)).otherwise(threads).alias("threads"),
        ms.alias("assembly_ms"),
    )
    part = lambda divisor: F.floor(F.col("assembly_ms") / F.lit(divisor)).cast("double")
    atomic = F.col("algorithm") == "cpu_atomic"
    zero = F.lit(0.0)
    return base.withColumns(
        {
            "total_ms": F.col("assembly_ms") + part(4.0),
            "preprocess_ms": part(4.0),
            "assembly_zero_ms": part(16.0),
            "assembly_generate_ms": F.when(atomic, zero).otherwise(part(8.0)),
            "assembly_numeric_ms": part(2.0),
            "assembly_merge_ms": F.when(F.col("algorithm") == "cpu_private_csr", part(5.0)).otherwise(zero),
            "assembly_sort_ms": zero,
            "assembly_reduce_ms": zero,
        }
    )


def event_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per dataset, algorithm and threads, with repeat statistics."""
    samples = event_samples(spark, sf_dir)
    stats = repeat_statistics(samples, RUN_KEYS)
    pre = samples.groupBy(*RUN_KEYS).agg(F.max("preprocess_ms").alias("preprocess_ms"))
    return stats.join(pre, RUN_KEYS).withColumn("effective_threads", F.col("threads"))


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finished run log: statistics, metrics and a status per run."""
    runs = derived_metrics(event_statistics(spark, sf_dir))
    coloring = F.col("algorithm") == "cpu_graph_coloring"
    inexact = (F.col("algorithm") == "cpu_row_owner") & (F.col("threads") == 8) & (F.col("case_name") == "case_1")
    runs = runs.withColumns(
        {
            "assembly_ms": F.col("assembly_mean_ms"),
            "total_ms": F.col("total_mean_ms"),
            "rel_l2": F.when(inexact, F.lit(1.0e-6)).otherwise(F.lit(0.0)),
            "same_structure": F.lit(True),
            "error": F.when(coloring & (F.col("threads") == 14), F.lit("estimate is Above Limit of the run")),
            "note": F.when(coloring, F.lit("first fit")),
            "extra_memory_bytes": F.col("run_count").cast("long") * F.col("threads") * 1048576,
            "prepare_allocate_ms": F.when(F.col("algorithm") == "cpu_private_csr", F.col("preprocess_ms")).otherwise(0.0),
            "prepare_coloring_ms": F.when(coloring, F.col("preprocess_ms")).otherwise(0.0),
            "prepare_owner_partition_ms": F.when(F.col("algorithm") == "cpu_row_owner", F.col("preprocess_ms")).otherwise(0.0),
        }
    )
    index = F.lit(0)
    for at, name in enumerate(RUN_ALGORITHMS.values()):
        index = F.when(F.col("algorithm") == name, F.lit(at)).otherwise(index)
    case_no = F.substring("case_name", 6, 10).cast("long")
    physics = (F.col("kernel") == "physics_tet4").cast("long")
    ordinal = ((case_no * 2 + physics) * 10 + index) * 100 + F.col("threads")
    return derive_status(runs).withColumn("ordinal", ordinal)
