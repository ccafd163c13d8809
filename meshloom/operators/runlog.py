"""Run-log analytics: statistics, derived metrics, best runs, pivots and summaries.

``runs`` is the typed run log of ``sources.runlogs`` with its ``ordinal`` column; ties
are broken by it, so the first row in file order wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.text import bytes_to_gib, classify_skip_reason, memory_string
from meshloom.model import CHECK_REL_L2

DATASET = ["case_name", "kernel"]
SERIAL = "cpu_serial"
# Stage columns in stacking order, with their display labels.
STAGES = {
    "prepare_allocate_ms": "预分配",
    "prepare_coloring_ms": "着色预处理",
    "prepare_owner_partition_ms": "owner 划分",
    "assembly_zero_ms": "装配前清零",
    "assembly_generate_ms": "局部贡献生成",
    "assembly_numeric_ms": "数值装配",
    "assembly_merge_ms": "线程结果合并",
    "assembly_sort_ms": "排序",
    "assembly_reduce_ms": "归并/规约",
}
REPEATED_STAGES = [s for s in STAGES if s.startswith("assembly_")]
ZERO_STAGE = 1.0e-8
LOG_FLOOR = 1.0e-9


def pass_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status") == "PASS")


def repeat_statistics(samples: DataFrame, keys: list[str], stages: list[str] | None = None) -> DataFrame:
    """Mean, min, max and population deviation of repeated runs, and mean stage times.

    ``samples`` has one row per repeat with ``assembly_ms`` and ``total_ms``. One repeat
    has deviation 0.
    """
    stages = REPEATED_STAGES if stages is None else stages
    aggregates = [F.count(F.lit(1)).cast("int").alias("run_count")]
    for part in ("assembly", "total"):
        column = f"{part}_ms"
        aggregates += [
            F.avg(column).alias(f"{part}_mean_ms"),
            F.min(column).alias(f"{part}_min_ms"),
            F.max(column).alias(f"{part}_max_ms"),
            F.coalesce(F.stddev_pop(column), F.lit(0.0)).alias(f"{part}_std_ms"),
        ]
    aggregates += [F.avg(s).alias(s) for s in stages]
    return samples.groupBy(*keys).agg(*aggregates)


def _ratio(top: str, bottom: str) -> Column:
    """top / bottom, and 0 unless the denominator is positive."""
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def derived_metrics(stats: DataFrame, dataset: list[str] | None = None) -> DataFrame:
    """Add speedup, efficiency and preprocess_share.

    The baseline of a dataset is its serial run with the fewest threads; without one the
    speedup is 0.
    """
    dataset = dataset or DATASET
    serial = stats.filter(F.col("algorithm") == SERIAL)
    baseline = serial.groupBy(*dataset).agg(F.min_by("assembly_mean_ms", "threads").alias("serial_ms"))
    joined = stats.join(baseline, dataset, "left").withColumn("serial_ms", F.coalesce("serial_ms", F.lit(0.0)))
    return (
        joined.withColumn("speedup", _ratio("serial_ms", "assembly_mean_ms"))
        .withColumn("efficiency", _ratio("speedup", "effective_threads"))
        .withColumn("preprocess_share", _ratio("preprocess_ms", "total_mean_ms"))
        .drop("serial_ms")
    )


def derive_status(runs: DataFrame, check: bool = True) -> DataFrame:
    """Add status, skip_reason and diagnostics from same_structure, rel_l2, error, note.

    ``error`` is the text of a failed run (NULL when it ran); ``note`` is a method's own
    diagnostics.
    """
    failed_run = F.col("error").isNotNull()
    reason = F.when(failed_run, classify_skip_reason(F.col("error"))).otherwise(F.lit(""))
    wrong = F.lit(check) & (~F.col("same_structure") | (F.col("rel_l2") > F.lit(CHECK_REL_L2)))
    out = runs.withColumn("skip_reason", reason)
    hard = F.col("skip_reason").isin("INPUT_NOT_READY", "CLI_ERROR")
    status = F.when(failed_run & hard, "FAIL").when(failed_run, "SKIP").when(wrong, "FAIL").otherwise("PASS")
    text = F.when(failed_run, F.col("error")).when(wrong, F.lit("Correctness check failed"))
    return out.withColumn("status", status).withColumn("diagnostics", text.otherwise(F.coalesce("note", F.lit(""))))


def _first_by(metric: str, largest: bool = False) -> Column:
    """Sort key of a winner: the metric, then file order."""
    value = -F.col(metric) if largest else F.col(metric)
    return F.struct(value, F.col("ordinal"))


def best_per_algorithm(runs: DataFrame, metric: str = "assembly_ms", keys: list[str] | None = None) -> DataFrame:
    """The row with the smallest metric per algorithm (per dataset by default).

    The rank filter is applied before the shuffle as well, so a task sends at most one
    row per group.
    """
    keys = [*DATASET, "algorithm"] if keys is None else keys
    window = Window.partitionBy(*keys).orderBy(metric, "ordinal")
    return runs.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def highlights(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Fastest, best speedup and lowest memory of the PASS rows, per dataset.

    Serial rows cannot win the speedup; a dataset with nothing else names its fastest.
    """
    keys = DATASET if keys is None else keys
    row = F.struct("algorithm", "threads", "assembly_ms", "speedup", "extra_memory_bytes")
    parallel = F.col("algorithm") != SERIAL
    best = pass_runs(runs).groupBy(*keys).agg(
        F.min_by(row, _first_by("assembly_ms")).alias("fastest"),
        F.min_by(row, F.when(parallel, _first_by("speedup", largest=True))).alias("best_parallel"),
        F.min_by(row, _first_by("extra_memory_bytes")).alias("lightest"),
    )
    best = best.withColumn("best_parallel", F.coalesce("best_parallel", "fastest"))
    return best.select(
        *keys,
        F.col("fastest.algorithm").alias("fastest_algorithm"),
        F.col("fastest.threads").alias("fastest_threads"),
        F.col("fastest.assembly_ms").alias("fastest_ms"),
        F.col("best_parallel.algorithm").alias("speedup_algorithm"),
        F.col("best_parallel.threads").alias("speedup_threads"),
        F.col("best_parallel.speedup").alias("best_speedup"),
        F.col("lightest.algorithm").alias("memory_algorithm"),
        F.col("lightest.extra_memory_bytes").alias("lowest_memory_bytes"),
    )


def dataset_counts(runs: DataFrame) -> DataFrame:
    """(case_name, kernel, runs, passed): the datasets of a log."""
    return runs.groupBy(*DATASET).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "PASS").alias("passed"))


def thread_series(runs: DataFrame, metric: str = "assembly_ms") -> DataFrame:
    """(case_name, kernel, algorithm, threads, value), one curve after the other."""
    ordered = runs.orderBy(*DATASET, "algorithm", "threads", "ordinal")
    return ordered.select(*DATASET, "algorithm", "threads", F.col(metric).alias("value"))


def stage_label(stage: Column) -> Column:
    """The display label of a stage column name."""
    labels = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, stage), stage)


def stage_breakdown(runs: DataFrame) -> DataFrame:
    """Stacked stage times of the best rows: (..., stage_no, stage, height, bottom).

    A stage that is zero for every algorithm of a dataset is left out.
    """
    best = best_per_algorithm(runs)
    stages = F.array(
        *[
            F.struct(F.lit(n).alias("stage_no"), F.lit(name).alias("stage"), F.col(name).alias("height"))
            for n, name in enumerate(STAGES)
        ]
    )
    long = best.select(*DATASET, "algorithm", F.inline(stages))
    peak = F.max(F.abs("height")).over(Window.partitionBy(*DATASET, "stage_no"))
    kept = long.withColumn("peak", peak).filter(F.col("peak") > ZERO_STAGE).drop("peak")
    below = Window.partitionBy(*DATASET, "algorithm").orderBy("stage_no").rowsBetween(Window.unboundedPreceding, -1)
    return kept.withColumn("bottom", F.coalesce(F.sum("height").over(below), F.lit(0.0)))


def extra_memory_table(runs: DataFrame) -> DataFrame:
    """(case_name, kernel, algorithm, threads, extra_memory_gib) of the best rows."""
    return best_per_algorithm(runs).select(
        *DATASET, "algorithm", "threads", bytes_to_gib(F.col("extra_memory_bytes")).alias("extra_memory_gib")
    )


def best_table(runs: DataFrame) -> DataFrame:
    """Best rows with preprocess and assembly time, speedup, efficiency in percent, GiB."""
    return best_per_algorithm(runs).select(
        *DATASET,
        "algorithm",
        "threads",
        "preprocess_ms",
        "assembly_ms",
        "speedup",
        (F.col("efficiency") * 100.0).alias("efficiency_pct"),
        bytes_to_gib(F.col("extra_memory_bytes")).alias("extra_memory_gib"),
    )


def thread_matrix(runs: DataFrame, metric: str, threads: list[int] | None = None, log10: bool = False) -> DataFrame:
    """Algorithm x threads matrix of a metric; absent runs are NULL, a repeated one is the last.

    Without ``threads`` the columns are read from the data first.
    """
    value = F.max_by(F.col(metric), F.col("ordinal"))
    if log10:
        value = F.log10(F.greatest(value, F.lit(LOG_FLOOR)))
    grouped = runs.withColumn("t", F.concat(F.lit("t"), F.col("threads"))).groupBy(*DATASET, "algorithm")
    if threads is None:
        threads = sorted(r[0] for r in runs.select("threads").distinct().collect())
    return grouped.pivot("t", [f"t{n}" for n in threads]).agg(value)


def cross_best(runs: DataFrame, label: str, algorithms: list[str] | None = None) -> DataFrame:
    """(label, algorithm, best_speedup) over PASS rows; a missing combination is 0.

    ``algorithms`` defaults to those with a PASS row. They meet each label as one list, so
    neither names nor rows reach the driver.
    """
    passed = pass_runs(runs)
    names = runs.select(F.col(label).alias("label")).distinct()
    if algorithms is None:
        listed = passed.select("algorithm").distinct().groupBy(F.lit(0).alias("_all")).agg(F.collect_set("algorithm").alias("_names"))
        wanted = names.withColumn("_all", F.lit(0)).join(listed, "_all").select("label", F.explode("_names").alias("algorithm"))
    else:
        wanted = names.select("label", F.explode(F.array(*[F.lit(a) for a in algorithms])).alias("algorithm"))
    best = passed.groupBy(F.col(label).alias("label"), "algorithm").agg(F.max("speedup").alias("best_speedup"))
    found = wanted.join(best, ["label", "algorithm"], "left")
    return found.select("label", "algorithm", F.coalesce("best_speedup", F.lit(0.0)).alias("best_speedup"))


def comparison_gate(runs: DataFrame) -> DataFrame:
    """One row: whether there is more than one case, and more than one kernel, to compare."""
    return runs.agg(
        (F.count_distinct("case_name") > 1).alias("compare_cases"), (F.count_distinct("kernel") > 1).alias("compare_kernels")
    )


def run_listing(runs: DataFrame) -> DataFrame:
    """All runs by dataset, algorithm and threads."""
    return runs.orderBy(*DATASET, "algorithm", "threads", "ordinal")


def skipped_listing(runs: DataFrame) -> DataFrame:
    """Runs that did not pass, with their reason or else their diagnostics."""
    reason = F.coalesce(F.nullif("skip_reason", F.lit("")), "diagnostics").alias("reason")
    return runs.filter(F.col("status") != "PASS").select(*DATASET, "algorithm", "threads", "status", reason)


SUMMARY_ORDER = [*DATASET, "part", "algorithm", "threads", "at"]


def summary_lines(runs: DataFrame) -> DataFrame:
    """(case_name, kernel, part, algorithm, threads, at, text): a Markdown summary.

    One line per row; sorted by ``SUMMARY_ORDER`` the rows read as title, highlights,
    table and skipped runs of each dataset.
    """
    blank, zero = F.lit(""), F.lit(0)

    def line(df, part: int, text: Column, algorithm=blank, threads=zero, at=zero) -> DataFrame:
        return df.select(
            *DATASET,
            F.lit(part).alias("part"),
            algorithm.alias("algorithm"),
            threads.alias("threads"),
            at.cast("long").alias("at"),
            text.alias("text"),
        )

    def at_threads(prefix: str, algorithm: str, threads: str, form: str, value: str) -> Column:
        return F.format_string(f"- {prefix}: `%s` @ `%d` threads, `{form}`", algorithm, threads, value)

    counts = dataset_counts(runs)
    none = F.when(F.col("passed") == 0, F.lit("\n\nNo PASS run.")).otherwise(blank)
    title = line(counts, 0, F.concat(F.lit("## "), "case_name", F.lit(" | kernel="), "kernel", none))
    top = highlights(runs)
    memory = F.concat(
        F.lit("- lowest extra memory: `"), "memory_algorithm", F.lit("`, `"), memory_string(F.col("lowest_memory_bytes")), F.lit("`")
    )
    header = F.lit(
        "| algorithm | threads | assembly ms | total ms | speedup | efficiency | extra GiB | rel_l2 | status |\n"
        "| --- | ---: | ---: | ---: | ---: | ---: | ---: | ---: | --- |"
    )
    row = F.format_string(
        "| %s | %d | %.3f | %.3f | %.3f | %.1f%% | %.3f | %.3e | %s |",
        "algorithm",
        "threads",
        "assembly_ms",
        "total_ms",
        "speedup",
        F.col("efficiency") * 100.0,
        bytes_to_gib(F.col("extra_memory_bytes")),
        "rel_l2",
        "status",
    )
    usable = counts.filter("passed > 0")
    shown = runs.join(usable.select(*DATASET), DATASET, "left_semi")
    place = {"algorithm": F.col("algorithm"), "threads": F.col("threads"), "at": F.col("ordinal")}
    reason = F.coalesce(F.nullif("skip_reason", F.lit("")), "diagnostics")
    miss = F.concat(F.lit("- "), "algorithm", F.lit(" @ "), "threads", F.lit(": "), "status", F.lit(", "), reason)
    parts = [
        line(top, 1, at_threads("fastest", "fastest_algorithm", "fastest_threads", "%.3f ms", "fastest_ms")),
        line(top, 2, at_threads("best speedup", "speedup_algorithm", "speedup_threads", "%.3fx", "best_speedup")),
        line(top, 3, memory),
        line(usable, 4, header),
        line(shown, 5, row, **place),
        line(shown.filter(F.col("status") != "PASS"), 6, miss, **place),
    ]
    out = title
    for part in parts:
        out = out.unionByName(part)
    return out
