"""Benchmark run logs from CSV or JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshloom.session import cut_lineage

# The run-log columns in file order with their types.
RUN_COLUMNS = {
    "case_name": "string",
    "mesh": "string",
    "element_type": "string",
    "kernel": "string",
    "nodes": "bigint",
    "elements": "bigint",
    "dofs": "bigint",
    "nnz": "bigint",
    "algorithm": "string",
    "threads": "int",
    "effective_threads": "int",
    "run_count": "int",
    "preprocess_ms": "double",
    "assembly_ms": "double",
    "total_ms": "double",
    "assembly_mean_ms": "double",
    "assembly_min_ms": "double",
    "assembly_max_ms": "double",
    "assembly_std_ms": "double",
    "total_mean_ms": "double",
    "total_min_ms": "double",
    "total_max_ms": "double",
    "total_std_ms": "double",
    "speedup": "double",
    "efficiency": "double",
    "preprocess_share": "double",
    "rel_l2": "double",
    "max_abs": "double",
    "extra_memory_bytes": "bigint",
    "peak_rss_mb": "double",
    "colors": "int",
    "prepare_allocate_ms": "double",
    "prepare_coloring_ms": "double",
    "prepare_owner_partition_ms": "double",
    "assembly_zero_ms": "double",
    "assembly_generate_ms": "double",
    "assembly_numeric_ms": "double",
    "assembly_merge_ms": "double",
    "assembly_sort_ms": "double",
    "assembly_reduce_ms": "double",
    "status": "string",
    "skip_reason": "string",
    "diagnostics": "string",
    "platform": "string",
    "omp_proc_bind": "string",
    "omp_places": "string",
    "omp_dynamic": "string",
}
REQUIRED = ["case_name", "mesh", "kernel", "algorithm", "status"]
JSON_SCHEMA = """
    case_name string,
    mesh struct<name: string, element_type: string, kernel: string,
                nodes: bigint, elements: bigint, dofs: bigint, nnz: bigint>,
    records array<struct<algorithm: string, threads: int, effective_threads: int, run_count: int,
                         status: string, skip_reason: string, speedup: double, efficiency: double,
                         preprocess_share: double, assembly_mean_ms: double, assembly_min_ms: double,
                         assembly_max_ms: double, assembly_std_ms: double, total_mean_ms: double,
                         peak_rss_mb: double, extra_memory_bytes: bigint, rel_l2: double,
                         max_abs: double, diagnostics: string>>
"""


def _typed(name: str, kind: str, present: list[str]) -> Column:
    """One run-log column from its text; missing or empty numbers are zero."""
    if name not in present:
        return F.lit("" if kind == "string" else 0).cast(kind).alias(name)
    if kind == "string":
        return F.coalesce(name, F.lit("")).alias(name)
    # Whole numbers may be written with a decimal point; they are cut, not rounded. The
    # plain path keeps longs that a double could not hold.
    text = F.nullif(F.col(name), F.lit(""))
    value = text.cast("double") if kind == "double" else F.coalesce(text.try_cast(kind), text.cast("double").cast(kind))
    return F.coalesce(value, F.lit(0).cast(kind)).alias(name)


def normalize_runs(raw: DataFrame, *keep: str) -> DataFrame:
    """Text columns, found by name, as the typed run log plus ``ordinal`` (row order) and the columns ``keep``.

    A zero mean falls through to the single-run time of the same row.
    """
    absent = [c for c in REQUIRED if c not in raw.columns]
    if absent:
        raise ValueError(f"run log lacks columns: {', '.join(absent)}")
    typed = raw.select(*[_typed(n, k, raw.columns) for n, k in RUN_COLUMNS.items()], "ordinal", *keep)
    return typed.withColumns(
        {
            f"{part}_ms": F.when(F.col(f"{part}_mean_ms") != 0, F.col(f"{part}_mean_ms")).otherwise(F.col(f"{part}_ms"))
            for part in ("assembly", "total")
        }
    )


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and rank of every file: in the order of ``paths``, inside a folder by name."""
    listed = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"))
    context = spark.sparkContext
    named = [(at, context._jvm.org.apache.hadoop.fs.Path(p)) for at, p in enumerate(paths)]
    conf = context._jsc.hadoopConfiguration()
    given = [(at, p.getFileSystem(conf).makeQualified(p).toUri().toString()) for at, p in named]
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    keyed = listed.select("path", F.explode(F.array(plain, F.regexp_replace(plain, "/[^/]*$", ""))).alias("key"))
    given = spark.createDataFrame(given, "at long, key string").withColumn("key", F.regexp_replace("key", "^file:/+", "file:/"))
    placed = keyed.join(given, "key").groupBy("path").agg(F.min("at").alias("at"))
    # One row per file.
    return placed.select("path", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at", "path")).cast("long").alias("rank"))


def csv_records(spark: SparkSession, paths: list[str], multiline: bool = True) -> DataFrame:
    """path, number (from 1 in every file) and text of the CSV records of all files.

    Files are split into blocks as any text is. A line begins a record if the quotes before it
    in its file are even in number. Each block counts its quotes, and its beginnings for
    either case, so exclusive sums over a file's blocks tell which case holds and the number
    of its first record. Only lines of records with line breaks are brought together. Quotes
    must be doubled inside quoted fields and appear in no others.
    """
    at = F.monotonically_increasing_id().alias("at")
    where = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.option("lineSep", "\n").text(paths).select(*where, at, "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'))) if multiline else F.lit(0)
    lines = lines.withColumn("quotes", quotes)
    # A block's lines follow each other in one task, whose running number orders them.
    block = Window.partitionBy("path", "block").orderBy("at")
    before = F.coalesce(F.sum("quotes").over(block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("odd", before % 2)
    running = {f"begun{case}": F.count_if(F.col("odd") == case).over(block) for case in (0, 1)}
    lines = lines.withColumns(running)
    totals = lines.groupBy("path", "block").agg(
        F.sum("quotes").alias("quotes"), F.count_if(F.col("odd") == 0).alias("all0"), F.count_if(F.col("odd") == 1).alias("all1")
    )
    # One row per block.
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carried = totals.withColumn("carry", F.coalesce(F.sum("quotes").over(earlier), zero) % 2)
    begun = F.when(F.col("carry") == 0, F.col("all0")).otherwise(F.col("all1"))
    carried = carried.withColumn("base", F.coalesce(F.sum(begun).over(earlier), zero)).select("path", "block", "carry", "base")
    own = F.when(F.col("carry") == 0, F.col("begun0")).otherwise(F.col("begun1"))
    lines = lines.join(carried, ["path", "block"]).withColumns({"number": F.col("base") + own, "inside": F.col("odd") != F.col("carry")})
    alone = ~F.col("inside") & (F.col("quotes") % 2 == 0)
    lines = lines.select("path", "number", "block", "at", "value", alone.alias("alone"))
    whole = lines.filter("alone").select("path", "number", F.col("value").alias("text"))
    parts = F.sort_array(F.collect_list(F.struct("block", "at", "value")))
    joined = lines.filter("not alone").groupBy("path", "number").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("text"))
    return whole.unionByName(joined).withColumn("text", F.regexp_replace("text", "\r$", ""))


def read_runs_csv(spark: SparkSession, paths: list[str], multiline: bool = True) -> DataFrame:
    """Run logs of all ``paths`` (files or folders) in file and row order. A file without rows is an error.

    Columns are found by each file's own header; of columns with the same name the last counts,
    columns without a name are not read. Quoted fields may hold line breaks, also in files
    that are split (see `csv_records`); with ``multiline=False`` a line is a record. Blank
    records are skipped. The typed rows are written once, and a row whose status is not PASS,
    SKIP or FAIL is an error: it is no row of a run log.
    """
    if not paths:
        raise ValueError("no run logs given")
    files = cut_lineage(_files(spark, paths))
    records = cut_lineage(csv_records(spark, paths, multiline).filter("text <> ''"))
    heads = records.join(records.groupBy("path").agg(F.min("number").alias("number")), ["path", "number"])
    heads = heads.withColumn("text", F.ltrim(F.col("text"), F.lit("\ufeff")))
    # Every comma of a header ends one name at most.
    width = heads.agg(F.max(F.length("text") - F.length(F.replace("text", F.lit(","))) + 1)).first()[0] or 1
    schema = ", ".join(f"c{i} string" for i in range(width))

    parsed = F.from_csv("text", schema, {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"})
    values = F.array(*[F.col(f"fields.c{i}") for i in range(width)])
    heads = cut_lineage(heads.withColumn("fields", parsed).select("path", F.col("number").alias("head"), values.alias("header")))
    present = {r[0] for r in heads.select(F.explode("header").alias("name")).distinct().filter("name is not null").collect()}
    absent = [c for c in REQUIRED if c not in present]
    if absent:
        raise ValueError(f"run log lacks columns: {', '.join(absent)}")
    names = [n for n in RUN_COLUMNS if n in present]
    # Place of each column in its file, from 0; an absent one is past the end.
    places = [(F.lit(width) - F.array_position(F.reverse("header"), n)).cast("int") for n in names]
    heads = heads.select("path", "head", F.array(*places).alias("places")).join(files, "path")
    body = records.join(heads, "path").filter("number > head").withColumn("fields", parsed)
    body = body.select("path", (F.col("rank") * (1 << 33) + F.col("number")).alias("ordinal"), "places", values.alias("v"))
    body = body.select("path", "ordinal", *[F.get("v", F.col("places")[i]).alias(n) for i, n in enumerate(names)])
    typed = cut_lineage(normalize_runs(body, "path"), frees=[records])
    found = typed.groupBy("path").agg(F.min(F.when(~F.col("status").isin("PASS", "SKIP", "FAIL"), F.col("status"))).alias("wrong"))
    checked = files.join(found.withColumn("rows", F.lit(True)), "path", "left")
    problem = checked.filter("rows is null or wrong is not null").orderBy("rank").first()
    if problem is not None and problem["rows"] is None:
        raise ValueError(f"CSV contains no data: {problem['path']}")
    if problem is not None:
        raise ValueError(f"not a run-log row, status: {problem['wrong']} in {problem['path']}")
    return typed.drop("path")


def read_runs_json(spark: SparkSession, paths: list[str], lines: bool = False) -> DataFrame:
    """One row per record of the nested run-log documents, with the mesh fields beside it.

    A file is one document by default, or one document per line with ``lines``, the form
    ``write_runs_json`` produces and the only one that a large file can be split in.
    """
    docs = spark.read.schema(JSON_SCHEMA).json(paths, multiLine=not lines)
    mesh = ["element_type", "kernel", "nodes", "elements", "dofs", "nnz"]
    rows = docs.select(
        "case_name",
        F.col("mesh.name").alias("mesh"),
        *[F.col(f"mesh.{m}").alias(m) for m in mesh],
        F.explode("records").alias("r"),
    )
    assembly_ms = F.col("r.assembly_mean_ms").alias("assembly_ms")
    total_ms = F.col("r.total_mean_ms").alias("total_ms")
    ordinal = F.monotonically_increasing_id().alias("ordinal")
    return rows.select("case_name", "mesh", *mesh, "r.*", assembly_ms, total_ms, ordinal)
