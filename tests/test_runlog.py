import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from meshloom.functions import names, text
from meshloom.operators import runlog
from meshloom.sinks import writers
from meshloom.sources.grids import cube_hex8, cube_tet4
from meshloom.sources.runlogs import RUN_COLUMNS, csv_records, read_runs_csv, read_runs_json
from meshloom.operators import symbolic
from meshloom.operators.assemble import assemble


def run(algorithm="cpu_atomic", threads=1, mean=1.0, **fields):
    row = {name: "" if kind == "string" else 0 for name, kind in RUN_COLUMNS.items()}
    row |= {"case_name": "cube", "mesh": "cube", "kernel": "simplified", "element_type": "Tet4", "status": "PASS"}
    row |= {"algorithm": algorithm, "threads": threads, "effective_threads": threads, "assembly_mean_ms": mean} | fields
    return row


def write_csv(path, rows, columns=None):
    columns = columns or list(RUN_COLUMNS)
    quote = lambda v: '"' + v.replace('"', '""') + '"' if isinstance(v, str) else str(v)
    path.write_text("\n".join([",".join(columns)] + [",".join(quote(r[c]) for c in columns) for r in rows]) + "\n")
    return str(path)


@pytest.fixture
def runs(spark, tmp_path):
    rows = [
        run("cpu_serial", 1, 8.0, speedup=1.0, extra_memory_bytes=0, preprocess_ms=0.5, assembly_numeric_ms=8.0),
        run("cpu_atomic", 2, 4.0, speedup=2.0, efficiency=1.0, extra_memory_bytes=0, assembly_numeric_ms=4.0),
        run("cpu_atomic", 4, 4.0, speedup=2.0, efficiency=0.5, extra_memory_bytes=0, assembly_numeric_ms=4.0),
        run("cpu_row_owner", 4, 2.0, speedup=4.0, extra_memory_bytes=2**31, prepare_owner_partition_ms=1.5, assembly_numeric_ms=2.0),
        run("cpu_private_csr", 8, 0.0, assembly_ms=1.0, status="SKIP", skip_reason="RESOURCE_LIMIT", diagnostics='said "no"'),
        run("cpu_graph_coloring", 8, 1.0, status="FAIL", diagnostics="Correctness check failed"),
        run("cpu_serial", 1, 3.0, kernel="physics_tet4", speedup=1.0),
        run("cpu_atomic", 1, 0.0, kernel="broken", status="SKIP", skip_reason="EXECUTION_ERROR"),
    ]
    return read_runs_csv(spark, [write_csv(tmp_path / "runs.csv", rows)])


def test_zero_mean_falls_through(runs):
    row = runs.filter("algorithm = 'cpu_private_csr'").first()
    assert (row["assembly_ms"], row["diagnostics"]) == (1.0, 'said "no"')


def test_missing_columns_and_numbers(spark, tmp_path):
    few = ["case_name", "mesh", "kernel", "algorithm", "status", "threads", "nodes", "speedup"]
    rows = [run(threads="4.0", nodes="", speedup="")]
    csv = tmp_path / "few.csv"
    csv.write_text(",".join(few) + "\ncube,cube,simplified,cpu_atomic,PASS,4.7,,\n")
    other = write_csv(tmp_path / "all.csv", [run(nodes=2**53 + 1)])
    got = read_runs_csv(spark, [str(csv), other]).orderBy("ordinal").collect()
    assert (got[0]["threads"], got[0]["nodes"], got[0]["speedup"], got[0]["skip_reason"]) == (4, 0, 0.0, "")
    assert got[1]["nodes"] == 2**53 + 1
    assert len(rows) == 1
    with pytest.raises(ValueError, match="lacks columns"):
        read_runs_csv(spark, [write_csv(tmp_path / "bad.csv", [run()], ["case_name", "mesh"])])
    empty = tmp_path / "empty.csv"
    empty.write_text(",".join(few) + "\n")
    with pytest.raises(ValueError, match="no data"):
        read_runs_csv(spark, [other, str(empty)])


def test_csv_round_trip(spark, runs, tmp_path):
    changed = runs.withColumn("assembly_mean_ms", F.when(F.col("threads") == 2, F.lit(1.23456789012345)).otherwise(F.col("assembly_mean_ms")))
    writers.write_runs_csv(changed, str(tmp_path / "out"))
    again = read_runs_csv(spark, [str(tmp_path / "out")])
    columns = [c for c in RUN_COLUMNS if not c.startswith("assembly_m")]
    assert sorted(map(repr, again.select(*columns).collect())) == sorted(map(repr, runs.select(*columns).collect()))
    assert again.filter("threads = 2").first()["assembly_mean_ms"] == 1.23456789
    assert again.columns[:-1] == list(RUN_COLUMNS)


def test_csv_file_order_and_line_breaks(spark, tmp_path):
    """A small and a large part of one folder keep their order; quoted fields hold line breaks."""
    folder = tmp_path / "parts"
    folder.mkdir()
    write_csv(folder / "part-0.csv", [run(case_name="first", diagnostics='two\nlines, "quoted"')])
    write_csv(folder / "part-1.csv", [run(case_name=f"next {i}") for i in range(40)])
    got = read_runs_csv(spark, [str(folder)]).orderBy("ordinal").collect()
    assert [r["case_name"] for r in got] == ["first", *[f"next {i}" for i in range(40)]]
    assert got[0]["diagnostics"] == 'two\nlines, "quoted"'
    with pytest.raises(Exception, match="not a run-log row"):
        read_runs_csv(spark, [write_csv(tmp_path / "odd.csv", [run(status="line2")])]).collect()


def test_records_over_many_blocks(spark, tmp_path):
    """Blocks of a few bytes: records with line breaks and quotes run over several of them."""
    rng = random.Random(5)
    parts = ["plain", 'q"q', "two\nlines", '\n"\n', "", "a,b", "é\r\nx", "\n\n\n"]
    folder = tmp_path / "logs"
    folder.mkdir()
    want = []
    for at in range(3):
        rows = [run(case_name=f"{at}-{i}", diagnostics="".join(rng.choices(parts, k=rng.randint(0, 6)))) for i in range(60)]
        few = ["diagnostics", "status", "case_name", "mesh", "kernel", "algorithm"]
        write_csv(folder / f"{at}.csv", rows, few[at:] + few[:at])
        want += [(r["case_name"], r["diagnostics"]) for r in rows]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "211b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        records = csv_records(spark, [str(folder)])
        assert records.groupBy("path").agg(F.max("number")).select("max(number)").distinct().collect()[0][0] == 61
        got = read_runs_csv(spark, [str(folder)]).orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r["case_name"], r["diagnostics"]) for r in got] == want


def test_headers_of_odd_files(spark, tmp_path):
    odd = tmp_path / "odd.csv"
    odd.write_text("\ufeffcase_name,mesh,,kernel,algorithm,status,,status\r\nc,m,x,k,a,FAIL,y,PASS\r\n\r\nd,m,,k,a,,,SKIP,z,z\r\n", newline="")
    got = read_runs_csv(spark, [str(odd), write_csv(tmp_path / "b.csv", [run()])]).orderBy("ordinal").collect()
    assert [(r["case_name"], r["status"]) for r in got] == [("c", "PASS"), ("d", "SKIP"), ("cube", "PASS")]
    lines = read_runs_csv(spark, [write_csv(tmp_path / "c.csv", [run(), run(case_name="x")])], multiline=False)
    assert [r["case_name"] for r in lines.orderBy("ordinal").collect()] == ["cube", "x"]


def test_json_round_trip(spark, runs, tmp_path):
    writers.write_runs_json(runs, str(tmp_path / "json"))
    again = read_runs_json(spark, [str(tmp_path / "json")], lines=True)
    keys = ["case_name", "kernel", "algorithm", "threads", "status", "speedup", "diagnostics", "extra_memory_bytes"]
    assert sorted(map(tuple, again.select(*keys).collect())) == sorted(map(tuple, runs.select(*keys).collect()))
    document = json.loads(spark.read.text(str(tmp_path / "json")).filter(F.col("value").contains("cpu_row_owner")).first()[0])
    assert [r["algorithm"] for r in document["records"]][:2] == ["cpu_serial", "cpu_atomic"]
    assert list(document) == ["case_name", "mesh", "records"]
    nested = json.dumps(document, indent=2)
    (tmp_path / "pretty.json").write_text(nested)
    assert read_runs_json(spark, [str(tmp_path / "pretty.json")]).count() == len(document["records"])


def test_repeat_statistics(spark):
    values = {"a": [3.0, 5.0, 10.0], "b": [2.0]}
    rows = [(k, v, v + 1.0, v / 2) for k, vs in values.items() for v in vs]
    samples = spark.createDataFrame(rows, "algorithm string, assembly_ms double, total_ms double, assembly_sort_ms double")
    got = {r["algorithm"]: r for r in runlog.repeat_statistics(samples, ["algorithm"], ["assembly_sort_ms"]).collect()}
    for k, vs in values.items():
        r = got[k]
        assert (r["run_count"], r["assembly_min_ms"], r["total_max_ms"]) == (len(vs), min(vs), max(vs) + 1)
        assert r["assembly_mean_ms"] == pytest.approx(statistics.mean(vs))
        assert r["assembly_std_ms"] == pytest.approx(statistics.pstdev(vs))
        assert r["assembly_sort_ms"] == pytest.approx(statistics.mean(vs) / 2)


def test_derived_metrics(spark):
    schema = "case_name string, kernel string, algorithm string, threads int, effective_threads int, assembly_mean_ms double, total_mean_ms double, preprocess_ms double"
    rows = [
        ("c", "k", "cpu_serial", 1, 1, 8.0, 10.0, 1.0),
        ("c", "k", "cpu_atomic", 4, 4, 2.0, 0.0, 1.0),
        ("c", "k", "cpu_atomic", 8, 0, 0.0, 4.0, 1.0),
        ("d", "k", "cpu_atomic", 8, 8, 2.0, 4.0, 1.0),
    ]
    got = runlog.derived_metrics(spark.createDataFrame(rows, schema)).orderBy("case_name", "threads").collect()
    assert [(r["speedup"], r["efficiency"], r["preprocess_share"]) for r in got] == [
        (1.0, 1.0, 0.1),
        (4.0, 1.0, 0.0),
        (0.0, 0.0, 0.25),
        (0.0, 0.0, 0.25),
    ]


def test_status(spark):
    schema = "id int, same_structure boolean, rel_l2 double, error string, note string"
    rows = [
        (0, True, 1e-8, None, "note"),
        (1, True, 1.1e-8, None, "note"),
        (2, False, float("inf"), None, None),
        (3, None, None, "x requires about 2 GiB transient memory, above limit 1 GiB", None),
        (4, None, None, "the input is a Git LFS pointer", None),
        (5, None, None, "Unknown argument: --x", None),
        (6, None, None, "boom", None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = [tuple(r)[5:] for r in runlog.derive_status(df).orderBy("id").collect()]
    assert [(s, k) for k, s, _ in got] == [
        ("PASS", ""),
        ("FAIL", ""),
        ("FAIL", ""),
        ("SKIP", "RESOURCE_LIMIT"),
        ("FAIL", "INPUT_NOT_READY"),
        ("FAIL", "CLI_ERROR"),
        ("SKIP", "EXECUTION_ERROR"),
    ]
    assert [d for _, _, d in got][:3] == ["note", "Correctness check failed", "Correctness check failed"]
    assert runlog.derive_status(df, check=False).filter("id = 1").first()["status"] == "PASS"


def test_highlights(runs):
    got = {r["kernel"]: r for r in runlog.highlights(runs).collect()}
    assert set(got) == {"simplified", "physics_tet4"}
    top = got["simplified"]
    assert (top["fastest_algorithm"], top["speedup_algorithm"], top["memory_algorithm"]) == ("cpu_row_owner", "cpu_row_owner", "cpu_serial")
    only_serial = got["physics_tet4"]
    assert (only_serial["fastest_algorithm"], only_serial["speedup_algorithm"]) == ("cpu_serial", "cpu_serial")


def test_best_rows_and_pivots(runs):
    best = runlog.best_per_algorithm(runlog.pass_runs(runs)).filter("kernel = 'simplified'")
    assert {(r["algorithm"], r["threads"]) for r in best.collect()} == {("cpu_serial", 1), ("cpu_atomic", 2), ("cpu_row_owner", 4)}
    wide = {r["algorithm"]: r for r in runlog.thread_matrix(runs.filter("kernel = 'simplified'"), "speedup").collect()}
    assert (wide["cpu_atomic"]["t2"], wide["cpu_atomic"]["t1"]) == (2.0, None)
    logs = runlog.thread_matrix(runs.filter("algorithm = 'cpu_serial'"), "total_ms", [1], log10=True)
    assert {r["t1"] for r in logs.collect()} == {-9.0}
    memory = {r["algorithm"]: r["extra_memory_gib"] for r in runlog.extra_memory_table(runlog.pass_runs(runs)).filter("kernel = 'simplified'").collect()}
    assert memory["cpu_row_owner"] == 2.0
    table = {r["algorithm"]: r for r in runlog.best_table(runlog.pass_runs(runs)).filter("kernel = 'simplified'").collect()}
    assert table["cpu_atomic"]["efficiency_pct"] == 100.0


def test_stage_breakdown_drops_empty_stages(runs):
    rows = runlog.stage_breakdown(runlog.pass_runs(runs)).filter("kernel = 'simplified'").collect()
    assert {r["stage"] for r in rows} == {"prepare_owner_partition_ms", "assembly_numeric_ms"}
    owner = {r["stage"]: (r["bottom"], r["height"]) for r in rows if r["algorithm"] == "cpu_row_owner"}
    assert owner == {"prepare_owner_partition_ms": (0.0, 1.5), "assembly_numeric_ms": (1.5, 2.0)}


def test_cross_best_and_gate(runs):
    got = {(r["label"], r["algorithm"]): r["best_speedup"] for r in runlog.cross_best(runs, "kernel").collect()}
    assert got[("simplified", "cpu_row_owner")] == 4.0
    assert got[("broken", "cpu_serial")] == got[("physics_tet4", "cpu_atomic")] == 0.0
    assert {a for _, a in got} == {"cpu_serial", "cpu_atomic", "cpu_row_owner"}
    assert tuple(runlog.comparison_gate(runs).first()) == (False, True)


def test_listings_and_summary(spark, runs, tmp_path):
    skipped = {r["algorithm"]: r["reason"] for r in runlog.skipped_listing(runs).collect()}
    assert skipped["cpu_private_csr"] == "RESOURCE_LIMIT"
    assert skipped["cpu_graph_coloring"] == "Correctness check failed"
    series = runlog.thread_series(runs.filter("algorithm = 'cpu_atomic' AND kernel = 'simplified'")).collect()
    assert [r["threads"] for r in series] == [2, 4]
    writers.write_summary(runs, str(tmp_path / "summary"))
    lines = "\n".join(open(p).read() for p in sorted((tmp_path / "summary").glob("part-*")))
    assert lines.index("## cube | kernel=broken") < lines.index("No PASS run") < lines.index("## cube | kernel=physics_tet4")
    assert "- fastest: `cpu_row_owner` @ `4` threads, `2.000 ms`" in lines
    assert "| cpu_row_owner | 4 | 2.000 | 0.000 | 4.000 | 0.0% | 2.000 | 0.000e+00 | PASS |" in lines
    assert "- lowest extra memory: `cpu_serial`, `0 B`" in lines


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_scalars(spark):
    sizes = [0, 1023, 1024, 1152, 1536, 1048575, 7077888, 5 * 2**30, 2**40 + 2**39, 2**50]
    want = ["0 B", "1023 B", "1.00 KiB", "1.12 KiB", "1.50 KiB", "1024.00 KiB", "6.75 MiB", "5.00 GiB", "1.50 TiB", "1024.00 TiB"]
    assert values(spark, [(s,) for s in sizes], "b long", text.memory_string(F.col("b"))) == want
    paths = [("a/b/mesh.v2.inp",), ("mesh",), ("dir/.hidden",), ("dir/..",), ("x.inp",)]
    assert values(spark, paths, "p string", names.file_stem(F.col("p"))) == ["mesh.v2", "mesh", ".hidden", "..", "x"]
    assert values(spark, [("COO",), ("Owner",)], "a string", names.canonical_algorithm(F.col("a"))) == ["cpu_coo_sort_reduce", "cpu_row_owner"]
    assert values(spark, [("C3D8",)], "a string", names.canonical_element(F.col("a"))) == ["hex8"]
    with pytest.raises(Exception, match="unsupported kernel type: none"):
        values(spark, [("none",)], "a string", names.canonical_kernel(F.col("a")))
    with pytest.raises(ValueError, match="unsupported algorithm"):
        names.canonical_method("none")
    stages = [("assembly_sort_ms",), ("other",)]
    assert values(spark, stages, "s string", runlog.stage_label(F.col("s"))) == ["排序", "other"]
    slug = names.dataset_slug(F.col("a"), F.col("b"))
    assert values(spark, [("x/y z", "k")], "a string, b string", slug) == ["x_y_z_k"]


def test_mesh_and_matrix_files(spark, tmp_path):
    mesh = cube_tet4(spark, 2, 1, 1)
    writers.write_mesh(mesh, str(tmp_path / "mesh"))
    assert spark.read.parquet(str(tmp_path / "mesh/nodes")).count() == 12
    assert spark.read.parquet(str(tmp_path / "mesh/elements")).count() == 12
    writers.write_mesh_text(cube_hex8(spark, 2, 1, 1, 1 / 2**16, 1.0, 1.0), str(tmp_path / "text"))
    lines = "".join(open(p).read() for p in sorted((tmp_path / "text").glob("part-*"))).splitlines()
    assert lines[0] == "Hex8 12 2" and len(lines) == 15
    assert lines[2] == f"{1 / 2**17:.10e} {0:.10e} {0:.10e}"
    assert lines[13] == "0 1 4 3 6 7 10 9"
    matrix = assemble(mesh)
    writers.write_matrix(matrix, str(tmp_path / "matrix"), partitions=3)
    back = spark.read.parquet(str(tmp_path / "matrix"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, matrix.collect()))
    csr = symbolic.pack_csr(matrix, spark.range(36).withColumnRenamed("id", "row"))
    writers.write_csr(csr, str(tmp_path / "csr"))
    assert spark.read.parquet(str(tmp_path / "csr")).count() == 36
