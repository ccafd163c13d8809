import pytest

from meshloom.functions.kernels import physics_tet4
from meshloom.operators import compare
from meshloom.operators.assemble import METHODS, assemble
from meshloom.sources.decks import deck_lines, parse_deck, pointer_check, read_deck, resolve_labels

# A pyramid over a skewed base, split into three tets; labels fall and have gaps.
GAP_LABELS = """*Preprint, echo=NO
** labels out of order
*Node
907, 2.5, -1.0, 0.25
61, 0.5, 3.0, 0.0

333, -2.0, 0.75, 1.5
** blank line above, comment here
12, 0.0, -0.5, 4.0
450, 3.0, 2.0, 2.0
88, -1.0, -3.0, 0.5
*Nset, nset=TIP
12,
*Element, type=C3D4, elset=LEFT
77, 907, 61, 333, 12
5, 61, 450, 907, 12
6001, 333, 88, 907, 12
*Density
7.8e-9
*Boundary
61, 1, 3
"""
# Sections whose keywords merely begin like node and element sections.
OUTPUT_SECTIONS = """*ELEMENT OUTPUT, elset=LEFT
E, PEEQ
*NODE
20, 0.0, 0.0, 1.0
21, 4.0, 0.0, 1.0
22, 0.0, 5.0, 1.0
23, 1.0, 1.0, 6.0
24, 2.0, 2.0, 9.0
*NODE PRINT
RF,
*ELEMENT, TYPE=C3D4
9, 23, 20, 21, 22
3, 24, 21, 20, 22
*NODE OUTPUT
UR, RF
"""
CUBE_NODES = "*Node\n" + "".join(f"{n + 1}, {n % 2}, {n // 2 % 2}, {n // 4}\n" for n in range(8))


def deck(tmp_path, text, name="deck.inp"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def elements_of(mesh):
    return [(r["elem_id"], r["type"], list(r["nodes"])) for r in mesh.elements.orderBy("elem_id").collect()]


def test_gap_labels(spark, tmp_path):
    mesh = read_deck(spark, deck(tmp_path, GAP_LABELS))
    assert elements_of(mesh) == [(0, "tet4", [0, 1, 2, 3]), (1, "tet4", [1, 4, 0, 3]), (2, "tet4", [2, 5, 0, 3])]
    nodes = [tuple(r) for r in mesh.nodes.orderBy("node_id").collect()]
    assert nodes == [
        (0, 2.5, -1.0, 0.25),
        (1, 0.5, 3.0, 0.0),
        (2, -2.0, 0.75, 1.5),
        (3, 0.0, -0.5, 4.0),
        (4, 3.0, 2.0, 2.0),
        (5, -1.0, -3.0, 0.5),
    ]


def test_methods_agree_on_a_deck(spark, tmp_path):
    mesh = read_deck(spark, deck(tmp_path, GAP_LABELS))
    reference = assemble(mesh, physics_tet4(), "serial").cache()
    for method in METHODS:
        report = compare.passes(compare.compare(reference, assemble(mesh, physics_tet4(), method))).first()
        assert report["passed"], method
    reference.unpersist()


def test_output_sections_are_not_nodes(spark, tmp_path):
    mesh = read_deck(spark, deck(tmp_path, OUTPUT_SECTIONS))
    assert mesh.nodes.count() == 5
    assert elements_of(mesh) == [(0, "tet4", [3, 0, 1, 2]), (1, "tet4", [4, 1, 0, 2])]


def test_mixed_types_and_header_spellings(spark, tmp_path):
    text = CUBE_NODES + (
        "*Element, type=c3d8r\n7, 1, 2, 4, 3, 5, 6, 8, 7\n"
        "*Element, type=C3D10\n1, 1, 2, 3, 4\n"
        "*Element, TYPE = C3D4\n1, 1, 2, 3, 4\n"
        "*element, elset=A, type=C3D4, x\n9, 5, 6, 7, 8, 99\n"
    )
    assert elements_of(read_deck(spark, deck(tmp_path, text))) == [
        (0, "hex8", [0, 1, 3, 2, 4, 5, 7, 6]),
        (1, "tet4", [4, 5, 6, 7]),
    ]


def test_line_numbers_across_splits(spark, tmp_path):
    text = "".join(f"line {n}\n" for n in range(1, 3001))
    path = deck(tmp_path, text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = deck_lines(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 3
        assert all(r["line"] == f"line {r['line_no']}" for r in lines.collect())
        assert lines.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def lines_frame(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"), start=1)), "line_no long, line string")


def test_rejects(spark):
    text = "*Node\n1, 0, 0\n2, 1.0D0, 0, 0\n3, 0, 0, 0, extra\n4, 1, 2, 3,\n*Element, type=C3D4\n1, 3, 4, 3\n1, 3, 4, x, 4"
    strict = parse_deck(lines_frame(spark, text))
    assert {r["line_no"]: r["reason"] for r in strict.rejects.collect()} == {
        2: "too few node fields",
        3: "not a number in node line",
        7: "too few element fields",
        8: "not a number in element line",
    }
    lenient = parse_deck(lines_frame(spark, text), numbers="prefix")
    assert {r["label"]: r["x"] for r in lenient.nodes.collect()} == {2: 1.0, 3: 0.0, 4: 1.0}


def test_split_hex_row_is_an_error(spark, tmp_path):
    text = CUBE_NODES + "*Element, type=C3D8\n1, 1, 2, 4, 3,\n5, 6, 8, 7\n"
    with pytest.raises(ValueError, match="too few element fields at line 11"):
        read_deck(spark, deck(tmp_path, text))


def test_unknown_and_early_references(spark, tmp_path):
    unknown = "*Node\n1,0,0,0\n2,1,0,0\n3,0,1,0\n*Element, type=C3D4\n1, 1, 2, 3, 77\n"
    with pytest.raises(ValueError, match="unknown node 77 at line 6"):
        read_deck(spark, deck(tmp_path, unknown))
    early = "*Element, type=C3D4\n1, 1, 2, 3, 4\n" + CUBE_NODES
    with pytest.raises(ValueError, match="unknown node . at line 2"):
        read_deck(spark, deck(tmp_path, early, "early.inp"))


def test_latest_definition_above_the_element_counts(spark):
    text = (
        "*Node\n1,0,0,0\n2,1,0,0\n3,0,1,0\n4,0,0,1\n*Element, type=C3D4\n1,1,2,3,4\n"
        "*Node\n4,9,9,9\n*Element, type=C3D4\n2,1,2,3,4\n3,1,2,3,5"
    )
    mesh, unknown = resolve_labels(parse_deck(lines_frame(spark, text)))
    assert elements_of(mesh) == [(0, "tet4", [0, 1, 2, 3]), (1, "tet4", [0, 1, 2, 4])]
    assert [tuple(r) for r in unknown.collect()] == [(12, 5)]


def test_pointer_and_empty_input(spark, tmp_path):
    pointer = "version https://git-lfs.github.com/spec/v1\noid sha256:0123\nsize 7\n"
    with pytest.raises(ValueError, match="Git LFS pointer"):
        read_deck(spark, deck(tmp_path, pointer))
    assert not pointer_check(lines_frame(spark, GAP_LABELS)).first()[0]
    with pytest.raises(ValueError, match="no supported nodes or elements"):
        read_deck(spark, deck(tmp_path, "*Node\n1,0,0,0\n", "nodes_only.inp"))


def test_dropped_lines_are_returned(spark, tmp_path):
    text = CUBE_NODES + "9, 1, oops, 0\n*Element, type=C3D4\n1, 1, 2, 3, 5\n2, 1, 2, 3, 99\n"
    mesh, lost = read_deck(spark, deck(tmp_path, text), on_error="list")
    assert mesh.nodes.count() == 8 and mesh.elements.count() == 1
    assert sorted(r["line_no"] for r in lost.collect()) == [10, 13]
