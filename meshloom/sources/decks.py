"""Text input decks: sections of node and element lines, ingested as Spark jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshloom.functions.text import ascii_upper
from meshloom.model import MeshFrames
from meshloom.operators.corners import BROADCAST_NODES
from meshloom.operators.prefix import carry_forward, exclusive_prefix
from meshloom.session import cut_lineage

# Header keywords, accepted element types, and the first two lines of a
# large-file pointer.
NODE_KEYWORD = "*NODE"
ELEMENT_KEYWORD = "*ELEMENT"
ELEMENT_TYPES = [("TYPE=C3D4", "tet4", 4), ("TYPE=C3D8", "hex8", 8)]
POINTER_LINES = ["version https://git-lfs.github.com/spec/v1", "oid sha256:"]
# Decks of up to this many headers are placed by broadcasting them.
BROADCAST_HEADERS = 256
# Characters trimmed from lines and fields, and the numeric prefixes that
# the lenient mode reads.
WHITESPACE = " \t\n\x0b\f\r"
INTEGER_PREFIX = r"^[+-]?\d+"
DOUBLE_PREFIX = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


@dataclass(frozen=True)
class DeckFrames:
    """Parsed deck lines before labels are resolved.

    nodes     line_no, label, x, y, z
    elements  line_no, type, labels
    rejects   line_no, line, reason
    """

    nodes: DataFrame
    elements: DataFrame
    rejects: DataFrame


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def deck_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of one text file, numbered from 1.

    The file is read in parallel splits. A line's number is its index in the split plus
    the lines of the splits before it, which needs one small aggregate per split and no
    single-task pass over the file.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    blocks = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("lines"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("start"))
    return raw.join(starts, ["file", "block"]).select(
        (F.col("start") + F.col("at") - F.col("first") + 1).alias("line_no"), "line"
    )


def pointer_check(lines: DataFrame) -> DataFrame:
    """One row: is the text only a large-file pointer instead of the input itself."""
    wanted = F.when(F.col("line_no") == 1, F.col("line").startswith(POINTER_LINES[0])).when(
        F.col("line_no") == 2, F.col("line").startswith(POINTER_LINES[1])
    )
    return lines.filter("line_no <= 2").agg((F.count_if(wanted) == 2).alias("is_pointer"))


def _section() -> Column:
    """The section a header line opens: NODE, tet4, hex8 or NONE."""
    upper = ascii_upper(F.col("text"))
    keyword = _trim(F.substring_index(upper, ",", 1))
    section = F.when(keyword == NODE_KEYWORD, F.lit("NODE"))
    for fragment, kind, _ in ELEMENT_TYPES:
        section = section.when((keyword == ELEMENT_KEYWORD) & upper.contains(fragment), F.lit(kind))
    return section.otherwise(F.lit("NONE"))


def _number(text: Column, kind: str, numbers: str) -> Column:
    if numbers == "prefix":
        text = F.regexp_extract(text, INTEGER_PREFIX if kind == "bigint" else DOUBLE_PREFIX, 0)
    return text.try_cast(kind)


def _between_headers(data: DataFrame, headers: DataFrame) -> DataFrame:
    """``data`` with its open section, found among few broadcast headers: the lines do not move."""
    following = F.lead("line_no").over(Window.partitionBy(F.lit(0)).orderBy("line_no"))
    opened = headers.select(F.col("line_no").alias("_from"), following.alias("_to"), F.col("opens").alias("section"))
    inside = (F.col("line_no") > F.col("_from")) & (F.col("_to").isNull() | (F.col("line_no") < F.col("_to")))
    return data.join(F.broadcast(opened.filter("section <> 'NONE'")), inside).drop("_from", "_to")


def parse_deck(lines: DataFrame, numbers: str = "strict") -> DeckFrames:
    """Split (line_no, line) into node rows, element rows and rejected rows.

    Blank lines and ``**`` comments do not end a section; every other ``*`` line starts
    one. The open section is carried forward by line number. ``numbers`` is ``strict``
    (a field must be a number) or ``prefix`` (leading digits count, as in ``1.0D0``).
    """
    text = lines.select("line_no", "line", _trim(F.col("line")).alias("text"))
    text = text.filter((F.col("text") != "") & ~F.col("text").startswith("**"))
    header = F.col("text").startswith("*")
    headers = text.filter(header).select("line_no", _section().alias("opens"))
    if headers.limit(BROADCAST_HEADERS + 1).count() <= BROADCAST_HEADERS:
        placed = _between_headers(text.filter(~header), headers)
    else:
        marked = text.withColumn("opens", F.when(header, _section()))
        placed = carry_forward(marked, "line_no", "opens", "section").filter(F.col("opens").isNull())
    data = placed.filter(F.col("section").isNotNull() & (F.col("section") != "NONE"))
    # Everything below reads the lines several times; they are placed and written once, and split when read.
    data = cut_lineage(data.select("line_no", "line", "section"))
    # One trailing comma does not start another field.
    fields = F.transform(F.split(F.regexp_replace(_trim(F.col("line")), ",$", ""), ","), _trim)
    data = data.withColumn("f", fields)

    field = lambda i: F.get("f", F.lit(i))
    node = data.filter(F.col("section") == "NODE").select(
        "line_no",
        "line",
        (F.size("f") < 4).alias("short"),
        _number(field(0), "bigint", numbers).alias("label"),
        *[_number(field(i), "double", numbers).alias(c) for i, c in enumerate("xyz", start=1)],
    )
    bad_node = F.when(F.col("short"), F.lit("too few node fields")).when(
        F.greatest(*[F.col(c).isNull() for c in ("label", "x", "y", "z")]), F.lit("not a number in node line")
    )
    node = node.withColumn("reason", bad_node)

    width = F.when(F.col("section") == "tet4", F.lit(4)).otherwise(F.lit(8))
    element = data.filter(F.col("section") != "NODE").select(
        "line_no",
        "line",
        F.col("section").alias("type"),
        (F.size("f") < width + 1).alias("short"),
        F.transform(F.slice("f", F.lit(2), width), lambda t: _number(t, "bigint", numbers)).alias("labels"),
    )
    bad_element = F.when(F.col("short"), F.lit("too few element fields")).when(
        F.exists("labels", lambda v: v.isNull()), F.lit("not a number in element line")
    )
    element = element.withColumn("reason", bad_element)

    rejects = node.select("line_no", "line", "reason").unionByName(element.select("line_no", "line", "reason"))
    return DeckFrames(
        node.filter(F.col("reason").isNull()).select("line_no", "label", "x", "y", "z"),
        element.filter(F.col("reason").isNull()).select("line_no", "type", "labels"),
        rejects.filter(F.col("reason").isNotNull()),
    )


def _numbered(df: DataFrame, out: str) -> DataFrame:
    """Dense 0-based ids in line order."""
    return exclusive_prefix(df.withColumn("_one", F.lit(1).cast("long")), "line_no", "_one", out).drop("_one")


def _ranged_numbers(df: DataFrame, out: str) -> DataFrame:
    """``_numbered`` for many rows under line numbers with gaps: ranges of lines are sorted and their sizes added up."""
    ranged = df.repartitionByRange("line_no").sortWithinPartitions("line_no").withColumn("_at", F.monotonically_increasing_id())
    ranged = cut_lineage(ranged)
    part = F.shiftrightunsigned("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_start"))
    placed = ranged.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn(out, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_start", "_at")


def resolve_labels(deck: DeckFrames) -> tuple[MeshFrames, DataFrame]:
    """Replace node labels by dense indices; returns the mesh and the unresolved references.

    An element sees the node lines above it; of repeated labels the latest counts. Unique
    labels, the normal case, resolve by one equi-join. Only when a label repeats is the
    position-aware lookup used, which carries definitions forward per label.
    """
    nodes = _numbered(deck.nodes, "node_id")
    elements = deck.elements
    references = elements.select("line_no", "type", F.posexplode("labels").alias("slot", "label"))
    repeated = not nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    if repeated:
        events = nodes.select("label", "line_no", F.lit(None).cast("string").alias("type"), F.lit(-1).alias("slot"), "node_id")
        asks = references.select("label", "line_no", "type", "slot", F.lit(None).cast("long").alias("node_id"))
        found = carry_forward(events.unionByName(asks), "line_no", "node_id", "index", by=["label"]).filter("slot >= 0")
    elif nodes.count() <= BROADCAST_NODES:
        return _resolve_in_place(nodes, elements)
    else:
        defined = nodes.select("label", "node_id", F.col("line_no").alias("defined_at"))
        known = F.when(F.col("defined_at") < F.col("line_no"), F.col("node_id"))
        found = references.join(defined, "label", "left").withColumn("index", known)

    unknown = found.filter(F.col("index").isNull()).select("line_no", "label").distinct()
    by_slot = [F.max(F.when(F.col("slot") == s, F.col("index"))).alias(f"n{s}") for s in range(8)]
    wide = found.groupBy("line_no", "type").agg(*by_slot, F.count_if(F.col("index").isNull()).alias("misses"))
    complete = wide.filter("misses = 0").select(
        "line_no", "type", F.array_compact(F.array(*[F.col(f"n{s}") for s in range(8)])).alias("nodes")
    )
    return _deck_mesh(nodes, complete), unknown


def _deck_mesh(nodes: DataFrame, complete: DataFrame) -> MeshFrames:
    return MeshFrames(nodes.select("node_id", "x", "y", "z"), _ranged_numbers(complete, "elem_id").select("elem_id", "type", "nodes"), "deck")


def _resolve_in_place(nodes: DataFrame, elements: DataFrame) -> tuple[MeshFrames, DataFrame]:
    """``resolve_labels`` for unique labels of nodes that can be broadcast: one probe per corner, elements do not move."""
    out = elements
    for s in range(8):
        side = nodes.select(F.col("label").alias("_label"), F.col("node_id").alias(f"n{s}"), F.col("line_no").alias("_at"))
        there = (F.get("labels", F.lit(s)) == F.col("_label")) & (F.col("_at") < F.col("line_no"))
        out = out.join(F.broadcast(side), there, "left").drop("_label", "_at")
    index = F.slice(F.array(*[F.col(f"n{s}") for s in range(8)]), F.lit(1), F.size("labels"))
    out = out.select("line_no", "type", "labels", index.alias("nodes"))
    misses = F.transform("labels", lambda v, i: F.struct(v.alias("label"), F.get("nodes", i).isNull().alias("missing")))
    unknown = out.select("line_no", F.inline(misses)).filter("missing").select("line_no", "label").distinct()
    return _deck_mesh(nodes, out.filter(~F.exists("nodes", lambda v: v.isNull())).select("line_no", "type", "nodes")), unknown


def _fail_on_first(rejects: DataFrame, unknown: DataFrame) -> None:
    bad = rejects.orderBy("line_no").first()
    miss = unknown.orderBy("line_no").first()
    if miss and (not bad or miss["line_no"] < bad["line_no"]):
        raise ValueError(f"element references unknown node {miss['label']} at line {miss['line_no']}")
    if bad:
        raise ValueError(f"{bad['reason']} at line {bad['line_no']}")


def read_deck(spark: SparkSession, path: str, on_error: str = "raise", numbers: str = "strict"):
    """Read a deck into a mesh. ``on_error`` is ``raise``, ``skip`` (drop bad lines) or ``list``.

    ``list`` drops them too and returns the mesh with the dropped lines, (line_no, reason).
    """
    lines = deck_lines(spark, path)
    if pointer_check(lines).first()[0]:
        raise ValueError(f"{path} is a Git LFS pointer, not the deck itself")
    deck = parse_deck(lines, numbers)
    mesh, unknown = resolve_labels(deck)
    if on_error == "raise":
        _fail_on_first(deck.rejects, unknown)
    if mesh.nodes.isEmpty() or mesh.elements.isEmpty():
        raise ValueError(f"no supported nodes or elements in {path}")
    mesh = MeshFrames(mesh.nodes, mesh.elements, path)
    if on_error != "list":
        return mesh
    lost = unknown.select("line_no", F.lit("element references unknown node").alias("reason")).distinct()
    return mesh, deck.rejects.select("line_no", "reason").unionByName(lost)
