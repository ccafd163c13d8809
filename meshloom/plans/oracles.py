"""Independent SQL for the registered queries, written relationally on the base tables."""

from __future__ import annotations

from meshloom.plans.catalog import COST_LIMIT, COST_THREADS, OWNERS

ORACLES: dict[str, str] = {}

# Lame constants of 210 GPa and Poisson ratio 0.3.
LAM, MU = 210.0 * 0.30 / ((1.0 + 0.30) * (1.0 - 2.0 * 0.30)), 210.0 / (2.0 * (1.0 + 0.30))

# One row per element corner of the order mesh, and the part nodes.
ORDER = """
keys AS (SELECT max(p_partkey) + 1 AS n FROM part),
element AS (
    SELECT DISTINCT l_orderkey * n + l_partkey AS elem_id, l_orderkey AS o, l_partkey AS p, n,
           CASE WHEN l_orderkey % 5 = 0 THEN 8 ELSE 4 END AS w,
           CASE WHEN l_orderkey % 5 = 0 THEN 'hex8' ELSE 'tet4' END AS type
    FROM lineitem, keys
),
corner AS (
    SELECT elem_id, type, w, slot, (p + slot * ((o * 13 + p * 7) % greatest(n // 8, 1) + 1)) % n AS node
    FROM element, range(8) AS r(slot) WHERE slot < w
),
node AS (
    SELECT p_partkey AS node_id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 1e2 AS y,
           ((p_partkey * 37) % 101) / 1e1 AS z
    FROM part
)"""

DOF = """
dof AS (
    SELECT elem_id, type, w, slot * 3 + c AS i, node * 3 + c AS dof FROM corner, range(3) AS r(c)
)"""

SCALE = "(1e0 + ((p.elem_id * 17) % 97) * 1e-4)"
SIMPLIFIED = f"""CASE WHEN p.i = q.i THEN 2e0 * {SCALE} + 1e-2 * (p.i % 3)
                 ELSE 2e-2 * {SCALE} / (1 + abs(p.i - q.i)) END"""

ENTRY = f"""
entry AS (
    SELECT p.elem_id, p.i, q.i AS j, p.dof AS "row", q.dof AS col, {SIMPLIFIED} AS value
    FROM dof p JOIN dof q ON p.elem_id = q.elem_id
)"""


def whole(value: str, quanta: str) -> str:
    return f"CAST(floor({value} * {quanta} + 0.5e0) AS BIGINT)"


def matrix(quanta: str) -> str:
    return f"""
matrix AS (
    SELECT "row", col, sum({whole("value", quanta)}) / {quanta} AS value FROM entry GROUP BY "row", col
)"""


def rows(quanta: str) -> str:
    v = whole("value", quanta)
    return f"""
SELECT "row", count(*) AS entries, min(col) AS first_col, max(col) AS last_col,
       CAST(sum(col) AS BIGINT) AS col_sum,
       CAST(sum(CASE WHEN "row" = col THEN {v} END) AS BIGINT) AS diagonal,
       CAST(sum({v}) AS BIGINT) AS total, CAST(sum({v} * (col % 11)) AS BIGINT) AS weighted
FROM matrix GROUP BY "row"
"""


def cube_size(source: str, tets: str = "count(*)") -> str:
    return f"""
size AS (SELECT max(k) AS n FROM range(1, 3000) AS r(k)
         WHERE k = 1 OR 6 * k * k * k <= (SELECT {tets} FROM {source}))"""


# Marks along the edges of a graded box: prefix sums of cell lengths.
PART_MARKS = """
more(axis, cell, length) AS (
    SELECT 0, p_partkey % n, p_size FROM part, size
    UNION ALL SELECT 1, p_partkey % n, floor(p_retailprice) FROM part, size
    UNION ALL SELECT 2, p_partkey % n, length(p_type) FROM part, size),
spacing AS (SELECT axis, cell, CAST(sum(length) AS BIGINT) + 1 AS length FROM more GROUP BY axis, cell),
step AS (
    SELECT r.axis, r.spot, CASE WHEN spot = 0 THEN 0 ELSE coalesce(length, 1) END AS step
    FROM (SELECT a.axis, b.spot FROM size, range(3) AS a(axis), range(n + 1) AS b(spot)) AS r
    LEFT JOIN spacing AS s ON s.axis = r.axis AND s.cell = r.spot - 1),
mark AS (
    SELECT axis, spot, CAST(sum(step) OVER (PARTITION BY axis ORDER BY spot) AS BIGINT) AS far,
           CAST(sum(step) OVER (PARTITION BY axis) AS BIGINT) AS total FROM step)"""


def graded(length: str, mark: str) -> str:
    return f"{length} * {mark}.far / {mark}.total"


CUBE_TETS = """
shape(t, slot, dx, dy, dz) AS (VALUES
    (0,0,0,0,0),(0,1,1,0,0),(0,2,1,1,0),(0,3,1,1,1),
    (1,0,0,0,0),(1,1,1,1,0),(1,2,0,1,0),(1,3,1,1,1),
    (2,0,0,0,0),(2,1,0,1,0),(2,2,0,1,1),(2,3,1,1,1),
    (3,0,0,0,0),(3,1,0,1,1),(3,2,0,0,1),(3,3,1,1,1),
    (4,0,0,0,0),(4,1,0,0,1),(4,2,1,0,1),(4,3,1,1,1),
    (5,0,0,0,0),(5,1,1,0,1),(5,2,1,0,0),(5,3,1,1,1)
)"""
SCRIPT_TETS = """
point(p, dx, dy, dz) AS (VALUES
    (0,0,0,0),(1,1,0,0),(2,1,1,0),(3,0,1,0),(4,0,0,1),(5,1,0,1),(6,1,1,1),(7,0,1,1)),
split(t, slot, p) AS (VALUES
    (0,0,0),(0,1,1),(0,2,3),(0,3,4), (1,0,1),(1,1,2),(1,2,3),(1,3,6),
    (2,0,1),(2,1,4),(2,2,5),(2,3,6), (3,0,3),(3,1,4),(3,2,6),(3,3,7),
    (4,0,1),(4,1,3),(4,2,4),(4,3,6), (5,0,0),(5,1,1),(5,2,4),(5,3,5)),
shape AS (SELECT t, slot, dx, dy, dz FROM split JOIN point USING (p))"""

CUBE_CORNER = """
cell AS (
    SELECT n, i + n * (j + n * k) AS id, i, j, k
    FROM size, range(n) AS a(i), range(n) AS b(j), range(n) AS c(k)
),
corner AS (
    SELECT id * 6 + t AS elem_id, 'tet4' AS type, 4 AS w, slot, i + dx AS gi, j + dy AS gj, k + dz AS gk, n,
           ((k + dz) * (n + 1) + (j + dy)) * (n + 1) + (i + dx) AS node
    FROM cell, shape
)"""

# Corner coordinates side by side, from located(elem_id, slot, x, y, z) and element(elem_id, type).
WIDE = "wide AS (SELECT elem_id, " + ", ".join(
    f"max(CASE WHEN slot = {s} THEN {c} END) AS {c}{s}" for s in range(5) for c in "xyz"
) + " FROM located GROUP BY elem_id)"


def cross(p: int, q: int, u: str, v: str) -> str:
    return f"e{p}{u} * e{q}{v} - e{p}{v} * e{q}{u}"


EDGES = "edge AS (SELECT *, " + ", ".join(
    f"{c}{s} - {c}0 AS e{s}{c}" for s in (1, 2, 3) for c in "xyz"
) + " FROM wide)"
CROSSES = "crossed AS (SELECT *, " + ", ".join(
    f"{cross(p, q, u, v)} AS c{t}{axis}"
    for t, (p, q) in {1: (2, 3), 2: (3, 1), 3: (1, 2)}.items()
    for axis, (u, v) in {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}.items()
) + " FROM edge)"
VOLUME = """
measured AS (
    SELECT *, abs(det) / 6e0 AS volume
    FROM (SELECT *, e1x * c1x + e1y * c1y + e1z * c1z AS det FROM crossed)
)"""
GRADIENT = "inner_gradient AS (SELECT *, " + ", ".join(
    f"CASE WHEN det <> 0 THEN c{s}{c} / det END AS g{s}{c}" for s in (1, 2, 3) for c in "xyz"
) + " FROM measured), gradient AS (SELECT *, " + ", ".join(
    f"-(g1{c} + g2{c} + g3{c}) AS g0{c}" for c in "xyz"
) + " FROM inner_gradient)"
GEOMETRY = f"{WIDE}, {EDGES}, {CROSSES}, {VOLUME}"

# Partial pivoting over the edges: each step takes the row with the largest number, the earlier of equals.
PIVOTS = """
side AS (
    SELECT elem_id, 1 AS s, e1x AS x, e1y AS y, e1z AS z FROM measured UNION ALL SELECT elem_id, 2, e2x, e2y, e2z FROM measured
    UNION ALL SELECT elem_id, 3, e3x, e3y, e3z FROM measured),
ranked AS (SELECT *, row_number() OVER (PARTITION BY elem_id ORDER BY abs(x) DESC, s) AS r FROM side),
lead AS (SELECT elem_id, s AS lead, x AS px, y AS py, z AS pz FROM ranked WHERE r = 1),
under AS (
    SELECT elem_id, px, CASE WHEN s = 1 THEN lead ELSE s END AS s, y - x * CASE WHEN px <> 0 THEN py / px END AS y, z - x * CASE WHEN px <> 0 THEN pz / px END AS z
    FROM ranked JOIN lead USING (elem_id) WHERE r > 1),
again AS (SELECT *, row_number() OVER (PARTITION BY elem_id ORDER BY abs(y) DESC, s) AS r FROM under),
pivots AS (
    SELECT u.elem_id, least(abs(u.px), abs(u.y), abs(l.z - l.y * CASE WHEN u.y <> 0 THEN u.z / u.y END)) AS smallest
    FROM again AS u JOIN again AS l ON l.elem_id = u.elem_id AND u.r = 1 AND l.r = 2)"""

# Physics entries: per element and local node a vector, then all pairs of dofs.
LONG_GRADIENT = PIVOTS + ", slope AS (" + " UNION ALL ".join(
    f"SELECT elem_id, volume, smallest, {s} AS slot, g{s}x AS gx, g{s}y AS gy, g{s}z AS gz FROM gradient JOIN pivots USING (elem_id)" for s in range(4)
) + ")"


def pick(alias: str, index: str) -> str:
    return f"(CASE {index} WHEN 0 THEN {alias}.gx WHEN 1 THEN {alias}.gy ELSE {alias}.gz END)"


def physics_entry() -> str:
    a_i, b_j = pick("a", "ci"), pick("b", "cj")
    a_j, b_i = pick("a", "cj"), pick("b", "ci")
    base = f"{LAM!r}::DOUBLE * ({a_i} * {b_j}) + {MU!r}::DOUBLE * ({a_j} * {b_i})"
    dot = f"{MU!r}::DOUBLE * (a.gx * b.gx + a.gy * b.gy + a.gz * b.gz)"
    return f"""
entry AS (
    SELECT na.node * 3 + ci AS "row", nb.node * 3 + cj AS col,
           CASE WHEN NOT a.volume > 1e-30 OR a.smallest < 1e-30 THEN
                (CASE WHEN a.slot * 3 + ci = b.slot * 3 + cj
                      THEN 2e0 * (1e0 + ((a.elem_id * 17) % 97) * 1e-4) + 1e-2 * ci
                      ELSE 2e-2 * (1e0 + ((a.elem_id * 17) % 97) * 1e-4) / (1 + abs(a.slot * 3 + ci - b.slot * 3 - cj)) END)
                ELSE a.volume * (CASE WHEN ci = cj THEN ({base}) + {dot} ELSE {base} END) END AS value
    FROM slope a JOIN slope b ON a.elem_id = b.elem_id
    JOIN corner na ON na.elem_id = a.elem_id AND na.slot = a.slot
    JOIN corner nb ON nb.elem_id = b.elem_id AND nb.slot = b.slot,
    range(3) AS r(ci), range(3) AS s(cj)
)"""


VECTOR = """
sized AS (SELECT vec_id, embedding, len(embedding) AS n, (max(len(embedding)) OVER () + 2) // 3 AS room FROM embeddings),
node AS (
    SELECT vec_id * room + t AS node_id, coalesce(CAST(embedding[3 * t + 1] AS DOUBLE), 0e0) AS x,
           coalesce(CAST(embedding[3 * t + 2] AS DOUBLE), 0e0) AS y, coalesce(CAST(embedding[3 * t + 3] AS DOUBLE), 0e0) AS z
    FROM (SELECT *, unnest(range((n + 2) // 3)) AS t FROM sized)
),
chain AS (SELECT vec_id, room, unnest(range((n + 2) // 3 - 3)) AS t FROM sized),
corner AS (
    SELECT vec_id * room + t AS elem_id, 'tet4' AS type, 4 AS w, slot, vec_id * room + t + slot AS node
    FROM chain, range(4) AS s(slot)
)"""
LOCATED = "located AS (SELECT elem_id, slot, x, y, z FROM corner JOIN node ON node_id = node)"

ORACLES["cube_tet4_assembly"] = f"""WITH {cube_size("part", "sum(p_size) // 10")}, {CUBE_TETS}, {CUBE_CORNER}, {DOF}, {ENTRY}, {matrix("1e9")}
SELECT "row", col, value FROM matrix"""

ORACLES["cube_stats"] = f"""WITH {cube_size("lineitem", "CAST(sum(floor(l_quantity)) AS BIGINT)")}
SELECT 'cube_tet4_' || n || 'x' || n || 'x' || n AS mesh, (n + 1) * (n + 1) * (n + 1) AS nodes, 6 * n * n * n AS elements,
       3 * (n + 1) * (n + 1) * (n + 1) AS dofs, 'tet4' AS dominant_type FROM size
UNION ALL
SELECT 'cube_hex8_' || n || 'x' || n || 'x' || n, (n + 1) * (n + 1) * (n + 1), n * n * n,
       3 * (n + 1) * (n + 1) * (n + 1), 'hex8' FROM size"""

ORACLES["cube_node_coordinates"] = f"""WITH {cube_size("part")}, {PART_MARKS}
SELECT (c.spot * (n + 1) + b.spot) * (n + 1) + a.spot AS node_id,
       {graded("2e0", "a")} AS x, {graded("3e0", "b")} AS y, {graded("5e0", "c")} AS z
FROM size, mark AS a, mark AS b, mark AS c WHERE a.axis = 0 AND b.axis = 1 AND c.axis = 2"""

CUBE_LOCATED = f"""
located AS (
    SELECT elem_id, slot, {graded("1e0", "a")} AS x, {graded("1e0", "b")} AS y, {graded("1e0", "c")} AS z
    FROM corner JOIN mark AS a ON a.axis = 0 AND a.spot = gi JOIN mark AS b ON b.axis = 1 AND b.spot = gj JOIN mark AS c ON c.axis = 2 AND c.spot = gk)"""
ORACLES["cube_physics_profile"] = f"""WITH {cube_size("part")}, {PART_MARKS}, {CUBE_TETS}, {CUBE_CORNER}, {CUBE_LOCATED}, {GEOMETRY}, {GRADIENT},
{LONG_GRADIENT}, {physics_entry()}, {matrix("1e6")} {rows("1e6")}"""

ORACLES["script_mesh_volumes"] = f"""WITH
size AS (SELECT CAST(floor(pow((SELECT count(*) FROM orders) / 3e0, 1e0 / 3e0)) AS BIGINT) AS n),
{SCRIPT_TETS}, {CUBE_CORNER},
box AS (
    SELECT 1e0 + CAST(count(DISTINCT o_custkey) AS DOUBLE) / count(*) AS lx, 1e0 + CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) AS ly,
           1e0 + CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE) / count(*) AS lz FROM orders),
located AS (SELECT elem_id, slot, gi * (lx / n) AS x, gj * (ly / n) AS y, gk * (lz / n) AS z FROM corner, box), {GEOMETRY}, {PIVOTS}
SELECT elem_id % 6 AS slot, count(*) AS elements, count(*) FILTER (NOT volume > 1e-30 OR smallest < 1e-30) AS degenerate,
       CAST(sum({whole("volume", "1e12")}) AS BIGINT) AS volume_sum
FROM measured JOIN pivots USING (elem_id) GROUP BY elem_id % 6"""

ORACLES["deck_nodes"] = f"""WITH {ORDER}
SELECT row_number() OVER (ORDER BY node_id) - 1 AS node_id, x, y, z FROM node"""

ORACLES["deck_elements"] = f"""WITH {ORDER},
dense AS (SELECT node_id AS label, row_number() OVER (ORDER BY node_id) - 1 AS idx FROM node),
listed AS (
    SELECT elem_id, type, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY slot) AS nodes
    FROM corner JOIN dense ON label = node GROUP BY elem_id, type)
SELECT row_number() OVER (ORDER BY type DESC, elem_id) - 1 AS elem_id, type, nodes FROM listed"""

ORACLES["deck_rejects"] = """
SELECT doc_id + 1 AS line_no,
       CASE WHEN len(string_split(regexp_replace('1,' || text, ',$', ''), ',')) < 4
            THEN 'too few node fields' ELSE 'not a number in node line' END AS reason
FROM documents"""

ORACLES["deck_pointer_check"] = """
SELECT 'plain' AS input, false AS is_pointer UNION ALL SELECT 'marked', count(*) > 1 FROM documents"""

ORACLES["deck_unknown_labels"] = f"""WITH {ORDER}
SELECT elem_id + 1000000000 AS line_no, count(DISTINCT node) AS unknown_labels
FROM corner WHERE node NOT IN (SELECT s_suppkey FROM supplier) GROUP BY elem_id"""

ORACLES["order_element_dofs"] = f"""WITH {ORDER}, {DOF} SELECT elem_id, CAST(i AS INTEGER) AS i, dof FROM dof"""

ORACLES["element_widths"] = f"""WITH {ORDER},
counted AS (SELECT elem_id, type, count(*) AS n FROM corner GROUP BY elem_id, type)
SELECT type, CASE type WHEN 'tet4' THEN 4 ELSE 8 END AS node_count, CASE type WHEN 'tet4' THEN 12 ELSE 24 END AS dof_count,
       count(*) AS elements, count(*) FILTER (n = CASE type WHEN 'tet4' THEN 4 ELSE 8 END) AS consistent
FROM counted GROUP BY type"""

ORACLES["name_aliases"] = """WITH
spelled(k, spelling, element_type, kernel, algorithm) AS (VALUES
    (0, 'C3D4', 'tet4', 'physics_tet4', NULL), (1, 'Hex8', 'hex8', NULL, NULL), (2, 'synthetic', NULL, 'simplified', NULL),
    (3, 'Physics-Tet4', NULL, 'physics_tet4', NULL), (4, 'ADDTO', NULL, NULL, 'cpu_atomic'),
    (5, 'owner_computes', NULL, NULL, 'cpu_row_owner'), (6, 'Serial', NULL, NULL, 'cpu_serial'),
    (7, 'coo', NULL, NULL, 'cpu_coo_sort_reduce'), (8, 'color', NULL, NULL, 'cpu_graph_coloring'), (9, 'other', NULL, NULL, NULL))
SELECT spelling, element_type, kernel, algorithm, count(*) AS n
FROM events JOIN spelled ON user_id % 10 = k GROUP BY ALL"""

ORACLES["memory_labels"] = f"""WITH sized AS (
    SELECT o_orderkey, {whole("o_totalprice", "1e2")} * (o_orderkey + 1) * ((o_custkey % 100) * 10 + 1) AS bytes FROM orders)
SELECT o_orderkey, bytes,
       CASE WHEN bytes < 1024 THEN bytes || ' B'
            WHEN bytes < 1048576 THEN printf('%.2f KiB', bytes / 1024e0)
            WHEN bytes < 1073741824 THEN printf('%.2f MiB', bytes / 1048576e0)
            WHEN bytes < 1099511627776 THEN printf('%.2f GiB', bytes / 1073741824e0)
            ELSE printf('%.2f TiB', bytes / 1099511627776e0) END AS label,
       bytes / 1073741824e0 AS gib
FROM sized"""

ORACLES["dataset_titles"] = """
SELECT p_partkey, replace(replace(p_name || '_' || p_type || '/' || p_brand, '/', '_'), ' ', '_') AS slug,
       p_name || ' | kernel=' || p_type || '/' || p_brand AS title
FROM part"""

ALGORITHM = """CASE event_type WHEN 'click' THEN 'cpu_serial' WHEN 'view' THEN 'cpu_atomic' WHEN 'purchase' THEN 'cpu_private_csr'
                  WHEN 'signup' THEN 'cpu_row_owner' WHEN 'error' THEN 'cpu_graph_coloring' ELSE '' END"""
# The display labels of the methods that the events name.
LABELS = """
    WHEN 'cpu_serial' THEN '串行基线' || chr(10) || 'Serial' WHEN 'cpu_atomic' THEN '原子直接累加' || chr(10) || 'Atomic'
    WHEN 'cpu_private_csr' THEN '线程私有 CSR' || chr(10) || 'Private CSR'
    WHEN 'cpu_row_owner' THEN '行拥有者' || chr(10) || 'Row Owner' WHEN 'cpu_graph_coloring' THEN '图着色' || chr(10) || 'Coloring'"""
ORACLES["algorithm_labels"] = f"""WITH
both_names AS (SELECT {ALGORITHM} AS algorithm FROM events UNION ALL SELECT event_type FROM events)
SELECT algorithm, CASE algorithm {LABELS} ELSE algorithm END AS label, count(*) AS n FROM both_names GROUP BY ALL"""

ORACLES["case_names"] = """
SELECT page_id,
       CASE WHEN page_id % 5 = 0 THEN 'case_' || page_id
            WHEN page_id % 2 = 0 THEN
                CASE WHEN strpos(substr(name, 2), '.') = 0 THEN name
                     ELSE array_to_string(string_split(name, '.')[:-2], '.') END
            ELSE 'cube_' || CASE WHEN page_id % 3 = 0 THEN 'hex8' ELSE 'tet4' END || '_' ||
                 (page_id % 7 + 1) || 'x' || (page_id % 11 + 1) || 'x' || (page_id % 13 + 1) END AS case_name
FROM (SELECT page_id, string_split(url, '/')[-1] AS name FROM pages)"""

ORACLES["skip_reasons"] = """
SELECT doc_id,
       CASE WHEN m LIKE '%above limit%' OR m LIKE '%transient memory%' THEN 'RESOURCE_LIMIT'
            WHEN m LIKE '%git lfs pointer%' THEN 'INPUT_NOT_READY'
            WHEN m LIKE '%unknown argument%' THEN 'CLI_ERROR' ELSE 'EXECUTION_ERROR' END AS reason
FROM (SELECT doc_id, lower(text || CASE doc_id % 5 WHEN 1 THEN ' is Above Limit now' WHEN 2 THEN ' needs TRANSIENT memory'
                                   WHEN 3 THEN ' is a Git LFS pointer' WHEN 4 THEN ' has an unknown argument' ELSE '' END) AS m
      FROM documents)"""

ORDER_GEOMETRY = f"{ORDER}, {LOCATED}, {GEOMETRY}"
STIFF = """
stiff AS (
    SELECT elem_id, type, greatest(CASE WHEN type = 'tet4' THEN volume ELSE (x1 - x0) * (y3 - y0) * (z4 - z0) END, 1e-10) AS v
    FROM measured JOIN element USING (elem_id)
)"""
COUPLING_ENTRY = """
entry AS (
    SELECT p.dof AS "row", q.dof AS col,
           CASE WHEN p.i = q.i THEN 1e0 / v * CASE WHEN p.type = 'tet4' THEN 4e0 ELSE 8e0 END
                WHEN p.i % 3 = q.i % 3 THEN -(1e0 / v) * 0.5e0 ELSE 0e0 END AS value
    FROM dof p JOIN dof q ON p.elem_id = q.elem_id JOIN stiff s ON s.elem_id = p.elem_id
)"""
ORACLES["near_zero_entries"] = f"""WITH {ORDER_GEOMETRY}, {STIFF}, {DOF}, {COUPLING_ENTRY}
SELECT "row", count(*) AS entries, count(*) FILTER (abs(value) >= 1e-15) AS kept FROM entry GROUP BY "row" """
ORACLES["coupling_assembly"] = f"""WITH {ORDER_GEOMETRY}, {STIFF}, {DOF}, {COUPLING_ENTRY}, {matrix("1e4")} {rows("1e4")}"""
ORACLES["coupling_stiffness"] = f"""WITH {ORDER_GEOMETRY}, {STIFF}
SELECT elem_id, type, round(v, 6) AS volume, round(1e0 / v, 3) AS stiffness FROM stiff"""

ORACLES["tet_volumes"] = f"""WITH {VECTOR}, {LOCATED}, {GEOMETRY}, {PIVOTS}
SELECT elem_id, round(volume, 12) AS volume, NOT volume > 1e-30 OR smallest < 1e-30 AS fallback
FROM measured JOIN pivots USING (elem_id)"""
ORACLES["physics_pivots"] = f"""WITH {VECTOR},
located AS (SELECT elem_id, slot, x * 1024e0 AS x, y * 1024e0 AS y, z * pow(2e0, -98) AS z FROM corner JOIN node ON node_id = node), {GEOMETRY}, {PIVOTS}
SELECT elem_id, NOT volume > 1e-30 AS by_volume, smallest < 1e-30 AS by_pivot, NOT volume > 1e-30 OR smallest < 1e-30 AS fallback
FROM measured JOIN pivots USING (elem_id)"""
ORACLES["tet_gradients"] = f"""WITH {VECTOR}, {LOCATED}, {GEOMETRY}, {GRADIENT}
SELECT elem_id, {", ".join(f"round(g{s}{c}, 6) AS g{s}{c}" for s in range(4) for c in "xyz")} FROM gradient"""
ORACLES["vector_physics"] = f"""WITH {VECTOR}, {LOCATED}, {GEOMETRY}, {GRADIENT}, {LONG_GRADIENT}, {physics_entry()},
{matrix("1e6")} {rows("1e6")}"""
ORACLES["mesh_text"] = f"""WITH {VECTOR}
SELECT CAST(0 AS INTEGER) AS part, CAST(0 AS BIGINT) AS at,
       'Tet4 ' || (SELECT count(*) FROM node) || ' ' || count(DISTINCT elem_id) AS text FROM corner
UNION ALL SELECT 1, node_id, printf('%.10e', x) || ' ' || printf('%.10e', y) || ' ' || printf('%.10e', z) FROM node
UNION ALL SELECT 2, elem_id, string_agg(CAST(node AS VARCHAR), ' ' ORDER BY slot) FROM corner GROUP BY elem_id"""
ORACLES["simplified_profile"] = f"""WITH {ORDER}, {DOF}, {ENTRY}
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, count(*) AS entries,
       CAST(sum({whole("value", "1e9")}) AS BIGINT) AS total
FROM entry GROUP BY i, j"""
ORACLES["physics_fallback"] = f"""WITH {ORDER_GEOMETRY}, {PIVOTS}
SELECT type, type = 'hex8' OR NOT volume > 1e-30 OR smallest < 1e-30 AS fallback, count(*) AS elements,
       CAST(sum(CASE WHEN type = 'tet4' THEN {whole("volume", "1e6")} END) AS BIGINT) AS tet_volume
FROM measured JOIN element USING (elem_id) JOIN pivots USING (elem_id) GROUP BY ALL"""
ORACLES["unknown_nodes"] = f"""WITH {ORDER}
SELECT elem_id, count(DISTINCT node) AS missing FROM corner
WHERE node NOT IN (SELECT s_suppkey FROM supplier) GROUP BY elem_id"""

ORACLES["order_mesh_stats"] = f"""WITH {ORDER}
SELECT (SELECT count(*) FROM part) AS nodes, count(*) AS elements, 3 * (SELECT count(*) FROM part) AS dofs,
       CASE WHEN count(*) FILTER (type = 'hex8') > count(*) FILTER (type = 'tet4') THEN 'hex8' ELSE 'tet4' END AS dominant_type
FROM element"""

PATTERN = """
pattern AS (SELECT DISTINCT p.dof AS "row", q.dof AS col FROM dof p JOIN dof q ON p.elem_id = q.elem_id)"""
LENGTHS = """
every_row AS (SELECT p_partkey * 3 + c AS "row" FROM part, range(3) AS r(c)),
lengths AS (SELECT e."row", count(col) AS row_length FROM every_row e LEFT JOIN pattern p ON p."row" = e."row" GROUP BY e."row"),
offsets AS (SELECT "row", row_length, CAST(sum(row_length) OVER (ORDER BY "row") - row_length AS BIGINT) AS row_offset FROM lengths)"""
POSITIONS = """
positions AS (SELECT "row", col, row_number() OVER (ORDER BY "row", col) - 1 AS pos FROM pattern)"""
STRUCTURE = f"{ORDER}, {DOF}, {PATTERN}"
ORACLES["order_pattern_rows"] = f"""WITH {STRUCTURE}
SELECT "row", count(*) AS entries, min(col) AS first_col, max(col) AS last_col, CAST(sum(col) AS BIGINT) AS col_sum
FROM pattern GROUP BY "row" """
ORACLES["order_row_offsets"] = f"""WITH {STRUCTURE}, {LENGTHS} SELECT "row", row_offset, row_length FROM offsets"""
ORACLES["order_csr"] = f"""WITH {STRUCTURE}, {LENGTHS}, {ENTRY}, {matrix("1e9")},
packed AS (SELECT "row", count(*) AS length, md5(string_agg(CAST(col AS VARCHAR), ',' ORDER BY col)) AS cols_md5,
                  CAST(sum({whole("value", "1e9")}) AS BIGINT) AS total FROM matrix GROUP BY "row")
SELECT o."row", CAST(0 AS BIGINT) AS piece, row_offset AS "offset", CAST(coalesce(length, 0) AS INTEGER) AS length,
       coalesce(cols_md5, md5('')) AS cols_md5, coalesce(total, 0) AS total
FROM offsets o LEFT JOIN packed p ON p."row" = o."row" """
ORACLES["order_csr_valid"] = f"""WITH {STRUCTURE}, filled AS (SELECT DISTINCT "row" FROM pattern)
SELECT 'whole' AS matrix, CAST(0 AS BIGINT) AS problems
UNION ALL SELECT 'damaged', count(*) FROM filled WHERE "row" % 5 = 0"""
ORACLES["order_matrix_bytes"] = f"""WITH {STRUCTURE}, widths AS (SELECT elem_id, w * 3 AS d FROM element)
SELECT 3 * (SELECT count(*) FROM part) AS n_rows, (SELECT count(*) FROM pattern) AS nnz,
       4 * (3 * (SELECT count(*) FROM part) + 1) + 12 * (SELECT count(*) FROM pattern) AS bytes,
       CAST(4 * (count(*) + 1 + sum(d) + sum(d * d)) AS BIGINT) AS plan_bytes FROM widths"""
ORACLES["order_scatter"] = f"""WITH {STRUCTURE}, {POSITIONS}
SELECT p.elem_id, count(*) AS entries, min(pos) AS first_pos, max(pos) AS last_pos,
       CAST(sum(pos * (p.i + 1)) AS BIGINT) AS weighted_i, CAST(sum(pos * (q.i + 1)) AS BIGINT) AS weighted_j
FROM dof p JOIN dof q ON p.elem_id = q.elem_id JOIN positions s ON s."row" = p.dof AND s.col = q.dof
GROUP BY p.elem_id"""
ORACLES["entry_lookup"] = f"""WITH {STRUCTURE}, {POSITIONS}
SELECT DISTINCT s."row", s.col, pos FROM lineitem JOIN positions s ON s."row" = l_partkey * 3 AND s.col = l_suppkey * 3 + 1"""
ORACLES["order_valence"] = f"""WITH {ORDER},
valence AS (SELECT node_id, count(elem_id) AS valence FROM node LEFT JOIN corner ON node = node_id GROUP BY node_id)
SELECT valence, count(*) AS nodes FROM valence GROUP BY valence"""
ORACLES["order_incidence"] = f"""WITH {ORDER}
SELECT node AS node_id, CAST(0 AS BIGINT) AS piece, CAST(count(*) AS INTEGER) AS n,
       md5(string_agg(CAST(elem_id AS VARCHAR), ',' ORDER BY elem_id)) AS elements_md5
FROM corner GROUP BY node"""
ORACLES["order_conflict_degree"] = f"""WITH {ORDER}
SELECT p.elem_id, count(DISTINCT q.elem_id) - 1 AS degree FROM corner p JOIN corner q ON p.node = q.node GROUP BY p.elem_id"""

METHOD_ORACLE = f"""WITH {ORDER}, {DOF}, {ENTRY}, {matrix("1e9")} {rows("1e9")}"""
# Sums of whole multiples of two quanta that follow from the largest value: any order gives the same double.
ORACLES["assemble_serial"] = f"""WITH {ORDER}, {DOF}, {ENTRY},
quanta AS (SELECT pow(2e0, floor(log2(max(abs(value)))) - 29) AS q1, pow(2e0, floor(log2(max(abs(value)))) - 59) AS q2 FROM entry),
split AS (SELECT "row", col, value, q1, q2, CAST(floor(value / q1) AS BIGINT) AS hi FROM entry, quanta),
matrix AS (
    SELECT "row", col, CAST(sum(hi) AS DOUBLE) * q1 + CAST(sum(CAST(floor((value - hi * q1) / q2) AS BIGINT)) AS DOUBLE) * q2 AS value
    FROM split GROUP BY "row", col, q1, q2)
SELECT "row", count(*) AS entries, max(value) AS largest, min(value) AS smallest, CAST(sum(col) AS BIGINT) AS col_sum
FROM matrix GROUP BY "row" """
for _name in ("atomic", "private_csr", "coo_sort_reduce", "row_owner", "graph_coloring"):
    ORACLES[f"assemble_{_name}"] = METHOD_ORACLE

OWNED = f"""
owned AS (SELECT elem_id, w, least({OWNERS - 1}, dof * {OWNERS} // (3 * (SELECT count(*) FROM part))) AS owner FROM dof)"""
ORACLES["owner_load"] = f"""WITH {ORDER}, {DOF}, {OWNED}
SELECT owner, count(DISTINCT elem_id) AS elements, CAST(sum(w * 3) AS BIGINT) AS tasks FROM owned GROUP BY owner"""
ORACLES["owner_replication"] = f"""WITH {ORDER}, {DOF}, {OWNED},
spread AS (SELECT elem_id, count(DISTINCT owner) AS n FROM owned GROUP BY elem_id)
SELECT CAST(n AS INTEGER) AS owners_per_element, count(*) AS elements FROM spread GROUP BY n"""
MEM = """CASE WHEN {b} < 1024 THEN {b} || ' B' WHEN {b} < 1048576 THEN printf('%.2f KiB', {b} / 1024e0)
              WHEN {b} < 1073741824 THEN printf('%.2f MiB', {b} / 1048576e0) ELSE printf('%.2f GiB', {b} / 1073741824e0) END"""
ORACLES["method_cost"] = f"""WITH {STRUCTURE},
totals AS (SELECT count(*) AS e, CAST(sum(w * 3 * w * 3) AS BIGINT) AS t, (SELECT count(*) FROM pattern) AS nnz FROM element),
estimate AS (
    SELECT 'cpu_serial' AS algorithm, CAST(0 AS BIGINT) AS bytes FROM totals
    UNION ALL SELECT 'cpu_atomic', 0 FROM totals
    UNION ALL SELECT 'cpu_private_csr', 8 * {COST_THREADS} * nnz FROM totals
    UNION ALL SELECT 'cpu_coo_sort_reduce', 16 * t FROM totals
    UNION ALL SELECT 'cpu_graph_coloring', 8 * e FROM totals
    UNION ALL SELECT 'cpu_row_owner', 12 * t FROM totals),
judged AS (SELECT *, bytes > {COST_LIMIT} AND algorithm <> 'cpu_graph_coloring' AS above FROM estimate)
SELECT algorithm, bytes, CASE WHEN above THEN 'SKIP' ELSE 'PASS' END AS status,
       CASE WHEN above THEN algorithm || CASE WHEN algorithm = 'cpu_private_csr' THEN ' requires ' ELSE ' requires about ' END ||
            {MEM.format(b="bytes")} || ' transient memory, above limit ' || {MEM.format(b=COST_LIMIT)} ELSE '' END AS message
FROM judged"""
ORACLES["batch_check"] = f"""WITH {ORDER}
SELECT count(*) AS elements, count(*) FILTER (elem_id IS NULL) AS conflicts FROM element"""
# In a chain of consecutive tets the first fit repeats every four elements.
ORACLES["vector_first_fit"] = f"""WITH {VECTOR} SELECT vec_id * room + t AS elem_id, t % 4 AS batch FROM chain"""
ORACLES["order_first_fit"] = f"""WITH {ORDER}
SELECT count(*) AS elements, CAST(0 AS BIGINT) AS clashes, CAST(0 AS BIGINT) AS unforced FROM element"""
ORACLES["vector_batch_sizes"] = f"""WITH {VECTOR} SELECT t % 4 AS batch, count(*) AS elements FROM chain GROUP BY t % 4"""
# The batches follow hashes that SQL does not see; only what must hold is compared.
ORACLES["order_batch_summary"] = f"WITH {ORDER} SELECT count(*) AS elements, true AS enough FROM element"
ORACLES["mesh_coverage"] = f"""WITH {ORDER}
SELECT count(*) AS pairs, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) AS elements,
       CAST(sum(w) AS BIGINT) AS corners FROM element"""

ORACLES["matrix_compare"] = f"""WITH {ORDER}, {DOF}, {ENTRY}, {matrix("1e9")},
sums AS (SELECT sqrt(sum((value * 1.0009765625e0 - value) * (value * 1.0009765625e0 - value)) / sum(value * value)) AS rel,
                max(abs(value * 1.0009765625e0 - value)) AS top FROM matrix),
hexes AS (SELECT count(*) AS n FROM element WHERE type = 'hex8')
SELECT 'same' AS pair, true AS same_structure, 0e0 AS rel_l2, 0e0 AS max_abs, true AS passed FROM sums
UNION ALL SELECT 'scaled', true, round(rel, 9), round(top, 9), false FROM sums
UNION ALL SELECT 'tets', n = 0, CASE WHEN n = 0 THEN 0e0 END, CASE WHEN n = 0 THEN 0e0 END, n = 0 FROM hexes"""
ORACLES["matrix_same_structure"] = f"""WITH {STRUCTURE}, tets AS (
    SELECT DISTINCT p.dof AS "row", q.dof AS col FROM dof p JOIN dof q ON p.elem_id = q.elem_id WHERE p.type = 'tet4')
SELECT 'all' AS pair, true AS same_structure
UNION ALL SELECT 'tets', (SELECT count(*) FROM tets) = (SELECT count(*) FROM pattern)"""
ORACLES["matrix_frobenius"] = f"""WITH {ORDER}, {DOF}, {ENTRY}, {matrix("1e9")}
SELECT round(sqrt(sum(value * value)), 6) AS frobenius FROM matrix"""

# Run log.
SAMPLES = f"""
timed AS (
    SELECT event_id, 'case_' || (event_id % 3) AS case_name,
           CASE WHEN user_id % 2 = 0 THEN 'simplified' ELSE 'physics_tet4' END AS kernel, {ALGORITHM} AS algorithm,
           CASE WHEN event_type = 'click' THEN 1
                ELSE CASE user_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 14 END END AS threads,
           CAST(floor(value * 1e2 + 0.5e0) AS DOUBLE) AS ms
    FROM events
),
samples AS (
    SELECT *, ms + floor(ms / 4e0) AS total_ms, floor(ms / 4e0) AS preprocess_ms, floor(ms / 16e0) AS assembly_zero_ms,
           CASE WHEN algorithm = 'cpu_atomic' THEN 0e0 ELSE floor(ms / 8e0) END AS assembly_generate_ms,
           floor(ms / 2e0) AS assembly_numeric_ms,
           CASE WHEN algorithm = 'cpu_private_csr' THEN floor(ms / 5e0) ELSE 0e0 END AS assembly_merge_ms,
           0e0 AS assembly_sort_ms, 0e0 AS assembly_reduce_ms
    FROM timed
),
stats AS (
    SELECT case_name, kernel, algorithm, threads, count(*) AS run_count,
           sum(ms) / count(*) AS assembly_mean_ms, min(ms) AS assembly_min_ms, max(ms) AS assembly_max_ms,
           stddev_pop(ms) AS assembly_std_ms,
           sum(total_ms) / count(*) AS total_mean_ms, min(total_ms) AS total_min_ms, max(total_ms) AS total_max_ms,
           stddev_pop(total_ms) AS total_std_ms, max(preprocess_ms) AS preprocess_ms,
           sum(assembly_zero_ms) / count(*) AS assembly_zero_ms, sum(assembly_generate_ms) / count(*) AS assembly_generate_ms,
           sum(assembly_numeric_ms) / count(*) AS assembly_numeric_ms, sum(assembly_merge_ms) / count(*) AS assembly_merge_ms,
           sum(assembly_sort_ms) / count(*) AS assembly_sort_ms, sum(assembly_reduce_ms) / count(*) AS assembly_reduce_ms
    FROM samples GROUP BY case_name, kernel, algorithm, threads
)"""
METRICS = """
baseline AS (SELECT case_name, kernel, assembly_mean_ms AS serial_ms FROM stats WHERE algorithm = 'cpu_serial'),
sped AS (
    SELECT s.*, CASE WHEN assembly_mean_ms > 0 THEN coalesce(serial_ms, 0e0) / assembly_mean_ms ELSE 0e0 END AS speedup
    FROM stats s LEFT JOIN baseline b ON b.case_name = s.case_name AND b.kernel = s.kernel
),
metrics AS (
    SELECT *, speedup / threads AS efficiency,
           CASE WHEN total_mean_ms > 0 THEN preprocess_ms / total_mean_ms ELSE 0e0 END AS preprocess_share
    FROM sped
)"""
RUNS = f"""{SAMPLES}, {METRICS},
runs AS (
    SELECT *, assembly_mean_ms AS assembly_ms, total_mean_ms AS total_ms, run_count * threads * 1048576 AS extra_memory_bytes,
           CASE WHEN algorithm = 'cpu_graph_coloring' AND threads = 14 THEN 'SKIP'
                WHEN algorithm = 'cpu_row_owner' AND threads = 8 AND case_name = 'case_1' THEN 'FAIL' ELSE 'PASS' END AS status,
           CASE WHEN algorithm = 'cpu_graph_coloring' AND threads = 14 THEN 'RESOURCE_LIMIT' ELSE '' END AS skip_reason,
           CASE WHEN algorithm = 'cpu_graph_coloring' AND threads = 14 THEN 'estimate is Above Limit of the run'
                WHEN algorithm = 'cpu_row_owner' AND threads = 8 AND case_name = 'case_1' THEN 'Correctness check failed'
                WHEN algorithm = 'cpu_graph_coloring' THEN 'first fit' ELSE '' END AS diagnostics,
           CASE WHEN algorithm = 'cpu_private_csr' THEN preprocess_ms ELSE 0e0 END AS prepare_allocate_ms,
           CASE WHEN algorithm = 'cpu_graph_coloring' THEN preprocess_ms ELSE 0e0 END AS prepare_coloring_ms,
           CASE WHEN algorithm = 'cpu_row_owner' THEN preprocess_ms ELSE 0e0 END AS prepare_owner_partition_ms,
           ((CAST(substr(case_name, 6) AS BIGINT) * 2 + CASE WHEN kernel = 'physics_tet4' THEN 1 ELSE 0 END) * 10 +
            CASE algorithm WHEN 'cpu_serial' THEN 0 WHEN 'cpu_atomic' THEN 1 WHEN 'cpu_private_csr' THEN 2
                           WHEN 'cpu_row_owner' THEN 3 ELSE 4 END) * 100 + threads AS ordinal
    FROM metrics
),
passed AS (SELECT * FROM runs WHERE status = 'PASS'),
best AS (SELECT * FROM passed
         QUALIFY row_number() OVER (PARTITION BY case_name, kernel, algorithm ORDER BY assembly_ms, ordinal) = 1)"""
KEYS = "case_name, kernel, algorithm, threads"
ORACLES["run_log_normalized"] = f"""WITH {RUNS}
SELECT {KEYS}, CAST(CASE WHEN threads % 2 = 1 THEN 0 ELSE run_count END AS INTEGER) AS run_count,
       CASE WHEN threads % 2 = 1 THEN assembly_min_ms ELSE assembly_ms END AS assembly_ms, total_ms, 0e0 AS speedup,
       status, skip_reason, '' AS diagnostics FROM runs"""
SAID = "'said \"' || algorithm || '\",' || chr(10) || diagnostics || chr(10)"
ORACLES["run_csv_files"] = f"""WITH {RUNS}
SELECT {KEYS}, case_name AS mesh, CAST(run_count AS INTEGER) AS run_count,
       CASE WHEN kernel = 'simplified' THEN assembly_min_ms ELSE 0e0 END AS assembly_min_ms,
       CASE WHEN kernel <> 'simplified' THEN assembly_min_ms
            WHEN assembly_ms = 0 THEN 0e0 ELSE CAST(printf('%.9e', assembly_ms) AS DOUBLE) END AS assembly_ms,
       CAST(CASE WHEN kernel = 'simplified' THEN extra_memory_bytes ELSE 0 END AS BIGINT) AS extra_memory_bytes,
       status, CASE WHEN kernel = 'simplified' THEN skip_reason ELSE '' END AS skip_reason, {SAID} AS diagnostics FROM runs"""
ORACLES["run_json_files"] = f"""WITH {RUNS}
SELECT {KEYS}, case_name AS mesh, 'Tet4' AS element_type, CAST(run_count AS INTEGER) AS run_count, assembly_ms,
       CAST(extra_memory_bytes AS BIGINT) AS extra_memory_bytes, status, skip_reason, {SAID} AS diagnostics FROM runs"""
ORACLES["run_stats"] = f"""WITH {SAMPLES}
SELECT {KEYS}, CAST(run_count AS INTEGER) AS run_count,
       assembly_mean_ms, assembly_min_ms, assembly_max_ms, total_mean_ms, total_min_ms, total_max_ms,
       round(assembly_std_ms, 6) AS assembly_std_ms, round(total_std_ms, 6) AS total_std_ms,
       assembly_zero_ms, assembly_generate_ms, assembly_numeric_ms, assembly_merge_ms, assembly_sort_ms, assembly_reduce_ms
FROM stats"""
ORACLES["run_speedup"] = f"WITH {SAMPLES}, {METRICS} SELECT {KEYS}, speedup, efficiency, preprocess_share FROM metrics"
ORACLES["run_status"] = f"WITH {RUNS} SELECT {KEYS}, status, skip_reason, diagnostics FROM runs"
ORACLES["run_highlights"] = f"""WITH {RUNS},
a AS (SELECT * FROM passed QUALIFY row_number() OVER (PARTITION BY case_name, kernel ORDER BY assembly_ms, ordinal) = 1),
b AS (SELECT * FROM passed QUALIFY row_number() OVER (PARTITION BY case_name, kernel
      ORDER BY algorithm = 'cpu_serial', CASE WHEN algorithm = 'cpu_serial' THEN assembly_ms ELSE -speedup END, ordinal) = 1),
c AS (SELECT * FROM passed QUALIFY row_number() OVER (PARTITION BY case_name, kernel ORDER BY extra_memory_bytes, ordinal) = 1)
SELECT a.case_name, a.kernel, a.algorithm AS fastest_algorithm, a.threads AS fastest_threads, a.assembly_ms AS fastest_ms,
       b.algorithm AS speedup_algorithm, b.threads AS speedup_threads, b.speedup AS best_speedup,
       c.algorithm AS memory_algorithm, c.extra_memory_bytes AS lowest_memory_bytes
FROM a JOIN b USING (case_name, kernel) JOIN c USING (case_name, kernel)"""
ORACLES["run_datasets"] = f"""WITH {RUNS}
SELECT case_name, kernel, count(*) AS runs, count(*) FILTER (status = 'PASS') AS passed FROM runs GROUP BY case_name, kernel"""
ORACLES["run_thread_series"] = f"WITH {RUNS} SELECT {KEYS}, assembly_ms AS value FROM passed"
ORACLES["run_best_per_algorithm"] = f"WITH {RUNS} SELECT {KEYS}, assembly_ms FROM best"
STAGE_NAMES = [
    "prepare_allocate_ms",
    "prepare_coloring_ms",
    "prepare_owner_partition_ms",
    "assembly_zero_ms",
    "assembly_generate_ms",
    "assembly_numeric_ms",
    "assembly_merge_ms",
    "assembly_sort_ms",
    "assembly_reduce_ms",
]
LONG_STAGES = " UNION ALL ".join(
    f"SELECT case_name, kernel, algorithm, {n} AS stage_no, '{s}' AS stage, {s} AS height FROM best" for n, s in enumerate(STAGE_NAMES)
)
ORACLES["run_stage_breakdown"] = f"""WITH {RUNS}, long AS ({LONG_STAGES}),
kept AS (SELECT * FROM long QUALIFY max(abs(height)) OVER (PARTITION BY case_name, kernel, stage_no) > 1e-8)
SELECT *, coalesce(sum(height) OVER (PARTITION BY case_name, kernel, algorithm ORDER BY stage_no
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS bottom FROM kept"""
ORACLES["run_extra_memory"] = f"WITH {RUNS} SELECT {KEYS}, extra_memory_bytes / 1073741824e0 AS extra_memory_gib FROM best"
THREADS = [1, 2, 4, 8, 14]
ORACLES["run_time_matrix"] = f"""WITH {RUNS}
SELECT case_name, kernel, algorithm,
       {", ".join(f"round(log10(greatest(max(CASE WHEN threads = {t} THEN assembly_ms END), CASE WHEN max(CASE WHEN threads = {t} THEN 1 END) = 1 THEN 1e-9 END)), 9) AS t{t}" for t in THREADS)}
FROM passed GROUP BY case_name, kernel, algorithm"""
ORACLES["run_speedup_matrix"] = f"""WITH {RUNS}
SELECT case_name, kernel, algorithm, {", ".join(f"max(CASE WHEN threads = {t} THEN speedup END) AS t{t}" for t in THREADS)}
FROM passed GROUP BY case_name, kernel, algorithm"""
ORACLES["run_best_table"] = f"""WITH {RUNS}
SELECT {KEYS}, preprocess_ms, assembly_ms, speedup, efficiency * 1e2 AS efficiency_pct,
       extra_memory_bytes / 1073741824e0 AS extra_memory_gib FROM best"""
for _name, _label in (("run_cross_case", "case_name"), ("run_cross_kernel", "kernel")):
    ORACLES[_name] = f"""WITH {RUNS}
SELECT l.label, a.algorithm, coalesce(max(speedup), 0e0) AS best_speedup
FROM (SELECT DISTINCT {_label} AS label FROM runs) l CROSS JOIN (SELECT DISTINCT algorithm FROM passed) a
LEFT JOIN passed p ON p.{_label} = l.label AND p.algorithm = a.algorithm GROUP BY l.label, a.algorithm"""
ORACLES["run_listing"] = f"WITH {RUNS} SELECT {KEYS}, assembly_ms, total_ms, status FROM runs"
ORACLES["run_skipped"] = f"""WITH {RUNS}
SELECT {KEYS}, status, CASE WHEN skip_reason <> '' THEN skip_reason ELSE diagnostics END AS reason FROM runs WHERE status <> 'PASS'"""
ORACLES["run_comparison_gate"] = f"""WITH {RUNS}
SELECT count(DISTINCT case_name) > 1 AS compare_cases, count(DISTINCT kernel) > 1 AS compare_kernels FROM runs"""
ORACLES["run_summary_layout"] = f"""WITH {RUNS}, sets AS (SELECT DISTINCT case_name, kernel FROM passed)
SELECT case_name, kernel, CAST(part AS INTEGER) AS part, '' AS algorithm, 0 AS threads, CAST(0 AS BIGINT) AS at,
       CASE WHEN part = 0 THEN '## ' || case_name || ' | kernel=' || kernel END AS title
FROM sets, range(5) AS r(part)
UNION ALL SELECT case_name, kernel, 5, algorithm, threads, ordinal, NULL FROM runs
UNION ALL SELECT case_name, kernel, 6, algorithm, threads, ordinal, NULL FROM runs WHERE status <> 'PASS'"""
ORACLES["run_json_documents"] = f"""WITH {RUNS}
SELECT case_name, kernel, CAST(count(*) AS INTEGER) AS records, string_agg(algorithm || '@' || threads, ',' ORDER BY ordinal) AS runs
FROM runs GROUP BY case_name, kernel"""
ORACLES["assemble_arrow"] = METHOD_ORACLE
ORACLES["vector_physics_arrow"] = ORACLES["vector_physics"]
ORACLES["vector_physics_prepared"] = ORACLES["vector_physics"]
ORACLES["assemble_prepared"] = METHOD_ORACLE
ORACLES["matrix_row_slice"] = f"""WITH parts AS (SELECT coalesce(max(p_partkey), 0) + 1 AS n FROM part), whole AS ({METHOD_ORACLE})
SELECT whole.* FROM whole, parts WHERE "row" >= n AND "row" < 2 * n"""
