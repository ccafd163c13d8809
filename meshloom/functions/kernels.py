"""Element kernels as SQL expressions.

A kernel works in three steps, all inside whole-stage codegen:

``prepare``   adds per-element state columns (volume, gradients, scale ...)
``localise``  runs after the element's node pairs were exploded and picks the state
              that belongs to local nodes ``a`` and ``b``
``entry``     the (i, j) entry of the 3x3 block of that pair

Splitting the steps keeps every generated expression small; one nested expression for
a whole element matrix exceeds the compiler's method limits and runs many times slower.
The expressions are SQL text because a plan of this width is built much faster from a
few strings than from hundreds of Column calls.

All kernels are symmetric: block(b, a) is the transpose of block(a, b).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.model import MIN_PIVOT, MIN_VOLUME, POISSON_RATIO, YOUNG_MODULUS

AXES = "xyz"


@dataclass(frozen=True)
class ElementKernel:
    """An element kernel; ``slots`` are the corners whose coordinates it reads."""

    name: str
    slots: tuple[int, ...]
    state: tuple[str, ...]
    prepare: Callable[[DataFrame], DataFrame]
    localise: Callable[[DataFrame], DataFrame]
    entry: Callable[[int, int], str]


def _same(df: DataFrame) -> DataFrame:
    return df


# Reducing the id before the product keeps it small; the remainder is unchanged.
SIMPLIFIED_SCALE = "1.0D + ((elem_id % 97) * 17 % 97) * 1.0E-4D"


def _simplified_entry(i: int, j: int) -> str:
    off_diagonal = f"0.02D * scale / (1 + abs((a - b) * 3 + {i - j}))"
    if i != j:
        return off_diagonal
    return f"if(a = b, 2.0D * scale + {0.01 * i!r}D, {off_diagonal})"


def simplified() -> ElementKernel:
    """The synthetic kernel: depends on the element id and local positions only."""
    return ElementKernel(
        name="simplified",
        slots=(),
        state=("scale",),
        prepare=lambda df: df.selectExpr("*", f"{SIMPLIFIED_SCALE} AS scale"),
        localise=_same,
        entry=_simplified_entry,
    )


def edge_vectors(df: DataFrame) -> DataFrame:
    """Edges e1, e2, e3 from corner 0 to corners 1, 2, 3."""
    return df.selectExpr("*", *[f"{c}{s} - {c}0 AS e{s}{c}" for s in (1, 2, 3) for c in AXES])


def _cross(out: int, p: int, q: int) -> list[str]:
    """The cross product of edges p and q as columns c{out}x, c{out}y, c{out}z."""
    turned = {c: (AXES[(n + 1) % 3], AXES[(n + 2) % 3]) for n, c in enumerate(AXES)}
    return [f"e{p}{u} * e{q}{v} - e{p}{v} * e{q}{u} AS c{out}{c}" for c, (u, v) in turned.items()]


def tet_determinant(df: DataFrame) -> DataFrame:
    """Cross products c1 = e2 x e3, c2 = e3 x e1, c3 = e1 x e2, their ``det``, ``volume`` and ``pivot``."""
    df = df.selectExpr("*", *_cross(1, 2, 3), *_cross(2, 3, 1), *_cross(3, 1, 2))
    df = df.selectExpr("*", "e1x * c1x + e1y * c1y + e1z * c1z AS det")
    return smallest_pivot(df.selectExpr("*", "abs(det) / 6.0D AS volume"))


def smallest_pivot(df: DataFrame) -> DataFrame:
    """``pivot``: the smallest pivot of the system [1 x y z] over the corners, by partial pivoting.

    Its first column is all ones: that step's pivot is one, is not counted, and leaves the three edges. A step takes the row
    with the largest leading number, the earlier one of equals, in exchange for the row in its
    place. A column of zeros gives the pivot 0.
    """
    df = df.selectExpr("*", "if(abs(e1x) >= abs(e2x) AND abs(e1x) >= abs(e3x), 1, if(abs(e2x) >= abs(e3x), 2, 3)) AS lead")
    taken = {"p": "123", "q": "212", "r": "331"}
    df = df.selectExpr(
        "*", *[f"CASE lead WHEN 1 THEN e{one}{c} WHEN 2 THEN e{two}{c} ELSE e{three}{c} END AS {row}{c}" for row, (one, two, three) in taken.items() for c in AXES]
    )
    df = df.selectExpr("*", *[f"if(px <> 0, p{c} / px, NULL) AS ratio_{c}" for c in "yz"])
    df = df.selectExpr("*", *[f"{row}{c} - {row}x * ratio_{c} AS {row}{c}_left" for row in "qr" for c in "yz"])
    swapped = "abs(ry_left) > abs(qy_left)"
    df = df.selectExpr("*", *[f"if({swapped}, r{c}_left, q{c}_left) AS upper_{c}" for c in "yz"], *[f"if({swapped}, q{c}_left, r{c}_left) AS lower_{c}" for c in "yz"])
    df = df.selectExpr("*", "if(upper_y <> 0, lower_z - lower_y * (upper_z / upper_y), NULL) AS last_pivot")
    # What a pivot of 0 leaves undefined is null, and least() passes over nulls.
    return df.selectExpr("*", "least(abs(px), abs(upper_y), abs(last_pivot)) AS pivot")


def shape_gradients(df: DataFrame) -> DataFrame:
    """Gradients g0..g3 of the linear shape functions; needs ``tet_determinant``."""
    df = df.selectExpr("*", *[f"if(det <> 0, c{s}{c} / det, NULL) AS g{s}{c}" for s in (1, 2, 3) for c in AXES])
    return df.selectExpr("*", *[f"-(g1{c} + g2{c} + g3{c}) AS g0{c}" for c in AXES])


# Two corners in one place make the element singular, although rounding can leave a tiny
# volume. NaN compares greater than every number in Spark, so it is tested by name.
TWIN_CORNERS = " OR ".join(
    f"(x{s} = x{t} AND y{s} = y{t} AND z{s} = z{t})" for s in range(4) for t in range(s + 1, 4)
)
FALLS_BACK = (
    f"size(nodes) <> 4 OR coalesce(isnan(volume) OR NOT volume > {MIN_VOLUME!r}D OR pivot < {MIN_PIVOT!r}D OR {TWIN_CORNERS}, true)"
)


def falls_back() -> Column:
    """True where the physics kernel does not apply: not a tet4, flat, or singular."""
    return F.expr(FALLS_BACK)


def lame_constants(young: float, poisson: float) -> tuple[float, float]:
    lam = young * poisson / ((1.0 + poisson) * (1.0 - 2.0 * poisson))
    return lam, young / (2.0 * (1.0 + poisson))


def physics_tet4(young: float = YOUNG_MODULUS, poisson: float = POISSON_RATIO) -> ElementKernel:
    """Linear elasticity on tet4; anything else falls back to the simplified kernel.

    For an isotropic material the block of nodes a, b is
    ``V * (lam * ga gb' + mu * gb ga' + mu * (ga . gb) * I)``.
    """
    lam, mu = lame_constants(young, poisson)

    def prepare(df: DataFrame) -> DataFrame:
        df = shape_gradients(tet_determinant(edge_vectors(df)))
        df = df.selectExpr("*", f"{FALLS_BACK} AS fallback", f"{SIMPLIFIED_SCALE} AS scale")
        gradients = ", ".join(f"g{s}{c}" for s in range(4) for c in AXES)
        # An element that falls back has no gradients; a null array keeps the row narrow.
        return df.selectExpr("*", f"if(fallback, NULL, array({gradients})) AS grad")

    def localise(df: DataFrame) -> DataFrame:
        at = [f"if(fallback, NULL, grad[{slot} * 3 + {c}]) AS {out}{c}" for out, slot in ("ua", "vb") for c in range(3)]
        return df.selectExpr("*", *at).selectExpr("*", f"{mu!r}D * (u0 * v0 + u1 * v1 + u2 * v2) AS shear")

    def entry(i: int, j: int) -> str:
        value = f"{lam!r}D * (u{i} * v{j}) + {mu!r}D * (u{j} * v{i})"
        if i == j:
            value += " + shear"
        return f"if(fallback, {_simplified_entry(i, j)}, volume * ({value}))"

    return ElementKernel(
        name="physics_tet4",
        slots=(0, 1, 2, 3),
        state=("fallback", "scale", "volume", "grad"),
        prepare=prepare,
        localise=localise,
        entry=entry,
    )


def coupling_stiffness(df: DataFrame) -> DataFrame:
    """``stiffness`` = 1 / clamped volume: tet4 by determinant, hex8 by its axis edges."""
    df = tet_determinant(edge_vectors(df))
    df = df.selectExpr("*", "if(size(nodes) = 4, volume, (x1 - x0) * (y3 - y0) * (z4 - z0)) AS measure")
    # The clamp takes the number when the other side is NaN; greatest() would keep the NaN.
    df = df.selectExpr("*", "if(isnan(measure), 1.0E-10D, greatest(measure, 1.0E-10D)) AS clamped_volume")
    return df.selectExpr("*", "1.0D / clamped_volume AS stiffness")


def coupling() -> ElementKernel:
    """Volume-scaled coupling of equal directions: strong diagonal, weak node pairs."""

    def prepare(df: DataFrame) -> DataFrame:
        return coupling_stiffness(df).selectExpr("*", "stiffness * if(size(nodes) = 4, 4.0D, 8.0D) AS diagonal")

    def entry(i: int, j: int) -> str:
        return "0.0D" if i != j else "if(a = b, diagonal, -stiffness * 0.5D)"

    return ElementKernel(
        name="coupling",
        slots=(0, 1, 2, 3, 4),
        state=("stiffness", "diagonal"),
        prepare=prepare,
        localise=_same,
        entry=entry,
    )


def kernel_by_name(name: str, young: float = YOUNG_MODULUS, poisson: float = POISSON_RATIO) -> ElementKernel:
    """The kernel for a spelling of its name."""
    from meshloom.functions.names import KERNEL_ALIASES

    if name == "coupling":
        return coupling()
    for canonical, aliases in KERNEL_ALIASES.items():
        if name.lower() in aliases:
            return simplified() if canonical == "simplified" else physics_tet4(young, poisson)
    raise ValueError(f"unsupported kernel type: {name}")
