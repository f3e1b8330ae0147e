"""Coordinates of the Piper, Stiff and Durov diagrams."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.constants import IONS, meq
from limnos.functions.expr import null, col_or_null, row_sum, safe_div

HEIGHT = math.sqrt(3.0) / 2.0
ROOT3 = math.sqrt(3.0)

VERTICES = ("pct_cat_left", "pct_cat_right", "pct_cat_apex", "pct_an_left", "pct_an_right", "pct_an_apex")


def normalise(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """Fractions of a three-part total; all NULL when a part is missing or the total is not positive."""
    total = a + b + c
    total = F.when(total > 0, total)
    return a / total, b / total, c / total


def ternary_xy(b: Column, c: Column, origin: float = 0.0) -> tuple[Column, Column]:
    """Cartesian point of normalised fractions (right vertex ``b``, apex ``c``)."""
    return F.lit(origin) + 0.5 * (2.0 * b + c), F.lit(HEIGHT) * c


def _group(df: DataFrame, ions: tuple[str, ...], absent: Column) -> Column:
    """Sum of a group in meq/L; ``absent`` when the frame carries none of its ions."""
    cols = [F.col(meq(i)) for i in ions if meq(i) in df.columns]
    return row_sum(*cols) if cols else absent


def _names(ions: tuple[str, ...]) -> str:
    return " + ".join(IONS[i].label for i in ions)


# --- Piper -------------------------------------------------------------------


@dataclass(frozen=True)
class PiperConvention:
    """Ions at each vertex (left, right, apex) and the rule for the diamond."""

    key: str
    cations: tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]
    anions: tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]
    geometric: bool


# The two vertex conventions.
CONVENTIONS = {
    "classic": PiperConvention(
        "classic", (("Ca",), ("Na", "K"), ("Mg",)), (("HCO3", "CO3"), ("Cl", "F", "NO3"), ("SO4",)), True
    ),
    "notebook": PiperConvention(
        "notebook", (("Ca",), ("Mg",), ("Na", "K")), (("HCO3", "CO3"), ("SO4",), ("Cl", "F", "NO3")), False
    ),
}
# Fixed value: gap between the diagram's triangles.
PIPER_GAP = 0.6


def get_convention(convention: str | PiperConvention = "classic") -> PiperConvention:
    if isinstance(convention, PiperConvention):
        return convention
    if convention not in CONVENTIONS:
        raise KeyError(f"unknown Piper convention {convention!r}; known: {sorted(CONVENTIONS)}")
    return CONVENTIONS[convention]


def vertex_labels(convention: str | PiperConvention = "classic") -> dict[str, str]:
    conv = get_convention(convention)
    return dict(zip(VERTICES, [_names(g) for g in conv.cations + conv.anions]))


def add_piper(df: DataFrame, convention: str | PiperConvention = "classic", gap: float = PIPER_GAP) -> DataFrame:
    """Six coordinates and six vertex fractions per sample.

    A vertex group without any column counts as zero; a missing cell of a
    single-ion group leaves its whole triangle empty.
    """
    conv = get_convention(convention)
    parts = {}
    for side, groups in (("cat", conv.cations), ("an", conv.anions)):
        sums = [_group(df, g, F.lit(0.0)) for g in groups]
        parts |= {f"pct_{side}_{v}": f for v, f in zip(("left", "right", "apex"), normalise(*sums))}
    df = df.withColumns(parts)
    x_cat, y_cat = ternary_xy(F.col("pct_cat_right"), F.col("pct_cat_apex"))
    x_an, y_an = ternary_xy(F.col("pct_an_right"), F.col("pct_an_apex"), 1.0 + gap)
    df = df.withColumns({"x_cat": x_cat, "y_cat": y_cat, "x_an": x_an, "y_an": y_an})
    if conv.geometric:
        x = (F.col("x_cat") + F.col("x_an")) / 2.0 + (F.col("y_an") - F.col("y_cat")) / F.lit(2.0 * ROOT3)
        y = F.col("y_cat") + F.lit(ROOT3) * (F.col("x_diamond") - F.col("x_cat"))
    else:
        u, w = F.col("pct_cat_apex"), F.col("pct_an_apex")
        x = F.lit(1.0 + gap / 2.0) + 0.5 * (u + w - 1.0)
        y = F.lit(HEIGHT * (1.0 + gap)) + F.lit(HEIGHT) * (u - w)
    return df.withColumn("x_diamond", x).withColumn("y_diamond", y)


# --- Stiff -------------------------------------------------------------------


@dataclass(frozen=True)
class StiffTemplate:
    """Rows from top to bottom, each (cation ions, anion ions)."""

    key: str
    rows: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]

    @property
    def columns(self) -> list[str]:
        return [f"row{i}_{side}" for i in range(len(self.rows)) for side in ("left", "right")]


# Row pairings of the two templates.
_CLASSIC_ROWS = ((("Na", "K"), ("Cl",)), (("Ca",), ("HCO3", "CO3")), (("Mg",), ("SO4",)))
TEMPLATES = {
    "standard": StiffTemplate("standard", _CLASSIC_ROWS),
    "extended": StiffTemplate("extended", _CLASSIC_ROWS + (((), ("F", "NO3")),)),
}


def get_template(template: str | StiffTemplate = "standard") -> StiffTemplate:
    if isinstance(template, StiffTemplate):
        return template
    if template not in TEMPLATES:
        raise KeyError(f"unknown Stiff template {template!r}; known: {sorted(TEMPLATES)}")
    return TEMPLATES[template]


def stiff_labels(template: str | StiffTemplate = "standard") -> dict[str, str]:
    tpl = get_template(template)
    return {
        f"row{i}_{side}": _names(ions)
        for i, row in enumerate(tpl.rows)
        for side, ions in zip(("left", "right"), row)
    }


def add_stiff(df: DataFrame, template: str | StiffTemplate = "standard") -> DataFrame:
    """``row<i>_left`` / ``row<i>_right`` in meq/L; an empty side is 0, an unmeasured one NULL."""
    tpl = get_template(template)
    out = {}
    for i, row in enumerate(tpl.rows):
        for side, ions in zip(("left", "right"), row):
            out[f"row{i}_{side}"] = _group(df, ions, null()) if ions else F.lit(0.0)
    return df.withColumns(out)


def stiff_polygon(template: str | StiffTemplate = "standard") -> Column:
    """Closed polygon: cations (negative) bottom-up, anions top-down, back to the start."""
    tpl = get_template(template)
    n = len(tpl.rows)

    def point(i: int, side: str) -> Column:
        value = F.col(f"row{i}_{side}")
        x = -value if side == "left" else value
        return F.struct(x.alias("x"), F.lit(float(n - 1 - i)).alias("y"))

    down = list(range(n))
    path = [point(i, "left") for i in reversed(down)] + [point(i, "right") for i in down]
    return F.array(*path, point(n - 1, "left"))


def widest_side(template: str | StiffTemplate = "standard") -> Column:
    """Largest side of one sample (missing sides are skipped)."""
    return F.greatest(*[F.col(c) for c in get_template(template).columns])


def stiff_axis_limit(
    df: DataFrame, template: str | StiffTemplate = "standard", margin: float = 1.20, minimum: float = 0.5
) -> DataFrame:
    """Shared half-width of the Stiff axis as one row."""
    top = df.agg(F.max(widest_side(template)).alias("top"))
    limit = F.greatest(F.col("top") * margin, F.lit(minimum))
    return top.select(F.coalesce(limit, F.lit(minimum)).alias("axis_limit"))


def stiff_nice_axis(df: DataFrame, template: str | StiffTemplate = "standard") -> DataFrame:
    """Axis half-width rounded up to 1, 2, 2.5, 5 or 10 times a power of ten (with 15 % margin)."""
    top = df.agg(F.coalesce(F.max(widest_side(template)), F.lit(0.0)).alias("top"))
    raw = top.withColumn("raw", F.greatest(F.col("top") * 1.15, F.lit(0.5)))
    raw = raw.withColumn("mag", F.pow(F.lit(10.0), F.floor(F.log10("raw")).cast("double")))
    nice = F.lit(None).cast("double")
    for step in (10.0, 5.0, 2.5, 2.0, 1.0):
        nice = F.when(F.lit(step) * F.col("mag") >= F.col("raw"), F.lit(step) * F.col("mag")).otherwise(nice)
    return raw.select("raw", F.coalesce(nice, F.col("raw")).alias("axis_limit"))


# --- Durov -------------------------------------------------------------------

# Fixed value: side of a panel beside the square.
DUROV_PANEL = 0.55
DUROV_GAP = 0.12


def add_durov(df: DataFrame, side: float = 1.0) -> DataFrame:
    """Square and marginal-triangle positions plus percentages, all prefixed ``durov_``."""
    zero = F.lit(0.0)
    cations = normalise(*[_group(df, g, zero) for g in (("Ca",), ("Na", "K"), ("Mg",))])
    anions = normalise(*[_group(df, g, zero) for g in (("HCO3", "CO3"), ("Cl", "F", "NO3"), ("SO4",))])
    names = ("Ca", "NaK", "Mg", "HCO3", "Cl", "SO4")
    df = df.withColumns({f"__d_{n}": f for n, f in zip(names, cations + anions)})
    nak, mg, cl, so4 = (F.col(f"__d_{n}") for n in ("NaK", "Mg", "Cl", "SO4"))
    df = df.withColumns(
        {
            "durov_y": (nak + 0.5 * mg) * side,
            "durov_x": (cl + 0.5 * so4) * side,
            "durov_cat_x": F.lit(-HEIGHT * side) * mg,
            "durov_cat_y": (nak + 0.5 * mg) * side,
            "durov_an_x": (cl + 0.5 * so4) * side,
            "durov_an_y": F.lit(side) + F.lit(HEIGHT * side) * so4,
        }
        | {f"durov_pct_{n}": F.col(f"__d_{n}") * 100.0 for n in names}
    )
    return df.drop(*[f"__d_{n}" for n in names])


def durov_panels(df: DataFrame, ph: str = "ph", tds: str = "tds_mgl") -> DataFrame:
    """Availability and range of the two side panels, with the reason when one cannot be drawn."""
    rows, aggregates = [], []
    for i, (panel, name) in enumerate((("ph", ph), ("tds", tds))):
        have = name in df.columns
        value = col_or_null(df, name)
        aggregates += [F.count(value).alias(f"n{i}"), F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}")]
        flat = F.col(f"lo{i}") == F.col(f"hi{i}")
        reason = F.lit("column absent") if not have else F.when(F.col(f"n{i}") == 0, "column without values")
        rows.append(
            F.struct(
                F.lit(panel).alias("panel"),
                (F.col(f"n{i}") > 0).alias("available"),
                F.col(f"n{i}").alias("n"),
                F.when(flat, F.col(f"lo{i}") - 0.5).otherwise(F.col(f"lo{i}")).alias("low"),
                F.when(flat, F.col(f"hi{i}") + 0.5).otherwise(F.col(f"hi{i}")).alias("high"),
                reason.alias("reason"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def add_durov_panels(
    df: DataFrame, ph: str = "ph", tds: str = "tds_mgl", side: float = 1.0
) -> DataFrame:
    """Positions in the pH panel (below the square) and the TDS panel (to its right)."""
    ranges = durov_panels(df, ph, tds)

    def scaled(panel: str, name: str) -> Column:
        one = ranges.filter(F.col("panel") == panel)
        low, high = one.select("low").scalar(), one.select("high").scalar()
        return safe_div(col_or_null(df, name) - low, high - low) * DUROV_PANEL

    return df.withColumns(
        {
            "durov_ph_x": F.col("durov_x"),
            "durov_ph_y": F.lit(-DUROV_GAP - DUROV_PANEL) + scaled("ph", ph),
            "durov_tds_x": F.lit(side + DUROV_GAP) + scaled("tds", tds),
            "durov_tds_y": F.col("durov_y"),
        }
    )
