"""Shared steps of the registered queries, as frames and as check SQL.

The SQL half is written in plain DuckDB text, one CTE per step, and does not use
the operators; only fixed values (weights, thresholds) and the sample derivation
are shared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.constants import ALL_IONS, ANIONS, CATIONS, IONS, LOG_KSP, equivalent_weights, meq, mgl
from limnos.functions.cells import apply_cells
from limnos.operators.balance import add_charge_balance, reliability
from limnos.operators.diagrams import add_durov, add_piper, add_stiff
from limnos.operators.facies import add_facies
from limnos.operators.irrigation import add_irrigation
from limnos.operators.positions import add_wgs84
from limnos.operators.saturation import add_saturation
from limnos.operators.standards import add_compliance
from limnos.operators.units import add_alkalinity, add_meq
from limnos.sources.sample_adapter import samples, samples_sql

# --- frames --------------------------------------------------------------------


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf)


def measured(spark: SparkSession, sf: str) -> DataFrame:
    return apply_cells(raw(spark, sf))


def chem(spark: SparkSession, sf: str) -> DataFrame:
    df = measured(spark, sf)
    df = add_meq(df.withColumn("reliable", reliability(df)))
    return add_alkalinity(add_charge_balance(df, reliable=F.col("reliable")))


def fac(spark: SparkSession, sf: str) -> DataFrame:
    return add_facies(chem(spark, sf))


def comp(spark: SparkSession, sf: str) -> DataFrame:
    return add_compliance(fac(spark, sf))


def irr(spark: SparkSession, sf: str) -> DataFrame:
    return add_irrigation(chem(spark, sf))


def sat(spark: SparkSession, sf: str) -> DataFrame:
    return add_saturation(measured(spark, sf))


def piper(spark: SparkSession, sf: str) -> DataFrame:
    return add_piper(chem(spark, sf))


def stiff(spark: SparkSession, sf: str) -> DataFrame:
    return add_stiff(fac(spark, sf))


def durov(spark: SparkSession, sf: str) -> DataFrame:
    return add_durov(chem(spark, sf))


def placed(spark: SparkSession, sf: str) -> DataFrame:
    return add_wgs84(fac(spark, sf), "EPSG:32718")


def full(spark: SparkSession, sf: str) -> DataFrame:
    """Every row-local step on one frame."""
    df = add_wgs84(fac(spark, sf), "EPSG:32718")
    df = add_saturation(add_irrigation(add_compliance(df)))
    return add_durov(add_stiff(add_piper(df)))


# --- check SQL -----------------------------------------------------------------


def psum(*cols: str) -> str:
    """Sum of the present cells, NULL when all are missing."""
    if len(cols) == 1:
        return cols[0]
    added = " + ".join(f"coalesce({c}, 0.0)" for c in cols)
    return f"CASE WHEN coalesce({', '.join(cols)}) IS NOT NULL THEN {added} END"


def _measured_sql() -> str:
    parts = []
    for c in ("F_mgL", "NO3_mgL"):
        t = f"trim({c}, ' ')"
        bare = f"replace(regexp_replace({t}, '^[<>]=?\\s*', ''), ',', '.')"
        parts += [
            f"CASE WHEN regexp_matches({t}, '^[0-9.,]+$') THEN CAST(replace({t}, ',', '.') AS DOUBLE) END AS v_{c}",
            f"CASE WHEN regexp_matches({t}, '^[<>]') THEN CAST({bare} AS DOUBLE) END AS {c}__detection_limit",
            f"CASE WHEN lower({t}) = 'nd' THEN 'nd' WHEN {t} LIKE '<%' THEN '<' WHEN {t} LIKE '>%' THEN '>' END AS q_{c}",
            f"coalesce({t} <> '', false) AS a_{c}",
        ]
    return (
        f"cells AS (SELECT *, {', '.join(parts)} FROM samples),\n"
        "measured AS (SELECT * EXCLUDE (F_mgL, NO3_mgL, v_F_mgL, v_NO3_mgL), v_F_mgL AS F_mgL, v_NO3_mgL AS NO3_mgL FROM cells)"
    )


_MAJORS = ("Ca", "Mg", "Na", "K", "HCO3", "SO4", "Cl")


def _chem_sql(name: str = "chem", source: str = "measured", table: str = "IUPAC2021") -> str:
    weights = equivalent_weights(table)
    items = ", ".join(f"{mgl(i)} / {weights[i]!r}::DOUBLE AS {meq(i)}" for i in ALL_IONS)
    missing = " + ".join(f"CAST({mgl(i)} IS NULL AS INTEGER)" for i in _MAJORS)
    return (
        f"{name}_meq AS (SELECT *, {items}, ({missing}) <= 2 AS reliable FROM {source}),\n"
        f"{name}_sum AS (SELECT *, {psum(*map(meq, CATIONS))} AS sum_cat, {psum(*map(meq, ANIONS))} AS sum_an FROM {name}_meq),\n"
        f"{name}_cbe AS (SELECT *, (sum_cat - sum_an) / nullif(sum_cat + sum_an, 0.0) * 100.0::DOUBLE AS CBE_pct, "
        f"({psum('HCO3_meq', 'CO3_meq')}) * 50.04::DOUBLE AS Alkalinity_mgCaCO3 FROM {name}_sum),\n"
        f"{name} AS (SELECT *, CASE WHEN NOT reliable OR CBE_pct IS NULL THEN 'unknown' WHEN abs(CBE_pct) <= 5 THEN 'acceptable' "
        f"WHEN abs(CBE_pct) <= 10 THEN 'marginal' ELSE 'rejected' END AS CBE_flag FROM {name}_cbe)"
    )


def _facies_sql() -> str:
    cat = {"Ca": "Ca_meq", "Mg": "Mg_meq", "Na": psum("Na_meq", "K_meq")}
    an = {"HCO3": psum("HCO3_meq", "CO3_meq"), "SO4": "SO4_meq", "Cl": psum("Cl_meq", "F_meq", "NO3_meq")}
    sums = ", ".join(f"{e} AS g_{k}" for k, e in (cat | an).items())
    totals = ", ".join(
        f"CASE WHEN {psum(*[f'g_{k}' for k in side])} > 0 THEN {psum(*[f'g_{k}' for k in side])} END AS {alias}"
        for alias, side in (("t_cat", cat), ("t_an", an))
    )
    pcts = ", ".join(
        [f"g_{k} / t_cat * 100.0::DOUBLE AS pct_{k}" for k in cat] + [f"g_{k} / t_an * 100.0::DOUBLE AS pct_{k}" for k in an]
    )

    def ranked(alias: str, names: list[str]) -> str:
        # Shares sorted from large to small, ties by position.
        items = ", ".join(f"{{'s': -pct_{k}, 'o': {i}, 'k': '{k}'}}" for i, k in enumerate(names))
        return f"list_sort(list_filter([{items}], lambda x: x.s IS NOT NULL)) AS {alias}"

    def named(alias: str, top: str) -> str:
        return (
            f"CASE WHEN len({top}) = 0 THEN NULL WHEN -{top}[1].s >= 50 OR len({top}) = 1 THEN {top}[1].k "
            f"ELSE {top}[1].k || '-' || {top}[2].k END AS {alias}"
        )

    def spelled(c: str, words: dict[str, str]) -> str:
        for k, v in words.items():
            c = f"replace({c}, '{k}', '{v}')"
        return c

    noun = spelled("n_an", {"HCO3": "bicarbonatada", "SO4": "sulfatada", "Cl": "clorurada"})
    adj = spelled("n_cat", {"Ca": "calcica", "Mg": "magnesica", "Na": "sodica"})
    return (
        f"f1 AS (SELECT *, {sums} FROM chem),\n"
        f"f2 AS (SELECT *, {totals} FROM f1),\n"
        f"f3 AS (SELECT *, {pcts} FROM f2),\n"
        f"f4 AS (SELECT *, {ranked('r_cat', list(cat))}, {ranked('r_an', list(an))} FROM f3),\n"
        f"f5 AS (SELECT *, {named('n_cat', 'r_cat')}, {named('n_an', 'r_an')} FROM f4),\n"
        "fac AS (SELECT * EXCLUDE (r_cat, r_an), coalesce(n_an || '-' || n_cat, 'sin_datos') AS facies, "
        f"coalesce(upper(substr({noun}, 1, 1)) || substr({noun}, 2) || ' ' || {adj}, 'Sin datos suficientes') AS facies_label FROM f5)"
    )


# Parameter, kind, minimum, maximum of the default standard.
WHO = [
    ("F_mgL", "health", None, 1.5),
    ("NO3_mgL", "health", None, 50),
    ("Cl_mgL", "aesthetic", None, 250),
    ("SO4_mgL", "aesthetic", None, 250),
    ("Na_mgL", "aesthetic", None, 200),
    ("tds_mgl", "aesthetic", None, 1000),
    ("ph", "operational", 6.5, 8.5),
]


def breach(c: str, low, high) -> str:
    tests = [f"{c} > {high}" for _ in (1,) if high is not None] + [f"{c} < {low}" for _ in (1,) if low is not None]
    return f"coalesce({' OR '.join(tests)}, false)"


def _comp_sql(limits=WHO, name: str = "comp", source: str = "fac") -> str:
    flags = ", ".join(f'{breach(p, lo, hi)} AS "{p}__exceeds"' for p, _, lo, hi in limits)
    n_eval = " + ".join(f"CAST({p} IS NOT NULL AS BIGINT)" for p, *_ in limits)
    n_bad = " + ".join(f'CAST("{p}__exceeds" AS BIGINT)' for p, *_ in limits)
    health = " OR ".join(f'"{p}__exceeds"' for p, kind, *_ in limits if kind == "health")
    return (
        f"{name}_f AS (SELECT *, {flags} FROM {source}),\n"
        f"{name} AS (SELECT *, {n_eval} AS n_evaluated, {n_bad} AS n_exceedances, ({health}) AS exceeds_health FROM {name}_f)"
    )


def _irr_sql() -> str:
    return (
        "i1 AS (SELECT *, Na_meq / sqrt(CASE WHEN (Ca_meq + Mg_meq) / 2 > 1e-9 THEN (Ca_meq + Mg_meq) / 2 ELSE 1e-9 END"
        " + CASE WHEN Ca_meq + Mg_meq IS NULL THEN NULL ELSE 0.0 END) AS SAR,\n"
        "  (HCO3_meq + coalesce(CO3_meq, 0.0)) - (Ca_meq + Mg_meq) AS RSC,\n"
        "  CASE WHEN Ca_meq + Mg_meq + Na_meq + coalesce(K_meq, 0.0) > 0 THEN (Na_meq + coalesce(K_meq, 0.0)) / "
        "(Ca_meq + Mg_meq + Na_meq + coalesce(K_meq, 0.0)) * 100.0::DOUBLE END AS Na_pct,\n"
        "  Na_meq / (Ca_meq + Mg_meq) AS Kelley_ratio, Mg_meq / (Ca_meq + Mg_meq) * 100.0::DOUBLE AS Magnesium_ratio FROM chem),\n"
        "i2 AS (SELECT *, CASE WHEN tds_mgl > 10000 OR tds_mgl < 50 THEN tds_mgl ELSE tds_mgl / 0.64::DOUBLE END AS ec FROM i1),\n"
        "irr AS (SELECT *,\n"
        "  CASE WHEN SAR IS NULL THEN 'Desconocido' WHEN SAR < 10 THEN 'S1' WHEN SAR < 18 THEN 'S2' WHEN SAR < 26 THEN 'S3' ELSE 'S4' END AS SAR_class,\n"
        "  CASE WHEN RSC IS NULL THEN 'Desconocido' WHEN RSC < 1.25 THEN 'Seguro' WHEN RSC <= 2.5 THEN 'Marginal' ELSE 'Inadecuado' END AS RSC_class,\n"
        "  CASE WHEN Na_pct IS NULL OR tds_mgl IS NULL THEN 'Desconocido' WHEN Na_pct < 20 AND ec < 250 THEN 'Excelente a Buena'\n"
        "   WHEN Na_pct < 40 AND ec < 750 THEN 'Buena a Permisible' WHEN Na_pct < 60 AND ec < 2000 THEN 'Permisible a Dudosa'\n"
        "   WHEN Na_pct < 80 AND ec < 3000 THEN 'Dudosa a Inadecuada' ELSE 'Inadecuada para riego' END AS Wilcox_class FROM i2)"
    )


def _sat_sql() -> str:
    strength = " + ".join(
        f"CASE WHEN {mgl(i)} > 0 THEN 0.5::DOUBLE * ({mgl(i)} / 1000.0::DOUBLE / {IONS[i].molar_mass!r}::DOUBLE) * {IONS[i].charge ** 2} ELSE 0.0 END"
        for i in ALL_IONS
    )

    def gamma(z2: int) -> str:
        return (
            f"CASE WHEN ionic_strength > 0 THEN pow(10.0::DOUBLE, -0.5092::DOUBLE * {z2} * "
            "(sqrt(ionic_strength) / (1 + sqrt(ionic_strength)) - 0.3::DOUBLE * ionic_strength)) ELSE 1.0 END"
        )

    def mol(i: str) -> str:
        return f"({mgl(i)} / 1000.0::DOUBLE / {IONS[i].molar_mass!r}::DOUBLE)"

    acts = ", ".join(f"{mol(i)} * g{1 if abs(IONS[i].charge) == 1 else 2} AS a_{i}" for i in ("Ca", "SO4", "Na", "Cl", "F"))
    co3 = (
        f"CASE WHEN {mol('CO3')} > 0 THEN {mol('CO3')} * g2 WHEN {mol('HCO3')} > 0 AND ph > 0 THEN "
        f"pow(10.0::DOUBLE, log10(greatest({mol('HCO3')} * g1, 1e-12)) + ph - 10.33::DOUBLE) ELSE 0.0 END AS a_CO3"
    )

    def si(mineral: str, product: str, *acts: str) -> str:
        ok = " AND ".join(f"{a} > 0" for a in acts)
        return (
            f"CASE WHEN ionic_strength > 0 AND {ok} THEN log10({product}) - ({LOG_KSP[mineral]!r}::DOUBLE) END AS SI_{mineral}"
        )

    return (
        f"s1 AS (SELECT *, {strength} AS ionic_strength FROM measured),\n"
        f"s2 AS (SELECT *, {gamma(1)} AS g1, {gamma(4)} AS g2 FROM s1),\n"
        f"s3 AS (SELECT *, {acts}, {co3} FROM s2),\n"
        f"sat AS (SELECT *, {si('Calcite', 'a_Ca * a_CO3', 'a_Ca', 'a_CO3')}, {si('Gypsum', 'a_Ca * a_SO4', 'a_Ca', 'a_SO4')}, "
        f"{si('Fluorite', 'a_Ca * (a_F * a_F)', 'a_Ca', 'a_F')}, {si('Halite', 'a_Na * a_Cl', 'a_Na', 'a_Cl')} FROM s3)"
    )


def _normalised(prefix: str, parts: dict[str, str]) -> tuple[str, str]:
    sums = ", ".join(f"{e} AS {prefix}s_{k}" for k, e in parts.items())
    total = " + ".join(f"{prefix}s_{k}" for k in parts)
    fractions = ", ".join(f"{prefix}s_{k} / CASE WHEN {total} > 0 THEN {total} END AS pct_{prefix}_{k}" for k in parts)
    return sums, fractions


NAK = psum("Na_meq", "K_meq")
HC = psum("HCO3_meq", "CO3_meq")
CLN = psum("Cl_meq", "F_meq", "NO3_meq")
_H = "(sqrt(3.0::DOUBLE) / 2)"


def _piper_sql(classic: bool = True, name: str = "piper", source: str = "chem") -> str:
    if classic:
        cat, an = {"left": "Ca_meq", "right": NAK, "apex": "Mg_meq"}, {"left": HC, "right": CLN, "apex": "SO4_meq"}
        x = "(x_cat + x_an) / 2 + (y_an - y_cat) / (2 * sqrt(3.0::DOUBLE))"
        y = "y_cat + sqrt(3.0::DOUBLE) * (x_diamond - x_cat)"
    else:
        cat, an = {"left": "Ca_meq", "right": "Mg_meq", "apex": NAK}, {"left": HC, "right": "SO4_meq", "apex": CLN}
        x = "1.3::DOUBLE + 0.5::DOUBLE * (pct_cat_apex + pct_an_apex - 1)"
        y = f"{_H} * 1.6::DOUBLE + {_H} * (pct_cat_apex - pct_an_apex)"
    s1, f1 = _normalised("cat", cat)
    s2, f2 = _normalised("an", an)
    return (
        f"{name}_1 AS (SELECT *, {s1}, {s2} FROM {source}),\n"
        f"{name}_2 AS (SELECT *, {f1}, {f2} FROM {name}_1),\n"
        f"{name}_3 AS (SELECT *, 0.5::DOUBLE * (2 * pct_cat_right + pct_cat_apex) AS x_cat, {_H} * pct_cat_apex AS y_cat, "
        f"1.6::DOUBLE + 0.5::DOUBLE * (2 * pct_an_right + pct_an_apex) AS x_an, {_H} * pct_an_apex AS y_an FROM {name}_2),\n"
        f"{name}_4 AS (SELECT *, {x} AS x_diamond FROM {name}_3),\n"
        f"{name} AS (SELECT *, {y} AS y_diamond FROM {name}_4)"
    )


STIFF_ROWS = [(NAK, "Cl_meq"), ("Ca_meq", HC), ("Mg_meq", "SO4_meq")]
STIFF_EXTENDED = STIFF_ROWS + [("CAST(0.0 AS DOUBLE)", psum("F_meq", "NO3_meq"))]


def _stiff_sql(rows=STIFF_ROWS, name: str = "stiff", source: str = "fac") -> str:
    items = ", ".join(f"{a} AS row{i}_left, {b} AS row{i}_right" for i, (a, b) in enumerate(rows))
    return f"{name} AS (SELECT *, {items} FROM {source})"


def _durov_sql() -> str:
    s1, f1 = _normalised("dc", {"Ca": "Ca_meq", "NaK": NAK, "Mg": "Mg_meq"})
    s2, f2 = _normalised("da", {"HCO3": HC, "Cl": CLN, "SO4": "SO4_meq"})
    return (
        f"d1 AS (SELECT *, {s1}, {s2} FROM chem),\nd2 AS (SELECT *, {f1}, {f2} FROM d1),\n"
        "durov AS (SELECT *, pct_dc_NaK + 0.5::DOUBLE * pct_dc_Mg AS durov_y, pct_da_Cl + 0.5::DOUBLE * pct_da_SO4 AS durov_x, "
        f"-{_H} * pct_dc_Mg AS durov_cat_x, pct_dc_NaK + 0.5::DOUBLE * pct_dc_Mg AS durov_cat_y, "
        f"pct_da_Cl + 0.5::DOUBLE * pct_da_SO4 AS durov_an_x, 1 + {_H} * pct_da_SO4 AS durov_an_y, "
        + ", ".join(f"pct_dc_{k} * 100 AS durov_pct_{k}" for k in ("Ca", "NaK", "Mg"))
        + ", "
        + ", ".join(f"pct_da_{k} * 100 AS durov_pct_{k}" for k in ("HCO3", "Cl", "SO4"))
        + " FROM d2)"
    )


def degrees_sql(name: str = "placed", source: str = "fac", east: str = "longitude", north: str = "latitude") -> str:
    """UTM 18S to degrees with the published series, as SQL."""
    e2 = "0.0066943799901413165::DOUBLE"
    ep2 = f"({e2} / (1 - {e2}))"
    e1 = f"((1 - sqrt(1 - {e2})) / (1 + sqrt(1 - {e2})))"
    mu = f"(({north} - 10000000) / 0.9996::DOUBLE) / (6378137 * (1 - {e2} / 4 - 3 * pow({e2}, 2) / 64 - 5 * pow({e2}, 3) / 256))"
    return (
        f"{name}_1 AS (SELECT *, {mu} AS mu FROM {source}),\n"
        f"{name}_2 AS (SELECT *, mu + (3 * {e1} / 2 - 27 * pow({e1}, 3) / 32) * sin(2 * mu) + (21 * pow({e1}, 2) / 16 - 55 * pow({e1}, 4) / 32) * sin(4 * mu) "
        f"+ (151 * pow({e1}, 3) / 96) * sin(6 * mu) + (1097 * pow({e1}, 4) / 512) * sin(8 * mu) AS p1 FROM {name}_1),\n"
        f"{name}_3 AS (SELECT *, {ep2} * pow(cos(p1), 2) AS c1, pow(tan(p1), 2) AS t1, 6378137 / sqrt(1 - {e2} * pow(sin(p1), 2)) AS n1, "
        f"6378137 * (1 - {e2}) / pow(1 - {e2} * pow(sin(p1), 2), 1.5) AS r1 FROM {name}_2),\n"
        f"{name}_4 AS (SELECT *, ({east} - 500000) / (n1 * 0.9996::DOUBLE) AS d FROM {name}_3),\n"
        f"{name} AS (SELECT *, degrees(radians(-75.0::DOUBLE) + (d - (1 + 2 * t1 + c1) * pow(d, 3) / 6 + "
        f"(5 - 2 * c1 + 28 * t1 - 3 * pow(c1, 2) + 8 * {ep2} + 24 * pow(t1, 2)) * pow(d, 5) / 120) / cos(p1)) AS lon_wgs84, "
        f"degrees(p1 - (n1 * tan(p1) / r1) * (pow(d, 2) / 2 - (5 + 3 * t1 + 10 * c1 - 4 * pow(c1, 2) - 9 * {ep2}) * pow(d, 4) / 24 + "
        f"(61 + 90 * t1 + 298 * c1 + 45 * pow(t1, 2) - 252 * {ep2} - 3 * pow(c1, 2)) * pow(d, 6) / 720)) AS lat_wgs84 FROM {name}_4)"
    )


_STEPS = {
    "samples": ((), samples_sql),
    "measured": (("samples",), _measured_sql),
    "chem": (("measured",), _chem_sql),
    "fac": (("chem",), _facies_sql),
    "comp": (("fac",), _comp_sql),
    "irr": (("chem",), _irr_sql),
    "sat": (("measured",), _sat_sql),
    "piper": (("chem",), _piper_sql),
    "stiff": (("fac",), _stiff_sql),
    "durov": (("chem",), _durov_sql),
    "placed": (("fac",), degrees_sql),
}


def ctes(*steps: str) -> list[str]:
    done: dict[str, str] = {}

    def add(step: str) -> None:
        needs, text = _STEPS[step]
        for n in needs:
            add(n)
        done.setdefault(step, text())

    for s in steps:
        add(s)
    return list(done.values())


def sql(body: str, *steps: str, more: tuple[str, ...] | list[str] = ()) -> str:
    """Full check text: the steps it needs, extra CTEs, then the query."""
    return "WITH " + ",\n".join([*ctes(*steps), *more]) + "\n" + body


def r(expr: str, alias: str | None = None, digits: int = 6) -> str:
    """Rounded double for the check text."""
    return f'round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS "{alias or expr}"'


def rs(*cols: str, digits: int = 6) -> str:
    return ", ".join(r(c, digits=digits) for c in cols)
