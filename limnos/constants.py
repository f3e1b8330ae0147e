"""Fixed reference values of water chemistry used by every operator."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Ion:
    key: str
    label: str
    name_es: str
    charge: int
    molar_mass: float  # g/mol


# Ion catalogue (IUPAC 2021 standard atomic weights).
IONS: dict[str, Ion] = {
    "Ca": Ion("Ca", "Ca²⁺", "calcio", 2, 40.078),
    "Mg": Ion("Mg", "Mg²⁺", "magnesio", 2, 24.305),
    "Na": Ion("Na", "Na⁺", "sodio", 1, 22.98976928),
    "K": Ion("K", "K⁺", "potasio", 1, 39.0983),
    "HCO3": Ion("HCO3", "HCO₃⁻", "bicarbonato", -1, 61.016),
    "CO3": Ion("CO3", "CO₃²⁻", "carbonato", -2, 60.008),
    "SO4": Ion("SO4", "SO₄²⁻", "sulfato", -2, 96.056),
    "Cl": Ion("Cl", "Cl⁻", "cloruro", -1, 35.45),
    "F": Ion("F", "F⁻", "fluoruro", -1, 18.998403),
    "NO3": Ion("NO3", "NO₃⁻", "nitrato", -1, 62.004),
}

ALL_IONS = tuple(IONS)
CATIONS = tuple(k for k in IONS if IONS[k].charge > 0)
ANIONS = tuple(k for k in IONS if IONS[k].charge < 0)
# Major ions, field measures.
MAJOR_IONS = ("Ca", "Mg", "Na", "K", "HCO3", "SO4", "Cl")
PHYSCHEM = ("ph", "temp_c", "do_mgl", "tds_mgl", "ec_uscm")

# Equivalent weights (g/eq). The first table follows from the
# catalogue, the second is the one printed in the 2019 USGS Piper/Stiff workbook.
EW_TABLES: dict[str, dict[str, float]] = {
    "IUPAC2021": {k: round(i.molar_mass / abs(i.charge), 6) for k, i in IONS.items()},
    "PiperStiff-v9": {
        "Ca": 20.04,
        "Mg": 12.156,
        "Na": 22.98983,
        "K": 39.102,
        "HCO3": 61.0,
        "CO3": 30.0,
        "SO4": 48.0308,
        "Cl": 35.453,
        "F": 18.9984,
        "NO3": 62.004,
    },
}
DEFAULT_EW_TABLE = "IUPAC2021"

# Thresholds.
CACO3_EQUIVALENT_WEIGHT = 50.04
CBE_ACCEPTABLE_PCT = 5.0
CBE_MARGINAL_PCT = 10.0
MAX_MISSING_MAJOR_IONS = 2
DOMINANCE_THRESHOLD = 50.0
MIN_CAMPAIGNS_FOR_TREND = 8
SUSPICIOUS_ZERO_SHARE = 0.10

# Equilibrium constants at 25 °C (log10 Ksp), Davies A, carbonate pK2.
LOG_KSP = {"Calcite": -8.48, "Gypsum": -4.58, "Fluorite": -10.60, "Halite": 1.57}
DAVIES_A = 0.5092
CARBONATE_PK2 = 10.33

# Plausible range per column (natural continental waters).
PLAUSIBLE_RANGES: dict[str, tuple[float, float]] = {
    "Ca_mgL": (0.0, 2000.0),
    "Mg_mgL": (0.0, 2000.0),
    "Na_mgL": (0.0, 20000.0),
    "K_mgL": (0.0, 1000.0),
    "HCO3_mgL": (0.0, 2000.0),
    "CO3_mgL": (0.0, 1000.0),
    "SO4_mgL": (0.0, 5000.0),
    "Cl_mgL": (0.0, 30000.0),
    "F_mgL": (0.0, 50.0),
    "NO3_mgL": (0.0, 1000.0),
    "ph": (0.0, 14.0),
    "temp_c": (-5.0, 100.0),
    "do_mgl": (0.0, 25.0),
    "tds_mgl": (0.0, 100000.0),
    "ec_uscm": (0.0, 200000.0),
}


def mgl(ion: str) -> str:
    return f"{ion}_mgL"


def meq(ion: str) -> str:
    return f"{ion}_meq"


def mmol(ion: str) -> str:
    return f"{ion}_mmol"


def equivalent_weights(table: str = DEFAULT_EW_TABLE) -> dict[str, float]:
    if table not in EW_TABLES:
        raise KeyError(f"unknown equivalent-weight table {table!r}; known: {sorted(EW_TABLES)}")
    return EW_TABLES[table]
