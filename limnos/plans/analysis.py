"""From a canonical table to an analysed one, and back from storage."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.constants import ALL_IONS, CBE_ACCEPTABLE_PCT, CBE_MARGINAL_PCT, DEFAULT_EW_TABLE, equivalent_weights, mgl
from limnos.functions.cells import apply_cells, censoring_summary
from limnos.functions.dates import normalise_dates
from limnos.operators import validation
from limnos.operators.balance import add_charge_balance, reliability
from limnos.operators.diagrams import add_durov, add_piper, add_stiff, get_convention, get_template
from limnos.operators.facies import SCHEMES, add_facies
from limnos.operators.imputation import METHODS, impute, imputation_log, ion_columns, zeros_as_missing
from limnos.operators.irrigation import add_irrigation
from limnos.operators.positions import add_wgs84, parse_crs
from limnos.operators.saturation import add_saturation
from limnos.operators.standards import DEFAULT_STANDARD, Standard, add_compliance, custom_standard, get_standard
from limnos.operators.units import add_alkalinity, add_meq
from limnos.sources.mapping import ColumnMapping


@dataclass(frozen=True)
class AnalysisOptions:
    """Every choice of a run; the defaults neither impute nor touch zeros.

    ``zeros_as_missing_for`` None applies the automatic zero policy.
    """

    ew_table: str = DEFAULT_EW_TABLE
    piper_convention: str = "classic"
    stiff_template: str = "standard"
    imputation: str = "none"
    min_group_size: int = 3
    zeros_as_missing_for: tuple[str, ...] | None = ()
    cbe_acceptable_pct: float = CBE_ACCEPTABLE_PCT
    cbe_marginal_pct: float = CBE_MARGINAL_PCT
    facies_scheme: str = "dominant"
    standard: str | Standard | None = DEFAULT_STANDARD
    crs: str | None = None

    def __post_init__(self) -> None:
        equivalent_weights(self.ew_table)
        get_convention(self.piper_convention)
        get_template(self.stiff_template)
        if self.imputation not in METHODS:
            raise ValueError(f"unknown imputation method {self.imputation!r}")
        if self.facies_scheme not in SCHEMES:
            raise ValueError(f"unknown facies scheme {self.facies_scheme!r}")
        if self.min_group_size < 1 or not 0 < self.cbe_acceptable_pct <= self.cbe_marginal_pct:
            raise ValueError("group size and balance thresholds must be positive and ordered")
        unknown = set(self.zeros_as_missing_for or ()) - set(ALL_IONS)
        if unknown:
            raise ValueError(f"unknown ions {sorted(unknown)}")
        if self.standard is not None:
            get_standard(self.standard)
        if self.crs is not None:
            parse_crs(self.crs)

    def to_dict(self) -> dict:
        out = dataclasses.asdict(self)
        if isinstance(self.standard, Standard):
            out["standard"] = self.standard.to_dict()
        return out

    @classmethod
    def from_dict(cls, record: dict) -> AnalysisOptions:
        """Validated options from a plain record; unknown keys are refused."""
        names = {f.name for f in dataclasses.fields(cls)}
        if set(record) - names:
            raise ValueError(f"unknown options {sorted(set(record) - names)}")
        record = dict(record)
        if isinstance(record.get("standard"), dict):
            record["standard"] = custom_standard(record["standard"]["name"], list(record["standard"]["limits"]))
        if record.get("zeros_as_missing_for") is not None:
            record["zeros_as_missing_for"] = tuple(record["zeros_as_missing_for"])
        return cls(**record)


@dataclass
class Dataset:
    """Tables of one run. ``samples`` is None when errors stopped it."""

    canonical: DataFrame
    issues: DataFrame
    censoring: DataFrame
    options: AnalysisOptions
    samples: DataFrame | None = None
    imputation: DataFrame | None = None


def automatic_zero_ions(df: DataFrame) -> list[str]:
    """Ions whose exact zeros reach the suspicious share; one aggregate, at most ten rows back."""
    found = validation.validate(df, ["zeros"]).filter("code = 'ceros_sospechosos'").select("field")
    return [row["field"].removesuffix("_mgL") for row in found.collect()]


def canonical_table(df: DataFrame, mapping: ColumnMapping | None = None) -> DataFrame:
    """Mapped, dated and split cells, with a sample key: the table's own, or one made of file and row."""
    mapping = mapping or ColumnMapping.of_headers(df.columns)
    if "sample_seq" not in df.columns and {"file", "row"} <= set(df.columns):
        df = df.withColumn("sample_seq", F.xxhash64("file", "row"))
    if mapping.mapping:
        key = [F.col(c) for c in ("sample_seq", "file") if c in df.columns and c not in mapping.mapping]
        df = df.select(*key, *[F.col(f"`{s}`").alias(k) for k, s in mapping.mapping.items() if s in df.columns])
    df = apply_cells(normalise_dates(df))
    numeric = {c: F.col(c).try_cast("double") for c in ("longitude", "latitude", "elevation") if c in df.columns}
    return df.withColumns(numeric) if numeric else df


def chemistry(df: DataFrame, options: AnalysisOptions) -> DataFrame:
    """Row-local stages after imputation; accepts a streaming frame when ``crs`` is declared."""
    df = add_meq(df, ew_table=options.ew_table)
    reliable = F.col("reliable") if "reliable" in df.columns else None
    df = add_charge_balance(df, options.cbe_acceptable_pct, options.cbe_marginal_pct, reliable)
    if "HCO3_meq" in df.columns:
        df = add_alkalinity(df)
    df = add_facies(df, options.facies_scheme)
    df = add_wgs84(df, options.crs)
    if options.standard is not None:
        df = add_compliance(df, options.standard)
    df = add_saturation(add_irrigation(df))
    return add_durov(add_stiff(add_piper(df, options.piper_convention), options.stiff_template))


def analyse(
    source: DataFrame,
    options: AnalysisOptions | None = None,
    mapping: ColumnMapping | None = None,
) -> Dataset:
    """Dates, cells, zero policy, rules, imputation, chemistry, limits, indices, diagrams.

    Errors end the run after the rules, before any chemistry.
    """
    options = options or AnalysisOptions()
    mapping = mapping or ColumnMapping.of_headers(source.columns)
    mapped = mapping.apply(source) if mapping.mapping else source
    censoring = censoring_summary(mapped)
    canonical = canonical_table(source, mapping)
    if options.zeros_as_missing_for is None:
        options = replace(options, zeros_as_missing_for=tuple(automatic_zero_ions(canonical)))
    zero_columns = [mgl(i) for i in options.zeros_as_missing_for]
    work = zeros_as_missing(canonical, zero_columns)
    issues = validation.validate(work).unionByName(validation.rows_read(work))
    if validation.has_errors(issues):
        return Dataset(canonical, issues, censoring, options)
    ions = ion_columns(work)
    group = "group" if "group" in work.columns else None
    filled = impute(
        work.withColumn("reliable", reliability(work)), ions, options.imputation, group, options.min_group_size
    )
    samples = chemistry(filled, options)
    issues = issues.unionByName(
        validation.balance_issues(samples, options.cbe_acceptable_pct, options.cbe_marginal_pct)
    ).unionByName(validation.crs_issues(samples, options.crs))
    if options.standard is not None:
        issues = issues.unionByName(validation.compliance_issues(samples, options.standard))
    return Dataset(canonical, issues, censoring, options, samples, imputation_log(filled, ions, options.imputation))


_STANDARD_CODES = ("excede_umbral", "estandar_sin_cotejar")


def with_standard(ds: Dataset, standard: str | Standard) -> Dataset:
    """The same run against other limits: flags and limit issues only, chemistry untouched."""
    standard = get_standard(standard)
    if ds.samples is None:
        raise ValueError("the run stopped on errors")
    issues = ds.issues.filter(~F.col("code").isin(*_STANDARD_CODES))
    return replace(
        ds,
        samples=add_compliance(ds.samples, standard),
        issues=issues.unionByName(validation.compliance_issues(ds.samples, standard)),
        options=replace(ds.options, standard=standard),
    )


def save_run(ds: Dataset, path: str) -> None:
    """Canonical table and options; results are recomputed when the run is opened."""
    ds.canonical.write.mode("errorifexists").parquet(f"{path}/canonical")
    record = json.dumps(ds.options.to_dict(), ensure_ascii=False)
    spark = ds.canonical.sparkSession
    spark.createDataFrame([(record,)], "value string").coalesce(1).write.text(f"{path}/options")


def load_run(spark, path: str) -> Dataset:
    record = json.loads(spark.read.text(f"{path}/options").first()["value"])
    canonical = spark.read.parquet(f"{path}/canonical")
    return analyse(canonical, AnalysisOptions.from_dict(record))
