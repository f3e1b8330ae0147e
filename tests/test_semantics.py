"""Hand-computed waters, null rules, files, streams and plans."""

import math

import pytest
from pyspark.sql import functions as F

from limnos.functions import cells
from limnos.functions.dates import normalise_dates
from limnos.operators import diagrams, facies, imputation, positions, standards, trend, validation
from limnos.operators.balance import add_charge_balance
from limnos.operators.saturation import add_saturation
from limnos.operators.units import add_meq
from limnos.plans import analysis
from limnos.plans import stages as S
from limnos.sources.delimited import read_lab_files
from limnos.sources.mapping import ColumnMapping, normalise_name

TOKENS = {
    "45,0": (45.0, None, None, True),
    "1.234,5": (1234.5, None, None, True),
    "1,234.5": (1234.5, None, None, True),
    "1.2e3": (1200.0, None, None, True),
    " < 0,05 ": (None, 0.05, "<", True),
    "<=2": (None, 2.0, "<=", True),
    ">100": (None, 100.0, ">", True),
    "ND": (None, None, "nd", True),
    "no detectado": (None, None, "nd", True),
    "<LD": (None, None, "nd", True),
    "": (None, None, None, False),
    "s/d": (None, None, None, False),
    "n/a": (None, None, None, False),
    "NaN": (None, None, None, False),
    "Infinity": (None, None, None, False),
    "1,2,3": (None, None, None, False),
    "trace": (None, None, None, False),
    None: (None, None, None, False),
}


def test_cell_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TOKENS)], "i int, c string")
    got = cells.parse_column(df, "c", "cell").orderBy("i").collect()
    assert [tuple(r["cell"]) for r in got] == list(TOKENS.values())


def water(spark, rows, columns="Ca Mg Na K HCO3 CO3 SO4 Cl F NO3".split()):
    schema = "i int, " + ", ".join(f"{c}_meq double" for c in columns)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def test_pure_waters_sit_on_diamond_corners(spark):
    rows = [
        (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0),  # Ca-HCO3: left
        (0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0),  # Na-Cl: right
        (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0),  # Ca-Cl: top
        (0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0),  # Na-HCO3: bottom
    ]
    h = math.sqrt(3) / 2
    cx, cy = 1.3, h * 1.6
    want = [(cx - 0.5, cy), (cx + 0.5, cy), (cx, cy + h), (cx, cy - h)]
    for convention in ("classic", "notebook"):
        got = diagrams.add_piper(water(spark, rows), convention).orderBy("i").collect()
        for r, (x, y) in zip(got, want):
            if convention == "classic":
                assert (r["x_diamond"], r["y_diamond"]) == pytest.approx((x, y), abs=1e-12)


def test_facies_present_while_piper_is_missing(spark):
    df = water(spark, [(3.0, None, 1.0, None, 2.0, None, 1.0, 1.0, None, None)])
    r = diagrams.add_piper(facies.add_facies(df)).first()
    assert r["facies"] == "HCO3-Ca" and r["facies_label"] == "Bicarbonatada calcica"
    assert r["x_cat"] is None and r["x_an"] is not None


def test_tie_and_compound_names(spark):
    rows = [
        (1.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0),
        (4.0, 3.5, 2.5, 0.0, 4.0, 0.0, 3.0, 3.0, 0.0, 0.0),
        (None,) * 10,
    ]
    got = [r["facies"] for r in facies.add_facies(water(spark, rows)).orderBy("i").collect()]
    assert got == ["HCO3-Ca", "HCO3-SO4-Ca-Mg", "sin_datos"]
    label = facies.add_facies(water(spark, rows)).orderBy("i").collect()[1]["facies_label"]
    assert label == "Bicarbonatada-sulfatada calcica-magnesica"


def test_absent_columns(spark):
    df = water(spark, [(2.0, 1.0)], ["Ca", "Na"])
    r = diagrams.add_stiff(diagrams.add_piper(df), "extended").first()
    assert r["pct_cat_left"] == pytest.approx(2 / 3) and r["pct_cat_apex"] == 0.0
    assert r["row2_left"] is None and r["row3_left"] == 0.0 and r["row3_right"] is None


def test_missing_is_never_an_exceedance(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 2.0), (4, 1.5)], "i int, F_mgL double")
    flags = standards.add_compliance(cells.apply_cells(df)).orderBy("i").collect()
    assert [r["F_mgL__exceeds"] for r in flags] == [False, False, True, False]
    assert [r["n_evaluated"] for r in flags] == [0, 0, 1, 1]


def test_unreliable_rows_are_unknown(spark):
    df = spark.createDataFrame([(20.04, 35.45), (20.04, 50.0), (None, None)], "Ca_mgL double, Cl_mgL double")
    out = add_charge_balance(add_meq(df), reliable=F.col("Cl_mgL") < 40).collect()
    assert [r["CBE_flag"] for r in out] == ["acceptable", "unknown", "unknown"]


def test_saturation_by_hand(spark):
    df = spark.createDataFrame([(80.0, 200.0, 7.5), (80.0, None, 7.5)], "Ca_mgL double, HCO3_mgL double, ph double")
    a, b = add_saturation(df).collect()
    ca, h = 80 / 1000 / 40.078, 200 / 1000 / 61.016
    i = 0.5 * (4 * ca + h)
    g = lambda z: 10 ** (-0.5092 * z * z * (math.sqrt(i) / (1 + math.sqrt(i)) - 0.3 * i))
    co3 = 10 ** (math.log10(h * g(1)) + 7.5 - 10.33)
    assert a["SI_Calcite"] == pytest.approx(math.log10(ca * g(2) * co3) + 8.48)
    assert b["SI_Calcite"] is None and a["SI_Gypsum"] is None


def test_utm_round_trip(spark):
    rows = [(-76.96, -12.21, "18S"), (-70.2, -15.8, "19S"), (-116.4, 36.5, "11N"), (2.35, 48.85, "31N"), (-75.0, 4.6, "18N")]
    for lon, lat, zone in rows:
        df = spark.createDataFrame([(lon, lat)], "lon_wgs84 double, lat_wgs84 double")
        crs = positions.parse_crs(f"UTM {zone}")
        there = positions.add_utm(df, crs)
        back = positions.add_degrees(there, crs, "utm_e", "utm_n", "lon2", "lat2").first()
        assert abs(back["lon2"] - lon) * 111e3 < 1e-3 and abs(back["lat2"] - lat) * 111e3 < 1e-3
    assert positions.parse_crs("32718") == positions.parse_crs("EPSG:32718") == positions.utm(18, "S")
    with pytest.raises(ValueError):
        positions.parse_crs("EPSG:3857")


def test_trend_statuses(spark):
    rows = []
    for name, values in {"flat": [5.0] * 9, "rising": range(9), "short": [1.0, 2.0, 3.0], "noisy": [3, 1, 4, 1, 5, 9, 2, 6]}.items():
        rows += [(name, f"20{10 + i}-01-15", float(v), i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "station_code string, d string, tds_mgl double, sample_seq int")
    df = df.withColumn("sampled_at", F.to_date("d"))
    got = {r["station_code"]: r for r in trend.trend_summary(df, ["tds_mgl"]).collect()}
    assert {k: v["status"] for k, v in got.items()} == {
        "flat": "flat", "rising": "increasing", "short": "insufficient", "noisy": "no_trend"}
    assert got["rising"]["s"] == 36 and got["flat"]["p_value"] == 1.0 and got["short"]["s"] is None
    assert got["rising"]["sen_slope_year"] == pytest.approx(1.0, abs=2e-3)


def test_dates_iso_or_day_first(spark):
    iso = spark.createDataFrame([("2024-03-18",), ("18/03/2024",)], "sampled_at string")
    assert [str(r[0])[:10] for r in normalise_dates(iso).collect()] == ["2024-03-18", "None"]
    local = spark.createDataFrame([("18/03/2024",), ("3/4/2024",), ("soon",)], "sampled_at string")
    assert [str(r[0])[:10] for r in normalise_dates(local).collect()] == ["2024-03-18", "2024-04-03", "None"]


def test_custom_standard_is_checked(spark):
    good = standards.custom_standard("mine", [{"parameter": "ph", "minimum": 6, "maximum": 9}])
    assert spark.range(1).select(standards.limit_text(good.limits[0])).first()[0] == "6 – 9 mg/L" and not good.verified
    for bad in ([], [{"parameter": "ph"}], [{"parameter": "ph", "maximum": 15}], [{"parameter": "x", "maximum": 1}],
                [{"parameter": "F_mgL", "minimum": 3, "maximum": 1}], [{"parameter": "F_mgL", "maximum": -1}]):
        with pytest.raises(ValueError):
            standards.custom_standard("mine", bad)


def test_half_limit_skips_unmeasured_columns(spark):
    df = spark.createDataFrame([("<0,05", "<1"), ("0,4", "ND")], "F_mgL string, NO3_mgL string")
    out = imputation.impute(cells.apply_cells(df), method="half_detection_limit").collect()
    assert [r["F_mgL"] for r in out] == [0.025, 0.4] and [r["NO3_mgL"] for r in out] == [None, None]


def test_header_names():
    assert normalise_name("Ca²⁺ (mg/L)") == "ca" and normalise_name("HCO₃⁻") == "hco3"
    assert ColumnMapping.of_headers(["Estación", "Calcio", "Ca", "pH campo"]).mapping == {
        "station_code": "Estación", "Ca_mgL": "Calcio", "ph": "pH campo"}


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Site,Ca,Mg\ncode,Calcium (mg/L),text\nA1,10,2\nA2,11,3\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("report\n\nEstación;Calcio;Magnesio;Calcio\nB1;1,5;<0,1;9\n;;;\nB2;2,5;ND;9\n", encoding="latin-1")
    (tmp_path / "c.tsv").write_text('Station\tCa\n"C ""1"""\t7\n', encoding="utf-8")
    rows = read_lab_files(spark, str(tmp_path)).select("station_code", "Ca_mgL", "Mg_mgL").collect()
    assert sorted(map(tuple, rows)) == [
        ("A1", "10", "2"), ("A2", "11", "3"), ("B1", "1,5", "<0,1"), ("B2", "2,5", "ND"), ('C "1"', "7", None)]


def test_run_saved_and_other_limits(spark, sf, tmp_path):
    ds = analysis.analyse(S.raw(spark, sf), analysis.AnalysisOptions(crs="EPSG:32718", zeros_as_missing_for=None))
    assert ds.options.zeros_as_missing_for == ("F",)
    assert ds.samples.filter("F_mgL = 0").isEmpty()
    other = analysis.with_standard(ds, "peru_drinking_template")
    assert "estandar_sin_cotejar" in [r["code"] for r in other.issues.select("code").distinct().collect()]
    path = str(tmp_path / "run")
    analysis.save_run(ds, path)
    assert analysis.load_run(spark, path).options == ds.options
    with pytest.raises(ValueError):
        analysis.AnalysisOptions(imputation="guess")


def test_errors_stop_the_run(spark):
    df = spark.createDataFrame([(1, "A", -3.0)], "sample_seq long, station_code string, Ca_mgL double")
    ds = analysis.analyse(df)
    assert ds.samples is None and validation.has_errors(ds.issues)


def test_stream_scores_like_batch(spark, sf, tmp_path):
    from limnos.streaming.scoring import score, score_folder

    raw = S.raw(spark, sf)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    raw.repartition(3).write.parquet(source)
    options = analysis.AnalysisOptions(crs="EPSG:32718")
    score_folder(spark, source, raw.schema, target, str(tmp_path / "ck"), options).awaitTermination()
    cols = ["sample_seq", "facies", "CBE_flag", "n_exceedances", "Wilcox_class"]
    a = spark.read.parquet(target).select(cols)
    b = score(raw, options).select(cols)
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_plans(spark, sf):
    plan = analysis.chemistry(S.measured(spark, sf), analysis.AnalysisOptions(crs="EPSG:32718"))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    lean = S.raw(spark, sf).select("station_code", "Ca_mgL")._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in lean and "l_tax" not in lean
    profile = validation.profile(S.raw(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert profile.count("l_orderkey#") > 0 and profile.count("Relation [l_orderkey") == 1


def test_quoted_breaks_bars_suffixes_and_late_descriptions(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Site,Ca,Mg\n"A\n1",10,2\n"B ""x""\n\n2",11,3\nC,12,4\n', encoding="utf-8")
    (tmp_path / "b.txt").write_text("Site|Ca|Mg\nD|13|5\n", encoding="utf-8")
    (tmp_path / "c.pdf").write_text("Site,Ca,Mg\nno,1,1\n", encoding="utf-8")
    (tmp_path / "d.csv").write_text("x\n" * 25 + "Site;Ca;Mg\n" + "\n" * 20 + "code;Calcium;text\nE;14;6\n", encoding="utf-8")
    (tmp_path / "e.csv").write_text("nothing\nknown here\n", encoding="utf-8")
    rows = read_lab_files(spark, str(tmp_path)).filter("station_code is not null").select("station_code", "Ca_mgL", "Mg_mgL").collect()
    assert sorted(map(tuple, rows)) == [("A\n1", "10", "2"), ('B "x"\n\n2', "11", "3"), ("C", "12", "4"), ("D", "13", "5"), ("E", "14", "6")]
    from limnos.sources.delimited import unreadable_files

    assert [r["file"].rsplit("/", 1)[-1] for r in unreadable_files(spark, str(tmp_path)).collect()] == ["e.csv"]


def test_two_sided_p_against_the_error_function(spark):
    import math

    from limnos.operators.trend import two_sided_p_sql

    zs = [i / 16 for i in range(-160, 161)] + [4.2426, 4.2427, 12.0, 20.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").selectExpr("z", two_sided_p_sql("z") + " AS p").collect()
    assert all(math.isclose(r["p"], math.erfc(abs(r["z"]) / math.sqrt(2)), rel_tol=1e-9, abs_tol=1e-15) for r in got)


def test_files_give_a_sample_key(spark, tmp_path):
    from limnos.plans.analysis import canonical_table

    (tmp_path / "a.csv").write_text("Site,Ca,Mg,pH\nA,10,2,7\nB,11,3,7\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("Site,Ca,Mg,pH\nA,10,2,7\n", encoding="utf-8")
    rows = canonical_table(read_lab_files(spark, str(tmp_path))).collect()
    assert len({r["sample_seq"] for r in rows}) == 3 and len({r["file"] for r in rows}) == 2
