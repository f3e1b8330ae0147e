"""Registered queries: file layouts, generators, exports, neighbours, components."""

from __future__ import annotations

import functools
import statistics

from pyspark.sql import functions as F

from limnos.constants import ALL_IONS, equivalent_weights, meq, mgl
from limnos.functions import cells
from limnos.operators import multivariate, neighbours
from limnos.operators.balance import add_charge_balance
from limnos.operators.units import add_meq
from limnos.plans import analysis
from limnos.plans import stages as S
from limnos.plans.registry import query, shown
from limnos.plans.stages import r, rs, sql
from limnos.session import scratch_path
from limnos.sinks import cards, writers
from limnos.sources import headers, mapping, synthetic
from limnos.sources.delimited import read_lab_files, read_lines
from limnos.sources.workbook import book_cells, canonical_cells, workbooks

SEQ = "sample_seq"
IONS = [mgl(i) for i in ALL_IONS]


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


# --- laboratory files derived from the samples -----------------------------------
# One real file per group; the separator depends on the length of its name. Two title
# lines, the header, a description line, then one record per sample, whose first cell is
# plain, has a quote inside, or is quoted round a separator, quotes or a line break.

_HEADER = ["Estación", "Grupo", "Fecha", "Calcio (mg/L)", "Cl⁻", "Fluoruros", "Calcio (mg/L)", ""]
_DESCRIPTION = ["code", "zone", "day", "Calcium", "Chloride", "Fluoride", "TDS", ""]


def _separator(name: str):
    return F.get(F.array(*[F.lit(s) for s in headers.SEPARATORS]), F.length(name) % 4)


def lab_lines(spark, sf):
    df, sep = S.raw(spark, sf), _separator("group")
    plain, quoted = F.col("station_code"), lambda *more: F.concat(F.lit('"'), "station_code", *more, F.lit('"'))
    station = F.get(F.array(plain, F.concat(plain, F.lit(' 3" norte')), quoted(sep, F.lit("b")), quoted(F.lit(' ""A""')), quoted(F.lit("\nsur"))), F.col(SEQ) % 5)
    fluoride = F.concat(F.lit('"'), F.col("F_mgL"), F.lit('"'))
    values = [
        station, F.col("group"), F.date_format("sampled_at", "yyyy-MM-dd"), F.col("Ca_mgL").cast("string"),
        F.format_string("%.3f", F.col("Cl_mgL")), fluoride, F.format_string("%.3f", F.col("tds_mgl")), F.lit(""),
    ]
    data = df.select(F.col("group").alias("file"), (F.col(SEQ) + 100).alias("row"), F.call_function("concat_ws", sep, *values).alias("text"))
    names, sep = df.select(F.col("group").alias("file")).distinct(), _separator("file")
    top = [F.concat(F.lit("Laboratory report "), F.col("file")), F.lit("")]
    top += [F.call_function("concat_ws", sep, *map(F.lit, cells_)) for cells_ in (_HEADER, _DESCRIPTION)]
    first = names.select("file", F.posexplode(F.array(*top)).alias("row", "text"))
    return first.select("file", F.col("row").cast("bigint").alias("row"), "text").unionByName(data)


def lab_folder(spark, sf) -> str:
    """The lines written as files, one per group."""
    path = scratch_path(spark, "laboratory")
    lab_lines(spark, sf).repartition("file").sortWithinPartitions("file", "row").select("file", "text").write.partitionBy("file").text(path)
    return path


def lab_records(spark, sf):
    """The records read from the files, which are named by their group."""
    return read_lines(spark, lab_folder(spark, sf)).withColumn("file", F.regexp_extract("file", "file=([^/]+)/", 1))


def _texts(kind: str) -> str:
    """Check SQL of a line's text: kind is title, header, description or data."""
    sep = "(CASE length(file) % 4 WHEN 0 THEN ';' WHEN 1 THEN ',' WHEN 2 THEN chr(9) ELSE '|' END)"
    if kind == "title":
        return "'Laboratory report ' || file"
    if kind in ("header", "description"):
        return "concat_ws(" + ", ".join([sep, *(f"'{c}'" for c in (_HEADER if kind == "header" else _DESCRIPTION))]) + ")"
    station = f"CASE sample_seq % 5 WHEN 0 THEN station_code WHEN 1 THEN station_code || ' 3\" norte' WHEN 2 THEN '\"' || station_code || {sep} || 'b\"' WHEN 3 THEN '\"' || station_code || ' \"\"A\"\"\"' ELSE '\"' || station_code || chr(10) || 'sur\"' END"
    rest = "file, strftime(sampled_at, '%Y-%m-%d'), CAST(CAST(Ca_mgL AS DOUBLE) AS VARCHAR), format('{:.3f}', Cl_mgL), '\"' || F_mgL || '\"', format('{:.3f}', tds_mgl), ''"
    return f"concat_ws({sep}, {station}, {rest})"


_HEADER_AT = f"(strlen({_texts('title')}) + 2)::BIGINT"
_DESCRIPTION_AT = f"({_HEADER_AT} + strlen({_texts('header')}) + 1)::BIGINT"
_BODY_AT = f"({_DESCRIPTION_AT} + strlen({_texts('description')}) + 1)::BIGINT"
_STATION = "CASE sample_seq % 5 WHEN 0 THEN station_code WHEN 1 THEN station_code || ' 3\" norte' WHEN 2 THEN station_code || (CASE length(file) % 4 WHEN 0 THEN ';' WHEN 1 THEN ',' WHEN 2 THEN chr(9) ELSE '|' END) || 'b' WHEN 3 THEN station_code || ' \"A\"' ELSE station_code || chr(10) || 'sur' END"
_PLACED = (
    f"SELECT *, ({_BODY_AT} + coalesce(sum(strlen({_texts('data')}) + 1) OVER (PARTITION BY file ORDER BY sample_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"row\" "
    'FROM (SELECT *, "group" AS file FROM samples)'
)
_FILES = 'SELECT DISTINCT "group" AS file FROM samples'


@query("src_01_separators", sql(
    f"SELECT file, CASE length(file) % 4 WHEN 0 THEN ';' WHEN 1 THEN ',' WHEN 2 THEN chr(9) ELSE '|' END AS sep, {_HEADER_AT} AS header_row FROM ({_FILES})", "samples"))
def src_01(spark, sf):
    return shown(headers.file_formats(headers.head(lab_records(spark, sf))), "file", "sep", "header_row")


@query("src_01_records", sql(
    f"SELECT file, \"row\", {_texts('data')} AS text FROM ({_PLACED}) UNION ALL SELECT file, 0, {_texts('title')} FROM ({_FILES}) UNION ALL SELECT file, strlen({_texts('title')}) + 1, '' FROM ({_FILES}) "
    f"UNION ALL SELECT file, {_HEADER_AT}, {_texts('header')} FROM ({_FILES}) UNION ALL SELECT file, {_DESCRIPTION_AT}, {_texts('description')} FROM ({_FILES})", "samples"))
def src_01_records(spark, sf):
    """Every record of the files, named by its byte offset; quoted breaks stay inside."""
    return shown(lab_records(spark, sf), "file", "row", "text")


_BOOK = {"station_code": "Estación", "group": "Grupo", "sampled_at": "Fecha", "Ca_mgL": "Calcio (mg/L)", "Cl_mgL": "Cl⁻", "F_mgL": "Fluoruros"}


@query("src_02_workbooks", sql(
    "SELECT station_code, \"group\", strftime(sampled_at, '%Y-%m-%d') || ' 00:00:00' AS sampled_at, CAST(CAST(Ca_mgL AS DOUBLE) AS VARCHAR) AS Ca_mgL, "
    "round(Cl_mgL, 6) AS Cl_mgL, nullif(F_mgL, '') AS F_mgL, count(*) AS n FROM samples GROUP BY ALL", "samples"))
def src_02(spark, sf):
    """Workbooks made of the samples, read cell by cell; the sheet of data is found among others."""
    df = S.raw(spark, sf).withColumns({c: F.col(c).cast("double") for c in ("Ca_mgL", "Cl_mgL")} | {"sampled_at": F.col("sampled_at").cast("date")})
    rows = canonical_cells(book_cells(workbooks(df, _BOOK)))
    rows = rows.select("station_code", "group", "sampled_at", "Ca_mgL", F.round(F.col("Cl_mgL").cast("double"), 6).alias("Cl_mgL"), "F_mgL")
    return shown(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")))


@query("src_03_best_sheet", sql(
    "SELECT file AS book, 'data' AS sheet, CAST(7 AS BIGINT) AS score FROM (" + _FILES + ")", "samples"))
def src_03(spark, sf):
    """Each file as a book of two sheets: notes, then data."""
    from limnos.sources.workbook import best_sheets

    data = lab_records(spark, sf).select("file", "row", "text", "in_head")
    notes = data.select("file").distinct().select("file", F.lit(0).cast("bigint").alias("row"), F.lit("notes\tabout\tthis\tbook").alias("text"))
    sheets = [(data, "data", 1), (notes.withColumn("in_head", F.lit(True)), "notes", 0)]
    parts = [
        df.select(
            F.concat("file", F.lit(f"#{name}")).alias("file"), F.col("file").alias("book"), F.lit(name).alias("sheet"),
            F.lit(pos).alias("sheet_pos"), "row", "in_head", "text")
        for df, name, pos in sheets
    ]
    return shown(best_sheets(parts[0].unionByName(parts[1])), "book", "sheet", "score")


@query("src_04_header_row", sql(
    "SELECT file, CAST(2 AS BIGINT) AS header_k, CAST(7 AS BIGINT) AS score FROM (" + _FILES + ")", "samples"))
def src_04(spark, sf):
    """Seven of the eight header cells are known names (the repeated one counts again)."""
    formats = headers.file_formats(headers.head(lab_records(spark, sf)))
    return shown(formats, "file", "header_k", "score")


_NAMES = ["Estación", "Grupo", "Fecha", "Calcio (mg/L)", "Cl⁻", "Fluoruros", "Calcio (mg/L)__2", "columna_8"]


@query("src_05_header_names", sql(union(f"SELECT file, CAST({i} AS BIGINT) AS pos, '{n}' AS name FROM ({_FILES})" for i, n in enumerate(_NAMES)), "samples"))
def src_05(spark, sf):
    heads = headers.head(lab_records(spark, sf))
    return shown(headers.header_names(heads, headers.file_formats(heads)))


@query("win_03_repeated_names", sql(f"SELECT 'Calcio (mg/L)__2' AS name, count(*) AS n FROM ({_FILES})", "samples"))
def win_03(spark, sf):
    heads = headers.head(lab_records(spark, sf))
    names = headers.header_names(heads, headers.file_formats(heads))
    return shown(names.filter(F.col("name").rlike("__[0-9]+$")).groupBy("name").agg(F.count("*").alias("n")))


@query("src_06_filled_columns", sql(
    f"SELECT file, CAST(pos AS BIGINT) AS pos FROM ({_FILES}) CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) v(pos)", "samples"))
def src_06(spark, sf):
    lines = lab_records(spark, sf)
    return shown(headers.filled_columns(lines, headers.file_formats(headers.head(lines))))


@query("src_07_description_row", sql(f'SELECT file, {_DESCRIPTION_AT} AS "row" FROM ({_FILES})', "samples"))
def src_07(spark, sf):
    lines = lab_records(spark, sf)
    heads = headers.head(lines)
    formats = headers.file_formats(heads)
    mapped = headers.map_columns(headers.header_names(heads, formats))
    return shown(headers.description_rows(lines, formats, mapped))


@query("src_09_normalised_names", sql(union(
    f"SELECT '{n}' AS name, '{k}' AS normal, count(*) AS n FROM ({_FILES})"
    for n, k in zip(_NAMES, ["estacion", "grupo", "fecha", "calcio", "cl", "fluoruros", "calcio_2", "columna_8"])), "samples"))
def src_09(spark, sf):
    heads = headers.head(lab_records(spark, sf))
    names = headers.header_names(heads, headers.file_formats(heads))
    out = names.withColumn("normal", mapping.normalised(F.col("name")))
    return shown(out.groupBy("name", "normal").agg(F.count("*").alias("n")))


_FIELDS = [("station_code", 0), ("group", 1), ("sampled_at", 2), ("Ca_mgL", 3), ("Cl_mgL", 4), ("F_mgL", 5)]


@query("src_10_column_mapping", sql(union(f"SELECT file, '{f}' AS field, CAST({p} AS BIGINT) AS pos FROM ({_FILES})" for f, p in _FIELDS), "samples"))
def src_10(spark, sf):
    heads = headers.head(lab_records(spark, sf))
    return shown(headers.map_columns(headers.header_names(heads, headers.file_formats(heads))), "file", "field", "pos")


@query("jon_05_header_alias", sql(union(f"SELECT '{f}' AS field, count(*) AS n FROM ({_FILES})" for f, _ in _FIELDS), "samples"))
def jon_05(spark, sf):
    heads = headers.head(lab_records(spark, sf))
    mapped = headers.map_columns(headers.header_names(heads, headers.file_formats(heads)))
    return shown(mapped.groupBy("field").agg(F.count("*").alias("n")))


@query("src_12_canonical_rows", sql(
    f"SELECT file, \"row\", {_STATION} AS station_code, strftime(sampled_at, '%Y-%m-%d') AS sampled_at, CAST(CAST(Ca_mgL AS DOUBLE) AS VARCHAR) AS Ca_mgL, "
    f"format('{{:.3f}}', Cl_mgL) AS Cl_mgL, nullif(F_mgL, '') AS F_mgL FROM ({_PLACED})", "samples"))
def src_12(spark, sf):
    return shown(headers.to_canonical(lab_records(spark, sf)), "file", "row", "station_code", "sampled_at", "Ca_mgL", "Cl_mgL", "F_mgL")


@query("win_06_file_keys", sql("SELECT count(*) AS n, count(*) AS n_keys, CAST(0 AS BIGINT) AS n_repeated FROM samples", "samples"))
def win_06_file_keys(spark, sf):
    """Keys of all samples read from the files."""
    rows = read_lab_files(spark, lab_folder(spark, sf))
    return shown(rows.agg(F.count("*").alias("n"), F.count_distinct(SEQ).alias("n_keys"), (F.count("*") - F.count_distinct(SEQ)).alias("n_repeated")))


@query("src_08_other_inputs", sql("SELECT station_code, count(*) AS n, count(*) FILTER (WHERE CBE_flag = 'rejected') AS n_rejected FROM chem GROUP BY 1", "chem"))
def src_08(spark, sf):
    """A frame written and read back is as good an input as the first one."""
    path = scratch_path(spark, "canonical")
    S.raw(spark, sf).write.parquet(path)
    df = cells.apply_cells(spark.read.parquet(path))
    df = add_charge_balance(add_meq(df.withColumn("reliable", analysis.reliability(df))), reliable=F.col("reliable"))
    return shown(df.groupBy("station_code").agg(F.count("*").alias("n"), F.count_if(F.col("CBE_flag") == "rejected").alias("n_rejected")))


_DRIFT = [
    "days AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, DATE '{d}')" for k, d in enumerate(synthetic.CAMPAIGN_DAYS)) + ") v(k, d))"
]


def _drifted(i: int, c: str, slope: float) -> str:
    return (
        f"{c} * (1 + (0.05::DOUBLE + 0.30::DOUBLE * (sample_seq % 12) / 11) * (k / 7.0::DOUBLE) * {slope}::DOUBLE) * "
        f"(1 + 0.03::DOUBLE * (((sample_seq * 7919 + k * 104729 + {i * 1299709}) % 2001) - 1000) / 1000)"
    )


_DRIFT_IONS = [(i, c, s) for i, (c, s) in enumerate(synthetic.DRIFT.items())]


@query("src_14_drifting_campaigns", sql(
    "SELECT d AS sampled_at, 'C0' || (k + 1) AS campaign, count(*) AS n, "
    + ", ".join(r(f"sum({_drifted(i, c, s)}) / count({c})", c, 1) for i, c, s in _DRIFT_IONS) + " FROM measured CROSS JOIN days GROUP BY 1, 2", "measured", more=_DRIFT))
def src_14(spark, sf):
    out = synthetic.drifting_campaigns(S.measured(spark, sf))
    return shown(out.groupBy("sampled_at", "campaign").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(c) for _, c, _ in _DRIFT_IONS]), digits=1)


@query("src_15_zoned_campaigns", sql(
    "SELECT CASE sample_seq % 3 WHEN 0 THEN 'Acuifero superior' WHEN 1 THEN 'Zona de transicion' ELSE 'Cuna salina' END AS \"group\", d AS sampled_at, count(*) AS n, "
    "count(*) FILTER (WHERE sample_seq % 3 = 0) AS n_censored, count(*) FILTER (WHERE sample_seq % 23 = 0) AS n_gaps "
    "FROM samples CROSS JOIN (VALUES (DATE '2024-03-18'), (DATE '2024-09-16'), (DATE '2025-03-17')) v(d) GROUP BY 1, 2", "samples"))
def src_15(spark, sf):
    df = cells.apply_cells(synthetic.zoned_campaigns(S.raw(spark, sf)))
    return shown(df.groupBy("group", "sampled_at").agg(
        F.count("*").alias("n"), F.count("F_mgL__detection_limit").alias("n_censored"), F.count_if(F.col("Mg_mgL").isNull()).alias("n_gaps")))


@query("set_02_union_of_files", sql(
    "SELECT source, count(*) AS n, count(Ca_mgL) AS n_ca, count(campaign) AS n_campaign FROM (SELECT 'measured' AS source, Ca_mgL, NULL AS campaign FROM measured "
    "UNION ALL SELECT 'synthetic', Ca_mgL, 'C' || k FROM measured CROSS JOIN days) GROUP BY 1", "measured", more=_DRIFT))
def set_02(spark, sf):
    df = S.measured(spark, sf)
    a = df.withColumn("source", F.lit("measured"))
    b = synthetic.drifting_campaigns(df).withColumn("source", F.lit("synthetic"))
    out = a.unionByName(b, allowMissingColumns=True).groupBy("source")
    return shown(out.agg(F.count("*").alias("n"), F.count("Ca_mgL").alias("n_ca"), F.count("campaign").alias("n_campaign")))


# --- exports -------------------------------------------------------------------


@query("snk_01_tidy_columns", sql(f"SELECT sample_seq, station_code, facies, {rs('Ca_mgL', 'Ca_meq', 'lon_wgs84')} FROM placed", "placed"))
def snk_01(spark, sf):
    out = writers.tidy(S.placed(spark, sf))
    if any(c.startswith("pct_") or c.endswith("__detection_limit") for c in out.columns):
        raise RuntimeError("internal columns were kept")
    return shown(out, SEQ, "station_code", "facies", "Ca_mgL", "Ca_meq", "lon_wgs84")


@query("snk_02_csv", sql(f"SELECT sample_seq, station_code, {rs('Ca_mgL', 'CBE_pct')} FROM chem", "chem"))
def snk_02(spark, sf):
    """Written as CSV and read back."""
    path = scratch_path(spark, "csv")
    writers.write_csv(S.chem(spark, sf), path)
    back = spark.read.option("header", True).csv(path)
    return shown(back.select(
        F.col(SEQ).cast("bigint").alias(SEQ), "station_code", F.col("Ca_mgL").cast("double").alias("Ca_mgL"), F.col("CBE_pct").cast("double").alias("CBE_pct")))


_LIMITS = [("F_mgL", None, 1.5), ("NO3_mgL", None, 50), ("Cl_mgL", None, 250), ("SO4_mgL", None, 250), ("Na_mgL", None, 200), ("tds_mgl", None, 1000), ("ph", 6.5, 8.5)]


@query("snk_03_result_bundle", sql(union([
    f"SELECT 'results' AS part, CAST(sample_seq AS VARCHAR) AS item, {r('CBE_pct', 'value')} FROM fac", "SELECT 'facies', facies, count(*) FROM fac GROUP BY facies",
    *[f"SELECT 'limits', '{p}', count(*) FILTER (WHERE {' OR '.join(x for x in (f'{p} > {hi}', f'{p} < {lo}' if lo else '') if x)}) FROM measured" for p, lo, hi in _LIMITS],
    "SELECT 'issues', 'filas_leidas', count(*) FROM measured",
    *[f"SELECT 'weights', '{i}', {w!r}" for i, w in equivalent_weights().items()]]), "fac"))
def snk_03(spark, sf):
    """All five tables written as one bundle and read back by its manifest."""
    from limnos.operators import standards, validation
    from limnos.operators.facies import facies_counts

    df, path = S.fac(spark, sf), scratch_path(spark, "bundle")
    weights = spark.createDataFrame([(i, float(w)) for i, w in equivalent_weights().items()], "ion string, weight double")
    writers.write_bundle({"results": writers.tidy(df), "facies": facies_counts(df), "limits": standards.compliance(df), "issues": validation.rows_read(df), "weights": weights}, path)
    back = writers.read_bundle(spark, path)
    shape = {"results": (SEQ, "CBE_pct"), "facies": ("facies", "n"), "limits": ("parameter", "n_exceeding"), "issues": ("code", "n_rows"), "weights": ("ion", "weight")}
    parts = [back[t].select(F.lit(t).alias("part"), F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("value")) for t, (item, value) in shape.items()]
    return shown(functools.reduce(lambda x, y: x.unionByName(y), parts))


@query("snk_04_geojson", sql(
    f"SELECT 'Feature' AS type, station_code AS estacion, facies AS facies_codigo, {r('Ca_mgL')}, {r('lon_wgs84', 'lon')}, {r('lat_wgs84', 'lat')}, F_mgL IS NOT NULL AS has_f, "
    "(SELECT count(*) FROM placed WHERE sample_seq % 7 = 0) AS n_skipped FROM placed WHERE sample_seq % 7 <> 0", "placed"))
def snk_04(spark, sf):
    """Written, one feature a line, and read back; a seventh of the samples has lost its position."""
    path = scratch_path(spark, "features")
    lost = F.when(F.col(SEQ) % 7 != 0, F.col("lon_wgs84"))
    skipped = writers.write_geojson(S.placed(spark, sf).withColumn("lon_wgs84", lost), path)
    shape = "type string, geometry struct<coordinates: array<double>>, properties struct<estacion: string, facies_codigo: string, Ca_mgL: double, F_mgL: double>"
    f = spark.read.schema(shape).json(path)
    at = F.col("geometry.coordinates")
    return shown(f.select(
        "type", "properties.estacion", "properties.facies_codigo", "properties.Ca_mgL", F.get(at, F.lit(0)).alias("lon"), F.get(at, F.lit(1)).alias("lat"),
        F.col("properties.F_mgL").isNotNull().alias("has_f"), F.lit(skipped).cast("long").alias("n_skipped")))


@query("snk_05_kml_document", sql(
    "SELECT '<Placemark><name>' || station_code || '</name><styleUrl>#' || facies || '</styleUrl>' AS line, count(*) AS n FROM placed GROUP BY 1 "
    "UNION ALL SELECT '<Folder><name>' || \"group\" || ' (' || count(*) || ')</name>', 1 FROM placed GROUP BY \"group\" UNION ALL SELECT '</Folder>', count(DISTINCT \"group\") FROM placed "
    "UNION ALL VALUES ('</Document></kml>', 1), ('<?xml version=\"1.0\" encoding=\"UTF-8\"?>', 1), ('<kml xmlns=\"http://www.opengis.net/kml/2.2\"><Document><name>samples</name>', 1)", "placed"))
def snk_05_document(spark, sf):
    """The document written and read back, by lines (less their points)."""
    path = scratch_path(spark, "kml")
    writers.write_kml(S.placed(spark, sf), path)
    line = F.regexp_replace("value", "<Point>.*", "")
    return shown(spark.read.text(path).groupBy(line.alias("line")).agg(F.count("*").alias("n")))


@query("scl_11_safe_names", sql("SELECT regexp_replace(station_code || ' ' || \"group\" || ' ñ/1', '[^A-Za-z0-9._-]', '_', 'g') AS name, count(*) AS n FROM samples GROUP BY 1", "samples"))
def scl_11(spark, sf):
    name = writers.safe_name(F.concat_ws(" ", "station_code", "group", F.lit("ñ/1")))
    return shown(S.raw(spark, sf).groupBy(name.alias("name")).agg(F.count("*").alias("n")))


@query("snk_05_kml_folders", sql("SELECT \"group\", count(*) AS n, \"group\" || ' (' || count(*) || ')' AS folder FROM placed GROUP BY 1", "placed"))
def snk_05(spark, sf):
    return shown(writers.kml_folders(S.placed(spark, sf)))


@query("snk_05_kml_placemarks", sql(
    "SELECT sample_seq, '<name>' || station_code || '</name>' AS name, '#' || facies AS style FROM placed", "placed"))
def snk_05_placemarks(spark, sf):
    p = writers.kml_placemarks(S.placed(spark, sf))
    return shown(p.select(
        SEQ, F.regexp_extract("placemark", "<name>.*</name>", 0).alias("name"),
        F.regexp_extract("placemark", "<styleUrl>(.*)</styleUrl>", 1).alias("style")))


@query("snk_06_map_extent", sql(
    f"SELECT count(*) AS n_samples, 0 AS n_skipped, {r('(min(lon_wgs84) + max(lon_wgs84)) / 2', 'center_lon')}, {r('(min(lat_wgs84) + max(lat_wgs84)) / 2', 'center_lat')}, "
    + r("greatest(1500.0::DOUBLE, greatest(max(lat_wgs84) - min(lat_wgs84), (max(lon_wgs84) - min(lon_wgs84)) * cos(radians((min(lat_wgs84) + max(lat_wgs84)) / 2))) * 111320 * 2.2::DOUBLE)", "look_range", 2)
    + f", {r('greatest(max(greatest(' + ', '.join(f'({a}), ({b})' for a, b in S.STIFF_ROWS) + ')) * 1.2::DOUBLE, 0.5::DOUBLE)', 'stiff_scale')} FROM placed", "placed"))
def snk_06(spark, sf):
    from limnos.operators.diagrams import add_stiff

    out = writers.map_extent(add_stiff(S.placed(spark, sf)))
    rounded = shown(out)
    return rounded.withColumn("look_range", F.round("look_range", 2) + 0.0)


@query("snk_06_classes_in_order", sql("SELECT facies, min(sample_seq) AS first_seq, count(*) AS n FROM placed GROUP BY 1 ORDER BY 2", "placed"))
def snk_06_classes(spark, sf):
    return shown(writers.classes_in_order(S.placed(spark, sf)))


@query("snk_07_sample_cards", sql(
    "SELECT sample_seq, station_code AS station, facies_label AS facies, "
    + " + ".join(f"CAST({c} IS NOT NULL AS BIGINT)" for c in IONS) + " AS n_ions, n_exceedances AS n_exceeded, "
    + r("ph", "pH") + " FROM comp", "comp"))
def snk_07(spark, sf):
    c = cards.sample_cards(S.comp(spark, sf))
    return shown(c.select(
        SEQ, "station", "facies", F.size("ions").alias("n_ions"), F.size("exceeded").alias("n_exceeded"), F.col("measures.pH").alias("pH")))


_TEXT = lambda e: f"CAST(CAST({e} AS DOUBLE) AS VARCHAR)"


@query("snk_08_speciation_input", sql(
    "SELECT concat_ws(chr(10), 'SOLUTION ' || sample_seq || ' ' || station_code, "
    f"'    temp ' || CASE WHEN temp_c <> 0 THEN {_TEXT('temp_c')} ELSE '25.0' END, '    pH ' || CASE WHEN ph <> 0 THEN {_TEXT('ph')} ELSE '7.0' END, '    units mg/l', "
    + ", ".join(f"'    {name} ' || {_TEXT(mgl(i))} || '{unit}'" for i, name, unit in writers._SPECIATION) + ") AS text FROM measured "
    "UNION ALL VALUES ('END'), ('TITLE Batch simulation' || chr(10) || 'SELECTED_OUTPUT' || chr(10) || '    -reset false' || chr(10) || '    -solution true' || chr(10) || '    -pH true' || chr(10) || '    -temperature true' "
    "|| chr(10) || '    -alkalinity true' || chr(10) || '    -ionic_strength true' || chr(10) || '    -totals Ca Mg Na K Cl S(6) F C(4)' || chr(10) || '    -si Calcite Gypsum Fluorite Halite')", "measured"))
def snk_08(spark, sf):
    """The document written and read back, by blocks."""
    path = scratch_path(spark, "speciation")
    writers.write_speciation(S.measured(spark, sf), path)
    return shown(spark.read.option("lineSep", "\n\n").text(path).select(F.col("value").alias("text")))


@query("snk_09_saved_run", sql("SELECT CBE_flag, count(*) AS n FROM chem GROUP BY 1", "chem"))
def snk_09(spark, sf):
    """Saved as canonical rows and options, reopened, recomputed."""
    path = scratch_path(spark, "run")
    analysis.save_run(analysis.analyse(S.raw(spark, sf), analysis.AnalysisOptions(crs="EPSG:32718")), path)
    again = analysis.load_run(spark, path)
    return shown(again.samples.groupBy("CBE_flag").agg(F.count("*").alias("n")))


@query("snk_10_sample_documents", sql(
    f"SELECT 's' || sample_seq AS id, station_code AS station, CBE_flag AS cbe_flag, {r('Na_mgL', 'na')}, {r('Na_meq', 'na_meq')}, n_exceedances FROM comp", "comp"))
def snk_10(spark, sf):
    d = cards.sample_documents(S.comp(spark, sf))
    return shown(d.select("id", "station", "cbe_flag", F.col("mgl.Na").alias("na"), F.col("meq.Na").alias("na_meq"), "n_exceedances"))


@query("snk_11_positions_only_wgs84", sql(f"SELECT sample_seq, {rs('lon_wgs84', 'lat_wgs84')} FROM placed", "placed"))
def snk_11(spark, sf):
    return shown(writers.placed_rows(S.placed(spark, sf).drop("longitude", "latitude")), SEQ, "lon_wgs84", "lat_wgs84")


# --- whole analysis, neighbours, components --------------------------------------

_SI = ["SI_Calcite", "SI_Gypsum", "SI_Fluorite", "SI_Halite"]


@query("full_analysis", sql(
    f"SELECT c.sample_seq, c.CBE_flag, c.facies, c.n_exceedances, {r('i.SAR', 'SAR')}, i.Wilcox_class, {', '.join(r('s.' + x, x) for x in _SI)}, "
    f"{r('p.x_diamond', 'x_diamond')}, {r('d.durov_x', 'durov_x')}, {r('g.lon_wgs84', 'lon_wgs84')} "
    "FROM comp c JOIN irr i USING (sample_seq) JOIN sat s USING (sample_seq) JOIN piper p USING (sample_seq) JOIN durov d USING (sample_seq) JOIN placed g USING (sample_seq)",
    "comp", "irr", "sat", "piper", "durov", "placed"))
def full_analysis(spark, sf):
    df = S.measured(spark, sf)
    df = analysis.chemistry(df.withColumn("reliable", analysis.reliability(df)), analysis.AnalysisOptions(crs="EPSG:32718"))
    return shown(df, SEQ, "CBE_flag", "facies", "n_exceedances", "SAR", "Wilcox_class", *_SI, "x_diamond", "durov_x", "lon_wgs84")


_K = 5
_SQUARES = " + ".join(f"coalesce((r.{c} - d.{c}) * (r.{c} - d.{c}), 0)" for c in IONS)
_COMMON = " + ".join(f"(r.{c} IS NOT NULL AND d.{c} IS NOT NULL)::INT" for c in IONS)
#: All pairs of samples with a gap and donors: the k nearest donors of each gap, copies merged.
_FILLS = [
    "v AS MATERIALIZED (SELECT " + ", ".join(IONS) + ", count(*) AS cnt, min(sample_seq) AS seq FROM measured GROUP BY ALL)",
    "best AS (" + " UNION ALL ".join(
        f"SELECT r.seq AS rid, '{t}' AS target, min(struct_pack(d2 := {len(IONS)}.0::DOUBLE * ({_SQUARES}) / ({_COMMON}), seq := d.seq, value := d.{t}, cnt := d.cnt), {_K}) AS near "
        f"FROM v r JOIN v d ON r.{t} IS NULL AND d.{t} IS NOT NULL AND ({_COMMON}) > 0 GROUP BY r.seq" for t in IONS) + ")",
    "each AS (SELECT rid, target, unnest(near) AS x FROM best)",
    f"taken AS (SELECT rid, target, x.d2 AS d2, x.value AS value, least(x.cnt, {_K} - (sum(x.cnt) OVER (PARTITION BY rid, target ORDER BY x.d2, x.seq) - x.cnt)) AS w FROM each)",
    "fills AS (SELECT rid, target, coalesce(sum(w * value) FILTER (d2 = 0) / sum(w) FILTER (d2 = 0), sum(w * value / sqrt(d2)) FILTER (d2 > 0) / sum(w / sqrt(d2)) FILTER (d2 > 0)) AS value "
    "FROM taken WHERE w > 0 GROUP BY ALL)",
]
_WIDE = "wide AS (SELECT rid, " + ", ".join(f"max(value) FILTER (target = '{c}') AS f_{c}" for c in IONS) + " FROM fills GROUP BY rid)"
_SAME = " AND ".join(f"m.{c} IS NOT DISTINCT FROM v.{c}" for c in IONS)


@query("imp_04_nearest_neighbours", sql(
    "SELECT m.sample_seq, " + ", ".join(r(f"coalesce(m.{c}, w.f_{c}, (SELECT avg({c}) FROM measured))", c) for c in IONS) + ", "
    + ", ".join(f"m.{c} IS NULL AS {c}__imputed" for c in IONS) + f" FROM measured m JOIN v ON {_SAME} LEFT JOIN wide w ON w.rid = v.seq", "measured", more=[*_FILLS, _WIDE]))
def imp_04(spark, sf):
    """Exact neighbours of every sample with an ion gap; the check compares all pairs."""
    df = neighbours.knn_fill(S.measured(spark, sf), IONS)
    return shown(df, SEQ, *IONS, *[f"{c}__imputed" for c in IONS])


@query("jon_07_nearest_donors", sql(f"SELECT rid, target, {r('value')} FROM fills", "measured", more=_FILLS))
def jon_07(spark, sf):
    _, fills = neighbours.nearest_values(S.measured(spark, sf).select(SEQ, *IONS), IONS)
    return shown(fills)


@query("srt_06_gaps_filled_by_donors", sql(f"SELECT target, count(*) AS n, {r('avg(value)', 'mean')} FROM fills GROUP BY target", "measured", more=_FILLS))
def srt_06(spark, sf):
    """Gaps per ion that found donors."""
    _, fills = neighbours.nearest_values(S.measured(spark, sf).select(SEQ, *IONS), IONS)
    return shown(fills.groupBy("target").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


_P = len(multivariate.FEATURES)
_PRODUCT = "list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b)))"


def _axis_sql(name: str, matrix: str) -> list[str]:
    """Check SQL of the largest eigenvalue and its vector: a matrix squared again and again, scaled by its trace, leaves that vector in every row."""
    trace = " + ".join(f"m[{i}][{i}]" for i in range(1, _P + 1))
    return [
        f"{name}_p(i, m) AS (SELECT 0, m FROM {matrix} UNION ALL SELECT i + 1, list_transform(q, lambda a: list_transform(a, lambda x: x / t)) "
        f"FROM (SELECT i, {_PRODUCT} AS q, list_sum(list_transform(m, lambda a: list_dot_product(a, a))) AS t FROM {name}_p WHERE i < 24))",
        f"{name}_r AS (SELECT list_extract(m, list_position(list_transform(m, lambda a: list_dot_product(a, a)), list_max(list_transform(m, lambda a: list_dot_product(a, a))))) AS v FROM {name}_p WHERE i = 24)",
        f"{name}_u AS (SELECT list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)) * sign(list_extract(v, list_position(list_transform(v, lambda y: abs(y)), list_max(list_transform(v, lambda y: abs(y))))))) AS v FROM {name}_r)",
        f"{name} AS (SELECT v, list_dot_product(v, list_transform(m, lambda a: list_dot_product(a, v))) AS spread FROM {name}_u, {matrix})",
    ]


_X = [f"coalesce({c}::DOUBLE, (SELECT median({c}) FROM fac), 0)" for c in multivariate.FEATURES]
_COMPONENTS = [
    f"full_ AS MATERIALIZED (SELECT sample_seq, facies_label, {', '.join(f'{x} AS x{i}' for i, x in enumerate(_X, 1))} FROM fac)",
    "scale_ AS MATERIALIZED (SELECT " + ", ".join(f"avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}" for i in range(1, _P + 1)) + " FROM full_)",
    "z AS MATERIALIZED (SELECT sample_seq, facies_label, " + f"x{multivariate.FEATURES.index('tds_mgl') + 1} AS tds, [" + ", ".join(f"(x{i} - m{i}) / s{i}" for i in range(1, _P + 1)) + "] AS z FROM full_, scale_)",
    "corr_ AS MATERIALIZED (SELECT [" + ", ".join("[" + ", ".join(f"covar_pop(x{i}, x{j}) / (any_value(s{i}) * any_value(s{j}))" if i != j else "1.0::DOUBLE" for j in range(1, _P + 1)) + "]" for i in range(1, _P + 1)) + "] AS m FROM full_, scale_)",
    *_axis_sql("a1", "corr_"),
    "rest_ AS (SELECT list_transform(m, lambda a, i: list_transform(a, lambda x, j: x - spread * list_extract(v, i) * list_extract(v, j))) AS m FROM corr_, a1)",
    *_axis_sql("a2", "rest_"),
    "scored AS MATERIALIZED (SELECT z.sample_seq, z.facies_label, z.tds, z.z, list_dot_product(z.z, a1.v) AS pc1, list_dot_product(z.z, a2.v) AS pc2 FROM z, a1, a2)",
]


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query("imp_05_principal_components", _recursive(sql(f"SELECT sample_seq, {rs('pc1', 'pc2')} FROM scored", "fac", more=_COMPONENTS)))
def imp_05(spark, sf):
    return shown(multivariate.component_scores(S.fac(spark, sf)).samples, SEQ, "pc1", "pc2")


_MIDDLES = [statistics.NormalDist().inv_cdf((j + 0.5) / 3) for j in range(3)]
_NEAR = "CASE WHEN d[1] <= d[2] AND d[1] <= d[3] THEN 1 WHEN d[2] <= d[3] THEN 2 ELSE 3 END"
_CENTRES = "[" + ", ".join("[" + ", ".join(f"coalesce(avg(z[{v}]) FILTER (near = {c}), any_value(old[{c}][{v}]))" for v in range(1, _P + 1)) + "]" for c in (1, 2, 3)) + "]"
_DISTANCES = "[list_sum(list_transform(list_zip(z, c[1]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), list_sum(list_transform(list_zip(z, c[2]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), list_sum(list_transform(list_zip(z, c[3]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))]"
_CLUSTERS = [
    *_COMPONENTS,
    "lines_ AS (SELECT 1 AS start, list_transform(v, lambda x: x * sqrt(spread)) AS line FROM a1 UNION ALL SELECT 2, list_transform(v, lambda x: x * sqrt(spread)) FROM a2 "
    f"UNION ALL SELECT 2 + i, list_transform(range(1, {_P + 1}), lambda j: CASE WHEN j = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM range(1, {_P + 1}) t(i))",
    "steps_(i, start, c, moving) AS (SELECT 0, start, [" + ", ".join(f"list_transform(line, lambda x: x * ({m!r}))" for m in _MIDDLES) + "], true FROM lines_ UNION ALL "
    f"SELECT i + 1, start, new, list_sum(list_transform(list_zip(flatten(new), flatten(old)), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) > {multivariate.SETTLED} FROM ("
    f"SELECT any_value(i) AS i, start, any_value(old) AS old, {_CENTRES} AS new FROM (SELECT i, start, old, z, {_NEAR} AS near FROM (SELECT s.i, s.start, s.c AS old, z.z, {_DISTANCES} AS d FROM steps_ s, z WHERE s.moving AND s.i < {multivariate.STEPS})) GROUP BY start))",
    "ends_ AS MATERIALIZED (SELECT start, arg_max(c, i) AS c FROM steps_ GROUP BY start)",
    f"costs_ AS (SELECT start, any_value(c) AS c, sum(list_min(d)) AS cost FROM (SELECT e.start, e.c, {_DISTANCES} AS d FROM ends_ e, z) GROUP BY start)",
    "won_ AS (SELECT list_transform(list_sort(list_transform(w.c, lambda x: struct_pack(k := list_dot_product(x, a1.v), x := x))), lambda p: p.x) AS c FROM (SELECT arg_min(c, cost) AS c FROM costs_) w, a1)",
    f"clustered AS MATERIALIZED (SELECT sample_seq, facies_label, tds, {_NEAR} AS cluster FROM (SELECT sample_seq, facies_label, tds, {_DISTANCES} AS d FROM z, won_))",
]


@query("imp_06_clusters", _recursive(sql("SELECT sample_seq, cluster::BIGINT AS cluster FROM clustered", "fac", more=_CLUSTERS)))
def imp_06(spark, sf):
    return shown(multivariate.analyse_variables(S.fac(spark, sf)).samples, SEQ, "cluster")


@query("agg_16_cluster_summary", _recursive(sql(
    f"SELECT cluster::BIGINT AS cluster, sum(n)::BIGINT AS n, coalesce(arg_min(facies_label, ROW(-n, facies_label)) FILTER (facies_label IS NOT NULL), 'Mixta') AS dominant_facies, {r('sum(tds) / sum(n)', 'mean_tds')} "
    "FROM (SELECT cluster, facies_label, count(*) AS n, sum(tds) AS tds FROM clustered GROUP BY ALL) GROUP BY cluster", "fac", more=_CLUSTERS)))
def agg_16(spark, sf):
    return shown(multivariate.analyse_variables(S.fac(spark, sf)).clusters)


@query("imp_07_guards", sql(union([
    "SELECT 'samples' AS guard, CASE WHEN count(*) FILTER (WHERE Ca_mgL < 0) < 3 THEN 'insufficient' ELSE 'ok' END AS status, count(*) AS n FROM measured",
    "SELECT 'variables', 'insufficient', count(*) FROM measured",
    "SELECT 'variation', 'insufficient', count(*) FROM measured",
    "SELECT 'none', CASE WHEN count(*) < 3 THEN 'insufficient' ELSE 'ok' END, count(*) FROM measured",
]), "measured"))
def imp_07(spark, sf):
    """Too few samples, too few variables and no variation give a status instead of a result."""
    df = S.fac(spark, sf)
    few = ["Ca_mgL", "Mg_mgL"]
    others = [c for c in multivariate.FEATURES if c in df.columns and c not in few]
    cases = {
        "samples": df.filter("Ca_mgL < 0"),
        "variables": df.drop(*others),
        "variation": df.withColumns({c: F.lit(1.0) for c in [*few, *others]}),
        "none": df,
    }
    status = {k: multivariate.analyse_variables(x).status for k, x in cases.items()}
    counts = df.agg(F.count("*").alias("n"))
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("guard"), F.lit(v).alias("status")) for k, v in status.items()]))
    return shown(counts.select(rows, "n"))
