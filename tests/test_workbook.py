import zipfile

from limnos.sources.workbook import read_workbooks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def sheet(rows):
    out = []
    for r, cells in enumerate(rows, 1):
        items = []
        for c, (kind, value) in cells.items():
            if kind == "text":
                items.append(f'<c r="{c}{r}" t="inlineStr"><is><t>{value}</t></is></c>')
            elif kind == "shared":
                items.append(f'<c r="{c}{r}" t="s"><v>{value}</v></c>')
            else:
                items.append(f'<c r="{c}{r}" s="{1 if kind == "date" else 0}"><v>{value}</v></c>')
        out.append(f'<row r="{r}">{"".join(items)}</row>')
    return f"<worksheet {NS}><sheetData>{''.join(out)}</sheetData></worksheet>"


def test_best_sheet_is_read(spark, tmp_path):
    data = sheet([
        {"A": ("text", "campaign sheet")},
        {},
        {"A": ("shared", 0), "B": ("text", "Fecha"), "D": ("text", "Calcio (mg/L)")},
        {"A": ("text", "P-1"), "B": ("date", 45369), "D": ("number", 45.5)},
        {"A": ("text", "P-2"), "D": ("text", "&lt;0,05")},
    ])
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{REL}"><sheets><sheet name="Notes" r:id="r1"/><sheet name="Data" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>Estación</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s1.xml", sheet([{"A": ("text", "read me")}]))
        z.writestr("xl/worksheets/s2.xml", data)
    rows = read_workbooks(spark, str(tmp_path)).orderBy("row").select("station_code", "sampled_at", "Ca_mgL").collect()
    assert [tuple(r) for r in rows] == [("P-1", "2024-03-18 00:00:00", "45.5"), ("P-2", None, "<0,05")]


def test_books_are_opened_once(spark):
    """Sheets are chosen, formats found and rows read from lines that were written, not from the archives again."""
    from limnos.sources.workbook import book_cells, canonical_cells, workbooks

    opened = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            opened.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(i, f"S{i}", float(i)) for i in range(30)], "sample_seq long, station_code string, Ca_mgL double")
    books = workbooks(df, {"station_code": "Estación", "Ca_mgL": "Calcio (mg/L)"}, rows=10)
    books = books.mapInArrow(counted, "path string, content binary")
    got = canonical_cells(book_cells(books)).select("station_code", "Ca_mgL").collect()
    assert sorted((r[0], float(r[1])) for r in got) == sorted((f"S{i}", float(i)) for i in range(30))
    assert opened.value == 3
