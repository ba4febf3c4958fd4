"""Workbooks made by hand: shared, rich and inline strings, dates, gaps, several sheets, broken files."""

import zipfile

import pytest

from sunfold.sources import excel, files

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
STYLES = f'<styleSheet {MAIN}><numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy-mm-dd hh:mm"/><numFmt numFmtId="165" formatCode="0.0&quot; day&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="22"/><xf numFmtId="165"/></cellXfs></styleSheet>'


def workbook(path, rows, shared=()):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" sheetId="7" r:id="rId3"/><sheet name="B" sheetId="8" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/other.xml"/><Relationship Id="rId3" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/other.xml", f"<worksheet {MAIN}><sheetData><row><c><v>9</v></c></row></sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/styles.xml", STYLES)
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")


HEAD = '<row r="1">' + "".join(f'<c r="{c}1" t="s"><v>{i}</v></c>' for i, c in enumerate("ABCDEF")) + "</row>"
NAMES = ["<t>Time</t>", "<r><t>Power </t></r><r><t>(kW)</t></r>", "<t>I</t>", "<t>T</t>", "<t>Pre</t>", "<t>Hum</t><rPh><t>x</t></rPh>"]
BODY = '<row r="2"><c r="A2" s="1"><v>45444.010416666664</v></c><c r="B2"><v>500.5</v></c><c r="D2" t="inlineStr"><is><t>21</t></is></c><c r="E2" s="3"><v>1001</v></c><c r="F2" t="str"><v>50</v></c></row><row r="4"><c r="A4" s="2"><v>45444.5</v></c><c r="B4" t="e"><v>#N/A</v></c><c r="C4"/><c r="F4"><v>130</v></c></row>'


def test_rows_of_a_sheet(tmp_path):
    workbook(tmp_path / "a.xlsx", HEAD + BODY, NAMES)
    rows = list(excel.sheet_rows((tmp_path / "a.xlsx").read_bytes()))
    assert rows[0] == ["Time", "Power (kW)", "I", "T", "Pre", "Hum"]
    assert rows[1:] == [["2024-06-01 00:15:00", "500.5", None, "21", "1001", "50"], ["2024-06-01 12:00:00", "#N/A", None, None, None, "130"]]
    assert excel._place("A1") == 0 and excel._place("AB12") == 27
    for broken in (b"", b"PK\x03\x04 no zip", (tmp_path / "a.xlsx").read_bytes()[:200]):
        with pytest.raises(ValueError):
            list(excel.sheet_rows(broken))


def test_stations_from_workbooks(spark, tmp_path):
    workbook(tmp_path / "north 1.xlsx", HEAD + BODY, NAMES)
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    (tmp_path / "south.csv").write_text("timestamp,P,I,T,Pre,Hum\n2024-06-01 00:00:00,900,300,22,1005,40\n")
    df, failed = files.read_stations(spark, [str(tmp_path) + "/"])
    rows = {(r["station"], r["ts"].hour): r for r in df.collect()}
    assert rows["north 1", 0]["power"] == 500.5 and rows["north 1", 0]["temperature"] == 21 and rows["north 1", 12]["power"] is None and rows["north 1", 12]["humidity"] == 100
    assert rows["south", 0]["power"] == 900 and len(failed) == 1 and "bad" in next(iter(failed))
    with pytest.raises(ValueError):
        files.read_station(spark, str(tmp_path / "x.xls"))
