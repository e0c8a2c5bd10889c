"""Spreadsheets written here by the format's description and read back, and sums of counters."""

import zipfile
from xml.sax.saxutils import escape

import pytest

from wayfold.sources import counters, sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def cell(place, value):
    if value is None:
        return f'<c r="{place}"/>'
    if isinstance(value, tuple):  # (type, content)
        kind, text = value
        return f'<c r="{place}" t="inlineStr"><is><t>{escape(text)}</t></is></c>' if kind == "inlineStr" else f'<c r="{place}" t="{kind}"><v>{escape(text)}</v></c>'
    return f'<c r="{place}"><v>{value}</v></c>'


def book(path, tables, strings=()):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(tables, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(tables) + 1)) + "</Relationships>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        for k, rows in enumerate(tables.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(cell(f"{c}{r}", v) for c, v in cells.items()) + "</row>" for r, cells in rows.items())
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")


def test_rows_of_a_sheet(spark, tmp_path):
    strings = ["<t>name</t>", "<r><t>two </t></r><r><t>runs</t></r><rPh><t>hint</t></rPh>", '<t xml:space="preserve"> é &amp; x </t>']
    table = {2: {"A": ("s", "0"), "C": ("inlineStr", " flag "), "AA": ("str", "wide")}, 3: {"A": ("s", "1"), "C": ("b", "1"), "AA": 2.5, "B": 9}, 5: {"A": ("s", "2"), "C": ("e", "#N/A"), "AA": None}, 6: {}}
    book(tmp_path / "a.xlsx", {"other": {1: {"A": 1}}, "T & co": table}, strings)
    got = {r["row"]: r["cells"] for r in sheets.rows(spark, str(tmp_path), sheet="T & co").collect()}
    assert got == {3: {"name": "two runs", "flag": "true", "wide": "2.5"}, 5: {"name": " é & x "}, 6: {}}
    assert sheets.rows(spark, str(tmp_path)).count() == 0  # the first sheet has names only
    with pytest.raises(Exception, match="no sheet"):
        sheets.rows(spark, str(tmp_path), sheet="none").collect()


def test_tracks_from_sheets(spark, tmp_path):
    names = dict(zip("ABCDE", (("inlineStr", n) for n in ("dataTime", "longitude", "latitude", "stepType", "note"))))
    rows = {k + 2: {"A": 1_700_000_000 + k, "B": 113.5, "C": ("str", "22.25" if k % 3 else "bad"), "D": ("str", ["0", "0.0", "1", "x"][k % 4]), "E": 7} for k in range(12_000)}
    book(tmp_path / "a.xlsx", {"s": {1: names, **rows, 20_000: {"D": 0}}})
    book(tmp_path / "b.xlsm", {"s": {1: {"A": ("inlineStr", "dataTime"), "B": ("inlineStr", "speed")}, 2: {"A": 5, "B": 1.5}, 3: {"A": 6.9}}})
    (tmp_path / "c.xlsx").write_bytes(b"PK broken")
    (tmp_path / "d.txt").write_text("no sheet")
    found = sheets.track_sheet(spark, str(tmp_path), mode="permissive").collect()
    own = [r for r in found if r["file"].endswith("a.xlsx")]
    assert [r["row"] for r in own] == [k + 2 for k in range(12_000) if k % 4 < 2]
    assert all(r["latitude"] == (22.25 if (r["row"] - 2) % 3 else None) and r["longitude"] == 113.5 and r["speed"] is None for r in own)
    assert sorted((r["dataTime"], r["speed"]) for r in found if r["file"].endswith("b.xlsm")) == [(5, 1.5), (6, None)]
    assert [r["file"][-6:] for r in sheets.rows(spark, str(tmp_path), mode="permissive").where("error is not null").collect()] == ["c.xlsx"]
    with pytest.raises(Exception, match="c.xlsx"):
        sheets.track_sheet(spark, str(tmp_path)).collect()


def test_sums_of_counters(spark):
    import datetime as d

    day = [d.date(2024, 1, k) for k in (1, 2, 3)]
    counted = spark.createDataFrame([(day[0], "lbcount", 5.0), (day[0], "71", 2.0), (day[0], "83", 1.0), (day[1], "hwheel", 4.0), (day[1], "wheel", 1.0), (day[2], "30", 8.0), (day[2], "lbcount", 1.0)], "date date, name string, value double")
    sums = {(r["date"].day, r["group"]): r["total"] for r in counters.group_sums(counted).collect()}
    assert sums == {(1, "numpad"): 3.0, (1, "buttons"): 5.0, (1, "wheels"): 0.0, (2, "numpad"): 0.0, (2, "buttons"): 0.0, (2, "wheels"): 5.0, (3, "numpad"): 0.0, (3, "buttons"): 1.0, (3, "wheels"): 0.0}
    totals = {r["name"]: (r["days"], r["first_date"].day, r["last_date"].day, r["total"]) for r in counters.counter_totals(counted).collect()}
    assert totals["lbcount"] == (2, 1, 3, 6.0) and totals["71"] == (1, 1, 1, 2.0) and len(totals) == 6
    assert counters.group_sums(counted.limit(0)).collect() == [] == counters.counter_totals(counted.limit(0)).collect()
