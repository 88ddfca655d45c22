from __future__ import annotations

SMALL = "/root/testdata/sf0.001"


def same_rows(spark_df, duck_relation) -> None:
    """Both sides hold the same rows, whatever the order."""
    names = sorted(spark_df.columns)

    def plain(v):
        if isinstance(v, float):
            return None if v != v else float(f"{v:.9g}")
        return v if v is None or isinstance(v, (str, bool, int)) else float(v) if hasattr(v, "as_tuple") else str(v)

    ours = sorted((tuple(plain(r[n]) for n in names) for r in spark_df.collect()), key=repr)
    at = [list(duck_relation.columns).index(n) for n in names]
    assert sorted(duck_relation.columns) == names
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in duck_relation.fetchall()), key=repr)
    assert ours == theirs


def workbook_bytes(sheets: dict[str, list[str]]) -> bytes:
    """A workbook whose sheets' rows are given as XML; style 1 is a date, style 2 a date with its own format."""
    import io
    import zipfile

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {space}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>Name</t></si><si><r><t>An</t></r><r><t>na</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {space}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {space}><sheetData>" + "".join(rows) + "</sheetData></worksheet>")
    return out.getvalue()


SHEET = [
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Count</t></is></c><c r="D1" t="str"><v>Day</v></c><c r="E1" t="inlineStr"><is><t>At</t></is></c><c r="F1" t="inlineStr"><is><t>Yes</t></is></c><c r="G1" t="inlineStr"><is><t>Share</t></is></c></row>',
    '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>12</v></c><c r="D2" s="1"><v>45296</v></c><c r="E2" s="2"><v>45296.5</v></c><c r="F2" t="b"><v>1</v></c><c r="G2"><v>0.5</v></c></row>',
    '<row r="3"/>',
    '<row r="4"><c r="A4" t="inlineStr"><is><t>Bo, &quot;B&quot;</t></is></c><c r="B4"><v>1E3</v></c><c r="D4" s="1"><v>45297</v></c><c r="E4" s="2"><v>45297.25</v></c><c r="F4" t="b"><v>0</v></c><c r="G4" t="e"><v>#DIV/0!</v></c></row>',
]
