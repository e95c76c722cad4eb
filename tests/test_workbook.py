import io
import zipfile

import pytest
from helpers import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.sources import workbook
from rollbook.sources.xlsx import number_text

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def make_workbook(sheets, strings=()):
    """Bytes of a workbook whose sheets are given as the XML of their rows."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        names = "".join(
            f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)
        )
        archive.writestr(
            "xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{LINK}"><sheets>{names}</sheets></workbook>'
        )
        links = "".join(
            f'<Relationship Id="r{i}" Type="x" Target="{"/xl/" if i == 1 else ""}worksheets/s{i}.xml"/>'
            for i in range(1, len(sheets) + 1)
        )
        archive.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            f"{links}</Relationships>",
        )
        for i, body in enumerate(sheets.values(), 1):
            archive.writestr(
                f"xl/worksheets/s{i}.xml",
                f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>',
            )
        if strings:
            items = "".join(f"<si>{s}</si>" for s in strings)
            archive.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{items}</sst>')
    return buffer.getvalue()


STRINGS = [
    "<t>Nama</t>",
    "<t> Peran </t>",
    '<r><t>ri</t></r><r><t xml:space="preserve">ch </t></r>',
    "<t> plain </t>",
]
HEADER = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c>'
    '<c r="C1" t="inlineStr"><is><t>N</t></is></c><c r="D1" t="str"><v>F x</v></c></row>'
)
FIRST = (
    HEADER
    + '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2" t="s"><v>3</v></c>'
    '<c r="C2"><v>45292</v></c><c r="D2"><f>1+1</f><v>2</v></c></row>'
    '<row r="4"><c r="B4" t="b"><v>1</v></c><c r="C4"><v>1.5e-7</v></c>'
    '<c r="D4" t="str"><f>x</f><v></v></c></row>'
    '<row r="5"/>'
)
SECOND = '<row><c t="inlineStr"><is><t>other</t></is></c></row><row><c><v>0.1</v></c></row>'

CELLS = {
    "a": [["[object Object]", " plain ", "45292", "[object Object]"], ["", "true", "1.5e-7", "[object Object]"]],
    "b": [["[object Object]", "plain", "45292", "[object Object]"], ["", "true", "1.5e-7", "[object Object]"]],
    "c": [["rich", "plain", "45292", ""], ["", "true", "1.5e-7", ""]],
    "d": [[None, " plain ", "45292", "2"], [None, "true", "1.5e-7", None]],
    "e": [["rich ", " plain ", "45292", "2"], ["", "true", "1.5e-7", "[object Object]"]],
}


@pytest.fixture
def book(tmp_path):
    path = tmp_path / "book.xlsx"
    path.write_bytes(make_workbook({"One": FIRST, "Two": SECOND}, STRINGS))
    return str(path)


@pytest.mark.parametrize("rule", CELLS)
def test_cell_rules(spark, book, rule):
    found = sorted(workbook.workbook_rows(spark, book, rule).collect(), key=lambda r: r["row_no"])
    assert [r["row_no"] for r in found] == [2, 4]
    assert {r["sheet"] for r in found} == {"One"}
    assert found[0]["header"] == ["Nama", " Peran ", "N", "F x"]
    assert [r["cells"] for r in found] == CELLS[rule]


def test_all_sheets(spark, book):
    found = workbook.workbook_rows(spark, book, "e", "all").filter("sheet_no = 2").collect()
    assert [(r["sheet"], r["header"], r["row_no"], r["cells"]) for r in found] == [
        ("Two", ["other"], 2, ["0.1"])
    ]


@pytest.mark.parametrize(("rule", "sheets"), [("z", "first"), ("a", "second")])
def test_bad_arguments(spark, book, rule, sheets):
    with pytest.raises(ValueError):
        workbook.workbook_rows(spark, book, rule, sheets)


@pytest.mark.parametrize(
    ("value", "text"),
    [
        (5.0, "5"),
        (-0.5, "-0.5"),
        (1e16, "10000000000000000"),
        (1e21, "1e+21"),
        (1e-5, "0.00001"),
        (1.25e-7, "1.25e-7"),
        (0.1 + 0.2, "0.30000000000000004"),
    ],
)
def test_number_text(value, text):
    assert number_text(value) == text


def test_by_position(spark, book):
    rows_in = workbook.workbook_rows(spark, book, "d")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in "abcd"])
    table = workbook.rows_to_table(rows_in, schema)
    assert [r["c"] for r in table.orderBy("source_order").collect()] == ["45292", "1.5e-7"]
    narrow = T.StructType(schema.fields[:3])
    with pytest.raises(Exception, match="wrong number of cells"):
        workbook.rows_to_table(rows_in, narrow).collect()


def test_by_name(spark, book):
    rows_in = workbook.workbook_rows(spark, book, "c")
    found = workbook.rows_by_name(rows_in, ["peran", "nama", "alamat"], on_unknown="drop")
    assert rows(found.drop("source_order")) == [("plain", "rich", None), ("true", "", None)]
    with pytest.raises(Exception, match="not allowed"):
        workbook.rows_by_name(rows_in, ["peran", "nama"]).collect()
    with pytest.raises(Exception, match="not allowed"):
        workbook.rows_by_name(rows_in, ["alamat"], on_unknown="drop").collect()


def test_many_files_each_by_its_header(spark, tmp_path):
    for number, names in enumerate((["nama", "peran"], ["peran", "nama"])):
        header = "".join(f'<c t="inlineStr"><is><t>{n}</t></is></c>' for n in names)
        cells = "".join(f'<c t="inlineStr"><is><t>{n}{number}</t></is></c>' for n in names)
        body = f"<row>{header}</row><row>{cells}</row>"
        (tmp_path / f"{number}.xlsx").write_bytes(make_workbook({"S": body}))
    found = workbook.rows_by_name(
        workbook.workbook_rows(spark, str(tmp_path), "c"), ["nama", "peran"]
    )
    assert rows(found, "nama", "peran") == [("nama0", "peran0"), ("nama1", "peran1")]


def test_sheet_without_header_fails(spark, tmp_path):
    (tmp_path / "x.xlsx").write_bytes(make_workbook({"S": '<row r="2"><c><v>1</v></c></row>'}))
    with pytest.raises(Exception, match="no header row"):
        workbook.workbook_rows(spark, str(tmp_path)).collect()


def test_cells_beyond_the_header_fail(spark, tmp_path):
    path = tmp_path / "wide.xlsx"
    wide = HEADER + '<row r="2"><c r="A2"><v>1</v></c><c r="E2"><v>9</v></c></row>'
    path.write_bytes(make_workbook({"S": wide}, STRINGS))
    with pytest.raises(Exception, match="beyond its header"):
        workbook.workbook_rows(spark, str(path)).collect()
