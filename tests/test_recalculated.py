"""Values of every kind that formulas keep when a workbook is written again."""

import io
import re
import zipfile

from quillgrid.plans import convert
from quillgrid.sources import packages, sinks

FORMULAS = ['IF(1<2,"a<b","c")', "1<2", "1>2", "1/0", '""', '"5"', "2*3", "Z99"]
CELLS = [(r, 0, "formula", f, 0.0, None) for r, f in enumerate(FORMULAS)]


def _part(data: bytes, name: str) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return z.read(name).decode()


def test_xlsx_values_of_every_kind():
    data = convert.convert(sinks.xlsx_bytes({"S": CELLS}), "xlsx", "xlsx")
    got = re.findall(r'<c r="A[0-9]+"([^>]*)><f>[^<]*</f>(.*?)</c>', _part(data, "xl/worksheets/sheet1.xml"))
    assert got == [(' t="str"', "<v>a&lt;b</v>"), (' t="b"', "<v>1</v>"), (' t="b"', "<v>0</v>"), (' t="e"', "<v>#DIV/0!</v>"), (' t="str"', "<v></v>"), (' t="str"', "<v>5</v>"), ("", "<v>6.0</v>"), ("", "")]
    assert [c[2:] for c in packages.xlsx_cells(data)] == [(r, 0, "formula", f, 6.0 if f == "2*3" else None, None) for r, f in enumerate(FORMULAS)]


def test_ods_values_of_every_kind():
    data = convert.convert(sinks.xlsx_bytes({"S": CELLS}), "xlsx", "ods")
    cells = re.findall(r"<table:table-cell table:formula=[^>]*>.*?</table:table-cell>", _part(data, "content.xml"))
    kinds = [(re.findall(r'office:value-type="(\w+)"', c), re.findall(r'office:(?:value|boolean-value|string-value)="([^"]*)"', c), re.findall(r'calcext:value-type="(\w+)"', c)) for c in cells]
    assert kinds == [(["string"], ["a&lt;b"], []), (["boolean"], ["true"], []), (["boolean"], ["false"], []), (["string"], ["#DIV/0!"], ["error"]), (["string"], [""], []), (["string"], ["5"], []), (["float"], ["6.0"], []), ([], [], [])]
    assert [c[4:] for c in packages.ods_cells(data)] == [("formula", f, 6.0 if f == "2*3" else None, None) for f in FORMULAS]
