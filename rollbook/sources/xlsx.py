"""The XLSX format: cells and rows of one workbook.

Plain Python for use inside tasks; Spark spreads the workbooks.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from decimal import Decimal
from xml.etree import ElementTree

from rollbook.functions.text import JS_WHITESPACE

# Namespaces of the file format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_OBJECT_TEXT = "[object Object]"

# --- cells ---------------------------------------------------------------
# A cell is None, a scalar (str, bool, float) or a dict with some of the keys
# "text", "richText", "formula" and "result".


def _as_text(value: object) -> str:
    """The text a scalar has in the source system."""
    if value is None:
        return ""
    if isinstance(value, dict):
        return _OBJECT_TEXT
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return number_text(value)
    return str(value)


def number_text(value: float) -> str:
    if abs(value) >= 1e21 or 0 < abs(value) < 1e-6:
        return re.sub(r"e([+-])0*(\d)", r"e\1\2", repr(value))
    return str(int(value)) if value == int(value) else format(Decimal(repr(value)), "f")


def _rich_text(value: dict) -> str:
    return "".join(value.get("richText") or [])


def _rule_plain(value: object) -> str:
    return _as_text(value)


def _rule_trimmed(value: object) -> str:
    return _as_text(value).strip(JS_WHITESPACE)


def _rule_rich(value: object) -> str:
    if isinstance(value, dict):
        value = value.get("text") or _rich_text(value)
    return _as_text(value).strip(JS_WHITESPACE)


def _rule_nullable(value: object) -> str | None:
    if isinstance(value, dict):
        value = value.get("text") or value.get("result") or None
    return None if value is None or value == "" else _as_text(value)


def _rule_extract(value: object) -> str:
    if isinstance(value, dict):
        for shown in (_rich_text(value), value.get("text"), value.get("result")):
            if shown:
                return _as_text(shown)
    return _as_text(value)


CELL_RULES: dict[str, Callable[[object], str | None]] = {
    "a": _rule_plain,
    "b": _rule_trimmed,
    "c": _rule_rich,
    "d": _rule_nullable,
    "e": _rule_extract,
}


# --- reading -------------------------------------------------------------


def read_workbook(path: str, content: bytes, rule: Callable, all_sheets: bool) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        strings, data_row = _shared_strings(archive), 0
        for sheet_no, (sheet, member) in enumerate(_sheets(archive), 1):
            header: list[str] | None = None
            with archive.open(member) as stream:
                for row_no, cells in _sheet_rows(stream, strings):
                    if row_no == 1:
                        header = [_as_text(c) for c in cells]
                        continue
                    if header is None:
                        raise ValueError(f"sheet {sheet!r} of {path} has no header row")
                    if any(_as_text(c) for c in cells[len(header) :] if c is not None):
                        raise ValueError(f"row {row_no} of {path} has cells beyond its header")
                    padded = cells[: len(header)] + [None] * (len(header) - len(cells))
                    texts = [rule(c) for c in padded]
                    numeric = [isinstance(c, float) for c in padded]
                    data_row += 1
                    yield path, sheet, sheet_no, row_no, data_row, header, texts, numeric
            if not all_sheets:
                return


def _sheets(archive: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    links = {
        link.get("Id"): link.get("Target")
        for link in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels")).iter(
            f"{_PACKAGE}Relationship"
        )
    }
    for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = links[sheet.get(f"{_LINK}id")]
        yield sheet.get("name"), posixpath.normpath(posixpath.join("/xl", target)).lstrip("/")


def _shared_strings(archive: zipfile.ZipFile) -> list[object]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    with archive.open("xl/sharedStrings.xml") as stream:
        return [_string_item(e) for e in _finished(stream, f"{_MAIN}si")]


def _sheet_rows(stream, strings: list[object]) -> Iterator[tuple[int, list[object]]]:
    last = 0
    for row in _finished(stream, f"{_MAIN}row"):
        last = int(row.get("r") or last + 1)
        cells: list[object] = []
        for cell in row.findall(f"{_MAIN}c"):
            column = _column_number(cell.get("r")) if cell.get("r") else len(cells) + 1
            cells += [None] * (column - 1 - len(cells))
            cells.append(_cell_value(cell, strings))
        if cells:
            yield last, cells


def _finished(stream, tag: str) -> Iterator[ElementTree.Element]:
    """Elements as they end, each freed after use."""
    context = ElementTree.iterparse(stream, events=("start", "end"))
    _, root = next(context)
    for event, element in context:
        if event == "end" and element.tag == tag:
            yield element
            element.clear()
            if element is not root:
                _drop_children(root)


def _drop_children(root: ElementTree.Element) -> None:
    holder = root.find(f"{_MAIN}sheetData")
    (root if holder is None else holder).clear()


def _cell_value(cell: ElementTree.Element, strings: list[object]) -> object:
    kind = cell.get("t", "n")
    text = cell.findtext(f"{_MAIN}v")
    if kind == "s":
        value = strings[int(text)] if text is not None else None
    elif kind == "inlineStr":
        inline = cell.find(f"{_MAIN}is")
        value = None if inline is None else _string_item(inline)
    elif text is None:
        value = None
    elif kind == "b":
        value = text == "1"
    elif kind == "n":
        value = float(text)
    else:  # formula text, errors and ISO dates keep their text
        value = text
    formula = cell.find(f"{_MAIN}f")
    return value if formula is None else {"formula": formula.text or "", "result": value}


def _string_item(item: ElementTree.Element) -> object:
    runs = item.findall(f"{_MAIN}r")
    if runs:
        return {"richText": [r.findtext(f"{_MAIN}t") or "" for r in runs]}
    return item.findtext(f"{_MAIN}t") or ""


def _column_number(reference: str) -> int:
    number = 0
    for char in reference:
        if not char.isalpha():
            break
        number = number * 26 + ord(char.upper()) - ord("A") + 1
    return number
