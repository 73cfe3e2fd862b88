"""Results out: Parquet, CSV, JSON, spreadsheet and HTML; larger ones than allowed are refused, never cut.

A Parquet export is written by all tasks. The others are single files for people, on the driver's disk, and bounded.
"""

from __future__ import annotations

import html
import json
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Row

from ..grain import RequestError

MOST_ROWS, REPORT_ROWS = 500_000, 80


def _rows(df: DataFrame, most: int = MOST_ROWS) -> Iterator[Row]:
    """The rows, a partition at a time, of a plan that runs once; one row too many is an error, however many follow."""
    for n, row in enumerate(df.limit(most + 1).toLocalIterator(prefetchPartitions=True)):
        if n == most:
            raise RequestError(f"an export has {most} rows at most")
        yield row


@contextmanager
def _whole(path: str, **how: Any) -> Iterator[Any]:
    """A file that is there under its name once it is whole."""
    part = Path(f"{path}.part")
    try:
        with part.open("w", encoding=how.pop("encoding", "utf-8"), **how) as f:
            yield f
        part.replace(path)
    finally:
        part.unlink(missing_ok=True)


def parquet(df: DataFrame, path: str) -> None:
    """A folder of files, written by all tasks; its schema is the DataFrame's."""
    df.write.mode("overwrite").parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """One file with a byte-order mark, for spreadsheets."""
    import csv as lib

    with _whole(path, encoding="utf-8-sig", newline="") as f:
        out = lib.writer(f)
        out.writerow(df.columns)
        for r in _rows(df):
            out.writerow(["" if v is None else v for v in r])


def as_json(df: DataFrame, path: str, metadata: dict[str, Any] | None = None) -> None:
    text = lambda v: json.dumps(v, default=str, ensure_ascii=False)
    with _whole(path) as f:
        f.write(f'{{"metadata": {text(metadata or {})}, "section": {{"columns": {text(df.columns)}, "rows": [')
        for n, r in enumerate(_rows(df)):
            f.write(", " * (n > 0) + text(r.asDict(recursive=True)))
        f.write("]}}")


def _cell(v: Any) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
        return f"<c><v>{v!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{html.escape(str(v))}</t></is></c>'


def _sheet(rows: list[list[Any]]) -> str:
    body = "".join("<row>" + "".join(map(_cell, r)) + "</row>" for r in rows)
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'


def xlsx(df: DataFrame, path: str, metadata: dict[str, Any] | None = None) -> None:
    """A workbook of two sheets, the data and what is known about it."""
    ns, office = "http://schemas.openxmlformats.org/", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names = ["Data", "Metadata"]
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{ns}package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in (1, 2)) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{ns}package/2006/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{ns}spreadsheetml/2006/main" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{ns}package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2)) + "</Relationships>",
        "xl/worksheets/sheet1.xml": _sheet([df.columns, *map(list, _rows(df))]),
        "xl/worksheets/sheet2.xml": _sheet([[k, v if isinstance(v, (int, float)) else str(v)] for k, v in (metadata or {}).items()]),
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text if text.startswith("<?xml") else '<?xml version="1.0" encoding="UTF-8"?>' + text)


def report(df: DataFrame, path: str, title: str) -> None:
    """A page with the first 80 rows and the number of all."""
    n = df.count()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in df.limit(REPORT_ROWS).collect())
    Path(path).write_text(f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><p>{n} rows</p><table><tr>{head}</tr>{body}</table>", encoding="utf-8")
