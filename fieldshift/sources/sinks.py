"""Result tables as files: CSV, a workbook, GeoJSON boxes, and a report in Markdown."""

from __future__ import annotations

import csv
import json
import zipfile
from collections.abc import Mapping
from datetime import datetime, timezone
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

#: Rows of a table that a workbook or report takes; larger tables go out as Parquet.
MOST_ROWS = 100_000
SHEET_NAME, COLUMN_WIDTH = 31, 48


def _rows(table: DataFrame, most: int = MOST_ROWS) -> list:
    rows = table.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write the table as Parquet")
    return rows


def write_csv(table: DataFrame, path: Path) -> None:
    with path.open("w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file)
        writer.writerow(table.columns)
        writer.writerows(map(tuple, _rows(table)))


def sheet_name(name: str) -> str:
    """A name that a workbook takes: no reserved marks, 31 characters at most."""
    return "".join("_" if c in "\\/*[]:?" else c for c in name)[:SHEET_NAME] or "sheet"


def shown(value: object) -> str:
    return "" if value is None else f"{value:.6g}" if isinstance(value, float) else str(value)


def _sheet(header: list[str], rows: list) -> str:
    def cell(v: object) -> str:
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t>{escape("" if v is None else str(v))}</t></is></c>'

    widths = [min(COLUMN_WIDTH, max(len(shown(r[i])) for r in [header, *rows]) + 2) for i in range(len(header))]
    columns = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [header, *rows])
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cols>{columns}</cols><sheetData>{body}</sheetData></worksheet>'


def write_workbook(path: Path, summary: Mapping[str, object], tables: Mapping[str, DataFrame]) -> None:
    """A sheet for the summary and one for each table."""
    sheets = {"summary": (["parameter", "value"], [(k, shown(v)) for k, v in summary.items()])}
    sheets |= {sheet_name(n): (t.columns, [tuple(r) for r in _rows(t)]) for n, t in tables.items()}
    base = "http://schemas.openxmlformats.org"
    kinds = "".join(
        f'<Override PartName="/xl/worksheets/s{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(sheets))
    )
    links = "".join(f'<Relationship Id="r{i}" Type="{base}/officeDocument/2006/relationships/worksheet" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets)))
    names = "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr(
            "[Content_Types].xml",
            f'<Types xmlns="{base}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
        )
        out.writestr("_rels/.rels", f'<Relationships xmlns="{base}/package/2006/relationships"><Relationship Id="r" Type="{base}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        out.writestr("xl/workbook.xml", f'<workbook xmlns="{base}/spreadsheetml/2006/main" xmlns:r="{base}/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        out.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{base}/package/2006/relationships">{links}</Relationships>')
        for i, (header, rows) in enumerate(sheets.values()):
            out.writestr(f"xl/worksheets/s{i}.xml", _sheet(list(header), rows))


def write_boxes(regions: DataFrame, path: Path) -> None:
    """Regions as GeoJSON boxes with their attributes."""
    features = []
    for r in _rows(regions):
        a, b, c, d = r.bbox_min_x, r.bbox_min_y, r.bbox_max_x, r.bbox_max_y
        ring = [[a, b], [c, b], [c, d], [a, d], [a, b]]
        features.append({"type": "Feature", "properties": r.asDict(), "geometry": {"type": "Polygon", "coordinates": [ring]}})
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, ensure_ascii=False), encoding="utf-8")


def write_report(path: Path, title: str, summary: Mapping[str, object], tables: Mapping[str, DataFrame], files: Mapping[str, Path]) -> None:
    """Parameters, tables and files in one Markdown document."""
    lines = [f"# {title}", "", datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M UTC"), "", "| parameter | value |", "|---|---|"]
    lines += [f"| {k} | {shown(v)} |" for k, v in summary.items()]
    for name, table in tables.items():
        lines += ["", f"## {name}", "", "| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
        lines += ["| " + " | ".join(shown(v) for v in r) + " |" for r in _rows(table)]
    lines += ["", "## Files", "", *[f"- {k}: {v}" for k, v in files.items()], ""]
    path.write_text("\n".join(lines), encoding="utf-8")
