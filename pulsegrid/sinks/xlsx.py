"""Summaries as worksheets: metrics and events down, entities across."""

from __future__ import annotations

import math
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame

NUMBER_FORMAT = "#,##0.0000"


def sheet_name(name: str) -> str:
    """Excel allows 31 characters."""
    return (name.replace("__edp_", "", 1) if len(name) > 31 else name)[:31]


def heading(key: str, level: str, modules: bool = False) -> str:
    """The column title of an entity."""
    parts = key.split("_")
    if level == "socket":
        return f"Socket {key}"
    if level == "core":
        return f"Socket {parts[0]} Module {parts[1]} Core {parts[2]}" if modules and len(parts) == 3 else f"Socket {parts[0]} Core {parts[-1]}"
    if level == "thread":
        return f"Core {key}"
    if level == "uncore":
        return f"Socket {parts[0]} Unit {parts[-1]}"
    return key


def table(summary: DataFrame, level: str = "system", modules: bool = False) -> list[list]:
    """Rows of a sheet; a summary has a row for each entity, so it is small."""
    rows = [list(r) for r in summary.collect()]
    if level != "system":
        rows.sort(key=lambda r: [int(x) if x.isdigit() else -1 for x in str(r[0]).split("_")])
    out = [["metrics + events", *(heading(str(r[0]), level, modules) for r in rows)]]
    return out + [[c, *(r[i] for r in rows)] for i, c in enumerate(summary.columns) if i]


def letters(n: int) -> str:
    return (letters(n // 26 - 1) if n > 25 else "") + chr(65 + n % 26)


def _cell(row: int, at: int, v) -> str:
    if v is None or isinstance(v, float) and not math.isfinite(v):
        return ""
    if isinstance(v, (int, float)):
        return f'<c r="{letters(at)}{row}" s="1"><v>{v!r}</v></c>'
    text = escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))
    return f'<c r="{letters(at)}{row}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def write_xlsx(path: str, sheets: dict[str, list[list]]) -> None:
    """Write sheets (name to rows); the first row becomes the header of an Excel table."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pkg, ct = "http://schemas.openxmlformats.org/package/2006/relationships", "http://schemas.openxmlformats.org/package/2006/content-types"
    kind, n = "application/vnd.openxmlformats-officedocument.spreadsheetml", len(sheets)
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/tables/table{i}.xml" ContentType="{kind}.table+xml"/>' for i in range(1, n + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{ct}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pkg}"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = [sheet_name(s) for s in sheets]
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pkg}">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1)) + f'<Relationship Id="rId{n + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{main}"><numFmts count="1"><numFmt numFmtId="164" formatCode="{NUMBER_FORMAT}"/></numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values(), 1):
            wide = max(map(len, rows))
            ref = f"A1:{letters(wide - 1)}{max(2, len(rows))}"
            body = "".join(f'<row r="{r}">' + "".join(_cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            widths = "".join(f'<col min="{c + 1}" max="{c + 1}" width="{min(80, max(len(str(r[c])) if c < len(r) and not isinstance(r[c], float) else 14 for r in rows) + 2)}" customWidth="1"/>' for c in range(wide))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}" xmlns:r="{rel}"><cols>{widths}</cols><sheetData>{body}</sheetData><tableParts count="1"><tablePart r:id="rId1"/></tableParts></worksheet>')
            z.writestr(f"xl/worksheets/_rels/sheet{i}.xml.rels", f'{head}<Relationships xmlns="{pkg}"><Relationship Id="rId1" Type="{rel}/table" Target="../tables/table{i}.xml"/></Relationships>')
            heads = "".join(f"<tableColumn id=\"{c + 1}\" name={quoteattr(str(v))}/>" for c, v in enumerate(rows[0]))
            z.writestr(f"xl/tables/table{i}.xml", f'{head}<table xmlns="{main}" id="{i}" name="Table{i}" displayName="Table{i}" ref="{ref}"><autoFilter ref="{ref}"/><tableColumns count="{wide}">{heads}</tableColumns></table>')
