"""A tiny workbook writer for the tests: cells as (kind, value) or plain text."""

import zipfile
from xml.sax.saxutils import escape

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _name(i):
    out = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(row, col, value, shared):
    ref = f"{_name(col)}{row + 1}"
    kind, value = value if isinstance(value, tuple) else ("s", value)
    if kind == "s":
        shared.append(value)
        return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
    if kind == "inline":
        return f'<c r="{ref}" t="inlineStr"><is><r><t>{escape(value)}</t></r></is></c>'
    if kind == "date":
        return f'<c r="{ref}" s="1"><v>{value}</v></c>'
    if kind == "custom":
        return f'<c r="{ref}" s="2"><v>{value}</v></c>'
    if kind == "formula":
        return f'<c r="{ref}" t="str"><f>A1</f><v>{escape(value)}</v></c>'
    if kind == "n":
        return f'<c r="{ref}"><v>{value}</v></c>'
    return f'<c r="{ref}" t="{kind}"><v>{value}</v></c>'


def write(path, sheets, states=None, broken=()):
    """``sheets``: {name: {(row, col): cell}}."""
    shared, parts = [], {}
    for n, (name, cells) in enumerate(sheets.items(), 1):
        rows = {}
        for (r, c), v in cells.items():
            rows.setdefault(r, []).append((c, v))
        body = "".join(
            f'<row r="{r + 1}">' + "".join(_cell(r, c, v, shared) for c, v in sorted(rows[r], key=lambda x: x[0])) + "</row>"
            for r in sorted(rows)
        )
        text = f'<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>'
        parts[f"xl/worksheets/sheet{n}.xml"] = text[:-30] if name in broken else text
    listed = "".join(
        f'<sheet name="{escape(name)}" sheetId="{n}" state="{(states or {}).get(name, "visible")}" r:id="rId{n}"/>'
        for n, name in enumerate(sheets, 1)
    )
    parts["xl/workbook.xml"] = f"<workbook {MAIN} {REL}><sheets>{listed}</sheets></workbook>"
    links = "".join(f'<Relationship Id="rId{n}" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'
    items = "".join(f"<si><t>{escape(s)}</t></si>" for s in shared)
    parts["xl/sharedStrings.xml"] = f"<sst {MAIN}>{items}</sst>"
    parts["xl/styles.xml"] = (
        f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="0.0&quot;days&quot;"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>'
    )
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for part, text in parts.items():
            book.writestr(part, text)


def table(rows):
    return {(r, c): v for r, row in enumerate(rows) for c, v in enumerate(row) if v != ""}
