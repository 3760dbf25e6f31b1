"""Word documents as a source and a sink (SRC-3, SNK-1), on the standard library alone.

Files come through Spark's binary source, so any file system that Spark reads will do, and are parsed in Arrow batches.
The sink makes a binary column, one archive for a document, which any Spark writer can store.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from typing import NamedTuple
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from parchwork.functions.dialect import round_half_up
from parchwork.functions.presentation import script_runs, standard
from parchwork.functions.text import MARKER

# Names of the format, style names of heading levels, defaults.
NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
W = "{" + NAMESPACE + "}"
STYLES: tuple[tuple[str, tuple[str, ...]], ...] = (("heading1", ("title", "h1")), ("heading2", ("subtitle", "h2")), ("heading3", ("h3",)), ("heading4", ("h4",)))
DEFAULT_TITLE, PLAIN_BREAK, CHARS_PER_PAGE = "مستند Word", "------------------------", 1500
_GAPS = re.compile(r"\n{3,}")


class Paragraph(NamedTuple):
    text: str
    markdown: str
    level: int
    bullet: str
    breaks: bool


class Document(NamedTuple):
    title: str
    markdown: str
    plain_text: str
    paragraphs: list[str]
    tables: list[list[list[str]]]
    pages: int
    notes: dict[str, str]


def notes_of(xml: bytes) -> dict[str, str]:
    """Note texts by id, without separators."""
    found = {}
    for note in ElementTree.fromstring(xml).iter(W + "footnote"):
        if note.get(W + "type") not in ("separator", "continuationSeparator") and note.get(W + "id"):
            found[note.get(W + "id")] = "".join(note.itertext()).strip()
    return found


def paragraph(p: ElementTree.Element, notes: dict[str, str]) -> Paragraph:
    """Only runs directly in the paragraph are read."""
    style = next(p.iter(W + "pStyle"), None)
    name = (style.get(W + "val") or "").lower() if style is not None else ""
    level = next((k for k, (part, names) in enumerate(STYLES, 1) if part in name or name in names), 0)
    bullet = ""
    if (number := next(p.iter(W + "numPr"), None)) is not None:
        depth = next(number.iter(W + "ilvl"), None)
        bullet = "1." if depth is not None and depth.get(W + "val") == "0" else "*"
    text, marked, breaks = [], [], False
    for run in p.findall(W + "r"):
        said = "".join(t.text or "" for t in run.iter(W + "t"))
        breaks |= any(b.get(W + "type") == "page" for b in run.iter(W + "br")) or next(run.iter(W + "lastRenderedPageBreak"), None) is not None
        ref = next(run.iter(W + "footnoteReference"), None)
        if ref is not None and notes.get(ref.get(W + "id") or ""):
            said += f" [^{ref.get(W + 'id')}]"
        text.append(said)
        style = run.find(W + "rPr")
        stars = "*" * (2 * (style is not None and style.find(W + "b") is not None) + (style is not None and style.find(W + "i") is not None)) if said.strip() else ""
        marked.append(stars + said + stars)
    return Paragraph("".join(text), "".join(marked), level, bullet, breaks)


def table_cells(table: ElementTree.Element, notes: dict[str, str]) -> list[list[str]]:
    """Rows of cell texts; nested tables' rows count too, blank rows don't."""
    rows = [[" ".join(s for p in cell.iter(W + "p") if (s := paragraph(p, notes).markdown.strip())) for cell in row.iter(W + "tc")] for row in table.iter(W + "tr")]
    return [r for r in rows if any(c.strip() for c in r)]


def markdown_table(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(c.replace("|", "\\|").strip() for c in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([*lines[:1], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) if rows else ""


@pandas_udf(T.StringType())
def markdown_tables(tables: pd.Series) -> pd.Series:
    """`markdown_table` of a column of arrays of arrays of cells; null cells are empty."""
    return tables.map(lambda rows: markdown_table([[c or "" for c in r] for r in rows]), na_action="ignore")


def parse(data: bytes) -> Document:
    """A document of its bytes. Raises ValueError if they are no Word document."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(W + "body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError("no Word document") from e
    if body is None:
        raise ValueError("no Word document")
    notes: dict[str, str] = {}
    try:
        notes = notes_of(archive.read("word/footnotes.xml"))
    except (KeyError, ElementTree.ParseError):
        pass
    markdown, plain, paragraphs, tables, title = [], [], [], [], ""
    for node in body:
        if node.tag == W + "p":
            p = paragraph(node, notes)
            if p.breaks:
                markdown.append(MARKER)
                plain.append(PLAIN_BREAK)
            if not p.text.strip():
                markdown.append("")
                plain.append("")
                continue
            paragraphs.append(p.text.strip())
            lead = "#" * p.level if p.level else p.bullet
            markdown.append(f"{lead} {p.markdown}" if lead else p.markdown)
            plain.append(f"{p.bullet} {p.text}" if p.bullet and not p.level else p.text)
            if p.level in (1, 2) and not title:
                title = p.text.strip()
        elif node.tag == W + "tbl" and (cells := table_cells(node, notes)):
            tables.append(cells)
            markdown += ["", markdown_table(cells), ""]
            plain += ["", "\n".join(" | ".join(r) for r in cells), ""]
    text = _GAPS.sub("\n\n", "\n".join(markdown)).strip()
    breaks = text.count(MARKER)
    pages = breaks + 1 if breaks else max(1, int(len(text) / CHARS_PER_PAGE + 0.5))
    return Document(title or DEFAULT_TITLE, text, _GAPS.sub("\n\n", "\n".join(plain)).strip(), paragraphs, tables, pages, notes)


def page_estimate(markdown: Column) -> Column:
    breaks = F.regexp_count(markdown, F.lit(MARKER))
    return F.when(breaks > 0, breaks + 1).otherwise(F.greatest(F.lit(1), round_half_up(F.length(markdown) / CHARS_PER_PAGE))).cast("int")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path, title, markdown, plain_text, paragraphs, tables, pages, notes, and error (null if the file could be read) of each file."""
    fields = [("title", pa.string()), ("markdown", pa.string()), ("plain_text", pa.string()), ("paragraphs", pa.list_(pa.string())), ("tables", pa.list_(pa.list_(pa.list_(pa.string())))), ("pages", pa.int32()), ("notes", pa.map_(pa.string(), pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for data in batch.column("content").to_pylist():
                try:
                    found.append(parse(data))
                    errors.append(None)
                except ValueError as e:
                    found.append(None)
                    errors.append(str(e))
            columns = [pa.array([None if d is None else list(d.notes.items()) if n == "notes" else getattr(d, n) for d in found], t) for n, t in fields]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *columns, pa.array(errors, pa.string())], names=["path", *(n for n, _ in fields), "error"])

    schema = "path string, title string, markdown string, plain_text string, paragraphs array<string>, tables array<array<array<string>>>, pages int, notes map<string,string>, error string"
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, schema)


# Writing -----------------------------------------------------------------------------------------------------------
_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/footnotes.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.footnotes+xml"/></Types>'
_RELATIONS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/></Relationships>'
_NOTE = re.compile(r"^\[\^([^\]]+)\]:\s*(.*)$", re.MULTILINE)
_INLINE = re.compile(r"\*\*(.+?)\*\*|\*(.+?)\*|`(.+?)`|\[\^([^\]]+)\]|([^*`\[]+|[*`\[])", re.DOTALL)
_STARTED = dict(date_time=(1980, 1, 1, 0, 0, 0))


def _runs(text: str, rtl: bool, notes: dict[str, int]) -> str:
    out = []
    for bold, italic, code, ref, plain in _INLINE.findall(text):
        if ref and ref in notes:
            out.append(f'<w:r><w:footnoteReference w:id="{notes[ref]}"/></w:r>')
            continue
        style = "<w:b/>" * bool(bold) + "<w:i/>" * bool(italic) + '<w:rFonts w:ascii="Consolas"/>' * bool(code)
        said = bold or italic or code or (f"[^{ref}]" if ref else plain)
        for part, arabic in script_runs(said) if rtl and not code else [(said, False)]:
            marks = style + "<w:rtl/>" * arabic
            out.append(f'<w:r>{f"<w:rPr>{marks}</w:rPr>" if marks else ""}<w:t xml:space="preserve">{escape(part)}</w:t></w:r>')
    return "".join(out)


def _p(runs: str, rtl: bool, style: str = "", more: str = "") -> str:
    return f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}{more}{"<w:bidi/>" * rtl}</w:pPr>{runs}</w:p>'


def compose(markdown: str, rtl: bool = True) -> bytes:
    """A Word document of markdown: headings, lists, tables, notes, page breaks; right to left if asked. The same text gives the same bytes."""
    text = standard(markdown)
    found = _NOTE.findall(text)
    notes = {ref: k for k, (ref, _) in enumerate(found, 1)}
    body, table, fence = [], [], False

    def flush() -> None:
        if table:
            width = max(map(len, table))
            rows = "".join("<w:tr>" + "".join(f"<w:tc>{_p(_runs(c, rtl, notes), rtl)}</w:tc>" for c in [*r, *[""] * (width - len(r))]) + "</w:tr>" for r in table)
            body.append(f"<w:tbl><w:tblPr>{'<w:bidiVisual/>' * rtl}</w:tblPr>{rows}</w:tbl>")
            table.clear()

    for raw in _NOTE.sub("", text).strip().split("\n"):
        line = raw.strip()
        if line.startswith("```"):
            flush()
            fence = not fence
            continue
        if fence:
            body.append(_p(_runs(f"`{raw}`" if raw.strip() else "", False, {}), False))
            continue
        if (line.startswith("|") and line.count("|") > 1) or (line.count("|") >= 2 and not line.startswith("#")):
            cells = [c.strip() for c in line.removeprefix("|").removesuffix("|").split("|")]
            if not all(re.fullmatch(r"[\s:\-]+", c) for c in cells):
                table.append(cells)
            continue
        flush()
        heading, bullet = re.match(r"(#{1,4}) (.*)", line), re.match(r"(?:[-*+]|[0-9\u0660-\u0669]+[.)])\s+(.*)", line)
        if MARKER in line or line.lower() in ("<!-- pagebreak -->", "<!-- page_break -->", "<!--pagebreak-->"):
            body.append(_p('<w:r><w:br w:type="page"/></w:r>', rtl))
        elif heading:
            body.append(_p(_runs(heading[2], rtl, notes), rtl, f"Heading{len(heading[1])}"))
        elif bullet:
            level = 0 if line[0] not in "-*+" else 1
            body.append(_p(_runs(bullet[1], rtl, notes), rtl, more=f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr>'))
        elif line:
            body.append(_p(_runs(line.removeprefix("> "), rtl, notes), rtl))
    flush()
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{NAMESPACE}"><w:body>{"".join(body)}<w:sectPr>{"<w:bidi/>" * rtl}</w:sectPr></w:body></w:document>'
    footnotes = f'<?xml version="1.0" encoding="UTF-8"?><w:footnotes xmlns:w="{NAMESPACE}">' + "".join(f'<w:footnote w:id="{k}">{_p(_runs(note.strip(), rtl, {}), rtl)}</w:footnote>' for k, (_, note) in enumerate(found, 1)) + "</w:footnotes>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in (
            ("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELATIONS.format("officeDocument", "word/document.xml")), ("word/document.xml", document),
            ("word/footnotes.xml", footnotes), ("word/_rels/document.xml.rels", _RELATIONS.format("footnotes", "footnotes.xml")),
        ):
            z.writestr(zipfile.ZipInfo(name, **_STARTED), part, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def with_docx(df: DataFrame, markdown: str = "markdown", rtl: str = "rtl") -> DataFrame:
    """`df` with docx, the bytes of a Word document of each row's markdown (null: empty); `rtl` is a boolean column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [compose(m or "", bool(r)) for m, r in zip(batch.column(markdown).to_pylist(), batch.column(rtl).to_pylist(), strict=True)]
            yield batch.append_column("docx", pa.array(made, pa.binary()))

    df = df.drop("docx")
    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", docx binary")
