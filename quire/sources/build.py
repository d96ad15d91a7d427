"""Synthesises packages from tables: Office Open XML as Column expressions, zipped where the rows are.  For tests, queries and reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packages import _slices, packed

_OFFICE = "http://schemas.openxmlformats.org"
SPACES = (
    f'xmlns:w="{_OFFICE}/wordprocessingml/2006/main" xmlns:r="{_OFFICE}/officeDocument/2006/relationships" xmlns:m="{_OFFICE}/officeDocument/2006/math" '
    f'xmlns:a="{_OFFICE}/drawingml/2006/main" xmlns:wp="{_OFFICE}/drawingml/2006/wordprocessingDrawing" xmlns:v="urn:schemas-microsoft-com:vml" xmlns:mc="{_OFFICE}/markup-compatibility/2006"'
)
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def esc(text: Column) -> Column:
    """Text or attribute value, escaped."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def cat(*pieces: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def t(text: Column) -> Column:
    return cat('<w:t xml:space="preserve">', esc(text), "</w:t>")


def r(inner: Column, properties: Column | str = "") -> Column:
    return cat("<w:r><w:rPr>", properties, "</w:rPr>", inner, "</w:r>")


def p(inner: Column | str, properties: Column | str = "") -> Column:
    return cat("<w:p><w:pPr>", properties, "</w:pPr>", inner, "</w:p>")


def joined(items: Column, f) -> Column:
    """The XML of all items of an array, in order."""
    return F.array_join(F.transform(items, f), "")


def numbered(num_id: Column | str, ilvl: Column | str) -> Column:
    return cat('<w:numPr><w:ilvl w:val="', ilvl, '"/><w:numId w:val="', num_id, '"/></w:numPr>')


def tc(inner: Column | str, properties: Column | str = "") -> Column:
    return cat("<w:tc><w:tcPr>", properties, "</w:tcPr>", inner, "</w:tc>")


def tr(cells: Column) -> Column:
    return cat("<w:tr>", cells, "</w:tr>")


def tbl(rows: Column) -> Column:
    return cat("<w:tbl>", rows, "</w:tbl>")


def hyperlink(inner: Column, rid: Column) -> Column:
    return cat('<w:hyperlink r:id="', rid, '">', inner, "</w:hyperlink>")


def numbering_xml(levels: list[tuple[str, int | None]], num_id: str = "1") -> str:
    """word/numbering.xml with one list of these (format, start) levels."""
    lvl = "".join(f'<w:lvl w:ilvl="{k}">' + (f'<w:start w:val="{s}"/>' if s is not None else "") + f'<w:numFmt w:val="{f}"/></w:lvl>' for k, (f, s) in enumerate(levels))
    return f'{HEAD}<w:numbering {SPACES}><w:abstractNum w:abstractNumId="0">{lvl}</w:abstractNum><w:num w:numId="{num_id}"><w:abstractNumId w:val="0"/></w:num></w:numbering>'


def document(body: Column) -> Column:
    return cat(f"{HEAD}<w:document {SPACES}><w:body>", body, "</w:body></w:document>")


def root(tag: str, inner: Column) -> Column:
    return cat(f"{HEAD}<w:{tag} {SPACES}>", inner, f"</w:{tag}>")


def core(pairs: dict[str, Column]) -> Column:
    space = f'xmlns:cp="{_OFFICE}/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/"'
    return cat(f"{HEAD}<cp:coreProperties {space}>", *[x for k, v in pairs.items() for x in (f"<{k}>", esc(v), f"</{k.split(' ')[0]}>")], "</cp:coreProperties>")


def build(df: DataFrame, doc_id: Column, parts: dict[str, Column | str], links: Column | None = None, media: dict[str, Column] | None = None) -> DataFrame:
    """doc_id and content: a package for each row of df.

    parts: file name below word/ (document.xml, header1.xml, footnotes.xml, comments.xml, numbering.xml ...) or core.xml, to its XML; a null
    column leaves the part out.  links: array of struct(id, target) for the main part.  media: name below word/media to bytes, with relationship ids m0, m1 ...
    """
    media = media or {}
    kinds = {n: n.split(".")[0].rstrip("0123456789") for n in parts}
    columns = [F.lit(v) if isinstance(v, str) else v for v in parts.values()]
    rows = df.select(doc_id.cast("string").alias("doc_id"), F.array(*columns).alias("xml"), (links if links is not None else F.expr("cast(array() as array<struct<id:string,target:string>>)")).alias("links"), F.array(*[c for c in media.values()] or [F.lit(None).cast("binary")]).alias("media"))
    names, pictures = list(parts), list(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xml.sax.saxutils import quoteattr

        rel = lambda i, kind, target, more="": f'<Relationship Id={quoteattr(i)} Type="{_OFFICE}/officeDocument/2006/relationships/{kind}" Target={quoteattr(target)}{more}/>'
        wrap = lambda x: f'{HEAD}<Relationships xmlns="{_OFFICE}/package/2006/relationships">{x}</Relationships>'
        for b in _slices(batches):
            out = []
            for xml, urls, raws in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                have = [(n, x) for n, x in zip(names, xml, strict=True) if x is not None]
                files = {"[Content_Types].xml": f'{HEAD}<Types xmlns="{_OFFICE}/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>'}
                top = rel("d", "officeDocument", "word/document.xml")
                if any(n == "core.xml" for n, _ in have):
                    top += f'<Relationship Id="c" Type="{_OFFICE}/package/2006/relationships/metadata/core-properties" Target="docProps/core.xml"/>'
                files["_rels/.rels"] = wrap(top)
                own = "".join(rel(f"p{k}", kinds[n], n) for k, (n, _) in enumerate(have) if n not in ("document.xml", "core.xml"))
                own += "".join(rel(u["id"], "hyperlink", u["target"], ' TargetMode="External"') for u in urls or []) + "".join(rel(f"m{k}", "image", f"media/{n}") for k, n in enumerate(pictures))
                files["word/_rels/document.xml.rels"] = wrap(own)
                files |= {("docProps/" if n == "core.xml" else "word/") + n: x for n, x in have}
                raw = {f"word/media/{n}": bytes(x or b"") for n, x in zip(pictures, raws, strict=False)}
                out.append(packed([*((n, x.encode()) for n, x in files.items()), *raw.items()], tuple(raw)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "content"])

    return rows.mapInArrow(run, "doc_id string, content binary")
