"""ZIP archives as rows: written and read in the tasks that hold them."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the time stamp of every entry, so that equal content gives equal archives.
STAMP = (1980, 1, 1, 0, 0, 0)
#: Entries that are not content.
SKIPPED = ("__MACOSX", "._")


def write_archives(files: DataFrame, key: str) -> DataFrame:
    """(key, archive) from rows (key, files array<struct<path string, content binary>>).

    Entries are stored, not compressed, in the order given. A repeated path keeps its first content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = []
                for entries in part.column("files").to_pylist():
                    target, seen = io.BytesIO(), set()
                    with zipfile.ZipFile(target, "w", zipfile.ZIP_STORED) as z:
                        for e in entries or ():
                            if e["path"] not in seen:
                                seen.add(e["path"])
                                z.writestr(zipfile.ZipInfo(e["path"], STAMP), e["content"] or b"")
                    out.append(target.getvalue())
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(out, pa.binary())], names=[key, "archive"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, "files").mapInArrow(run, f"{key} {kind}, archive binary")


def read_archives(rows: DataFrame, key: str, archive: str = "archive") -> DataFrame:
    """(key, path, content, error): the entries of each archive. Folders and system entries are skipped;
    encrypted entries, methods other than stored and deflated, and broken archives give a row with an error."""

    def entries(data: bytes | None) -> list[tuple]:
        found = []
        try:
            with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                for info in z.infolist():
                    name = info.filename
                    if info.is_dir() or name.startswith(SKIPPED[0]) or name.rsplit("/", 1)[-1].startswith(SKIPPED[1]):
                        continue
                    if info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                        found.append((name, None, "not supported"))
                    else:
                        found.append((name, z.read(info), None))
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError) as e:
            found.append((None, None, type(e).__name__))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(key).to_pylist(), batch.column(archive).to_pylist()):
                found = entries(data)
                columns = [pa.array([k] * len(found), batch.schema.field(key).type)]
                columns += [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "path", "content", "error"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, archive).mapInArrow(run, f"{key} {kind}, path string, content binary, error string")


#: The parts of a word processor file that do not depend on its text.
TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
RELATIONS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)
SPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(nodes: DataFrame, key: str) -> DataFrame:
    """(key, archive): one .docx per key from nodes (key, ord, kind, text): headings and list items by
    style, others plain paragraphs; characters that XML forbids are removed."""
    clean = F.regexp_replace("text", r"[^\t\n\r\x20-퟿-�\x{10000}-\x{10FFFF}]", "")
    safe = F.replace(F.replace(F.replace(clean, F.lit("&"), F.lit(escape("&"))), F.lit("<"), F.lit(escape("<"))), F.lit(">"), F.lit(escape(">")))
    style = F.when(F.col("kind") == "heading", "Heading3").when(F.col("kind") == "item", "ListParagraph").otherwise("Normal")
    part = F.concat(F.lit('<w:p><w:pPr><w:pStyle w:val="'), style, F.lit('"/></w:pPr><w:r><w:t xml:space="preserve">'), safe, F.lit("</w:t></w:r></w:p>"))
    parts = F.array_sort(F.collect_list(F.struct("ord", part.alias("p"))))
    body = F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{SPACE}"><w:body>'), F.array_join(F.transform(parts, lambda x: x["p"]), ""), F.lit("</w:body></w:document>"))
    made = nodes.groupBy(key).agg(body.alias("body"))
    entry = lambda path, text: F.struct(F.lit(path).alias("path"), F.to_binary(text, F.lit("utf-8")).alias("content"))
    files = F.array(entry("[Content_Types].xml", F.lit(TYPES)), entry("_rels/.rels", F.lit(RELATIONS)), entry("word/document.xml", F.col("body")))
    return write_archives(made.select(key, files.alias("files")), key)
