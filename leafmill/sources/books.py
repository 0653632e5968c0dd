"""Book files as rows: format detection, readers of EPUB, FB2, DOCX, text, Markdown and HTML, and writers.

Files come from Spark's binaryFile source; each is read in the worker that holds it, under size limits, and one row goes
out for each file, with a status in place of an error.
"""

from __future__ import annotations

import codecs
import contextlib
import io
import posixpath
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.operators import html, segment

# Limits of a file and of an archive.
FILE_BYTES, ENTRIES, ENTRY_BYTES = 150 << 20, 12_000, 40 << 20
_CHAPTER = T.StructType().add("title", T.StringType()).add("paragraphs", T.ArrayType(T.StringType()))
BOOK = T.StructType().add("status", T.StringType()).add("format", T.StringType()).add("title", T.StringType()).add("author", T.StringType()).add("chapters", T.ArrayType(_CHAPTER)).add("warnings", T.ArrayType(T.StringType()))


def format_of(name: Column, content: Column) -> Column:
    """S2 without archives: magic bytes, then the beginning of the content, then the name."""
    head = F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1"))
    extension = F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)$", 1))
    by_name = F.when(extension.isin("htm", "html", "xhtml"), "HTML").when(extension.isin("md", "markdown"), "MD").when(extension.isin("epub", "fb2", "docx", "pdf", "txt"), F.upper(extension))
    return (
        F.when(F.hex(F.substring(content, 1, 4)) == "25504446", "PDF")
        .when(F.hex(F.substring(content, 1, 4)) == "504B0304", "ZIP")
        .when(F.contains(head, F.lit("<fictionbook")), "FB2")
        .when(F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<!doctype html")), "HTML")
        .otherwise(by_name)
    )


def decode(content: bytes) -> tuple[str, bool]:
    """Text of bytes, and whether the charset was guessed: byte order marks, strict UTF-8, else windows-1251."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace"), False
    try:
        return content.decode("utf-8"), False
    except UnicodeDecodeError:
        return content.decode("windows-1251", "replace"), True


def legacy_charset(content: bytes) -> str:
    """UTF-8 if it decodes; else the Cyrillic table under which small letters prevail."""
    try:
        content.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        text = content.decode("windows-1251", "replace")
        small, large = (sum(a <= c <= b for c in text) for a, b in ("ая", "АЯ"))
        return "windows-1251" if small >= large else "koi8-r"


NAMED_CHARSET = regex.compile(rb"(?i)charset\s*=\s*[\"']?([a-zA-Z0-9_.:-]+)")


def charset(header: str | None, content: bytes) -> str:
    """The header's word, else that of the first 8 KB, else a guess; names that are none are passed over."""
    named = NAMED_CHARSET.search(content[:8192])
    for name in ((header or "").strip(), named[1].decode() if named else ""):
        with contextlib.suppress(LookupError):
            if name:
                return codecs.lookup(name).name
    return legacy_charset(content)


def zip_path(base: str, href: str) -> str | None:
    """The entry that a link in an archive means; None for one that leaves it."""
    plain = unquote(regex.split("[#?]", href)[0])
    if not plain or plain.startswith("/") or regex.match("[A-Za-z][A-Za-z0-9+.-]*:", plain):
        return None
    path = posixpath.normpath(posixpath.join(posixpath.dirname(base), plain.replace("\\", "/")))
    return None if path.startswith("..") else path


class Archive:
    """A zip file whose entries and sizes are limited."""

    def __init__(self, content: bytes):
        self.file = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.file.namelist())
        if len(self.names) > ENTRIES:
            raise ValueError("too many entries")

    def read(self, name: str) -> bytes:
        if self.file.getinfo(name).file_size > ENTRY_BYTES:
            raise ValueError("entry too large")
        return self.file.read(name)


def _local(node) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _below(node, name: str):
    return (n for n in node.iter() if _local(n) == name)


def _plain(node) -> str:
    return segment.tidy("".join(node.itertext()))


def epub(content: bytes) -> dict:
    """The spine's documents, in order, one chapter each."""
    files = Archive(content)
    container = ElementTree.fromstring(files.read("META-INF/container.xml"))
    package = next(_below(container, "rootfile")).get("full-path")
    root = ElementTree.fromstring(files.read(package))
    manifest = {n.get("id"): n for n in _below(root, "item")}
    chapters = []
    for ref in _below(root, "itemref"):
        item = manifest.get(ref.get("idref"))
        skip = item is None or ref.get("linear") == "no" or "nav" in (item.get("properties") or "").split() or "html" not in (item.get("media-type") or "")
        path = None if skip else zip_path(package, item.get("href") or "")
        if path in files.names:
            text = regex.sub(r"<(title|script|style)\b([^>]*)/>", r"<\1\2></\1>", decode(files.read(path))[0])
            page = html.parse(text)
            found = html.blocks(next(iter(page.find(lambda n: n.tag == "body")), page))
            named = next((t for t, k in found if k in ("HEADING", "SUBHEADING")), None)
            paragraphs = [t for t, _ in found]
            if named and paragraphs[:1] == [named]:
                paragraphs = paragraphs[1:]
            if paragraphs or named:
                chapters.append({"title": named or f"Глава {len(chapters) + 1}", "paragraphs": paragraphs})
    first = lambda name: next((_plain(n) for n in _below(root, name)), "")
    return {"format": "EPUB", "title": first("title"), "author": first("creator"), "chapters": chapters}


def fb2(content: bytes) -> dict:
    """Sections in reading order, a section's own paragraphs before those of the ones in it; notes are left out."""
    root = ElementTree.fromstring(content)
    chapters, notes = [], 0

    def section(node):
        own, title = [], ""
        for child in node:
            name = _local(child)
            if name == "title" and not title:
                title = " ".join(filter(None, (_plain(p) for p in child))) or _plain(child)
            elif name in ("poem", "epigraph", "cite"):
                own += [t for p in child.iter() if _local(p) in ("p", "v", "text-author") and (t := _plain(p))]
            elif name in ("p", "subtitle", "v") and (text := _plain(child)):
                own.append(text)
        if own or title:
            chapters.append({"title": title or f"Глава {len(chapters) + 1}", "paragraphs": own})
        for child in node:
            if _local(child) == "section":
                section(child)

    for body in _below(root, "body"):
        if body.get("name") == "notes":
            notes += 1
        else:
            section(body)
    info = next(_below(root, "title-info"), root)
    author = next(_below(info, "author"), None)
    parts = [_plain(n) for k in ("first-name", "middle-name", "last-name") for n in (_below(author, k) if author is not None else ())]
    return {"format": "FB2", "title": next((_plain(n) for n in _below(info, "book-title")), ""), "author": " ".join(filter(None, parts)), "chapters": [c for c in chapters if c["paragraphs"]], "warnings": ["notes left out"] * bool(notes)}


def docx(content: bytes) -> dict:
    """Headings of the first two levels, or lines that name chapters, begin chapters; table rows keep their cells."""
    root = ElementTree.fromstring(Archive(content).read("word/document.xml"))
    body = next(_below(root, "body"))
    chapters: list[dict] = [{"title": "", "paragraphs": []}]
    for node in body:
        if _local(node) == "tbl":
            for row in _below(node, "tr"):
                chapters[-1]["paragraphs"].append("\t".join(segment.tidy("".join(t.text or "" for t in _below(c, "t"))) for c in row if _local(c) == "tc"))
        elif _local(node) == "p":
            text = segment.tidy("".join((t.text or "") if _local(t) == "t" else " " for t in node.iter() if _local(t) in ("t", "tab", "br")))
            style = next((v for n in _below(node, "pStyle") for k, v in n.attrib.items() if k.endswith("val")), "")
            level = regex.search(r"(?i)heading\s*(\d)|заголовок\s*(\d)", style)
            if text and ((level and int(level[1] or level[2]) <= 2) or segment.HEADING.fullmatch(text)):
                chapters.append({"title": text, "paragraphs": []})
            elif text:
                chapters[-1]["paragraphs"].append(text)
    return {"format": "DOCX", "title": "", "author": "", "chapters": [c for c in chapters if c["paragraphs"]]}


def markdown(text: str) -> dict:
    """K5: front matter for title and author; headings of three levels begin chapters; marks are dropped."""
    meta = {}
    if front := regex.match(r"---\n(.*?)\n---\n", text, regex.DOTALL):
        meta = dict(m.groups() for m in regex.finditer(r'(?m)^(title|author):\s*"?(.*?)"?\s*$', front[1]))
        text = text[front.end() :]
    chapters: list[dict] = [{"title": meta.get("title", ""), "lines": []}]
    fenced = False
    for line in text.split("\n"):
        fenced ^= line.startswith("```")
        heading = None if fenced else regex.match(r"#{1,3}\s+(.*?)\s*#*$", line)
        if heading:
            chapters.append({"title": heading[1], "lines": []})
        elif not line.startswith("```"):
            clean = line if fenced else regex.sub(r"!?\[([^\]]*)\]\([^)]*\)|(\*\*|__|\*|`)(?=\S)(.+?)\2", lambda m: m[1] or m[3] or "", regex.sub(r"^\s*>\s?", "", line))
            chapters[-1]["lines"].append(clean)
    done = [{"title": c["title"], "paragraphs": segment.paragraphs("\n".join(c["lines"]))} for c in chapters]
    return {"format": "MD", "title": meta.get("title", ""), "author": meta.get("author", ""), "chapters": [c for c in done if c["paragraphs"]]}


def read(name: str, kind: str | None, content: bytes) -> dict:
    """One book; a file that can't be read has its reason as status and no chapters."""
    book = {"status": "SUCCESS", "format": kind, "title": "", "author": "", "chapters": [], "warnings": []}
    try:
        if len(content) > FILE_BYTES:
            return book | {"status": "TOO_LARGE"}
        if kind == "ZIP":
            names = Archive(content).names
            inner = [n for n in names if n.lower().endswith(".fb2")]
            if "META-INF/container.xml" in names:
                book |= epub(content)
            elif "word/document.xml" in names:
                book |= docx(content)
            elif inner:
                book |= fb2(Archive(content).read(inner[0]))
            else:
                return book | {"status": "UNKNOWN_FORMAT"}
        elif kind == "FB2":
            book |= fb2(content)
        elif kind in ("TXT", "MD", "HTML"):
            text, guessed = decode(content)
            stem = posixpath.basename(name).rpartition(".")[0] or name
            if kind == "MD":
                book |= markdown(text)
            else:
                found = segment.paragraphs(text)
                if kind == "HTML":
                    root = html.parse(text)
                    whole = next(iter(root.find(lambda n: n.tag == "article") or root.find(lambda n: n.tag == "main") or root.find(lambda n: n.tag == "body")), root)
                    found = [t for t, _ in html.blocks(whole.cleaned())]
                book["chapters"] = [{"title": t, "paragraphs": p} for t, p in segment.chapters(stem, found)]
            book["title"] = book["title"] or stem
            book["warnings"] = [*book["warnings"], *["charset guessed"] * guessed]
        else:
            return book | {"status": "UNKNOWN_FORMAT"}
    except (ElementTree.ParseError, zipfile.BadZipFile, KeyError, ValueError, StopIteration) as e:
        return book | {"status": f"BROKEN: {type(e).__name__}", "chapters": []}
    return book if book["chapters"] else book | {"status": "EMPTY_CONTENT"}


@F.pandas_udf(BOOK)
def read_book(name: pd.Series, kind: pd.Series, content: pd.Series) -> pd.DataFrame:
    rows = [read(n or "", k, bytes(c or b"")) for n, k, c in zip(name, kind, content, strict=True)]
    return pd.DataFrame(rows, columns=["status", "format", "title", "author", "chapters", "warnings"])


def books(spark: SparkSession, path: str) -> DataFrame:
    """(path, status, format, title, author, chapters, warnings) of the files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", read_book("path", format_of(F.col("path"), F.col("content")), "content").alias("b")).select("path", "b.*")


def _xml(text: str) -> str:
    clean = regex.sub("[\\x00-\\x08\\x0b-\\x1f]", "", text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        clean = clean.replace(a, b)
    return clean


def write_fb2(title: str, author: str, chapters: list) -> bytes:
    """W9."""
    sections = "".join(f"<section><title><p>{_xml(c['title'])}</p></title>{''.join(f'<p>{_xml(p)}</p>' for p in c['paragraphs'])}</section>" for c in chapters)
    head = f"<title-info><author><first-name>{_xml(author)}</first-name></author><book-title>{_xml(title)}</book-title></title-info>"
    return f'<?xml version="1.0" encoding="utf-8"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description>{head}</description><body>{sections}</body></FictionBook>'.encode()


def write_epub(title: str, author: str, chapters: list) -> bytes:
    """The stored mimetype first, a document for each chapter; rows of tables that follow each other share a table."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        items, spine = "", ""
        for k, c in enumerate(chapters, 1):
            body = "".join("<tr>" + "".join(f"<td>{_xml(x)}</td>" for x in p.split("\t")) + "</tr>" if "\t" in p else f"<p>{_xml(p)}</p>" for p in c["paragraphs"])
            body = regex.sub(r"(?:<tr>(?:(?!</tr>).)*</tr>)+", lambda m: f"<table>{m[0]}</table>", body)
            z.writestr(f"OEBPS/c{k}.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{_xml(c["title"])}</title></head><body><h1>{_xml(c["title"])}</h1>{body}</body></html>')
            items += f'<item id="c{k}" href="c{k}.xhtml" media-type="application/xhtml+xml"/>'
            spine += f'<itemref idref="c{k}"/>'
        z.writestr("OEBPS/content.opf", f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{_xml(title)}</dc:title><dc:creator>{_xml(author)}</dc:creator></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>')
    return out.getvalue()


def exported(library: DataFrame, kind: str) -> DataFrame:
    """(path, content): each book of (path, title, author, chapters) as the bytes of a file."""
    write = {"fb2": write_fb2, "epub": write_epub}[kind]

    @F.pandas_udf(T.BinaryType())
    def content(title: pd.Series, author: pd.Series, chapters: pd.Series) -> pd.Series:
        return pd.Series([write(t or "", a or "", [] if c is None else c) for t, a, c in zip(title, author, chapters, strict=True)])

    return library.select("path", content("title", "author", "chapters").alias("content"))


#: Markers of a JPEG file that stand alone.
STANDALONE = {0x01, *range(0xD0, 0xDA)}


def picture_size(content: bytes) -> tuple[int, int] | None:
    """V4: width and height from the header of a PNG, GIF, JPEG or WebP file."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return int.from_bytes(content[16:20]), int.from_bytes(content[20:24])
    if content[:3] == b"GIF":
        return int.from_bytes(content[6:8], "little"), int.from_bytes(content[8:10], "little")
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        if content[12:16] == b"VP8X":
            return 1 + int.from_bytes(content[24:27], "little"), 1 + int.from_bytes(content[27:30], "little")
        if content[12:16] == b"VP8L":
            bits = int.from_bytes(content[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        return int.from_bytes(content[26:28], "little") & 0x3FFF, int.from_bytes(content[28:30], "little") & 0x3FFF
    at = 2 if content[:2] == b"\xff\xd8" else len(content)
    while at + 9 < len(content):
        marker, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4])
        if marker == 0xFF or marker in STANDALONE:  # a fill byte, or a marker without a length
            at += 1 if marker == 0xFF else 2
            continue
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 7 : at + 9]), int.from_bytes(content[at + 5 : at + 7])
        at += 2 + size
    return None


