"""Documents as blocks (S8-S13, S15). Blocks are arrays of (block_type, page_or_location, text_content).

Plain text is cut by column functions. The other formats are no regular languages: each is a small
parser of one document that runs in Arrow batches.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schemas
from tessera.functions.arrays import let, sums_before
from tessera.functions.text import looks_like_text

BLOCKS = "array<struct<block_type:string,page_or_location:string,text_content:string>>"
BLOCKS_TYPE = T.ArrayType(schemas.BLOCK)
Block = tuple[str, str, str]


#: Blank lines between paragraphs.
_BLANK = r"(?U)\n[^\S\n]*\n\s*"


def text_blocks(text: Column) -> Column:
    """Paragraphs between blank lines, lines trimmed and joined by a space, at their first line.

    A paragraph's line follows from the line ends before it, which are summed up in blocks."""
    def line_ends(t: Column) -> Column:
        return F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))

    def trimmed_line(line: Column) -> Column:
        return F.trim(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))

    gaps = F.concat(F.transform(F.regexp_extract_all(text, F.lit(_BLANK), F.lit(0)), line_ends), F.array(F.lit(0)))
    pieces = F.split(text, _BLANK)
    before = let(gaps, lambda g: sums_before(F.transform(pieces, lambda p, i: line_ends(p) + F.get(g, i))))

    def block(p: Column, n: Column) -> Column:
        lines = F.filter(F.transform(F.split(p, "\n"), trimmed_line), lambda x: x != "")
        at = n + 1 + line_ends(F.regexp_extract(p, r"(?U)^\s*", 0))
        return F.struct(F.lit("Paragraph").alias("block_type"), at.cast("string").alias("page_or_location"), F.array_join(lines, " ").alias("text_content"))

    return F.filter(F.zip_with(pieces, before, block), lambda b: b["text_content"] != "")


def parse_markdown(text: str) -> list[Block]:
    """Fenced code, headings and paragraphs with the line they start at."""
    out: list[Block] = []
    paragraph: list[str] = []
    code: list[str] | None = None
    begin = 0

    def end_paragraph() -> None:
        if paragraph:
            out.append(("Paragraph", str(begin), " ".join(paragraph)))
            paragraph.clear()

    for no, raw in enumerate(text.split("\n"), 1):
        line = raw.rstrip()
        body = line.lstrip()
        if body.startswith("```"):
            if code is None:
                end_paragraph()
                code, begin = [], no
            else:
                out.append(("Code", str(begin), "\n".join(code)))
                code = None
        elif code is not None:
            code.append(line)
        elif body.startswith("#"):
            end_paragraph()
            out.append(("Heading", str(no), body.lstrip("#").strip()))
        elif not body:
            end_paragraph()
        else:
            begin = begin if paragraph else no
            paragraph.append(body)
    end_paragraph()
    if code:
        out.append(("Code", str(begin), "\n".join(code)))
    return out


#: Tags of HTML blocks.
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CODE = frozenset(("pre", "code"))
BREAKS = HEADINGS | CODE | frozenset("p div li td th tr blockquote section article br".split())
SKIPPED = frozenset("script style head noscript".split())


def decode_entities(text: str) -> str:
    """Seven references, in this order."""
    for name, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        text = text.replace(name, sign)
    return text


def region_text(region: str) -> str:
    """Text of a piece of HTML, white space as single spaces."""
    return decode_entities(" ".join(re.sub(r"<[^>]*>?", "", region).split()))


_TAG = re.compile(r"<(/*)([A-Za-z0-9]*)([^>]*)>?")
_REGION = re.compile(r"<(table|math)(?: [^>]*)?>.*?</\1>", re.S)


def parse_html(page: str) -> list[Block]:
    """Headings, code, paragraphs, tables, formulas and images in page order."""
    out: list[Block] = []
    held: list[str] = []
    kind, skipping, at = "Paragraph", [], 0

    def flush() -> None:
        body = "".join(held).strip()
        held.clear()
        if body:
            out.append((kind, str(len(out) + 1), decode_entities(body)))

    while at < len(page):
        begin = page.find("<", at)
        begin = len(page) if begin < 0 else begin
        if not skipping:
            held.append(page[at:begin])
        if begin == len(page):
            break
        region = None if skipping else _REGION.match(page, begin)
        if region:
            flush()
            if body := region_text(region[0]):
                out.append(("Table" if region[1] == "table" else "Equation", str(len(out) + 1), body))
            at = region.end()
            continue
        tag = _TAG.match(page, begin)
        at, name = tag.end(), tag[2].lower()
        if name in SKIPPED:
            if tag[1]:
                if name in skipping:
                    del skipping[len(skipping) - 1 - skipping[::-1].index(name)]
            else:
                skipping.append(name)
        elif skipping:
            continue
        elif name == "img" and not tag[1]:
            flush()
            low = tag[3].lower()
            formula = "class=" in low and any(w in low for w in ("formula", "equation", "katex", "mathjax"))
            out.append(("Equation" if formula else "Image", str(len(out) + 1), ""))
        elif name in BREAKS:
            flush()
            kind = "Heading" if name in HEADINGS else "Code" if name in CODE else "Paragraph"
    flush()
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parse_docx(content: bytes) -> list[Block]:
    """Paragraphs, then tables (cells by ``|``, rows by ``;``); unreadable files are one image."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, NotImplementedError):
        return [("Image", "1", "")]

    def words(element) -> str:
        return "".join(t.text or "" for t in element.iter(f"{_W}t")).strip()

    inside = {id(p) for t in root.iter(f"{_W}tbl") for p in t.iter(f"{_W}p")}
    texts = [("Paragraph", words(p)) for p in root.iter(f"{_W}p") if id(p) not in inside]
    texts += [("Table", "; ".join(" | ".join(words(c) for c in r.iter(f"{_W}tc")) for r in t.iter(f"{_W}tr"))) for t in root.iter(f"{_W}tbl")]
    return [(kind, str(i), text) for i, (kind, text) in enumerate([x for x in texts if x[1]], 1)]


#: Characters (or bytes) that are parsed at once.
SLICE = 1 << 20


def slices(values: pa.Array) -> Iterator[pa.Array]:
    """An Arrow array in parts of about ``SLICE`` characters, one value at least, so that few blocks are Python objects at once."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(values):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, "right")))
        yield values.slice(at, end - at)
        at = end


def _parsed(batches: Iterator[pa.Array], parse: Callable[..., list[Block]]) -> Iterator[pa.Array]:
    """Blocks of each value as Arrow lists; null stays null."""
    kind = pa.list_(pa.struct([(n, pa.string()) for n in ("block_type", "page_or_location", "text_content")]))
    for whole in batches:
        parts = []
        for part in slices(whole):
            made = [None if v is None else parse(v) for v in part.to_pylist()]
            ends = np.cumsum([0, *(len(m or ()) for m in made)], dtype=np.int32)
            columns = list(zip(*(b for m in made for b in m or ()), strict=True)) or [(), (), ()]
            struct = pa.StructArray.from_arrays([pa.array(c, type=pa.string()) for c in columns], fields=list(kind.value_type))
            parts.append(pa.ListArray.from_arrays(pa.array(ends), struct, type=kind, mask=pa.array([m is None for m in made])))
        yield pa.concat_arrays(parts) if parts else pa.array([], type=kind)


@F.arrow_udf(BLOCKS_TYPE)
def markdown_blocks(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _parsed(texts, parse_markdown)


@F.arrow_udf(BLOCKS_TYPE)
def html_blocks(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _parsed(pages, parse_html)


@F.arrow_udf(BLOCKS_TYPE)
def docx_blocks(contents: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _parsed(contents, parse_docx)


def pdf_page_blocks(pages: Column) -> Column:
    """Page texts of a PDF plug-in as blocks; pages without real text are images to read."""
    listed = F.transform(pages, lambda t, i: F.struct(F.when(looks_like_text(t), "Paragraph").otherwise("Image").alias("block_type"), (i + 1).cast("string").alias("page_or_location"), F.when(looks_like_text(t), t).otherwise("").alias("text_content")))
    return F.when(F.size(pages) > 0, listed).otherwise(F.array(F.struct(F.lit("Image").alias("block_type"), F.lit("1").alias("page_or_location"), F.lit("").alias("text_content"))))


def html_text(page: Column) -> Column:
    """S12/S11 as column functions: the text of a page outside scripts, styles and the head."""
    body = F.regexp_replace(page, r"(?is)<(script|style|head|noscript)\b[^>]*>.*?</\1\s*>", "")
    flat = F.trim(F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", " "), r"\s+", " "))
    for name, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        flat = F.replace(flat, F.lit(name), F.lit(sign))
    return flat
