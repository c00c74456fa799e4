"""Blocks of a page from a vision model's output: tagged text or Markdown.

Block kinds are lower-case names. Markdown is split and classified by Column expressions;
tagged text is scanned by a Pandas function, as its nesting rules need a cursor.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_all, trimmed_paragraphs

BLOCKS = "array<struct<kind:string,content:string,bbox:array<double>,reading_order:int>>"

#: Tag names and the kinds they stand for; others are text.
TAG_KINDS = {
    "heading": "heading", "title": "heading", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
    "list": "list", "ul": "list", "ol": "list", "table": "table", "figure": "figure", "image": "figure", "formula": "formula", "math": "formula",
    "caption": "caption", "footer": "footer", "header": "header",
}

_OPEN = re.compile(r"<([^ >/]*)([^>]*)>")
_LOC = re.compile(r'loc="([^"]*)"')
_SPACE = " \t\n\r\f"


def _box(attributes: str) -> list[float] | None:
    found = _LOC.search(attributes)
    values = []
    for part in found[1].split(",") if found else ():
        try:
            values.append(float(part.strip()))
        except ValueError:
            continue
    return values if len(values) == 4 else None


def tagged_blocks(text: str) -> list[dict]:
    """Blocks in order. An unclosed tag holds all that follows; a tag without its > ends the scan."""
    out: list[dict] = []

    def add(kind: str, content: str, box=None):
        out.append({"kind": kind, "content": content, "bbox": box, "reading_order": len(out)})

    at = 0
    while at < len(text):
        if text[at] in _SPACE:
            at += 1
        elif text[at] != "<":
            end = text.find("<", at)
            end = len(text) if end < 0 else end
            if text[at:end].strip():
                add("text", text[at:end].strip())
            at = end
        elif not (tag := _OPEN.match(text, at)):
            break
        else:
            kind, box, at = TAG_KINDS.get(tag[1].lower(), "text"), _box(tag[2]), tag.end()
            if tag[0].endswith("/>"):
                add(kind, "", box)
                continue
            close = f"</{tag[1]}>"
            end = text.find(close, at)
            body = text[at:] if end < 0 else text[at:end]
            add(kind, body.strip(), box)
            at = len(text) if end < 0 else end + len(close)
    return out


def parse_doctags(text: Column) -> Column:
    @F.pandas_udf(BLOCKS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else tagged_blocks(t))

    return run(text)


def as_markdown(kind: Column, content: Column) -> Column:
    return (
        F.when(kind == "heading", F.concat(F.lit("## "), content)).when(kind == "list", F.concat(F.lit("- "), content))
        .when(kind == "formula", F.concat(F.lit("$$\n"), content, F.lit("\n$$"))).when(kind == "caption", F.concat(F.lit("*"), content, F.lit("*"))).otherwise(content)
    )


def markdown_of(blocks: Column) -> Column:
    """Blocks that have content, one below the other."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["content"] != ""), lambda b: as_markdown(b["kind"], b["content"])), "\n")


def paragraph_block(p: Column) -> Column:
    """(kind, content) of one trimmed Markdown paragraph; the first rule that holds decides."""
    formula = p.startswith("$$") & p.endswith("$$") & (F.length(p) >= 4)
    figure = p.startswith("![")
    table = ~F.exists(F.split(p, "\r?\n"), lambda line: ~line.rlike(r"(?U)^\s*\|"))
    heading = p.rlike("^#[# ]")
    first = F.regexp_replace(F.regexp_extract(p, r"^([^\n]*)", 1), r"(?U)^\s+", "")
    listed = first.startswith("- ") | first.startswith("* ") | (first.rlike("^[0-9]") & first.contains(". "))
    kind = F.when(formula, "formula").when(figure, "figure").when(table, "table").when(heading, "heading").when(listed, "list").otherwise("text")
    alt = F.regexp_extract(p, r"(?s)^!\[([^\]]*)\]", 1)
    content = (
        F.when(formula, trim_all(F.substring(p, F.lit(3), F.length(p) - 4))).when(figure, alt)
        .when(~table & heading, F.regexp_replace(p, r"(?U)^#+\s*", "")).otherwise(p)
    )
    return F.struct(kind.alias("kind"), content.alias("content"))


def parse_markdown(text: Column) -> Column:
    """Blocks of a page in Markdown: inline formulas stay in their text."""
    return F.transform(
        F.transform(trimmed_paragraphs(text), paragraph_block),
        lambda b, i: F.struct(b["kind"].alias("kind"), b["content"].alias("content"), F.lit(None).cast("array<double>").alias("bbox"), i.cast("int").alias("reading_order")),
    )


#: Output styles and their parsers.
STYLES = {"granite-docling": "doctags", "mineru": "markdown", "olmocr": "markdown"}


def parse_blocks(text: Column, style: str) -> Column:
    if style not in STYLES:
        raise ValueError(f"unknown style {style}; one of {', '.join(STYLES)}")
    return parse_doctags(text) if STYLES[style] == "doctags" else parse_markdown(text)
