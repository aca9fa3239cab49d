"""Spreadsheets and word-processor files as segments, and patched copies of them; page texts of PDF files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qirtas.functions.text import is_page_number

#: Parts that hold text, and the elements that make a segment there and its runs. Fixed values.
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SHEET_PARTS = [(re.compile(r"xl/sharedStrings\.xml$"), f"{SHEET}si", f"{SHEET}t"), (re.compile(r"xl/worksheets/sheet\d+\.xml$"), f"{SHEET}is", f"{SHEET}t"), (re.compile(r"xl/comments\d*\.xml$"), f"{SHEET}text", f"{SHEET}t"), (re.compile(r"xl/charts/chart\d+\.xml$"), f"{DRAW}p", f"{DRAW}t")]
WORD_PARTS = [(re.compile(r"word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments|glossary/document)\.xml$"), f"{WORD}p", f"{WORD}t")]
ARABIC = re.compile("[؀-ۿ]")


def _safe(name: str) -> bool:
    return bool(name) and not name.startswith("/") and "\\" not in name and ".." not in name.split("/")


def _rule(name: str):
    return next(((unit, run) for rules in (SHEET_PARTS, WORD_PARTS) for p, unit, run in rules if p.match(name)), None)


def joined(runs: list[str]) -> str:
    """Texts of runs, a space between two that have none at their edges."""
    out = ""
    for r in runs:
        out += (" " if out and r and not out[-1].isspace() and not r[0].isspace() else "") + r
    return out


def read_segments(content: bytes) -> list[tuple[str, int, str]]:
    """(part, place, text) of the non-blank segments of a zipped office file; an unsafe entry name is an error."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        if not all(map(_safe, names)):
            raise ValueError("unsafe entry name")
        for name in names:
            if rule := _rule(name):
                unit, run = rule
                for i, e in enumerate(ET.fromstring(z.read(name)).iter(unit)):
                    text = joined([t.text or "" for t in e.iter(run)])
                    if text.strip():
                        out.append((name, i, text))
    return out


def patch(content: bytes, translations: dict[str, str]) -> bytes:
    """The file with segments replaced: the translation goes into the first run, other runs are emptied, other parts stay as they are."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for info in z.infolist():
            data = z.read(info.filename)
            if rule := _rule(info.filename):
                unit, run = rule
                root, changed = ET.fromstring(data), False
                for e in root.iter(unit):
                    runs = list(e.iter(run))
                    new = translations.get(joined([t.text or "" for t in runs]))
                    if new is not None and runs:
                        changed = True
                        for t in runs:
                            t.text = ""
                        runs[0].text = new
                        if unit == f"{WORD}p":
                            _direction(e, bool(ARABIC.search(new)))
                data = ET.tostring(root, encoding="utf-8", xml_declaration=True) if changed else data
            w.writestr(info, data)
    return out.getvalue()


def _direction(paragraph: ET.Element, arabic: bool) -> None:
    properties = paragraph.find(f"{WORD}pPr")
    if properties is None:
        if not arabic:
            return
        properties = ET.Element(f"{WORD}pPr")
        paragraph.insert(0, properties)
    flag = properties.find(f"{WORD}bidi")
    if arabic and flag is None:
        properties.append(ET.Element(f"{WORD}bidi"))
    elif not arabic and flag is not None:
        properties.remove(flag)


def segments(files: DataFrame) -> DataFrame:
    """``path, part, pos, text`` of files read as binary (``path, content``)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *s) for p, c in zip(b["path"], b["content"], strict=True) for s in read_segments(c)], columns=["path", "part", "pos", "text"])

    return files.select("path", "content").mapInPandas(read, "path string, part string, pos int, text string")


def patched(files: DataFrame, translations: DataFrame) -> DataFrame:
    """``path, content`` of the patched files; ``translations`` has ``path, text, translation``. A file's translations travel with it."""
    per = translations.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("text", "translation"))).alias("t"))

    @F.pandas_udf("binary")
    def apply(content: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([patch(c, dict(m) if m else {}) for c, m in zip(content, t, strict=True)])

    return files.join(per, "path", "left").select("path", apply("content", "t").alias("content"))


def page_blocks(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", most_pages: int | None = None) -> DataFrame:
    """``doc, page, pos, n, text`` of the blocks of page texts: lines joined by spaces, blank blocks and page numbers left out, numbered anew.

    A document of more than ``most_pages`` pages is an error.
    """
    base = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.col(text).alias("text"))
    if most_pages is not None:
        long = F.raise_error(F.concat(F.lit("too many pages: "), F.col("doc").cast("string"))).cast("string")
        counts = base.groupBy("doc").agg(F.countDistinct("page").alias("_n"))
        base = base.join(counts, "doc").withColumn("text", F.when(F.col("_n") > most_pages, long).otherwise(F.col("text"))).drop("_n")
    b = base.where("text is not null").withColumn("_b", F.transform(F.split("text", r"\n\s*\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"[^\S\n]*\n\s*", " "))))
    kept = F.filter("_b", lambda x: (x != "") & ~is_page_number(x))
    return b.select("doc", "page", F.size(kept).alias("n"), F.posexplode(kept).alias("pos", "text"))


def is_margin(pos: Column, n: Column, text: Column) -> Column:
    """Whether a block is a header or footer: the first or last of more than two, short, and no sentence."""
    words = F.split(text, r"\s+")
    sentence = (F.size(words) >= 2) & F.exists(words, lambda w: w.rlike(r"^\p{L}{4,}$"))
    return (n > 2) & ((pos == 0) | (pos == n - 1)) & (F.length(text) < 60) & ~sentence


def page_paragraphs(pages: DataFrame, most_pages: int | None = None) -> DataFrame:
    """Paragraphs of page texts (``doc, page, text``): page numbers dropped, short margins dropped, first of equal ones kept."""
    b = page_blocks(pages, most_pages=most_pages)
    kept = b.where(~is_margin(F.col("pos"), F.col("n"), F.col("text")))
    return kept.groupBy("doc", "text").agg(F.min(F.struct("page", "pos")).alias("o")).select("doc", "o.page", "o.pos", "text")


def sidecar_text(paragraphs: DataFrame) -> DataFrame:
    """``doc, text``: paragraphs parted by blank lines, pages by a page break."""
    pages = paragraphs.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("p")).select("doc", "page", F.array_join(F.col("p.text"), "\n\n").alias("t"))
    return pages.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "t"))).alias("p")).select("doc", F.array_join(F.col("p.t"), "\n\n--- page break ---\n\n").alias("text"))
