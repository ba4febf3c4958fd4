"""The first sheets of .xlsx workbooks as rows of text, from any store that Spark reads. A workbook is one task, and has at most
1,048,576 rows."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DATES = {*range(14, 23), *range(45, 48)}  # numbers of the built-in formats of dates and times
_EPOCH = dt.datetime(1899, 12, 30)


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _text(e: ElementTree.Element) -> str:
    """A string's text, also in runs, without phonetic hints."""
    return "".join(t.text or "" for x in e if _tag(x) in ("t", "r") for t in ([x] if _tag(x) == "t" else [y for y in x if _tag(y) == "t"]))


def _place(reference: str) -> int:
    """The column's number of a cell such as AB12, from 0."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _first_sheet(book: zipfile.ZipFile) -> str:
    tree = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheet = next(e for e in tree.iter() if _tag(e) == "sheet")
    wanted = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(e.get("Target") for e in links if e.get("Id") == wanted)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style whether it shows a date or a time."""
    if "xl/styles.xml" not in book.namelist():
        return []
    tree = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {e.get("numFmtId"): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")) for e in tree.iter() if _tag(e) == "numFmt"}
    cells = next((e for e in tree if _tag(e) == "cellXfs"), [])
    return [int(x.get("numFmtId", 0)) in _DATES or bool(re.search("[ymdhs]", own.get(x.get("numFmtId"), ""), re.I)) for x in cells]


def sheet_rows(data: bytes) -> Iterator[list[str | None]]:
    """The rows of a workbook's first sheet, as text; dates as ISO, numbers as they are stored, gaps as null. Rows that are left out of
    the file are left out here. ValueError for what is no such workbook."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
        sheet, dates = _first_sheet(book), _date_styles(book)
        shared = [_text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        with book.open(sheet) as f:
            for _, row in ElementTree.iterparse(f):
                if _tag(row) != "row":
                    continue
                out: list[str | None] = []
                for cell in row:
                    at = _place(cell.get("r")) if cell.get("r") else len(out)
                    out += [None] * (at + 1 - len(out))
                    kind, value = cell.get("t", "n"), next((x for x in cell if _tag(x) == "v"), None)
                    if kind == "inlineStr":
                        out[at] = _text(next(x for x in cell if _tag(x) == "is"))
                    elif value is not None and value.text is not None:
                        out[at] = value.text
                        if kind == "s":
                            out[at] = shared[int(value.text)]
                        elif kind == "n" and (style := int(cell.get("s", 0))) < len(dates) and dates[style]:
                            seconds = round(float(value.text) * 86_400)
                            out[at] = (_EPOCH + dt.timedelta(seconds=seconds)).isoformat(" ")
                yield out
                row.clear()
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, IndexError) as e:
        raise ValueError(f"no workbook: {e}") from e


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheets of workbooks of one layout, as text, with the file's stem as station. The first row of each names its
    columns, and that of the first file those of all."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, data in zip(b["path"], b["content"], strict=True):
                at, held = 0, []
                for cells in sheet_rows(data):
                    held.append(cells)
                    if len(held) == 5000:
                        yield pd.DataFrame({"path": file, "at": range(at, at + len(held)), "cells": held})
                        at, held = at + len(held), []
                if held:
                    yield pd.DataFrame({"path": file, "at": range(at, at + len(held)), "cells": held})

    files = spark.read.format("binaryFile").load(path)
    rows = files.select("path", "content").mapInPandas(parse, "path string, at long, cells array<string>")
    head = files.orderBy("path").limit(1).select("path", "content").mapInPandas(parse, "path string, at long, cells array<string>").filter("at = 0").head(1)
    if not head:
        raise ValueError(f"no rows in {path}")
    names = [(c or "").strip() or f"column{i + 1}" for i, c in enumerate(head[0]["cells"])]
    stem = F.url_decode(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1))
    station = [] if "station" in names else [stem.alias("station")]
    return rows.filter("at > 0").select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)), *station)
