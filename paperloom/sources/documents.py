"""Document sources: a folder's binary files, and the boundary to a text extractor."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_SCHEMA = "path string, line_no long, text string, font_size double, is_bold boolean, page int, x0 double, x1 double, y0 double, page_width double"


def scan(spark: SparkSession, folder: str, pattern: str = "*.pdf", exclude: str = "assignment", content: bool = False) -> DataFrame:
    """(path, length, modificationTime[, content]) of a folder's files in order of their
    names, without those that have ``exclude`` in it. Content is read only if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    columns = ["path", "length", "modificationTime", *(["content"] if content else [])]
    return files.where(~name.contains(exclude)).select(columns).orderBy("path")


def extract_lines(files: DataFrame, extractor: Callable[[bytes], Iterable[dict]]) -> DataFrame:
    """Text lines of binary files. The extractor turns a file's bytes into dicts of the line
    columns; a file it can't read gives no lines. Loaded once a worker, run file by file."""
    names = [c.split()[0] for c in LINE_SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [{"path": path, "line_no": i, **line} for i, line in enumerate(extractor(content))]
                except Exception:  # a broken file is no reason to lose the others
                    rows = []
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, LINE_SCHEMA)


def plain_text_lines(content: bytes) -> Iterable[dict]:
    """An extractor for text files: pages by form feeds, lines without fonts."""
    for page, part in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        for y, line in enumerate(part.splitlines()):
            if line.strip():
                yield {"text": line.strip(), "font_size": 10.0, "is_bold": False, "page": page, "x0": 0.0, "x1": 0.0, "y0": float(y), "page_width": 600.0}
