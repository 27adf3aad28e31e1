"""Pages and texts of PDF files through injected readers.

No PDF library is part of this package. A reader is a callable that is shipped to the executors:

* a rasteriser takes (content, dpi) and gives the PNG bytes of each page, or raises;
* a text reader takes content and gives, for each page, a dict with page_w, page_h, spans (block,
  block_type, line, span, text, font and the line's bbox in page units) and fonts (name, type,
  embedded, subset).

Everything that follows from what readers give is DataFrame operations (operators.layouts and
operators.fonts).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioqc.functions import text as X

Rasteriser = Callable[[bytes, int], list[bytes]]
BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
SPAN = f"block: bigint, block_type: int, line: bigint, span: bigint, text: string, font: string, bbox: {BOX}"
FONT = "name: string, type: string, embedded: boolean, subset: boolean"


def rendered(files: DataFrame, engines: dict[str, Rasteriser], engine: str = "auto", dpi: int = 240) -> DataFrame:
    """job_id, page_index, content (PNG), engine, error of PDF files (job_id, content).

    A named engine renders alone. "auto" takes the engines in their order, each where those before
    it failed. A file that none renders gives one row with the last error.
    """
    if engine != "auto" and engine not in engines:
        raise ValueError(f"no such engine: {engine}")
    order = list(engines.items()) if engine == "auto" else [(engine, engines[engine])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for job, content in zip(pdf["job_id"], pdf["content"]):
                error = None
                for name, render in order:
                    try:
                        pages = render(bytes(content), dpi)
                    except Exception as e:
                        error = str(e)
                        continue
                    rows += [(job, n, page, name, None) for n, page in enumerate(pages)]
                    break
                else:
                    rows.append((job, None, None, None, error))
            yield pd.DataFrame(rows, columns=["job_id", "page_index", "content", "engine", "error"]).astype({"page_index": "Int64"})

    return files.select("job_id", "content").mapInPandas(run, "job_id long, page_index int, content binary, engine string, error string")


def texts(files: DataFrame, read: Callable[[bytes], list[dict]]) -> DataFrame:
    """job_id, page_index, page_w, page_h, spans, fonts of PDF files (job_id, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for job, content in zip(pdf["job_id"], pdf["content"]):
                rows += [(job, n, float(p.get("page_w") or 1.0), float(p.get("page_h") or 1.0), p.get("spans", []), p.get("fonts", [])) for n, p in enumerate(read(bytes(content)))]
            yield pd.DataFrame(rows, columns=["job_id", "page_index", "page_w", "page_h", "spans", "fonts"])

    return files.select("job_id", "content").mapInPandas(run, f"job_id long, page_index int, page_w double, page_h double, spans array<struct<{SPAN}>>, fonts array<struct<{FONT}>>")


def spans_of(pages: DataFrame) -> DataFrame:
    return pages.select("job_id", "page_index", F.explode("spans").alias("s")).select("job_id", "page_index", "s.*")


def font_references(pages: DataFrame) -> DataFrame:
    """Fonts that pages name, with normalised names; pages count from 1."""
    f = pages.select("job_id", (F.col("page_index") + 1).alias("page"), F.explode("fonts").alias("f"))
    return f.select("job_id", "page", X.font_name(F.col("f.name")).alias("name"), F.col("f.type").alias("type"), "f.embedded", (F.col("f.subset") | X.font_is_subset(F.col("f.name"))).alias("subset"))


def font_spans(pages: DataFrame) -> DataFrame:
    """job_id, page, name, chars of text spans with any character but white space."""
    s = spans_of(pages).where("block_type = 0").select("job_id", (F.col("page_index") + 1).alias("page"), X.font_name(F.col("font")).alias("name"), X.solid_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("chars"))
    return s.where("chars > 0")


def recognise(images: DataFrame, provider: Callable[[bytes], list[dict]] | None) -> DataFrame:
    """job_id, page_index, kind (line or paragraph), item, text, bbox, confidence that an injected
    recogniser reads from page images (job_id, page_index, content); without one there are none."""
    schema = f"job_id long, page_index int, kind string, item long, text string, bbox {BOX}, confidence double"
    if provider is None:
        return images.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for job, page, content in zip(pdf["job_id"], pdf["page_index"], pdf["content"]):
                for n, item in enumerate(provider(bytes(content))):
                    rows.append((job, page, item["kind"], n, item["text"], item.get("bbox") or {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}, item.get("confidence")))
            yield pd.DataFrame(rows, columns=["job_id", "page_index", "kind", "item", "text", "bbox", "confidence"])

    return images.select("job_id", "page_index", "content").mapInPandas(run, schema)
