"""External converters as injected callables, chosen and tried on the driver.

A converter is an object with name, available() and any of to_pdf(deck, target), to_images(deck,
folder, dpi) and build(deck, actions, target). Nothing here runs a program of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Converter(Protocol):
    name: str

    def available(self) -> bool: ...


def in_order(available: list[str], preferred: str | None = None, fallback: bool = True, office_first: bool = True) -> list[str]:
    """Converter names to try, each once: the preferred one, then the other if falling back is
    allowed; without a preference the office suite, then the native one if it may stand in."""
    wanted = (preferred or "").strip().lower()
    if wanted:
        other = "libreoffice" if wanted == "powerpoint" else "powerpoint"
        names = [wanted, *([other] if fallback else [])]
    else:
        names = ["libreoffice", *(["powerpoint"] if office_first or "libreoffice" not in available else [])]
    return [n for n in dict.fromkeys(names) if n in available]


def first_that_works(converters: list[Converter], call: Callable[[Converter], object]) -> tuple[str, object]:
    """Name and result of the first converter that is available and does not fail."""
    error: Exception | None = None
    for c in converters:
        if c.available():
            try:
                return c.name, call(c)
            except Exception as e:
                error = e
    raise RuntimeError(f"no converter could do it: {error}" if error else "no converter is available")


def wrong_image_counts(slides: DataFrame, images: DataFrame) -> DataFrame:
    """job_id, error of jobs whose exported images (job_id) are not as many as their slides (job_id, n_slides)."""
    n = images.groupBy("job_id").agg(F.count("*").alias("n"))
    joined = slides.join(n, "job_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    said = F.concat(F.lit("PowerPoint slide-image export produced the wrong number of PNG files ("), F.col("n").cast("string"), F.lit(" exported for "), F.col("n_slides").cast("string"), F.lit(" slides)."))
    return joined.where(F.col("n") != F.col("n_slides")).select("job_id", said.alias("error"))
