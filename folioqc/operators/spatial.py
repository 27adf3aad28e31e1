"""Spatial joins over grids of several widths.

A box belongs to the grid whose cells are just larger than it, so it lies in four of them at most,
and to the cells above these in all wider grids. Two boxes that share a point share a cell of the
wider one's own grid; only such pairs are tested, so the tests of a page grow with its boxes and
with how many truly lie together, not with the square of all. Cells are keys of equality, so a
page with very many boxes is dealt to many tasks. Rows in cells are far more than the files behind
them suggest, so they are never broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioqc.functions import geometry as G
from folioqc.params import DEFAULT

#: The finest grid has 2 to this power cells a side.
FINEST = 10


def cells(box: Column) -> Column:
    """Array of level, cx, cy and own (whether the level is the box's) of the cells that box touches."""
    size = F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"], F.lit(2.0**-FINEST))
    level = F.greatest(F.lit(0), F.floor(-F.log2(size)).cast("int"))

    def places(width: Column, lo: Column, hi: Column) -> Column:
        last = (width - 1).cast("int")
        at = lambda v: F.least(last, F.greatest(F.lit(0), F.floor(v * width).cast("int")))
        return F.sequence(at(F.least(lo, hi)), at(F.greatest(lo, hi)))

    def of_level(n: Column) -> Column:
        width = F.pow(F.lit(2.0), n)
        rows = F.transform(places(width, box["y0"], box["y1"]), lambda y: F.transform(places(width, box["x0"], box["x1"]), lambda x: F.struct(n.alias("level"), x.alias("cx"), y.alias("cy"), (n == level).alias("own"))))
        return F.flatten(rows)

    return F.when(box.isNotNull(), F.flatten(F.transform(F.sequence(F.lit(0), level), of_level)))


def _in_cells(rows: DataFrame, suffix: str) -> DataFrame:
    """rows with their bbox as box{suffix}, once for each cell."""
    named = rows.withColumnsRenamed({c: f"{c}{suffix}" for c in rows.columns})
    return named.withColumn(f"cell{suffix}", F.explode(cells(F.col(f"bbox{suffix}"))))


def _meeting(left: str, right: str) -> Column:
    a, b = F.col(f"cell{left}"), F.col(f"cell{right}")
    return (a["level"] == b["level"]) & (a["cx"] == b["cx"]) & (a["cy"] == b["cy"]) & (a["own"] | b["own"])


def pairs(left: DataFrame, right: DataFrame, keys: list[str], test) -> DataFrame:
    """Pairs of rows with equal keys that share a point and pass test(left box, right box), once
    each: where the lower corner of what they share lies. Columns end in _l and _r."""
    a, b = F.col("bbox_l"), F.col("bbox_r")
    width = F.pow(F.lit(2.0), F.col("cell_l")["level"])
    at = lambda x, y: F.least((width - 1).cast("int"), F.greatest(F.lit(0), F.floor(F.greatest(x, y) * width).cast("int")))
    here = (F.col("cell_l")["cx"] == at(F.least(a["x0"], a["x1"]), F.least(b["x0"], b["x1"]))) & (F.col("cell_l")["cy"] == at(F.least(a["y0"], a["y1"]), F.least(b["y0"], b["y1"])))
    same = _meeting("_l", "_r") & here & test(a, b)
    for k in keys:
        same = same & (F.col(f"{k}_l") == F.col(f"{k}_r"))
    return _in_cells(left, "_l").join(_in_cells(right, "_r").hint("merge"), same).drop("cell_l", "cell_r")


def hits(left: DataFrame, right: DataFrame, test) -> DataFrame:
    """slide, bbox: the distinct boxes of left that some box of right on their slide shares a point
    with and that pass test(left box, right box)."""
    boxes = lambda d: d.select("slide", "bbox").distinct()
    same = (F.col("slide_l") == F.col("slide_r")) & _meeting("_l", "_r") & test(F.col("bbox_l"), F.col("bbox_r"))
    found = _in_cells(boxes(left), "_l").join(_in_cells(boxes(right), "_r").hint("merge"), same, "left_semi")
    return found.select(F.col("slide_l").alias("slide"), F.col("bbox_l").alias("bbox")).distinct()


def touches(finding: Column, region: Column) -> Column:
    return (G.iou(finding, region) >= DEFAULT.colour_iou) | G.contains(region, G.centre_x(finding), G.centre_y(finding))


def uncovered(regions: DataFrame, boxes: DataFrame, threshold: float = DEFAULT.missing_overlap) -> DataFrame:
    """Regions (slide, bbox) of whose area no box of the slide covers the threshold (above 0)."""
    return regions.join(hits(regions, boxes, lambda a, b: G.overlap_ratio(a, b) >= threshold).hint("merge"), ["slide", "bbox"], "left_anti").select(regions.columns)


def on_text(findings: DataFrame, regions: DataFrame) -> DataFrame:
    return findings.join(hits(findings, regions, touches).hint("merge"), ["slide", "bbox"], "left_semi").select(findings.columns)


def supported(findings: DataFrame, supports: DataFrame) -> DataFrame:
    """Findings that touch a support or have their centre in the same ninth of the page as one."""
    ninths = supports.select("slide", G.grid_cell(F.col("bbox")).alias("ninth")).distinct()
    placed = findings.withColumn("ninth", G.grid_cell(F.col("bbox")))
    near = placed.join(ninths, ["slide", "ninth"], "left_semi").select(findings.columns)
    return near.unionByName(on_text(placed.join(ninths, ["slide", "ninth"], "left_anti").select(findings.columns), supports))


def visual_fallback(findings: DataFrame, regions: DataFrame) -> DataFrame:
    """Confident findings that touch no text region."""
    sure = findings.where(F.col("confidence") >= DEFAULT.colour_confidence)
    return sure.join(hits(sure, regions, touches).hint("merge"), ["slide", "bbox"], "left_anti").select(findings.columns)


def lines_of_paragraphs(lines: DataFrame, paragraphs: DataFrame, threshold: float = DEFAULT.line_overlap) -> DataFrame:
    """slide, para, n_lines and the sorted ords of the lines that cover the threshold (above 0) of the
    paragraph's area."""
    met = pairs(paragraphs.select("slide", "ord", "bbox"), lines.select("slide", "ord", "bbox"), ["slide"], lambda p, l: G.overlap_ratio(p, l) >= threshold)  # noqa: E741
    found = met.groupBy(F.col("slide_l").alias("slide"), F.col("ord_l").alias("para")).agg(F.count("*").alias("n_lines"), F.sort_array(F.collect_list("ord_r")).alias("lines"))
    none = F.array().cast(found.schema["lines"].dataType)
    listed = paragraphs.select("slide", F.col("ord").alias("para")).join(found, ["slide", "para"], "left")
    return listed.select("slide", "para", F.coalesce("n_lines", F.lit(0).cast("bigint")).alias("n_lines"), F.coalesce("lines", none).alias("lines"))


def visual_filter(findings: DataFrame, regions: DataFrame) -> DataFrame:
    """Drops layout findings, content findings in the edge band, and colour findings that are not
    confident or not on text."""
    content = findings.where(F.col("type").isin("missing_content", "extra_content") & ~G.in_edge_band(F.col("bbox")))
    colour = on_text(findings.where((F.col("type") == "wrong_color") & (F.col("confidence") >= DEFAULT.colour_confidence)), regions)
    return content.unionByName(colour).unionByName(findings.where("type = 'wrong_text'"))
