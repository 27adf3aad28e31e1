"""Presentation packages: slide count and size, text shapes, parts and new part names.

Packages are read with binaryFile; each is parsed whole in one task, and only the parts that are
asked for are decompressed.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# XML namespaces of the format.
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
TYPES = "{http://schemas.openxmlformats.org/package/2006/content-types}"
OFFICE = R.strip("{}")
SLIDE_TYPE = "application/vnd.openxmlformats-officedocument.presentationml.slide+xml"
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}
REFERENCE_NAME = "PDF_ORIGINAL"
# Packages that a task turns into Python objects at once.
FEW = 16
PACKAGE = {"path": pa.string(), "content": pa.binary()}
SLIDE_PART = re.compile(r"ppt/slides/slide(\d+)\.xml")
NAMED_SLIDE = re.compile(rb"""(<(?:\w+:)?cSld\b[^>]*\bname=)(["'])PDF_ORIGINAL_[^"']+\2""")


def read_packages(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pptx").option("recursiveFileLookup", "true").load(path).where("length > 0")


def metrics_of(content: bytes) -> tuple[int, int, int]:
    """Slides, width and height in EMU, from the presentation part alone."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ET.fromstring(z.read("ppt/presentation.xml"))
    size = root.find(f"{P}sldSz")
    return len(root.findall(f"{P}sldIdLst/{P}sldId")), int(size.get("cx")), int(size.get("cy"))


def slide_metrics(packages: DataFrame) -> DataFrame:
    """path, slides, width, height; unreadable packages give nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((path, *metrics_of(content)))
                except (zipfile.BadZipFile, KeyError, ET.ParseError, AttributeError):
                    rows.append((path, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "slides", "width", "height"]).astype({"slides": "Int64", "width": "Int64", "height": "Int64"})

    return packages.select("path", "content").mapInPandas(run, "path string, slides long, width long, height long")


def _offset(shape: ET.Element, tag: str) -> tuple[int, int, int, int] | None:
    x = shape.find(tag)
    off, ext = (x.find(f"{A}off"), x.find(f"{A}ext")) if x is not None else (None, None)
    return None if off is None or ext is None else (int(off.get("x")), int(off.get("y")), int(ext.get("cx")), int(ext.get("cy")))


def shapes(tree: ET.Element, dx: int = 0, dy: int = 0) -> Iterator[tuple[str, int, int, int, int, str]]:
    """(kind, left, top, width, height, paragraph) of all text, groups entered with their offset.

    A table comes before a text frame; a group whose position is broken is left out.
    """
    for s in tree:
        if s.tag == f"{P}grpSp":
            at = _offset(s, f"{P}grpSpPr/{A}xfrm")
            if at:
                yield from shapes(s, dx + at[0], dy + at[1])
        elif s.tag in (f"{P}sp", f"{P}graphicFrame"):
            at = _offset(s, f"{P}spPr/{A}xfrm") or _offset(s, f"{P}xfrm") or (0, 0, 0, 0)
            place = (at[0] + dx, at[1] + dy, at[2], at[3])
            cells = list(s.iter(f"{A}tc"))
            if cells:
                for cell in cells:
                    text = "\n".join("".join(t.text or "" for t in p.iter(f"{A}t")) for p in cell.iter(f"{A}p"))
                    if text.strip():
                        yield "table_cell", *place, " ".join(text.split())
            else:
                for p in s.iter(f"{A}p"):
                    text = "".join("\v" if n.tag == f"{A}br" else n.text or "" for n in p.iter() if n.tag in (f"{A}t", f"{A}br"))
                    if text.strip():
                        yield "paragraph", *place, " ".join(text.split())


def slide_order(z: zipfile.ZipFile) -> list[str]:
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
    root = ET.fromstring(z.read("ppt/presentation.xml"))
    return ["ppt/" + rels[s.get(f"{R}id")].lstrip("/").removeprefix("ppt/") for s in root.findall(f"{P}sldIdLst/{P}sldId")]


def slide_text(packages: DataFrame) -> DataFrame:
    """path, slide_index, ord, kind, left, top, width, height, text."""
    names = ["path", "slide_index", "ord", "kind", "left", "top", "width", "height", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for i, part in enumerate(slide_order(z)):
                        tree = ET.fromstring(z.read(part)).find(f"{P}cSld/{P}spTree")
                        rows += [(path, i, n, *s) for n, s in enumerate(shapes(tree) if tree is not None else ())]
            yield pd.DataFrame(rows, columns=names)

    return packages.select("path", "content").mapInPandas(run, "path string, slide_index int, ord int, kind string, left long, top long, width long, height long, text string")


def _in_turn(batches: Iterator[pa.RecordBatch], run, kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """run(rows) of a few rows (tuples) at a time, so that few packages are in memory at once."""
    for whole in batches:
        for at in range(0, whole.num_rows, FEW):
            rows = list(run(zip(*(c.to_pylist() for c in whole.slice(at, FEW).columns))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))


def parts(packages: DataFrame) -> DataFrame:
    """path, part, size, crc of every entry, by the directory only."""

    def listed(rows):
        for path, content in rows:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                yield from ((path, e.filename, e.file_size, e.CRC) for e in z.infolist())

    kinds = {"path": pa.string(), "part": pa.string(), "size": pa.int64(), "crc": pa.int64()}
    return packages.select("path", "content").mapInArrow(lambda batches: _in_turn(batches, listed, kinds), "path string, part string, size long, crc long")


def new_numbers(listed: DataFrame, wanted: DataFrame, pattern: str, default: int = 1) -> DataFrame:
    """wanted (path, ord) with the next free numbers after those that part names hold."""
    top = listed.groupBy("path").agg(_top_number(pattern).alias("top"))
    return wanted.join(top, "path", "left").select("path", "ord", (F.coalesce(F.col("top"), F.lit(default - 1)) + 1 + F.col("ord")).cast("bigint").alias("number"))


def next_numbers(listed: DataFrame, default: int = 1, **patterns: str) -> DataFrame:
    """path and, for each name of a pattern, the first free number after those that the package's part
    names hold. The parts are listed once for all patterns."""
    free = lambda p: (F.coalesce(_top_number(p), F.lit(default - 1)) + 1).cast("bigint")
    return listed.groupBy("path").agg(*(free(p).alias(n) for n, p in patterns.items()))


def _top_number(pattern: str):
    return F.max(F.regexp_extract("part", pattern, 1).try_cast("int"))


def blank_layout(layouts: DataFrame) -> DataFrame:
    """path, part: the first blank layout by name, else the first layout."""
    return layouts.groupBy("path").agg(F.min_by("part", F.struct((F.coalesce("type", F.lit("")) != "blank").alias("other"), F.col("part").alias("p"))).alias("part"))


def unique_names(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, ord, name: a free name PDF_ORIGINAL_nnn for each wanted slide (path, ord), in order, each
    the first that neither existing slides (path, name) nor earlier wanted ones have."""
    n = F.regexp_extract("name", f"^{REFERENCE_NAME}_([0-9]+)$", 1)
    taken = existing.where(n != "").select("path", n.cast("int").alias("n"), "name").where(F.col("name") == F.concat(F.lit(f"{REFERENCE_NAME}_"), F.lpad(F.col("n").cast("string"), F.greatest(F.lit(3), F.length(F.col("n").cast("string"))), "0")))
    taken = taken.select("path", "n").distinct()
    ranked = wanted.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("ord")))
    most = ranked.groupBy("path").agg(F.max("k").alias("k")).join(taken.groupBy("path").agg(F.count("*").alias("t")), "path", "left")
    free = most.select("path", F.explode(F.sequence(F.lit(1), (F.col("k") + F.coalesce("t", F.lit(0))).cast("int"))).alias("n")).join(taken, ["path", "n"], "left_anti")
    free = free.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("n")))
    digits = F.col("n").cast("string")
    return ranked.join(free, ["path", "k"]).select("path", "ord", F.concat(F.lit(f"{REFERENCE_NAME}_"), F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), "0")).alias("name"))


def one_name(packages: DataFrame) -> DataFrame:
    """path, content with numbered reference slides renamed to the one name; broken packages stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, renamed(bytes(c))) for p, c in zip(pdf["path"], pdf["content"])], columns=["path", "content"])

    return packages.select("path", "content").mapInPandas(run, "path string, content binary")


def renamed(content: bytes) -> bytes:
    out = io.BytesIO()
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
            for e in z.infolist():
                data = z.read(e)
                w.writestr(e, NAMED_SLIDE.sub(lambda m: m[1] + m[2] + REFERENCE_NAME.encode() + m[2], data) if SLIDE_PART.fullmatch(e.filename) else data)
    except zipfile.BadZipFile:
        return content
    return out.getvalue()


def with_notes(packages: DataFrame, notes: DataFrame) -> DataFrame:
    """path, content: packages with a note drawn on each slide that has one (path, slide_index, kind,
    left, top, width, height, lines); summaries are light, manual reviews dark with one bold line."""
    from xml.sax.saxutils import escape

    # Fill, line and letter colours.
    colours = {"summary": ("FFF9E7", "D4C48C", "3A3A3A"), "manual_review": ("585E68", "585E68", "FFFFFF")}

    def shape(n, number: int) -> str:
        fill, line, ink = colours[n.kind]
        solid = lambda c: f'<a:solidFill><a:srgbClr val="{c}"/></a:solidFill>'
        rows = "".join(
            f'<a:p><a:r><a:rPr sz="{1200 if not k else 1100}" b="{int(not k)}">{solid(ink)}</a:rPr><a:t>{escape(t)}</a:t></a:r></a:p>' for k, t in enumerate(n.lines)
        )
        return (
            f'<p:sp xmlns:p="{P.strip("{}")}" xmlns:a="{A.strip("{}")}"><p:nvSpPr><p:cNvPr id="{number}" name="{REFERENCE_NAME}"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr>'
            f'<p:spPr><a:xfrm><a:off x="{n.left}" y="{n.top}"/><a:ext cx="{n.width}" cy="{n.height}"/></a:xfrm><a:prstGeom prst="roundRect"><a:avLst/></a:prstGeom>{solid(fill)}<a:ln>{solid(line)}</a:ln></p:spPr>'
            f"<p:txBody><a:bodyPr wrap=\"square\"><a:spAutoFit/></a:bodyPr>{rows}</p:txBody></p:sp>"
        )

    def run(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        content = bytes(old["content"].iloc[0])
        for prefix, space in (("p", P), ("a", A), ("r", R)):
            ET.register_namespace(prefix, space.strip("{}"))
        changes = {}
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            slides = slide_order(z)
            for n in new.itertuples():
                if n.slide_index < len(slides):
                    root = ET.fromstring(z.read(slides[n.slide_index]))
                    tree = root.find(f"{P}cSld/{P}spTree")
                    number = _top([e.get("id", "") for e in tree.iter(f"{P}cNvPr")], r"(\d+)", 1)
                    tree.append(ET.fromstring(shape(n, number)))
                    changes[slides[n.slide_index]] = _xml(ET.tostring(root, encoding="unicode"))
        return pd.DataFrame([(key[0], rewritten(content, changes))], columns=["path", "content"])

    return packages.select("path", "content").groupBy("path").cogroup(notes.groupBy("path")).applyInPandas(run, "path string, content binary")


def numbered_names(packages: DataFrame) -> DataFrame:
    """path, content with reference slides numbered, as slides of one deck need names of their own while
    a native program builds it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    ours = [(n, z.read(n)) for n in z.namelist() if SLIDE_PART.fullmatch(n)]
                old = f'cSld name="{REFERENCE_NAME}"'.encode()
                named = {n: data.replace(old, f'cSld name="{REFERENCE_NAME}_{k:03d}"'.encode()) for k, (n, data) in enumerate(ours, 1) if old in data}
                rows.append((path, rewritten(bytes(content), named)))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return packages.select("path", "content").mapInPandas(run, "path string, content binary")


def slide_parts(packages: DataFrame) -> DataFrame:
    """path, position, part of the slides of each deck, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(path, n, part) for n, part in enumerate(slide_order(z))]
            yield pd.DataFrame(rows, columns=["path", "position", "part"])

    return packages.select("path", "content").mapInPandas(run, "path string, position int, part string")


def slide_names(packages: DataFrame) -> DataFrame:
    """path, part, name of the slides that have one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for part in filter(SLIDE_PART.fullmatch, z.namelist()):
                        name = ET.fromstring(z.read(part)).find(f"{P}cSld").get("name")
                        rows += [(path, part, name)] if name else []
            yield pd.DataFrame(rows, columns=["path", "part", "name"])

    return packages.select("path", "content").mapInPandas(run, "path string, part string, name string")


_SLIDE = (
    '<p:sld xmlns:p="{p}" xmlns:a="{a}" xmlns:r="{r}"><p:cSld name="{name}"><p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
    '<p:pic><p:nvPicPr><p:cNvPr id="2" name="{name}" descr={text}/><p:cNvPicPr><a:picLocks noChangeAspect="1"/></p:cNvPicPr><p:nvPr/></p:nvPicPr>'
    '<p:blipFill><a:blip r:embed="rId2"/><a:stretch><a:fillRect/></a:stretch></p:blipFill>'
    '<p:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{w}" cy="{h}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr></p:pic></p:spTree></p:cSld>'
    "<p:clrMapOvr><a:masterClrMapping/></p:clrMapOvr></p:sld>"
)
_SLIDE_RELS = '<Relationships xmlns="{rels}"><Relationship Id="rId1" Type="{r}/slideLayout" Target={layout}/><Relationship Id="rId2" Type="{r}/image" Target="../media/{image}"/></Relationships>'


def _top(values: list[str], pattern: str, least: int) -> int:
    return max([least - 1, *(int(m[1]) for v in values if (m := re.fullmatch(pattern, v)))]) + 1


def reference_slide_parts(content: bytes, images: list[tuple[int | None, str, bytes]]) -> dict[str, bytes]:
    """New and changed parts of a package that gets a slide for each image (slide index that it
    follows, or none for the end; file name; bytes). Only the parts that change are read, so a
    package with broken media can be patched."""
    from xml.sax.saxutils import quoteattr

    if not images:
        return {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        deck, rels, types = (ET.fromstring(z.read(n)) for n in ("ppt/presentation.xml", "ppt/_rels/presentation.xml.rels", "[Content_Types].xml"))
        layouts = sorted(n for n in names if re.fullmatch(r"ppt/slideLayouts/slideLayout\d+\.xml", n))
        if not layouts:
            raise ValueError("the package has no slide layout")
        layout = next((n for n in layouts if ET.fromstring(z.read(n)).get("type") == "blank"), layouts[0])
    listed, size = deck.find(f"{P}sldIdLst"), deck.find(f"{P}sldSz")
    if listed is None or size is None:
        raise ValueError("the package has no slide list or size")
    slide, media = _top(names, SLIDE_PART.pattern, 1), _top(names, r"ppt/media/image(\d+)\.[^.]+", 1)
    rel = _top([r.get("Id", "") for r in rels], r"rId(\d+)", 1)
    number = _top([s.get("id", "255") for s in listed], r"(\d+)", 256)
    parts: dict[str, bytes] = {}
    after: dict[int | None, list[ET.Element]] = {}
    originals = list(listed)
    placed = sorted((x for x in images if x[0] is not None and x[0] < len(originals)), key=lambda x: x[0]) + [x for x in images if x[0] is None]
    for k, (index, name, data) in enumerate(placed):
        ext = name.rpartition(".")[2].lower() if "." in name else "png"
        if ext not in IMAGE_TYPES:
            raise ValueError(f"no slide picture can be made of .{ext}")
        image, part = f"image{media + k}.{ext}", f"ppt/slides/slide{slide + k}.xml"
        shape = _SLIDE.format(p=P.strip("{}"), a=A.strip("{}"), r=OFFICE, name=REFERENCE_NAME, text=quoteattr(name), w=int(size.get("cx", "0")), h=int(size.get("cy", "0")))
        links = _SLIDE_RELS.format(rels=RELS.strip("{}"), r=OFFICE, layout=quoteattr("../slideLayouts/" + layout.rpartition("/")[2]), image=image)
        parts |= {part: _xml(shape), f"ppt/slides/_rels/slide{slide + k}.xml.rels": _xml(links), f"ppt/media/{image}": data}
        ET.SubElement(rels, f"{RELS}Relationship", {"Id": f"rId{rel + k}", "Type": f"{OFFICE}/slide", "Target": f"slides/slide{slide + k}.xml"})
        if not any(o.get("PartName") == f"/{part}" for o in types.iter(f"{TYPES}Override")):
            ET.SubElement(types, f"{TYPES}Override", {"PartName": f"/{part}", "ContentType": SLIDE_TYPE})
        if not any(d.get("Extension", "").lower() == ext for d in types.iter(f"{TYPES}Default")):
            ET.SubElement(types, f"{TYPES}Default", {"Extension": ext, "ContentType": IMAGE_TYPES[ext]})
        after.setdefault(index, []).append(ET.Element(f"{P}sldId", {"id": str(number + k), f"{R}id": f"rId{rel + k}"}))
    for child in originals:
        listed.remove(child)
    for n, child in enumerate(originals):
        listed.append(child)
        listed.extend(after.get(n, []))
    listed.extend(after.get(None, []))
    for prefix, space in (("p", P), ("a", A), ("r", R)):
        ET.register_namespace(prefix, space.strip("{}"))
    changed = {"ppt/presentation.xml": (deck, None), "ppt/_rels/presentation.xml.rels": (rels, RELS), "[Content_Types].xml": (types, TYPES)}
    for part, (root, space) in changed.items():
        if space:
            ET.register_namespace("", space.strip("{}"))
        parts[part] = _xml(ET.tostring(root, encoding="unicode"))
    return parts


def _xml(text: str) -> bytes:
    return b"<?xml version='1.0' encoding='utf-8'?>\n" + text.encode()


def with_reference_slides(packages: DataFrame, images: DataFrame) -> DataFrame:
    """path, content: packages (path, content) with a slide for each image (path, ord, after, name,
    data); after is the index of the slide that it follows, null for the end."""

    def patch(rows):
        for path, content, new in rows:
            if content is None:
                raise ValueError(f"there is no package {path} for its images")
            listed = [(i["after"], i["name"], i["data"]) for i in new]
            yield path, rewritten(content, reference_slide_parts(content, listed))

    image = F.struct("ord", "after", "name", "data")
    listed = images.groupBy("path").agg(F.sort_array(F.collect_list(image)).alias("images"))
    joined = packages.select("path", "content").join(listed.hint("merge"), "path", "full")
    asked = joined.select("path", "content", F.coalesce("images", F.array().cast(listed.schema["images"].dataType)).alias("images"))
    return asked.mapInArrow(lambda batches: _in_turn(batches, patch, PACKAGE), "path string, content binary")


def rewritten(content: bytes, changes: dict[str, bytes]) -> bytes:
    """The package with parts replaced in place and new ones at the end. Untouched parts are copied as
    they are stored, so one that is broken stays as it was and breaks nothing else."""
    out, extra = io.BytesIO(), dict(changes)
    source = io.BytesIO(content)
    with zipfile.ZipFile(source) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for e in z.infolist():
            if e.filename in extra:
                w.writestr(e.filename, extra.pop(e.filename))
                continue
            try:
                w.writestr(e, z.read(e))
            except zipfile.BadZipFile:
                source.seek(e.header_offset + 26)
                name, more = (int.from_bytes(source.read(2), "little") for _ in range(2))
                source.seek(e.header_offset + 30 + name + more)
                data = source.read(e.compress_size)
                w.writestr(e.filename, zlib.decompressobj(-15).decompress(data) if e.compress_type == zipfile.ZIP_DEFLATED else data)
        for name, data in extra.items():
            w.writestr(name, data)
    return out.getvalue()


def written(decks: DataFrame) -> DataFrame:
    """path, content of new packages, one slide for each page of a deck.

    decks has path, page_index and shapes: array<struct<left, top, width, height, kind, texts>>; kind
    is "text" (a frame with a paragraph for each text) or "table" (one row, a cell for each text).
    """
    from xml.sax.saxutils import escape

    def shape(s) -> str:
        at = f'<a:off x="{s["left"]}" y="{s["top"]}"/><a:ext cx="{s["width"]}" cy="{s["height"]}"/>'
        para = lambda t: f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>"
        if s["kind"] == "table":
            cells = "".join(f"<a:tc><a:txBody>{para(t)}</a:txBody></a:tc>" for t in s["texts"])
            return f"<p:graphicFrame><p:xfrm>{at}</p:xfrm><a:graphic><a:graphicData><a:tbl><a:tr>{cells}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
        return f'<p:sp><p:spPr><a:xfrm>{at}</a:xfrm></p:spPr><p:txBody>{"".join(map(para, s["texts"]))}</p:txBody></p:sp>'

    spaces = f'xmlns:p="{P.strip("{}")}" xmlns:a="{A.strip("{}")}" xmlns:r="{OFFICE}"'

    def package(pages: list[dict]) -> bytes:
        out = io.BytesIO()
        ids = range(1, len(pages) + 1)
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            listed = "".join(f'<p:sldId id="{255 + n}" r:id="rId{n}"/>' for n in ids)
            z.writestr("ppt/presentation.xml", _xml(f'<p:presentation {spaces}><p:sldIdLst>{listed}</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/></p:presentation>'))
            links = "".join(f'<Relationship Id="rId{n}" Type="{OFFICE}/slide" Target="slides/slide{n}.xml"/>' for n in ids)
            z.writestr("ppt/_rels/presentation.xml.rels", _xml(f'<Relationships xmlns="{RELS.strip("{}")}">{links}</Relationships>'))
            z.writestr("[Content_Types].xml", _xml(f'<Types xmlns="{TYPES.strip("{}")}"><Default Extension="xml" ContentType="application/xml"/></Types>'))
            z.writestr("ppt/slideLayouts/slideLayout1.xml", _xml(f'<p:sldLayout {spaces} type="title"/>'))
            z.writestr("ppt/slideLayouts/slideLayout2.xml", _xml(f'<p:sldLayout {spaces} type="blank"/>'))
            for n, page in zip(ids, pages):
                z.writestr(f"ppt/slides/slide{n}.xml", _xml(f'<p:sld {spaces}><p:cSld><p:spTree>{"".join(map(shape, page["shapes"]))}</p:spTree></p:cSld></p:sld>'))
        return out.getvalue()

    def run(rows):
        return ((path, package(pages)) for path, pages in rows)

    # A deck is few bytes for much work: as many tasks as a shuffle has.
    dealt = decks.select("path", "page_index", "shapes").repartition(int(decks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    listed = dealt.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("page_index", "shapes"))).alias("pages"))
    return listed.mapInArrow(lambda batches: _in_turn(batches, run, PACKAGE), "path string, content binary")


def patched(packages: DataFrame, additions: DataFrame) -> DataFrame:
    """path, content: packages with parts (path, part, data) added or replaced, in entry order."""

    def run(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        changes = {p: bytes(d) for p, d in zip(new["part"], new["data"])}
        return pd.DataFrame([(key[0], rewritten(bytes(old["content"].iloc[0]), changes))], columns=["path", "content"])

    return packages.select("path", "content").groupBy("path").cogroup(additions.groupBy("path")).applyInPandas(run, "path string, content binary")
