"""WARC archives in Zstandard: one frame for each record, the dictionary in a leading skippable frame.

Pages are written where they are: each task trains a dictionary on its first records, puts it into
a skippable frame at the head of its archive, and appends one frame for each record. Of equal
payloads only digests travel between tasks. The reader knows nothing but the files: it loads the
dictionary, walks frame by frame, and checks headers, lengths and digests of every record.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioqc.llm.common import cut, meet, new_path, scratch, slices

#: Payloads of fewer bytes are written again rather than referred to.
LEAST_BYTES = 100
#: Compressed bytes after which a task begins its next archive.
ARCHIVE_BYTES = 64 << 20
#: The dictionary is trained on a task's first records: at most so many, and so many bytes of each.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 1 << 14, 1 << 14
LEVEL = 3
#: A time of capture for pages that have none.
NO_DATE = "1970-01-01T00:00:00Z"

# Fixed values of the formats: frame magics (little-endian), the dictionary's skippable frame and the
# largest of that kind, lengths of the header's optional fields, names of headers, a profile.
FRAME, DICTIONARY, SKIPPABLE, SKIPPABLE_LAST, SKIPPABLE_OWN = 0xFD2FB528, 0xEC30A437, 0x184D2A50, 0x184D2A5F, 0x184D2A5D
DICTIONARY_ID_BYTES, CONTENT_SIZE_BYTES = (0, 1, 2, 4), (0, 2, 4, 8)
VERSIONS = ("WARC/1.0", "WARC/1.1")
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n"

ARCHIVE = "path string, records bigint"
RECORD = (
    "path string, nth bigint, record_type string, record_id string, page_id bigint, url string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string, payload binary, problem string"
)


class Damaged(ValueError):
    """What is wrong with a record or an archive."""


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16])}>"


def head(first: str, fields: list[tuple[str, object]]) -> bytes:
    return END.join([first.encode(), *(f"{k}: {v}".encode() for k, v in fields if v is not None), b"", b""])


def page_record(own_id: str, page_id: int | None, url: str | None, kind: str, refers_to: int | None, size: int, digest: str, payload: bytes) -> bytes:
    """A whole record. A revisit has the answer's head but no payload; the head keeps its length."""
    revisit = kind == "revisit"
    block = head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)]) + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", own_id),
        ("WARC-Date", NO_DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe="!#$&'()*+,/:;=?@[]~")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", SAME_PAYLOAD if revisit else None),
        ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
        ("Page-ID", page_id),
        ("Refers-To-Page-ID", refers_to),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return head(VERSIONS[1], fields) + block + END + END


class ArchiveWriter:
    """Writes records to a stream: the dictionary's skippable frame, then one frame a record."""

    def __init__(self, stream, sample: list[bytes]):
        self.stream, self.bytes, self.records = stream, 0, 0
        dictionary = self._trained(sample)
        if dictionary is not None:
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
            self._put(struct.pack("<II", SKIPPABLE_OWN, len(packed)) + packed)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)

    @staticmethod
    def _trained(sample: list[bytes]) -> zstandard.ZstdCompressionDict | None:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, [s[:SAMPLE_BYTES] for s in sample], k=1024, d=8)
        except zstandard.ZstdError:  # too few or too small samples: the archive has none
            return None

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.bytes += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.compressor.compress(record))
        self.records += 1


def exactly(stream, size: int) -> bytes:
    data = stream.read(size)
    if len(data) != size:
        raise Damaged("the archive ends within a frame")
    return data


def load_dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    """The dictionary of a leading skippable frame, itself compressed or not."""
    if content[:4] == struct.pack("<I", FRAME):
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    if content[:4] != struct.pack("<I", DICTIONARY):
        raise Damaged("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT)


def frames(stream) -> Iterator[tuple[bool, bytes]]:
    """(skippable, bytes) of each frame; one frame is in memory at a time.

    A frame ends where its own blocks say, so whatever lies between two frames is found out.
    """
    while magic := stream.read(4):
        kind = struct.unpack("<I", magic.ljust(4, b"\0"))[0]
        if SKIPPABLE <= kind <= SKIPPABLE_LAST:
            yield True, exactly(stream, struct.unpack("<I", exactly(stream, 4))[0])
            continue
        if kind != FRAME:
            raise Damaged("no frame begins where the last one ended")
        descriptor = exactly(stream, 1)
        single, checksum = descriptor[0] >> 5 & 1, descriptor[0] >> 2 & 1
        more = (1 - single) + DICTIONARY_ID_BYTES[descriptor[0] & 3] + (CONTENT_SIZE_BYTES[descriptor[0] >> 6] or single)
        parts, last = [magic, descriptor, exactly(stream, more)], 0
        while not last:
            block = exactly(stream, 3)
            word = int.from_bytes(block, "little")
            last = word & 1
            parts += [block, exactly(stream, 1 if word >> 1 & 3 == 1 else word >> 3)]
        parts.append(exactly(stream, 4 * checksum))
        yield False, b"".join(parts)


def fields_of(data: bytes, what: str) -> tuple[str, dict[str, str], bytes]:
    """First line, fields and rest of a record or an answer."""
    top, gap, rest = data.partition(END + END)
    if not gap:
        raise Damaged(f"the {what}'s head has no end")
    first, *lines = top.decode("utf-8", "replace").split("\r\n")
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise Damaged(f"the {what}'s head has a line that is no field")
        if name.lower() in found and name.lower() != "warc-concurrent-to":
            raise Damaged(f"the {what} has {name} twice")
        found[name.lower()] = value.strip()
    return first, found, rest


def length(fields: dict[str, str], what: str) -> int:
    value = fields.get("content-length", "")
    if not re.fullmatch("[0-9]+", value):
        raise Damaged(f"the {what}'s Content-Length is no number")
    return int(value)


class Record(NamedTuple):
    kind: str
    own_id: str
    page_id: int | None
    url: str | None
    refers_to: int | None
    size: int
    digest: str
    payload: bytes


def number(fields: dict[str, str], name: str) -> int | None:
    value = fields.get(name.lower())
    if value is None:
        return None
    if not re.fullmatch("-?[0-9]+", value):
        raise Damaged(f"{name} is no number")
    return int(value)


def parsed(data: bytes) -> Record | None:
    """The record of one frame, checked; None for kinds other than response and revisit."""
    first, fields, rest = fields_of(data, "record")
    if first not in VERSIONS:
        raise Damaged("the version line is unknown")
    if missing := [n for n in REQUIRED if not fields.get(n.lower())]:
        raise Damaged(f"{missing[0]} is missing")
    size = length(fields, "record")
    if len(rest) != size + 4 or rest[size:] != END + END:
        raise Damaged("the block is not as long as Content-Length says")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    _, answer, payload = fields_of(rest[:size], "answer")
    full = length(answer, "answer")
    digest = re.fullmatch("sha256:([0-9a-f]{64})", fields.get("warc-payload-digest", ""))
    if not digest:
        raise Damaged("WARC-Payload-Digest is no sha256")
    refers_to = number(fields, "Refers-To-Page-ID")
    if kind == "revisit":
        if payload:
            raise Damaged("a revisit has a payload")
        if fields.get("warc-profile") != SAME_PAYLOAD or fields.get("warc-refers-to") != record_id(refers_to, digest[1]):
            raise Damaged("a revisit does not name the record that it repeats")
    elif len(payload) != full or hashlib.sha256(payload).hexdigest() != digest[1]:
        raise Damaged("the payload is not what its length and digest say")
    url = fields.get("warc-target-uri")
    return Record(kind, fields["warc-record-id"], number(fields, "Page-ID"), None if url is None else unquote(url), refers_to, full, digest[1], payload)


def records(stream) -> Iterator[tuple[Record | None, str | None]]:
    """(record, None) or (None, what is wrong) for each frame of an archive but its dictionary.

    A damaged record is told and passed over; after a damaged frame the archive cannot be read on.
    """
    decompressor = zstandard.ZstdDecompressor()
    try:
        for nth, (skippable, content) in enumerate(frames(stream)):
            if skippable:
                if nth == 0:
                    decompressor = zstandard.ZstdDecompressor(dict_data=load_dictionary(content))
                continue
            try:
                single = decompressor.decompressobj()
                data = single.decompress(content)
                if not single.eof:
                    raise Damaged("the frame has no end")
                yield parsed(data), None
            except (Damaged, zstandard.ZstdError) as problem:
                yield None, str(problem)
    except (Damaged, zstandard.ZstdError) as problem:
        yield None, str(problem)


def planned(pages: DataFrame) -> DataFrame:
    """Each page with the record that it becomes: page_id, url, html (null for revisits), bytes,
    digest, record_type, refers_to and unique (whether page and payload tell it from all others).

    Groups of equal payloads are found by digest; rows meet only groups of two and more. Of a group
    the smallest page_id (null last), then the smallest url (null first), keeps the payload; rows
    that repeat that very page are one response and revisits for the rest.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("bigint")).withColumn("digest", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    pairs = rows.where(F.col("bytes") >= LEAST_BYTES).groupBy("digest", "page_id", "url").agg(F.count("*").alias("n"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "n")
    groups = pairs.groupBy("digest").agg(F.min(order).alias("first"), F.sum("n").alias("size")).where("size > 1")
    groups = cut(groups.select("digest", F.col("first.page_id").alias("keep_id"), F.col("first.url").alias("keep_url"), F.col("first.n").alias("keep_rows"), F.lit(True).alias("grouped")), "payloads")
    met = meet(rows, groups, ["digest"], "left")
    first = F.col("page_id").eqNullSafe(F.col("keep_id")) & F.col("url").eqNullSafe(F.col("keep_url"))
    revisit = F.col("grouped").isNotNull() & ~first

    def as_records(part: DataFrame, again) -> DataFrame:
        return part.select(
            "page_id", "url", F.when(~again, F.col("html")).alias("html"), "bytes", F.hex("digest").alias("digest"),
            F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("keep_id")).alias("refers_to"),
            ((F.col("bytes") >= LEAST_BYTES) & ~again).alias("unique"),
        )

    repeated = F.col("grouped").isNotNull() & first & (F.col("keep_rows") > 1)
    out = as_records(met.where(~repeated), revisit)
    if groups.where("keep_rows > 1").isEmpty():
        return out
    # Equal rows are counted, not gathered: one keeps the payload, one comes back for each other.
    same = met.where(repeated).groupBy("digest", "page_id", "url", "bytes", "keep_id").agg(F.first("html").alias("html"), F.count("*").alias("n"))
    same = same.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return out.unionByName(as_records(same, F.col("copy") > 1))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages as archives of folder; returns path and records of each.

    An archive's name is its attempt's own, and only the list returned by tasks that succeeded says
    which archives there are: a lost or repeated task leaves files that nobody reads.
    """
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def encoded(batches: Iterator[pa.RecordBatch], run: str) -> Iterator[bytes]:
        numbers = itertools.count()
        for batch in slices(batches, 200):
            for page_id, url, html, size, digest, kind, refers_to, unique in zip(*(c.to_pylist() for c in batch.columns)):
                digest = digest.lower()
                own = record_id(page_id, digest) if unique else record_id(run, next(numbers))
                yield page_record(own, page_id, url, kind, refers_to, size, digest, (html or "").encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        rows, name = [], uuid.uuid4().hex
        left = encoded(batches, name)
        while sample := list(itertools.islice(left, SAMPLE_RECORDS)):
            path = f"{root}/{name}-{len(rows):05d}.warc.zst"
            with store.open_output_stream(path) as stream:
                writer = ArchiveWriter(stream, sample)
                info = head("WARC/1.1", [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(path)), ("WARC-Date", NO_DATE), ("Content-Length", 0)])
                writer.add(info + END + END)
                for record in itertools.chain(sample, left):
                    writer.add(record)
                    if writer.bytes >= ARCHIVE_BYTES:
                        break
            rows.append((path, writer.records))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64()))], ["path", "records"])

    return cut(planned(pages).mapInArrow(run, ARCHIVE), "archives")


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """A row for every record of the archives: path, nth, record_type, record_id, page_id, url,
    refers_to, payload_bytes, payload_digest, payload (none for revisits) and problem.

    A damaged record, an archive that cannot be read on, and one with fewer or more records than
    listed give a row with a problem; the other records come out all the same.
    """
    schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in RECORD.split(", "))])

    def rows_of(store, path: str, listed: int) -> Iterator[tuple]:
        nth = 0
        with store.open_input_stream(path, buffer_size=1 << 20) as stream:
            for nth, (r, problem) in enumerate(records(stream), 1):
                if problem:
                    yield (path, nth, *[None] * 8, problem)
                elif r:
                    yield (path, nth, r.kind, r.own_id, r.page_id, r.url, r.refers_to, r.size, r.digest, r.payload if with_payload and r.kind == "response" else None, None)
        if nth != listed:
            yield (path, nth + 1, *[None] * 8, f"{nth} of {listed} records were found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, listed in zip(*(c.to_pylist() for c in batch.columns)):
                found = rows_of(store, path, listed)
                while part := list(itertools.islice(found, 500)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)

    spread = archives.repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(run, RECORD)


def archived(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Write pages to new archives in the shared folder and return what these say of every page.

    A null html is empty; payloads under LEAST_BYTES are all responses. Of equal larger ones the
    smallest page_id keeps the payload (null after all numbers), and of rows that repeat that page
    one does. A null page_id or url is a field that the record lacks. No page, no archive. Only
    page_id, url and html are read, so other columns may have any names; a page of any length is
    one record.
    """
    folder = re.sub("^file:/+", "file:///", new_path(pages.sparkSession, "warc"))
    with scratch() as keep:
        listed = keep(write_archives(pages, folder))
    return read_archives(listed, folder, with_payload)
