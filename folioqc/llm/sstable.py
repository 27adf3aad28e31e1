"""Token identifiers in sorted-string-table shards.

A shard holds documents in key order:

    data block*   zlib of entries (shared prefix length u8, key suffix length u8, suffix,
                  value length u32, value); a block starts at about BLOCK_BYTES of values
    index         for each block: first key (KEY_BYTES), offset u64, size u32
    bloom         bit array
    footer        index offset u64, blocks u32, bloom offset u64, bloom bytes u32, probes u32,
                  documents u64, identifiers u64, magic

All integers are little-endian but for the key: a null flag, the identifier with its sign bit
turned, big-endian, and the number among the shard's rows of the same identifier. So byte order is
document order, nulls last; rows of one identifier may go on in the next shard. A value is the identifiers as u16 if all fit, else as u32, after a width byte.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioqc.llm.common import cut, new_path, slices

MAGIC = b"FQSST001"
KEY_BYTES = 13
BLOCK_BYTES = 64 << 10
SHARD_IDS = 16 << 20
BLOOM_BITS = 10
BLOOM_PROBES = 7
FOOTER = struct.Struct("<QIQIIQQ8s")
INDEX = struct.Struct(f"<{KEY_BYTES}sQI")
MEMO_WORDS = 800_000


def make_key(doc_id: int | None, nth: int = 0) -> bytes:
    return struct.pack(">BQI", doc_id is None, ((doc_id or 0) + (1 << 63)) & ((1 << 64) - 1), nth)


def key_id(key: bytes) -> int | None:
    null, number, _ = struct.unpack(">BQI", key)
    return None if null else number - (1 << 63)


def pack_ids(ids: np.ndarray) -> bytes:
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


def _probes(key: bytes, bits: int) -> list[int]:
    """Bloom positions; over the identifier alone, so that a lookup needs no row number."""
    h = xxhash.xxh3_128_intdigest(key[:9])
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


class ShardWriter:
    """Writes entries given in ascending key order."""

    def __init__(self, out):
        self.out, self.at, self.index, self.keys = out, 0, [], []
        self.block, self.first, self.last, self.weight, self.ids = [], b"", b"", 0, 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key <= self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < KEY_BYTES and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        value = pack_ids(ids)
        self.block.append(struct.pack("<BB", shared, KEY_BYTES - shared) + key[shared:] + struct.pack("<I", len(value)) + value)
        self.last, self.weight, self.ids = key, self.weight + len(value), self.ids + len(ids)
        self.keys.append(key)
        if self.weight >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = zlib.compress(b"".join(self.block), 1)
            self.out.write(data)
            self.index.append(INDEX.pack(self.first, self.at, len(data)))
            self.at, self.block, self.weight = self.at + len(data), [], 0

    def finish(self) -> None:
        self._flush()
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        self.out.write(index + bytes(bloom))
        self.out.write(FOOTER.pack(self.at, len(self.index), self.at + len(index), len(bloom), BLOOM_PROBES, len(self.keys), self.ids, MAGIC))


class ShardReader:
    """Reads one shard from a random-access file: footer and index first, blocks as needed."""

    def __init__(self, file):
        self.file, self._open = file, (-1, {})
        size = file.size()
        at, blocks, bloom_at, bloom_bytes, _, self.documents, self.ids, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw = file.read_at(blocks * INDEX.size, at) if blocks else b""
        self.index = list(INDEX.iter_unpack(raw))
        self.first_keys = [key for key, _, _ in self.index]
        self.bloom = file.read_at(bloom_bytes, bloom_at)

    def block(self, n: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size = self.index[n]
        data, p, key = zlib.decompress(self.file.read_at(size, at)), 0, b""
        while p < len(data):
            shared, more = data[p], data[p + 1]
            key = key[:shared] + data[p + 2 : p + 2 + more]
            p += 2 + more
            (length,) = struct.unpack_from("<I", data, p)
            yield key, unpack_ids(data[p + 4 : p + 4 + length])
            p += 4 + length

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for n in range(len(self.index)):
            self._open = n, dict(self.block(n))
            yield from self._open[1].items()

    def may_hold(self, doc_id: int | None) -> bool:
        for p in _probes(make_key(doc_id), len(self.bloom) * 8):
            if not self.bloom[p >> 3] >> (p & 7) & 1:
                return False
        return True

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """Identifiers of the shard's first row with this identifier: the Bloom filter, then binary
        search in the sparse index, then the one block that can hold it (the last one is kept)."""
        if not self.documents or not self.may_hold(doc_id):
            return None
        key = make_key(doc_id)
        n = bisect.bisect_right(self.first_keys, key) - 1
        if n < 0:
            return None
        if self._open[0] != n:
            self._open = n, dict(self.block(n))
        return self._open[1].get(key)


class _Memo(dict):
    """Packed identifiers of a spaced word, encoded when first met."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> bytes:
        packed = self[word] = np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return packed


class WordEncoder:
    """Whole-text encoding with the tokenizers library, through a bounded memo of spaced words.

    A byte-level pre-tokenizer with the library's own pattern always splits before a space that
    follows a non-space, between a letter and a mark, and around a line end between non-spaces. So
    a text without white space next to white space around a space may be encoded piece by piece at
    these places. Texts that may hold an added token go to the library as a whole, and so does
    every text if the tokenizer file is of any other kind. Of a batch's pieces each distinct one
    is looked up once.
    """

    #: White space of any library here, and the texts that must stay whole.
    SPACE = r"\s\x0b\x1c-\x1f\x{85}\pZ"
    WHOLE = rf"\x00|\A |[{SPACE}] [{SPACE}]|[{SPACE}]\z"
    CUTS = ((r"([a-z])([.,;:!?])", "\\1\0\\2"), (rf"([^{SPACE}])\n([A-Za-z])", "\\1\0\n\0\\2"))

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = _Memo(self.tokenizer)
        self.memo_words = memo_words
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        added = [t["content"] for t in kind.get("added_tokens") or ()]
        self.in_pieces = self._splits_at_spaces(kind) and all(len(t) > 1 and not re.search(r"[\s\\]", t) for t in added)
        self.not_in_pieces = "|".join([self.WHOLE, *(re.escape(t[:2]) for t in added)])

    @staticmethod
    def _splits_at_spaces(kind: dict) -> bool:
        before = kind.get("pre_tokenizer") or {}
        model = kind.get("model") or {}
        return (
            before.get("type") == "ByteLevel" and before.get("use_regex") is True and before.get("add_prefix_space") is False
            and not any(kind.get(k) for k in ("normalizer", "truncation", "padding")) and (kind.get("post_processor") or {}).get("type", "ByteLevel") == "ByteLevel"
            and model.get("type") == "BPE" and not model.get("dropout")
        )

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Identifiers (u32) of each of an array of texts without nulls."""
        if not len(texts):
            return []
        if len(self.memo) > self.memo_words:
            self.memo.clear()
        if not self.in_pieces:
            return [self.whole(t) for t in texts.to_pylist()]
        whole = pc.match_substring_regex(texts, self.not_in_pieces)
        spaced = iter(self._spaced(texts.filter(pc.invert(whole))))
        return [self.whole(texts[i].as_py()) if w else next(spaced) for i, w in enumerate(whole.to_pylist())]

    def _spaced(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        marked = pc.replace_substring(texts, " ", "\0 ")
        for pattern, cut_there in self.CUTS:
            marked = pc.replace_substring_regex(marked, pattern, cut_there)
        split = pc.split_pattern(marked, "\0")
        offsets = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        at = coded.indices.to_numpy()
        packed = [self.memo[w] for w in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
        start = np.cumsum(size) - size
        n = size[at]
        end = np.cumsum(n)
        ids = np.frombuffer(b"".join(packed), "<u4")[np.repeat(start[at] - (end - n), n) + np.arange(end[-1])]
        return np.split(ids, end[offsets[1:-1] - 1])


@functools.lru_cache(maxsize=1)
def _encoder(path: str, memo_words: int) -> WordEncoder:
    """The encoder of a worker process, kept for its next tasks."""
    return WordEncoder(path, memo_words)


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Encode every whole text, append end_id and write shards; returns part, shard, path, documents, ids.

    One range shuffle on doc_id and a digest of the text moves texts (not the longer identifiers)
    into key order, so that rows of one identifier, or of none, are dealt to as many tasks as they
    fill; each task then encodes its range and writes shards of at most about SHARD_IDS
    identifiers. A file's name is its attempt's own, and only shards that a task which succeeded
    lists are read, so a lost or repeated task leaves none. Null texts are empty; null identifiers sort last; repeated
    identifiers keep one entry each, ordered by that digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, memo_words)
        store, root = fs.FileSystem.from_uri(folder)
        part, shard, rows = TaskContext.get().partitionId(), 0, []
        tail = np.asarray([end_id], "<u4")
        stream = writer = None
        last, nth = (), 0

        def close():
            nonlocal stream, writer, shard
            writer.finish()
            stream.close()
            rows.append((part, shard, path, len(writer.keys), writer.ids))
            stream = writer = None
            shard += 1

        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            for doc_id, encoded in zip(ids, encoder.encode(batch.column(1))):
                if writer is None:
                    path = f"{root}/shard-{part:06d}-{shard:05d}-{uuid.uuid4().hex}.sst"
                    stream = store.open_output_stream(path)
                    writer = ShardWriter(stream)
                nth = nth + 1 if last == (doc_id,) else 0
                last = (doc_id,)
                writer.add(make_key(doc_id, nth), np.concatenate([encoded, tail]))
                if writer.ids >= SHARD_IDS:
                    close()
        if writer is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
            ["part", "shard", "path", "documents", "ids"],
        )

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    ranged = slim.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return cut(ranged.mapInArrow(run, "part bigint, shard bigint, path string, documents bigint, ids bigint"), "shards")


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every entry, read back from the files, and found: if a
    search for the identifier (Bloom filter, sparse index, block) ends at an entry of the shard.

    Only the list of shards is summed in one place (a row for each file of SHARD_IDS identifiers);
    documents are read block by block where their shard is.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = shards.select("part", "shard", "path", before.alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "found"]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        for batch in batches:
            for path, start in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                rows = []
                with store.open_input_file(path) as file:
                    reader = ShardReader(file)
                    for key, ids in reader:
                        doc_id = key_id(key)
                        hit = reader.get(doc_id)
                        same = hit is not None and (key != make_key(doc_id) or hit is ids)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), same))
                        start += len(ids)
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    spread = listed.repartition(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part", "shard")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, found boolean")


def token_shards(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the shards of docs to a new shared folder and return what the files say.

    Null and empty texts have the end token alone; a null doc_id comes last, after all numbers;
    rows of one doc_id are entries of their own; no row, no shard. Only doc_id and text are read,
    so other columns may have any names; a text of any length is one entry.
    """
    folder = re.sub("^file:/+", "file:///", new_path(docs.sparkSession, "sst"))
    return read_shards(write_shards(docs, tokenizer_path, end_id, folder), folder)
