"""Byte-level BPE by monoid tree reduction.

A text is a binary tree of halves. A leaf is encoded on its own; two neighbours are joined by
re-encoding a window around their border that grows until both of its ends are cuts at which
the pre-tokenizer is bound to split, whatever stands on the other side. Tokens outside of such
a window cannot change, so the join equals the encoding of the joined text, and joining is
associative: any bracketing gives the same identifiers.

Why a cut between a non-space and a space is safe: no alternative of the pattern matches a
space after a non-space, so the match left of the cut ends there with or without its right
side, and matching goes on at the cut as it would at the start of a text. Merges never leave a
match.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioqc.llm.common import slices

SAFE_CUT = re.compile(r"(?<=\S)[ \n\t]")
#: Fixed value: the pattern for which these cuts are safe.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF_CHARS = 64
FIRST_WINDOW = 16
DECODE_LEAF = 64


class TreeCodec:
    """Encoder and decoder over one rank file."""

    def __init__(self, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        if pattern != PATTERN:
            raise ValueError("cuts before white space are not known to be safe for this pattern")
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        self.leaf_chars = max(1, leaf_chars)
        self.joins = 0

    def encode(self, text: str) -> list[int]:
        return self._span(text, 0, len(text)) if text else []

    def _span(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf_chars:
            return self._encode(text[a:b])
        m = (a + b) // 2
        return self.join(text, a, m, b, self._span(text, a, m), self._span(text, m, b))

    def join(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of text[a:b] from those of text[a:m] and text[m:b]."""
        self.joins += 1
        lo, hi = self._left_cut(text, a, m), self._right_cut(text, m, b)
        if lo == hi:
            left += right
            return left
        keep = len(left) - self._covering(reversed(left), len(text[lo:m].encode()))
        skip = self._covering(iter(right), len(text[m:hi].encode()))
        del left[keep:]
        left += self._encode(text[lo:hi])
        left += right[skip:]
        return left

    def _left_cut(self, text: str, a: int, m: int) -> int:
        width = FIRST_WINDOW
        while m - width > a:
            cuts = [c.start() for c in SAFE_CUT.finditer(text, m - width, m + 1)]
            if cuts:
                return cuts[-1]
            width *= 2
        cuts = [c.start() for c in SAFE_CUT.finditer(text, a + 1, m + 1)]
        return cuts[-1] if cuts else a

    def _right_cut(self, text: str, m: int, b: int) -> int:
        width = FIRST_WINDOW
        while True:
            cut = SAFE_CUT.search(text, m, min(b, m + width))
            if cut:
                return cut.start()
            if m + width >= b:
                return b
            width *= 2

    def _covering(self, tokens: Iterable[int], n_bytes: int) -> int:
        """How many of the tokens, in order, make up exactly n_bytes."""
        n = 0
        for token in tokens if n_bytes else ():
            n_bytes -= len(self.pieces[token])
            n += 1
            if n_bytes <= 0:
                break
        if n_bytes:
            raise AssertionError("a window's end is no token boundary")
        return n

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.pieces.__getitem__, ids))
        m = len(ids) // 2
        return self.decode(ids[:m]) + self.decode(ids[m:])


_codecs: dict[tuple, TreeCodec] = {}


def codec(ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> TreeCodec:
    """One codec for each worker process and vocabulary."""
    key = (ranks_path, pattern, leaf_chars)
    if key not in _codecs:
        _codecs[key] = TreeCodec(*key)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_joins (of the text's tree) and, if asked,
    token_ids of every whole text.

    Null texts count as empty: no tokens, digests of nothing. Null identifiers and repeated rows
    give one row each; only doc_id and text are read, so other columns may have any names. No row,
    no output. No shuffle: documents are independent, and a long one is a deeper tree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(ranks_path, pattern, leaf_chars)
        for batch in slices(batches):
            counts, digests, decoded, joins, tokens = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                before = tree.joins
                ids = tree.encode(text or "")
                joins.append(tree.joins - before)
                packed = np.asarray(ids, dtype="<u4")
                counts.append(len(ids))
                digests.append(hashlib.sha256(packed.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(tree.decode(ids)).hexdigest())
                if with_ids:
                    tokens.append(packed.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), pa.array(joins, pa.int64())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_joins"]
            if with_ids:
                columns.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_joins bigint"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, schema + (", token_ids array<int>" if with_ids else "")
    )
