"""Byte-level BPE encoding and decoding with the tiktoken library.

The rank file is read by each Python worker once; its path must be valid on the
executors. Long texts are encoded piece by piece, cut where no match of the
pattern can reach across: before a space or line feed that follows a character
which is not white space. Every match of the pattern that holds white space
after its first character consists of white space only, so none spans such a
cut, and what the pattern sees ahead of a cut is white space on either side of
it. A very long run of white space, which would overflow the stack of the
library's pattern matcher, is encoded as the single match that it is. Ids and bytes are handed on piece by piece, so a text never needs more
memory than itself and its ids.

Defined results for odd inputs: a null text is an empty one (no ids, the digests
of nothing); repeated rows each get their row; an empty table gives none; order
among rows does not matter, so there are no ties. Only the two named columns are
read, others may have any names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import per_row

# Characters after which a text is cut at the next safe boundary.
PIECE_CHARS = 1 << 16
# Runs of white space from this length on bypass the pattern.
LONG_RUN = regex.compile(r"\p{White_Space}{8192,}")


@functools.cache
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut at safe boundaries
    only (a piece without one stays longer)."""
    start, n = 0, len(text)
    while n - start > size:
        cut = start + size
        while True:
            found = [i for i in (text.find(" ", cut), text.find("\n", cut)) if i >= 0]
            cut = min(found, default=n)
            if cut == n or not text[cut - 1].isspace():
                break
            cut += 1
        yield text[start:cut]
        start = cut
    if start < n:
        yield text[start:]


def encode_piece(enc: tiktoken.Encoding, piece: str) -> list[int]:
    """Token ids of one piece. The pattern takes a run of white space as one
    match, but for its last character if more text follows."""
    ids: list[int] = []
    start = 0
    for run in LONG_RUN.finditer(piece):
        end = run.end() if run.end() == len(piece) else run.end() - 1
        ids += enc.encode_ordinary(piece[start : run.start()])
        ids += enc._encode_single_piece(piece[run.start() : end])
        start = end
    return ids + enc.encode_ordinary(piece[start:])


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    """Token ids of a whole text."""
    ids: list[int] = []
    for piece in pieces(text):
        ids += encode_piece(enc, piece)
    return ids


def decode(enc: tiktoken.Encoding, ids: list[int]) -> bytes:
    """The bytes behind the ids; a token may end inside a character."""
    return enc.decode_bytes(ids)


def encoded(
    docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, the token ``ids`` (array of int) and ``decoded`` bytes."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)

        def make(ident, words):
            ids = encode(enc, words or "")
            return ident, ids, decode(enc, ids)

        for batch in batches:
            schema = pa.schema(
                [batch.schema.field(0), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]
            )
            yield from per_row([batch], schema, make)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def round_trip(
    docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_tokens, and the SHA-256 of the ids (little-endian
    unsigned 32-bit integers) and of the bytes they decode to. Encodes and
    decodes as ``encoded`` does, and hands back digests only."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)

        def make(ident, words):
            count, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
            for piece in pieces(words or ""):
                ids = encode_piece(enc, piece)
                count += len(ids)
                of_ids.update(ids_bytes(ids))
                of_bytes.update(decode(enc, ids))
            return ident, count, of_ids.hexdigest(), of_bytes.hexdigest()

        names = ("ids_sha256", "decoded_sha256")
        for batch in batches:
            fields = [batch.schema.field(0), ("n_tokens", pa.int64())]
            schema = pa.schema([*fields, *[(name, pa.string()) for name in names]])
            yield from per_row([batch], schema, make)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def ids_bytes(ids: list[int]) -> bytes:
    return pa.array(ids, pa.uint32()).buffers()[1].to_pybytes()[: 4 * len(ids)] if ids else b""
