"""Token counts by whole-token shortcut.

Before any text is read, every vocabulary string that can be a whole pre-token is
run through the merges once; those that come out as the single token of that
string are *proven whole*. While counting, a pre-token among them counts one and
no merge is run; only the rest is merged by the library.

A match of the pre-tokenizer's pattern never holds white space, the normalizer
neither joins characters across white space nor makes any vanish, and a special
string holds none. So a text's count is the sum over its pieces between white
space. A piece of letters up to U+017F (all of them normal, each with a lower case
of its own) is one pre-token, its lower case; printable ASCII is cut by the same
pattern here; all other pieces are left to the library's normalizer and
pre-tokenizer. Pieces and pre-tokens, which repeat a lot, are remembered
(boundedly).

Defined results for odd inputs: a null text is an empty one (0 tokens); strings of
special tokens inside texts count as one token each, the library's default;
repeated rows each get their row; an empty table gives none; there are no ties.
Only the two named columns are read, others may have any names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .tables import per_row

LIMIT = 2048
# Pieces remembered by a worker, and the longest that is.
MEMORY = 300_000
LONGEST = 64
# Byte-level alphabet (fixed values): printable bytes stand for themselves, the
# others for the characters from 256 on, in order.
SIMPLE_LETTERS = "\u017f"
SPACE = regex.compile(r"[\t-\r ]+")
# The pre-tokenizer's pattern where all text is lower-case printable ASCII (fixed value).
ASCII_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[int, str]:
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counter:
    """Counts the tokens of texts as ``tokenizer.encode`` would, without
    begin, end or other added tokens."""

    def __init__(self, path: str):
        self.known: dict[str, int] = {}
        self.merged: dict[str, int] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = self.prove()
        alphabet = byte_alphabet()
        self.byte_level = {byte: alphabet[byte] for byte in range(256)}
        spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
        visible = [c for c in spaces if self.plain(c)]
        self.visible = regex.compile("[" + "".join(map(regex.escape, visible)) + "]")
        added = self.tokenizer.get_added_tokens_decoder().values()
        special = sorted((t.content for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def prove(self) -> frozenset[str]:
        """Vocabulary strings that alone, as a pre-token, become one token: their
        own. Found by running the merges on each, not by assuming it."""
        model, alphabet = self.tokenizer.model, set(byte_alphabet().values())
        end = model.end_of_word_suffix or ""
        proven = []
        for token in self.tokenizer.get_vocab(with_added_tokens=False):
            body = token[: len(token) - len(end)] if end and token.endswith(end) else token
            if body and (body != token or not end) and alphabet.issuperset(body):
                merged = model.tokenize(body)
                if len(merged) == 1 and merged[0].value == token:
                    proven.append(body)
        return frozenset(proven)

    def pre_token(self, token: str) -> int:
        """Tokens of one pre-token: one if proven whole, else by merging."""
        if token in self.whole:
            return 1
        count = self.merged.get(token)
        if count is None:
            count = len(self.tokenizer.model.tokenize(token))
            remember(self.merged, token, count)
        return count

    def plain(self, piece: str) -> int:
        """Tokens of a piece without special strings."""
        ready = self.tokenizer.normalizer.normalize_str(piece)
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(ready)
        return sum(self.pre_token(token) for token, _ in found)

    def piece(self, piece: str) -> int:
        """Tokens of a piece between white space."""
        lower = piece.lower()
        if lower.isalpha() and max(piece) <= SIMPLE_LETTERS:
            raw = lower.encode().decode("latin-1")
            return self.pre_token(raw.translate(self.byte_level))
        if self.special is None or not self.special.search(piece):
            if piece.isascii() and piece.isprintable():
                return sum(map(self.pre_token, ASCII_TOKEN.findall(lower)))
            return self.plain(piece)
        parts = self.special.split(piece)
        return len(parts) - 1 + sum(self.plain(part) for part in parts if part)

    def count(self, text: str) -> int:
        """Tokens of a whole text. Where Python takes a character for white space
        that the tokenizer keeps, only ASCII white space is split at."""
        total, known = 0, self.known.get
        for piece in SPACE.split(text) if self.visible.search(text) else text.split():
            count = known(piece)
            if count is None:
                count = self.piece(piece)
                remember(self.known, piece, count)
            total += count
        return total


def remember(known: dict[str, int], text: str, count: int) -> None:
    if len(text) <= LONGEST:
        if len(known) >= MEMORY:
            known.clear()
        known[text] = count


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(
    docs: DataFrame,
    path: str,
    limit: int = LIMIT,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit. ``path`` names a
    file of the tokenizers library, valid on the executors."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)

        def make(ident, words):
            words = words or ""
            tokens = own.count(words)
            return ident, len(words.encode()), tokens, tokens > limit

        for batch in batches:
            fields = [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]
            yield from per_row([batch], pa.schema([batch.schema.field(0), *fields]), make)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
