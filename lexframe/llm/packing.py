"""Packing by power-of-two decomposition: every document is cut into pieces of binary lengths, equal lengths share a bucket.

A piece fills one sequence of its own, so no sequence crosses documents and none is padded. A document of n tokens gives n // limit
pieces of the limit and one piece for each binary digit of the rest, longest first; bucket = length.

Edge cases: null and empty texts are the end token alone (one piece of length 1); long texts are only more pieces; repeated rows are
packed each for itself; a null id stays null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.common import map_batches, small_batches

END_ID = 0
LIMIT = 1024
MEMO = 40 << 20  # about the bytes of a generation of a worker's memo; it holds two, which changes no result
ENTRY = 160  # bytes of an entry beside its text and ids
SLICE = 1 << 18  # characters between two looks at the size of the memo

_MEMO: dict[str, _Words] = {}
_BEFORE_WORD = re.compile(r" (?=\S)")
_ODD_SPACE = re.compile(r" \s| \Z")
# a sign after a letter and a line end between visible characters are pieces of their own, too
_SIGN = re.compile(r"[.,;:!?](?=\s\S)(?<=[^\W\d_].)")
_LINE = re.compile(r"\n(?=\S)(?<=\S\n)")
_MARK = "\ue000"  # begins a chunk that has no blank before it; texts with this character are cut at blanks only


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


_LETTERS = _byte_letters()
_ID = attrgetter("id")


class _Memo(dict):
    """Strings -> ids as bytes, made when first asked for, in two generations: when the new one is full, the old one goes; what is asked for moves up."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make = make
        self.old: dict[str, bytes] = {}
        self.bytes = 0

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.make(key)
        self[key] = ids
        self.bytes += ENTRY + len(key) + len(ids)
        return ids

    def turn(self) -> None:
        if self.bytes > MEMO:
            self.old = dict(self)
            self.clear()
            self.bytes = 0


class _Words:
    """Chunks of text -> their ids as little-endian 32-bit bytes, filled by the tokenizer.

    The tokenizer always starts anew at a blank before a visible character, so a text may be cut there and its chunks be looked up. It does
    so as well at a sign between a letter and a blank and at a single line end; a chunk that begins there starts with a mark. ``known`` has
    the chunks, ``parts`` the pieces that the tokenizer's own pattern makes of the others. A text with the special token's own string is
    encoded whole.
    """

    def __init__(self, path: str):
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.known, self.parts = _Memo(self.chunk), _Memo(lambda p: self.word(p) if p.isalpha() else self.plain(p))
        self.encoder = Tokenizer.from_file(path)
        self.special = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        self.cut = regex.compile(PATTERN).findall
        self.piece = self.encoder.model.tokenize

    def plain(self, text: str) -> bytes:
        return array("I", self.encoder.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, piece: str) -> bytes:
        """Ids of a piece of letters and a blank before them: what the model makes of its bytes."""
        shown = piece.replace(" ", _LETTERS[32]) if piece.isascii() else "".join([_LETTERS[b] for b in piece.encode()])
        return array("I", map(_ID, self.piece(shown))).tobytes()

    def chunk(self, text: str) -> bytes:
        """Ids of a chunk: of its word, or of the pieces it is cut into."""
        if text.isalpha():
            return self.word(" " + text)
        pieces = self.cut(text[1:] if text[0] == _MARK else " " + text)
        return b"".join([self.known[p[1:]] if p[0] == " " and p[1:].isalpha() else self.parts[p] for p in pieces])

    def chunks(self, text: str) -> list[str] | None:
        if any(s in text for s in self.special):
            return None
        if _MARK not in text:
            text = _LINE.sub(f" {_MARK}\n {_MARK}", _SIGN.sub(rf" {_MARK}\g<0>", text))
        return _BEFORE_WORD.split(text) if _ODD_SPACE.search(text) else text.split(" ")

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        self.known.turn()
        self.parts.turn()
        for text in texts:
            chunks = self.chunks(text)
            yield self.plain(text) if chunks is None else self.plain(chunks[0]) + b"".join(map(self.known.__getitem__, chunks[1:]))


def _words(path: str) -> _Words:
    if path not in _MEMO:
        _MEMO[path] = _Words(path)
    return _MEMO[path]


def piece_lengths(n: int, limit: int = LIMIT) -> list[int]:
    rest = n % limit
    return [limit] * (n // limit) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """``doc_id, text`` -> a row per piece; ``with_ids`` adds the ids themselves. ``limit`` is a power of two."""
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        words = _words(tokenizer)
        end = array("I", [END_ID]).tobytes()
        for batch, texts in small_batches(batches, chars=SLICE):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.ids([t or "" for t in texts]), strict=True):
                ids += end
                tokens, at = len(ids) // 4, 0
                for length in piece_lengths(tokens, limit):
                    part = ids[4 * at: 4 * (at + length)]
                    rows.append((doc_id, at, length, zlib.crc32(part), tokens, part))
                    at += length
                if len(rows) >= 5000:
                    yield _columns(rows)
                    rows = []
            if rows:
                yield _columns(rows)

    def _columns(rows: list[tuple]) -> dict:
        doc, start, length, crc, tokens, part = zip(*rows, strict=True)
        out = {"doc_id": pa.array(doc, pa.int64())}
        for name, values in (("start", start), ("length", length), ("ids_crc32", crc), ("doc_tokens", tokens)):
            out[name] = pa.array(values, pa.int64())
        if with_ids:
            out["ids"] = pa.array([np.frombuffer(p, "<u4").astype("i4") for p in part], pa.list_(pa.int32()))
        return out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)
    # a sequence is a piece, so any unique number serves; it follows from the input split and so is the same when a task runs again
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Pieces of ``pack(..., with_ids=True)`` as a table with a folder per length: a batch is read from one folder."""
    pieces.withColumnRenamed("length", "bucket").write.partitionBy("bucket").parquet(path)
