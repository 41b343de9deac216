"""Whole texts to token ids, and documents to pieces of at most one sequence.

The vocabulary file is a parameter; nothing is trained. Its tokenizer drops white space and never joins across
it, so a text is encoded one blank-separated chunk at a time, and the ids of a chunk are kept in a bounded memo
of each worker: frequent words are looked up, only new ones are encoded.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

CAPACITY = 4096
DOCUMENT_END = 1
#: Chunks in the memo of a worker, which keeps it through later stages: about 145 bytes each.
_MEMO = 400_000
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A comma or full stop that ends a chunk is a unit of its own unless another mark stands before it.
_MARKS_MEET = re.compile(r"(?:[^\w\s]|_)[.,][ \n]")
#: Letters below this code point have no combining forms, so their lower case is their own, letter by letter.
_LATIN = "\u0250"


@cache
def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + hidden.index(b)) for b in range(256)]


class _Memo(dict):
    """Chunk of a text to its ids. A chunk seen for the first time is encoded by the tokenizer."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha() and (chunk.isascii() or (max(chunk) < _LATIN and "\u0130" not in chunk)):
            word = chunk.lower()  # one unit of the tokenizer: its byte letters go to the merges as they are
            if word != chunk and word in self:
                ids = self[word]
            else:
                letters = word if word.isascii() else "".join(map(_byte_letters().__getitem__, word.encode()))
                ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        elif (word := chunk.rstrip(_MARKS)) != chunk and word.isalpha():
            ids = self[word] + self[chunk[len(word) :]]
        else:
            ids = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        self[chunk] = ids
        return ids


@cache
def _memo(vocabulary: str) -> _Memo:
    return _Memo(vocabulary)


def encode(text: str, vocabulary: str) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers, without special tokens added."""
    memo = _memo(vocabulary)
    if len(memo) > _MEMO:
        memo.clear()
    if text.isascii() and "<|" not in text:
        text = text.lower()
    if not _MARKS_MEET.search(text):
        text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
    return b"".join(map(memo.__getitem__, text.replace("\n", " ").split(" ")))


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, block, place and, if wanted, the ids.

    A document is its ids and then the id 1 that ends it; a null or empty text is that id alone. Only documents longer
    than ``capacity`` are cut, into pieces of ``capacity`` ids, of which the last may be shorter. ``block`` is the task
    that made the piece and ``place`` its number among the pieces of the same length there, from 0: so the pieces of a
    length can be numbered by adding up counts per block. Ids are 32-bit little-endian integers, compressed by zstd.
    """
    fields = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, block int, place bigint" + ", ids binary" * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()][: 7 + with_ids]
    names = [f.split(" ")[0] for f in fields.split(", ")]
    end = np.array([DOCUMENT_END], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = TaskContext.get().partitionId(), Counter()
        squeeze = zstandard.ZstdCompressor(level=1).compress

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = encode(text or "", vocabulary) + end
                for k in range(0, len(raw) // 4, capacity):
                    own = raw[4 * k : 4 * (k + capacity)]
                    length = len(own) // 4
                    row = (doc, k // capacity, k, length, zlib.crc32(own), block, seen[length])
                    seen[length] += 1
                    yield (*row, squeeze(own)) if with_ids else row

        for batch in batches:
            found = rows(batch)
            while held := list(islice(found, 2_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, fields)


def unpack(ids: bytes) -> np.ndarray:
    """The ids of a piece as made by :func:`pieces`."""
    return np.frombuffer(zstandard.decompress(ids), dtype="<u4")
