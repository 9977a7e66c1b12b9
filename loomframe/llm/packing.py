"""Packing by power-of-two decomposition.

A document of n token ids (its terminal id included) is cut into as many full
sequences as fit and then into the binary digits of what is left: one piece
for each set bit, longest first.  Every piece has a power-of-two length, is a
sequence by itself and so holds ids of one document only; a batch takes pieces
of one length bucket.  Nothing is padded.

Cases: a null or empty text gives the terminal id alone; rows of a repeated or
null doc_id are packed one by one; a table without rows gives none; other
columns are ignored.  A very long text is encoded in parts cut between a letter
and a following space and letter, where the tokenizer's own splitting always
cuts, so the ids are those of the whole text.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters given to the tokenizer at once, and of white space given to its pattern.
PART, RUN = 1 << 18, 1 << 12
# The characters of Unicode's white space, and the special token of the vocabulary.
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPECIAL = {"<|endoftext|>": 50256}
LONG_RUN = re.compile(f"[{SPACES}]{{{RUN},}}")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int, pad_to long"


def pieces(n: int, limit: int) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order."""
    out = [limit] * (n // limit)
    left, bit = n % limit, limit >> 1
    while left:
        if left & bit:
            out.append(bit)
            left -= bit
        bit >>= 1
    return out


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of about ``size`` characters whose ids concatenate to the text's."""
    import regex

    safe = regex.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
    at = 0
    while len(text) - at > size:
        cut = safe.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Encoder:
    """Byte-level BPE ids; built once in each Python worker."""

    kept: dict[str, Encoder] = {}

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)

    @classmethod
    def of(cls, ranks_path: str, pattern: str) -> Encoder:
        if ranks_path not in cls.kept:
            cls.kept[ranks_path] = cls(ranks_path, pattern)
        return cls.kept[ranks_path]

    def ids(self, text: str) -> list[int]:
        if len(text) <= RUN:
            return self._ids(text)
        out: list[int] = []
        for part in parts(text):
            at = 0
            for run in LONG_RUN.finditer(part):
                end = run.end() if run.end() == len(part) or part.startswith(tuple(SPECIAL), run.end()) else run.end() - 1
                out += self._ids(part[at : run.start()])
                out += self.encoding._encode_single_piece(part[run.start() : end])
                at = end
            out += self._ids(part[at:])
        return out

    def _ids(self, text: str) -> list[int]:
        return self.encoding.encode(text, allowed_special="all", disallowed_special=())


def vocabulary() -> tuple[str, str]:
    """Place and splitting pattern of the 50k byte-level vocabulary.

    The rank file holds the same vocabulary and merges as ``byte_bpe_50k.json``;
    the tests compare the ids of both.
    """
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pack(docs: DataFrame, limit: int = 2048, end_id: int = 1, ranks_path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece; ``with_ids`` adds the ids themselves.

    ``sequence_id`` holds the task's partition number above 40 bits and a
    counter below, so numbering needs no shuffle and a repeated task gives the
    same numbers.  ``bucket`` is the base-two logarithm of the length.
    """
    if not ranks_path or not pattern:
        ranks_path, pattern = vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(ranks_path, pattern)
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encoder.ids(text.as_py() or ""), end_id], dtype="<u4")
                start = 0
                for length in pieces(len(ids), limit):
                    piece = ids[start : start + length]
                    row = (doc_id, start, length, zlib.crc32(piece.tobytes()), len(ids), serial, 0, length.bit_length() - 1, length)
                    rows.append((*row, piece.astype(np.int32)) if with_ids else row)
                    start += length
                    serial += 1
                    held += length
                if held > 1 << 21:
                    yield as_batch(rows)
                    rows, held = [], 0
            if rows:
                yield as_batch(rows)

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("bucket", pa.int32()), ("pad_to", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the pieces, made with their ids, in one folder for each length bucket."""
    packed.write.partitionBy("bucket").parquet(path)
