"""Exact deduplication by composable polynomial fingerprints.

The fingerprint of a byte string b of length n is the pair of sums of
``b[i] * B**(n-1-i)`` modulo two 31-bit primes.  The fingerprint of a
concatenation is the left one shifted by the right one's length plus the right
one, so chunks can be hashed anywhere and in any order.  A huge document is cut
into chunk rows that are dealt out over the cluster; each chunk emits its hash
already shifted by the bytes that follow it, and a document's fingerprint is
the sum of its chunks' terms, which Spark adds up before and after the shuffle.

Rows of equal length and fingerprint are then compared byte by byte: their
texts are streamed as chunk rows, each beside the chunk of the group's first
row.  Large groups are salted, with the first row's chunks in each salt.  Rows
that differ from the first row (a collision) form new groups until none are left.

Two texts are equal when identical after each run of ASCII white space became
one space.  Cases: null counts as empty; empty texts are equal to each other;
of equal texts the row with the smallest doc_id stays, null last, and among
rows of one doc_id the first of the table; an empty table gives an empty
result; other columns are ignored, whatever their names.  The input must be a
table read from files (or written by ``durable``), so that its rows come in
the same order each time they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import fresh
from loomframe.session import durable, release

#: Moduli and bases of the two polynomials (fixed values; any primes below 2**31 do).
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1220703125)
#: Bytes hashed by one dot product; 255 * 2**31 * BLOCK stays exact in a double.
BLOCK = 4096
#: Documents over this many bytes are hashed as chunk rows of CHUNK bytes.
HUGE = 8 << 20
CHUNK = 1 << 20
#: Rows of a group that share one copy of the group's first text.
PER_SALT = 512
SPACE = "[\\x20\\x09-\\x0D]+"
_WHITE = b" \t\n\r\x0b\x0c"


@cache
def _powers() -> np.ndarray:
    out = np.empty((BLOCK, 2))
    for k, (p, base) in enumerate(zip(PRIMES, BASES, strict=True)):
        x = 1
        for i in range(BLOCK - 1, -1, -1):
            out[i, k] = x
            x = x * base % p
    return out


@cache
def _block_shift() -> tuple[int, int]:
    return tuple(pow(b, BLOCK, p) for p, b in zip(PRIMES, BASES, strict=True))


def fingerprint(data: bytes) -> tuple[int, int]:
    """Both polynomial values of the bytes."""
    table = _powers()
    a = np.frombuffer(data, np.uint8)
    head = len(a) % BLOCK
    h = [0, 0]
    if head:
        v = a[:head].astype(np.float64) @ table[BLOCK - head :]
        h = [int(v[0]) % PRIMES[0], int(v[1]) % PRIMES[1]]
    shift = _block_shift()
    for at in range(head, len(a), BLOCK * 64):
        lanes = a[at : at + BLOCK * 64].reshape(-1, BLOCK).astype(np.float64) @ table
        for u, v in lanes.tolist():
            h = [(h[0] * shift[0] + int(u)) % PRIMES[0], (h[1] * shift[1] + int(v)) % PRIMES[1]]
    return h[0], h[1]


def combine(left: tuple[int, int], right: tuple[int, int], right_bytes: int) -> tuple[int, int]:
    """Fingerprint of a concatenation from those of its two sides."""
    return tuple((l * pow(b, right_bytes, p) + r) % p for l, r, b, p in zip(left, right, BASES, PRIMES, strict=True))


def normalise(data: bytes) -> bytes:
    """Each run of ASCII white space becomes one space."""
    out = b" ".join(data.split())
    if not data:
        return out
    if not out:
        return b" "
    return (b" " if data[0] in _WHITE else b"") + out + (b" " if data[-1] in _WHITE else b"")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, hi, lo, shas = [], [], [], []
        for item in batch.column(2):
            data = normalise(item.as_py() or b"")
            a, b = fingerprint(data)
            sizes.append(len(data))
            hi.append(a)
            lo.append(b)
            shas.append(hashlib.sha256(data).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(shas, pa.string())], names=["row_id", "doc_id", "n_bytes", "fp_a", "fp_b", "text_sha256"])


def _chunk_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of each chunk, shifted by the number of bytes behind it."""
    for batch in batches:
        a, b = [], []
        for data, behind in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            term = combine(fingerprint(data.as_py()), (0, 0), behind)
            a.append(term[0])
            b.append(term[1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["row_id", "a", "b"])


def chunks(data: Column, size: int) -> Column:
    """Array of (idx, chunk, behind) of a binary column; an empty value has one empty chunk."""
    n = F.octet_length(data)
    count = F.greatest(F.ceil(n / F.lit(size)).cast("int"), F.lit(1))
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.struct(i.alias("idx"), F.substring(data, i * size + 1, F.lit(size)).alias("chunk"), F.greatest(n - (i + 1) * size, F.lit(0)).cast("long").alias("behind")),
    )


def clean_text() -> Column:
    return F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE, " ").cast("binary")


def numbered(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, text) of every row."""
    return docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


def digests(docs: DataFrame, huge: int = HUGE, chunk: int = CHUNK) -> DataFrame:
    """Length, fingerprint and SHA-256 of each row's normalised text."""
    rows = numbered(docs)
    is_huge = F.coalesce(F.octet_length("text"), F.lit(0)) > huge
    small = rows.where(~is_huge).select("row_id", "doc_id", F.col("text").cast("binary").alias("text"))
    small = small.mapInArrow(_digests, "row_id long, doc_id long, n_bytes long, fp_a long, fp_b long, text_sha256 string")
    large = rows.where(is_huge).select("row_id", "doc_id", clean_text().alias("data"))
    cut = large.select("row_id", F.explode(chunks(F.col("data"), chunk)).alias("c")).select("row_id", F.col("c.idx").alias("idx"), "c.chunk", "c.behind")
    terms = cut.repartition("row_id", "idx").select("row_id", "chunk", "behind").mapInArrow(_chunk_terms, "row_id long, a long, b long")
    sums = terms.groupBy("row_id").agg((F.sum("a") % PRIMES[0]).alias("fp_a"), (F.sum("b") % PRIMES[1]).alias("fp_b"))
    facts = large.select("row_id", "doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("text_sha256"))
    return small.unionByName(facts.join(sums, "row_id").select("row_id", "doc_id", "n_bytes", "fp_a", "fp_b", "text_sha256"))


def equal_groups(docs: DataFrame, keys: DataFrame, chunk: int = CHUNK, per_salt: int = PER_SALT) -> DataFrame:
    """(row_id, group_id) of each row found equal to an earlier one, by comparing bytes.

    ``keys`` has row_id, doc_id and the columns of the fingerprint: n_bytes, fp_a, fp_b.
    """
    on = ["n_bytes", "fp_a", "fp_b"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id"))
    texts = numbered(docs).select("row_id", F.col("text"))
    pending, found = keys, None
    while True:
        groups = pending.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), first.alias("first")).where("n > 1")
        # written, so that the join below deals both sides anew and a large group's rows can be split
        groups = durable(groups.select(*on, F.col("first.row_id").alias("group_id"), F.ceil(F.col("n") / per_salt).cast("int").alias("salts")), "exact-groups")
        members = pending.join(groups, on).select("row_id", *on, "doc_id", "group_id", "salts")
        body = texts.join(members.select("row_id", "group_id", "salts"), "row_id").select("row_id", "group_id", "salts", F.explode(chunks(clean_text(), chunk)).alias("c"))
        # written once, so that the texts are dealt out once for both sides of the comparison
        body = durable(body.select("row_id", "group_id", "salts", F.col("c.idx").alias("idx"), F.col("c.chunk").alias("chunk")), "exact-body")
        heads = body.where("row_id = group_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        heads = heads.select("group_id", "salt", "idx", F.col("chunk").alias("head"))
        tails = body.where("row_id != group_id").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.col("salts")).cast("int"))
        compared = tails.join(heads, ["group_id", "salt", "idx"], "left").groupBy("row_id", "group_id").agg(F.min((F.col("chunk") == F.coalesce(F.col("head"), F.lit(b"")))).alias("same"))
        compared = durable(compared, "exact-compared")
        release(body)
        equal = compared.where("same").select("row_id", "group_id")
        found = equal if found is None else found.unionByName(equal)
        if compared.where("not same").isEmpty():
            return found
        pending = durable(keys.join(compared.where("not same").select("row_id"), "row_id", "left_semi"), "exact-pending")


def mark(docs: DataFrame, huge: int = HUGE, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, row_id."""
    keys = durable(digests(docs, huge, chunk), "exact-digests")
    found = equal_groups(docs, keys.drop("text_sha256"), chunk)
    rows = keys.select("row_id", "doc_id", "text_sha256").join(found, "row_id", "left").withColumn("group_id", F.coalesce("group_id", "row_id"))
    # only groups with copies are counted; their table is written, so that a large group's rows can be split in the join
    heads = found.groupBy("group_id").agg((F.count(F.lit(1)) + 1).alias("group_size")).join(keys.select(F.col("row_id").alias("group_id"), F.col("doc_id").alias("keep_id")), "group_id")
    heads = durable(heads, "exact-heads")
    several = F.col("group_size").isNotNull()
    return rows.join(heads, "group_id", "left").select(
        "doc_id",
        F.when(several, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("row_id") == F.col("group_id")).alias("kept"),
        "text_sha256",
        "row_id",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    keys = durable(digests(docs).drop("text_sha256"), "exact-digests")
    row = fresh(docs, "row_id")
    gone = equal_groups(docs, keys).select(F.col("row_id").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(gone, row, "left_anti").drop(row)
