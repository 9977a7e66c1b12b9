"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to BITS bits each, at quantiles of
the whole table, and a row's cells give its index on the Hilbert curve through
that grid (Skilling 2004).  Rows are sorted by it and the order is cut into runs
of nearly equal bytes, so a shard covers a small box in every dimension and a
reader can skip shards by the minima and maxima of their files.

Rows of equal text take the place of the group's first row (by doc_id), so
copies lie side by side.  Shards of whole rows are unequal anyway by up to the
largest row; a group of no more bytes than that, or than SLACK of a shard, goes to
one shard whole.  A larger group may be cut, where a shard ends within it.

The order is made by range partitioning with doc_id as the last key, so a hot
group or cell spreads over partitions; positions come from sums over
partitions, which are as many numbers as there are partitions.

Cases: null text has no bytes (crc32 of nothing is 0); null dimensions come first;
rows equal in all columns used are interchangeable; there are empty shards only
if there are fewer groups than shards; an empty table gives an empty result;
other columns are carried only by ``write``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import fresh
from loomframe.session import durable, release

BITS = 5
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Share of a shard's bytes by which keeping a group whole may move a cut.
SLACK = 0.05
#: Rows that one task writes.
WRITE_ROWS = 100_000


def text_prefix(c: Column) -> Column:
    """The first seven bytes of a string as a number of the same order."""
    return F.conv(F.hex(F.rpad(F.substring(c.cast("binary"), 1, 7), 7, F.lit(b"\x00"))), 16, 10).cast("long")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the curve of each row of integer coordinates (rows, dimensions)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work of the levels
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            x[0] = np.where(on, x[0] ^ p, x[0])
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, n):  # Gray encode
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def _facts(docs: DataFrame) -> DataFrame:
    """Small columns of each row; the text itself goes no further."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group_hash"),
        text_prefix(F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("source_key"),
        text_prefix(F.coalesce(F.col("lang").cast("string"), F.lit(""))).alias("lang_key"),
    )


DIMENSIONS = ("source_key", "lang_key", "size", "doc_id")


def shard(docs: DataFrame, shards: int = 40, bits: int = BITS, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the curve index of every row."""
    facts = durable(_facts(docs), "hilbert-facts")
    spark = docs.sparkSession
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    totals = facts.agg(F.sum("size").alias("bytes"), F.max("size").alias("largest"), *(F.percentile_approx(d, F.array(*map(F.lit, steps)), 20000).alias(d) for d in DIMENSIONS)).first()
    if totals["bytes"] is None:
        return spark.createDataFrame([], "doc_id long, size long, text_crc32 long, shard int, slot long, hilbert long")
    bounds = [np.unique(np.array(totals[d] or [], np.int64)) for d in DIMENSIONS]
    total = int(totals["bytes"])

    group = ["group_hash", "size"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "source_key", "lang_key"))
    groups = facts.groupBy(*group).agg(F.sum("size").alias("group_bytes"), first.alias("f"))
    groups = groups.select(*group, "group_bytes", F.col("f.source_key").alias("k0"), F.col("f.lang_key").alias("k1"), F.col("f.doc_id").alias("k3"))
    limit = max(slack * total / shards, totals["largest"])
    # a group to be kept whole sorts and is cut as one unit
    groups = groups.withColumn("unit", F.when(F.col("group_bytes") <= limit, 1).otherwise(0))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("k0", "k1", "size", "k3")]
            # dimensions of few values spread over the whole grid
            cells = [np.searchsorted(b, v.fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)) * (1 << bits) // (len(b) + 1) for b, v in zip(bounds, own, strict=True)]
            h = pa.array(hilbert_index(np.stack(cells, 1), bits), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, h], names=[*batch.schema.names, "hilbert"])

    keyed = groups.mapInArrow(index, "group_hash long, size long, group_bytes long, k0 long, k1 long, k3 long, unit int, hilbert long")
    rows = facts.drop("source_key", "lang_key").join(keyed.select(*group, "group_bytes", "unit", "hilbert"), group)
    # rows of a unit share their key and so lie in one partition; others are told apart by their id
    rows = rows.withColumn("spread", F.when(F.col("unit") == 1, 0).otherwise(F.xxhash64("doc_id")))
    order = ["hilbert", *group, "spread"]
    placed = placed_rows = durable(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "hilbert-order")
    sums = {r["part"]: (int(r["n"]), int(r["b"])) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect()}
    before, n, b = [], 0, 0
    for p in sorted(sums):
        before.append((p, n, b))
        n, b = n + sums[p][0], b + sums[p][1]
    offsets = F.broadcast(spark.createDataFrame(before, "part int, n0 long, b0 long"))  # a row for each partition

    w = Window.partitionBy("part").orderBy(*order, F.col("doc_id").asc_nulls_last())
    at = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    head = (F.lag("group_hash").over(w) == F.col("group_hash")) & (F.lag("size").over(w) == F.col("size")) & (F.lag("hilbert").over(w) == F.col("hilbert"))
    placed = placed.withColumn("number", F.row_number().over(w).cast("long") - 1).withColumn("at", at).withColumn("head", ~F.coalesce(head, F.lit(False)))
    placed = placed.withColumn("start", F.last(F.when(F.col("head"), F.col("at")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(offsets, "part").withColumn("number", F.col("number") + F.col("n0"))
    centre = F.when(F.col("unit") == 1, 2 * (F.col("start") + F.col("b0")) + F.col("group_bytes")).otherwise(2 * (F.col("at") + F.col("b0")) + F.col("size"))
    cut = F.least(F.floor(centre * F.lit(shards) / F.lit(2 * total)), F.lit(shards - 1)).cast("int")
    numbered = durable(placed.select("doc_id", "size", "text_crc32", cut.alias("shard"), "number", "hilbert"), "hilbert-shards")
    for done in (facts, placed_rows):
        release(done)
    first_of = numbered.groupBy("shard").agg(F.min("number").alias("first"))  # a row for each shard
    return numbered.join(F.broadcast(first_of), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("number") - F.col("first")).alias("slot"), "hilbert")


def write(docs: DataFrame, placed: DataFrame, path: str, rows_per_task: int = WRITE_ROWS) -> None:
    """Write whole documents in one folder for each shard, in files of runs of slots; doc_id must be a key of ``docs``."""
    own, slot, piece = fresh(docs, "shard"), fresh(docs, "slot"), fresh(docs, "piece")
    named = placed.select("doc_id", F.col("shard").alias(own), F.col("slot").alias(slot), F.floor(F.col("slot") / rows_per_task).alias(piece))
    docs.join(named, "doc_id").repartition(own, piece).sortWithinPartitions(own, slot).drop(slot, piece).write.partitionBy(own).parquet(path)


def ranges(docs: DataFrame, placed: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum and maximum of each column in each shard: what a reader prunes by."""
    return docs.join(placed.select("doc_id", "shard"), "doc_id").groupBy("shard").agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))
