"""Windows over chunks of a scenario, so that a long scenario spreads over tasks.

A frame goes to its own chunk and, where a window of another chunk's frame reaches
it, to that chunk too.  Frames of a scenario follow each other without gaps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Frames of a chunk.
SIZE = 4096


def with_windows(rows: DataFrame, before: int, after: int, add: Callable[[DataFrame, WindowSpec], DataFrame], size: int = SIZE) -> DataFrame:
    """What ``add`` makes of the rows with a window in order of frame, which may reach so many rows back and ahead."""
    own = F.floor((F.col("frame") - 1) / size)
    first, last = F.floor((F.col("frame") - 1 - after) / size), F.floor((F.col("frame") - 1 + before) / size)
    dealt = rows.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    made = add(dealt, Window.partitionBy("scenario", "_chunk").orderBy("frame"))
    return made.where("_own = _chunk").drop("_own", "_chunk")


def chunk_of(size: int = SIZE) -> Column:
    return F.floor((F.col("frame") - 1) / size)


def running_count(rows: DataFrame, condition: Column, name: str, size: int = SIZE) -> DataFrame:
    """Adds how many frames of the scenario up to each one meet the condition.

    A chunk's frames are counted by a window over the chunk; what lies before it
    comes from the chunks' totals, a row for each chunk.  ``rows`` is read twice.
    """
    dealt = rows.withColumn("_chunk", chunk_of(size)).withColumn("_hit", condition.cast("long"))
    totals = dealt.groupBy("scenario", "_chunk").agg(F.sum("_hit").alias("_n"))
    earlier = Window.partitionBy("scenario").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("scenario", "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    upto = Window.partitionBy("scenario", "_chunk").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    counted = dealt.withColumn(name, F.sum("_hit").over(upto)).join(before, ["scenario", "_chunk"])
    return counted.withColumn(name, F.col(name) + F.col("_before")).select(*rows.columns, name)


def last_mark(frames: DataFrame, marks: DataFrame, name: str, size: int = SIZE) -> DataFrame:
    """Adds ``name``, a struct that ``marks`` (scenario, frame, name) has at the last marked frame up to each one, or null.

    The last mark before a chunk comes from the marks alone, a row for each chunk.
    """
    n = frames.groupBy("scenario").agg(F.max("frame").alias("_n"))
    grid = n.select("scenario", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / size))).alias("_chunk"))
    own = marks.withColumn("_chunk", chunk_of(size)).groupBy("scenario", "_chunk").agg(F.max_by(name, "frame").alias("_last"))
    earlier = Window.partitionBy("scenario").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = grid.join(own, ["scenario", "_chunk"], "left").select("scenario", "_chunk", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    upto = Window.partitionBy("scenario", "_chunk").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    rows = frames.join(marks, ["scenario", "frame"], "left").withColumn("_chunk", chunk_of(size))
    rows = rows.withColumn(name, F.last(name, ignorenulls=True).over(upto)).join(before, ["scenario", "_chunk"])
    return rows.select(*frames.columns, F.coalesce(name, "_before").alias(name))
