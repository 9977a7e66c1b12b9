"""Evaluation windows, the normal set, and resampling units."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.greedy import spaced_places
from loomframe.operators import chunks
from loomframe.session import durable
from loomframe.sources.timeline import ANCHORS, DEFECT, NORMAL


def windows(passes: DataFrame, lengths: DataFrame, grace: int = 24) -> DataFrame:
    """Adds lo, hi (the evaluation window) and carry to passes (scenario, s, e, ...).

    ``lengths`` has (scenario, frame, K).  The window reaches to the last frame
    within ``grace`` of the pass whose own window still touches it, but not into
    the next pass.  Frames past the end of a pass are looked up by an equi-join
    on at most grace + 1 exploded frames a pass.
    """
    w = Window.partitionBy("scenario").orderBy("s")
    n = lengths.groupBy("scenario").agg(F.max("frame").alias("N"))
    rows = passes.withColumn("next", F.lead("s").over(w)).withColumn("before", F.lag("e").over(w)).join(n, "scenario")
    keys = ["scenario", "s"]
    reach = rows.select(*keys, "e", "N", F.explode(F.sequence(F.col("e"), F.least(F.col("e") + grace, F.col("N")))).alias("frame"))
    reach = reach.join(lengths.select("scenario", "frame", "K"), ["scenario", "frame"]).where(F.col("frame") - F.col("K") + 1 <= F.col("e"))
    last = reach.groupBy(*keys).agg(F.max("frame").alias("g"))
    at = lengths.select("scenario", F.col("frame").alias("s"), F.col("K").alias("Ks"))
    out = rows.join(last, keys, "left").join(at, keys)
    hi = F.least(F.greatest(F.col("e"), F.coalesce("g", "e")), F.coalesce(F.col("next") - 1, F.col("N")), F.col("N"))
    carry = F.coalesce(F.col("s") - F.col("Ks") + 1 <= F.col("before"), F.lit(False))
    return out.withColumn("lo", F.col("s")).withColumn("hi", hi).withColumn("carry", carry).drop("next", "before", "N", "g", "Ks")


def with_label(windows_: DataFrame, frames: DataFrame, label: int) -> DataFrame:
    """The windows whose pass [s, e] shows the label on some frame."""
    marks = windows_.select("scenario", "s", "e", F.col("s").alias("lo"), F.col("e").alias("hi"))
    hit = in_window(frames.where(F.col("label") >= DEFECT), marks, "s").where((F.col("label") == label) & F.col("s").isNotNull())
    return windows_.join(hit.select("scenario", "s").distinct(), ["scenario", "s"], "left_semi")


def assert_disjoint(windows_: DataFrame) -> DataFrame:
    """The windows, or an error where two of a scenario overlap."""
    w = Window.partitionBy("scenario").orderBy("lo")
    bad = F.coalesce(F.lead("lo").over(w) <= F.col("hi"), F.lit(False))
    return windows_.withColumn("hi", F.when(bad, F.raise_error(F.lit("windows overlap")).cast("int")).otherwise(F.col("hi")))


def in_window(frames: DataFrame, windows_: DataFrame, *columns: str) -> DataFrame:
    """Adds the window that holds each frame (lo, null if none) and its other columns.

    Windows are disjoint, so the window of a frame is the last one that begins
    at or before it, if it reaches the frame.  That is an equi-join and a window
    function over chunks of frames: no range join, whatever the number of windows.
    """
    names = ["lo", "hi", *columns]
    marks = windows_.select("scenario", F.col("lo").alias("frame"), F.struct(*names).alias("_w"))
    rows = chunks.last_mark(frames, marks, "_w")
    hit = F.col("_w").isNotNull() & (F.col("frame") <= F.col("_w.hi"))
    return rows.select(*frames.columns, *(F.when(hit, F.col(f"_w.{c}")).alias(c) for c in ["lo", *columns]))


def normal_set(frames: DataFrame, windows_: DataFrame) -> DataFrame:
    """Adds ``normal`` (label of normal cloth, outside every window) and ``seg``.

    ``seg`` counts the frames outside the normal set so far; no event crosses one.
    """
    rows = in_window(frames, windows_).withColumn("normal", F.col("label").isin(*NORMAL) & F.col("lo").isNull()).drop("lo")
    # written, as its chunks are counted before its frames are
    return chunks.running_count(durable(rows, "normal"), ~F.col("normal"), "seg")


def eligible(frames: DataFrame, defects: DataFrame, margin: Column) -> DataFrame:
    """Normal frames further than the margin from every defect frame; a null margin excludes none.

    The nearest defects on either side come from window functions, not a join
    of frames with defects.
    """
    d = defects.select("scenario", "frame").distinct().withColumn("d", F.col("frame"))
    rows = frames.join(d, ["scenario", "frame"], "left").withColumn("_m", margin)
    w = Window.partitionBy("scenario").orderBy("frame")
    before = F.last("d", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # backwards, as a frame that only grows: one that shrinks is evaluated anew for each row
    back = Window.partitionBy("scenario").orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, 0)
    after = F.last("d", ignorenulls=True).over(back)
    near = F.coalesce(F.col("frame") - before <= F.col("_m"), F.lit(False)) | F.coalesce(after - F.col("frame") <= F.col("_m"), F.lit(False))
    return rows.withColumn("_near", near).where(F.col("label").isin(*NORMAL) & ~F.col("_near")).select(*frames.columns)


def anchors(frames: DataFrame, period: Column, labels: tuple[int, ...] = ANCHORS) -> DataFrame:
    """Run starts of anchor labels that are at least half a period after the last one taken.

    Run starts are found by a window function; which of them count depends on
    the last one taken, so a task walks through one scenario's starts.
    """
    kind = dict(frames.dtypes)["scenario"]
    w = Window.partitionBy("scenario").orderBy("frame")
    hit = F.col("label").isin(*labels)
    rows = frames.withColumn("_p", period).withColumn("_h", hit).withColumn("_b", F.coalesce(F.lag("_h").over(w), F.lit(False)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        starts = np.sort(pdf["frame"].to_numpy())
        return pd.DataFrame({"scenario": pdf["scenario"].iloc[0], "anchor": starts[spaced_places(2 * starts, pdf["period"].iloc[0])]})

    starts = rows.where("_h and not _b").select("scenario", "frame", F.col("_p").alias("period"))
    return starts.groupBy("scenario").applyInPandas(run, f"scenario {kind}, anchor int")


def phases(frames: DataFrame, anchors_: DataFrame, period: Column, bin_width: int = 50) -> DataFrame:
    """Adds anchor (as-of), phase and phase_bin.

    Before the first anchor the first one counts; without anchors the phase
    runs from frame 1.
    """
    marks = anchors_.select("scenario", F.col("anchor").alias("frame"), F.struct("anchor").alias("_a"))
    first = anchors_.groupBy("scenario").agg(F.min("anchor").alias("_first"))
    rows = chunks.last_mark(frames.withColumn("_p", period), marks, "_a").join(first, "scenario", "left")
    rows = rows.withColumn("anchor", F.coalesce("_a.anchor", "_first", F.lit(1)))
    phase = F.pmod(F.col("frame") - F.col("anchor"), F.col("_p")).cast("int")
    return rows.withColumn("phase", phase).withColumn("phase_bin", F.floor(F.col("phase") / bin_width).cast("int")).drop("_p", "_a", "_first")


def blocks(frames: DataFrame, length: int = 1200) -> DataFrame:
    """Adds the fixed block of each frame; the last, partial one is kept."""
    return frames.withColumn("block", F.floor((F.col("frame") - 1) / length).cast("int"))


def dense_units(rows: DataFrame, bin_name: str, unit: str) -> DataFrame:
    """Adds dense unit numbers from 0 in (scenario, bin) order.

    Only the distinct units, which are few, are numbered in one window.
    """
    units = rows.select("scenario", bin_name).distinct()
    units = units.withColumn(unit, F.dense_rank().over(Window.orderBy("scenario", bin_name)).cast("int") - 1)
    return rows.join(units, ["scenario", bin_name])


def unit_sizes(rows: DataFrame, unit: str) -> DataFrame:
    """Normal frames of every unit, zero included."""
    return rows.groupBy(unit).agg(F.sum(F.col("normal").cast("long")).alias("n"))


def offsets(frames: DataFrame) -> DataFrame:
    """Frames of each scenario and of all before it."""
    n = frames.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("start", F.sum("n").over(Window.orderBy("scenario").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))


def concatenated(frames: DataFrame, separator: int = 4) -> DataFrame:
    """(position, scenario, frame, normal) of all scenarios one after the other.

    ``separator`` frames outside the normal set follow each scenario, more than a
    run of events can bridge, so one walk over all positions counts as one for each scenario.
    """
    n = offsets(frames)
    place = n.withColumn("before", F.col("start") + separator * (F.row_number().over(Window.orderBy("scenario")) - 1))  # a row a scenario
    rows = frames.join(place, "scenario").select((F.col("before") + F.col("frame")).cast("long").alias("position"), "scenario", "frame", "normal")
    end = (F.col("before") + F.col("n")).cast("long")
    gaps = place.select(F.explode(F.sequence(end + 1, end + separator)).alias("position"))
    kinds = dict(frames.dtypes)
    return rows.unionByName(gaps.select("position", F.lit(None).cast(kinds["scenario"]).alias("scenario"), F.lit(0).cast(kinds["frame"]).alias("frame"), F.lit(False).alias("normal")))


def fold_statistics(frames: DataFrame, windows_: DataFrame) -> DataFrame:
    """One row: frames, normal frames, passes, tracks, carried-over passes."""
    a = frames.agg(F.count(F.lit(1)).alias("frames"), F.sum(F.col("normal").cast("long")).alias("normal"))
    b = windows_.agg(F.count(F.lit(1)).alias("passes"), F.countDistinct("track").alias("tracks"), F.sum(F.col("carry").cast("long")).alias("carry"))
    return a.join(F.broadcast(b))  # one row each
