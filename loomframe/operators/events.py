"""Counting false-alarm events at one threshold and at all of them.

An alarm is a normal frame whose score reaches the threshold.  Alarms of a
scenario are linked over gaps of up to GAP normal frames; a run of span L is
ceil(L / CAP) events.  No run crosses a frame outside the normal set, so counts
add up over segments (scenario, seg), and every count curve is a sum of steps:
each segment emits how its count changes as the threshold falls past a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.operators.running import Ordered
from loomframe.session import spread

GAP, CAP = 2, 25
#: Segments of a scenario that one task takes together.
SEGMENTS = 64


def alarms(frames: DataFrame, tau: float | Column) -> DataFrame:
    return frames.where(F.col("normal") & (F.col("score") >= tau))


def runs_at(frames: DataFrame, tau: float | Column, gap: int = GAP, keys: list[str] | None = None) -> DataFrame:
    """Runs (keys, scenario, run, a, b) of linked alarms."""
    part = [*(keys or []), "scenario"]
    w = Window.partitionBy(*part).orderBy("frame")
    linked = (F.col("frame") - F.lag("frame").over(w) <= gap + 1) & (F.lag("seg").over(w) == F.col("seg"))
    rows = alarms(frames, tau).withColumn("new", F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*part, "run").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))


def events_of(runs: DataFrame, cap: int | None = CAP) -> Column:
    """Events of a run [a, b]."""
    if cap is None:
        return F.lit(1).cast("long")
    return F.call_function("div", F.col("b") - F.col("a") + cap, F.lit(cap)).cast("long")


def chunks_of(runs: DataFrame, cap: int = CAP) -> DataFrame:
    """The frames at which a run's events start."""
    return runs.withColumn("frame", F.explode(F.sequence(F.col("a"), F.col("b"), F.lit(cap))))


def uncapped_steps(frames: DataFrame, gap: int = GAP) -> DataFrame:
    """(tau, delta) of the uncapped curve, by window functions alone.

    A frame opens a run for thresholds up to its score and above the highest
    score among the frames it could link back to.
    """
    w = Window.partitionBy("scenario", "seg").orderBy("frame").rangeBetween(-(gap + 1), -1)
    rows = frames.where("normal").withColumn("p", F.max("score").over(w))
    opens = rows.where("p is null or p < score")
    up = opens.select(F.col("score").alias("tau"), F.lit(1).cast("long").alias("delta"))
    down = opens.where("p is not null").select(F.col("p").alias("tau"), F.lit(-1).cast("long").alias("delta"))
    return up.unionAll(down).groupBy("tau").agg(F.sum("delta").alias("delta"))


def segment_steps(frame: np.ndarray, score: np.ndarray, seg: np.ndarray, cap: int, gap: int, unit: np.ndarray | None = None, most: int | None = None) -> tuple:
    """Changes of the event count as the threshold falls, over normal frames of one scenario in order.

    Frames enter by falling score.  An alarm joins the nearest alarm on either
    side within reach, which is the end of its run, so a run is known by what its
    two ends say about each other.  Returns arrays (tau, change), or (tau, unit,
    change) with each event at the unit of its first frame; values may repeat.
    With ``most`` the walk ends at the first threshold with more events than that:
    counts of several scenarios only add up, so whatever bounds their sum by
    ``most`` never looks below it.
    """
    n = len(frame)
    # plain arrays, as lists of a whole scenario's frames would take many times their memory
    f = memoryview(np.ascontiguousarray(frame, np.int64))
    # how many places to the left and right of a frame another one may lie that it is linked to
    near = np.zeros((2, n), np.int8)
    for k in range(1, gap + 2):
        linked = (seg[k:] == seg[:-k]) & (frame[k:] - frame[:-k] <= gap + 1)
        near[0, k:] += linked
        near[1, :-k] += linked
    back, ahead = map(memoryview, near)
    other = memoryview(np.full(n, -1, np.int32))  # of a run's two ends, the other one
    taus, units, changes = [], [], []
    own = None if unit is None else dict(zip(frame.tolist(), unit.tolist(), strict=True))

    def put(tau: float, lo: int, hi: int, sign: int) -> int:
        if own is None:
            size = (f[hi] - f[lo] + cap) // cap
            taus.append(tau)
            changes.append(sign * size)
            return sign * size
        starts = range(f[lo], f[hi] + 1, cap)
        for start in starts:
            taus.append(tau)
            units.append(own[start])
            changes.append(sign)
        return sign * len(starts)

    total, before = 0, None
    for i, tau in _falling(score, most):
        if most is not None and total > most and tau != before:
            break
        before = tau
        j = next((i - k for k in range(1, back[i] + 1) if other[i - k] >= 0), -1)
        k = next((i + k for k in range(1, ahead[i] + 1) if other[i + k] >= 0), -1)
        if j >= 0 and k >= 0 and f[k] - f[j] <= gap + 1:
            # inside a run: it is an alarm that nothing further is linked to
            other[i] = i
            continue
        lo = hi = i
        if j >= 0:
            lo = other[j]
            total += put(tau, lo, j, -1)
        if k >= 0:
            hi = other[k]
            total += put(tau, k, hi, -1)
        other[i] = i
        other[lo], other[hi] = hi, lo
        total += put(tau, lo, hi, 1)
    arrays = np.array(taus, float), np.array(changes, np.int64)
    return arrays if own is None else (arrays[0], np.array(units), arrays[1])


#: Places that a walk by falling score takes as Python numbers at once.
AT_ONCE = 1 << 16


def _falling(score: np.ndarray, most: int | None) -> Iterator[tuple[int, float]]:
    """(place, score) by falling score; with ``most`` the largest few are sorted first, as the walk may end among them."""

    def sorted_(places: np.ndarray) -> Iterator[tuple[int, float]]:
        places = places[np.argsort(-score[places], kind="stable")]
        for a in range(0, len(places), AT_ONCE):
            some = places[a : a + AT_ONCE]
            yield from zip(some.tolist(), score[some].tolist(), strict=True)

    rest = np.arange(len(score))
    if most is not None and len(score) > 8 * (most + 1):
        cut = np.partition(score, len(score) - 4 * (most + 1))[len(score) - 4 * (most + 1)]
        yield from sorted_(np.flatnonzero(score > cut))
        rest = np.flatnonzero(score <= cut)
    yield from sorted_(rest)


def steps(frames: DataFrame, keys: list[str] | None = None, cap: int = CAP, gap: int = GAP, unit: str | None = None, segments: int = SEGMENTS) -> DataFrame:
    """(keys, tau, [unit,] delta) of the capped curve at every distinct normal score.

    Tasks take blocks of whole segments, so long scenarios spread over many.
    """
    keys = keys or []
    kinds = dict(frames.dtypes)
    names = [*keys, "tau", *([unit] if unit else []), "delta"]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "tau double", *([f"{unit} {kinds[unit]}"] if unit else []), "delta long"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        got = segment_steps(pdf["frame"].to_numpy(), pdf["score"].to_numpy(float), pdf["seg"].to_numpy(), cap, gap, pdf[unit].to_numpy() if unit else None)
        out = pd.DataFrame(dict(zip(names[len(keys) :], got, strict=True)))
        if not unit:
            # every score is a threshold, also where the count stays
            out = pd.concat([out, pd.DataFrame({"tau": pdf["score"].to_numpy(float), "delta": 0})])
        out = out.groupby([c for c in out.columns if c != "delta"], as_index=False)["delta"].sum()
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[names]

    rows = frames.where("normal").withColumn("_block", F.floor(F.col("seg") / segments))
    rows = rows.select(*keys, "scenario", "frame", "score", "seg", "_block", *([unit] if unit else []))
    got = spread(rows, *keys, "scenario", "_block").groupBy(*keys, "scenario", "_block").applyInPandas(run, schema)
    return got.groupBy(*names[:-1]).agg(F.sum("delta").alias("delta"))


def curve(steps_: DataFrame, keys: list[str] | None = None, unit: str | None = None) -> DataFrame:
    """(keys, tau, [unit,] C): running sums of the steps."""
    part = [*(keys or []), *([unit] if unit else [])]
    if not part:
        return Ordered(steps_.select("tau", "delta"), "tau").sums({"C": "delta"}).rows.select("tau", "C")
    w = Window.partitionBy(*part).orderBy(F.desc("tau")).rowsBetween(Window.unboundedPreceding, 0)
    return steps_.select(*part, "tau", F.sum("delta").over(w).alias("C"))
