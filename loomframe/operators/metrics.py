"""Detection metrics in exact integers.

The grid of thresholds is infinity and every distinct value of the normal
scores and the passes' scores.  False alarms are compared as integer counts and
rates stay fractions (num, den), so no metric passes through a float.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.operators import events
from loomframe.operators.intervals import in_window
from loomframe.operators.running import Ordered

INFINITY = float("inf")


def frame_scores(maps: DataFrame, cells: str = "map") -> DataFrame:
    """A frame's score is the largest cell of its map."""
    return maps.withColumn("score", F.array_max(cells).cast("double"))


def pass_scores(frames: DataFrame, windows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, scenario, s, track, q): the largest score inside each window."""
    rows = in_window(frames, windows, "s", "track").where("s is not null")
    return rows.groupBy(*(keys or []), "scenario", "s", "track").agg(F.max("score").alias("q"))


def track_scores(q: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return q.groupBy(*(keys or []), "track").agg(F.max("q").alias("z"))


def _steps_of(values: DataFrame, value: str, name: str, keys: list[str], weight: Column | None = None) -> DataFrame:
    counted = values.groupBy(*keys, F.col(value).alias("tau")).agg(F.sum(weight if weight is not None else F.lit(1)).cast("long").alias(name))
    return counted


def metric_curve(steps: DataFrame, q: DataFrame, keys: list[str] | None = None, weight: Column | None = None, index: DataFrame | None = None) -> DataFrame:
    """(keys, j, tau, C, E, detp, dett, next_E) at every threshold, from infinity down.

    Each quantity is a step function of the threshold; the steps are united
    and summed from above, so no values are compared with thresholds pair by
    pair.  ``weight`` counts passes other than by one.  ``index`` has all keys, if
    some may have no pass.
    """
    keys = keys or []
    parts = [
        steps.select(*keys, "tau", F.col("delta").alias("dc"), F.lit(0).cast("long").alias("dp"), F.lit(0).cast("long").alias("dt")),
        _steps_of(q, "q", "dp", keys, weight).select(*keys, "tau", F.lit(0).cast("long").alias("dc"), "dp", F.lit(0).cast("long").alias("dt")),
        _steps_of(track_scores(q, keys), "z", "dt", keys).select(*keys, "tau", F.lit(0).cast("long").alias("dc"), F.lit(0).cast("long").alias("dp"), "dt"),
    ]
    zero = [F.lit(0).cast("long").alias(c) for c in ("dc", "dp", "dt")]
    top = (q if index is None else index).select(*keys, F.lit(INFINITY).alias("tau"), *zero).distinct() if keys else q.sparkSession.range(1).select(F.lit(INFINITY).alias("tau"), *zero)
    united = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(top)
    grid = united.groupBy(*keys, "tau").agg(*(F.sum(c).alias(c) for c in ("dc", "dp", "dt")))
    return accumulated(grid, keys)


def accumulated(grid: DataFrame, keys: list[str]) -> DataFrame:
    """The curve of a grid of changes (keys, tau, dc, dp, dt): running sums, the envelope E and the next row's."""
    sums = {"C": "dc", "detp": "dp", "dett": "dt"}
    if not keys:
        rows = Ordered(grid, "tau").sums(sums, "j").greatest("C", "E").following("E", "next_E").rows
    else:
        w = Window.partitionBy(*keys).orderBy(F.desc("tau"))
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        rows = grid.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()} | {"j": (F.row_number().over(w) - 1).cast("long")})
        rows = rows.withColumn("E", F.max("C").over(upto)).withColumn("next_E", F.lead("E").over(w))
    return rows.select(*keys, "j", "tau", "C", "E", "detp", "dett", "next_E")


def metrics(curve: DataFrame, sizes: DataFrame, keys: list[str] | None = None, cap: int = 50) -> DataFrame:
    """P1, P2 and P3 as fractions, P1_censored and saturated.

    ``sizes`` has one row (for each key): nN normal frames, nP passes (or their
    total weight) and nK tracks.  P1 is the alarm rate at the first threshold
    that finds 4/5 of the passes; P2 the share of tracks found at the last one
    with at most 2 alarms per 1000 normal frames; P3 the mean share of passes
    found as the rate goes from 0 to 10 per 1000.
    """
    keys = keys or []
    rows = curve.join(sizes, keys) if keys else curve.join(F.broadcast(sizes))  # one row without keys
    within = 100 * F.col("E") <= F.col("nN")
    nxt = F.col("next_E")
    inner = within & F.coalesce(100 * nxt <= F.col("nN"), F.lit(False))
    area = F.when(inner, F.col("detp") * 1000 * (nxt - F.col("E"))).when(within, F.col("detp") * (10 * F.col("nN") - 1000 * F.col("E"))).otherwise(0)
    rows = rows.withColumn("area", area)
    ok2 = 1000 * F.col("E") <= 2 * F.col("nN")
    agg = rows.groupBy(*keys, "nN", "nP", "nK").agg(
        F.min(F.when(5 * F.col("detp") >= 4 * F.col("nP"), F.struct("j", "E"))).alias("at_p1"),
        F.max(F.when(ok2, F.struct("j", "detp", "dett", "tau", "E"))).alias("at_p2"),
        F.sum("area").cast("long").alias("P3_num"),
    )
    censored = 1000 * F.col("at_p1.E") > cap * F.col("nN")
    return agg.select(
        *keys,
        F.when(censored, F.lit(cap) * F.col("nN")).otherwise(1000 * F.col("at_p1.E")).cast("long").alias("P1_num"),
        F.col("nN").alias("P1_den"),
        censored.alias("P1_censored"),
        F.col("at_p2.dett").alias("P2_num"),
        F.col("nK").alias("P2_den"),
        "P3_num",
        (10 * F.col("nP") * F.col("nN")).alias("P3_den"),
        (20 * F.col("at_p2.detp") >= 19 * F.col("nP")).alias("saturated"),
    )


def track_shares(curve: DataFrame, q: DataFrame, sizes: DataFrame) -> DataFrame:
    """(track, share_num, share_den): each track's part of the track-balanced P3, which is their sum.

    A pass counts at thresholds up to its score, so its part of the area is that
    of the alarm rates from its score down.  Parts are whole numbers over one
    denominator for each track, however many passes it has.
    """
    rows = curve.join(F.broadcast(sizes.select("nN")))  # one row
    within = 100 * F.col("E") <= F.col("nN")
    inner = within & F.coalesce(100 * F.col("next_E") <= F.col("nN"), F.lit(False))
    width = F.when(inner, 1000 * (F.col("next_E") - F.col("E"))).when(within, 10 * F.col("nN") - 1000 * F.col("E")).otherwise(0).cast("long")
    # scores of passes are thresholds of the curve; widths above a score are taken from the whole
    upto = Ordered(rows.select("tau", width.alias("width")), "tau").sums({"above": "width"}).rows.select("tau", (F.col("above") - F.col("width")).alias("above"))
    whole = rows.agg(F.sum(width).alias("whole"))
    parts = q.join(upto, q["q"] == upto["tau"]).join(F.broadcast(whole))  # one row
    by = parts.groupBy("track").agg(F.sum(F.col("whole") - F.col("above")).cast("long").alias("share_num"), F.count(F.lit(1)).alias("n"))
    one = sizes.select((F.col("nN") * F.col("nK")).alias("m"))
    return by.join(F.broadcast(one)).select("track", "share_num", (10 * F.col("n") * F.col("m")).cast("long").alias("share_den"))


def sizes(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """One row: nN, nP, nK."""
    a = frames.agg(F.sum(F.col("normal").cast("long")).alias("nN"))
    return a.join(F.broadcast(windows.agg(F.count(F.lit(1)).alias("nP"), F.countDistinct("track").alias("nK"))))


def evaluate(frames: DataFrame, windows: DataFrame, cap: int = events.CAP) -> DataFrame:
    """All metrics of one score trace (scenario, frame, score, normal, seg)."""
    q = pass_scores(frames, windows)
    return metrics(metric_curve(events.steps(frames, cap=cap), q), sizes(frames, windows))


def deployment_threshold(steps: DataFrame, normal: DataFrame, keys: list[str] | None = None, most: int = 2, per: int = 1000) -> DataFrame:
    """Smallest threshold of a timeline without passes with at most ``most`` alarms per ``per`` frames.

    ``normal`` has n, the number of normal frames (of each key).
    """
    keys = keys or []
    zero = F.lit(0).cast("long").alias("delta")
    if not keys:
        top = steps.sparkSession.range(1).select(F.lit(INFINITY).alias("tau"), zero)
        rows = Ordered(steps.select("tau", "delta").unionByName(top), "tau").sums({"C": "delta"}).greatest("C", "E").rows.join(F.broadcast(normal))  # one row
    else:
        w = Window.partitionBy(*keys).orderBy(F.desc("tau")).rowsBetween(Window.unboundedPreceding, 0)
        rows = steps.select(*keys, "tau", "delta").unionByName(normal.select(*keys, F.lit(INFINITY).alias("tau"), zero))
        rows = rows.withColumn("C", F.sum("delta").over(w)).withColumn("E", F.max("C").over(w)).join(normal, keys)
    return rows.where(F.lit(per) * F.col("E") <= F.lit(most) * F.col("n")).groupBy(*keys).agg(F.min("tau").alias("threshold"), F.max("E").alias("events"))


def at_threshold(frames: DataFrame, windows: DataFrame, tau) -> DataFrame:
    """One row: events, passes and tracks found at a threshold, and the totals they are shares of."""
    runs = events.runs_at(frames, tau)
    found = pass_scores(frames, windows).where(F.col("q") >= tau)
    a = runs.agg(F.coalesce(F.sum(events.events_of(runs)), F.lit(0)).cast("long").alias("events"))
    b = found.agg(F.count(F.lit(1)).alias("passes"), F.countDistinct("track").alias("tracks"))
    return a.join(F.broadcast(b)).join(F.broadcast(sizes(frames, windows)))  # one row each


def ranking_quality(frames: DataFrame) -> DataFrame:
    """Frame AUROC (ties by average rank) and AUPRC of score against ``positive``.

    Counts are summed for each distinct score first, then accumulated by range.
    """
    by = frames.groupBy("score").agg(F.sum(F.col("positive").cast("long")).alias("hits"), F.sum((~F.col("positive")).cast("long")).alias("misses"))
    rows = Ordered(by, "score").sums({"tp": "hits", "fp": "misses"}).rows
    total = by.agg(F.sum("hits").alias("positives"), F.sum("misses").alias("negatives"))
    rows = rows.join(F.broadcast(total))  # one row
    # twice the pairs ranked right: all negatives below the score count two, ties one
    right = F.sum(F.col("hits") * (2 * (F.col("negatives") - F.col("fp")) + F.col("misses")))
    area = F.sum(F.col("hits") / F.col("positives") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return rows.groupBy("positives", "negatives").agg((right / (2.0 * F.col("positives") * F.col("negatives"))).alias("auroc"), area.alias("auprc")).select("auroc", "auprc")
