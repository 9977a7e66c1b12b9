"""Motion estimates: consistency, thresholds, statuses, adaptive windows and shifts.

Rules whose history holds every earlier estimate are window functions.  Rules
whose history holds only accepted rows depend on their own earlier decisions;
they run as one pass over each scenario.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loomframe.operators.chunks import with_windows
from loomframe.session import spread
from loomframe.sources.config import Motion, Windows

UNKNOWN, HELD, RELIABLE = 0, 1, 2


def _by_frame(*keys: str):
    return Window.partitionBy("scenario", *keys).orderBy("frame")


def _bounds(cfg: Motion) -> Column:
    return (F.abs("dx") <= cfg.max_abs_dx) & (F.abs("dy") <= cfg.max_abs_dy)


def consistency(frames: DataFrame, cfg: Motion = Motion()) -> DataFrame:
    """Frames with an estimate and whether it agrees with the estimates before it."""
    rows = frames.where("has_est")
    before = _by_frame().rowsBetween(-cfg.consistency_window, -1)
    med = F.percentile("dx", F.lit(0.5)).over(before)
    n = F.count("dx").over(before)
    near = F.abs(F.col("dx") - med) <= F.greatest(F.lit(cfg.consistency_abs), F.lit(cfg.consistency_rel) * F.abs(med))
    return rows.withColumn("consistent", _bounds(cfg) & ((n < cfg.consistency_min_history) | F.coalesce(near, F.lit(True))))


def two_frame_sum(frames: DataFrame) -> DataFrame:
    """Adds ``s2``, the displacement over two frames; null unless both have an estimate."""
    w = _by_frame()
    return frames.withColumn("s2", F.when(F.col("has_est") & F.lag("has_est").over(w), F.col("dx") + F.lag("dx").over(w)))


def sum_consistency(frames: DataFrame, cfg: Motion = Motion()) -> DataFrame:
    """As ``consistency``, on two-frame sums against half the relative band."""
    rows = two_frame_sum(frames).where("has_est").withColumn("defined", F.col("s2").isNotNull())
    before = _by_frame("defined").rowsBetween(-cfg.consistency_window, -1)
    med = F.percentile("s2", F.lit(0.5)).over(before)
    n = F.count("s2").over(before)
    near = F.abs(F.col("s2") - med) <= F.greatest(F.lit(cfg.consistency_abs), F.lit(cfg.consistency_rel) * F.abs(med) / 2)
    return rows.withColumn("consistent", _bounds(cfg) & (~F.col("defined") | (n < cfg.consistency_min_history) | F.coalesce(near, F.lit(True)))).drop("defined")


def threshold_counts(flags: DataFrame, cfg: Motion = Motion(), by: list[str] | None = None) -> DataFrame:
    """Estimates and consistent ones with r at or above each step g of the grid.

    A row goes to the last step it reaches, found from floor(r * steps) and
    corrected by comparing with the steps themselves; counts then add up over a
    table of one row a step.
    """
    keys, steps = by or [], cfg.tau_r_steps
    g0 = F.floor(F.col("r") * steps)
    last = F.when(F.col("r") >= (g0 + 1) / F.lit(float(steps)), g0 + 1).when(F.col("r") < g0 / F.lit(float(steps)), g0 - 1).otherwise(g0)
    reached = flags.withColumn("g", F.least(last, F.lit(steps)).cast("int")).where("g >= 0")
    sums = reached.groupBy(*keys, "g").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("consistent").cast("long")).alias("c"))
    grid = flags.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("g"))
    if keys:
        grid = sums.select(*keys).distinct().withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(sums, [*keys, "g"], "left").select(*keys, "g", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("n"), F.sum(F.coalesce("c", F.lit(0))).over(w).alias("consistent"))


def least_threshold(counts: DataFrame, cfg: Motion = Motion(), by: list[str] | None = None) -> DataFrame:
    """Smallest step with enough pairs of which 95 % are consistent; null if there is none."""
    good = (F.col("n") >= cfg.tau_r_min_pairs) & (100 * F.col("consistent") >= 95 * F.col("n"))
    return counts.groupBy(*(by or [])).agg(F.min(F.when(good, F.col("g"))).alias("tau_step"))


def _median(values: Iterable[float]) -> float:
    v = sorted(values)
    h = len(v) // 2
    return v[h] if len(v) % 2 else (v[h - 1] + v[h]) / 2


def _walk(pdf: pd.DataFrame, tau: float | None, cfg: Motion, sums: bool) -> pd.DataFrame:
    """Statuses of one scenario; the history holds accepted values only."""
    pdf = pdf.sort_values("frame")
    dx, dy, r = (pdf[c].to_numpy(float) for c in ("dx", "dy", "r"))
    has, frame = pdf["has_est"].to_numpy(bool), pdf["frame"].to_numpy()
    with np.errstate(invalid="ignore"):
        basic = has & (r >= (np.inf if tau is None else tau)) & (np.abs(dx) <= cfg.max_abs_dx) & (np.abs(dy) <= cfg.max_abs_dy)
    status, used = np.zeros(len(pdf), np.int8), np.full(len(pdf), np.nan)
    history: deque[float] = deque(maxlen=cfg.consistency_window)
    last = -1
    for i in range(len(pdf)):
        ok = bool(basic[i]) and frame[i] > 1
        value, rel = dx[i], cfg.consistency_rel
        if sums:
            ok = ok and i > 0 and bool(basic[i - 1])
            value, rel = (dx[i] + dx[i - 1] if i else np.nan), rel / 2
        if ok and len(history) >= cfg.consistency_min_history:
            med = _median(history)
            ok = abs(value - med) <= max(cfg.consistency_abs, rel * abs(med) if not sums else cfg.consistency_rel * abs(med) / 2)
        if ok:
            history.append(float(value))
            status[i], used[i], last = RELIABLE, dx[i], i
        elif frame[i] > 1 and last >= 0 and i - last <= cfg.hold_frames:
            status[i], used[i] = HELD, used[last]
    return pd.DataFrame({"scenario": pdf["scenario"].to_numpy(), "frame": frame, "status": status, "dx_used": pd.array(used).astype("Float64")})


def statuses(frames: DataFrame, tau: float | None, cfg: Motion = Motion(), sums: bool = False) -> DataFrame:
    """(scenario, frame, status, dx_used); with no threshold every frame is unknown.

    ``sums`` tests two-frame sums, whose both frames must pass the basic checks.
    """
    kind = dict(frames.dtypes)["scenario"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _walk(pdf, tau, cfg, sums)
        out["dx_used"] = out["dx_used"].astype(object).where(out["dx_used"].notna(), None)
        return out

    return frames.select("scenario", "frame", "dx", "dy", "r", "has_est").transform(spread, "scenario").groupBy("scenario").applyInPandas(run, f"scenario {kind}, frame int, status tinyint, dx_used double")


def window_lengths(moved: DataFrame, cfg: Windows = Windows()) -> DataFrame:
    """Adds k_full and K = least(k_full, frame) from (scenario, frame, status, dx_used): the adaptive window."""
    reliable = F.col("status") == RELIABLE
    own = _by_frame("reliable")
    rows = moved.withColumn("reliable", reliable)
    med = F.percentile(F.abs("dx_used"), F.lit(0.5)).over(own.rowsBetween(1 - cfg.median_window, 0))
    rows = rows.withColumn("m", F.when(F.col("reliable"), med)).withColumn("c", F.when(F.col("reliable"), F.row_number().over(own)))
    upto = _by_frame().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("m", F.last("m", ignorenulls=True).over(upto)).withColumn("c", F.coalesce(F.last("c", ignorenulls=True).over(upto), F.lit(0)))
    scaled = F.least(F.greatest(F.floor(F.lit(cfg.span_px) / F.col("m") + 0.5), F.lit(cfg.k_min)), F.lit(cfg.k_max))
    k = F.when(F.col("c") < cfg.reliable_for_k, cfg.k_initial).when(F.col("m") == 0, cfg.k_stopped).otherwise(scaled).cast("int")
    return rows.withColumn("k_full", k).withColumn("K", F.least("k_full", "frame")).drop("reliable", "m", "c")


def motion_unknown(rows: DataFrame, known: Column, name: str = "mu", longest: int = Windows.k_max) -> DataFrame:
    """Adds whether any frame in [t - K + 2, t] is not known (K = 1: never); K is at most ``longest``."""

    def add(dealt: DataFrame, w: WindowSpec) -> DataFrame:
        last = F.last(F.when(~known, F.col("frame")), ignorenulls=True).over(w.rowsBetween(2 - longest, 0))
        return dealt.withColumn(name, (F.col("K") >= 2) & F.coalesce(last >= F.greatest(F.lit(1), F.col("frame") - F.col("K") + 2), F.lit(False)))

    return with_windows(rows, longest - 2, 0, add)


def oracle_dx(moved: DataFrame, cfg: Motion = Motion()) -> DataFrame:
    """Adds the centred median of reliable dx; null with too few values.  Not causal."""
    half = cfg.oracle_halfwidth
    value = F.when(F.col("status") == RELIABLE, F.col("dx_used"))

    def add(dealt: DataFrame, w: WindowSpec) -> DataFrame:
        near = w.rowsBetween(-half, half)
        return dealt.withColumn("dx_oracle", F.when(F.count(value).over(near) >= cfg.oracle_min_values, F.percentile(value, F.lit(0.5)).over(near)))

    return with_windows(moved, half, half, add)


def shifts(rows: DataFrame, dx: str = "dx_used", longest: int = Windows.k_max) -> DataFrame:
    """Adds U: cell shifts (U(t,0)=0 .. U(t,K-1)), each summed in ascending frame order."""
    step = F.coalesce(F.col(dx) / 8.0, F.lit(float("nan")))
    total = lambda i: F.aggregate(F.slice("_u", F.size("_u") - i + 1, i), F.lit(0.0), lambda a, x: a + x)
    one = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.when(~F.isnan(total(i)), F.floor(-total(i) + 0.5)).cast("long"))
    held = with_windows(rows, longest - 2, 0, lambda dealt, w: dealt.withColumn("_u", F.collect_list(step).over(w.rowsBetween(2 - longest, 0))))
    return held.withColumn("U", F.transform(F.sequence(F.lit(0), F.col("K") - 1), one)).drop("_u")


def invalid(rows: DataFrame, has_threshold: bool, by: list[str] | None = None) -> DataFrame:
    """Whether over 5 % of the frames are motion-unknown, or no threshold exists."""
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("mu").cast("long")).alias("unknown")).withColumn("invalid", F.lit(not has_threshold) | (100 * F.col("unknown") > 5 * F.col("n")))


def without_estimate(frames: DataFrame) -> DataFrame:
    return frames.groupBy("scenario").agg(F.count_if((F.col("frame") > 1) & ~F.col("has_est")).alias("n"))


def standardise(image: np.ndarray, rows: tuple[int, int], least: float = 1e-6) -> np.ndarray | None:
    """Zero mean and unit population deviation of a band of rows; None if nearly constant."""
    x = image[rows[0] : rows[1] + 1].astype(np.float32)
    s = float(x.std())
    return None if s < least else ((x - float(x.mean())) / s).astype(np.float32)


def phase_correlate(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(dx, dy, response) of b against a, by the windowed cross-power spectrum.

    The peak is refined by the centroid of its 5 x 5 neighbourhood, whose share
    of the whole response is returned.
    """
    h, w = a.shape
    win = np.sqrt(np.outer(np.hanning(h), np.hanning(w)))
    fa, fb = np.fft.rfft2(a * win), np.fft.rfft2(b * win)
    cross = fb * np.conj(fa)
    size = np.abs(cross)
    c = np.fft.irfft2(np.where(size > 1e-12, cross / np.maximum(size, 1e-12), 0), s=(h, w))
    py, px = np.unravel_index(int(c.argmax()), c.shape)
    ys, xs = np.arange(py - 2, py + 3), np.arange(px - 2, px + 3)
    near = np.maximum(c[np.ix_(ys % h, xs % w)], 0)
    mass = near.sum()
    y, x = (near.sum(1) * ys).sum() / mass, (near.sum(0) * xs).sum() / mass
    return float(x - w if x > w / 2 else x), float(y - h if y > h / 2 else y), float(mass)


def raw_motion(images: DataFrame, rows: int, cols: int, crop: tuple[int, int]) -> DataFrame:
    """(scenario, frame, dx, dy, r, has_est) from (scenario, frame, pixels), one scenario a task."""
    kind = dict(images.dtypes)["scenario"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, before = [], None
        for s, f, p in pdf.sort_values("frame")[["scenario", "frame", "pixels"]].itertuples(index=False):
            z = standardise(np.asarray(p).reshape(rows, cols), crop)
            out.append((s, f, *(phase_correlate(before, z) if z is not None and before is not None else (None,) * 3), z is not None and before is not None))
            before = z
        return pd.DataFrame(out, columns=["scenario", "frame", "dx", "dy", "r", "has_est"])

    return spread(images, "scenario").groupBy("scenario").applyInPandas(run, f"scenario {kind}, frame int, dx double, dy double, r double, has_est boolean")
