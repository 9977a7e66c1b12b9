"""Checks that two computations of the same quantity agree."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.operators.temporal import _warped

#: Largest relative errors of features and maps between batch sizes; of distances (fixed values).
FEATURES_REL, MAPS_REL, DISTANCE_REL = 1e-6, 1e-4, 1e-4
#: Unit roundoff of float32, terms of a squared distance of 1,024 dimensions, and the double's allowance.
U32, TERMS, DOUBLE = 2.0**-24, 1026, 1024 * 2.0**-53
#: Pairs that the direction check takes, and how many of them must hold.
PAIRS, HOLDING = 200, 190


def shapes(found: dict[str, tuple], expected: dict[str, tuple]) -> bool:
    """Whether every expected shape was found."""
    return all(tuple(found.get(k, ())) == tuple(v) for k, v in expected.items())


def identical(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: rows of either side whose values differ or have no partner, bit by bit."""
    joined = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys, "full")
    same = F.coalesce(F.xxhash64("x") == F.xxhash64("y"), F.lit(False)) & F.col("x").eqNullSafe(F.col("y"))
    return joined.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~same).alias("different"))


def array_error(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: max |a - b| / max |b| over the elements of array columns."""
    joined = a.select(*keys, F.col(value).cast("array<double>").alias("x")).join(b.select(*keys, F.col(value).cast("array<double>").alias("y")), keys)
    rows = joined.select(F.array_max(F.zip_with("x", "y", lambda p, q: F.abs(p - q))).alias("d"), F.array_max(F.transform("y", F.abs)).alias("m"))
    return rows.agg((F.max("d") / F.max("m")).alias("rel"))


def constants_agree(a: DataFrame, b: DataFrame, most: float = MAPS_REL) -> DataFrame:
    """(name, rel, agrees) of the constants of two one-row tables with the same columns."""
    x, y = a.select(*(F.col(c).cast("double").alias(f"a_{c}") for c in a.columns)), b.select(*(F.col(c).cast("double").alias(f"b_{c}") for c in a.columns))
    each = [F.struct(F.lit(c).alias("name"), (F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) / F.abs(f"b_{c}")).alias("rel")) for c in a.columns]
    rows = x.join(F.broadcast(y)).select(F.explode(F.array(*each)).alias("r"))  # one row each
    return rows.select("r.name", "r.rel", (F.col("r.rel") <= most).alias("agrees"))


def batch_verdict(features_rel: float, maps_rel: list[float]) -> bool:
    return features_rel <= FEATURES_REL and max(maps_rel) <= MAPS_REL


def distance_bound(q: np.ndarray, b: np.ndarray, d: np.ndarray, terms: int = TERMS) -> np.ndarray:
    """Largest error that float32 arithmetic explains for each query q and base row b at distance d."""
    gamma = terms * U32 / (1 - terms * U32)
    return gamma * ((q * q).sum(1) + (b * b).sum(1) + 2 * (np.abs(q) * np.abs(b)).sum(1)) + DOUBLE * d


def distances_agree(q: np.ndarray, base: np.ndarray) -> dict:
    """Nearest squared distances by the float32 expansion against differences in double."""
    x, m = q.astype(np.float64), base.astype(np.float64)
    d64 = np.stack([((m - v) ** 2).sum(1) for v in x])
    at64 = d64.argmin(1)
    y, n = q.astype(np.float32), base.astype(np.float32)
    d32 = np.maximum(0, (y * y).sum(1)[:, None] + (n * n).sum(1)[None] - 2 * y @ n.T)
    at32 = d32.argmin(1)
    rows = np.arange(len(q))
    best = d64[rows, at64]
    error = np.abs(d32[rows, at32].astype(np.float64) - best)
    bound = np.maximum(distance_bound(x, m[at64], best), distance_bound(x, m[at32], best))
    primary = bool(error.max() / best.max() <= DISTANCE_REL) if best.max() > 0 else False
    fallback = bool((error <= bound).all())
    return {"relative": float(error.max() / best.max()) if best.max() > 0 else math.inf, "primary": primary, "fallback": fallback, "same_index": float((at32 == at64).mean()), "pass": primary or fallback}


def prefers_forward(before: np.ndarray, after: np.ndarray, u: int) -> tuple[bool, float, float, float]:
    """Whether the map moved by u matches the next one better than moved by -u; the errors, and that of no move.

    Compared on the columns that both moves cover; without any, the pair does not hold.
    """
    w = before.shape[1]
    cols = slice(abs(u), w - abs(u))
    if 2 * abs(u) >= w:
        return False, math.nan, math.nan, math.nan
    error = lambda m: float(np.mean((after[:, cols] - m[:, cols]) ** 2))
    f, r = error(_warped(before, u, 0.0)), error(_warped(before, -u, 0.0))
    return f < r, f, r, error(before)


def direction_check(pairs: DataFrame, maps: DataFrame, height: int, width: int) -> DataFrame:
    """(scenario, frame, u, holds, forward, backward, still) of pairs (scenario, frame, u) with the frame before."""
    kind = dict(pairs.dtypes)["scenario"]
    now = maps.select("scenario", "frame", F.col("map").alias("after"))
    prior = maps.select("scenario", (F.col("frame") + 1).alias("frame"), F.col("map").alias("before"))
    rows = pairs.join(now, ["scenario", "frame"]).join(prior, ["scenario", "frame"])

    def run(batches):
        for pdf in batches:
            got = [prefers_forward(np.asarray(b, float).reshape(height, width), np.asarray(a, float).reshape(height, width), int(u)) for b, a, u in zip(pdf["before"], pdf["after"], pdf["u"], strict=True)]
            out = pd.DataFrame(got, columns=["holds", "forward", "backward", "still"])
            yield pd.concat([pdf[["scenario", "frame", "u"]].reset_index(drop=True), out], axis=1)

    return rows.select("scenario", "frame", "u", "before", "after").mapInPandas(run, f"scenario {kind}, frame int, u int, holds boolean, forward double, backward double, still double")


def status_rollup(results: DataFrame, statuses: tuple[str, ...] = ("passed", "failed", "skipped")) -> DataFrame:
    """Tests of each module by status (module, status)."""
    return results.groupBy("module").pivot("status", list(statuses)).count().na.fill(0, list(statuses))
