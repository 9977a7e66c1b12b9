"""Temporal variants of a score: plain, averaged, and averaged along the motion.

Maps are arrays in row-major order.  A frame's variants need the maps of up to
24 frames before it, so frames are dealt to chunks of CHUNK frames and the last
24 of a chunk go to the next one too; tasks hold one chunk, however long a
scenario is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.functions.scalars import lag_source
from loomframe.operators.chunks import with_windows
from loomframe.session import spread

NAMES = ("V0", "V1", "V2", "V4", "REV", "LAG", "ORA")
CHUNK, LONGEST = 256, 25


def trailing_mean(frames: DataFrame, column: str = "score", longest: int = LONGEST) -> DataFrame:
    """Adds V1, the mean of the last K scores, summed from the newest to the oldest."""
    held = with_windows(frames, longest - 1, 0, lambda dealt, w: dealt.withColumn("_s", F.collect_list(column).over(w.rowsBetween(1 - longest, 0))))
    newest = F.reverse(F.slice("_s", F.size("_s") - F.col("K") + 1, F.col("K")))
    return held.withColumn("V1", F.aggregate(newest, F.lit(0.0), lambda a, x: a + x) / F.col("K")).drop("_s")


def fill_count(u, width: int):
    """Columns that a warp by u fills with the prior."""
    return F.least(F.abs(u), F.lit(width))


def warp(cells: DataFrame, shift: str, width: int, prior: float, keys: list[str]) -> DataFrame:
    """Cells (keys, row, col, value) moved left by ``shift`` columns; uncovered cells hold the prior."""
    rows = cells.select(*keys, "row").distinct().withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    moved = cells.select(*keys, "row", (F.col("col") - F.col(shift)).cast("int").alias("col"), "value").where(F.col("col").between(0, width - 1))
    return rows.join(moved, [*keys, "row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(prior)))


def terms(rows: DataFrame) -> DataFrame:
    """(scenario, frame, variant, i, src, shift) of every aligned variant's terms; needs K and U."""
    base = rows.where("U is not null").select("scenario", "frame", "K", F.posexplode("U").alias("i", "u"))
    plan = F.array(
        F.struct(F.lit("V4").alias("variant"), (F.col("frame") - F.col("i")).alias("src"), F.col("u").alias("shift")),
        F.struct(F.lit("REV").alias("variant"), (F.col("frame") - F.col("i")).alias("src"), (-F.col("u")).alias("shift")),
        F.struct(F.lit("LAG").alias("variant"), (F.col("frame") - lag_source(F.col("i"), F.col("K"))).cast("int").alias("src"), F.col("u").alias("shift")),
    )
    return base.select("scenario", "frame", "i", F.explode(plan).alias("p")).select("scenario", "frame", "p.variant", "i", "p.src", "p.shift")


def _warped(a: np.ndarray, u: int, prior: float) -> np.ndarray:
    out = np.full(a.shape, prior)
    w = a.shape[1]
    if abs(u) < w:
        out[:, max(0, -u) : w - max(0, u)] = a[:, max(0, u) : w + min(0, u)]
    return out


def _top(total: np.ndarray, k: int) -> float:
    return float((total / k).astype(np.float32).max())


def variants(rows: DataFrame, height: int, width: int, prior: float, chunk: int = CHUNK, longest: int = LONGEST) -> DataFrame:
    """(scenario, frame, variant, score) of all variants.

    ``rows`` has map, K, mu, U and, for ORA, mu_oracle and U_oracle.  Sums are
    double, in the order i = 0 .. K-1, and become floats before the maximum.
    Frames of unknown motion score as V2.
    """
    kind = dict(rows.dtypes)["scenario"]
    names = ["scenario", "frame", "map", "K", "mu", "U", "mu_oracle", "U_oracle"]
    own = F.floor((F.col("frame") - 1) / chunk).cast("int")
    after = F.floor((F.col("frame") + longest - 2) / chunk).cast("int")
    lags = F.transform(F.sequence(F.lit(0), F.col("K") - 1), lambda i: lag_source(i, F.col("K")).cast("int"))
    dealt = rows.select(*names, lags.alias("lags"), own.alias("own"), F.explode(F.sequence(own, after)).alias("part"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        first = int(pdf["frame"].iloc[0])
        maps = np.stack([np.asarray(m, np.float32).reshape(height, width) for m in pdf["map"]])
        out = []
        for i, (f, k, mu, us, mo, uo, lag, mine) in enumerate(zip(pdf["frame"], pdf["K"], pdf["mu"], pdf["U"], pdf["mu_oracle"], pdf["U_oracle"], pdf["lags"], pdf["own"] == pdf["part"], strict=True)):
            if not mine:
                continue
            assert f - first == i and i - k + 1 >= 0, "frames must follow each other"
            total, line = np.zeros((height, width)), 0.0
            for j in range(k):
                total += maps[i - j]
                line += float(maps[i - j].max())
            got = dict.fromkeys(NAMES, _top(total, k))
            got["V0"], got["V1"] = float(maps[i].max()), line / k
            plans = {}
            if not mu:
                plans = {"V4": [(j, us[j]) for j in range(k)], "REV": [(j, -us[j]) for j in range(k)], "LAG": list(zip(lag, us, strict=True))}
            if not mo:
                plans["ORA"] = [(j, uo[j]) for j in range(k)]
            for name, plan in plans.items():
                total = np.zeros((height, width))
                for j, u in plan:
                    total += _warped(maps[i - j], int(u), prior)
                got[name] = _top(total, k)
            out += [(pdf["scenario"].iloc[i], f, name, got[name]) for name in NAMES]
        return pd.DataFrame(out, columns=["scenario", "frame", "variant", "score"])

    return spread(dealt, "scenario", "part").groupBy("scenario", "part").applyInPandas(run, f"scenario {kind}, frame int, variant string, score double")


def map_constants(maps: DataFrame, column: str = "map") -> DataFrame:
    """One row: the mean of all cells and their 99.9th percentile (linear)."""
    cells = maps.select(F.explode(F.col(column).cast("array<double>")).alias("v"))
    return cells.agg(F.avg("v").alias("mu0"), F.percentile("v", F.lit(0.999)).alias("tau_cell"))


def cells_of(maps: DataFrame, width: int, keys: list[str], column: str = "map") -> DataFrame:
    """Long form (keys, row, col, value)."""
    return maps.select(*keys, F.posexplode(column).alias("cell", "value")).select(*keys, F.floor(F.col("cell") / width).cast("int").alias("row"), F.pmod("cell", F.lit(width)).alias("col"), F.col("value").cast("double").alias("value"))


def max3(cells: DataFrame, height: int, width: int, keys: list[str]) -> DataFrame:
    """Largest value of each cell's 3 x 3 neighbourhood, clipped at the border."""
    near = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    spread = cells.withColumn("o", F.explode(near)).select(*keys, (F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"), "value")
    return spread.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).groupBy(*keys, "row", "col").agg(F.max("value").alias("value"))


def baselines(cells: DataFrame, height: int, width: int, keys: list[str]) -> DataFrame:
    """(row, col, b1, b3): means over frames of the cell and of its 3 x 3 maximum."""
    b1 = cells.groupBy("row", "col").agg(F.avg("value").alias("b1"))
    return b1.join(max3(cells, height, width, keys).groupBy("row", "col").agg(F.avg("value").alias("b3")), ["row", "col"])


def column_profile(base: DataFrame) -> DataFrame:
    return base.groupBy("col").agg(F.avg("b1").alias("profile"))


def argmax_cell(cells: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """(keys, row, col, value) of the largest cell; the first in row-major order on ties."""
    cell = F.col("row") * width + F.col("col")
    best = F.max(F.struct("value", (-cell).alias("c"))).alias("b")
    out = cells.groupBy(*keys).agg(best).select(*keys, (-F.col("b.c")).alias("cell"), F.col("b.value").alias("value"))
    return out.select(*keys, F.floor(F.col("cell") / width).cast("int").alias("row"), F.pmod("cell", F.lit(width)).alias("col"), "value")


def unfold3(cells: DataFrame, height: int, width: int, keys: list[str]) -> DataFrame:
    """(keys, row, col, patch): the nine values around each cell, row by row, zeros outside."""
    near = F.array(*(F.struct(F.lit(3 * (1 - a) + 1 - b).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    spread = cells.withColumn("o", F.explode(near)).select(*keys, (F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"), F.col("o.k").alias("k"), "value")
    inside = spread.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    held = F.map_from_entries(F.collect_list(F.struct("k", "value")))
    return inside.groupBy(*keys, "row", "col").agg(held.alias("m")).select(*keys, "row", "col", F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.coalesce(F.col("m")[k], F.lit(0.0))).alias("patch"))


def adaptive_mean(column, size: int, parts: int):
    """Averages of an array over ``parts`` slices from floor(i n / d) to ceil((i+1) n / d)."""
    cuts = [(i * size // parts, -(-(i + 1) * size // parts)) for i in range(parts)]
    return F.array(*(F.aggregate(F.slice(column, a + 1, b - a), F.lit(0.0), lambda s, x: s + x) / F.lit(float(b - a)) for a, b in cuts))


def upsample2(cells: DataFrame, height: int, width: int, keys: list[str]) -> DataFrame:
    """Bilinear enlargement by two with pixel centres aligned to their areas."""

    def taps(n: int) -> list[tuple[int, int, float]]:
        out = []
        for o in range(2 * n):
            x = max(0.0, (o + 0.5) / 2 - 0.5)
            a = int(x)
            b = min(a + 1, n - 1)
            out += [(o, a, 1 - (x - a)), (o, b, x - a)]
        return out

    spark = cells.sparkSession
    rows = spark.createDataFrame(taps(height), "orow int, row int, wr double")  # a few rows for each row of a map
    cols = spark.createDataFrame(taps(width), "ocol int, col int, wc double")
    joined = cells.join(F.broadcast(rows), "row").join(F.broadcast(cols), "col")
    return joined.groupBy(*keys, F.col("orow").alias("row"), F.col("ocol").alias("col")).agg(F.sum(F.col("value") * F.col("wr") * F.col("wc")).alias("value"))


def block_mean(cells: DataFrame, block: int, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys, F.floor(F.col("row") / block).cast("int").alias("row"), F.floor(F.col("col") / block).cast("int").alias("col")).agg(F.avg("value").alias("value"))


def paired_mse(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Mean squared difference over cells present in both."""
    return a.join(b.withColumnRenamed("value", "other"), [*keys, "row", "col"]).groupBy(*keys).agg(F.avg((F.col("value") - F.col("other")) ** 2).alias("mse"))
