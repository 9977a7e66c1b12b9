"""Choice of normal frames for a bank: capacity, allocation and spacing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.greedy import spaced_places
from loomframe.session import checked_broadcast


def capacity(eligible: DataFrame) -> DataFrame:
    """(scenario, frame, c): frames taken in order, each at least ``spacing`` after the last one taken."""
    kind = dict(eligible.dtypes)["scenario"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frames = np.sort(pdf["frame"].to_numpy())
        taken = frames[spaced_places(frames, int(pdf["spacing"].iloc[0]))]
        return pd.DataFrame({"scenario": pdf["scenario"].iloc[0], "frame": taken, "c": np.arange(len(taken))})

    return eligible.select("scenario", "frame", "spacing").groupBy("scenario").applyInPandas(run, f"scenario {kind}, frame int, c int")


def waterfill(total: int, capacities: dict[str, int]) -> dict[str, int]:
    """Equal shares up to each capacity; remainders to the first names, shortfalls to the rest, until nothing is left."""
    names = sorted(capacities)
    full = np.array([capacities[s] for s in names], np.int64)
    room = full.copy()
    while total > 0 and room.any():
        place = np.cumsum(room > 0)  # from 1 among those with room
        offer = total // place[-1] + (place <= total % place[-1])
        given = np.minimum(room, offer)
        room -= given
        total -= int(given.sum())
    return dict(zip(names, (full - room).tolist(), strict=True))


def allocate(capacities: DataFrame, total: int) -> DataFrame:
    """(group, scenario, quota) of (group, scenario, capacity): a task fills one group's few scenarios."""
    kinds = dict(capacities.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q = waterfill(total, dict(zip(pdf["scenario"], (int(c) for c in pdf["capacity"]), strict=True)))
        return pd.DataFrame({"group": pdf["group"].iloc[0], "scenario": list(q), "quota": list(q.values())})

    return capacities.groupBy("group").applyInPandas(run, f"group {kinds['group']}, scenario {kinds['scenario']}, quota long")


def spaced(taken: DataFrame, quotas: DataFrame) -> DataFrame:
    """(scenario, j, frame): the frames at floor((j + 1/2) c / q) of each scenario's c frames."""
    n = taken.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))
    picks = quotas.where("quota > 0").join(n, "scenario").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)))
    picks = picks.withColumn("c", F.call_function("div", (2 * F.col("j") + 1) * F.col("n"), 2 * F.col("quota")).cast("int"))
    return picks.join(taken, ["scenario", "c"]).select("scenario", "j", "frame")


def build(eligible: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """(group, scenario, j, frame) of a whole bank: ``total`` frames for each group."""
    taken = capacity(eligible)
    sizes = groups.join(taken.groupBy("scenario").agg(F.count(F.lit(1)).alias("n")), "scenario", "left").select("group", "scenario", F.coalesce("n", F.lit(0)).alias("capacity"))
    quotas = allocate(sizes, total)
    return spaced(taken, quotas.drop("group")).join(checked_broadcast(groups), "scenario").select("group", "scenario", "j", "frame")


def consecutive(frames: DataFrame, length: int) -> DataFrame:
    """The first run of ``length`` reliable frames; else the first ``length`` reliable frames; else none."""
    w = Window.partitionBy("scenario").orderBy("frame")
    rows = frames.where("status = 2").withColumn("island", F.col("frame") - F.row_number().over(w))
    runs = rows.groupBy("scenario", "island").agg(F.min("frame").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= length)
    first = runs.orderBy("scenario", "a").limit(1)
    run = first.select("scenario", F.explode(F.sequence("a", F.col("a") + length - 1)).alias("frame"))
    ordered = rows.select("scenario", "frame").orderBy("scenario", "frame").limit(length)
    enough = ordered.agg(F.count(F.lit(1)).alias("n"))
    none = first.agg(F.count(F.lit(1)).alias("m"))
    fallback = ordered.join(F.broadcast(enough)).join(F.broadcast(none)).where((F.col("n") == length) & (F.col("m") == 0)).select("scenario", "frame")
    return run.unionByName(fallback)
