"""Timelines from the driver's event table, and their integrity checks.

A timeline has one row a frame: scenario, frame (from 1), score, label and a
raw motion estimate (dx, dy, r, has_est).  Its columns come from `events` by
fixed expressions, so both engines read the same timeline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.functions.scalars import frame_number

#: Labels of normal frames, least label of a defect, and labels that start a rotation.
NORMAL, DEFECT, ANCHORS = (1, 2), 3, (2, 5)
#: Scenarios of the timeline made from the event table.
SCENARIOS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str, scenarios: int = SCENARIOS) -> DataFrame:
    """The frames of every scenario."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    scenario = F.pmod(F.col("user_id"), F.lit(scenarios)).cast("int")
    w = Window.partitionBy("scenario").orderBy("ts", "event_id")
    label = F.when((F.col("event_type") == "error") & (F.col("k") >= 90), 4).when((F.col("event_type") == "signup") & (F.col("k") < 10), 2).otherwise(1)
    rows = events.withColumn("k", k).withColumn("scenario", scenario).withColumn("frame", F.row_number().over(w))
    has = F.col("frame") > 1
    dx = (-(F.lit(100) + F.pmod(F.col("event_id") * 7919, F.lit(41)) - 20)).cast("double")
    return rows.select(
        "scenario",
        "frame",
        F.col("value").alias("score"),
        label.alias("label"),
        F.when(has, dx).alias("dx"),
        F.when(has, (F.pmod(F.col("event_id"), F.lit(7)) - 3).cast("double")).alias("dy"),
        F.when(has, F.col("k") / F.lit(100.0)).alias("r"),
        has.alias("has_est"),
    )


def capped(frames: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` frames of each scenario, or all."""
    return frames if most is None else frames.where(F.col("frame") <= most)


def parse_labels(raw: DataFrame) -> DataFrame:
    """(scenario, frame, label) of label rows (scenario, FileName, Label), header spaces stripped."""
    names = {c.strip().lower(): c for c in raw.columns}
    return raw.select("scenario", frame_number(F.col(names["filename"])).alias("frame"), F.trim(F.col(names["label"])).cast("int").alias("label"))


def contiguity(frames: DataFrame) -> DataFrame:
    """For each scenario whether its frames are exactly 1..N."""
    return frames.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"),
        ((F.min("frame") == 1) & (F.max("frame") == F.count(F.lit(1))) & (F.countDistinct("frame") == F.count(F.lit(1)))).alias("contiguous"),
    )


def finite(score: Column) -> Column:
    """The score, or an error where it is null, NaN or infinite."""
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a score is not finite")).cast("double")).otherwise(score)


def defect_frames(frames: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Frames labelled as a defect or inside a scenario's override range (scenario, lo, hi)."""
    labelled = frames.where(F.col("label") >= DEFECT).select("scenario", "frame")
    if overrides is None:
        return labelled
    inside = frames.join(overrides, "scenario").where(F.col("frame").between(F.col("lo"), F.col("hi"))).select("scenario", "frame")
    return labelled.union(inside).distinct()


def runs_of(frames: DataFrame, condition: Column) -> DataFrame:
    """Maximal runs (scenario, ordinal, s, e) of consecutive frames that meet the condition."""
    w = Window.partitionBy("scenario").orderBy("frame")
    rows = frames.withColumn("hit", F.coalesce(condition, F.lit(False))).withColumn("starts", (F.col("hit") & ~F.coalesce(F.lag("hit").over(w), F.lit(False))).cast("int"))
    rows = rows.withColumn("ordinal", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("hit").groupBy("scenario", "ordinal").agg(F.min("frame").alias("s"), F.max("frame").alias("e"))


def passes(frames: DataFrame, tracks: int = 5) -> DataFrame:
    """Defect runs as passes (scenario, ordinal, s, e, track)."""
    found = runs_of(frames, F.col("label") >= DEFECT)
    return found.withColumn("track", F.concat_ws("-", F.col("scenario").cast("string"), F.pmod(F.col("ordinal"), F.lit(tracks)).cast("string")))


def purpose_gate(reads: DataFrame, allowed: DataFrame) -> DataFrame:
    """Reads (purpose, fold, scenario, frame) that no allow-list row covers; null frame allows all."""
    on = ["purpose", "fold", "scenario"]
    whole = allowed.where("frame is null").select(*on).distinct()
    single = allowed.where("frame is not null").select(*on, "frame").distinct()
    return reads.join(whole, on, "left_anti").join(single, [*on, "frame"], "left_anti")


def roles(groups: DataFrame, train: list[str], test: str) -> DataFrame:
    """(scenario, training, test) of the scenarios (scenario, group) with a role; raises if one has both."""
    wanted = training_scenarios(groups, train, test).select("scenario", F.lit("training").alias("role"))
    held = groups.where(F.col("group") == test).select("scenario", F.lit("test").alias("role")).distinct()
    both = F.count(F.lit(1)) > 1
    named = wanted.unionByName(held).groupBy("scenario").agg(F.when(both, F.raise_error(F.lit("a scenario has two roles")).cast("string")).otherwise(F.min("role")).alias("role"))
    return named.select("scenario", (F.col("role") == "training").alias("training"), (F.col("role") == "test").alias("test"))


def group_map(clusters: DataFrame, scenario: str, group: str) -> DataFrame:
    """(scenario, group) of cluster rows; raises where a scenario has two groups."""
    rows = clusters.groupBy(F.col(scenario).alias("scenario")).agg(F.min(group).alias("group"), F.max(group).alias("_g"))
    two = F.raise_error(F.lit("a scenario has two groups")).cast("string")
    return rows.select("scenario", F.when(F.col("group") != F.col("_g"), two).otherwise(F.col("group").cast("string")).alias("group"))


def gated(reads: DataFrame, allowed: DataFrame) -> DataFrame:
    """The reads, or an error if one of them is not allowed."""
    if not purpose_gate(reads, allowed).isEmpty():
        raise PermissionError("a frame is read for a purpose that does not allow it")
    return reads


def read_summary(reads: DataFrame) -> DataFrame:
    return reads.groupBy("purpose", "fold", "scenario").agg(F.count(F.lit(1)).alias("n"))


def tagged(frames: DataFrame, purpose: str, fold: int | str | None = None) -> DataFrame:
    """Frames with the purpose (and fold) that they are read for."""
    return frames.withColumn("purpose", F.lit(purpose)).withColumn("fold", F.lit(fold))


def require_purpose(frames: DataFrame, purpose: str) -> DataFrame:
    """The frames, or an error where one was read for another purpose."""
    wrong = F.col("purpose").isNull() | (F.col("purpose") != purpose)
    return frames.withColumn("purpose", F.when(wrong, F.raise_error(F.lit(f"frames must be read for {purpose}")).cast("string")).otherwise(F.col("purpose")))


def training_scenarios(groups: DataFrame, wanted: list[str], test_group: str) -> DataFrame:
    """Scenarios of the wanted groups (scenario, group); raises if the test group is among them."""
    if test_group in wanted:
        raise ValueError("the test group may not train")
    return groups.where(F.col("group").isin(wanted)).select("scenario").distinct()
