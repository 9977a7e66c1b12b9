"""Criteria and decisions on exact fractions.

A fold's row holds numerators over one common denominator for each metric, so
every comparison with a limit is a comparison of values rounded half-even to
nine places (``q9``), kept as integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions.scalars import q9

#: Limits in units of 1e-9 (fixed values).
BAND, C1_PASS, C1_FAIL, C2_LEAST, SHARE_PASS, SHARE_FAIL = 20_000_000, 800_000_000, 950_000_000, 60_000_000, 500_000_000, 200_000_000
CONTROLS = ("V2", "REV", "LAG")
#: Outcomes by falling severity (fixed values).
SEVERITY = ("G", "M", "F", "D", "E", "C", "I", "A")


def validity(collapse: Column, motion: Column, saturated: Column) -> Column:
    return F.when(collapse, "collapse").when(motion, "motion").when(saturated, "saturated").otherwise("valid")


def band(gain9: Column) -> Column:
    return F.when(gain9 <= -BAND, "harm").when(gain9 >= BAND, "positive").otherwise("null")


def control_status(share9: Column, margin9: Column) -> Column:
    """Of a control's share of the gain and its margin; defined where the gain is positive."""
    return F.when(share9 <= SHARE_FAIL, "fail").when((share9 >= SHARE_PASS) & (margin9 >= BAND), "pass").otherwise("between")


def all_controls(statuses: list[Column]) -> Column:
    failed, passed = F.lit(False), F.lit(True)
    for s in statuses:
        failed, passed = failed | (s == "fail"), passed & (s == "pass")
    return F.when(failed, "fail").when(passed, "pass").otherwise("between")


def rate_criterion(a9: Column, a_censored: Column, b9: Column, b_censored: Column, ratio9: Column) -> Column:
    """Alarm-rate criterion of a (before) and b (after)."""
    return F.when((a9 == 0) & (b9 == 0), "nonevaluable").when(a9 == 0, "fail").when(a_censored & b_censored, "nonevaluable").when(ratio9 <= C1_PASS, "pass").when(ratio9 > C1_FAIL, "fail").otherwise("between")


def fold_criteria(rows: DataFrame) -> DataFrame:
    """Adds the criteria of one fold.

    Needs collapse, motion, saturated; P3_<v> for V1, V4 and the controls over
    P3_den; P2_V1, P2_V4 over P2_den; P1_<v>_num, P1_<v>_den, P1_<v>_censored
    for V1, V4; lb9 (lower bound in units of 1e-9).  All rounded values are
    computed once, in one projection.
    """
    c = F.col
    gain = c("P3_V4") - c("P3_V1")
    a_num, a_den, b_num, b_den = (c(f"P1_{v}_{x}") for v in ("V1", "V4") for x in ("num", "den"))
    values = {
        "gain9": q9(gain, c("P3_den")),
        "a9": q9(a_num, a_den),
        "b9": q9(b_num, b_den),
        "ratio9": q9(b_num * a_den, b_den * F.when(a_num != 0, a_num)),
        "d2": q9(c("P2_V4") - c("P2_V1"), c("P2_den")),
        "d1": q9(a_num * b_den - b_num * a_den, a_den * b_den),
    }
    for v in CONTROLS:
        margin = c("P3_V4") - c(f"P3_{v}")
        values |= {f"margin9_{v}": q9(margin, c("P3_den")), f"share9_{v}": q9(margin, F.when(gain != 0, gain))}
    rows = rows.withColumns(values).withColumn("band", band(c("gain9")))
    statuses = [control_status(c(f"share9_{v}"), c(f"margin9_{v}")) for v in CONTROLS]
    made = {
        "valid": validity(c("collapse"), c("motion"), c("saturated")),
        "c4": F.when(c("band") == "positive", all_controls(statuses)),
        "c1": rate_criterion(c("a9"), c("P1_V1_censored"), c("b9"), c("P1_V4_censored"), c("ratio9")),
        "c2": c("d2") >= C2_LEAST,
        "sign_p3": F.signum("gain9").cast("int"),
        "sign_p2": F.signum("d2").cast("int"),
        "sign_p1": F.signum("d1").cast("int"),
        "lb_positive": c("lb9") > 0,
    }
    return rows.withColumns(made)


def decide(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds the outcome of two folds given as structs of ``fold_criteria`` columns."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    both = lambda c, v: (x(c) == v) & (y(c) == v)
    either = lambda c, v: (x(c) == v) | (y(c) == v)
    invalid = (x("valid") != "valid").cast("int") + (y("valid") != "valid").cast("int")
    opposite = lambda c: x(c) * y(c) == -1
    rated = (x("c1") != "nonevaluable") & (y("c1") != "nonevaluable")
    agree = ~(opposite("sign_p3") | opposite("sign_p2") | (rated & opposite("sign_p1")))
    c3 = both("band", "positive") & (x("lb_positive") | y("lb_positive"))
    c4 = both("band", "positive") & F.coalesce(both("c4", "pass"), F.lit(False))
    failed = F.coalesce((x("band") == "positive") & (x("c4") == "fail"), F.lit(False)) | F.coalesce((y("band") == "positive") & (y("c4") == "fail"), F.lit(False))
    outcome = (
        F.when((invalid == 2) & either("valid", "collapse"), "G")
        .when((invalid == 2) & either("valid", "motion"), "M")
        .when(invalid == 2, "F")
        .when(invalid == 1, "Bstar")
        .when(either("band", "harm"), "D")
        .when(both("band", "null"), "C")
        .when(failed, "E")
        .when(c3 & c4 & agree & (both("c1", "pass") | (x("c2") & y("c2"))), "A")
        .otherwise("B")
    )
    return pairs.withColumn("outcome", outcome)


def severity(outcome: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITY)), F.when(outcome.isin("B", "Bstar"), "I").otherwise(outcome))


def final(first: Column, second: Column, third: Column) -> Column:
    """Outcome over three seeds: the first one's if it is final, else the most severe."""
    worst = F.element_at(F.array(*map(F.lit, SEVERITY)), F.least(severity(first), severity(second), severity(third)).cast("int"))
    return F.when(first.isin("A", "B", "Bstar"), worst).otherwise(first)


def oracle_share9(rows: DataFrame) -> DataFrame:
    """Adds the share of the gain that exact motion would add: (P3 of ORA - P3 of V4) / gain, null without a gain."""
    gain = F.col("P3_V4") - F.col("P3_V1")
    return rows.withColumn("oracle_share9", F.when(q9(gain, F.col("P3_den")) >= BAND, q9(F.col("P3_ORA") - F.col("P3_V4"), F.when(gain != 0, gain))))


def grid(signatures: DataFrame, columns: list[str]) -> DataFrame:
    """Outcome counts over all ordered pairs of fold states.

    States are first counted by their criteria, a few thousand signatures
    whatever the number of states, and pairs of signatures are weighed by the
    product of their counts.
    """
    by = signatures.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    one = by.select(F.struct(*columns).alias("a"), F.col("n").alias("na"))
    two = by.select(F.struct(*columns).alias("b"), F.col("n").alias("nb"))
    pairs = one.repartition(F.col("a")).join(F.broadcast(two))  # bounded by the number of distinct criteria
    return decide(pairs).groupBy("outcome").agg(F.sum(F.col("na") * F.col("nb")).alias("n"))
