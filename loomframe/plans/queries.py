"""One query for each operator over the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.functions import scalars as S
from loomframe.operators import bank, decision, events, inference, intervals, metrics, motion, synth, temporal, vectors
from loomframe.plans import pilot
from loomframe.plans.sql import with_parts
from loomframe.session import durable
from loomframe.sources import files
from loomframe.sources import timeline as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TAU = 30.0


def query(parts: str = "", sql: str | None = None, **instead: tuple[str, str]):
    """Register a query and, where SQL can express it, the SQL; ``instead`` replaces expressions of the SQL's parts."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_parts(parts, sql, **instead) if parts else sql
        return f

    return add


def lengths(frames: DataFrame) -> DataFrame:
    return frames.select("scenario", "frame", F.least(F.lit(7), "frame").alias("K"))


def windows(frames: DataFrame) -> DataFrame:
    return intervals.windows(T.passes(frames), lengths(frames))


def layout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Frames with the normal set and segments, and the windows."""
    frames = T.timeline(spark, sf_dir)
    w = windows(frames)
    return intervals.normal_set(frames, w), w


def kept_layout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The layout written once, for plans that read it several times."""
    frames = T.timeline(spark, sf_dir)
    w = durable(windows(frames), "windows")
    return durable(intervals.normal_set(frames, w), "frames"), w


# -- sources, filters, projections


@query("timeline", "SELECT scenario, count(*) AS n, min(frame) = 1 AND max(frame) = count(*) AND count(DISTINCT frame) = count(*) AS contiguous FROM timeline GROUP BY scenario")
def src_label_scan(spark, sf_dir):
    frames = T.timeline(spark, sf_dir)
    raw = frames.select("scenario", F.format_string(" img_%05d.png ", "frame").alias(" FileName"), F.concat(F.lit(" "), F.col("label").cast("string")).alias("Label "))
    return T.contiguity(T.parse_labels(raw))


@query("passes", "SELECT scenario, ordinal, s, e, track FROM passes")
def src_passes(spark, sf_dir):
    return T.passes(T.timeline(spark, sf_dir))


@query("", """SELECT n.n_name AS scenario, r.r_name AS "group" FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey""")
def src_group_map(spark, sf_dir):
    region = T.table(spark, sf_dir, "region")
    clusters = T.table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return T.group_map(clusters, "n_name", "r_name")


@query("", """WITH bank AS (SELECT n_regionkey AS fold, n_name AS scenario, n_nationkey AS frame, CASE WHEN n_nationkey % 7 = 0 THEN 'x' ELSE 'g' || n_regionkey END AS grp FROM nation)
SELECT 'group' AS problem, fold, scenario FROM bank WHERE grp <> 'g' || fold
UNION ALL SELECT 'quota', fold, scenario FROM bank WHERE frame % 5 = 0""")
def src_bank_record(spark, sf_dir):
    nation = T.table(spark, sf_dir, "nation")
    own = F.concat(F.lit("g"), F.col("n_regionkey").cast("string"))
    rows = nation.select(F.col("n_regionkey").alias("fold"), F.col("n_name").alias("scenario"), F.col("n_nationkey").alias("frame"), F.when(F.col("n_nationkey") % 7 == 0, "x").otherwise(own).alias("group"))
    groups = nation.select(F.col("n_name").alias("scenario"), own.alias("group"))
    quotas = nation.select(F.col("n_regionkey").alias("fold"), F.col("n_name").alias("scenario"), F.when(F.col("n_nationkey") % 5 == 0, 2).otherwise(1).alias("quota"))
    return files.bank_problems(rows, quotas, groups)


@query("timeline", "SELECT scenario, frame FROM timeline WHERE label >= 3 OR (scenario = 1 AND frame BETWEEN 100 AND 140) OR (scenario = 3 AND frame BETWEEN 7 AND 9)")
def fil_defect_frames(spark, sf_dir):
    over = spark.createDataFrame([(1, 100, 140), (3, 7, 9)], "scenario int, lo int, hi int")
    return T.defect_frames(T.timeline(spark, sf_dir), over)


@query("timeline", """SELECT t.scenario, t.frame FROM timeline t WHERE t.label IN (1, 2) AND (t.scenario = 2 OR NOT EXISTS (
SELECT 1 FROM timeline d WHERE d.scenario = t.scenario AND d.label >= 3 AND abs(t.frame - d.frame) <= 5 + t.scenario))""")
def fil_eligible(spark, sf_dir):
    frames = T.timeline(spark, sf_dir)
    margin = F.when(F.col("scenario") == 2, F.lit(None).cast("int")).otherwise(5 + F.col("scenario"))
    return intervals.eligible(frames, T.defect_frames(frames), margin).select("scenario", "frame")


@query("frames", "SELECT scenario, frame, normal, seg FROM frames")
def fil_normal_set(spark, sf_dir):
    return layout(spark, sf_dir)[0].select("scenario", "frame", "normal", "seg")


@query("frames", f"SELECT scenario, frame, score FROM frames WHERE normal AND score >= {TAU}")
def fil_alarms(spark, sf_dir):
    return events.alarms(layout(spark, sf_dir)[0], TAU).select("scenario", "frame", "score")


@query("", """SELECT 'validation' AS purpose, l.quality AS fold, d.source AS scenario, d.doc_id AS frame FROM documents d JOIN labels l USING (doc_id)
WHERE NOT (d.source IN ('src1', 'src2') OR (d.source = 'src0' AND d.doc_id % 3 = 0 AND l.quality = 1))""")
def fil_purpose_gate(spark, sf_dir):
    docs, labels = T.table(spark, sf_dir, "documents").select("doc_id", "source"), T.table(spark, sf_dir, "labels")
    reads = docs.join(labels, "doc_id").select(F.lit("validation").alias("purpose"), F.col("quality").alias("fold"), F.col("source").alias("scenario"), F.col("doc_id").alias("frame"))
    whole = spark.createDataFrame([("validation", f, s) for f in (0, 1) for s in ("src1", "src2")], "purpose string, fold int, scenario string").withColumn("frame", F.lit(None).cast("long"))
    single = docs.where("source = 'src0' and doc_id % 3 = 0").select(F.lit("validation").alias("purpose"), F.lit(1).alias("fold"), F.col("source").alias("scenario"), F.col("doc_id").alias("frame"))
    return T.purpose_gate(reads, whole.unionByName(single))


@query("", "SELECT 'validation' AS purpose, l.quality AS fold, d.source AS scenario, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY l.quality, d.source")
def fil_read_audit(spark, sf_dir):
    docs, labels = T.table(spark, sf_dir, "documents").select("doc_id", "source"), T.table(spark, sf_dir, "labels")
    return T.read_summary(docs.join(labels, "doc_id").select(F.lit("validation").alias("purpose"), F.col("quality").alias("fold"), F.col("source").alias("scenario")))


@query("", """SELECT s.n_name AS scenario, s.n_regionkey IN (1, 2) AS training, s.n_regionkey = 3 AS test FROM nation s WHERE s.n_regionkey IN (1, 2, 3)""")
def fil_roles(spark, sf_dir):
    groups = T.table(spark, sf_dir, "nation").select(F.col("n_name").alias("scenario"), F.col("n_regionkey").cast("string").alias("group"))
    return T.roles(groups, ["1", "2"], "3")


@query("timeline", "SELECT scenario, frame, score FROM timeline")
def fil_finite_scores(spark, sf_dir):
    return T.timeline(spark, sf_dir).select("scenario", "frame", T.finite(F.col("score")).alias("score"))


@query("cells", """SELECT frame, "row", col, round((floor(abs(value) * 1000) % 256 / 255.0::DOUBLE - 0.485::DOUBLE) / 0.229::DOUBLE, 9) AS c0, round((floor(abs(value) * 1000) % 256 / 255.0::DOUBLE - 0.406::DOUBLE) / 0.225::DOUBLE, 9) AS c2 FROM cells""")
def prj_normalise_pixels(spark, sf_dir):
    px = maps(spark, sf_dir).withColumn("p", F.transform("map", lambda x: F.pmod(F.floor(F.abs(x.cast("double")) * 1000), F.lit(256))))
    out = px.withColumn("c", vectors.normalise_pixels(F.col("p"), [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]))
    out = out.select("frame", F.posexplode(F.arrays_zip(F.element_at("c", 1).alias("x"), F.element_at("c", 3).alias("z"))).alias("i", "v"))
    return out.select("frame", F.floor(F.col("i") / 8).cast("int").alias("row"), F.pmod("i", F.lit(8)).alias("col"), F.round("v.x", 9).alias("c0"), F.round("v.z", 9).alias("c2"))


@query("cells", 'SELECT frame, CAST("row" // 4 AS INTEGER) AS "row", CAST(col // 4 AS INTEGER) AS col, round(avg(value), 9) AS value FROM cells GROUP BY ALL')
def prj_block_mean(spark, sf_dir):
    out = temporal.block_mean(temporal.cells_of(maps(spark, sf_dir), 8, ["frame"]), 4, ["frame"])
    return out.withColumn("value", F.round("value", 9))


@query("", "SELECT event_id, event_id // 80 AS bank_frame, CAST(event_id % 80 // 10 AS INTEGER) AS \"row\", CAST(event_id % 10 AS INTEGER) AS col FROM events")
def prj_index_to_source(spark, sf_dir):
    return T.table(spark, sf_dir, "events").select("event_id", *vectors.index_to_source(F.col("event_id"), 80, 10))


# -- intervals and windows


@query("windows", "SELECT scenario, ordinal, track, s, e, lo, hi, carry FROM windows")
def win_pass_windows(spark, sf_dir):
    return intervals.assert_disjoint(windows(T.timeline(spark, sf_dir))).select("scenario", "ordinal", "track", "s", "e", "lo", "hi", "carry")


@query("windows", "SELECT scenario, s, e AS hi FROM windows")
def spc_no_grace(spark, sf_dir):
    frames = T.timeline(spark, sf_dir)
    return intervals.windows(T.passes(frames), lengths(frames).withColumn("K", F.lit(1)), grace=0).select("scenario", "s", "hi")


@query("held", "SELECT scenario, frame, win AS s, track FROM held WHERE win IS NOT NULL")
def joi_interval(spark, sf_dir):
    frames = T.timeline(spark, sf_dir)
    return intervals.in_window(frames, windows(frames), "s", "track").where("s is not null").select("scenario", "frame", "s", "track")


def period():
    """Frames of a turn of each scenario."""
    return 300 + 20 * F.col("scenario")


def phased(spark, sf_dir, frames: DataFrame | None = None) -> DataFrame:
    frames = layout(spark, sf_dir)[0] if frames is None else frames
    return intervals.blocks(intervals.phases(frames, intervals.anchors(frames, period()), period()))


@query("chosen", "SELECT scenario, a AS anchor FROM chosen WHERE taken")
def win_anchors(spark, sf_dir):
    return intervals.anchors(T.timeline(spark, sf_dir), period())


@query("phased", "SELECT scenario, frame, CAST(phase AS INTEGER) AS phase, CAST(phase // 50 AS INTEGER) AS phase_bin, CAST((frame - 1) // 1200 AS INTEGER) AS block FROM phased")
def win_phases(spark, sf_dir):
    return phased(spark, sf_dir).select("scenario", "frame", "phase", "phase_bin", "block")


@query("phased frames", """SELECT CAST(unit AS INTEGER) AS unit, CAST(sum(normal::INT) AS BIGINT) AS n FROM (SELECT p.scenario, p.frame, dense_rank() OVER (ORDER BY p.scenario, p.phase // 50) - 1 AS unit, f.normal
FROM phased p JOIN frames f USING (scenario, frame)) GROUP BY unit""")
def agg_unit_sizes(spark, sf_dir):
    return intervals.unit_sizes(intervals.dense_units(phased(spark, sf_dir), "phase_bin", "unit"), "unit")


@query("frames windows", """SELECT (SELECT count(*) FROM frames) AS frames, (SELECT count(*) FROM frames WHERE normal) AS normal, (SELECT count(*) FROM windows) AS passes,
(SELECT count(DISTINCT track) FROM windows) AS tracks, (SELECT count(*) FROM windows WHERE carry) AS carry""")
def agg_fold_statistics(spark, sf_dir):
    return intervals.fold_statistics(*kept_layout(spark, sf_dir))


@query("timeline", "SELECT scenario, n, CAST(sum(n) OVER (ORDER BY scenario) - n AS BIGINT) AS start FROM (SELECT scenario, count(*) AS n FROM timeline GROUP BY scenario)")
def win_offsets(spark, sf_dir):
    return intervals.offsets(T.timeline(spark, sf_dir))


@query("timeline", "SELECT scenario, frame, score FROM timeline WHERE frame <= 30")
def srt_limit(spark, sf_dir):
    return T.capped(T.timeline(spark, sf_dir), 30).select("scenario", "frame", "score")


@query("frames spans", """, before AS (SELECT s.scenario, s.N, CAST(coalesce((SELECT sum(x.N + 4) FROM spans x WHERE x.scenario < s.scenario), 0) AS BIGINT) AS b FROM spans s)
SELECT b + f.frame AS position, f.scenario, f.frame, f.normal FROM frames f JOIN before USING (scenario)
UNION ALL SELECT b + N + g, NULL, 0, false FROM before, range(1, 5) AS r(g)""")
def gen_layout(spark, sf_dir):
    return intervals.concatenated(layout(spark, sf_dir)[0])


# -- motion


@query("consistent", "SELECT scenario, frame, consistent FROM consistent")
def win_consistency(spark, sf_dir):
    return motion.consistency(T.timeline(spark, sf_dir)).select("scenario", "frame", "consistent")


@query("consistent", """SELECT g, CAST(count(*) FILTER (WHERE r >= g / 100.0::DOUBLE) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE r >= g / 100.0::DOUBLE AND consistent) AS BIGINT) AS consistent
FROM consistent, (SELECT CAST(i AS INTEGER) AS g FROM range(0, 101) AS x(i)) GROUP BY g""")
def agg_threshold_counts(spark, sf_dir):
    return motion.threshold_counts(motion.consistency(T.timeline(spark, sf_dir)))


@query("sum_flags", """SELECT min(g) AS tau_step FROM (SELECT CAST(i AS INTEGER) AS g, count(*) FILTER (WHERE r >= i / 100.0::DOUBLE) AS n, count(*) FILTER (WHERE r >= i / 100.0::DOUBLE AND consistent) AS c
FROM sum_flags, range(0, 101) AS x(i) GROUP BY i) WHERE n >= 1000 AND 100 * c >= 95 * n""")
def agg_least_threshold(spark, sf_dir):
    return motion.least_threshold(motion.threshold_counts(motion.sum_consistency(T.timeline(spark, sf_dir))))


@query("sum_flags", "SELECT scenario, frame, s2, consistent FROM sum_flags")
def win_sum_consistency(spark, sf_dir):
    return motion.sum_consistency(T.timeline(spark, sf_dir)).select("scenario", "frame", "s2", "consistent")


def moved(spark, sf_dir) -> DataFrame:
    return motion.window_lengths(motion.statuses(T.timeline(spark, sf_dir), 0.4))


@query("walk", "SELECT scenario, frame, status, dx_used FROM walk")
def win_statuses(spark, sf_dir):
    return motion.statuses(T.timeline(spark, sf_dir), 0.4)


@query("walk_sum", "SELECT scenario, frame, status, dx_used FROM walk_sum")
def win_sum_statuses(spark, sf_dir):
    return motion.statuses(T.timeline(spark, sf_dir), 0.2, sums=True)


@query("walk", "SELECT scenario, status, count(*) AS n FROM walk GROUP BY scenario, status")
def agg_status_counts(spark, sf_dir):
    return motion.statuses(T.timeline(spark, sf_dir), 0.4).groupBy("scenario", "status").agg(F.count(F.lit(1)).alias("n"))


@query("moved", 'SELECT scenario, frame, k_full, "K" AS k_used FROM moved')
def win_adaptive_length(spark, sf_dir):
    return moved(spark, sf_dir).select("scenario", "frame", "k_full", F.col("K").alias("k_used"))


@query("oracled", "SELECT scenario, frame, dx_oracle FROM oracled")
def win_oracle_dx(spark, sf_dir):
    return motion.oracle_dx(motion.statuses(T.timeline(spark, sf_dir), 0.4)).select("scenario", "frame", "dx_oracle")


MU_SQL = """SELECT m.scenario, m.frame, m."K" >= 2 AND EXISTS (SELECT 1 FROM walk u WHERE u.scenario = m.scenario AND u.status = 0
AND u.frame BETWEEN greatest(1, m.frame - m."K" + 2) AND m.frame) AS mu FROM moved m"""


@query("moved walk", MU_SQL)
def win_motion_unknown(spark, sf_dir):
    return motion.motion_unknown(moved(spark, sf_dir), F.col("status") != motion.UNKNOWN).select("scenario", "frame", "mu")


@query("moved walk", f"SELECT scenario, count(*) AS n, count(*) FILTER (WHERE mu) AS unknown, 100 * count(*) FILTER (WHERE mu) > 5 * count(*) AS invalid FROM ({MU_SQL}) GROUP BY scenario")
def agg_motion_invalid(spark, sf_dir):
    return motion.invalid(motion.motion_unknown(moved(spark, sf_dir), F.col("status") != motion.UNKNOWN), True, ["scenario"])


@query("timeline", "SELECT scenario, count(*) FILTER (WHERE frame > 1 AND NOT has_est) AS n FROM timeline GROUP BY scenario")
def agg_without_estimate(spark, sf_dir):
    return motion.without_estimate(T.timeline(spark, sf_dir))


@query("timeline lengths", """SELECT l.scenario, l.frame, i, CAST(CASE WHEN i = 0 THEN 0 ELSE floor(-(SELECT sum(t.dx / 8 ORDER BY t.frame) FROM timeline t WHERE t.scenario = l.scenario AND t.frame BETWEEN l.frame - i + 1 AND l.frame) + 0.5::DOUBLE) END AS BIGINT) AS u
FROM lengths l, range(0, 7) AS g(i) WHERE i < l.K""")
def win_shifts(spark, sf_dir):
    rows = motion.shifts(T.timeline(spark, sf_dir).withColumn("K", F.least(F.lit(7), "frame")), "dx")
    return rows.select("scenario", "frame", F.posexplode("U").alias("i", "u")).withColumn("i", F.col("i").cast("long"))


@query("", """SELECT k, i, CASE WHEN i = 0 OR k <= 2 THEN i ELSE i % (k - 1) + 1 END AS source FROM range(1, 26) AS a(k), range(0, 25) AS b(i) WHERE i < k""")
def arr_lag_order(spark, sf_dir):
    ks = spark.range(1, 26).withColumnRenamed("id", "k")
    return ks.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).select("k", "i", S.lag_source(F.col("i"), F.col("k")).alias("source"))


# -- events and metrics


RUNS_SQL = f"""SELECT scenario, min(frame) AS a, max(frame) AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY scenario ORDER BY frame) AS run FROM (
SELECT scenario, frame, CASE WHEN frame - lag(frame) OVER w <= 3 AND seg = lag(seg) OVER w THEN 0 ELSE 1 END AS opens FROM frames WHERE normal AND score >= {TAU}
WINDOW w AS (PARTITION BY scenario ORDER BY frame))) GROUP BY scenario, run"""


@query("frames", f"SELECT scenario, count(*) AS n_runs, CAST(sum((b - a + 25) // 25) AS BIGINT) AS n_events FROM ({RUNS_SQL}) GROUP BY scenario")
def agg_events_at(spark, sf_dir):
    runs = events.runs_at(layout(spark, sf_dir)[0], TAU)
    return runs.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_runs"), F.sum(events.events_of(runs)).alias("n_events"))


@query("frames", f"SELECT scenario, CAST(c AS INTEGER) AS frame FROM (SELECT scenario, unnest(range(a, b + 1, 25)) AS c FROM ({RUNS_SQL}))")
def agg_event_starts(spark, sf_dir):
    return events.chunks_of(events.runs_at(layout(spark, sf_dir)[0], TAU)).select("scenario", "frame")


@query("counted frames", "SELECT tau, C FROM counted WHERE tau IN (SELECT score FROM frames WHERE normal)")
def agg_count_curve(spark, sf_dir):
    return events.curve(events.steps(layout(spark, sf_dir)[0]))


@query("counted frames", "SELECT tau, U AS C FROM counted WHERE tau IN (SELECT score FROM frames WHERE normal)")
def spc_uncapped_curve(spark, sf_dir):
    frames = layout(spark, sf_dir)[0]
    # the steps lie at scores where a run opens or closes; between them the count stays
    got = events.uncapped_steps(frames).unionByName(frames.where("normal").select(F.col("score").alias("tau"), F.lit(0).cast("long").alias("delta")).distinct()).groupBy("tau").agg(F.sum("delta").alias("delta"))
    return events.curve(got)


UNIT_SQL = """, starts_ AS (SELECT r.scenario, r.seg, r.tau, p.phase // 50 AS bin, count(*) AS n FROM (SELECT scenario, seg, tau, unnest(range(a, b + 1, 25)) AS frame FROM seg_runs) r
  JOIN phased p ON p.scenario = r.scenario AND p.frame = r.frame GROUP BY ALL),
filled AS (SELECT t.scenario, t.seg, t.tau, u.bin, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT scenario, seg, tau FROM seg_runs) t JOIN (SELECT DISTINCT scenario, seg, bin FROM starts_) u ON u.scenario = t.scenario AND u.seg = t.seg
  LEFT JOIN starts_ s ON s.scenario = t.scenario AND s.seg = t.seg AND s.tau = t.tau AND s.bin = u.bin),
unit_deltas AS (SELECT CAST(scenario * 100 + bin AS INTEGER) AS unit, tau, CAST(sum(d) AS BIGINT) AS d FROM (SELECT *, n - lag(n, 1, 0) OVER (PARTITION BY scenario, seg, bin ORDER BY tau DESC) AS d FROM filled) GROUP BY ALL HAVING sum(d) <> 0)"""


@query("seg_runs phased", UNIT_SQL + " SELECT unit, tau, CAST(sum(d) OVER (PARTITION BY unit ORDER BY tau DESC) AS BIGINT) AS n FROM unit_deltas")
def agg_unit_curve(spark, sf_dir):
    """The events of each unit at every threshold where their number changes."""
    rows = phased(spark, sf_dir).withColumn("unit", (F.col("scenario") * 100 + F.col("phase_bin")).cast("int"))
    return events.curve(events.steps(rows, unit="unit").where("delta != 0"), unit="unit").withColumnRenamed("C", "n")


@query("qs", "SELECT scenario, win AS s, track, q FROM qs")
def agg_pass_scores(spark, sf_dir):
    frames, w = layout(spark, sf_dir)
    return metrics.pass_scores(frames, w)


@query("zs", "SELECT track, z FROM zs")
def agg_track_scores(spark, sf_dir):
    frames, w = layout(spark, sf_dir)
    return metrics.track_scores(metrics.pass_scores(frames, w))


def curve_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    frames, w = kept_layout(spark, sf_dir)
    return metrics.metric_curve(events.steps(frames), metrics.pass_scores(frames, w)), metrics.sizes(frames, w)


@query("curve", "SELECT j, tau, C, E, detp, dett FROM curve")
def met_curve(spark, sf_dir):
    return curve_of(spark, sf_dir)[0].drop("next_E")


METRICS_SQL = """SELECT CAST(CASE WHEN 1000 * a.E > 50 * t.nN THEN 50 * t.nN ELSE 1000 * a.E END AS BIGINT) AS P1_num, t.nN AS P1_den, 1000 * a.E > 50 * t.nN AS P1_censored,
b.dett AS P2_num, t.nK AS P2_den, (SELECT CAST(sum(CASE WHEN 100 * E > nN THEN 0 WHEN 100 * nextE <= nN THEN detp * 1000 * (nextE - E) ELSE detp * (10 * nN - 1000 * E) END) AS BIGINT) FROM rates) AS P3_num,
10 * t.nP * t.nN AS P3_den, 20 * b.detp >= 19 * t.nP AS saturated
FROM total t, (SELECT * FROM rates WHERE 5 * detp >= 4 * nP ORDER BY j LIMIT 1) a, (SELECT * FROM rates WHERE 1000 * E <= 2 * nN ORDER BY j DESC LIMIT 1) b"""


@query("rates", METRICS_SQL)
def met_all(spark, sf_dir):
    return metrics.metrics(*curve_of(spark, sf_dir))


@query("rates", f"""SELECT P3_num // g || '/' || P3_den // g AS p3, CAST(CASE WHEN r * 2 > P3_den OR (r * 2 = P3_den AND w % 2 = 1) THEN w + 1 ELSE w END AS BIGINT) AS p3_q9, CAST(sign(P3_num) AS INTEGER) AS sign FROM (
SELECT *, gcd(P3_num, P3_den) AS g, (P3_num::HUGEINT * 1000000000) // P3_den AS w, (P3_num::HUGEINT * 1000000000) % P3_den AS r FROM ({METRICS_SQL}))""")
def sca_exact_text(spark, sf_dir):
    m = metrics.metrics(*curve_of(spark, sf_dir))
    return m.select(S.fraction_text(F.col("P3_num"), F.col("P3_den")).alias("p3"), S.q9(F.col("P3_num"), F.col("P3_den")).alias("p3_q9"), S.sign9(F.col("P3_num"), F.col("P3_den")).alias("sign"))


@query("counted frames total", """SELECT min(tau) AS threshold, max(E) AS events FROM (SELECT tau, max(C) OVER (ORDER BY tau DESC) AS E FROM counted
WHERE tau = 'Infinity'::DOUBLE OR tau IN (SELECT score FROM frames WHERE normal)), total WHERE 1000 * E <= 2 * nN""")
def met_deployment(spark, sf_dir):
    frames = durable(layout(spark, sf_dir)[0], "frames")
    return metrics.deployment_threshold(events.steps(frames), frames.agg(F.sum(F.col("normal").cast("long")).alias("n")))


RANKING_SQL = """SELECT round((SELECT sum(hits * (2 * (n - fp) + misses)) / (2.0::DOUBLE * any_value(p) * any_value(n)) FROM b), 9) AS auroc,
round((SELECT sum(hits / p::DOUBLE * tp / (tp + fp)::DOUBLE) FROM b), 9) AS auprc FROM (SELECT 1)"""


@query("timeline", """, a AS (SELECT score, count(*) FILTER (WHERE label >= 3) AS hits, count(*) FILTER (WHERE label < 3) AS misses FROM timeline GROUP BY score),
b AS (SELECT *, (SELECT sum(x.hits) FROM a x WHERE x.score >= a.score) AS tp, (SELECT sum(x.misses) FROM a x WHERE x.score >= a.score) AS fp, (SELECT sum(hits) FROM a) AS p, (SELECT sum(misses) FROM a) AS n FROM a WHERE hits > 0)
""" + RANKING_SQL)
def spc_ranking_quality(spark, sf_dir):
    got = metrics.ranking_quality(T.timeline(spark, sf_dir).withColumn("positive", F.col("label") >= 3))
    return got.select(F.round("auroc", 9).alias("auroc"), F.round("auprc", 9).alias("auprc"))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 maps: one scenario, frames in order of vec_id."""
    return T.table(spark, sf_dir, "embeddings").select(F.lit(0).alias("scenario"), (F.col("vec_id") + 1).cast("int").alias("frame"), F.col("embedding").alias("map"))


def as_cells(spark, sf_dir) -> DataFrame:
    return temporal.cells_of(maps(spark, sf_dir), 8, ["frame"])


# -- variants: K = least(7, frame), one cell of motion a frame and the other way for the oracle


def variant_rows(spark, sf_dir) -> DataFrame:
    rows = maps(spark, sf_dir).withColumn("K", F.least(F.lit(7), "frame")).withColumn("dx", (-8.0 * (1 + F.pmod("frame", F.lit(2)))).cast("double"))
    rows = motion.shifts(rows, "dx").withColumn("mu", F.pmod("frame", F.lit(50)) == 0)
    oracle = motion.shifts(rows.select("scenario", "frame", "K", F.lit(-8.0).alias("dx")), "dx").select("scenario", "frame", F.col("U").alias("U_oracle"))
    return rows.join(oracle, ["scenario", "frame"]).withColumn("mu_oracle", F.col("frame") < 3)


VARIANT_SQL = """, plan AS (
  SELECT f.frame, i, least(7, f.frame) AS "K", f.frame % 50 = 0 AS mu, f.frame < 3 AS mo,
    CASE WHEN i = 0 THEN 0 ELSE (SELECT sum(1 + j % 2) FROM range(f.frame - i + 1, f.frame + 1) AS r(j)) END AS u
  FROM (SELECT DISTINCT frame FROM cells) f, range(0, 7) AS g(i) WHERE i < least(7, f.frame)),
terms AS (
  SELECT frame, 'V2' AS variant, frame - i AS src, 0 AS shift, "K" FROM plan
  UNION ALL SELECT frame, 'V4', frame - i, CASE WHEN mu THEN 0 ELSE u END, "K" FROM plan
  UNION ALL SELECT frame, 'REV', frame - i, CASE WHEN mu THEN 0 ELSE -u END, "K" FROM plan
  UNION ALL SELECT frame, 'LAG', frame - CASE WHEN mu OR i = 0 OR "K" <= 2 THEN i ELSE i % ("K" - 1) + 1 END, CASE WHEN mu THEN 0 ELSE u END, "K" FROM plan
  UNION ALL SELECT frame, 'ORA', frame - i, CASE WHEN mo THEN 0 ELSE i END, "K" FROM plan),
summed AS (
  SELECT t.frame, t.variant, g."row", g.col, CAST(sum(coalesce(c.value, 0.25::DOUBLE)) / any_value(t."K") AS FLOAT) AS v
  FROM terms t, (SELECT r AS "row", c AS col FROM range(0, 8) AS a(r), range(0, 8) AS b(c)) g
  LEFT JOIN cells c ON c.frame = t.src AND c."row" = g."row" AND c.col = g.col + t.shift AND g.col + t.shift BETWEEN 0 AND 7
  GROUP BY t.frame, t.variant, g."row", g.col),
peaks AS (SELECT frame, max(value) AS s FROM cells GROUP BY frame)
SELECT 0 AS scenario, CAST(frame AS INTEGER) AS frame, variant, round(score, 6) AS score FROM (
  SELECT frame, variant, CAST(max(v) AS DOUBLE) AS score FROM summed GROUP BY frame, variant
  UNION ALL SELECT frame, 'V0', s FROM peaks
  UNION ALL SELECT p.frame, 'V1', (SELECT sum(q.s) FROM peaks q WHERE q.frame BETWEEN p.frame - least(7, p.frame) + 1 AND p.frame) / least(7, p.frame) FROM peaks p)"""


@query("cells", VARIANT_SQL)
def arr_variants(spark, sf_dir):
    got = temporal.variants(variant_rows(spark, sf_dir), 8, 8, 0.25)
    return got.withColumn("score", F.round("score", 6))


@query("cells", VARIANT_SQL.split("summed AS", 1)[0].rstrip(",\n") + "\nSELECT 0 AS scenario, CAST(t.frame AS INTEGER) AS frame, variant, CAST(count(*) AS BIGINT) AS n, CAST(sum(src * 31 + shift) AS BIGINT) AS h FROM terms t WHERE variant IN ('V4', 'REV', 'LAG') AND frame % 50 <> 0 GROUP BY t.frame, variant")
def arr_terms(spark, sf_dir):
    got = temporal.terms(variant_rows(spark, sf_dir).where("not mu"))
    return got.groupBy("scenario", "frame", "variant").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("src") * 31 + F.col("shift")).alias("h"))


@query("lengths timeline", "SELECT l.scenario, l.frame, round((SELECT sum(t.score) FROM timeline t WHERE t.scenario = l.scenario AND t.frame BETWEEN l.frame - l.K + 1 AND l.frame) / l.K, 6) AS v1 FROM lengths l")
def win_trailing_mean(spark, sf_dir):
    rows = temporal.trailing_mean(T.timeline(spark, sf_dir).withColumn("K", F.least(F.lit(7), "frame")))
    return rows.select("scenario", "frame", F.round("V1", 6).alias("v1"))


@query("cells", """SELECT g.frame, CAST(g.r AS INTEGER) AS "row", CAST(g.c AS INTEGER) AS col, coalesce(x.value, 0.25::DOUBLE) AS value, least(abs(g.u), 8) AS filled FROM (
SELECT f.frame, f.frame % 5 - 2 AS u, r, c FROM (SELECT DISTINCT frame FROM cells) f, range(0, 8) AS a(r), range(0, 8) AS b(c)) g
LEFT JOIN cells x ON x.frame = g.frame AND x."row" = g.r AND x.col = g.c + g.u""")
def arr_warp(spark, sf_dir):
    rows = as_cells(spark, sf_dir).withColumn("u", F.pmod("frame", F.lit(5)) - 2)
    return temporal.warp(rows, "u", 8, 0.25, ["frame", "u"]).select("frame", "row", "col", "value", temporal.fill_count(F.col("u"), 8).cast("long").alias("filled"))


@query("cells", "SELECT 0 AS scenario, frame, max(value) AS score FROM cells GROUP BY frame")
def agg_frame_scores(spark, sf_dir):
    return metrics.frame_scores(maps(spark, sf_dir)).select("scenario", F.col("frame").cast("long").alias("frame"), "score")


@query("cells", "SELECT round(avg(value), 9) AS mu0, round(quantile_cont(value, 0.999), 9) AS tau_cell FROM cells")
def agg_map_constants(spark, sf_dir):
    got = temporal.map_constants(maps(spark, sf_dir))
    return got.select(F.round("mu0", 9).alias("mu0"), F.round("tau_cell", 9).alias("tau_cell"))


MAX3_SQL = """SELECT a.frame, a."row", a.col, max(b.value) AS value FROM cells a JOIN cells b ON a.frame = b.frame AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL"""


@query("cells", MAX3_SQL)
def arr_max3(spark, sf_dir):
    return temporal.max3(as_cells(spark, sf_dir), 8, 8, ["frame"])


@query("cells", f"""SELECT c."row", c.col, round(c.b1, 9) AS b1, round(m.b3, 9) AS b3 FROM (SELECT "row", col, avg(value) AS b1 FROM cells GROUP BY ALL) c
JOIN (SELECT "row", col, avg(value) AS b3 FROM ({MAX3_SQL}) GROUP BY ALL) m ON c."row" = m."row" AND c.col = m.col""")
def agg_baselines(spark, sf_dir):
    return temporal.baselines(as_cells(spark, sf_dir), 8, 8, ["frame"]).withColumns({"b1": F.round("b1", 9), "b3": F.round("b3", 9)})


@query("cells", """SELECT col, round(avg(b1), 9) AS profile FROM (SELECT "row", col, avg(value) AS b1 FROM cells GROUP BY ALL) GROUP BY col""")
def agg_column_profile(spark, sf_dir):
    got = temporal.column_profile(temporal.baselines(as_cells(spark, sf_dir), 8, 8, ["frame"]))
    return got.withColumn("profile", F.round("profile", 9))


@query("cells", """SELECT frame, "row", col, value FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY value DESC, "row", col) AS n FROM (
SELECT frame, "row", col, round(value, 1) AS value FROM cells)) WHERE n = 1""")
def srt_argmax(spark, sf_dir):
    return temporal.argmax_cell(as_cells(spark, sf_dir).withColumn("value", F.round("value", 1)), 8, ["frame"])


@query("cells", """SELECT g.frame, CAST(g.r AS INTEGER) AS "row", CAST(g.c AS INTEGER) AS col, k, coalesce(x.value, 0) AS value FROM (
SELECT f.frame, r, c, CAST(k AS INTEGER) AS k FROM (SELECT DISTINCT frame FROM cells) f, range(0, 8) AS a(r), range(0, 8) AS b(c), range(0, 9) AS d(k)) g
LEFT JOIN cells x ON x.frame = g.frame AND x."row" = g.r + g.k // 3 - 1 AND x.col = g.c + g.k % 3 - 1""")
def arr_unfold3(spark, sf_dir):
    got = temporal.unfold3(as_cells(spark, sf_dir), 8, 8, ["frame"])
    return got.select("frame", "row", "col", F.posexplode("patch").alias("k", "value"))


@query("", """SELECT vec_id, CAST(i AS INTEGER) AS i, round((SELECT avg(CAST(embedding[j] AS DOUBLE)) FROM range(i * 64 // 10 + 1, ((i + 1) * 64 + 9) // 10 + 1) AS r(j)), 9) AS value
FROM embeddings, range(0, 10) AS g(i)""")
def arr_adaptive_mean(spark, sf_dir):
    x = T.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    got = x.select("vec_id", F.posexplode(temporal.adaptive_mean(F.col("x"), 64, 10)).alias("i", "value"))
    return got.withColumn("value", F.round("value", 9))


@query("cells", """, taps AS (SELECT CAST(o AS INTEGER) AS o, CAST(a AS INTEGER) AS a, w FROM (
  SELECT o, floor(x) AS a, 1 - (x - floor(x)) AS w FROM (SELECT o, greatest(0.0::DOUBLE, (o + 0.5::DOUBLE) / 2 - 0.5::DOUBLE) AS x FROM range(0, 16) AS g(o))
  UNION ALL SELECT o, least(floor(x) + 1, 7), x - floor(x) FROM (SELECT o, greatest(0.0::DOUBLE, (o + 0.5::DOUBLE) / 2 - 0.5::DOUBLE) AS x FROM range(0, 16) AS g(o)))),
across AS (SELECT c.frame, c."row", t.o AS col, sum(t.w * c.value) AS value FROM cells c JOIN taps t ON t.a = c.col GROUP BY ALL)
SELECT c.frame, t.o AS "row", c.col, round(sum(t.w * c.value), 6) AS value FROM across c JOIN taps t ON t.a = c."row" GROUP BY ALL""")
def arr_upsample(spark, sf_dir):
    return temporal.upsample2(as_cells(spark, sf_dir), 8, 8, ["frame"]).withColumn("value", F.round("value", 6))


@query("cells", "SELECT a.frame, round(avg((a.value - b.value) ** 2), 9) AS mse FROM cells a JOIN cells b ON b.frame = a.frame + 1 AND a.\"row\" = b.\"row\" AND a.col = b.col GROUP BY a.frame")
def agg_paired_mse(spark, sf_dir):
    rows = as_cells(spark, sf_dir)
    return temporal.paired_mse(rows, rows.withColumn("frame", F.col("frame") - 1), ["frame"]).withColumn("mse", F.round("mse", 9))


# -- vectors


@query("", """SELECT qid, id, round(d2, 6) AS d2 FROM (SELECT q.vec_id AS qid, b.vec_id AS id, d2, row_number() OVER (PARTITION BY q.vec_id ORDER BY d2, b.vec_id) AS n FROM embeddings q, embeddings b,
LATERAL (SELECT list_sum(list_transform(list_zip(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2) WHERE q.vec_id % 10 <> 0 AND b.vec_id % 10 = 0) WHERE n = 1""")
def joi_nearest(spark, sf_dir):
    v = T.table(spark, sf_dir, "embeddings")
    got = vectors.nearest(v.where("vec_id % 10 != 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("x")), v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")))
    return got.withColumn("d2", F.round("d2", 6))


@query()
def srt_coreset(spark, sf_dir):
    v = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    return vectors.coreset(v, 0.02).select("id")


@query("", "SELECT round(max(abs(l_extendedprice - l_quantity * 1000)) / max(abs(l_quantity * 1000)), 9) AS rel FROM lineitem")
def agg_relative_error(spark, sf_dir):
    rows = T.table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * 1000).alias("b"))
    return vectors.relative_error(rows).select(F.round(F.col("rel").cast("double"), 9).alias("rel"))


# -- bank


def normal_frames(spark, sf_dir) -> DataFrame:
    frames = T.timeline(spark, sf_dir)
    rows = intervals.eligible(frames, T.defect_frames(frames), F.lit(5))
    return rows.select("scenario", "frame", (11 + F.col("scenario")).alias("spacing"))


BANK_PARTS = """, elig AS (SELECT t.scenario, t.frame, 11 + t.scenario AS spacing FROM timeline t WHERE t.label IN (1, 2) AND NOT EXISTS (
  SELECT 1 FROM timeline d WHERE d.scenario = t.scenario AND d.label >= 3 AND abs(t.frame - d.frame) <= 5)),
taken AS (SELECT scenario, min(frame) AS frame, 0 AS c, any_value(spacing) AS spacing FROM elig GROUP BY scenario
  UNION ALL SELECT t.scenario, (SELECT min(e.frame) FROM elig e WHERE e.scenario = t.scenario AND e.frame >= t.frame + t.spacing), t.c + 1, t.spacing FROM taken t
  WHERE EXISTS (SELECT 1 FROM elig e WHERE e.scenario = t.scenario AND e.frame >= t.frame + t.spacing))"""


@query("timeline", BANK_PARTS + " SELECT scenario, frame, c FROM taken")
def win_capacity(spark, sf_dir):
    return bank.capacity(normal_frames(spark, sf_dir))


FILL_SQL = """SELECT o_orderpriority AS "group", o_orderstatus AS scenario, count(*) AS capacity FROM orders GROUP BY ALL"""


@query("", f"""WITH RECURSIVE caps AS ({FILL_SQL}),
fill AS (SELECT "group", scenario, capacity, 0::BIGINT AS quota, 500::BIGINT AS remaining, 0 AS step FROM caps
  UNION ALL SELECT "group", scenario, capacity, q2, remaining - sum(q2 - quota) OVER (PARTITION BY "group"), step + 1 FROM (
    SELECT *, quota + CASE WHEN capacity > quota THEN least(remaining // open_n + CASE WHEN rank_open <= remaining % open_n THEN 1 ELSE 0 END, capacity - quota) ELSE 0 END AS q2 FROM (
      SELECT *, sum(CASE WHEN capacity > quota THEN 1 ELSE 0 END) OVER (PARTITION BY "group") AS open_n,
        sum(CASE WHEN capacity > quota THEN 1 ELSE 0 END) OVER (PARTITION BY "group" ORDER BY scenario) AS rank_open FROM fill WHERE step < 8)
    WHERE remaining > 0 AND open_n > 0))
SELECT "group", scenario, CAST(max(quota) AS BIGINT) AS quota FROM fill GROUP BY ALL""")
def srt_waterfill(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders")
    caps = orders.groupBy(F.col("o_orderpriority").alias("group"), F.col("o_orderstatus").alias("scenario")).agg(F.count(F.lit(1)).alias("capacity"))
    return bank.allocate(caps, 500)


@query("timeline", BANK_PARTS + """, sizes AS (SELECT scenario, count(*) AS n FROM taken GROUP BY scenario)
SELECT t.scenario, j, t.frame FROM sizes s, range(0, 20) AS g(j) JOIN taken t ON t.scenario = s.scenario AND t.c = ((2 * j + 1) * s.n) // 40""")
def srt_spaced_pick(spark, sf_dir):
    quotas = spark.createDataFrame([(s, 20) for s in range(4)], "scenario int, quota long")
    return bank.spaced(bank.capacity(normal_frames(spark, sf_dir)), quotas)


@query("timeline", BANK_PARTS + """, sizes AS (SELECT scenario, count(*) AS n FROM taken GROUP BY scenario)
SELECT CASE WHEN t.scenario % 2 = 0 THEN 'even' ELSE 'odd' END AS "group", t.scenario, j, t.frame FROM sizes s, range(0, 8) AS g(j) JOIN taken t ON t.scenario = s.scenario AND t.c = ((2 * j + 1) * s.n) // 16""")
def srt_bank_build(spark, sf_dir):
    """Sixteen frames for each of two groups; all capacities are over eight, so shares are equal."""
    groups = spark.createDataFrame([("even", 0), ("odd", 1), ("even", 2), ("odd", 3)], "`group` string, scenario int")
    return bank.build(normal_frames(spark, sf_dir), groups, 16)


@query("walk", """SELECT scenario, CAST(unnest(range(a, a + 12)) AS INTEGER) AS frame FROM (SELECT scenario, min(frame) AS a, count(*) AS n FROM (
SELECT scenario, frame, frame - row_number() OVER (PARTITION BY scenario ORDER BY frame) AS i FROM walk WHERE status = 2) GROUP BY scenario, i HAVING count(*) >= 12 ORDER BY scenario, a LIMIT 1)""")
def win_consecutive(spark, sf_dir):
    return bank.consecutive(durable(motion.statuses(T.timeline(spark, sf_dir), 0.4), "statuses"), 12)


# -- inference


@query("timeline spans", "SELECT t.scenario, CAST((t.frame - 1 + 17 * (t.scenario + 1)) % n.N + 1 AS INTEGER) AS frame, t.score FROM timeline t JOIN spans n USING (scenario)")
def win_cyclic_shift(spark, sf_dir):
    by = spark.createDataFrame([(s, 17 * (s + 1)) for s in range(4)], "scenario int, d int")
    return inference.shift(T.timeline(spark, sf_dir), by)


def fixed_shifts(spark, n: int) -> DataFrame:
    return spark.createDataFrame([(b, s, 37 * b + 11 * s + 5) for b in range(n) for s in range(T.SCENARIOS)], "b int, scenario int, d int")


# the whole evaluation for each b of rf (b, scenario, frame, score, normal, seg, win, track)
BY_SQL = """rq AS (SELECT b, scenario, win, track, max(score) AS q FROM rf WHERE win IS NOT NULL GROUP BY ALL),
rs AS (SELECT b, scenario, seg, tau, run, min(frame) AS a, max(frame) AS e FROM (SELECT *, sum(opens) OVER (PARTITION BY b, scenario, seg, tau ORDER BY frame) AS run FROM (
  SELECT g.b, g.tau, f.scenario, f.seg, f.frame, CASE WHEN f.frame - lag(f.frame) OVER w <= 3 THEN 0 ELSE 1 END AS opens
  FROM (SELECT DISTINCT b, scenario, seg, score AS tau FROM rf WHERE normal) g JOIN rf f ON f.b = g.b AND f.scenario = g.scenario AND f.seg = g.seg AND f.normal AND f.score >= g.tau
  WINDOW w AS (PARTITION BY g.b, g.scenario, g.seg, g.tau ORDER BY f.frame))) GROUP BY ALL),
rd AS (SELECT b, tau, sum(d) AS d FROM (SELECT b, tau, c - lag(c, 1, 0) OVER (PARTITION BY b, scenario, seg ORDER BY tau DESC) AS d FROM (SELECT b, scenario, seg, tau, sum((e - a + 25) // 25) AS c FROM rs GROUP BY ALL)) GROUP BY ALL),
rg AS (SELECT DISTINCT b, tau FROM (SELECT b, score AS tau FROM rf WHERE normal UNION ALL SELECT b, q FROM rq) UNION ALL SELECT DISTINCT b, 'Infinity'::DOUBLE FROM rf),
rp_ AS (SELECT b, q AS tau, count(*) AS d FROM rq GROUP BY ALL),
rz_ AS (SELECT b, z AS tau, count(*) AS d FROM (SELECT b, track, max(q) AS z FROM rq GROUP BY ALL) GROUP BY ALL),
rn AS (SELECT g.b, g.tau, coalesce(sum(d.d) OVER w, 0) AS C, coalesce(sum(p.d) OVER w, 0) AS detp, coalesce(sum(z.d) OVER w, 0) AS dett
  FROM rg g LEFT JOIN rd d ON d.b = g.b AND d.tau = g.tau LEFT JOIN rp_ p ON p.b = g.b AND p.tau = g.tau LEFT JOIN rz_ z ON z.b = g.b AND z.tau = g.tau WINDOW w AS (PARTITION BY g.b ORDER BY g.tau DESC)),
rc AS (SELECT b, row_number() OVER w - 1 AS j, max(C) OVER w AS E, detp, dett FROM rn WINDOW w AS (PARTITION BY b ORDER BY tau DESC)),
rr AS (SELECT c.*, t.*, lead(E) OVER (PARTITION BY b ORDER BY j) AS nextE FROM rc c, total t),
rp AS (SELECT b, CAST(sum(CASE WHEN 100 * E > nN THEN 0 WHEN 100 * nextE <= nN THEN detp * 1000 * (nextE - E) ELSE detp * (10 * nN - 1000 * E) END) AS BIGINT) AS P3_num, any_value(10 * nP * nN) AS P3_den FROM rr GROUP BY b)"""


SHIFTED_SQL = """, ring AS (SELECT CAST(b AS INTEGER) AS b, c.scenario, CAST((c.frame - 1 + 37 * b + 11 * c.scenario + 5) % n.N + 1 AS INTEGER) AS frame, c.score FROM frames c JOIN spans n USING (scenario), range(0, {shifts}) AS g(b)),
rf AS (SELECT r.b, r.scenario, r.frame, r.score, c.normal, c.seg, c.win, c.track FROM ring r JOIN frames c USING (scenario, frame)),
""" + BY_SQL
SHIFTS = 20


def trial(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Frames with their windows (s, track), and the sizes."""
    frames, w = kept_layout(spark, sf_dir)
    return intervals.in_window(frames, w, "s", "track"), metrics.sizes(frames, w)


@query("frames spans total", SHIFTED_SQL.format(shifts=SHIFTS) + " SELECT b, P3_num, P3_den FROM rp")
def inf_permutation_null(spark, sf_dir):
    frames, sizes = trial(spark, sf_dir)
    return inference.permutation_null(frames, fixed_shifts(spark, SHIFTS), sizes)


@query("frames spans total rates", SHIFTED_SQL.format(shifts=SHIFTS) + f", obs AS ({METRICS_SQL}) SELECT count(*) FILTER (WHERE rp.P3_num >= obs.P3_num) AS k, count(*) FILTER (WHERE rp.P3_num >= obs.P3_num) >= 2 AS collapsed, count(*) FILTER (WHERE rp.P3_num >= obs.P3_num) + 1 AS p_num, count(*) + 1 AS p_den FROM rp, obs")
def inf_collapse(spark, sf_dir):
    frames, sizes = trial(spark, sf_dir)
    return inference.collapse(inference.permutation_null(frames, fixed_shifts(spark, SHIFTS), sizes), metrics.metrics(*curve_of(spark, sf_dir)), 2)


@query()
def inf_chance_null(spark, sf_dir):
    """The whole null of 200 shifts with drawn offsets, and the collapse test, on unrounded scores."""
    frames, w = kept_layout(spark, sf_dir)
    lengths_ = [r["n"] for r in frames.groupBy("scenario").agg(F.count(F.lit(1)).alias("n")).orderBy("scenario").collect()]  # one number a scenario
    drawn = inference.offsets(lengths_, 0, 0)
    by = spark.createDataFrame([(b, s, int(drawn[b, s])) for b in range(len(drawn)) for s in range(drawn.shape[1])], "b int, scenario int, d int")
    sizes = durable(metrics.sizes(frames, w), "sizes")
    null = inference.permutation_null(intervals.in_window(frames, w, "s", "track"), by, sizes)
    return inference.collapse(null, metrics.evaluate(frames, w))


@query()
def gen_null_calibration(spark, sf_dir):
    """Shifts of synthetic traces that do at least as well as the traces themselves, on the whole layout."""
    frames, w = kept_layout(spark, sf_dir)
    scenarios = [(r["scenario"], r["n"], 40) for r in frames.groupBy("scenario").agg(F.count(F.lit(1)).alias("n")).orderBy("scenario").collect()]  # one number a scenario
    place = durable(intervals.in_window(frames, w, "s", "track").drop("score", "label", "dx", "dy", "r", "has_est"), "layout")
    traces = synth.traces(spark, "N2_ar0.9", 6, scenarios)
    sizes = durable(metrics.sizes(frames, w), "sizes")
    return inference.calibrate(traces, place, fixed_shifts(spark, 12), sizes)


def bootstrap_parts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    frames, w = kept_layout(spark, sf_dir)
    rows = durable(phased(spark, sf_dir, frames).withColumn("unit", (F.col("scenario") * 100 + F.col("phase_bin")).cast("int")), "units")
    q = durable(metrics.pass_scores(frames, w), "pass-scores")
    sizes = intervals.unit_sizes(rows, "unit")
    weights = sizes.select("unit").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("w", F.pmod(F.col("b") * 7 + F.col("unit") * 13, F.lit(3)).cast("long")).where("w > 0")
    tracks = q.select("track").distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("w", F.pmod(F.col("b") + F.substring("track", 1, 1).cast("int") + 2 * F.substring("track", 3, 1).cast("int"), F.lit(3)).cast("long")).where("w > 0")
    return events.steps(rows, unit="unit"), weights, sizes, q, tracks


BOOT_SQL = UNIT_SQL + """,
us AS (SELECT CAST(p.scenario * 100 + p.phase // 50 AS INTEGER) AS unit, sum(f.normal::INT) AS n FROM phased p JOIN frames f USING (scenario, frame) GROUP BY 1),
uw AS (SELECT b, unit, n, (b * 7 + unit * 13) % 3 AS w FROM us, range(0, 6) AS g(b)),
tw AS (SELECT b, track, (b + CAST(track[1] AS INTEGER) + 2 * CAST(track[3] AS INTEGER)) % 3 AS w FROM (SELECT DISTINCT track FROM qs), range(0, 6) AS g(b)),
bs AS (SELECT w.b, u.tau, sum(w.w * u.d) AS d FROM unit_deltas u JOIN uw w ON w.unit = u.unit GROUP BY ALL),
bp AS (SELECT t.b, q.q AS tau, sum(t.w) AS d FROM qs q JOIN tw t USING (track) GROUP BY ALL),
bz AS (SELECT t.b, z.z AS tau, sum(t.w) AS d FROM zs z JOIN tw t USING (track) GROUP BY ALL),
bc AS (SELECT g.b, g.tau, coalesce(sum(s.d) OVER w, 0) AS C, coalesce(sum(p.d) OVER w, 0) AS detp, coalesce(sum(z.d) OVER w, 0) AS dett FROM (SELECT x.b, tau FROM grid, range(0, 6) AS x(b)) g
  LEFT JOIN bs s ON s.b = g.b AND s.tau = g.tau LEFT JOIN bp p ON p.b = g.b AND p.tau = g.tau LEFT JOIN bz z ON z.b = g.b AND z.tau = g.tau WINDOW w AS (PARTITION BY g.b ORDER BY g.tau DESC)),
bd AS (SELECT b, tau, row_number() OVER v AS j, max(C) OVER v AS E, detp, dett FROM bc WINDOW v AS (PARTITION BY b ORDER BY tau DESC)),
bn AS (SELECT b, (SELECT sum(w * n) FROM uw WHERE uw.b = x.b) AS nN, (SELECT sum(t.w) FROM qs q JOIN tw t ON t.track = q.track AND t.b = x.b) AS nP, (SELECT nK FROM total) AS nK FROM range(0, 6) AS x(b)),
br AS (SELECT d.*, n.nN, n.nP, n.nK, lead(E) OVER (PARTITION BY d.b ORDER BY j) AS nextE FROM bd d JOIN bn n ON n.b = d.b),
bm AS (SELECT CAST(b AS INTEGER) AS b, least(1000 * min(E) FILTER (WHERE 5 * detp >= 4 * nP), 50 * any_value(nN)) / any_value(nN)::DOUBLE AS P1,
  max(dett) FILTER (WHERE 1000 * E <= 2 * nN) / any_value(nK)::DOUBLE AS P2,
  sum(CASE WHEN 100 * E > nN THEN 0 WHEN 100 * nextE <= nN THEN detp * 1000 * (nextE - E) ELSE detp * (10 * nN - 1000 * E) END) / (10.0::DOUBLE * any_value(nP) * any_value(nN)) AS P3 FROM br GROUP BY b)"""


@query("seg_runs phased frames grid qs zs total", BOOT_SQL + " SELECT b, round(P1, 9) AS p1, round(P2, 9) AS p2, round(P3, 9) AS p3 FROM bm")
def inf_bootstrap(spark, sf_dir):
    steps, weights, sizes, q, tracks = bootstrap_parts(spark, sf_dir)
    got = inference.replicate_metrics(steps, "unit", weights, sizes, q, tracks)
    return got.select("b", *(F.round(c, 9).alias(c.lower()) for c in ("P1", "P2", "P3")))


@query("seg_runs phased frames grid qs zs total", BOOT_SQL + " SELECT round(quantile_cont(P3, 0.025), 9) AS lo, round(quantile_cont(P3, 0.975), 9) AS hi, 0::BIGINT AS undefined FROM bm")
def agg_interval(spark, sf_dir):
    steps, weights, sizes, q, tracks = bootstrap_parts(spark, sf_dir)
    got = inference.interval(inference.replicate_metrics(steps, "unit", weights, sizes, q, tracks), "P3")
    return got.select(F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "undefined")


@query("", "SELECT o_orderkey, CASE WHEN o_totalprice - 150000 > 0 AND o_custkey > 50 THEN round(ln((o_totalprice - 150000) / o_custkey), 9) END AS v FROM orders")
def sca_log_ratio(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    a = (F.col("o_totalprice") - 150000).cast("double")
    return o.select("o_orderkey", F.round(S.log_ratio(a, F.when(F.col("o_custkey") > 50, F.col("o_custkey"))), 9).alias("v"))


@query("", "SELECT event_id, CAST(floor((event_id - 5000) / 8.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS half_up, (((event_id - 5000) % 7) + 7) % 7 AS modulo, round(event_id * power(2.0::DOUBLE, -24) / (1 - event_id * power(2.0::DOUBLE, -24)), 12) AS bound FROM events")
def sca_rounding(spark, sf_dir):
    x = F.col("event_id") - 5000
    return T.table(spark, sf_dir, "events").select("event_id", S.half_up(x / 8.0).alias("half_up"), S.true_mod(x, 7).alias("modulo"), F.round(S.error_bound(F.col("event_id")), 12).alias("bound"))


@query("", "SELECT fold, sha256(string_agg(path || chr(9) || size || chr(10), '' ORDER BY path)) AS digest FROM (SELECT doc_id % 7 AS fold, 'f' || lpad(doc_id::VARCHAR, 9, '0') AS path, n_chars AS size FROM documents) GROUP BY fold")
def snk_list_digest(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("fold"), F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.col("n_chars").alias("size"))
    return files.list_digest(docs, "path", "size", "fold")


# -- decisions: fold states made from lineitem's integers


def fold_states(spark, sf_dir) -> DataFrame:
    """Synthetic fold states; shares of a gain, signs and limits all occur."""
    n = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    m = lambda a, b: F.pmod(F.floor(n / a), F.lit(b))
    rows = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    v1 = 300 + 10 * m(1, 11)
    v4 = v1 + 4 * m(11, 31) - 40
    made = {
        "collapse": m(3, 17) == 0, "motion": m(5, 13) == 0, "saturated": m(7, 11) == 0,
        "P3_den": F.lit(1000).cast("long"), "P3_V1": v1, "P3_V4": v4,
        "P3_V2": v4 - m(13, 60), "P3_REV": v4 - m(17, 90), "P3_LAG": v4 - m(19, 90),
        "P2_den": F.lit(34).cast("long"), "P2_V1": 10 + m(23, 5), "P2_V4": 10 + m(29, 9),
        "P1_V1_num": 10 * m(31, 7), "P1_V1_den": F.lit(41).cast("long"), "P1_V1_censored": m(31, 7) == 6,
        "P1_V4_num": 10 * m(37, 7), "P1_V4_den": F.lit(41).cast("long"), "P1_V4_censored": m(37, 7) == 6,
        "lb9": (m(41, 9) - 4).cast("long") * 1000,
    }
    return rows.withColumns(made)


STATES_SQL = """WITH n AS (SELECT l_orderkey, l_linenumber, l_orderkey * 7 + l_linenumber AS n FROM lineitem),
b AS (SELECT *, 300 + 10 * (n % 11) AS v1 FROM n), c AS (SELECT *, v1 + 4 * (n // 11 % 31) - 40 AS v4 FROM b),
d AS (SELECT *, v4 - v1 AS g, n // 13 % 60 AS m2, n // 17 % 90 AS mr, n // 19 % 90 AS ml, (n // 29 % 9) - (n // 23 % 5) AS p2, n // 31 % 7 AS a, n // 37 % 7 AS z,
  CASE WHEN n // 3 % 17 = 0 THEN 'collapse' WHEN n // 5 % 13 = 0 THEN 'motion' WHEN n // 7 % 11 = 0 THEN 'saturated' ELSE 'valid' END AS valid, (n // 41 % 9) > 4 AS lbp FROM c),
e AS (SELECT *, CASE WHEN g <= -20 THEN 'harm' WHEN g >= 20 THEN 'positive' ELSE 'null' END AS band FROM d),
f AS (SELECT *, CASE WHEN band <> 'positive' THEN NULL WHEN 5 * m2 <= g OR 5 * mr <= g OR 5 * ml <= g THEN 'fail'
   WHEN 2 * m2 >= g AND m2 >= 20 AND 2 * mr >= g AND mr >= 20 AND 2 * ml >= g AND ml >= 20 THEN 'pass' ELSE 'between' END AS c4,
  CASE WHEN a = 0 AND z = 0 THEN 'nonevaluable' WHEN a = 0 THEN 'fail' WHEN a = 6 AND z = 6 THEN 'nonevaluable' WHEN 10 * z <= 8 * a THEN 'pass' WHEN 100 * z > 95 * a THEN 'fail' ELSE 'between' END AS c1,
  p2 * 100 >= 6 * 34 AS c2, sign(g)::INT AS sign_p3, sign(p2)::INT AS sign_p2, sign(a - z)::INT AS sign_p1 FROM e)"""

CRITERIA = ["valid", "band", "c4", "c1", "c2", "sign_p3", "sign_p2", "sign_p1", "lb_positive"]


@query("", STATES_SQL + " SELECT l_orderkey, l_linenumber, valid, band, c4, c1, c2, sign_p3, sign_p2, sign_p1, lbp AS lb_positive FROM f")
def dec_criteria(spark, sf_dir):
    return decision.fold_criteria(fold_states(spark, sf_dir)).select("l_orderkey", "l_linenumber", *CRITERIA)


@query("", STATES_SQL + """, s AS (SELECT valid, band, c4, c1, c2, sign_p3, sign_p2, sign_p1, lbp, count(*) AS n FROM f GROUP BY ALL)
SELECT outcome, CAST(sum(n) AS BIGINT) AS n FROM (SELECT x.n * y.n AS n, CASE
  WHEN x.valid <> 'valid' AND y.valid <> 'valid' THEN CASE WHEN 'collapse' IN (x.valid, y.valid) THEN 'G' WHEN 'motion' IN (x.valid, y.valid) THEN 'M' ELSE 'F' END
  WHEN x.valid <> 'valid' OR y.valid <> 'valid' THEN 'Bstar'
  WHEN 'harm' IN (x.band, y.band) THEN 'D' WHEN x.band = 'null' AND y.band = 'null' THEN 'C'
  WHEN coalesce(x.c4, '') = 'fail' OR coalesce(y.c4, '') = 'fail' THEN 'E'
  WHEN x.band = 'positive' AND y.band = 'positive' AND (x.lbp OR y.lbp) AND x.c4 = 'pass' AND y.c4 = 'pass' AND ((x.c1 = 'pass' AND y.c1 = 'pass') OR (x.c2 AND y.c2))
    AND NOT (x.sign_p3 * y.sign_p3 = -1 OR x.sign_p2 * y.sign_p2 = -1 OR (x.c1 <> 'nonevaluable' AND y.c1 <> 'nonevaluable' AND x.sign_p1 * y.sign_p1 = -1)) THEN 'A'
  ELSE 'B' END AS outcome FROM s x, s y) GROUP BY outcome""")
def dec_outcome_grid(spark, sf_dir):
    return decision.grid(decision.fold_criteria(fold_states(spark, sf_dir)), CRITERIA)


@query("", """WITH o AS (SELECT ['A','B','Bstar','C','D','E','F','G','M'] AS v), s AS (SELECT ['G','M','F','D','E','C','I','A'] AS v)
SELECT a, b, c, CASE WHEN a NOT IN ('A', 'B', 'Bstar') THEN a ELSE (SELECT s.v[least(list_position(s.v, m(a)), list_position(s.v, m(b)), list_position(s.v, m(c)))] FROM s) END AS final
FROM (SELECT unnest(v) AS a FROM o), (SELECT unnest(v) AS b FROM o), (SELECT unnest(v) AS c FROM o)""".replace("m(a)", "CASE WHEN a IN ('B','Bstar') THEN 'I' ELSE a END").replace("m(b)", "CASE WHEN b IN ('B','Bstar') THEN 'I' ELSE b END").replace("m(c)", "CASE WHEN c IN ('B','Bstar') THEN 'I' ELSE c END"))
def dec_final(spark, sf_dir):
    o = [("A",), ("B",), ("Bstar",), ("C",), ("D",), ("E",), ("F",), ("G",), ("M",)]
    one = lambda n: spark.createDataFrame(o, f"{n} string")
    return one("a").join(F.broadcast(one("b"))).join(F.broadcast(one("c"))).withColumn("final", decision.final(F.col("a"), F.col("b"), F.col("c")))  # nine rows each


#: Values of the state grid in units of 1e-9 (fixed values): gains, shares of the gain, lower bounds,
#: alarm rates with their censoring, gains in tracks.
GRID = {
    "d": [-30_000_000, -20_000_000, -19_999_999, -10_000_000, 0, 10_000_000, 19_999_999, 20_000_000, 30_000_000, 40_000_000, 200_000_000],
    "s": [-1_000_000_000, 200_000_000, 200_000_001, 499_999_999, 500_000_000, 1_000_000_000],
    "lb": [-10_000_000, 0, 1_000_000],
    "p1": [(0, False, 0, False), (10, False, 0, False), (0, False, 5, False), (10, False, 8, False), (10, False, 9, False), (10, False, 10, False), (50, True, 50, True), (50, True, 40, False)],
    "dp2": [-60_000_000, 0, 59_999_999, 60_000_000],
}


def grid_states(spark) -> DataFrame:
    """Every combination of flags, gains, shares, bounds and rates: 1,824,768 fold states."""
    rows = spark.range(8).select(*((F.floor(F.col("id") / k) % 2 == 1).alias(n) for n, k in (("collapse", 4), ("motion", 2), ("saturated", 1))))
    each = lambda df, name, values: df.withColumn(name, F.explode(F.array(*(F.lit(v).cast("long") for v in values))))
    for name, values in (("d", GRID["d"]), ("s2", GRID["s"]), ("sr", GRID["s"]), ("sl", GRID["s"]), ("lb9", GRID["lb"]), ("dp2", GRID["dp2"])):
        rows = each(rows, name, values)
    rates = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(p, ("a", "ac", "b", "bc"), strict=True))) for p in GRID["p1"]))
    unit, fine = 10**9, 100
    # gains of a share are multiples of 0.01, so products with shares are whole in units of 1e-11
    wide = F.call_function("div", F.greatest("d", F.lit(20_000_000).cast("long")), F.lit(10_000_000).cast("long"))
    v4 = (F.lit(400_000_000).cast("long") + F.col("d")) * fine
    one = F.lit(1).cast("long")
    return rows.repartition("d", "s2").withColumn("p1", F.explode(rates)).select(
        "collapse", "motion", "saturated", "lb9", "d", F.lit(unit * fine).cast("long").alias("P3_den"), F.lit(400_000_000 * fine).cast("long").alias("P3_V1"), v4.alias("P3_V4"),
        *((v4 - F.col(c) * wide).alias(f"P3_{n}") for c, n in (("s2", "V2"), ("sr", "REV"), ("sl", "LAG"))),
        F.lit(unit).cast("long").alias("P2_den"), F.lit(unit // 2).cast("long").alias("P2_V1"), (F.lit(unit // 2).cast("long") + F.col("dp2")).alias("P2_V4"),
        F.col("p1.a").cast("long").alias("P1_V1_num"), one.alias("P1_V1_den"), F.col("p1.ac").alias("P1_V1_censored"),
        F.col("p1.b").cast("long").alias("P1_V4_num"), one.alias("P1_V4_den"), F.col("p1.bc").alias("P1_V4_censored"),
    )


def _grid_sql() -> str:
    """States with the criteria written out; every share is exact at nine places."""
    one = lambda name, values: f"(SELECT unnest({values}) AS {name})"
    rates = ", ".join(f"({a}, {str(x).lower()}, {b}, {str(y).lower()})" for a, x, b, y in GRID["p1"])
    return f"""WITH d AS (SELECT *, CASE WHEN f >= 4 THEN 'collapse' WHEN f >= 2 THEN 'motion' WHEN f >= 1 THEN 'saturated' ELSE 'valid' END AS valid,
  CASE WHEN g <= -20000000 THEN 'harm' WHEN g >= 20000000 THEN 'positive' ELSE 'null' END AS band
  FROM range(0, 8) AS fl(f), {one("g", GRID["d"])}, {one("s2", GRID["s"])}, {one("sr", GRID["s"])}, {one("sl", GRID["s"])}, {one("lb", GRID["lb"])}, {one("p2", GRID["dp2"])}, (VALUES {rates}) AS r(a, ac, b, bc)),
m AS (SELECT *, least(s2, sr, sl) AS low, least(s2, sr, sl)::HUGEINT * g AS margin FROM d),
f AS (SELECT *, CASE WHEN band <> 'positive' THEN NULL WHEN low <= 200000000 THEN 'fail' WHEN low >= 500000000 AND (2 * margin + 1000000000) // 2000000000 >= 20000000 THEN 'pass' ELSE 'between' END AS c4,
  CASE WHEN a = 0 AND b = 0 THEN 'nonevaluable' WHEN a = 0 THEN 'fail' WHEN ac AND bc THEN 'nonevaluable' WHEN 10 * b <= 8 * a THEN 'pass' WHEN 100 * b > 95 * a THEN 'fail' ELSE 'between' END AS c1,
  p2 >= 60000000 AS c2, sign(g)::INT AS sign_p3, sign(p2)::INT AS sign_p2, sign(a - b)::INT AS sign_p1, lb > 0 AS lbp FROM m)"""


OUTCOME_SQL = ORACLES["dec_outcome_grid"][len(STATES_SQL) :]


@query("", _grid_sql() + OUTCOME_SQL)
def gen_decision_grid(spark, sf_dir):
    """Outcomes of all ordered pairs of the 1,824,768 fold states."""
    return decision.grid(decision.fold_criteria(grid_states(spark)), CRITERIA)


# -- the specification's sensitivity analyses


def variant_metrics(spark, sf_dir, w: DataFrame, cap: int = events.CAP, weight=None, sizes=None) -> DataFrame:
    frames = kept_layout(spark, sf_dir)[0]
    q = metrics.pass_scores(frames, w)
    return metrics.metrics(metrics.metric_curve(events.steps(frames, cap=cap), q, weight=weight), sizes if sizes is not None else metrics.sizes(frames, w))


SUBSET_SQL = """, sub AS ({subset}), sq AS (SELECT * FROM qs SEMI JOIN sub USING (scenario, win)), sz AS (SELECT track, max(q) AS z FROM sq GROUP BY track),
sg AS (SELECT DISTINCT tau FROM (SELECT score AS tau FROM frames WHERE normal UNION ALL SELECT q FROM sq UNION ALL SELECT 'Infinity'::DOUBLE)),
sc AS (SELECT row_number() OVER v AS j, max(C) OVER v AS E, (SELECT count(*) FROM sq WHERE q >= tau) AS detp, (SELECT count(*) FROM sz WHERE z >= tau) AS dett
  FROM (SELECT sg.tau, c.C FROM sg JOIN counted c ON c.tau = sg.tau) WINDOW v AS (ORDER BY tau DESC)),
st AS (SELECT nN, (SELECT count(*) FROM sq) AS nP, (SELECT count(*) FROM sz) AS nK FROM total),
sr AS (SELECT *, lead(E) OVER (ORDER BY j) AS nextE FROM sc, st)
SELECT b.dett AS P2_num, st.nK AS P2_den, (SELECT CAST(sum(CASE WHEN 100 * E > nN THEN 0 WHEN 100 * nextE <= nN THEN detp * 1000 * (nextE - E) ELSE detp * (10 * nN - 1000 * E) END) AS BIGINT) FROM sr) AS P3_num,
10 * st.nP * st.nN AS P3_den FROM st, (SELECT * FROM sr WHERE 1000 * E <= 2 * nN ORDER BY j DESC LIMIT 1) b"""


@query("counted frames qs total windows", SUBSET_SQL.format(subset="SELECT scenario, s AS win FROM windows WHERE NOT carry"))
def spc_without_carry(spark, sf_dir):
    w = windows(T.timeline(spark, sf_dir)).where("not carry")
    return variant_metrics(spark, sf_dir, w).select("P2_num", "P2_den", "P3_num", "P3_den")


@query("counted frames qs total windows", SUBSET_SQL.format(subset="SELECT scenario, s AS win FROM windows WHERE track <> (SELECT track FROM windows GROUP BY track ORDER BY count(*) DESC, track LIMIT 1)"))
def spc_without_largest_track(spark, sf_dir):
    w = windows(T.timeline(spark, sf_dir))
    largest = w.groupBy("track").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "track").limit(1).select("track")
    return variant_metrics(spark, sf_dir, w.join(F.broadcast(largest), "track", "left_anti")).select("P2_num", "P2_den", "P3_num", "P3_den")


@query("rates qs zs total", """, wt AS (SELECT track, count(*) AS n FROM qs GROUP BY track),
bw AS (SELECT j, E, nN, nextE, tau FROM rates),
areas AS (SELECT q.track, q.q, w.n, (SELECT sum(CASE WHEN 100 * E > nN THEN 0 WHEN 100 * nextE <= nN THEN 1000 * (nextE - E) ELSE 10 * nN - 1000 * E END) FROM bw WHERE bw.tau <= q.q) AS area FROM qs q JOIN wt w USING (track))
SELECT track, CAST(sum(area) AS BIGINT) AS share_num, CAST(10 * any_value(n) * (SELECT nN * nK FROM total) AS BIGINT) AS share_den FROM areas GROUP BY track""")
def spc_track_balanced(spark, sf_dir):
    """Each track's part of the track-balanced P3 as an exact fraction: passes weigh 1 / (passes of their track x tracks)."""
    frames, w = kept_layout(spark, sf_dir)
    return metrics.track_shares(metrics.metric_curve(events.steps(frames), metrics.pass_scores(frames, w)), metrics.pass_scores(frames, w), metrics.sizes(frames, w))


# -- end to end: maps of two rows and eight columns, a map's pixel being twelve of the image


MAP_HEIGHT, MAP_WIDTH, PRIOR, SCALE, TAU_R = 2, 8, 0.25, 12.0, 0.4


def frame_maps(spark, sf_dir, frames: DataFrame) -> DataFrame:
    """A map for each frame: the first values of some vector."""
    v = T.table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, MAP_HEIGHT * MAP_WIDTH).alias("map"))
    n = v.agg(F.count(F.lit(1)).alias("n"))
    named = frames.select("scenario", "frame").join(F.broadcast(n)).withColumn("vec_id", F.pmod(F.col("scenario") * 7919 + F.col("frame") * 31, F.col("n")))  # one row
    return named.join(v, "vec_id").select("scenario", "frame", "map")


def pilot_parts(spark, sf_dir, **motion_options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores of all variants to six places, layout, windows)."""
    frames = durable(T.timeline(spark, sf_dir), "timeline")
    moved = durable(pilot.motion_of(frames, TAU_R, SCALE, **motion_options), "moved")
    place, w = pilot.layout_of(frames, moved)
    scores = pilot.variant_scores(frame_maps(spark, sf_dir, frames), moved, MAP_HEIGHT, MAP_WIDTH, PRIOR)
    return scores.withColumn("score", F.round("score", 6)), place, w


# sums of displacements are over at most 24 frames; a term's map is moved by whole cells
PILOT_SQL = f""", mus AS (SELECT m.scenario, m.frame, m."K", m."K" >= 2 AND EXISTS (SELECT 1 FROM walk u WHERE u.scenario = m.scenario AND u.status = 0 AND u.frame BETWEEN greatest(1, m.frame - m."K" + 2) AND m.frame) AS mu,
  m."K" >= 2 AND EXISTS (SELECT 1 FROM oracled u WHERE u.scenario = m.scenario AND u.dx_oracle IS NULL AND u.frame BETWEEN greatest(1, m.frame - m."K" + 2) AND m.frame) AS mo FROM moved m),
steps_ AS (SELECT s.*, i FROM mus s, range(0, 25) AS g(i) WHERE i < s."K"),
pairs AS (SELECT s.scenario, s.frame, s.i, o.dx_used, o.dx_oracle, o.frame AS fr FROM steps_ s JOIN oracled o ON o.scenario = s.scenario AND o.frame BETWEEN s.frame - s.i + 1 AND s.frame),
us AS (SELECT scenario, frame, i, floor(-sum(dx_used / {SCALE} / 8.0::DOUBLE ORDER BY fr) + 0.5::DOUBLE) AS u, floor(-sum(dx_oracle / {SCALE} / 8.0::DOUBLE ORDER BY fr) + 0.5::DOUBLE) AS uo FROM pairs GROUP BY ALL),
plan AS (SELECT s.*, coalesce(u.u, 0) AS u, coalesce(u.uo, 0) AS uo FROM steps_ s LEFT JOIN us u ON u.scenario = s.scenario AND u.frame = s.frame AND u.i = s.i),
terms AS (
  SELECT scenario, frame, 'V2' AS variant, frame - i AS src, 0 AS shift, "K" FROM plan
  UNION ALL SELECT scenario, frame, 'V4', frame - i, CASE WHEN mu THEN 0 ELSE u END, "K" FROM plan
  UNION ALL SELECT scenario, frame, 'REV', frame - i, CASE WHEN mu THEN 0 ELSE -u END, "K" FROM plan
  UNION ALL SELECT scenario, frame, 'LAG', frame - CASE WHEN mu OR i = 0 OR "K" <= 2 THEN i ELSE i % ("K" - 1) + 1 END, CASE WHEN mu THEN 0 ELSE u END, "K" FROM plan
  UNION ALL SELECT scenario, frame, 'ORA', frame - i, CASE WHEN mo THEN 0 ELSE uo END, "K" FROM plan),
fmap AS (SELECT t.scenario, t.frame, e.embedding[1:{MAP_HEIGHT * MAP_WIDTH}] AS m FROM timeline t JOIN embeddings e ON e.vec_id = (t.scenario * 7919 + t.frame * 31) % (SELECT count(*) FROM embeddings)),
cellsums AS (SELECT t.variant, t.scenario, t.frame, c.cell, CAST(sum(CASE WHEN c.cell % {MAP_WIDTH} + t.shift BETWEEN 0 AND {MAP_WIDTH - 1} THEN CAST(f.m[CAST(c.cell + t.shift + 1 AS BIGINT)] AS DOUBLE) ELSE {PRIOR}::DOUBLE END) / any_value(t."K") AS FLOAT) AS v
  FROM terms t JOIN fmap f ON f.scenario = t.scenario AND f.frame = t.src, range(0, {MAP_HEIGHT * MAP_WIDTH}) AS c(cell) GROUP BY t.variant, t.scenario, t.frame, c.cell),
tops AS (SELECT scenario, frame, CAST(list_max(m) AS DOUBLE) AS s FROM fmap),
scored AS (SELECT variant, scenario, frame, round(CAST(max(v) AS DOUBLE), 6) AS score FROM cellsums GROUP BY ALL
  UNION ALL SELECT 'V0', scenario, frame, round(s, 6) FROM tops
  UNION ALL SELECT 'V1', m.scenario, m.frame, round(sum(t.s) / any_value(m."K"), 6) FROM moved m JOIN tops t ON t.scenario = m.scenario AND t.frame BETWEEN m.frame - m."K" + 1 AND m.frame GROUP BY m.scenario, m.frame),
rf AS (SELECT s.variant AS b, s.scenario, s.frame, s.score, f.normal, f.seg, f.win, f.track FROM scored s JOIN frames f USING (scenario, frame)),
"""
ADAPTIVE = {"lengths": ("moved", 'SELECT scenario, frame, "K" AS K FROM moved')}


@query("moved oracled walk frames windows total", PILOT_SQL + BY_SQL + """
SELECT b AS variant, CAST(least(1000 * min(E) FILTER (WHERE 5 * detp >= 4 * nP), 50 * any_value(nN)) AS BIGINT) AS P1_num, any_value(nN) AS P1_den, 1000 * min(E) FILTER (WHERE 5 * detp >= 4 * nP) > 50 * any_value(nN) AS P1_censored,
CAST(max(dett) FILTER (WHERE 1000 * E <= 2 * nN) AS BIGINT) AS P2_num, any_value(nK) AS P2_den, (SELECT P3_num FROM rp WHERE rp.b = rr.b) AS P3_num, 10 * any_value(nP) * any_value(nN) AS P3_den,
20 * max(detp) FILTER (WHERE 1000 * E <= 2 * nN) >= 19 * any_value(nP) AS saturated FROM rr GROUP BY b""", **ADAPTIVE)
def e2e_metrics(spark, sf_dir):
    """Raw frames to motion, adaptive windows, seven variants and their metrics."""
    return pilot.evaluate(*pilot_parts(spark, sf_dir))[0]


@query("moved oracled walk frames windows total", PILOT_SQL + BY_SQL + """,
vc AS (SELECT b, scenario, seg, tau, CAST(sum((e - a + 25) // 25) AS BIGINT) AS c FROM rs GROUP BY ALL),
vd AS (SELECT b, tau, sum(d) AS d FROM (SELECT b, tau, c - lag(c, 1, 0) OVER (PARTITION BY b, scenario, seg ORDER BY tau DESC) AS d FROM vc WHERE scenario = 3) GROUP BY ALL UNION ALL SELECT DISTINCT b, 'Infinity'::DOUBLE, 0 FROM rf),
ve AS (SELECT b, tau, max(C) OVER (PARTITION BY b ORDER BY tau DESC) AS E FROM (SELECT b, tau, sum(d) OVER (PARTITION BY b ORDER BY tau DESC) AS C FROM vd)),
th AS (SELECT b, min(tau) AS threshold FROM ve WHERE 1000 * E <= 2 * (SELECT count(*) FROM frames WHERE normal AND scenario = 3) GROUP BY b),
tc AS (SELECT b, scenario, seg, min(tau) AS tau FROM vc JOIN th USING (b) WHERE tau >= threshold AND scenario <> 3 GROUP BY ALL)
SELECT th.b AS variant, threshold, CAST(coalesce((SELECT sum(c) FROM vc JOIN tc USING (b, scenario, seg, tau) WHERE vc.b = th.b), 0) AS BIGINT) AS events,
(SELECT count(*) FROM rq WHERE rq.b = th.b AND rq.scenario <> 3 AND rq.q >= threshold) AS passes, (SELECT count(DISTINCT track) FROM rq WHERE rq.b = th.b AND rq.scenario <> 3 AND rq.q >= threshold) AS tracks,
(SELECT count(*) FROM frames WHERE normal AND scenario <> 3) AS nN FROM th""", **ADAPTIVE)
def e2e_deployment(spark, sf_dir):
    """Thresholds of the seven variants on one scenario without its passes, applied to the others."""
    scores, place, w = pilot_parts(spark, sf_dir)
    return pilot.deployment(pilot.evaluate(scores, place, w)[1], F.col("scenario") == 3)


SENSITIVITY = {"k5": {"fixed_length": 5}, "k10": {"fixed_length": 10}, "k20": {"fixed_length": 20}, "k_half": {"factor": 0.5}, "k_double": {"factor": 2.0}, "shift_half": {"shift_factor": 0.5}, "shift_more": {"shift_factor": 1.5}}


@query("moved walk", """SELECT x.scenario, x.frame, least(5, x.frame) AS k5, least(10, x.frame) AS k10, least(20, x.frame) AS k20, CAST(least(greatest(floor(k_full * 0.5::DOUBLE + 0.5::DOUBLE), 1), 25, x.frame) AS INTEGER) AS k_half,
CAST(least(greatest(floor(k_full * 2.0::DOUBLE + 0.5::DOUBLE), 1), 25, x.frame) AS INTEGER) AS k_double, "K" AS shift_half, "K" AS shift_more FROM moved x""")
def spc_fixed_lengths(spark, sf_dir):
    """Window lengths of each sensitivity analysis, all of one table of statuses: K does not depend on the scale of shifts."""
    rows = motion.window_lengths(durable(motion.statuses(T.timeline(spark, sf_dir), TAU_R), "statuses"))
    lengths_ = {name: {k: v for k, v in options.items() if k != "shift_factor"} for name, options in SENSITIVITY.items()}
    return rows.select("scenario", "frame", *(pilot.length_of(**options).alias(name) for name, options in lengths_.items()))


@query()
def spc_sensitivity(spark, sf_dir):
    """Metrics of all variants for each window length and scale of shifts of the sensitivity analyses."""
    out = None
    for name, options in SENSITIVITY.items():
        one = pilot.evaluate(*pilot_parts(spark, sf_dir, **options))[0].withColumn("analysis", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("counted frames qs total windows timeline", SUBSET_SQL.format(subset="SELECT w.scenario, w.s AS win FROM windows w WHERE EXISTS (SELECT 1 FROM timeline t WHERE t.scenario = w.scenario AND t.frame BETWEEN w.s AND w.e AND t.label = 4 AND t.frame % 2 = 0)"))
def spc_label_subset(spark, sf_dir):
    """P2 and P3 of the passes that show label 4 (on an even frame, as all defects of this timeline have it)."""
    frames = T.timeline(spark, sf_dir).withColumn("label", F.when((F.col("label") == 4) & (F.col("frame") % 2 == 1), 5).otherwise(F.col("label")))
    w = intervals.with_label(windows(T.timeline(spark, sf_dir)), frames, 4)
    return variant_metrics(spark, sf_dir, w).select("P2_num", "P2_den", "P3_num", "P3_den")


@query()
def spc_block_intervals(spark, sf_dir):
    """The same intervals with fixed blocks of 600 frames in place of 1,200."""
    scores, place, w = pilot_parts(spark, sf_dir)
    frames = pilot.evaluate(scores, place, w)[1].where(F.col("variant").isin("V1", "V2", "V4", "REV", "LAG"))
    units = intervals.blocks(phased(spark, sf_dir, place).drop("block"), 600)
    return inference.fold_intervals(frames, units.select("scenario", "frame", "phase_bin", "block")).where("scheme = 'B'").drop("LB9")


@query()
def inf_fold_intervals(spark, sf_dir):
    """Intervals of the fold's differences and its lower bound, from 2,000 drawn replicates of two schemes."""
    scores, place, w = pilot_parts(spark, sf_dir)
    frames = pilot.evaluate(scores, place, w)[1].where(F.col("variant").isin("V1", "V2", "V4", "REV", "LAG"))
    return inference.fold_intervals(frames, phased(spark, sf_dir, place).select("scenario", "frame", "phase_bin", "block"))


@query("held", """, v AS (SELECT scenario, win, track, score, avg(score) OVER (PARTITION BY scenario ORDER BY frame ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS v1 FROM held),
z AS (SELECT track, max(score) >= 60 AS a, max(v1) >= 30 AS b FROM v WHERE win IS NOT NULL GROUP BY track),
n AS (SELECT count(*) FILTER (WHERE a AND NOT b) AS b, count(*) FILTER (WHERE b AND NOT a) AS c FROM z)
SELECT b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(gamma(b + c + 1.0) / gamma(i + 1.0) / gamma(b + c - i + 1.0)) FROM range(greatest(b, c), b + c + 1) AS r(i)) / power(2.0::DOUBLE, b + c)) END, 9) AS p FROM n""")
def spc_mcnemar(spark, sf_dir):
    """Exact test of the tracks found by the score at 60 and by its trailing mean at 30."""
    frames, w = kept_layout(spark, sf_dir)
    rows = temporal.trailing_mean(frames.withColumn("K", F.least(F.lit(7), "frame")))
    a = metrics.track_scores(metrics.pass_scores(rows, w)).withColumnRenamed("z", "za")
    b = metrics.track_scores(metrics.pass_scores(rows.withColumn("score", F.col("V1")), w)).withColumnRenamed("z", "zb")
    both = a.join(b, "track").agg(F.count_if((F.col("za") >= 60) & (F.col("zb") < 30)).alias("b"), F.count_if((F.col("za") < 60) & (F.col("zb") >= 30)).alias("c"))
    test = F.udf(lambda x, y: inference.mcnemar(x, y), "double")  # one row
    return both.withColumn("p", F.round(test("b", "c"), 9))


def event_classes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Classified alarm runs of the maps, and the maps."""
    from loomframe.operators import decompose

    rows = maps(spark, sf_dir)
    base = durable(decompose.one_map(temporal.baselines(as_cells(spark, sf_dir), 8, 8, ["frame"]), 8), "base")
    frames = metrics.frame_scores(rows).withColumn("normal", F.lit(True)).withColumn("seg", F.lit(0).cast("long"))
    runs = events.runs_at(frames, EVENT_TAU).withColumn("K", F.lit(7))
    moves = rows.withColumn("move", F.when(F.pmod("frame", F.lit(9)) != 0, F.lit(-1.0)))
    got = decompose.classes(runs, moves, base, 8, 8, EVENT_TAU, decompose.Limits(null_row_offset=3))
    return got.join(runs.select("scenario", "a", "b"), ["scenario", "a"]), rows


EVENT_TAU = 0.35
# the same cascade; the 3 x 3 maxima are joined for the cells of the path
CLASSES_SQL = f""", peaks AS (SELECT frame, max(value) AS score, quantile_cont(value, 0.5) AS med FROM cells GROUP BY frame),
runs AS (SELECT min(frame) AS a, max(frame) AS b FROM (SELECT frame, sum(o) OVER (ORDER BY frame) AS run FROM (SELECT frame, CASE WHEN frame - lag(frame) OVER (ORDER BY frame) <= 3 THEN 0 ELSE 1 END AS o FROM peaks WHERE score >= {EVENT_TAU}::DOUBLE)) GROUP BY run),
m3 AS (SELECT x.frame, x."row", x.col, max(y.value) AS value FROM cells x JOIN cells y ON x.frame = y.frame AND abs(x."row" - y."row") <= 1 AND abs(x.col - y.col) <= 1 GROUP BY ALL),
b1 AS (SELECT "row", col, avg(value) AS v FROM cells GROUP BY ALL), b3 AS (SELECT "row", col, avg(value) AS v FROM m3 GROUP BY ALL), lv AS (SELECT quantile_cont(v, 0.5) AS level FROM b1),
place AS (SELECT r.a, r.b, c."row" AS y, c.col AS x0, c.value AS top, p.med FROM runs r JOIN peaks p ON p.frame = r.a JOIN cells c ON c.frame = r.a AND c.value = p.score QUALIFY row_number() OVER (PARTITION BY r.a ORDER BY c."row", c.col) = 1),
top AS (SELECT p.*, p.top - b1.v AS peak, lv.level, p.top - (p.med - lv.level) < {EVENT_TAU}::DOUBLE AS driven FROM place p JOIN b1 ON b1."row" = p.y AND b1.col = p.x0, lv),
path AS (SELECT t.a, t.y, t.x0, t.peak, j, t.x0 - j AS x FROM top t, range(1, 8) AS g(j) WHERE t.a + j <= (SELECT max(frame) FROM cells) AND t.x0 - j >= 0
  AND NOT EXISTS (SELECT 1 FROM range(1, 8) AS h(i) WHERE i <= j AND (t.a + i) % 9 = 0)),
rise AS (SELECT p.a, p.j, p.x, p.x0, (m.value - b.v) / p.peak AS moving, (f.value - fb.v) / p.peak AS fixed,
  (SELECT avg((n.value - nb.v) / p.peak) FROM m3 n JOIN b3 nb ON nb."row" = n."row" AND nb.col = n.col WHERE n.frame = p.a + p.j AND n.col = p.x AND n."row" IN (p.y - 3, p.y + 3)) AS beside
  FROM path p JOIN m3 m ON m.frame = p.a + p.j AND m."row" = p.y AND m.col = p.x JOIN b3 b ON b."row" = p.y AND b.col = p.x
  JOIN m3 f ON f.frame = p.a + p.j AND f."row" = p.y AND f.col = p.x0 JOIN b3 fb ON fb."row" = p.y AND fb.col = p.x0),
facts AS (SELECT a, count(*) AS n, bool_and(abs(x - x0) <= 1) AS still, quantile_cont(moving, 0.5) AS moving, quantile_cont(fixed, 0.5) AS fixed, quantile_cont(beside, 0.5) AS beside FROM rise GROUP BY a),
classed AS (SELECT t.a, t.b, CASE WHEN driven THEN 'global-driven' WHEN coalesce(n, 0) < 3 OR peak < 0.1::DOUBLE * ({EVENT_TAU}::DOUBLE - level) THEN 'ambiguous-geometry' WHEN still THEN 'ambiguous-coincident' WHEN beside >= 0.25 THEN 'diffuse'
  WHEN fixed >= 0.5 AND fixed - beside >= 0.25 AND fixed > moving THEN 'camera-fixed' WHEN moving >= 0.5 AND moving - beside >= 0.25 THEN 'persistent-local' WHEN moving < 0.25 AND fixed < 0.25 THEN 'transient' ELSE 'ambiguous' END AS class
  FROM top t LEFT JOIN facts f ON f.a = t.a)"""


@query("cells", CLASSES_SQL + " SELECT class, count(*) AS n FROM classed GROUP BY class")
def spc_event_classes(spark, sf_dir):
    """Classes of alarm runs on the maps, and how many of each."""
    return event_classes(spark, sf_dir)[0].groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("cells", CLASSES_SQL + """, v AS (SELECT frame, (score + coalesce(lag(score) OVER (ORDER BY frame), score)) / 2 AS score FROM peaks),
other AS (SELECT min(frame) AS a, max(frame) AS b FROM (SELECT frame, sum(o) OVER (ORDER BY frame) AS run FROM (SELECT frame, CASE WHEN frame - lag(frame) OVER (ORDER BY frame) <= 3 THEN 0 ELSE 1 END AS o FROM v WHERE score >= 0.45::DOUBLE)) GROUP BY run)
SELECT class, count(*) AS n, CAST(count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM other o WHERE o.a <= classed.b AND o.b >= classed.a)) AS BIGINT) AS removed FROM classed GROUP BY class""")
def spc_removal_rates(spark, sf_dir):
    """Of each class, the events that no run of the mean of two frames touches."""
    from loomframe.operators import decompose

    found, rows = event_classes(spark, sf_dir)
    w = Window.partitionBy("scenario").orderBy("frame")
    mean = metrics.frame_scores(rows).withColumn("score", (F.col("score") + F.coalesce(F.lag("score").over(w), F.col("score"))) / 2)
    other = events.runs_at(mean.withColumn("normal", F.lit(True)).withColumn("seg", F.lit(0).cast("long")), 0.45)
    return decompose.removal(found, other)


# -- generators and streaming


@query()
def gen_null_traces(spark, sf_dir):
    return synth.traces(spark, "N8_composite", 4, [(0, 300, 40), (1, 200, 30)])


@query()
def gen_motion_calibration(spark, sf_dir):
    """Criteria of the two-frame motion rule on synthetic traces."""
    return synth.motion_criteria(synth.motion_calibration(durable(synth.motion_traces(spark, 8), "motion-traces")))


@query("timeline", "SELECT scenario, CAST(frame AS BIGINT) AS frame, round(avg(score) OVER (PARTITION BY scenario ORDER BY frame ROWS BETWEEN 8 PRECEDING AND CURRENT ROW), 6) AS v FROM timeline")
def gen_moving_average(spark, sf_dir):
    rows = pilot.trailing_mean_by_scenario(T.timeline(spark, sf_dir), 9)
    return rows.select("scenario", F.col("frame").cast("long").alias("frame"), F.round("v", 6).alias("v"))


STREAM_SQL = """SELECT m.scenario, m.frame, m.status, m.dx_used, m.k_full, m."K" AS k_used, t.score AS v0, round((SELECT sum(x.score) FROM timeline x WHERE x.scenario = m.scenario AND x.frame BETWEEN m.frame - m."K" + 1 AND m.frame) / m."K", 6) AS v1
FROM moved m JOIN timeline t USING (scenario, frame)"""


@query("moved timeline", STREAM_SQL)
def str_causal_scores(spark, sf_dir):
    """A replayed stream through the stateful operators, all of it."""
    import uuid

    from loomframe.session import work_dir
    from loomframe.streaming import scores

    frames = durable(T.timeline(spark, sf_dir), "stream-frames")
    top = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    scores.replay(frames, f"{top}/in", 2)
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
    run = scores.causal_scores(stream, 0.4).writeStream.format("parquet").option("checkpointLocation", f"{top}/state").outputMode("append").trigger(availableNow=True).start(f"{top}/out")
    run.awaitTermination()
    out = spark.read.parquet(f"{top}/out")
    return out.select("scenario", "frame", "status", "dx_used", "k_full", F.col("K").alias("k_used"), F.col("V0").alias("v0"), F.round("V1", 6).alias("v1"))


# -- acceptance checks and reports


@query("cells", """SELECT 0 AS scenario, CAST(f.frame AS INTEGER) AS frame, CAST(f.u AS INTEGER) AS u, coalesce(max(x.ef) < max(x.er), false) AS holds, round(max(x.ef), 9) AS forward, round(max(x.er), 9) AS backward
FROM (SELECT DISTINCT frame, frame % 4 + 1 AS u FROM cells WHERE frame > 1) f LEFT JOIN (
SELECT a.frame, avg((a.value - p.value) ** 2) AS ef, avg((a.value - m.value) ** 2) AS er FROM cells a
JOIN cells p ON p.frame = a.frame - 1 AND p."row" = a."row" AND p.col = a.col + (a.frame % 4 + 1)
JOIN cells m ON m.frame = a.frame - 1 AND m."row" = a."row" AND m.col = a.col - (a.frame % 4 + 1)
GROUP BY a.frame) x ON x.frame = f.frame WHERE f.u < 4 GROUP BY f.frame, f.u""")
def acc_direction_check(spark, sf_dir):
    from loomframe.operators import acceptance

    rows = maps(spark, sf_dir)
    pairs = rows.where("frame > 1").select("scenario", "frame", (F.pmod("frame", F.lit(4)) + 1).cast("int").alias("u")).where("u < 4")
    got = acceptance.direction_check(pairs, rows, 8, 8)
    return got.select("scenario", "frame", "u", "holds", F.round("forward", 9).alias("forward"), F.round("backward", 9).alias("backward"))


@query("", "SELECT round(max(e) / max(m), 9) AS rel FROM (SELECT list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x * 0.001))) AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS m FROM embeddings)")
def acc_array_error(spark, sf_dir):
    from loomframe.operators import acceptance

    v = T.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    other = v.withColumn("x", F.transform("x", lambda x: x + x * 0.001))
    return acceptance.array_error(other, v, ["vec_id"], "x").select(F.round("rel", 9).alias("rel"))


@query("cells", """SELECT name, round(rel, 9) AS rel, rel <= 0.0001::DOUBLE AS agrees FROM (
SELECT 'mu0' AS name, abs(avg(v) - avg(value)) / abs(avg(value)) AS rel FROM (SELECT value, value * CASE WHEN frame % 2 = 0 THEN 1.00001::DOUBLE ELSE 1.0::DOUBLE END AS v FROM cells)
UNION ALL SELECT 'tau_cell', abs(quantile_cont(v, 0.999) - quantile_cont(value, 0.999)) / abs(quantile_cont(value, 0.999)) FROM (SELECT value, value * CASE WHEN frame % 2 = 0 THEN 1.00001::DOUBLE ELSE 1.0::DOUBLE END AS v FROM cells))""")
def acc_constants(spark, sf_dir):
    """Constants of maps that are a little larger in every second frame."""
    from loomframe.operators import acceptance

    own = maps(spark, sf_dir).withColumn("map", F.col("map").cast("array<double>"))
    more = F.when(F.pmod("frame", F.lit(2)) == 0, F.lit(1.00001)).otherwise(F.lit(1.0))
    other = own.withColumn("map", F.transform("map", lambda x: x * more))
    got = acceptance.constants_agree(temporal.map_constants(other), temporal.map_constants(own))
    return got.withColumn("rel", F.round("rel", 9))


@query("", "SELECT count(*) AS rows, count(*) FILTER (WHERE vec_id % 9 = 0) AS different FROM embeddings")
def acc_identical(spark, sf_dir):
    from loomframe.operators import acceptance

    v = T.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = v.withColumn("embedding", F.when(F.col("vec_id") % 9 == 0, F.transform("embedding", lambda x: x + F.lit(0.5))).otherwise(F.col("embedding")))
    return acceptance.identical(v, other.withColumn("embedding", F.col("embedding").cast("array<float>")), ["vec_id"], "embedding")


@query("", "SELECT o_orderpriority AS module, count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY o_orderpriority")
def agg_status_rollup(spark, sf_dir):
    from loomframe.operators import acceptance

    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("module"), F.col("o_orderstatus").alias("status"))
    return acceptance.status_rollup(o, ("O", "F", "P"))


@query("seg_runs frames qs total", "SELECT (SELECT CAST(sum((b - a + 25) // 25) AS BIGINT) FROM (SELECT r.* FROM seg_runs r JOIN (SELECT scenario, seg, min(score) AS tau FROM frames WHERE normal AND score >= 40 GROUP BY scenario, seg) m USING (scenario, seg, tau))) AS events, (SELECT count(*) FROM qs WHERE q >= 40) AS passes, (SELECT count(DISTINCT track) FROM qs WHERE q >= 40) AS tracks, nN, nP, nK FROM total")
def spc_deployment_table(spark, sf_dir):
    frames, w = kept_layout(spark, sf_dir)
    return metrics.at_threshold(frames, w, 40.0)


@query("", STATES_SQL.split("e AS (SELECT", 1)[0].rstrip(", \n") + " SELECT l_orderkey, l_linenumber, CASE WHEN g >= 20 THEN CAST(round(1000000000::DOUBLE * (n // 43 % 40 - 10) / g) AS BIGINT) END AS share9 FROM d")
def spc_oracle_share(spark, sf_dir):
    n = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    rows = fold_states(spark, sf_dir).withColumn("P3_ORA", F.col("P3_V4") + F.pmod(F.floor(n / 43), F.lit(40)) - 10)
    return decision.oracle_share9(rows).select("l_orderkey", "l_linenumber", F.col("oracle_share9").alias("share9"))
