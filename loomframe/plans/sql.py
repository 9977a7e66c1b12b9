"""The same queries in ANSI SQL, as common table expressions that build on each other."""

from __future__ import annotations

#: name: (needed expressions, body)
PARTS: dict[str, tuple[str, str]] = {
    "raw": ("", """SELECT event_id, ts, CAST(user_id % 4 AS INTEGER) AS scenario, event_type, value,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS kk FROM events"""),
    "numbered": ("raw", "SELECT *, CAST(row_number() OVER (PARTITION BY scenario ORDER BY ts, event_id) AS INTEGER) AS frame FROM raw"),
    "timeline": ("numbered", """SELECT scenario, frame, value AS score,
        CASE WHEN event_type = 'error' AND kk >= 90 THEN 4 WHEN event_type = 'signup' AND kk < 10 THEN 2 ELSE 1 END AS label,
        CASE WHEN frame > 1 THEN CAST(-(100 + ((event_id * 7919) % 41) - 20) AS DOUBLE) END AS dx,
        CASE WHEN frame > 1 THEN CAST((event_id % 7) - 3 AS DOUBLE) END AS dy,
        CASE WHEN frame > 1 THEN kk / 100.0::DOUBLE END AS r, frame > 1 AS has_est FROM numbered"""),
    "opened": ("timeline", "SELECT *, CASE WHEN label >= 3 AND coalesce(lag(label) OVER (PARTITION BY scenario ORDER BY frame), 0) < 3 THEN 1 ELSE 0 END AS opens FROM timeline"),
    "passes": ("opened", """SELECT scenario, CAST(ordinal AS BIGINT) AS ordinal, min(frame) AS s, max(frame) AS e, scenario || '-' || (CAST(ordinal AS BIGINT) % 5) AS track
        FROM (SELECT *, sum(opens) OVER (PARTITION BY scenario ORDER BY frame) AS ordinal FROM opened) WHERE label >= 3 GROUP BY scenario, ordinal"""),
    "lengths": ("timeline", "SELECT scenario, frame, least(7, frame) AS K FROM timeline"),
    "spans": ("timeline", "SELECT scenario, max(frame) AS N FROM timeline GROUP BY scenario"),
    "ordered": ("passes spans", "SELECT p.*, n.N, lead(s) OVER w AS nxt, lag(e) OVER w AS prv FROM passes p JOIN spans n USING (scenario) WINDOW w AS (PARTITION BY scenario ORDER BY s)"),
    "reach": ("ordered lengths", """SELECT o.scenario, o.s, max(l.frame) AS g FROM ordered o JOIN lengths l ON l.scenario = o.scenario
        AND l.frame BETWEEN o.e AND least(o.e + 24, o.N) AND l.frame - l.K + 1 <= o.e GROUP BY o.scenario, o.s"""),
    "windows": ("ordered reach lengths", """SELECT o.scenario, o.ordinal, o.track, o.s, o.e, o.s AS lo,
        least(greatest(o.e, coalesce(r.g, o.e)), coalesce(o.nxt - 1, o.N), o.N) AS hi, coalesce(o.s - l.K + 1 <= o.prv, false) AS carry
        FROM ordered o LEFT JOIN reach r ON r.scenario = o.scenario AND r.s = o.s JOIN lengths l ON l.scenario = o.scenario AND l.frame = o.s"""),
    "held": ("timeline windows", """SELECT t.*, w.s AS win, w.track, (t.label IN (1, 2) AND w.s IS NULL) AS normal FROM timeline t
        LEFT JOIN windows w ON w.scenario = t.scenario AND t.frame BETWEEN w.lo AND w.hi"""),
    "frames": ("held", "SELECT *, CAST(sum(CASE WHEN normal THEN 0 ELSE 1 END) OVER (PARTITION BY scenario ORDER BY frame) AS BIGINT) AS seg FROM held"),
    "consistent": ("timeline", """SELECT *, abs(dx) <= 400 AND abs(dy) <= 16 AND (n < 5 OR abs(dx - med) <= greatest(8.0::DOUBLE, 0.2::DOUBLE * abs(med))) AS consistent FROM (
        SELECT *, quantile_cont(dx, 0.5) OVER w AS med, count(dx) OVER w AS n FROM timeline WHERE has_est
        WINDOW w AS (PARTITION BY scenario ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING))"""),
    "sums": ("timeline", """SELECT *, CASE WHEN has_est AND lag(has_est) OVER w THEN dx + lag(dx) OVER w END AS s2 FROM timeline WINDOW w AS (PARTITION BY scenario ORDER BY frame)"""),
    "sum_flags": ("sums", """SELECT *, abs(dx) <= 400 AND abs(dy) <= 16 AND (s2 IS NULL OR n < 5 OR abs(s2 - med) <= greatest(8.0::DOUBLE, 0.2::DOUBLE * abs(med) / 2)) AS consistent FROM (
        SELECT *, quantile_cont(s2, 0.5) OVER w AS med, count(s2) OVER w AS n FROM sums WHERE has_est
        WINDOW w AS (PARTITION BY scenario, s2 IS NOT NULL ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING))"""),
    # one step a frame for all scenarios together; hist holds accepted values only
    "walk": ("timeline", """SELECT t.scenario, t.frame, 0 AS status, NULL::DOUBLE AS dx_used, []::DOUBLE[] AS hist, NULL::DOUBLE AS last_dx, NULL::INTEGER AS last_frame
          FROM timeline t WHERE t.frame = 1
        UNION ALL
        SELECT scenario, frame, CASE WHEN ok THEN 2 WHEN frame - last_frame <= 5 THEN 1 ELSE 0 END,
          CASE WHEN ok THEN dx WHEN frame - last_frame <= 5 THEN last_dx END,
          CASE WHEN ok THEN list_append(hist, dx)[-15:] ELSE hist END, CASE WHEN ok THEN dx ELSE last_dx END, CASE WHEN ok THEN frame ELSE last_frame END
        FROM (SELECT t.scenario, t.frame, t.dx, w.hist, w.last_dx, w.last_frame,
            coalesce(t.r >= 0.4::DOUBLE AND abs(t.dx) <= 400 AND abs(t.dy) <= 16 AND (len(w.hist) < 5
              OR abs(t.dx - list_median(w.hist)) <= greatest(8.0::DOUBLE, 0.2::DOUBLE * abs(list_median(w.hist)))), false) AS ok
          FROM walk w JOIN timeline t ON t.scenario = w.scenario AND t.frame = w.frame + 1)"""),
    "walk_sum": ("timeline", """SELECT t.scenario, t.frame, 0 AS status, NULL::DOUBLE AS dx_used, []::DOUBLE[] AS hist, NULL::DOUBLE AS last_dx, NULL::INTEGER AS last_frame, false AS basic, t.dx AS dx
          FROM timeline t WHERE t.frame = 1
        UNION ALL
        SELECT scenario, frame, CASE WHEN ok THEN 2 WHEN frame - last_frame <= 5 THEN 1 ELSE 0 END,
          CASE WHEN ok THEN dx WHEN frame - last_frame <= 5 THEN last_dx END,
          CASE WHEN ok THEN list_append(hist, s)[-15:] ELSE hist END, CASE WHEN ok THEN dx ELSE last_dx END, CASE WHEN ok THEN frame ELSE last_frame END, basic, dx
        FROM (SELECT *, basic AND before AND (len(hist) < 5 OR abs(s - list_median(hist)) <= greatest(8.0::DOUBLE, 0.2::DOUBLE * abs(list_median(hist)) / 2)) AS ok
          FROM (SELECT t.scenario, t.frame, t.dx, t.dx + w.dx AS s, w.hist, w.last_dx, w.last_frame, w.basic AS before,
            coalesce(t.r >= 0.2::DOUBLE AND abs(t.dx) <= 400 AND abs(t.dy) <= 16, false) AS basic
          FROM walk_sum w JOIN timeline t ON t.scenario = w.scenario AND t.frame = w.frame + 1))"""),
    "reliable": ("walk", """SELECT scenario, frame, quantile_cont(abs(dx_used), 0.5) OVER (PARTITION BY scenario ORDER BY frame ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS m,
        row_number() OVER (PARTITION BY scenario ORDER BY frame) AS c FROM walk WHERE status = 2"""),
    "carried": ("walk reliable", """SELECT w.scenario, w.frame, w.status, w.dx_used, last_value(r.m IGNORE NULLS) OVER u AS m, coalesce(last_value(r.c IGNORE NULLS) OVER u, 0) AS c
        FROM walk w LEFT JOIN reliable r USING (scenario, frame) WINDOW u AS (PARTITION BY w.scenario ORDER BY w.frame)"""),
    "moved": ("carried", """SELECT scenario, frame, status, dx_used, k_full, least(k_full, frame) AS "K" FROM (SELECT *, CAST(CASE WHEN c < 5 THEN 10 WHEN m = 0 THEN 25
        ELSE least(greatest(floor(800.0::DOUBLE / m + 0.5::DOUBLE), 3), 25) END AS INTEGER) AS k_full FROM carried)"""),
    "oracled": ("moved", """SELECT *, CASE WHEN count(v) OVER w >= 5 THEN quantile_cont(v, 0.5) OVER w END AS dx_oracle FROM (SELECT *, CASE WHEN status = 2 THEN dx_used END AS v FROM moved)
        WINDOW w AS (PARTITION BY scenario ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)"""),
    "starts": ("timeline", """SELECT scenario, frame AS a, row_number() OVER (PARTITION BY scenario ORDER BY frame) AS i FROM (
        SELECT *, lag(label) OVER (PARTITION BY scenario ORDER BY frame) AS p FROM timeline) WHERE label IN (2, 5) AND coalesce(p NOT IN (2, 5), true)"""),
    "chosen": ("starts", """SELECT scenario, a, i, true AS taken, a AS last FROM starts WHERE i = 1
        UNION ALL SELECT s.scenario, s.a, s.i, 2 * (s.a - c.last) >= 300 + 20 * s.scenario, CASE WHEN 2 * (s.a - c.last) >= 300 + 20 * s.scenario THEN s.a ELSE c.last END
        FROM chosen c JOIN starts s ON s.scenario = c.scenario AND s.i = c.i + 1"""),
    "phased": ("timeline chosen", """SELECT t.*, (((t.frame - x.anchor) % p) + p) % p AS phase FROM (SELECT *, 300 + 20 * scenario AS p FROM timeline) t
        JOIN (SELECT t.scenario, t.frame, coalesce(max(c.a) FILTER (WHERE c.a <= t.frame), min(c.a), 1) AS anchor FROM timeline t
          LEFT JOIN chosen c ON c.scenario = t.scenario AND c.taken GROUP BY t.scenario, t.frame) x USING (scenario, frame)"""),
    "cells": ("", """SELECT vec_id + 1 AS frame, CAST((i - 1) // 8 AS INTEGER) AS "row", CAST((i - 1) % 8 AS INTEGER) AS col, CAST(embedding[i] AS DOUBLE) AS value
        FROM embeddings, range(1, 65) AS g(i)"""),
    "grid": ("frames", """SELECT DISTINCT tau FROM (SELECT score AS tau FROM frames WHERE normal
        UNION ALL SELECT max(score) FROM frames WHERE win IS NOT NULL GROUP BY scenario, win) UNION ALL SELECT 'Infinity'::DOUBLE"""),
    # no run crosses a frame outside the normal set, so runs are found for each segment at each of its own scores
    "seg_runs": ("frames", """SELECT scenario, seg, tau, min(frame) AS a, max(frame) AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY scenario, seg, tau ORDER BY frame) AS run FROM (
        SELECT g.tau, c.scenario, c.seg, c.frame, CASE WHEN c.frame - lag(c.frame) OVER w <= 3 THEN 0 ELSE 1 END AS opens
        FROM (SELECT DISTINCT scenario, seg, score AS tau FROM frames WHERE normal) g JOIN frames c ON c.normal AND c.scenario = g.scenario AND c.seg = g.seg AND c.score >= g.tau
        WINDOW w AS (PARTITION BY g.scenario, g.seg, g.tau ORDER BY c.frame))) GROUP BY scenario, seg, tau, run"""),
    "seg_counts": ("seg_runs", "SELECT scenario, seg, tau, sum((b - a + 25) // 25) AS c, count(*) AS u FROM seg_runs GROUP BY scenario, seg, tau"),
    "deltas": ("seg_counts", """SELECT tau, sum(dc) AS dc, sum(du) AS du FROM (SELECT tau, c - lag(c, 1, 0) OVER w AS dc, u - lag(u, 1, 0) OVER w AS du FROM seg_counts
        WINDOW w AS (PARTITION BY scenario, seg ORDER BY tau DESC)) GROUP BY tau"""),
    "counted": ("grid deltas", """SELECT g.tau, CAST(coalesce(sum(d.dc) OVER w, 0) AS BIGINT) AS C, CAST(coalesce(sum(d.du) OVER w, 0) AS BIGINT) AS U FROM grid g LEFT JOIN deltas d ON d.tau = g.tau
        WINDOW w AS (ORDER BY g.tau DESC)"""),
    "qs": ("frames", "SELECT scenario, win, track, max(score) AS q FROM frames WHERE win IS NOT NULL GROUP BY scenario, win, track"),
    "zs": ("qs", "SELECT track, max(q) AS z FROM qs GROUP BY track"),
    "curve": ("counted qs zs", """SELECT row_number() OVER (ORDER BY tau DESC) - 1 AS j, tau, C, max(C) OVER (ORDER BY tau DESC) AS E,
        (SELECT count(*) FROM qs WHERE q >= tau) AS detp, (SELECT count(*) FROM zs WHERE z >= tau) AS dett FROM counted"""),
    "total": ("frames windows", "SELECT (SELECT count(*) FROM frames WHERE normal) AS nN, (SELECT count(*) FROM windows) AS nP, (SELECT count(DISTINCT track) FROM windows) AS nK"),
    "rates": ("curve total", """SELECT c.*, t.*, lead(E) OVER (ORDER BY j) AS nextE FROM curve c, total t"""),
}


def with_parts(names: str, body: str, **instead: tuple[str, str]) -> str:
    """The query with all expressions it needs, in order; ``instead`` replaces some of them."""
    parts = PARTS | instead
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for need in parts[name][0].split():
                add(need)
            done.append(name)

    for n in names.split():
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({parts[n][1]})" for n in done) + "\n" + body
