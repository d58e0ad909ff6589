"""The candle queries as DuckDB SQL over the driver's tables."""

from __future__ import annotations

from wickline.plans.queries import AS_OF, HORIZON, THRESHOLD

# Common table expressions; each names what it is built from.
CTE = {
    "ticks": ("", """SELECT event_type AS session_id, ts, event_id AS seq, value AS price, user_id, date_trunc('hour', ts) AS open_time,
        CASE WHEN event_id % 97 <> 0 THEN 0.5::DOUBLE + (event_id % 51) / 100.0::DOUBLE END AS confidence FROM events"""),
    "bars": ("ticks", """SELECT session_id, open_time, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close,
        CASE WHEN count(confidence) = count(*) THEN min(confidence) END AS confidence, min(ts) AS first_ts, arg_min(seq, (ts, seq)) AS first_seq, count(*) AS ticks FROM ticks GROUP BY session_id, open_time"""),
    "snaps": ("bars", """SELECT session_id, open_time, ts, seq, first_value(price) OVER w AS open, max(price) OVER w AS high, min(price) OVER w AS low, price AS close, false AS is_closed,
        CASE WHEN count(confidence) OVER w = count(*) OVER w THEN min(confidence) OVER w END AS confidence FROM ticks
        WINDOW w AS (PARTITION BY session_id, open_time ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        UNION ALL SELECT session_id, open_time, nts, nseq, open, high, low, close, true, confidence FROM
        (SELECT *, lead(first_ts) OVER v AS nts, lead(first_seq) OVER v AS nseq FROM bars WINDOW v AS (PARTITION BY session_id ORDER BY open_time)) WHERE nseq IS NOT NULL"""),
    "closed": ("snaps", "SELECT *, open_time + INTERVAL 1 HOUR AS close_time FROM snaps WHERE is_closed"),
    "days": ("ticks", "SELECT DISTINCT session_id, date_trunc('day', ts)::TIMESTAMP AS as_of FROM ticks"),
    "known": ("snaps", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, open_time ORDER BY ts DESC, seq DESC) AS r FROM snaps WHERE ts <= TIMESTAMP '{AS_OF}') WHERE r = 1"""),
    "altered": ("snaps", """SELECT session_id, open_time, ts, seq, CASE WHEN seq % 53 = 0 THEN open + 1 ELSE open END AS open, CASE WHEN seq % 41 = 0 THEN high - 50 ELSE high END AS high, low, close, is_closed, confidence FROM snaps"""),
    "pairs0": ("known", """SELECT *, lag(close) OVER w AS pc, lag(is_closed) OVER w AS pk, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM known WINDOW w AS (PARTITION BY session_id ORDER BY open_time)"""),
    "steps": ("closed", """SELECT *, row_number() OVER w AS k, close / nullif(lag(close) OVER w, 0) - 1 AS x, (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) AS ch,
        CASE WHEN lag(high) OVER w IS NULL THEN NULL WHEN high > lag(high) OVER w AND low > lag(low) OVER w THEN 1 ELSE 0 END AS up,
        CASE WHEN lag(high) OVER w IS NULL THEN NULL WHEN high < lag(high) OVER w AND low < lag(low) OVER w THEN 1 ELSE 0 END AS down FROM closed WINDOW w AS (PARTITION BY session_id ORDER BY open_time)"""),
    "feats": ("steps", """SELECT *, CASE WHEN k > 2 THEN CASE WHEN min(up) OVER p = 1 THEN 'RISING_STRUCTURE' WHEN min(down) OVER p = 1 THEN 'FALLING_STRUCTURE' ELSE 'MIXED_STRUCTURE' END END AS trend,
        CASE WHEN k >= 4 AND first_value(close) OVER l <> 0 THEN NOT (min(up) OVER q = 1) AND NOT (min(down) OVER q = 1) AND (max(high) OVER l - min(low) OVER l) / abs(first_value(close) OVER l) <= 0.9 END AS flat,
        CASE WHEN count(*) OVER l = 4 AND count(confidence) OVER l = 4 THEN min(confidence) OVER l END AS quality FROM steps
        WINDOW p AS (PARTITION BY session_id ORDER BY open_time ROWS 1 PRECEDING), q AS (PARTITION BY session_id ORDER BY open_time ROWS 2 PRECEDING), l AS (PARTITION BY session_id ORDER BY open_time ROWS 3 PRECEDING)"""),
    "rules": ("feats", """SELECT *, CASE WHEN k < 4 THEN 'INSUFFICIENT_HISTORY' WHEN quality IS NULL THEN 'MISSING_DATA_QUALITY' WHEN quality < 0.5 THEN 'LOW_DATA_QUALITY' WHEN flat IS NULL THEN 'MISSING_LATERALIZATION'
        WHEN flat THEN 'SIDEWAYS' WHEN trend IN ('RISING_STRUCTURE', 'FALLING_STRUCTURE') THEN trend ELSE 'UNCERTAIN_FALLBACK' END AS state_rule FROM feats"""),
    "states": ("rules", """SELECT *, CASE state_rule WHEN 'SIDEWAYS' THEN 'SIDEWAYS' WHEN 'RISING_STRUCTURE' THEN 'UP' WHEN 'FALLING_STRUCTURE' THEN 'DOWN' ELSE 'UNCERTAIN' END AS market_state FROM rules"""),
    "decided": ("states", """SELECT session_id, ts, k, CASE WHEN k >= 4 THEN trend END AS trend, CASE WHEN k >= 4 THEN flat END AS flat, CASE WHEN k >= 4 THEN quality END AS quality, state_rule, market_state,
        CASE WHEN market_state = 'UNCERTAIN' THEN 0.0 ELSE quality END::DOUBLE AS confidence, open_time FROM states"""),
    "asked": ("days decided", """SELECT d.session_id, d.as_of, coalesce(state_rule, 'INSUFFICIENT_HISTORY') AS state_rule, coalesce(market_state, 'UNCERTAIN') AS market_state, coalesce(confidence, 0.0)::DOUBLE AS confidence, quality, trend, flat
        FROM days d ASOF LEFT JOIN decided c ON d.session_id = c.session_id AND d.as_of >= c.ts"""),
    "truth": ("bars", "SELECT session_id, open_time, open, high, low, close FROM bars"),
    "recon": ("ticks", """SELECT session_id, open_time, open, high, low, CASE WHEN a = 2 THEN low ELSE close END AS close, a FROM
        (SELECT session_id, open_time, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close FROM ticks GROUP BY session_id, open_time HAVING arg_min(price, (ts, seq)) <> arg_max(price, (ts, seq))),
        (VALUES (1), (2)) v(a) WHERE a = 1 OR hour(open_time) % 7 = 0"""),
    "matches": ("truth recon", """SELECT t.*, r.close IS NOT NULL AS detected, r.open AS r_open, r.high AS r_high, r.low AS r_low, r.close AS r_close FROM truth t LEFT JOIN
        (SELECT session_id, open_time, arg_max(open, a) AS open, arg_max(high, a) AS high, arg_max(low, a) AS low, arg_max(close, a) AS close FROM recon GROUP BY ALL) r USING (session_id, open_time)"""),
    "anchors": ("bars", """SELECT session_id, day, k * 100 AS y, 500.0::DOUBLE - k * 10.0::DOUBLE - CASE WHEN day(day) % 4 = 0 AND k = 3 THEN 7.5 ELSE 0.0 END::DOUBLE AS price, 0.9::DOUBLE + k * 0.01::DOUBLE AS confidence FROM
        (SELECT session_id, date_trunc('day', open_time)::TIMESTAMP AS day, row_number() OVER (PARTITION BY session_id, date_trunc('day', open_time) ORDER BY open_time) AS k FROM bars)"""),
    "sess": ("ticks", "SELECT session_id, min(ts) AS origin_time, CASE WHEN session_id = 'signup' THEN 'LEGACY_UNKNOWN' ELSE 'TRACKED' END AS tracking_state FROM ticks GROUP BY session_id"),
    "pols": ("sess", f"SELECT 'p-' || session_id AS policy_id, session_id, {HORIZON} AS horizon, CASE WHEN session_id = 'view' THEN origin_time + INTERVAL 10 DAY ELSE origin_time END AS bound_at FROM sess WHERE session_id <> 'click'"),
    "horizons": ("closed", f"""SELECT session_id, open_time AS reference_open_time, close_time AS reference_close_time, close AS reference_close, lead(open_time, {HORIZON}) OVER w AS final_open_time, lead(close_time, {HORIZON}) OVER w AS final_close_time, lead(close, {HORIZON}) OVER w AS final_close
        FROM closed WINDOW w AS (PARTITION BY session_id ORDER BY open_time)"""),
    "evals0": ("decided horizons pols sess", """SELECT a.session_id, a.ts AS timestamp, a.market_state, a.confidence, h.reference_open_time, h.reference_close_time, h.reference_close, h.final_open_time, h.final_close_time, h.final_close, p.policy_id, p.bound_at, s.tracking_state
        FROM decided a ASOF LEFT JOIN horizons h ON a.session_id = h.session_id AND a.ts >= h.reference_close_time LEFT JOIN pols p ON p.session_id = a.session_id LEFT JOIN sess s ON s.session_id = a.session_id"""),
    "evals": ("evals0", f"""SELECT *, CASE WHEN status = 'AVAILABLE' THEN CASE WHEN ret > {THRESHOLD} THEN 'UP' WHEN ret < -{THRESHOLD} THEN 'DOWN' WHEN ret IS NOT NULL THEN 'SIDEWAYS' END END AS realized_state FROM
        (SELECT *, (final_close - reference_close) / nullif(reference_close, 0) AS ret, CASE WHEN tracking_state <> 'TRACKED' THEN 'EXPOSURE_HISTORY_UNKNOWN' WHEN policy_id IS NULL THEN 'UNAVAILABLE_POLICY' WHEN bound_at > timestamp THEN 'POLICY_BOUND_TOO_LATE'
         WHEN reference_close IS NULL THEN 'UNAVAILABLE_REFERENCE' WHEN final_close IS NULL THEN CASE WHEN session_id = 'purchase' THEN 'UNAVAILABLE_END_OF_DATASET' ELSE 'PENDING_HORIZON' END ELSE 'AVAILABLE' END AS status FROM evals0)"""),
    "good": ("evals", "SELECT * FROM evals WHERE status = 'AVAILABLE'"),
    "bins": ("good", """SELECT policy_id, bin, count(*) AS n, avg(confidence) AS mean_confidence, avg(CASE WHEN market_state = realized_state THEN 1.0 ELSE 0.0 END) AS observed_accuracy FROM
        (SELECT *, least(floor(confidence::DECIMAL(20, 10) * 5), 4)::INTEGER AS bin FROM good WHERE market_state <> 'UNCERTAIN') GROUP BY policy_id, bin"""),
    "allbins": ("bins", """SELECT g.policy_id, b.bin, coalesce(n, 0) AS n, mean_confidence, observed_accuracy, abs(mean_confidence - observed_accuracy) AS absolute_gap FROM (SELECT DISTINCT policy_id FROM good) g CROSS JOIN (SELECT unnest(range(5))::INTEGER AS bin) b LEFT JOIN bins USING (policy_id, bin)"""),
    # the dark bars of a day's hours, and by which hours of the day each is reached
    "cells": ("bars", """SELECT session_id || '/' || strftime(open_time, '%Y%m%d') AS image, hour(open_time) AS hour, floor(low / 12)::INTEGER AS a, floor(high / 12)::INTEGER AS b FROM bars"""),
    "reach": ("cells", """SELECT image, hour, hour AS root, a, b FROM cells UNION SELECT n.image, n.hour, r.root, n.a, n.b FROM reach r JOIN cells n ON n.image = r.image AND abs(n.hour - r.hour) = 1 AND n.a <= r.b + 1 AND r.a <= n.b + 1"""),
    "orderbars": ("", """SELECT o_orderpriority AS session_id, date_trunc('day', o_orderdate)::TIMESTAMP AS open_time, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close FROM orders GROUP BY ALL"""),
}


def sql(body: str, *needs: str) -> str:
    """``body`` behind the expressions it needs, in the order of the table."""
    wanted: set[str] = set()

    def want(name: str) -> None:
        if name not in wanted:
            wanted.add(name)
            for before in CTE[name][0].split():
                want(before)

    for need in needs:
        want(need)
    return "WITH RECURSIVE " * ("reach" in wanted) + "WITH " * ("reach" not in wanted) + ",\n".join(f"{name} AS ({text})" for name, (_, text) in CTE.items() if name in wanted) + "\n" + body


_RATE = "coalesce({} / nullif({}::DOUBLE, 0), 0.0)"
_SCORES = ", ".join(f"round(count(*) FILTER (market_state = '{s}' AND realized_state = '{s}') / nullif(count(*) FILTER ({side} = '{s}'), 0)::DOUBLE, 9) AS {name}_{s.lower()}" for s in ("UP", "DOWN", "SIDEWAYS") for name, side in (("precision", "market_state"), ("recall", "realized_state")))

ORACLE_SQL = {
    "candles_from_ticks": sql("SELECT session_id, open_time, open, high, low, close, ticks FROM bars", "bars"),
    "snapshots_cumulative": sql("SELECT * FROM snaps", "snaps"),
    "candles_for_frame": sql("SELECT 'f' || strftime(t.ts, '%Y%m%d%H%M') AS frame_id, s.session_id, s.open_time, s.ts, s.open, s.high, s.low, s.close, s.is_closed FROM snaps s JOIN ticks t USING (seq)", "snaps", "ticks"),
    "candles_as_of": sql("SELECT session_id, open_time, ts, open, high, low, close, is_closed FROM known", "known"),
    "candles_as_of_batched": sql("""SELECT session_id, as_of, count(*) AS known, count(*) FILTER (is_closed) AS closed, max(open_time) AS newest, round(sum(close), 4) AS sum_close FROM
        (SELECT d.as_of, s.*, row_number() OVER (PARTITION BY d.session_id, d.as_of, s.open_time ORDER BY s.ts DESC, s.seq DESC) AS r FROM days d JOIN snaps s ON s.session_id = d.session_id AND s.ts <= d.as_of) WHERE r = 1 GROUP BY session_id, as_of""", "days", "snaps"),
    "canonical_latest": sql("SELECT session_id, open_time, ts, open, high, low, close, is_closed FROM (SELECT *, row_number() OVER (PARTITION BY session_id, open_time ORDER BY ts DESC, seq DESC) AS r FROM snaps) WHERE r = 1", "snaps"),
    "latest_snapshot_ts": sql("SELECT session_id, open_time, max(ts) AS latest_ts FROM snaps GROUP BY ALL", "snaps"),
    "evolution_violations": sql("""SELECT session_id, open_time, ts, seq, violation FROM (SELECT *, CASE WHEN open <> o THEN 'OPEN_CHANGED' WHEN f IS NOT NULL AND (NOT is_closed OR {'a': open, 'b': high, 'c': low, 'd': close} <> f) THEN 'CHANGED_AFTER_CLOSE' WHEN high < h THEN 'HIGH_FELL' WHEN low > l THEN 'LOW_ROSE' END AS violation FROM
        (SELECT *, first_value(open) OVER w AS o, first_value(CASE WHEN is_closed THEN {'a': open, 'b': high, 'c': low, 'd': close} END IGNORE NULLS) OVER b AS f, max(high) OVER b AS h, min(low) OVER b AS l FROM altered
         WINDOW w AS (PARTITION BY session_id, open_time ORDER BY ts, seq), b AS (PARTITION BY session_id, open_time ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) WHERE violation IS NOT NULL""", "altered"),
    "same_ts_conflicts": sql("SELECT session_id, open_time, date_trunc('minute', ts)::TIMESTAMP AS ts, count(DISTINCT (open, high, low, close, is_closed)) AS states FROM snaps GROUP BY ALL HAVING count(DISTINCT (open, high, low, close, is_closed)) > 1", "snaps"),
    "constraint_violations": sql("""SELECT session_id, ts, seq, is_closed, unnest(list_filter([CASE WHEN NOT high >= greatest(open, close) THEN 'HIGH_BELOW_BODY' END, CASE WHEN NOT low <= least(open, close) THEN 'LOW_ABOVE_BODY' END, CASE WHEN NOT low <= high THEN 'LOW_ABOVE_HIGH' END,
        CASE WHEN seq % 61 = 0 THEN 'confidence_range' END], lambda x: x IS NOT NULL)) AS violation FROM altered""", "altered"),
    "key_duplicates": sql("SELECT session_id, open_time, user_id, count(*) AS copies FROM ticks GROUP BY ALL HAVING count(*) > 1", "ticks"),
    "orphan_audit": sql("SELECT session_id, open_time FROM bars WHERE session_id = 'error'", "bars"),
    "idempotent_merge_plan": sql("SELECT session_id, open_time, CASE WHEN hour(open_time) >= 16 THEN 'insert' WHEN hour(open_time) % 5 = 0 THEN 'conflict' ELSE 'noop' END AS action FROM bars", "bars"),
    "replay_visible": sql(f"SELECT session_id, open_time, open, high, low, close FROM closed WHERE close_time <= TIMESTAMP '{AS_OF}'", "closed"),
    "replay_release_steps": sql("""SELECT session_id, clock, position, (position - coalesce(lag(position) OVER (PARTITION BY session_id ORDER BY clock), 0))::INTEGER AS released FROM
        (SELECT d.session_id, d.as_of AS clock, count(c.open_time)::INTEGER AS position FROM days d LEFT JOIN closed c ON c.session_id = d.session_id AND c.close_time <= d.as_of GROUP BY ALL)""", "days", "closed"),
    "sequence_validation": sql("""SELECT session_id, ordinal, CASE WHEN asset <> first_value(asset) OVER w THEN 'MIXED_ASSET' WHEN t <= lag(t) OVER w THEN 'NOT_INCREASING' END AS violation FROM
        (SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY open_time))::INTEGER AS ordinal, CASE WHEN hour(open_time) = 13 THEN 'OTHER' ELSE session_id END AS asset,
                CASE WHEN row_number() OVER (PARTITION BY session_id ORDER BY open_time) % 50 = 0 THEN open_time - INTERVAL 5 DAY ELSE open_time END AS t FROM bars)
        WINDOW w AS (PARTITION BY session_id ORDER BY ordinal) QUALIFY violation IS NOT NULL""", "bars"),
    "direction": sql("SELECT session_id, open_time, CASE WHEN close > open THEN 'CLOSE_ABOVE_OPEN' WHEN close < open THEN 'CLOSE_BELOW_OPEN' ELSE 'CLOSE_EQUAL_OPEN' END AS direction FROM bars", "bars"),
    "amplitude": sql("SELECT session_id, open_time, round(high - low, 9) AS amplitude FROM bars", "bars"),
    "returns": sql("SELECT session_id, open_time, CASE WHEN pk THEN round((close - pc) / nullif(pc, 0), 9) END AS \"return\" FROM pairs0", "pairs0"),
    "hh_hl_lh_ll": sql("SELECT session_id, open_time, CASE WHEN is_closed AND pk THEN high > ph END AS higher_high, CASE WHEN is_closed AND pk THEN low > pl END AS higher_low, CASE WHEN is_closed AND pk THEN high < ph END AS lower_high, CASE WHEN is_closed AND pk THEN low < pl END AS lower_low FROM pairs0", "pairs0"),
    "volatility": sql("SELECT session_id, open_time, CASE WHEN k >= 5 AND count(ch) OVER w = 4 THEN round(stddev_pop(ch) OVER w, 9) END AS volatility FROM steps WINDOW w AS (PARTITION BY session_id ORDER BY open_time ROWS 3 PRECEDING)", "steps"),
    "basic_trend": sql("SELECT session_id, open_time, trend FROM feats", "feats"),
    "basic_lateralization": sql("SELECT session_id, open_time, flat AS \"lateral\" FROM feats", "feats"),
    "data_quality": sql("SELECT session_id, open_time, quality FROM feats", "feats"),
    "last_closed": sql("SELECT session_id, open_time, close FROM closed QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY open_time DESC) <= 3", "closed"),
    "analysis_decision": sql("SELECT session_id, as_of, state_rule, market_state, confidence, quality FROM asked", "asked"),
    "analysis_evidence": sql("""SELECT session_id, as_of, 'STATE_RULE=' || state_rule || '|BASIC_TREND=' || coalesce(trend, 'NONE') || '|BASIC_LATERALIZATION=' || coalesce(upper(flat::VARCHAR), 'NONE') || '|DATA_QUALITY=' || coalesce(quality::VARCHAR, 'NONE')
        || '|TREND_PAIRS=2|LATERALIZATION_WINDOW_CANDLES=4|LATERALIZATION_MAX_RANGE_RATIO=0.9|MINIMUM_DATA_QUALITY=0.5' AS evidence FROM asked""", "asked"),
    "analysis_dense": sql("SELECT session_id, ts AS as_of, state_rule, market_state, confidence FROM decided", "decided"),
    "reconstruction_match": sql("SELECT session_id, open_time, detected, close, r_open, r_high, r_low, r_close FROM matches", "matches"),
    "reconstruction_metrics": sql(f"""SELECT {", ".join(f"round(avg(abs(r_{f} - {f})), 9) AS {f}_mean_error" for f in ("open", "high", "low", "close"))},
        round({_RATE.format("count(*) FILTER (detected)", "count(*)")}, 9) AS detection_rate, round({_RATE.format("count(*) FILTER (sign(close - open) = sign(r_close - r_open))", "count(*) FILTER (detected)")}, 9) AS direction_accuracy,
        round({_RATE.format("any_value(surplus)", "any_value(n)")}, 9) AS duplicate_rate, round({_RATE.format("(count(*) - count(*) FILTER (detected))", "count(*)")}, 9) AS missing_rate,
        count(*) AS truth_count, any_value(n)::BIGINT AS reconstructed_count, count(*) FILTER (detected) AS matched_count
        FROM matches, (SELECT sum(c) AS n, sum(c - 1) AS surplus FROM (SELECT count(*) AS c FROM recon GROUP BY session_id, open_time))""", "matches"),
    "normalize_dedup": sql("SELECT session_id, open_time, seq AS arrival, close FROM snaps WHERE NOT is_closed QUALIFY row_number() OVER (PARTITION BY session_id, open_time ORDER BY date_trunc('minute', ts) DESC, seq DESC) = 1", "snaps"),
    "ohlc_reject_reasons": sql("""SELECT session_id, seq, is_closed, CASE WHEN high < greatest(open, close) THEN 'HIGH_BELOW_BODY' WHEN low > least(open, close) THEN 'LOW_ABOVE_BODY' WHEN low > high THEN 'LOW_ABOVE_HIGH' END AS reason
        FROM (SELECT * REPLACE (CASE WHEN seq % 37 = 0 THEN low + 80 ELSE low END AS low) FROM altered) WHERE reason IS NOT NULL""", "altered"),
    "bands": sql("SELECT session_id, min(h) AS start, max(h) AS \"end\" FROM (SELECT session_id, h, h - row_number() OVER (PARTITION BY session_id ORDER BY h) AS g FROM (SELECT DISTINCT session_id, date_diff('hour', TIMESTAMP '2024-01-01', open_time) AS h FROM bars)) GROUP BY session_id, g", "bars"),
    "frame_change_flags": sql("SELECT session_id, frame_id, image_hash, coalesce(image_hash <> lag(image_hash) OVER (PARTITION BY session_id ORDER BY ts, frame_id), false) AS changed FROM (SELECT session_id, seq AS frame_id, ts, sha256(floor(price / 10)::BIGINT::VARCHAR) AS image_hash FROM ticks)", "ticks"),
    "price_interpolation": sql("""SELECT t.session_id, t.seq, t.y, round(CASE WHEN t.y = y0 THEN p0 ELSE p0 + (p1 - p0) * (t.y - y0) / (y1 - y0) END, 9) AS price, CASE WHEN y0 IS NULL THEN 'Y_OUTSIDE_CALIBRATED_RANGE' END AS reason
        FROM (SELECT session_id, date_trunc('day', ts)::TIMESTAMP AS day, seq, seq % 2450 + 50 AS y FROM ticks) t LEFT JOIN (SELECT session_id, day, y AS y0, price AS p0, lead(y) OVER w AS y1, lead(price) OVER w AS p1 FROM anchors WINDOW w AS (PARTITION BY session_id, day ORDER BY y)) s
        ON s.session_id = t.session_id AND s.day = t.day AND (t.y = y0 OR (y0 < t.y AND t.y < y1))""", "anchors", "ticks"),
    "anchor_calibration": sql("""SELECT session_id, day, n AS anchors, min_y::INTEGER AS min_y, max_y::INTEGER AS max_y, CASE WHEN reason IS NULL THEN CASE WHEN falls THEN 'PRICE_INCREASES_UP' ELSE 'PRICE_INCREASES_DOWN' END END AS orientation, CASE WHEN reason IS NULL THEN round(least_c * greatest(0.0, 1 - dev), 9) END AS confidence, reason FROM
        (SELECT *, CASE WHEN n < 2 THEN 'INSUFFICIENT_PRICE_ANCHORS' WHEN NOT falls AND NOT rises THEN 'NON_MONOTONIC_PRICE_ANCHORS' WHEN dev > 0.05 THEN 'INCONSISTENT_PRICE_ANCHORS' END AS reason FROM
         (SELECT session_id, day, count(*) AS n, min(y) AS min_y, max(y) AS max_y, min(confidence) AS least_c, bool_and(gap < 0) AS falls, bool_and(gap > 0) AS rises, max(abs(slope - m) / nullif(m, 0)) AS dev FROM
          (SELECT *, avg(slope) OVER (PARTITION BY session_id, day) AS m FROM (SELECT *, abs((lead(price) OVER w - price) / nullif(lead(y) OVER w - y, 0)) AS slope, lead(price) OVER w - price AS gap FROM anchors WINDOW w AS (PARTITION BY session_id, day ORDER BY y, price))) GROUP BY ALL))""", "anchors"),
    "spacing_shift_median": sql("SELECT session_id, day, median(gap) AS spacing, round_even(median(gap), 0)::INTEGER AS shift FROM (SELECT session_id, date_trunc('day', ts)::TIMESTAMP AS day, seq - lag(seq) OVER (PARTITION BY session_id, date_trunc('day', ts) ORDER BY seq) AS gap FROM ticks) WHERE gap IS NOT NULL GROUP BY ALL", "ticks"),
    "exposure_frontier": sql("SELECT s.session_id, s.tracking_state, CASE WHEN s.tracking_state = 'TRACKED' THEN greatest(s.origin_time, m) END AS exposure_frontier FROM sess s LEFT JOIN (SELECT session_id, max(ts) AS m FROM ticks GROUP BY session_id) e USING (session_id)", "sess"),
    "policy_registration": sql(f"SELECT 'p-' || session_id AS policy_id, session_id, CASE WHEN session_id = 'error' THEN 5 ELSE {HORIZON} END AS horizon, CASE session_id WHEN 'signup' THEN 'refused' WHEN 'click' THEN 'insert' WHEN 'error' THEN 'conflict' ELSE 'noop' END AS action, CASE WHEN session_id = 'view' THEN origin_time + INTERVAL 10 DAY ELSE origin_time END AS bound_at FROM sess", "sess"),
    "policy_eligibility": sql("SELECT d.session_id, as_of, policy_id FROM days d JOIN pols p ON p.session_id = d.session_id AND p.bound_at <= d.as_of", "days", "pols"),
    "outcome_reference": sql("SELECT d.session_id, d.as_of, c.open_time, c.close FROM days d ASOF LEFT JOIN closed c ON d.session_id = c.session_id AND d.as_of >= c.close_time", "days", "closed"),
    "outcome_horizon": sql("SELECT session_id, reference_open_time, final_open_time, final_close FROM horizons", "horizons"),
    "outcome_state": sql("SELECT session_id, timestamp, reference_open_time, final_open_time, round(ret, 9) AS realized_return, realized_state FROM good", "good"),
    "outcome_evidence": sql(f"""SELECT session_id, timestamp, 'OUTCOME_RULE=' || CASE realized_state WHEN 'UP' THEN 'RETURN_ABOVE_THRESHOLD' WHEN 'DOWN' THEN 'RETURN_BELOW_NEGATIVE_THRESHOLD' ELSE 'RETURN_WITHIN_THRESHOLD' END
        || '|ANALYSIS_ID=' || session_id || '/' || strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') || '|POLICY_ID=' || policy_id
        || '|REFERENCE_CANDLE_OPEN_TIME=' || reference_open_time || '|REFERENCE_CANDLE_CLOSE_TIME=' || reference_close_time || '|REFERENCE_CLOSE=' || reference_close::DECIMAL(18, 6)
        || '|FINAL_CANDLE_OPEN_TIME=' || final_open_time || '|FINAL_CANDLE_CLOSE_TIME=' || final_close_time || '|FINAL_CLOSE=' || final_close::DECIMAL(18, 6) || '|HORIZON_CLOSED_CANDLES={HORIZON}'
        || '|REALIZED_RETURN_THRESHOLD=' || {THRESHOLD}::DECIMAL(18, 6) || '|REALIZED_RETURN=' || ret::DECIMAL(18, 6) || '|REALIZED_STATE=' || realized_state AS evidence FROM good""", "good"),
    "availability_status": sql("SELECT session_id, status, count(*) AS analyses FROM evals GROUP BY ALL", "evals"),
    "confusion_matrix": sql(f"SELECT p.policy_id, s.realized_state, {', '.join(f'''count(*) FILTER (g.market_state = '{x}') AS predicted_{x.lower()}''' for x in ('UP', 'DOWN', 'SIDEWAYS', 'UNCERTAIN'))} FROM (SELECT DISTINCT policy_id FROM good) p CROSS JOIN (VALUES ('UP'), ('DOWN'), ('SIDEWAYS')) s(realized_state) LEFT JOIN good g ON g.policy_id = p.policy_id AND g.realized_state = s.realized_state GROUP BY p.policy_id, s.realized_state", "good"),
    "precision_recall": sql(f"SELECT policy_id, count(*) AS evaluated, round(count(*) FILTER (market_state = realized_state) / count(*)::DOUBLE, 9) AS accuracy, {_SCORES} FROM good GROUP BY policy_id", "good"),
    "coverage": sql("SELECT policy_id, count(*) FILTER (market_state = 'UNCERTAIN') AS uncertain_count, round(count(*) FILTER (market_state <> 'UNCERTAIN') / count(*)::DOUBLE, 9) AS coverage, round(count(*) FILTER (market_state = 'UNCERTAIN') / count(*)::DOUBLE, 9) AS uncertain_frequency FROM good GROUP BY policy_id", "good"),
    "confidence_calibration": sql("SELECT policy_id, bin, n, round(mean_confidence, 9) AS mean_confidence, round(observed_accuracy, 9) AS observed_accuracy, round(absolute_gap, 9) AS absolute_gap FROM allbins", "allbins"),
    "calibration_gap": sql("SELECT policy_id, round(sum(n * absolute_gap) / nullif(sum(n), 0)::DOUBLE, 9) AS weighted_alignment_gap FROM allbins GROUP BY policy_id", "allbins"),
    "chart_reading": sql("""SELECT image, x::INTEGER AS x, CASE WHEN up THEN 'UP' ELSE 'DOWN' END AS direction, top AS body_top, bottom AS body_bottom, CASE WHEN high < top THEN high END AS upper_top, CASE WHEN low > bottom THEN low END AS lower_bottom, 13 AS width FROM
        (SELECT session_id || '/' || strftime(open_time, '%Y%m%d') AS image, 100 + 22 * row_number() OVER (PARTITION BY session_id, date_trunc('day', open_time) ORDER BY open_time) AS x, close >= open AS up, 100 + floor((500.0::DOUBLE - high) * 0.6::DOUBLE)::INTEGER AS high, 100 + floor((500.0::DOUBLE - low) * 0.6::DOUBLE)::INTEGER AS low,
                100 + floor((500.0::DOUBLE - greatest(open, close)) * 0.6::DOUBLE)::INTEGER AS top, 100 + floor((500.0::DOUBLE - least(open, close)) * 0.6::DOUBLE)::INTEGER AS bottom FROM bars) WHERE low - high + 1 >= 5""", "bars"),
    "chart_prices": sql(f"""SELECT image, x::INTEGER AS x, CASE WHEN up THEN 'UP' ELSE 'DOWN' END AS direction, {", ".join(f"CASE WHEN {y} BETWEEN 100 AND 340 THEN round(500.0::DOUBLE - ({y} - 100) / 0.6::DOUBLE, 6) END AS {name}" for name, y in (("open", "(CASE WHEN up THEN bottom ELSE top END)"), ("high", "high"), ("low", "low"), ("close", "(CASE WHEN up THEN top ELSE bottom END)")))} FROM
        (SELECT session_id || '/' || strftime(open_time, '%Y%m%d') AS image, 100 + 22 * row_number() OVER (PARTITION BY session_id, date_trunc('day', open_time) ORDER BY open_time) AS x, close >= open AS up, 100 + floor((500.0::DOUBLE - high) * 0.6::DOUBLE)::INTEGER AS high, 100 + floor((500.0::DOUBLE - low) * 0.6::DOUBLE)::INTEGER AS low,
                100 + floor((500.0::DOUBLE - greatest(open, close)) * 0.6::DOUBLE)::INTEGER AS top, 100 + floor((500.0::DOUBLE - least(open, close)) * 0.6::DOUBLE)::INTEGER AS bottom FROM bars) WHERE low - high + 1 >= 5""", "bars"),
    "chart_regions": sql("""SELECT image, CASE WHEN w IS NULL THEN 'CHART_NOT_FOUND' ELSE 'OK' END AS status, x, y, w AS chart_width, h AS chart_height FROM (SELECT DISTINCT image FROM cells) LEFT JOIN
        (SELECT image, arg_max(x, (w * h, y)) AS x, arg_max(y, (w * h, y)) AS y, arg_max(w, (w * h, y)) AS w, arg_max(h, (w * h, y)) AS h FROM
            (SELECT image, root, CAST(min(a) * 16 AS INTEGER) AS x, CAST(min(hour) * 16 AS INTEGER) AS y, CAST((max(b) - min(a) + 1) * 16 AS INTEGER) AS w, CAST((max(hour) - min(hour) + 1) * 16 AS INTEGER) AS h
             FROM (SELECT image, hour, min(root) AS root FROM reach GROUP BY image, hour) JOIN cells USING (image, hour) GROUP BY image, root)
         WHERE w >= 120 AND h >= 80 AND w * h >= 0.15 * 400 * 704 GROUP BY image) USING (image)""", "reach"),
    "touching_bars": sql("""SELECT image, x::INTEGER AS x, CASE WHEN up THEN 'UP' ELSE 'DOWN' END AS direction, top AS body_top, bottom AS body_bottom, CASE WHEN high < top THEN high END AS upper_top, CASE WHEN low > bottom THEN low END AS lower_bottom, 13 AS width FROM
        (SELECT image, x, up, (b + floor((500.0::DOUBLE - high) * 0.3::DOUBLE))::INTEGER AS high, (b + floor((500.0::DOUBLE - low) * 0.3::DOUBLE))::INTEGER AS low,
                (b + floor((500.0::DOUBLE - greatest(open, close)) * 0.3::DOUBLE))::INTEGER AS top, (b + floor((500.0::DOUBLE - least(open, close)) * 0.3::DOUBLE))::INTEGER AS bottom FROM
            (SELECT *, close >= open AS up, 100 + 10 * k AS x, 80 + 180 * (k % 2) AS b FROM
                (SELECT *, session_id || '/' || strftime(open_time, '%Y%m%d') AS image, row_number() OVER (PARTITION BY session_id, date_trunc('day', open_time) ORDER BY open_time) AS k FROM bars))) WHERE low - high + 1 >= 5""", "bars"),
    "order_series_features": sql("""SELECT session_id, open_time, open, high, low, close, CASE WHEN k >= 5 AND count(ch) OVER v = 4 THEN round(stddev_pop(ch) OVER v, 9) END AS volatility,
        CASE WHEN k > 2 THEN CASE WHEN min(up) OVER p = 1 THEN 'RISING_STRUCTURE' WHEN min(down) OVER p = 1 THEN 'FALLING_STRUCTURE' ELSE 'MIXED_STRUCTURE' END END AS trend,
        CASE WHEN k >= 4 AND first_value(close) OVER v <> 0 THEN NOT (min(up) OVER q = 1) AND NOT (min(down) OVER q = 1) AND (max(high) OVER v - min(low) OVER v) / abs(first_value(close) OVER v) <= 1.5 END AS "lateral" FROM
        (SELECT *, row_number() OVER w AS k, (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) AS ch, CASE WHEN lag(high) OVER w IS NULL THEN NULL WHEN high > lag(high) OVER w AND low > lag(low) OVER w THEN 1 ELSE 0 END AS up,
          CASE WHEN lag(high) OVER w IS NULL THEN NULL WHEN high < lag(high) OVER w AND low < lag(low) OVER w THEN 1 ELSE 0 END AS down FROM orderbars WINDOW w AS (PARTITION BY session_id ORDER BY open_time))
        WINDOW p AS (PARTITION BY session_id ORDER BY open_time ROWS 1 PRECEDING), q AS (PARTITION BY session_id ORDER BY open_time ROWS 2 PRECEDING), v AS (PARTITION BY session_id ORDER BY open_time ROWS 3 PRECEDING)""", "orderbars"),
    "lineitem_candles": """SELECT l_returnflag AS session_id, date_trunc('day', l_shipdate)::TIMESTAMP AS open_time, arg_min(l_extendedprice, (l_shipdate, l_orderkey * 100 + l_linenumber)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
        arg_max(l_extendedprice, (l_shipdate, l_orderkey * 100 + l_linenumber)) AS close, count(*) AS ticks FROM lineitem GROUP BY ALL""",
}
