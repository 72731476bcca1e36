"""SQL that the registered queries are checked against.

Written straight from the definitions, with joins and windows over all rows,
independently of how the Spark plans get there. The SQL runs on a single-node
engine over the raw test tables.
"""

from __future__ import annotations

from tidemark.functions import normal


def _sql_polynomial(coefficients: tuple[float, ...], x: str) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _erfc(x: str) -> str:
    """Complementary error function of a column as SQL (no engine-side erf here either)."""
    y, sq = f"abs({x})", f"({x} * {x})"
    inv = f"(1.0::DOUBLE / {sq})"
    small = f"1.0 - {y} * {_sql_polynomial(normal.SMALL_NUM, sq)} / {_sql_polynomial(normal.SMALL_DEN, sq)}"
    middle = f"exp(-{sq}) * {_sql_polynomial(normal.MIDDLE_NUM, y)} / {_sql_polynomial(normal.MIDDLE_DEN, y)}"
    fraction = f"{inv} * {_sql_polynomial(normal.TAIL_NUM, inv)} / {_sql_polynomial(normal.TAIL_DEN, inv)}"
    tail = f"exp(-{sq}) * (1.0 / sqrt(pi()) - {fraction}) / {y}"
    positive = (
        f"CASE WHEN {y} <= {normal.SMALL_LIMIT} THEN {small} WHEN {y} <= {normal.MIDDLE_LIMIT} THEN {middle} ELSE {tail} END"
    )
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} < 0 THEN 2.0 - ({positive}) ELSE {positive} END)"


# --- base tables -------------------------------------------------------------

RAW = """
installs AS (
  SELECT c_custkey AS user_id, DATE '2023-11-18' + CAST(c_custkey % 45 AS INTEGER) AS installed FROM customer),
named AS (
  SELECT e.*, i.installed,
    CASE WHEN event_type = 'signup' THEN CASE WHEN value >= 40 THEN 'account_created' ELSE 'install' END
         WHEN event_type = 'view' AND value >= 60 THEN 'first_session'
         WHEN event_type = 'view' THEN 'session_start'
         WHEN event_type = 'click' AND value >= 60 THEN 'feature_used'
         WHEN event_type = 'error' THEN CASE WHEN value >= 90 THEN 'trial_started' ELSE 'trial_expired_no_purchase' END
         WHEN event_type = 'purchase' AND value >= 120 THEN 'purchase_completed'
         ELSE 'trial_reminder_shown' END AS event_name
  FROM events e JOIN installs i USING (user_id)),
raw_events AS (
  SELECT event_id, user_id, CAST(user_id % 20 + 1 AS INTEGER) AS app_id, event_name,
    CASE WHEN event_name = 'feature_used' THEN
      CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 30 THEN 'collaboration_feature'
           ELSE 'standard_feature' END
      WHEN event_name = 'trial_reminder_shown' AND CAST(json_extract_string(props, '$.k') AS INTEGER) < 30
      THEN 'day6_trial_extension' END AS event_subtype,
    ts AS event_timestamp, CAST(date_diff('day', installed, CAST(ts AS DATE)) AS INTEGER) AS day_offset
  FROM named),
raw_users AS (
  SELECT c.c_custkey AS user_id, CAST(c.c_custkey % 20 + 1 AS INTEGER) AS app_id,
    CAST(i.installed AS TIMESTAMP) AS install_timestamp,
    CAST(date_trunc('month', i.installed) AS DATE) AS cohort_month,
    CASE WHEN c.c_custkey % 25 = 0 THEN 'dev-shared' WHEN c.c_custkey % 40 <> 9 THEN 'dev-' || c.c_custkey END AS device_id,
    n.n_name AS country,
    CASE WHEN c.c_custkey % 50 = 0 THEN 'internal_qa' ELSE c.c_mktsegment END AS acquisition_channel,
    CASE WHEN c.c_custkey % 25 = 0 THEN 'TEST_bot_' || c.c_custkey || '@example.com'
         WHEN c.c_custkey % 40 <> 19 THEN 'user' || c.c_custkey || '@example.com' END AS email,
    CASE WHEN c.c_custkey IN (SELECT user_id FROM raw_events WHERE event_name = 'trial_started')
         THEN CASE WHEN c.c_custkey % 2 = 0 THEN 'control' ELSE 'treatment' END END AS ab_group,
    (c.c_custkey % 25 = 0 AND c.c_custkey % 100 <> 50) OR c.c_custkey % 200 = 13 AS is_bot_ground_truth
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN installs i ON i.user_id = c.c_custkey)"""

CLEAN = RAW + """,
shared_devices AS (SELECT device_id FROM raw_users GROUP BY device_id HAVING COUNT(DISTINCT user_id) > 20),
flagged AS (
  SELECT *, COALESCE(device_id IN (SELECT device_id FROM shared_devices WHERE device_id IS NOT NULL), FALSE)
    OR COALESCE(regexp_matches(lower(email), 'test|qa|bot'), FALSE) AS is_suspected_bot
  FROM raw_users),
clean_users AS (SELECT * EXCLUDE (is_suspected_bot) FROM flagged WHERE NOT is_suspected_bot),
clean_events AS (SELECT * FROM raw_events SEMI JOIN clean_users USING (user_id))"""


def _clean(query: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([CLEAN, *ctes]) + "\n" + query


FACTS = """
per_user AS (
  SELECT user_id, COUNT(*) AS n_events,
    COUNT(*) FILTER (event_name = 'session_start') AS session_count,
    COUNT(*) FILTER (event_name = 'session_start' AND day_offset <= 3) AS early_sessions,
    MIN(day_offset) AS first_event_day, MAX(day_offset) AS last_event_day, MAX(event_timestamp) AS last_event_ts,
    MAX(day_offset) FILTER (event_name = 'purchase_completed') AS purchase_day,
    bool_or(event_name = 'account_created') AS reached_signup,
    bool_or(event_name = 'first_session') AS reached_first_session,
    bool_or(event_name = 'feature_used') AS reached_feature,
    bool_or(event_name = 'trial_started') AS reached_trial,
    bool_or(event_name = 'purchase_completed') AS reached_purchase,
    bool_or(core) AS has_core_activity, bool_or(core AND day_offset = 1) AS active_d1, bool_or(core AND day_offset = 7) AS active_d7,
    bool_or(core AND day_offset = 14) AS active_d14, bool_or(core AND day_offset = 30) AS active_d30,
    bool_or(COALESCE(event_subtype = 'collaboration_feature', FALSE)) AS used_collab,
    bool_or(COALESCE(event_subtype = 'collaboration_feature', FALSE) AND day_offset <= 3) AS used_collab_early,
    bool_or(event_name = 'purchase_completed' AND day_offset <= 3) AS purchased_early
  FROM (SELECT *, list_contains(['session_start', 'feature_used', 'trial_started', 'purchase_completed'], event_name) AS core FROM clean_events)
  GROUP BY user_id)"""

_FLAGS = (
    "reached_signup", "reached_first_session", "reached_feature", "reached_trial", "reached_purchase",
    "has_core_activity", "active_d1", "active_d7", "active_d14", "active_d30",
    "used_collab", "used_collab_early", "purchased_early",
)

FUNNEL = """
funnel_counts AS (
  SELECT (SELECT COUNT(*) FROM clean_users) AS n_install,
    COUNT(DISTINCT user_id) FILTER (event_name = 'account_created') AS n_signup,
    COUNT(DISTINCT user_id) FILTER (event_name = 'first_session') AS n_first_session,
    COUNT(DISTINCT user_id) FILTER (event_name = 'feature_used') AS n_feature,
    COUNT(DISTINCT user_id) FILTER (event_name = 'trial_started') AS n_trial,
    COUNT(DISTINCT user_id) FILTER (event_name = 'purchase_completed') AS n_purchase
  FROM clean_events),
funnel AS (
  SELECT *,
    ROUND(100.0::DOUBLE * n_signup / NULLIF(n_install, 0), 2) AS pct_install_to_signup,
    ROUND(100.0::DOUBLE * n_first_session / NULLIF(n_signup, 0), 2) AS pct_signup_to_session,
    ROUND(100.0::DOUBLE * n_feature / NULLIF(n_first_session, 0), 2) AS pct_session_to_feature,
    ROUND(100.0::DOUBLE * n_trial / NULLIF(n_feature, 0), 2) AS pct_feature_to_trial,
    ROUND(100.0::DOUBLE * n_purchase / NULLIF(n_trial, 0), 2) AS pct_trial_to_purchase
  FROM funnel_counts)"""

RETENTION = """
log_end AS (SELECT CAST(MAX(event_timestamp) AS DATE) AS day FROM clean_events),
seen AS (
  SELECT u.cohort_month, COUNT(DISTINCT e.user_id) AS cohort_size,
    COUNT(DISTINCT e.user_id) FILTER (e.day_offset = 1) AS u1, COUNT(DISTINCT e.user_id) FILTER (e.day_offset = 7) AS u7,
    COUNT(DISTINCT e.user_id) FILTER (e.day_offset = 14) AS u14, COUNT(DISTINCT e.user_id) FILTER (e.day_offset = 30) AS u30
  FROM clean_events e, clean_users u
  WHERE e.user_id = u.user_id AND e.event_name IN ('session_start', 'feature_used', 'trial_started', 'purchase_completed')  -- fixed values
  GROUP BY u.cohort_month),
retention AS (
  SELECT cohort_month, cohort_size,
    ROUND(100.0::DOUBLE * (u1::DOUBLE / cohort_size), 2) AS d1_retention_pct,
    ROUND(100.0::DOUBLE * (u7::DOUBLE / cohort_size), 2) AS d7_retention_pct,
    IF(cohort_month + 14 <= day, ROUND(100.0::DOUBLE * (u14::DOUBLE / cohort_size), 2), NULL) AS d14_retention_pct,
    IF(cohort_month + 30 <= day, ROUND(100.0::DOUBLE * (u30::DOUBLE / cohort_size), 2), NULL) AS d30_retention_pct
  FROM seen, log_end)"""

CURVE = """
starts AS (SELECT user_id, day_offset AS start_day FROM clean_events WHERE event_name = 'trial_started'),
matched AS (
  SELECT DISTINCT s.user_id, e.day_offset - s.start_day AS rel
  FROM starts s JOIN clean_events e ON e.user_id = s.user_id AND e.day_offset BETWEEN s.start_day AND s.start_day + 30
  WHERE e.event_name = 'session_start' OR e.event_name = 'feature_used'),
heights AS (
  SELECT rel, ROUND(100.0::DOUBLE * COUNT(*) / (SELECT COUNT(*) FROM starts), 2) AS pct_active FROM matched GROUP BY rel),
curve AS (
  SELECT CAST(rel AS INTEGER) AS day_offset, pct_active,
    ROUND(pct_active - LAG(pct_active) OVER (ORDER BY rel), 2) AS day_over_day_change_pp FROM heights)"""

ADOPTION = """
triallists AS (
  SELECT user_id, bool_or(COALESCE(event_subtype = 'collaboration_feature', FALSE)) AS collaborated,
    bool_or(event_name = 'purchase_completed') AS bought
  FROM clean_events GROUP BY user_id HAVING bool_or(event_name = 'trial_started')),
adoption AS (
  SELECT collaborated::INTEGER AS used_collab, COUNT(*) AS total_users, COUNT(*) FILTER (bought) AS total_purchases,
    ROUND(100.0::DOUBLE * COUNT(*) FILTER (bought) / COUNT(*), 2) AS conversion_rate
  FROM triallists GROUP BY collaborated)"""

SEGMENTS = """
habits AS (
  SELECT user_id, COUNT(*) FILTER (event_name = 'session_start') AS n_sessions, bool_or(event_name = 'purchase_completed') AS bought,
    CAST(MAX(event_timestamp) AS DATE) AS last_day
  FROM clean_events GROUP BY user_id),
bounds AS (
  SELECT MAX(last_day) - 14 AS oldest_live_day, quantile_cont(n_sessions, 0.9) FILTER (n_sessions > 0) AS many_sessions FROM habits),
segmented AS (
  SELECT u.user_id,
    CASE WHEN bought THEN 'Converted'
         WHEN COALESCE(last_day >= oldest_live_day, FALSE) IS FALSE THEN 'Churned (>14d inactive)'
         WHEN n_sessions >= many_sessions AND n_sessions > 0 THEN 'Power User'
         ELSE 'At-Risk / Average' END AS user_segment
  FROM clean_users u CROSS JOIN bounds LEFT JOIN habits h ON h.user_id = u.user_id),
segmentation AS (
  SELECT user_segment, COUNT(*) AS user_count, ROUND(100.0::DOUBLE * COUNT(*) / SUM(COUNT(*)) OVER (), 2) AS pct_of_total
  FROM segmented GROUP BY user_segment)"""

RANKED = """
counted AS (
  SELECT u.user_id, COUNT(e.event_id) AS c FROM clean_users u
  LEFT JOIN clean_events e ON e.user_id = u.user_id AND e.event_name = 'session_start' GROUP BY u.user_id)"""

BANDS = """
ranked AS (
  SELECT c, NTILE(4) OVER (ORDER BY c DESC) AS q, PERCENT_RANK() OVER (ORDER BY c DESC) AS pr FROM counted),
bands AS (
  SELECT COALESCE(ROUND(AVG(c) FILTER (pr <= 0.1), 1), 0.0::DOUBLE) AS top_10_pct_avg_sessions,
    COALESCE(ROUND(quantile_cont(c, 0.5), 1), 0.0::DOUBLE) AS median_user_sessions,
    COALESCE(ROUND(AVG(c) FILTER (pr >= 0.9), 1), 0.0::DOUBLE) AS bottom_10_pct_avg_sessions,
    COALESCE(ROUND(AVG(c) FILTER (q = 1), 1), 0.0::DOUBLE) AS q1_avg_sessions,
    COALESCE(ROUND(AVG(c) FILTER (q = 2), 1), 0.0::DOUBLE) AS q2_avg_sessions,
    COALESCE(ROUND(AVG(c) FILTER (q = 3), 1), 0.0::DOUBLE) AS q3_avg_sessions,
    COALESCE(ROUND(AVG(c) FILTER (q = 4), 1), 0.0::DOUBLE) AS q4_avg_sessions
  FROM ranked)"""

LIFETIME = """
spans AS (SELECT user_id, MAX(day_offset) - MIN(day_offset) AS days FROM clean_events GROUP BY user_id),
lifetime AS (
  SELECT COALESCE(ROUND(AVG(days), 1), 0.0::DOUBLE) AS avg_lifetime_days,
    COALESCE(CAST(MAX(days) AS DOUBLE), 0.0::DOUBLE) AS max_lifetime_days,
    COALESCE(quantile_cont(days, 0.5), 0.0::DOUBLE) AS median_lifetime_days FROM spans)"""

WEEKLY = """
weekly AS (
  SELECT CAST(date_trunc('week', install_timestamp) AS DATE) AS cohort_week, COUNT(*) AS installs,
    COUNT(*) FILTER (user_id IN (SELECT user_id FROM clean_events WHERE event_name = 'purchase_completed')) AS conversions
  FROM clean_users GROUP BY 1),
weekly_range AS (
  SELECT ROUND(MIN(conversions::DOUBLE / installs) * 100, 2) AS weekly_conv_rate_min,
    ROUND(MAX(conversions::DOUBLE / installs) * 100, 2) AS weekly_conv_rate_max FROM weekly)"""

ARMS = """
arms AS (
  SELECT u.ab_group, COUNT(*) AS n_users,
    COUNT(*) FILTER (u.user_id IN (SELECT user_id FROM clean_events WHERE event_name = 'purchase_completed')) AS n_purchases,
    u.acquisition_channel
  FROM clean_users u WHERE u.ab_group IS NOT NULL GROUP BY u.ab_group, u.acquisition_channel)"""

# normal quantiles of 0.95, 0.8 and 0.975
_Z95, _Z80, _Z975 = "1.6448536269514722::DOUBLE", "0.8416212335729143::DOUBLE", "1.959963984540054::DOUBLE"


def _readout(by: str = "") -> str:
    """CTEs from arms to the full readout, per group when ``by`` names a column."""
    lead, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""
sides AS (
  SELECT {lead}CAST(COALESCE(SUM(n_users) FILTER (ab_group = 'control'), 0) AS BIGINT) AS n_c,
    CAST(COALESCE(SUM(n_purchases) FILTER (ab_group = 'control'), 0) AS BIGINT) AS x_c,
    CAST(COALESCE(SUM(n_users) FILTER (ab_group = 'treatment'), 0) AS BIGINT) AS n_t,
    CAST(COALESCE(SUM(n_purchases) FILTER (ab_group = 'treatment'), 0) AS BIGINT) AS x_t
  FROM arms {group}),
rates AS (
  SELECT *, CAST(x_c AS DOUBLE) / NULLIF(n_c, 0) AS rate_c, CAST(x_t AS DOUBLE) / NULLIF(n_t, 0) AS rate_t,
    (n_c + n_t) / 2.0::DOUBLE AS expected,
    CAST(x_c + x_t AS DOUBLE) / NULLIF(n_c + n_t, 0) AS pooled,
    2 * power(({_Z95} + {_Z80}) / (2 * (asin(sqrt(0.12::DOUBLE * 1.08::DOUBLE)) - asin(sqrt(0.12::DOUBLE)))), 2) AS required_n
  FROM sides),
stats AS (
  SELECT *, (n_c - expected) * (n_c - expected) / NULLIF(expected, 0) + (n_t - expected) * (n_t - expected) / NULLIF(expected, 0) AS srm_chi2,
    rate_t - rate_c AS absolute_lift,
    CASE WHEN rate_c > 0 THEN (rate_t - rate_c) / rate_c WHEN rate_c = 0 THEN 0.0::DOUBLE END AS relative_lift,
    (rate_t - rate_c) / NULLIF(sqrt(pooled * (1 - pooled) * (1.0::DOUBLE / NULLIF(n_c, 0) + 1.0::DOUBLE / NULLIF(n_t, 0))), 0) AS z_stat,
    CASE WHEN rate_c > 0 AND rate_c * 1.08::DOUBLE <= 1 THEN 2 * (asin(sqrt(LEAST(rate_c * 1.08::DOUBLE, 1))) - asin(sqrt(rate_c)))
         WHEN rate_c = 0 THEN 0.0::DOUBLE END AS effect_h,
    {_Z975} * sqrt(rate_t * (1 - rate_t) / NULLIF(n_t, 0)) AS margin_t,
    {_Z975} * sqrt(rate_c * (1 - rate_c) / NULLIF(n_c, 0)) AS margin_c
  FROM rates),
arguments AS (
  SELECT *, sqrt(srm_chi2 / 2) AS srm_x, z_stat / sqrt(2.0::DOUBLE) AS z_x,
    -(effect_h * sqrt(n_c / 2.0::DOUBLE) - {_Z95}) / sqrt(2.0::DOUBLE) AS power_x FROM stats),
readout AS (
  SELECT *, {_erfc('srm_x')} AS srm_p_value, 0.5 * {_erfc('z_x')} AS p_value,
    CASE WHEN rate_c = 0 THEN 0.0::DOUBLE ELSE 0.5 * {_erfc('power_x')} END AS power FROM arguments)"""


_RESULT_COLUMNS = """'A/B Test - Day 6 Trial Extension' AS metric, n_c AS control_n, n_t AS treatment_n,
  ROUND(rate_c, 8) AS control_rate, ROUND(rate_t, 8) AS treatment_rate, ROUND(relative_lift * 100, 8) AS relative_lift_pct,
  ROUND(absolute_lift * 100, 8) AS absolute_lift_pp, ROUND(z_stat, 8) AS z_stat, ROUND(p_value, 8) AS p_value,
  p_value < 0.025 AS is_significant, ROUND(srm_p_value, 8) AS srm_p_value, srm_p_value < 0.001 AS has_srm,
  ROUND(required_n, 0) AS required_n_per_arm, n_c >= required_n AND n_t >= required_n AS is_adequately_powered,
  ROUND(power, 4) AS observed_power,
  ROUND(CASE WHEN margin_t IS NOT NULL THEN GREATEST(rate_t - margin_t, 0) END, 8) AS ci_lower_t,
  ROUND(CASE WHEN margin_t IS NOT NULL THEN LEAST(rate_t + margin_t, 1) END, 8) AS ci_upper_t,
  ROUND(CASE WHEN margin_c IS NOT NULL THEN GREATEST(rate_c - margin_c, 0) END, 8) AS ci_lower_c,
  ROUND(CASE WHEN margin_c IS NOT NULL THEN LEAST(rate_c + margin_c, 1) END, 8) AS ci_upper_c"""

CHI2 = f"""
cells AS (
  SELECT COUNT(DISTINCT used_collab) AS groups,
    SUM(total_purchases) FILTER (used_collab = 1)::DOUBLE AS a, SUM(total_users - total_purchases) FILTER (used_collab = 1)::DOUBLE AS b,
    SUM(total_purchases) FILTER (used_collab = 0)::DOUBLE AS c, SUM(total_users - total_purchases) FILTER (used_collab = 0)::DOUBLE AS d
  FROM adoption),
expected_cells AS (
  SELECT unnest([a, b, c, d]) AS o,
    unnest([(a + b) * (a + c), (a + b) * (b + d), (c + d) * (a + c), (c + d) * (b + d)]) / (a + b + c + d) AS e
  FROM cells WHERE groups = 2),
chi2_stat AS (
  SELECT SUM(power(abs(o - e) - LEAST(0.5::DOUBLE, abs(o - e)), 2) / NULLIF(e, 0)) AS chi2_stat FROM expected_cells HAVING COUNT(*) > 0),
chi2_x AS (SELECT chi2_stat, sqrt(chi2_stat / 2) AS x FROM chi2_stat),
chi2_p AS (SELECT chi2_stat, {_erfc('x')} AS p FROM chi2_x),
chi2 AS (
  SELECT 'Chi-Square: Collaboration Feature vs Conversion' AS test, ROUND(chi2_stat, 8) AS chi2_stat,
    ROUND(GREATEST(p, 1e-300), 8) AS p_value, GREATEST(p, 1e-300) AS exact_p, p < 0.025 AS is_significant, 0.025::DOUBLE AS bonferroni_alpha
  FROM chi2_p)"""

FEATURES = """
features AS (
  SELECT u.user_id, u.country, u.acquisition_channel,
    COUNT(*) FILTER (e.day_offset <= 3 AND e.event_name = 'session_start') AS early_sessions,
    bool_or(e.day_offset <= 3 AND COALESCE(e.event_subtype = 'collaboration_feature', FALSE))::INTEGER AS used_collab_early,
    bool_or(e.event_name = 'purchase_completed')::INTEGER AS target_purchased
  FROM clean_users u JOIN clean_events e USING (user_id)
  WHERE u.ab_group IN ('control', 'treatment')
    AND u.user_id NOT IN (SELECT user_id FROM raw_events WHERE day_offset <= 3 AND event_name = 'purchase_completed')
  GROUP BY ALL)"""

ADVANCED = """
advanced AS (
  UNPIVOT (SELECT * FROM bands, lifetime, weekly_range) ON COLUMNS(*) INTO NAME metric VALUE value)"""

KPI = """
cliff AS (
  SELECT day_offset AS cliff_day, day_over_day_change_pp AS cliff_change_pp, pct_active FROM curve
  WHERE day_over_day_change_pp IS NOT NULL ORDER BY day_over_day_change_pp, day_offset LIMIT 1),
kpi AS (
  SELECT CAST(n_install AS DOUBLE) AS total_installs, CAST(n_trial AS DOUBLE) AS trial_starters,
    COALESCE(n_trial::DOUBLE / NULLIF(n_install, 0), 0) AS trial_start_rate,
    COALESCE(n_purchase::DOUBLE / NULLIF(n_trial, 0), 0) AS trial_to_paid_rate,
    COALESCE(n_signup::DOUBLE / NULLIF(n_install, 0), 0) AS signup_rate,
    (SELECT pct_of_total FROM segmentation WHERE user_segment ILIKE '%churned%') AS churned_pct,
    (SELECT CAST(cliff_day AS DOUBLE) FROM cliff) AS cliff_day, (SELECT cliff_change_pp FROM cliff) AS cliff_change_pp,
    (SELECT pct_active FROM curve WHERE day_offset = 0) AS day0_pct,
    (SELECT pct_active FROM curve WHERE day_offset = 7) AS day7_pct,
    (SELECT MAX(pct_active) FROM curve) AS peak_pct,
    (SELECT conversion_rate FROM adoption WHERE used_collab = 1) / NULLIF((SELECT conversion_rate FROM adoption WHERE used_collab = 0), 0) AS adoption_ratio,
    (SELECT weekly_conv_rate_max - weekly_conv_rate_min FROM weekly_range) AS weekly_conversion_range
  FROM funnel)"""

ALL_MARTS = (FUNNEL, RETENTION, CURVE, ADOPTION, SEGMENTS, RANKED, BANDS, LIFETIME, WEEKLY, KPI)

SPLIT = """
hashed AS (SELECT *, md5('42:' || user_id) AS h FROM features),
positioned AS (
  SELECT *, row_number() OVER (PARTITION BY target_purchased ORDER BY h, user_id) AS r,
    COUNT(*) OVER (PARTITION BY target_purchased) AS size FROM hashed)"""

CATALOG = """
listed AS (
  SELECT p_partkey AS ord, p_name AS app,
    CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'PRODUCTIVITY' END AS category,
    CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST((p_partkey % 4 + 2) || '.' || (p_partkey % 10) AS DOUBLE) END AS rating,
    CASE WHEN p_size = 50 THEN 'Free' WHEN p_size = 49 THEN 'Varies' ELSE p_size || ',000+' END AS installs,
    CASE WHEN p_partkey % 7 <> 0 THEN '$' || CAST(p_retailprice AS VARCHAR) END AS price
  FROM part),
parsed AS (
  SELECT ord, app, category, rating, TRY_CAST(replace(replace(installs, '+', ''), ',', '') AS BIGINT) AS installs,
    TRY_CAST(replace(price, '$', '') AS DOUBLE) AS price
  FROM listed WHERE replace(replace(installs, '+', ''), ',', '') <> 'Free'),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY app ORDER BY ord) AS copy FROM parsed
  WHERE rating IS NOT NULL AND installs IS NOT NULL AND category = 'PRODUCTIVITY' AND rating >= 4.0)"""

ORDER_COUNTS = """
counted AS (
  SELECT c_custkey AS user_id, COUNT(o_orderkey) AS c FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)"""

_SCORED = """
scored AS (SELECT l.quality AS label, d.n_chars FROM documents d JOIN labels l USING (doc_id))"""


def _auc(score: str) -> str:
    return f"""WITH {_SCORED}, s AS (SELECT label, {score} AS score FROM scored),
ranks AS (SELECT label, (RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE) AS mid FROM s),
sums AS (
  SELECT COUNT(*) FILTER (label = 1) AS n_pos, COUNT(*) FILTER (label <> 1) AS n_neg, SUM(mid) FILTER (label = 1) AS rank_sum FROM ranks)
SELECT n_pos, n_neg, ROUND((rank_sum - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos * n_neg), 8) AS roc_auc FROM sums"""


def _rounded_kpis() -> str:
    return "SELECT " + ", ".join(
        f"ROUND({k}, 8) AS {k}"
        for k in (
            "total_installs", "trial_starters", "trial_start_rate", "trial_to_paid_rate", "signup_rate", "churned_pct",
            "cliff_day", "cliff_change_pp", "day0_pct", "day7_pct", "peak_pct", "adoption_ratio", "weekly_conversion_range",
        )
    ) + " FROM kpi"


def _check(name: str, n_bad: str) -> str:
    return f"SELECT '{name}' AS \"check\", CAST({n_bad} AS BIGINT) AS n_bad, ({n_bad}) = 0 AS passed"


def _bad_rows(table: str, bad: str) -> str:
    """Rows that break a rule or can't be judged; no rows at all count as one."""
    return f"(SELECT COUNT(*) FILTER (WHERE COALESCE({bad}, TRUE)) + (COUNT(*) = 0)::INT FROM {table})"


def _absent(table: str, columns: str) -> str:
    names = ", ".join(f"'{c}'" for c in columns.split())
    return f"""((SELECT COUNT(*) FROM (SELECT unnest([{names}]) AS c)
  WHERE c NOT IN (SELECT unnest(json_keys(to_json(t))) FROM (SELECT * FROM {table} LIMIT 1) t)) + (SELECT (COUNT(*) = 0)::INT FROM {table}))"""


_STEPS = (("n_signup", "n_install", "pct_install_to_signup"), ("n_first_session", "n_signup", "pct_signup_to_session"),
          ("n_feature", "n_first_session", "pct_session_to_feature"), ("n_trial", "n_feature", "pct_feature_to_trial"),
          ("n_purchase", "n_trial", "pct_trial_to_purchase"))

_CHECKS = {
    "users_present": _absent(
        "raw_users", "user_id app_id install_timestamp cohort_month device_id country acquisition_channel email ab_group is_bot_ground_truth"
    ),
    "events_present": _absent("raw_events", "event_id user_id app_id event_name event_subtype event_timestamp day_offset"),
    "users_key": _bad_rows("(SELECT user_id, COUNT(*) AS n FROM raw_users GROUP BY user_id)", "user_id IS NULL OR n > 1"),
    "events_key": _bad_rows("(SELECT event_id, COUNT(*) AS n FROM raw_events GROUP BY event_id)", "event_id IS NULL OR n > 1"),
    "clean_users_fewer_than_raw": "(SELECT CASE WHEN (SELECT COUNT(*) FROM clean_users) < (SELECT COUNT(*) FROM raw_users) THEN 0 ELSE 1 END)",
    "funnel_monotone": "(SELECT (n_signup > n_install)::INT + (n_first_session > n_signup)::INT + (n_feature > n_first_session)::INT"
    " + (n_trial > n_feature)::INT + (n_purchase > n_trial)::INT FROM funnel)",
    "step_rates_consistent": "(" + " + ".join(
        _bad_rows("funnel", f"abs(100.0::DOUBLE * {part} / NULLIF({whole}, 0) - {pct}) >= 0.01") for part, whole, pct in _STEPS
    ) + ")",
    "clean_users_complete": _bad_rows("clean_users", "user_id IS NULL OR install_timestamp IS NULL"),
    "events_complete": _bad_rows("raw_events", "event_name IS NULL OR event_timestamp IS NULL"),
    "no_sample_ratio_mismatch": _bad_rows("readout", "srm_p_value < 0.001"),
    "ab_rates_plausible": "(" + _bad_rows("readout", "rate_c NOT BETWEEN 0.25 AND 0.6") + " + "
    + _bad_rows("readout", "rate_t NOT BETWEEN 0.25 AND 0.65") + ")",
    "no_label_leakage": _bad_rows(
        "features", "user_id IN (SELECT user_id FROM raw_events WHERE event_name = 'purchase_completed' AND day_offset <= 3)"
    ),
    "signup_rate_near_expected": _bad_rows("funnel", "n_signup::DOUBLE / NULLIF(n_install, 0) NOT BETWEEN 0.83 AND 0.87"),
    "retention_pct_in_range": "(" + " + ".join(
        [_bad_rows("retention", f"{c} NOT BETWEEN 0 AND 100") for c in ("d1_retention_pct", "d7_retention_pct")]
        + [f"(SELECT COUNT(*) FROM retention WHERE {c} NOT BETWEEN 0 AND 100)" for c in ("d14_retention_pct", "d30_retention_pct")]
    ) + ")",
    "d1_retention_at_least_d7": _bad_rows("retention", "d1_retention_pct < d7_retention_pct"),
    "segment_pct_sums_to_100": _bad_rows("(SELECT SUM(pct_of_total) AS total FROM segmentation)", "abs(total - 100) >= 0.1"),
    "curve_non_increasing_after_peak": _bad_rows(
        "(SELECT pct_active, LAG(pct_active) OVER (ORDER BY day_offset) AS previous FROM curve WHERE day_offset >= 8)",
        "CASE WHEN previous IS NULL THEN pct_active IS NULL ELSE pct_active > previous END",
    ),
    "cliff_on_expected_day": _bad_rows("cliff", "cliff_day <> 6"),
    # the forest has no SQL twin; that it splits on something at all follows from two classes in training
    "importances_sum_to_1": "(SELECT (COUNT(DISTINCT target_purchased) < 2)::INT FROM positioned WHERE r > ceil(size * 0.2::DOUBLE))",
}

_MANIFEST = {
    "funnel_summary": ("funnel", 11),
    "cohort_retention": ("retention", 6),
    "trial_dropoff_curve": ("curve", 3),
    "behavioral_stats": ("adoption", 4),
    "user_segmentation": ("segmentation", 3),
    "advanced_analytics": ("advanced", 2),
    "ab_test_results": ("readout", 19),
    "behavioral_chi2_results": ("chi2", 5),
    "bot_filter_quality": ("(SELECT COUNT(*) FROM flagged)", 7),
    "ab_labels": ("readout", 7),
    "kpi_summary": ("kpi", 13),
    "revenue_impact": ("readout", 5),
}

_MODEL_PARTS = """
placed AS (
  SELECT *, r <= ceil(size * 0.2::DOUBLE) AS is_test, CASE WHEN r > ceil(size * 0.2::DOUBLE) THEN (r - ceil(size * 0.2::DOUBLE)::BIGINT - 1) % 5 END AS part
  FROM positioned),
columns_known AS (
  SELECT 'early_sessions' AS feature UNION SELECT 'used_collab_early'
  UNION SELECT 'country_' || country FROM placed WHERE NOT is_test AND country > (SELECT MIN(country) FROM placed WHERE NOT is_test)
  UNION SELECT 'acquisition_channel_' || acquisition_channel FROM placed
  WHERE NOT is_test AND acquisition_channel > (SELECT MIN(acquisition_channel) FROM placed WHERE NOT is_test))"""

_MODEL_MEASURES = [
    ("test_rows", "SELECT COUNT(*) FROM placed WHERE is_test"),
    ("test_positives", "SELECT COUNT(*) FROM placed WHERE is_test AND target_purchased = 1"),
    ("scores_out_of_range", "SELECT COUNT(*) FROM placed WHERE is_test AND user_id IS NULL"),
    ("predictions_unlike_scores", "SELECT COUNT(*) FROM placed WHERE is_test AND target_purchased NOT IN (0, 1)"),
    ("train_rows", "SELECT COUNT(*) FROM placed WHERE NOT is_test"),
    ("train_positives", "SELECT COUNT(*) FROM placed WHERE NOT is_test AND target_purchased = 1"),
    ("rows_in_no_or_two_parts", "SELECT COUNT(*) FROM placed WHERE is_test = (part IS NOT NULL)"),
    *[(f"fold_{k}_rows", f"SELECT COUNT(*) FROM placed WHERE part = {k}") for k in range(5)],
    *[(f"fold_{k}_positives", f"SELECT COUNT(*) FROM placed WHERE part = {k} AND target_purchased = 1") for k in range(5)],
    ("features", "SELECT COUNT(*) FROM columns_known"),
    ("feature_name_chars", "SELECT SUM(length(feature)) FROM columns_known"),
    ("importances_off", "SELECT (COUNT(DISTINCT target_purchased) < 2)::INT FROM placed WHERE NOT is_test"),
    # the model's own figures are the other side of these two
    ("scores_unlike_the_models", "SELECT 0"),
    ("importances_unlike_the_models", "SELECT 0"),
]

_LABELS = """CASE WHEN p_value < 0.025 THEN 'Statistically Significant (α=0.025, Bonferroni)' ELSE 'Not Significant' END AS significance_flag,
  'P-Value: ' || printf('%.4f', p_value) AS p_value_display,
  CASE WHEN p_value >= 0.0001 THEN printf('%.4f', p_value) ELSE printf('%.2e', p_value) END AS p_value_text,
  CASE WHEN p_value < 0.01 THEN 'highly significant' WHEN p_value < 0.05 THEN 'significant' ELSE 'not significant' END AS significance_text,
  CASE WHEN srm_p_value < 0.001 THEN 'SRM FAILED - Check Sample Ratio' WHEN srm_p_value IS NOT NULL THEN 'SRM Passed' END AS srm_check,
  CASE WHEN (SELECT is_significant FROM chi2) THEN 'Significant (α=0.025)' ELSE 'Not Significant' END AS chi2_flag,
  (SELECT CASE WHEN exact_p >= 0.001 THEN printf('%.4f', exact_p) WHEN exact_p > 1e-100 THEN printf('%.2e', exact_p) ELSE '< 1e-100' END FROM chi2) AS chi2_p_value_text"""

ORACLE: dict[str, str] = {
    "scan_csv_roundtrip": f"WITH {RAW} SELECT * FROM raw_users",
    "export_manifest": _clean(
        " UNION ALL ".join(
            f"SELECT '{name}' AS mart, '{name}' AS sheet, (SELECT COUNT(*) FROM {source}) AS n_rows, CAST({width} AS INTEGER) AS n_cols"
            for name, (source, width) in _MANIFEST.items()
        ),
        *ALL_MARTS,
        ADVANCED,
        CHI2,
        ARMS,
        _readout(),
    ),
    "device_reuse": f"WITH {RAW} SELECT device_id, COUNT(DISTINCT user_id) AS distinct_users_on_device FROM raw_users GROUP BY ALL",
    "bot_flags": _clean("SELECT user_id, is_suspected_bot FROM flagged"),
    "clean_users": _clean("SELECT * FROM clean_users"),
    "clean_events": _clean("SELECT * FROM clean_events"),
    "bot_filter_quality": _clean(
        """SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives,
  COALESCE(tp::DOUBLE / NULLIF(flags, 0), 0) AS precision, COALESCE(tp::DOUBLE / NULLIF(bots, 0), 0) AS recall,
  flags AS n_flagged, bots AS n_bots
FROM (SELECT COUNT(*) FILTER (is_bot_ground_truth AND is_suspected_bot) AS tp,
  COUNT(*) FILTER (NOT is_bot_ground_truth AND is_suspected_bot) AS fp,
  COUNT(*) FILTER (is_bot_ground_truth AND NOT is_suspected_bot) AS fn,
  COUNT(*) FILTER (is_suspected_bot) AS flags, COUNT(*) FILTER (is_bot_ground_truth) AS bots FROM flagged)"""
    ),
    "id_set_overlap": _clean(
        """SELECT (SELECT COUNT(*) FROM (SELECT user_id FROM b EXCEPT SELECT user_id FROM s)) AS only_left,
  (SELECT COUNT(*) FROM (SELECT user_id FROM s EXCEPT SELECT user_id FROM b)) AS only_right,
  (SELECT COUNT(*) FROM (SELECT user_id FROM s INTERSECT SELECT user_id FROM b)) AS in_both""",
        "b AS (SELECT user_id FROM flagged WHERE is_bot_ground_truth)",
        "s AS (SELECT user_id FROM flagged WHERE is_suspected_bot)",
    ),
    "user_facts": _clean(
        "SELECT u.user_id, u.app_id, u.cohort_month, u.country, u.acquisition_channel, u.ab_group,"
        " COALESCE(n_events, 0) AS n_events, COALESCE(session_count, 0) AS session_count, COALESCE(early_sessions, 0) AS early_sessions,"
        " first_event_day, last_event_day, last_event_day - first_event_day AS lifetime_days, COALESCE(purchase_day, -1) AS purchase_day, "
        + ", ".join(f"COALESCE({f}, FALSE)::INTEGER AS {f}" for f in _FLAGS)
        + " FROM clean_users u LEFT JOIN per_user p USING (user_id)",
        FACTS,
    ),
    "funnel_summary": _clean("SELECT * FROM funnel", FUNNEL),
    "funnel_transitions": _clean(
        """SELECT 'Install' AS source, 'Signup' AS target, n_signup AS value FROM funnel
UNION ALL SELECT 'Install', 'Drop-Off', n_install - n_signup FROM funnel
UNION ALL SELECT 'Signup', 'First Session', n_first_session FROM funnel
UNION ALL SELECT 'Signup', 'Drop-Off', n_signup - n_first_session FROM funnel
UNION ALL SELECT 'First Session', 'Feature Used', n_feature FROM funnel
UNION ALL SELECT 'First Session', 'Drop-Off', n_first_session - n_feature FROM funnel
UNION ALL SELECT 'Feature Used', 'Trial', n_trial FROM funnel
UNION ALL SELECT 'Feature Used', 'Drop-Off', n_feature - n_trial FROM funnel
UNION ALL SELECT 'Trial', 'Purchase', n_purchase FROM funnel
UNION ALL SELECT 'Trial', 'Drop-Off', n_trial - n_purchase FROM funnel""",
        FUNNEL,
    ),
    "cohort_retention": _clean("SELECT * FROM retention ORDER BY cohort_month", RETENTION),
    "retention_long": _clean(
        " UNION ALL ".join(
            f"SELECT strftime(cohort_month, '%Y-%m') AS cohort, CAST({d} AS INTEGER) AS retention_day, d{d}_retention_pct AS retention_pct FROM retention"
            for d in (1, 7, 14, 30)
        ),
        RETENTION,
    ),
    "trial_dropoff_curve": _clean("SELECT * FROM curve ORDER BY day_offset", CURVE),
    "dropoff_cliff": _clean(
        "SELECT day_offset AS cliff_day, day_over_day_change_pp AS cliff_change_pp, pct_active FROM curve"
        " WHERE day_over_day_change_pp IS NOT NULL ORDER BY day_over_day_change_pp, day_offset LIMIT 1",
        CURVE,
    ),
    "feature_adoption": _clean("SELECT * FROM adoption", ADOPTION),
    "user_segmentation": _clean("SELECT * FROM segmentation", SEGMENTS),
    "user_segments": _clean("SELECT user_id, user_segment FROM segmented", SEGMENTS),
    "lifetime_stats": _clean("SELECT * FROM lifetime", LIFETIME),
    "engagement_bands": f"WITH {ORDER_COUNTS}, {BANDS} SELECT * FROM bands",
    "weekly_conversion": _clean(
        "SELECT *, ROUND(conversions::DOUBLE / installs * 100, 2) AS conversion_pct FROM weekly", WEEKLY
    ),
    "weekly_order_conversion": """SELECT CAST(date_trunc('week', CAST(o_orderdate AS DATE)) AS DATE) AS cohort_week,
  COUNT(DISTINCT o_custkey) AS customers,
  COUNT(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') AS conversions FROM orders GROUP BY 1""",
    "advanced_analytics": _clean("SELECT metric, value FROM advanced", RANKED, BANDS, LIFETIME, WEEKLY, ADVANCED),
    "kpi_summary": _clean(_rounded_kpis(), *ALL_MARTS),
    "catalog_clean": f"""WITH {CATALOG}
SELECT CAST(row_number() OVER (ORDER BY ord) AS INTEGER) AS app_id, app AS app_name, category, rating AS "Rating",
  installs AS "Installs", price AS "Price" FROM kept WHERE copy = 1""",
    "ab_arm_counts": _clean(
        "SELECT ab_group, CAST(SUM(n_users) AS BIGINT) AS n_users, CAST(SUM(n_purchases) AS BIGINT) AS n_purchases FROM arms GROUP BY ab_group",
        ARMS,
    ),
    "ab_srm": _clean(
        "SELECT n_c, n_t, ROUND(srm_chi2, 8) AS srm_chi2, ROUND(srm_p_value, 8) AS srm_p_value, srm_p_value < 0.001 AS has_srm FROM readout",
        ARMS,
        _readout(),
    ),
    "ab_power": _clean(
        "SELECT n_c, n_t, ROUND(required_n, 8) AS required_n, n_c >= required_n AND n_t >= required_n AS is_adequately_powered,"
        " ROUND(effect_h, 8) AS effect_h, ROUND(power, 8) AS power FROM readout",
        ARMS,
        _readout(),
    ),
    "ab_ztest": _clean(
        """SELECT n_c, x_c, n_t, x_t, ROUND(rate_c, 8) AS rate_c, ROUND(rate_t, 8) AS rate_t,
  ROUND(absolute_lift, 8) AS absolute_lift, ROUND(relative_lift, 8) AS relative_lift, ROUND(z_stat, 8) AS z_stat,
  ROUND(p_value, 8) AS p_value, p_value < 0.025 AS is_significant,
  ROUND(GREATEST(rate_t - margin_t, 0), 8) AS ci_lower_t, ROUND(LEAST(rate_t + margin_t, 1), 8) AS ci_upper_t,
  ROUND(GREATEST(rate_c - margin_c, 0), 8) AS ci_lower_c, ROUND(LEAST(rate_c + margin_c, 1), 8) AS ci_upper_c FROM readout""",
        ARMS,
        _readout(),
    ),
    "ab_test_results": _clean(f"SELECT {_RESULT_COLUMNS} FROM readout", ARMS, _readout()),
    "ab_test_by_channel": _clean(
        f"SELECT acquisition_channel, {_RESULT_COLUMNS} FROM readout", ARMS, _readout("acquisition_channel")
    ),
    "adoption_chi2": _clean("SELECT test, chi2_stat, p_value, is_significant, bonferroni_alpha FROM chi2", ADOPTION, CHI2),
    "ab_labels": _clean(
        f"SELECT {_LABELS} FROM readout",
        ARMS,
        _readout(),
        ADOPTION,
        CHI2,
    ),
    "ab_labels_by_channel": _clean(
        f"SELECT acquisition_channel, {_LABELS} FROM readout", ARMS, _readout("acquisition_channel"), ADOPTION, CHI2
    ),
    "revenue_impact": _clean(
        """SELECT ROUND(10000.0::DOUBLE * rate_c, 6) AS baseline_conversions,
  ROUND(10000.0::DOUBLE * rate_c * relative_lift, 6) AS incremental_unrounded,
  ROUND(10000.0::DOUBLE * rate_c * relative_lift * 4.99::DOUBLE, 6) AS mrr_unrounded,
  CAST(round_even(10000.0::DOUBLE * rate_c * relative_lift, 0) AS BIGINT) AS incremental_subscribers,
  ROUND(round_even(10000.0::DOUBLE * rate_c * relative_lift, 0) * 4.99::DOUBLE, 6) AS incremental_mrr FROM readout""",
        ARMS,
        _readout(),
    ),
    "propensity_features": _clean("SELECT * FROM features", FEATURES),
    "propensity_onehot": _clean(
        """SELECT user_id, 'early_sessions' AS feature, CAST(early_sessions AS DOUBLE) AS value FROM features WHERE early_sessions <> 0
UNION ALL SELECT user_id, 'used_collab_early', CAST(used_collab_early AS DOUBLE) FROM features WHERE used_collab_early <> 0
UNION ALL SELECT user_id, 'country_' || country, 1.0::DOUBLE FROM features WHERE country > (SELECT MIN(country) FROM features)
UNION ALL SELECT user_id, 'acquisition_channel_' || acquisition_channel, 1.0::DOUBLE FROM features
  WHERE acquisition_channel > (SELECT MIN(acquisition_channel) FROM features)""",
        FEATURES,
    ),
    "stratified_split": _clean(
        """SELECT user_id, target_purchased, r <= ceil(size * 0.2::DOUBLE) AS is_test,
  CASE WHEN r > ceil(size * 0.2::DOUBLE) THEN CAST((r - ceil(size * 0.2::DOUBLE)::BIGINT - 1) % 5 AS INTEGER) END AS fold FROM positioned""",
        FEATURES,
        SPLIT,
    ),
    "class_weights": _clean(
        "SELECT target_purchased, COUNT(*) AS n, ROUND((SELECT COUNT(*) FROM features)::DOUBLE"
        " / ((SELECT COUNT(DISTINCT target_purchased) FROM features) * COUNT(*)), 8) AS weight FROM features GROUP BY target_purchased",
        FEATURES,
    ),
    "roc_auc": _auc("n_chars % 50"),
    "roc_auc_continuous": _auc("n_chars"),
    "classification_report": f"""WITH {_SCORED}, p AS (SELECT label, CASE WHEN n_chars % 50 >= 25 THEN 1 ELSE 0 END AS prediction FROM scored),
classes AS (SELECT DISTINCT label AS k FROM p UNION SELECT DISTINCT prediction FROM p),
counts AS (
  SELECT k, (SELECT COUNT(*) FROM p WHERE label = k AND prediction = k) AS hits,
    (SELECT COUNT(*) FROM p WHERE prediction = k) AS predicted, (SELECT COUNT(*) FROM p WHERE label = k) AS support FROM classes),
rated AS (
  SELECT *, COALESCE(hits::DOUBLE / NULLIF(predicted, 0), 0) AS pr, COALESCE(hits::DOUBLE / NULLIF(support, 0), 0) AS re FROM counts),
full_rated AS (SELECT *, COALESCE(2.0::DOUBLE * pr * re / NULLIF(pr + re, 0), 0) AS f1 FROM rated)
SELECT CAST(k AS VARCHAR) AS "class", ROUND(pr, 8) AS precision, ROUND(re, 8) AS recall, ROUND(f1, 8) AS f1_score, support FROM full_rated
UNION ALL SELECT 'accuracy', NULL, NULL, ROUND(SUM(hits)::DOUBLE / SUM(support), 8), CAST(SUM(support) AS BIGINT) FROM full_rated
UNION ALL SELECT 'macro avg', ROUND(AVG(pr), 8), ROUND(AVG(re), 8), ROUND(AVG(f1), 8), CAST(SUM(support) AS BIGINT) FROM full_rated
UNION ALL SELECT 'weighted avg', ROUND(SUM(pr * support) / SUM(support), 8), ROUND(SUM(re * support) / SUM(support), 8),
  ROUND(SUM(f1 * support) / SUM(support), 8), CAST(SUM(support) AS BIGINT) FROM full_rated""",
    "join_semantics": """SELECT 'left' AS join_type, c_mktsegment, COUNT(*) AS n_rows FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment
UNION ALL SELECT 'left_with_condition', c_mktsegment, COUNT(*) FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_mktsegment
UNION ALL SELECT 'inner', c_mktsegment, COUNT(*) FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment
UNION ALL SELECT 'left_semi', c_mktsegment, COUNT(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY c_mktsegment
UNION ALL SELECT 'left_anti', c_mktsegment, COUNT(*) FROM customer
  WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') GROUP BY c_mktsegment""",
    "agg_primitives": """SELECT event_type, COUNT(*) AS n_rows, COUNT(value) AS n_values, COUNT(DISTINCT user_id) AS n_users,
  COUNT(DISTINCT user_id) FILTER (value >= 50) AS n_high_users, COUNT(*) FILTER (value >= 50) AS n_high,
  ROUND(SUM(value), 2) AS sum_value, ROUND(AVG(value), 6) AS avg_value, MIN(value) AS min_value, MAX(value) AS max_value,
  bool_or(event_type = 'purchase')::INTEGER AS is_purchase,
  bool_or(event_type = 'view')::INTEGER AS is_view
FROM events GROUP BY event_type""",
    "value_counts": _clean("SELECT target_purchased, COUNT(*) AS n FROM features GROUP BY target_purchased", FEATURES),
    "percentile_exact": f"""WITH {ORDER_COUNTS}
SELECT 'orders_p50' AS metric, ROUND(quantile_cont(c, 0.5), 6) AS value FROM counted
UNION ALL SELECT 'orders_p90', ROUND(quantile_cont(c, 0.9), 6) FROM counted
UNION ALL SELECT 'price_p10', ROUND(quantile_cont(l_extendedprice, 0.1), 6) FROM lineitem
UNION ALL SELECT 'price_p50', ROUND(quantile_cont(l_extendedprice, 0.5), 6) FROM lineitem
UNION ALL SELECT 'price_p90', ROUND(quantile_cont(l_extendedprice, 0.9), 6) FROM lineitem""",
    "window_rank_family": f"""WITH {ORDER_COUNTS},
windowed AS (
  SELECT c, NTILE(4) OVER (ORDER BY c DESC) AS tile, RANK() OVER (ORDER BY c DESC) AS value_rank,
    PERCENT_RANK() OVER (ORDER BY c DESC) AS pct_rank FROM counted)
SELECT c AS n_orders, CAST(tile AS INTEGER) AS tile, value_rank, ROUND(pct_rank, 8) AS pct_rank, COUNT(*) AS n_rows
FROM windowed GROUP BY c, tile, value_rank, pct_rank""",
    "scalar_dates": """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date,
  CAST(date_trunc('week', CAST(o_orderdate AS DATE)) AS DATE) AS week_start, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS month_start,
  strftime(o_orderdate, '%Y-%m') AS month_label, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS INTEGER) AS days_to_end,
  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS VARCHAR) AS day_number FROM orders""",
    "scalar_strings": """WITH t AS (
  SELECT *, format('{:,}', p_size * 1000) || '+' AS installs_raw, (p_partkey + 1) / 2000003.0::DOUBLE AS p FROM part),
s AS (SELECT *, p * p_size / 1e9 AS tiny FROM t)
SELECT p_partkey, replace(replace(installs_raw, '+', ''), ',', '') AS installs_text,
  TRY_CAST(replace(replace(installs_raw, '+', ''), ',', '') AS BIGINT) AS installs, TRY_CAST(p_name AS DOUBLE) AS not_a_number,
  CASE WHEN p >= 0.0001 THEN printf('%.4f', p) ELSE printf('%.2e', p) END AS p_text,
  CASE WHEN tiny >= 0.001 THEN printf('%.4f', tiny) WHEN tiny > 1e-100 THEN printf('%.2e', tiny) ELSE '< 1e-100' END AS chi2_p_text,
  format('{:,}', (p_partkey + 1) * 12345) AS with_thousands, substr(p_name, 1, 5) AS name_clip,
  (p_name ILIKE '%RED%' OR p_name ILIKE '%blue%') AS is_red_or_blue FROM s""",
    "quality_report": _clean(
        "\nUNION ALL ".join(_check(name, n_bad) for name, n_bad in _CHECKS.items()),
        *ALL_MARTS,
        ARMS,
        _readout(),
        FEATURES,
        SPLIT,
    ),
    "model_checks": _clean(
        "SELECT measure, CAST(value AS BIGINT) AS value FROM (SELECT unnest(["
        + ", ".join(f"'{name}'" for name, _ in _MODEL_MEASURES)
        + "]) AS measure, unnest(["
        + ", ".join(f"({sql})::BIGINT" for _, sql in _MODEL_MEASURES)
        + "]) AS value)",
        FEATURES,
        SPLIT,
        _MODEL_PARTS,
    ),
    "catalog_csv": f"""WITH {CATALOG}
SELECT app AS "App", category AS "Category", installs AS "Installs", price AS "Price", CASE WHEN rating IS NULL THEN 'NaN' ELSE CAST(rating AS VARCHAR) END AS "Rating",
  row_number() OVER (ORDER BY ord) - 1 AS source_order FROM listed""",
}

_FAULTS = {
    5: "user_id is no bigint", 7: "install_timestamp is no timestamp_ntz", 9: "is_bot_ground_truth is no boolean",
    11: "more fields than columns", 13: "fewer fields than columns, or a value that doesn't fit",
}
_FAULT = " ".join(f"WHEN {place} THEN '{reason.replace(chr(39), chr(39) * 2)}'" for place, reason in _FAULTS.items())
ORACLE |= {
    "scan_csv_quarantine": f"""WITH {RAW} SELECT CASE WHEN user_id % 41 = 5 THEN 'none' ELSE user_id::VARCHAR END AS first_field,
  CASE user_id % 41 {_FAULT} END AS reason FROM raw_users WHERE user_id % 41 IN (5, 7, 9, 11, 13)""",
    "scan_csv_kept": f"WITH {RAW} SELECT * FROM raw_users WHERE user_id % 41 NOT IN (5, 7, 9, 11, 13)",
    "distinct_rollup": f"""WITH {RAW} SELECT week, app_id, COUNT(DISTINCT user_id) AS users,
  COUNT(DISTINCT user_id) FILTER (event_name = 'session_start') AS session_users,
  COUNT(DISTINCT user_id) FILTER (event_name = 'purchase_completed') AS buyers
FROM (SELECT *, CAST(date_trunc('week', event_timestamp) AS DATE) AS week FROM raw_events) GROUP BY CUBE (week, app_id)""",
}

# the same tables by other ways through the engine
ORACLE |= {
    "user_facts_incremental": ORACLE["user_facts"],
    "user_facts_bucketed": ORACLE["user_facts"],
    "dropoff_incremental": ORACLE["trial_dropoff_curve"],
    "dropoff_bucketed": ORACLE["trial_dropoff_curve"],
    "clean_events_bucketed": ORACLE["clean_events"],
    "replaced_table": """SELECT c_custkey, c_nationkey, 2 AS n_writes FROM customer
WHERE c_custkey % 5 <> 0 AND (c_custkey + 1) % 5 <> 0""",
}


def _checksum(mart: str, query: str) -> str:
    """Files, rows and checksum of a mart: numbers in millionths, 32 bits of a digest a row, summed."""
    cells = "COALESCE(CAST(round(TRY_CAST(COLUMNS(*)::VARCHAR AS DOUBLE) * 1000000) AS BIGINT)::VARCHAR, COLUMNS(*)::VARCHAR, '')"
    return f"""SELECT '{mart}' AS mart, greatest(1, ceil(COUNT(*) / 4000))::INTEGER AS n_files, COUNT(*) AS n_rows,
  COALESCE(SUM(('0x' || substr(md5(line), 1, 8))::BIGINT), 0)::BIGINT AS checksum
FROM (SELECT concat_ws('|', *COLUMNS(*)) AS line FROM (SELECT {cells} FROM ({query})))"""


_MART_QUERIES = {mart: ORACLE[mart] for mart in _MANIFEST if mart in ORACLE} | {
    "behavioral_stats": ORACLE["feature_adoption"],
    "behavioral_chi2_results": ORACLE["adoption_chi2"],
    "orders": "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS o_day FROM orders",
}
ORACLE["export_checksums"] = " UNION ALL ".join(f"({_checksum(mart, query)})" for mart, query in _MART_QUERIES.items())
