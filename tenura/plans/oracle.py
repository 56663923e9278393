"""Plain SQL statements of the registered queries, over the whole tables, for checking them."""

from __future__ import annotations

from tenura.operators import signals as lexicon
from tenura.plans.newton_sql import newton_steps, normal_tail

L_CTE = """
pairs AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id,
         CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS duration,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS event,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
         l_linestatus AS line_status, o_orderstatus AS order_status, o_orderpriority AS priority
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ranged AS (SELECT * FROM pairs WHERE duration BETWEEN 0.5 AND 5000),
firsts AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, item_id
             ORDER BY duration, event, quantity, price, discount, tax, line_status, order_status, priority) AS rn
    FROM ranged) WHERE rn = 1),
per_user AS (SELECT o_custkey AS user_id, count(*) AS n_orders FROM orders GROUP BY o_custkey),
L AS (
  SELECT f.user_id, item_id, duration, event, priority,
         ln(1 + quantity) AS log_playtime_2weeks,
         ln(1 + n_orders) AS log_items_count,
         1 - 20 * discount AS sentiment_score,
         tax / 0.08 AS frustration_level,
         CASE WHEN line_status = 'F' THEN 1 ELSE 0 END AS technical_issue,
         CASE WHEN price > 53000 THEN 1 ELSE 0 END AS value_complaint,
         CASE WHEN order_status = 'F' THEN 1 ELSE 0 END AS engagement_dropped,
         CASE WHEN event = 0 AND substr(md5(concat_ws('|', CAST(f.user_id AS VARCHAR),
                   CAST(item_id AS VARCHAR), '0')), 1, 1) < '8' THEN 1 ELSE 0 END AS positive_signal
  FROM firsts f JOIN per_user u ON f.user_id = u.user_id)"""

T_CTE = r"""
reviews AS (
  SELECT source AS user_id, d.doc_id AS item_id, quality = 1 AS recommend,
         regexp_replace(coalesce(text, ''), '^[\s\p{Z}\x{0085}\x{000B}]+|[\s\p{Z}\x{0085}\x{000B}]+$', '', 'g') AS review_text
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
per_lang AS (SELECT lang, count(*) AS items_count FROM documents GROUP BY lang),
items AS (
  SELECT d.source AS user_id, doc_id AS item_id, n_chars / 60.0::DOUBLE AS playtime_forever,
         (doc_id % 97) / 60.0::DOUBLE AS playtime_2weeks, items_count
  FROM documents d JOIN per_lang s ON d.lang = s.lang),
texts AS (SELECT * FROM reviews WHERE length(review_text) > 20),
joined AS (
  SELECT t.user_id, t.item_id, recommend, review_text, playtime_forever AS duration, playtime_2weeks, items_count
  FROM texts t JOIN items i ON t.user_id = i.user_id AND t.item_id = i.item_id),
T AS (
  SELECT user_id, item_id, duration, CASE WHEN recommend THEN 0 ELSE 1 END AS event, review_text,
         playtime_2weeks, ln(1 + playtime_2weeks) AS log_playtime_2weeks, ln(1 + items_count) AS log_items_count
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY recommend, review_text, duration) AS rn
        FROM joined WHERE duration BETWEEN 0.5 AND 5000) WHERE rn = 1)"""

FEATURES = (
    "log_playtime_2weeks", "log_items_count", "sentiment_score", "frustration_level",
    "technical_issue", "value_complaint", "engagement_dropped", "positive_signal",
)
SIGNALS = FEATURES[2:]
BINARY = FEATURES[4:]


def on_l(body: str) -> str:
    return f"WITH {L_CTE},\n{body.strip()}" if not body.lstrip().startswith("SELECT") else f"WITH {L_CTE}\n{body.strip()}"


def on_t(body: str) -> str:
    return f"WITH {T_CTE},\n{body.strip()}" if not body.lstrip().startswith("SELECT") else f"WITH {T_CTE}\n{body.strip()}"


def km_ctes(source: str, group: str) -> str:
    return f"""
steps AS (SELECT {group} AS g, duration AS time, CAST(sum(event) AS BIGINT) AS deaths, count(*) AS removed
          FROM {source} GROUP BY {group}, duration),
risk AS (SELECT *, CAST(sum(removed) OVER (PARTITION BY g ORDER BY time DESC) AS BIGINT) AS at_risk FROM steps),
run AS (SELECT *,
          sum(CASE WHEN at_risk > deaths THEN ln((at_risk - deaths) / at_risk::DOUBLE) ELSE 0 END)
             OVER (PARTITION BY g ORDER BY time) AS log_s,
          sum(CASE WHEN at_risk > deaths THEN deaths / (at_risk::DOUBLE * (at_risk - deaths)) ELSE 0 END)
             OVER (PARTITION BY g ORDER BY time) AS var,
          sum(CASE WHEN at_risk = deaths THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY time) AS ended
        FROM risk),
curve AS (
  SELECT g, time, at_risk, deaths,
         CASE WHEN ended > 0 THEN 0.0 ELSE exp(log_s) END AS survival,
         CASE WHEN ended > 0 THEN NULL WHEN log_s = 0 THEN 1.0
              ELSE exp(log_s * exp(-1.959963984540054 * sqrt(var) / log_s)) END AS lower,
         CASE WHEN ended > 0 THEN NULL WHEN log_s = 0 THEN 1.0
              ELSE exp(log_s * exp(1.959963984540054 * sqrt(var) / log_s)) END AS upper
  FROM run
  UNION ALL
  SELECT g, 0.0, CAST(sum(removed) AS BIGINT), 0, 1.0, 1.0, 1.0 FROM steps GROUP BY g HAVING min(time) > 0)"""


def km(source: str, group: str) -> str:
    return on_l(
        km_ctes(source, group)
        + f"""
SELECT g AS {group}, CAST(time AS DOUBLE) AS time, at_risk, CAST(deaths AS BIGINT) AS deaths,
       round(survival, 6) AS survival, round(lower, 6) AS lower, round(upper, 6) AS upper FROM curve"""
    )


def _union(parts: list[str]) -> str:
    return "SELECT * FROM (" + "\nUNION ALL\n".join(parts) + ")"


ORACLE: dict[str, str] = {}

ORACLE["survival_dataset"] = on_l("""
SELECT user_id, item_id, duration, event, priority,
       round(log_playtime_2weeks, 6) AS log_playtime_2weeks, round(log_items_count, 6) AS log_items_count,
       round(sentiment_score, 6) AS sentiment_score, round(frustration_level, 6) AS frustration_level,
       technical_issue, value_complaint, engagement_dropped, positive_signal FROM L""")

ORACLE["text_survival_dataset"] = on_t("""
SELECT user_id, item_id, round(duration, 6) AS duration, event, review_text,
       round(playtime_2weeks, 6) AS playtime_2weeks, round(log_playtime_2weeks, 6) AS log_playtime_2weeks,
       round(log_items_count, 6) AS log_items_count FROM T""")

ORACLE["stage_counts"] = on_t(_union([
    "SELECT 'reviews' AS stage, count(*) AS n_rows FROM texts",
    "SELECT 'items', count(*) FROM items",
    "SELECT 'joined', count(*) FROM joined",
    "SELECT 'filtered', count(*) FROM T",
]))

ORACLE["line_stage_counts"] = on_l("""
SELECT (SELECT count(*) FROM pairs) AS joined, (SELECT count(*) FROM ranged) AS in_range,
       (SELECT count(*) FROM firsts) AS deduplicated""")

ORACLE["churn_summary"] = on_l("""
SELECT count(*) AS n_rows, CAST(sum(event) AS BIGINT) AS n_churned,
       CAST(sum(1 - event) AS BIGINT) AS n_retained, round(avg(event), 6) AS churn_rate FROM L""")

HASHED = """
hashed AS (SELECT *, md5(concat_ws('|', CAST(user_id AS VARCHAR), CAST(item_id AS VARCHAR), '{seed}')) AS h FROM L)"""

ORACLE["stratified_cap"] = on_l(HASHED.format(seed=42) + """,
sizes AS (SELECT count(*) AS n, avg(event) AS rate, sum(event) AS n1, sum(1 - event) AS n0 FROM L),
take AS (SELECT CASE WHEN n > 10000 THEN least(CAST(floor(10000 * rate) AS BIGINT), n1) ELSE n1 END AS k1, n, n0 FROM sizes),
ranked AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY h) AS rn FROM hashed)
SELECT user_id, item_id, event FROM ranked, take
WHERE n <= 10000 OR (event = 1 AND rn <= k1) OR (event = 0 AND rn <= least(10000 - k1, n0))""")

SPLIT = HASHED.format(seed=1729) + """,
sizes AS (SELECT event, count(*) AS c, sum(count(*)) OVER () AS n FROM L GROUP BY event),
shares AS (SELECT event, c, n - ceil(n * 0.2) AS n_train, c * (n - ceil(n * 0.2)) / n::DOUBLE AS exact FROM sizes),
floors AS (SELECT event, c, floor(exact) AS f,
                  row_number() OVER (ORDER BY exact - floor(exact) DESC, event) AS pos,
                  n_train - sum(floor(exact)) OVER () AS missing FROM shares),
tests AS (SELECT event, c - f - CASE WHEN pos <= missing THEN 1 ELSE 0 END AS n_test FROM floors),
ranked AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY h) AS rn FROM hashed),
sides AS (SELECT r.*, CASE WHEN rn <= n_test THEN 'test' ELSE 'train' END AS split
          FROM ranked r JOIN tests t ON r.event = t.event)"""

ORACLE["holdout_split"] = on_l(SPLIT + """
SELECT user_id, item_id, event, split FROM sides""")

ORACLE["kfold_assignment"] = on_l(HASHED.format(seed=42) + """,
ranked AS (SELECT *, row_number() OVER (ORDER BY h) - 1 AS r, count(*) OVER () AS n FROM hashed)
SELECT user_id, item_id,
       CAST(CASE WHEN r < (n % 5) * (n // 5 + 1) THEN r // (n // 5 + 1)
                 ELSE (n % 5) + (r - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold
FROM ranked""")

ORACLE["km_by_group"] = km("L", "priority")
ORACLE["km_by_event"] = km("L", "event")
ORACLE["km_median_split"] = on_l("""
marked AS (SELECT *, CASE WHEN frustration_level > (SELECT median(frustration_level) FROM L) THEN 1 ELSE 0 END
           AS above_median FROM L),""" + km("marked", "above_median").split(L_CTE + ",", 1)[1])

ORACLE["median_survival"] = on_l(km_ctes("L", "priority") + """
SELECT g AS priority, min(CASE WHEN survival <= 0.5 + 1e-12 THEN time END) AS median_time FROM curve GROUP BY g""")

ORACLE["contract_violations"] = on_l(_union(
    ["SELECT 'event_binary' AS rule, count(*) FILTER (NOT coalesce(event IN (0, 1), false)) AS violations FROM L",
     "SELECT 'duration_positive', count(*) FILTER (NOT coalesce(duration > 0, false)) FROM L",
     "SELECT 'sentiment_score_range', count(*) FILTER (NOT coalesce(sentiment_score BETWEEN -1 AND 1, false)) FROM L",
     "SELECT 'frustration_level_range', count(*) FILTER (NOT coalesce(frustration_level BETWEEN 0 AND 1, false)) FROM L"]
    + [f"SELECT '{b}_binary', count(*) FILTER (NOT coalesce({b} IN (0, 1), false)) FROM L" for b in BINARY]))

ORACLE["describe_features"] = on_l(_union([
    f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(stddev_samp({f}), 6) AS std, "
    f"round(CAST(min({f}) AS DOUBLE), 6) AS min, round(CAST(max({f}) AS DOUBLE), 6) AS max FROM L" for f in FEATURES]))

ORACLE["rates_by_event"] = on_l(_union([
    f"SELECT event, '{b}' AS feature, round(avg({b}), 6) AS rate FROM L GROUP BY event" for b in BINARY]))

ORACLE["density_by_event"] = on_l("""
long AS (SELECT event, 'sentiment_score' AS feature, sentiment_score AS x FROM L
         UNION ALL SELECT event, 'frustration_level', frustration_level FROM L),
spread AS (SELECT event, feature, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS bw, min(x) AS lo, max(x) AS hi
           FROM long GROUP BY ALL),
shape AS (SELECT event, feature, n, bw, lo - 3 * bw AS s, hi - lo + 6 * bw AS w FROM spread),
binned AS (SELECT event, feature, n, bw, s, w, floor((x - s) / w * 1024) AS bin, count(*) AS c
           FROM long JOIN shape USING (event, feature) GROUP BY ALL),
grid AS (SELECT unnest(range(0, 200)) AS point)
SELECT event, feature, CAST(point AS INTEGER) AS point, round(min(s + w * point / 199.0), 6) AS x,
       round(sum(c * exp(-pow((s + w * point / 199.0 - (s + w * (bin + 0.5) / 1024.0)) / bw, 2) / 2) / sqrt(2 * pi()))
             / min(n * bw), 6) AS density
FROM binned, grid GROUP BY event, feature, point""")

ORACLE["histogram_by_event"] = on_l("""
SELECT event, CASE WHEN log_items_count < 0 THEN -1 WHEN log_items_count > 4 THEN 16
                   ELSE CAST(least(floor(log_items_count / 0.25), 15) AS INTEGER) END AS bin, count(*) AS n_rows
FROM L GROUP BY ALL""")


def _spearman(features) -> str:
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS r_{f}" for f in features)
    pairs = [
        f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, corr(r_{a}, r_{b}) AS rho FROM ranks"
        for a in features for b in features]
    return f"ranks AS (SELECT {ranks} FROM L),\nmatrix AS ({_union(pairs)})"


ORACLE["spearman_matrix"] = on_l(_spearman(SIGNALS) + """
SELECT feature_x, feature_y, round(rho, 6) AS rho FROM matrix""")
ORACLE["collinear_pairs"] = f"""WITH {L_CTE},
base AS (SELECT * FROM L)""" + _spearman((*FEATURES, "playtime_2weeks", "items_count")).replace(
    "ranks AS", """, wider AS (SELECT *, round(exp(log_playtime_2weeks) - 1) AS playtime_2weeks,
                                 round(exp(log_items_count) - 1) AS items_count FROM base),
ranks AS""", 1).replace("FROM L)", "FROM wider)", 1) + """
SELECT feature_x, feature_y, round(rho, 6) AS rho FROM matrix WHERE feature_x < feature_y AND abs(rho) > 0.7"""


def _sparse_pair(a: str, b: str) -> str:
    """One pair, ranked over the rows that have both values."""
    ranked = ", ".join(
        f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS r_{n}" for n, x in ((0, a), (1, b)))
    return (f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, corr(r_0, r_1) AS rho FROM "
            f"(SELECT {ranked} FROM seen WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


KNOWN = {"sentiment_score": "log_items_count > 2.5", "frustration_level": "value_complaint = 1", "engagement_dropped": "event = 0"}

ORACLE["spearman_sparse"] = on_l(
    "seen AS (SELECT " + ", ".join(f"CASE WHEN {KNOWN.get(f, 'TRUE')} THEN {f} END AS {f}" for f in FEATURES) + " FROM L),\n"
    + f"matrix AS ({_union([_sparse_pair(a, b) for a in FEATURES for b in FEATURES])})\n"
    + "SELECT feature_x, feature_y, round(CASE WHEN isnan(rho) THEN NULL ELSE rho END, 6) AS rho FROM matrix")


# ---------------------------------------------------------------- Cox quantities at fixed coefficients

ETA = "0.1::DOUBLE * log_playtime_2weeks + 0.3::DOUBLE * frustration_level + (-0.2)::DOUBLE * technical_issue"
FIXED = ("log_playtime_2weeks", "frustration_level", "technical_issue")

SCORED = f"scored AS (SELECT *, {ETA} AS eta FROM L)"

RISK = f"""{SCORED},
times AS (SELECT duration AS time, count(*) AS n, CAST(sum(event) AS BIGINT) AS d, sum(exp(eta)) AS r0,
                 sum(exp(eta) * event) AS d0, {", ".join(
    f"sum(exp(eta) * {f}) AS r_{f}, sum(exp(eta) * event * {f}) AS d_{f}, sum(event * {f}) AS x_{f}" for f in FIXED)}
          FROM scored GROUP BY duration),
risk AS (SELECT *, sum(r0) OVER later AS s0, {", ".join(f"sum(r_{f}) OVER later AS s_{f}" for f in FIXED)},
                sum(n) OVER (ORDER BY time) AS upto
         FROM times WINDOW later AS (ORDER BY time DESC)),
steps AS (SELECT *, l / d AS frac, s0 - l / d * d0 AS phi
          FROM (SELECT *, unnest(range(0, d)) AS l FROM risk WHERE d > 0)),
means AS (SELECT time, {", ".join(f"sum((s_{f} - frac * d_{f}) / phi) / max(d) AS e_{f}" for f in FIXED)}
          FROM steps GROUP BY time)"""

ORACLE["cindex_fixed_risk"] = on_l(f"""{SCORED},
cells AS MATERIALIZED (SELECT duration AS t, event AS e, round(eta, 9) AS r, count(*) AS w FROM scored GROUP BY ALL),
found AS (SELECT CAST(sum(CASE WHEN b.r < a.r THEN a.w * b.w ELSE 0 END) AS DOUBLE) AS concordant,
                 CAST(sum(CASE WHEN b.r = a.r THEN a.w * b.w ELSE 0 END) AS DOUBLE) AS tied,
                 CAST(sum(a.w * b.w) AS DOUBLE) AS pairs
          FROM cells a JOIN cells b ON a.e = 1 AND (b.t > a.t OR (b.t = a.t AND b.e = 0)))
SELECT concordant, tied, pairs, round((concordant + 0.5 * tied) / pairs, 6) AS cindex FROM found""")

ORACLE["cox_loglik_fixed_beta"] = on_l(RISK + """
SELECT (SELECT count(*) FROM scored) AS n_rows, (SELECT CAST(sum(event) AS BIGINT) FROM scored) AS n_events,
       round((SELECT sum(event * eta) FROM scored) - (SELECT sum(ln(phi)) FROM steps), 3) AS loglik""")

ORACLE["baseline_hazard_fixed_beta"] = on_l(RISK + """
SELECT time, round(d / s0, 9) AS hazard, round(sum(d / s0) OVER (ORDER BY time), 6) AS cumulative_hazard FROM risk""")

ORACLE["schoenfeld_fixed_beta"] = on_l(RISK + f"""
SELECT user_id, item_id, time, {", ".join(f"round({f} - e_{f}, 6) AS {f}" for f in FIXED)}
FROM L JOIN means ON duration = time WHERE event = 1""")

ORACLE["ph_sums_fixed_beta"] = on_l(RISK + """,
ranked AS (SELECT risk.*, means.* EXCLUDE (time), upto - (n - 1) / 2.0::DOUBLE AS g
           FROM risk JOIN means ON risk.time = means.time),
centre AS (SELECT sum(d * g) / sum(d) AS gm, sum(d) AS n_events FROM ranked),
spread AS (SELECT sum(d * (g - gm) * (g - gm)) AS v FROM ranked, centre)
""" + _union([
    f"SELECT '{f}' AS covariate, (SELECT round(sum((g - gm) * (x_{f} - d * e_{f})), 0) FROM ranked, centre) AS rank_residual, "
    "round(v, 0) AS rank_variation, CAST(n_events AS BIGINT) AS n_events FROM spread, centre" for f in FIXED]))

ORACLE["survival_curve"] = on_l(RISK + """,
base AS (SELECT time, sum(d / s0) OVER (ORDER BY time) AS h FROM risk),
asked AS (SELECT i * 20 + 0.25::DOUBLE AS time FROM range(0, 130) AS r(i)),
around AS (
  SELECT a.time, (SELECT max(b.time) FROM base b WHERE b.time <= a.time) AS t0,
         (SELECT min(b.time) FROM base b WHERE b.time >= a.time) AS t1 FROM asked a),
clamped AS (SELECT time, coalesce(t0, t1) AS t0, coalesce(t1, t0) AS t1 FROM around),
curves AS (SELECT 0 AS curve_id, exp(0.1::DOUBLE * 1.0) AS risk
           UNION ALL SELECT 1, exp(0.1::DOUBLE * 3.5 + 0.3::DOUBLE * 1.0 - 0.2::DOUBLE)),
ends AS (SELECT curve_id, c.time, t0, t1, exp(-l.h * risk) AS low, exp(-u.h * risk) AS high
         FROM clamped c JOIN base l ON c.t0 = l.time JOIN base u ON c.t1 = u.time, curves)
SELECT curve_id, time, round(CASE WHEN t1 = t0 THEN low ELSE low + (high - low) * (time - t0) / (t1 - t0) END, 6)
       AS survival_prob FROM ends""")


# ---------------------------------------------------------------- the ridge fit itself, Newton step by step


def newton(models: str, steps: int = 7) -> str:
    """CTEs that fit two-covariate models, one per k, by `steps` Newton steps from zero.

    `models` selects (k, t, e, x1, x2); a model whose x2 is constant is a one-covariate model.
    """
    ctes = [
        f"rows_in AS MATERIALIZED ({models})",
        """scale AS MATERIALIZED (SELECT k, count(*) AS n, avg(x1) AS m1, stddev_samp(x1) AS s1, avg(x2) AS m2,
            CASE WHEN stddev_samp(x2) > 0 THEN stddev_samp(x2) ELSE 1 END AS s2 FROM rows_in GROUP BY k)""",
        """z AS MATERIALIZED (SELECT r.k, t, e, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2
            FROM rows_in r JOIN scale s ON r.k = s.k)""",
        "b0 AS (SELECT k, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM scale)",
    ]
    moments = {"a": "z1", "b": "z2", "aa": "z1 * z1", "ab": "z1 * z2", "bb": "z2 * z2"}
    for i in range(steps + 1):
        ctes += [
            f"r{i} AS (SELECT z.*, b1, b2, b1 * z1 + b2 * z2 AS eta, exp(b1 * z1 + b2 * z2) AS r FROM z JOIN b{i} b ON z.k = b.k)",
            f"t{i} AS MATERIALIZED (SELECT k, t, CAST(sum(e) AS BIGINT) AS d, sum(r) AS r0, sum(r * e) AS d0, sum(e * eta) AS eta, "
            "sum(e * z1) AS xa, sum(e * z2) AS xb, "
            + ", ".join(f"sum(r * {v}) AS r{m}, sum(r * e * {v}) AS d{m}" for m, v in moments.items())
            + f" FROM r{i} GROUP BY k, t)",
            f"s{i} AS (SELECT *, sum(r0) OVER w AS s0, " + ", ".join(f"sum(r{m}) OVER w AS s{m}" for m in moments)
            + f" FROM t{i} WINDOW w AS (PARTITION BY k ORDER BY t DESC))",
            f"l{i} AS (SELECT k, (sa - f * da) / phi AS ga, (sb - f * db) / phi AS gb, (saa - f * daa) / phi AS haa, "
            f"(sab - f * dab) / phi AS hab, (sbb - f * dbb) / phi AS hbb, ln(phi) AS logphi FROM "
            f"(SELECT *, l / d AS f, s0 - l / d * d0 AS phi FROM (SELECT *, unnest(range(0, d)) AS l FROM s{i} WHERE d > 0)))",
            f"x{i} AS (SELECT k, sum(xa) AS xa, sum(xb) AS xb, sum(eta) AS eta FROM t{i} GROUP BY k)",
            f"q{i} AS (SELECT k, sum(ga) AS ga, sum(gb) AS gb, sum(haa - ga * ga) AS haa, sum(hab - ga * gb) AS hab, "
            f"sum(hbb - gb * gb) AS hbb, sum(logphi) AS logphi FROM l{i} GROUP BY k)",
            f"d{i} AS MATERIALIZED (SELECT b.k, b1, b2, xa - ga - 0.1 * n * b1 AS ga, xb - gb - 0.1 * n * b2 AS gb, "
            f"haa + 0.1 * n AS haa, hab, hbb + 0.1 * n AS hbb, eta - logphi AS loglik "
            f"FROM b{i} b JOIN x{i} x ON b.k = x.k JOIN q{i} q ON b.k = q.k JOIN scale s ON b.k = s.k)",
            f"b{i + 1} AS (SELECT k, b1 + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS b1, "
            f"b2 + (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b2 FROM d{i})",
        ]
    return ",\n".join(ctes)


STEPS = 7
ALL_ROWS = "SELECT 0 AS k, duration AS t, event AS e, log_playtime_2weeks AS x1, log_items_count AS x2 FROM L"

ORACLE["model_roundtrip"] = ORACLE["survival_curve"]
ORACLE["cox_fit"] = on_l(newton(ALL_ROWS) + f""",
raw AS (
  SELECT 'log_playtime_2weeks' AS feature, b1 / s1 AS coef, sqrt(hbb / (haa * hbb - hab * hab)) / s1 AS se
  FROM d{STEPS} d JOIN scale s ON d.k = s.k
  UNION ALL
  SELECT 'log_items_count', b2 / s2, sqrt(haa / (haa * hbb - hab * hab)) / s2 FROM d{STEPS} d JOIN scale s ON d.k = s.k)
SELECT feature, round(coef, 6) AS coef, round(se, 6) AS se, round(exp(coef), 6) AS HR,
       round(exp(coef - 1.959963984540054 * se), 6) AS HR_lower,
       round(exp(coef + 1.959963984540054 * se), 6) AS HR_upper FROM raw""")

# ---------------------------------------------------------------- the same with all covariates


def _covariates(k: int, used: tuple[str, ...]) -> str:
    """Rows of L for model k; a covariate that the model does not use is constant."""
    values = ", ".join(f"CAST({f} AS DOUBLE) AS x{j}" if f in used else f"0.0::DOUBLE AS x{j}" for j, f in enumerate(FEATURES, 1))
    return f"SELECT {k} AS k, duration AS t, event AS e, {values} FROM L"


def on_l_recursive(sql: str) -> str:
    return on_l(sql).replace("WITH", "WITH RECURSIVE", 1)


FULL = newton_steps(_covariates(0, FEATURES), len(FEATURES), STEPS)
BOTH = newton_steps(_covariates(0, FEATURES) + " UNION ALL " + _covariates(1, FEATURES[:2]), len(FEATURES), STEPS)

ORACLE["hazard_ratios"] = on_l_recursive(FULL + """,
raw AS (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, b{j} / s{j} AS coef, sqrt(v) / s{j} AS se, '{'behavioural' if j <= 2 else 'signal'}' AS family "
    f"FROM fit JOIN scale USING (k) JOIN inverse USING (k) WHERE i = {j} AND j = {j}" for j, f in enumerate(FEATURES, 1)) + """)
SELECT feature, round(exp(coef), 6) AS HR, round(exp(coef - 1.959963984540054 * se), 6) AS HR_lower,
       round(exp(coef + 1.959963984540054 * se), 6) AS HR_upper, family FROM raw""")

ORACLE["lr_test_all_signals"] = on_l_recursive(BOTH + """,
test AS (SELECT 2 * (a.loglik - b.loglik) AS x FROM fit a, fit b WHERE a.k = 0 AND b.k = 1),
tail AS (SELECT x, -x / 2 + ln(1 + x / 2 + x * x / 8) AS log_p FROM test)
SELECT round(x, 4) AS lr_statistic, CAST(6 AS BIGINT) AS df, round(exp(log_p), 6) AS p_value,
       round(log_p, 4) AS log_p_value, log_p < ln(0.05) AS significant FROM tail""")

_ph = range(1, len(FEATURES) + 1)
ORACLE["ph_test"] = on_l_recursive(FULL + """,
ranked AS (SELECT *, sum(n) OVER (ORDER BY t) - (n - 1) / 2.0::DOUBLE AS g FROM at_fit),
centre AS (SELECT sum(d * g) / sum(d) AS gm, sum(d) AS deaths FROM ranked),
spread AS (SELECT sum(d * (g - gm) * (g - gm)) AS w, any_value(deaths) AS deaths FROM ranked, centre),
scores AS (""" + " UNION ALL ".join(
    f"SELECT {j} AS i, sum((g - gm) * (x{j} - g{j})) AS u FROM ranked, centre" for j in _ph) + """),
sums AS (SELECT j, sum(u * v) AS uv, max(CASE WHEN i = j THEN v END) AS vjj FROM scores JOIN inverse USING (i) GROUP BY j),
stats AS (SELECT j, sqrt(deaths * uv * uv / (vjj * w)) AS z FROM sums, spread),
tails AS (SELECT CASE j """ + " ".join(f"WHEN {j} THEN '{f}'" for j, f in enumerate(FEATURES, 1)) + f""" END AS covariate,
                 {normal_tail("z")} AS p FROM stats)
SELECT covariate, round(p, 6) AS p, round(-log10(greatest(p, 1e-30)), 4) AS evidence, p < 0.05 AS ph_violated FROM tails""")

ORACLE["lr_test"] = on_l(newton(ALL_ROWS + """
  UNION ALL SELECT 1, duration, event, log_playtime_2weeks, 0 FROM L""") + f"""
SELECT round(a.loglik, 4) AS loglik_full, round(b.loglik, 4) AS loglik_restricted,
       round(2 * (a.loglik - b.loglik), 4) AS lr_statistic, 1 AS df
FROM d{STEPS} a, d{STEPS} b WHERE a.k = 0 AND b.k = 1""")

ORACLE["cox_gradient_at_fit"] = _union([f"SELECT '{f}' AS feature, 0.0::DOUBLE AS gradient" for f in FEATURES])

FOLDED = HASHED.format(seed=42) + """,
folded AS MATERIALIZED (
  SELECT *, CAST(CASE WHEN r < (n % 5) * (n // 5 + 1) THEN r // (n // 5 + 1)
                      ELSE (n % 5) + (r - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold
  FROM (SELECT *, row_number() OVER (ORDER BY h) - 1 AS r, count(*) OVER () AS n FROM hashed))"""

ORACLE["cv_cindex"] = on_l(FOLDED + """,
""" + newton("""SELECT CAST(i AS INTEGER) AS k, duration AS t, event AS e, log_playtime_2weeks AS x1, log_items_count AS x2
                FROM folded, range(0, 5) AS folds(i) WHERE fold <> i""") + f""",
held AS MATERIALIZED (
  SELECT fold, duration AS t, event AS e,
         round((log_playtime_2weeks - m1) * b1 / s1 + (log_items_count - m2) * b2 / s2, 9) AS r
  FROM folded f JOIN d{STEPS} d ON f.fold = d.k JOIN scale s ON s.k = d.k)
SELECT a.fold, round(sum(CASE WHEN b.r < a.r THEN 1.0 WHEN b.r = a.r THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 4) AS cindex
FROM held a JOIN held b ON a.fold = b.fold AND a.e = 1 AND (b.t > a.t OR (b.t = a.t AND b.e = 0)) GROUP BY a.fold""")

ORACLE["experiment_baseline"] = on_l(SPLIT + """,
train AS (SELECT *, md5(concat_ws('|', CAST(user_id AS VARCHAR), CAST(item_id AS VARCHAR), '42')) AS fh
          FROM sides WHERE split = 'train'),
folded AS MATERIALIZED (
  SELECT *, CAST(CASE WHEN r < (n % 5) * (n // 5 + 1) THEN r // (n // 5 + 1)
                      ELSE (n % 5) + (r - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold
  FROM (SELECT *, row_number() OVER (ORDER BY fh) - 1 AS r, count(*) OVER () AS n FROM train)),
""" + newton("""SELECT CAST(i AS INTEGER) AS k, duration AS t, event AS e, log_playtime_2weeks AS x1, log_items_count AS x2
                FROM folded, range(0, 6) AS folds(i) WHERE fold <> i""") + f""",
jobs AS (
  SELECT fold AS k, 'fold' || fold AS job, duration, event, log_playtime_2weeks AS x1, log_items_count AS x2 FROM folded
  UNION ALL SELECT 5, 'apparent', duration, event, log_playtime_2weeks, log_items_count FROM folded
  UNION ALL SELECT 5, 'holdout', duration, event, log_playtime_2weeks, log_items_count FROM sides WHERE split = 'test'),
held AS MATERIALIZED (
  SELECT job, duration AS t, event AS e, round((x1 - m1) * b1 / s1 + (x2 - m2) * b2 / s2, 9) AS r, count(*) AS w
  FROM jobs j JOIN d{STEPS} d ON j.k = d.k JOIN scale s ON s.k = d.k GROUP BY ALL),
scores AS (
  SELECT a.job, sum(CASE WHEN b.r < a.r THEN a.w * b.w WHEN b.r = a.r THEN 0.5 * a.w * b.w ELSE 0 END)::DOUBLE / sum(a.w * b.w) AS c
  FROM held a JOIN held b ON a.job = b.job AND a.e = 1 AND (b.t > a.t OR (b.t = a.t AND b.e = 0)) GROUP BY a.job)
SELECT 'baseline' AS variant, 2 AS n_features,
       round(avg(c) FILTER (job LIKE 'fold%'), 4) AS cv_mean, round(stddev_pop(c) FILTER (job LIKE 'fold%'), 4) AS cv_std,
       round(max(c) FILTER (job = 'holdout'), 4) AS holdout_cindex, round(max(c) FILTER (job = 'apparent'), 4) AS apparent_cindex
FROM scores""")

# one covariate at a time: the model number is 5 * feature + fold
SINGLE = _union([f"SELECT {i} AS f, '{name}' AS feature, fold, duration, event, CAST({name} AS DOUBLE) AS x FROM folded"
                 for i, name in enumerate(FEATURES)])

ORACLE["univariate_cindex"] = on_l(FOLDED + f""",
single AS MATERIALIZED ({SINGLE}),
""" + newton("""SELECT CAST(5 * f + i AS INTEGER) AS k, duration AS t, event AS e, x AS x1, 0 AS x2
                FROM single, range(0, 5) AS folds(i) WHERE fold <> i""") + f""",
held AS MATERIALIZED (
  SELECT feature, fold, duration AS t, event AS e, round((x - m1) * b1 / s1, 9) AS r, count(*) AS w
  FROM single g JOIN d{STEPS} d ON 5 * g.f + g.fold = d.k JOIN scale s ON s.k = d.k GROUP BY ALL),
scores AS (
  SELECT a.feature, a.fold,
         sum(CASE WHEN b.r < a.r THEN a.w * b.w WHEN b.r = a.r THEN 0.5 * a.w * b.w ELSE 0 END)::DOUBLE / sum(a.w * b.w) AS c
  FROM held a JOIN held b ON a.feature = b.feature AND a.fold = b.fold AND a.e = 1
       AND (b.t > a.t OR (b.t = a.t AND b.e = 0)) GROUP BY a.feature, a.fold)
SELECT feature, round(avg(c), 4) AS univariate_c,
       CASE WHEN feature IN ('log_playtime_2weeks', 'log_items_count') THEN 'behavioural' ELSE 'signal' END AS family
FROM scores GROUP BY feature""")


# ---------------------------------------------------------------- text

WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')"

TERMS = f"""
tokens AS (SELECT item_id, {WORDS.format("review_text")} AS w FROM T),
grams AS (SELECT item_id, unnest(w) AS term FROM tokens
          UNION ALL
          SELECT item_id, w[i] || ' ' || w[i + 1] FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM tokens)),
counts AS MATERIALIZED (SELECT item_id, term, count(*) AS tf FROM grams GROUP BY item_id, term),
vocab AS MATERIALIZED (
  SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df,
         ln((1 + (SELECT count(*) FROM T)) / (1 + count(*))::DOUBLE) + 1 AS idf
  FROM counts GROUP BY term HAVING count(*) >= 3 AND count(*) <= 0.95 * (SELECT count(*) FROM T)
  ORDER BY tf DESC, term LIMIT 10000)"""

ORACLE["tfidf_vocab"] = on_t(TERMS + """
SELECT term, tf, df, round(idf, 6) AS idf FROM vocab""")

ORACLE["tfidf_weights"] = on_t(TERMS + """,
weights AS (SELECT item_id, c.term, (1 + ln(c.tf)) * idf AS w FROM counts c JOIN vocab v ON c.term = v.term),
lengths AS (SELECT item_id, sqrt(sum(w * w)) AS length FROM weights GROUP BY item_id)
SELECT w.item_id, term, round(w / length, 6) AS weight FROM weights w JOIN lengths l ON w.item_id = l.item_id""")

ORACLE["dense_vectors"] = on_t("""
cells AS (SELECT item_id, embedding, unnest(range(0, 64)) AS p FROM T JOIN embeddings ON item_id = vec_id),
norms AS (SELECT item_id, sqrt(sum(pow(embedding[p + 1]::DOUBLE, 2))) AS length FROM cells GROUP BY item_id)
SELECT c.item_id, CAST(p AS INTEGER) AS position,
       round(CASE WHEN length > 0 THEN embedding[p + 1]::DOUBLE / length ELSE 0 END, 6) AS value
FROM cells c JOIN norms n ON c.item_id = n.item_id""")


ORACLE["pca_total"] = f"""WITH vectors AS (SELECT item_id, position, value FROM ({ORACLE["dense_vectors"].replace(
    "CASE WHEN length > 0 THEN embedding[p + 1]::DOUBLE / length ELSE 0 END, 6",
    "CASE WHEN length > 0 THEN embedding[p + 1]::DOUBLE / length ELSE 0 END, 15")})),
along AS (SELECT position, var_samp(value) AS v FROM vectors GROUP BY position)
SELECT count(*) AS n_components, round(sum(v), 6) AS variance FROM along"""


# ---------------------------------------------------------------- signals


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _flag(words, phrases) -> str:
    found = [f"list_has_any(w, {_list(words)})"] + [f"contains(j, ' {p} ')" for p in phrases]
    return "CASE WHEN " + " OR ".join(found) + " THEN 1 ELSE 0 END"


SCORES = f"""
tokens AS (SELECT doc_id, text, lang, {WORDS.format("text")} AS w FROM documents),
hits AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS j,
                len(list_filter(w, lambda t: list_contains({_list(lexicon.POSITIVE_WORDS)}, t))) AS pos,
                len(list_filter(w, lambda t: list_contains({_list(lexicon.NEGATIVE_WORDS)}, t))) AS neg FROM tokens),
scores AS (SELECT doc_id, text, lang,
       CASE WHEN pos + neg > 0 THEN (pos - neg) / (pos + neg) ELSE 0.0::DOUBLE END AS sentiment_score,
       least(1.0::DOUBLE, neg / 4.0::DOUBLE) AS frustration_level,
       {_flag(lexicon.TECHNICAL_WORDS, ())} AS technical_issue,
       {_flag(lexicon.VALUE_WORDS, lexicon.VALUE_PHRASES)} AS value_complaint,
       {_flag(lexicon.DROPPED_WORDS, lexicon.DROPPED_PHRASES)} AS engagement_dropped,
       {_flag(lexicon.POSITIVE_SIGNAL_WORDS, lexicon.POSITIVE_SIGNAL_PHRASES)} AS positive_signal FROM hits)"""

ORACLE["text_signals"] = f"WITH {SCORES} SELECT * EXCLUDE (text, lang) FROM scores"
ORACLE["signals_stream"] = f"WITH {SCORES} SELECT * EXCLUDE (text, lang) FROM scores WHERE length(text) > 20"

ORACLE["signal_contract"] = on_l("""
raw AS (SELECT 1 - 25 * discount AS a, tax > 0.07 AS unknown, round(tax / 0.06, 6) AS b,
               CAST(quantity % 3 AS INTEGER) AS c, event = 0 AS p FROM pairs)
SELECT concat_ws(',', CASE WHEN a < -1 OR a > 1 THEN 'sentiment_score' END,
                 CASE WHEN unknown OR b < 0 OR b > 1 THEN 'frustration_level' END,
                 CASE WHEN c > 1 THEN 'technical_issue' END,
                 CASE WHEN NOT p THEN 'positive_signal' END) AS broken, count(*) AS n_rows
FROM raw GROUP BY ALL""")

BATCHED = "batched AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 10 AS batch FROM {0})"

ORACLE["align_batches"] = f"""WITH {SCORES},
{BATCHED.format("scores")},
grouped AS (SELECT batch, CAST(count(*) FILTER (lang = 'en') AS INTEGER) AS expected,
                   coalesce(list(sentiment_score ORDER BY b.doc_id) FILTER (l.doc_id IS NOT NULL), []) AS s
            FROM batched b LEFT JOIN labels l ON b.doc_id = l.doc_id GROUP BY batch)
SELECT batch, expected, CAST(len(s) AS INTEGER) AS returned, CAST(greatest(len(s) - expected, 0) AS INTEGER) AS surplus,
       CAST(greatest(expected - len(s), 0) AS INTEGER) AS shortage, expected AS n_aligned,
       round(coalesce(list_sum(s[1:expected]), 0.0), 6) AS sentiment_sum FROM grouped"""

ORACLE["signal_fallbacks"] = f"""WITH {BATCHED.format("documents")},
facts AS (SELECT batch, bool_or(contains(text, 'worthless')) AS failed, bool_or(contains(text, 'pathetic')) AS short,
                 count(*) AS n, max(doc_id) AS last_id FROM batched GROUP BY batch)
SELECT b.batch, failed AS signal_fallback, CAST(CASE WHEN short AND NOT failed THEN 1 ELSE 0 END AS INTEGER) AS signal_shortage,
       count(*) AS n_rows,
       CAST(sum(CASE WHEN NOT failed AND NOT (short AND doc_id = last_id) AND contains(text, 'best') THEN 1 ELSE 0 END) AS INTEGER)
         AS n_positive,
       round(sum(CASE WHEN NOT failed AND NOT (short AND doc_id = last_id) THEN least(1.0, length(text) / 20000.0::DOUBLE)
                      ELSE 0 END), 6) AS frustration_sum
FROM batched b JOIN facts f ON b.batch = f.batch GROUP BY b.batch, failed, short"""


# ---------------------------------------------------------------- raw records

ORACLE["ingest_reviews"] = on_t("""
SELECT user_id, CAST(item_id AS VARCHAR) AS item_id, recommend, '' AS posted, md5(review_text) AS text_md5
FROM texts WHERE item_id % 10 <> 3""")

ORACLE["ingest_items"] = """
WITH owned AS (
  SELECT o_custkey, CAST(l_partkey AS VARCHAR) AS item_id, l_quantity / 60.0::DOUBLE AS h,
         l_linenumber / 60.0::DOUBLE AS r, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT o_custkey, 's' || l_suppkey, 0, 0, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 'u' || o_custkey AS user_id, item_id, count(*) AS n_rows, round(sum(h), 6) AS hours,
       round(sum(r), 6) AS recent_hours, max(l_linenumber) AS items_count
FROM owned GROUP BY o_custkey, item_id"""

ORACLE["ingest_bad_lines"] = """
SELECT count(*) AS n_lines, count(*) FILTER (doc_id % 10 = 3) AS n_bad FROM documents JOIN labels USING (doc_id)"""

# what is written and read back must be what was written
ORACLE["survival_saved"] = ORACLE["survival_dataset"]
ORACLE["split_saved"] = ORACLE["holdout_split"]
ORACLE["weights_saved"] = ORACLE["tfidf_weights"]
ORACLE["vectors_cached"] = ORACLE["dense_vectors"]
ORACLE["vectors_changed"] = on_t("""
now AS (SELECT item_id, item_id = (SELECT min(item_id) FROM T) AS new,
               CASE WHEN item_id = (SELECT min(item_id) FROM T) THEN review_text || ' again' ELSE review_text END AS review_text FROM T)
SELECT item_id, CASE WHEN new THEN 1 ELSE 0 END AS version, length(review_text)::DOUBLE AS chars,
       len(string_split(review_text, ' '))::DOUBLE AS words FROM now""")


ORACLE["results_document"] = on_l("leaves AS (" + _union(
    [f"SELECT 'summary' AS \"table\", NULL::VARCHAR AS feature, '{name}' AS path, ({value})::DOUBLE AS value FROM L"
     for name, value in {"n_rows": "count(*)", "n_churned": "sum(event)", "n_retained": "sum(1 - event)", "churn_rate": "avg(event)"}.items()]
    + [f"SELECT 'rates', '{f}', 'by_event.' || event, avg({f})::DOUBLE FROM L GROUP BY event" for f in BINARY]
    + [f"SELECT 'shape', '{f}', '{name}', ({agg}({f}))::DOUBLE FROM L"
       for f in FEATURES for name, agg in {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}.items()]
) + """)
SELECT "table", feature, path, round(value, 6) AS value FROM leaves""")


# ---------------------------------------------------------------- studies: all variants, folds and scores


def _study(variants: dict[str, tuple[str, ...]], folded: str, jobs: str) -> str:
    """Fits of all `variants` without each fold and on all rows (fold 5), and the concordance of each job. `jobs`
    selects (i, job, rows of L): the rows that the model without fold i scores under that name."""
    uses = lambda f: ", ".join(str(v) for v, own in enumerate(variants.values()) if f in own)
    values = ", ".join(f"CASE WHEN v IN ({uses(f)}) THEN CAST({f} AS DOUBLE) ELSE 0.0::DOUBLE END AS x{j}" for j, f in enumerate(FEATURES, 1))
    models = (
        f"SELECT CAST(6 * v + i AS INTEGER) AS k, duration AS t, event AS e, {values} "
        f"FROM folded, range(0, 6) AS a(i), range(0, {len(variants)}) AS b(v) WHERE fold <> i"
    )
    risk = " + ".join(
        f"CASE WHEN v IN ({uses(f)}) THEN ({f} - m{j}) * b{j} / s{j} ELSE 0 END" for j, f in enumerate(FEATURES, 1)
    )
    named = " ".join(f"WHEN {v} THEN '{name}'" for v, name in enumerate(variants))
    sizes = " ".join(f"WHEN {v} THEN {len(own)}" for v, own in enumerate(variants.values()))
    lists = " ".join(f"WHEN {v} THEN '{','.join(own)}'" for v, own in enumerate(variants.values()))
    return on_l_recursive(folded + newton_steps(models, len(FEATURES), STEPS) + f""",
jobs AS ({jobs}),
held AS MATERIALIZED (
  SELECT v, job, duration AS t, event AS e, round({risk}, 9) AS r, count(*) AS w
  FROM jobs, range(0, {len(variants)}) AS b(v) JOIN fit ON fit.k = 6 * v + i JOIN scale ON scale.k = 6 * v + i GROUP BY ALL),
scores AS (
  SELECT a.v, a.job, sum(CASE WHEN b.r < a.r THEN a.w * b.w WHEN b.r = a.r THEN 0.5 * a.w * b.w ELSE 0 END)::DOUBLE / sum(a.w * b.w) AS c
  FROM held a JOIN held b ON a.v = b.v AND a.job = b.job AND a.e = 1 AND (b.t > a.t OR (b.t = a.t AND b.e = 0)) GROUP BY ALL),
ratios AS (SELECT v, CASE v {sizes} END - 2 AS df, 2 * (f.loglik - g.loglik) AS x
          FROM range(1, {len(variants)}) AS b(v) JOIN fit f ON f.k = 6 * v + 5 JOIN fit g ON g.k = 5),
ratio_tails AS (SELECT *, -x / 2 + ln(1 + CASE WHEN df > 2 THEN x / 2 ELSE 0 END + CASE WHEN df > 4 THEN x * x / 8 ELSE 0 END) AS log_p FROM ratios),
lr AS (SELECT CASE v {named} END || '_vs_baseline' AS comparison, round(x, 4) AS lr_statistic, df, round(exp(log_p), 6) AS p_value,
              round(log_p, 4) AS log_p_value, log_p < ln(0.05) AS significant FROM ratio_tails),
raw AS (SELECT CASE v {named} END AS variant, CASE v {sizes} END AS n_features, CASE v {lists} END AS features,
               avg(c) FILTER (job LIKE 'fold%') AS cv, stddev_pop(c) FILTER (job LIKE 'fold%') AS cv_sd,
               string_agg(printf('%.4f', c), ',' ORDER BY job) FILTER (job LIKE 'fold%') AS cv_folds,
               max(c) FILTER (job = 'holdout') AS holdout, max(c) FILTER (job = 'apparent') AS apparent FROM scores GROUP BY v),
base AS (SELECT cv AS base_cv, holdout AS base_holdout FROM raw WHERE variant = 'baseline')
""")


# The covariate families of the audit.
_BASE, _PLAIN = FEATURES[:2], ("technical_issue", "engagement_dropped")
_POLAR = ("sentiment_score", "frustration_level", "positive_signal", "value_complaint")

AUDIT = _study(
    {"baseline": _BASE, "non_polarity": _BASE + _PLAIN, "polarity_only": _BASE + _POLAR, "full_augmented": _BASE + _PLAIN + _POLAR},
    FOLDED + ",\n",
    "SELECT fold AS i, 'fold' || fold AS job, * FROM folded",
)
LIFTS = """,
lifts AS (SELECT max(base_cv) AS base, max(cv - base_cv) FILTER (variant = 'non_polarity') AS plain,
                 max(cv - base_cv) FILTER (variant = 'polarity_only') AS polar,
                 max(cv - base_cv) FILTER (variant = 'full_augmented') AS whole FROM raw, base)
"""
ORACLE["leakage_audit"] = AUDIT + """
SELECT variant, n_features, features, round(cv, 4) AS cv_mean, round(cv_sd, 4) AS cv_std, cv_folds,
       round(cv - base_cv, 4) AS delta_vs_baseline FROM raw, base"""
ORACLE["leakage_lr_tests"] = AUDIT + "SELECT * FROM lr"
ORACLE["leakage_decomposition"] = AUDIT.rstrip() + LIFTS + """
SELECT round(base, 4) AS base, round(plain, 4) AS non_polarity_lift, round(whole - plain, 4) AS polarity_lift FROM lifts"""
ORACLE["leakage_shares"] = AUDIT.rstrip() + LIFTS + """
SELECT round(plain, 4) AS defensible_predictive_lift, round(polar, 4) AS polarity_lift, round(whole, 4) AS full_augmented_lift,
       round(polar / whole, 3) AS polarity_share, round(plain / whole, 3) AS non_polarity_share FROM lifts"""

EXPERIMENT = _study(
    {"baseline": _BASE, "augmented": FEATURES},
    SPLIT + """,
train AS (SELECT *, md5(concat_ws('|', CAST(user_id AS VARCHAR), CAST(item_id AS VARCHAR), '42')) AS fh
          FROM sides WHERE split = 'train'),
folded AS MATERIALIZED (
  SELECT *, CAST(CASE WHEN r < (n % 5) * (n // 5 + 1) THEN r // (n // 5 + 1)
                      ELSE (n % 5) + (r - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold
  FROM (SELECT *, row_number() OVER (ORDER BY fh) - 1 AS r, count(*) OVER () AS n FROM train)),
""",
    f"""SELECT fold AS i, 'fold' || fold AS job, duration, event, {", ".join(FEATURES)} FROM folded
  UNION ALL SELECT 5, 'apparent', duration, event, {", ".join(FEATURES)} FROM folded
  UNION ALL SELECT 5, 'holdout', duration, event, {", ".join(FEATURES)} FROM sides WHERE split = 'test'""",
)
ORACLE["experiment"] = EXPERIMENT + """
SELECT variant, n_features, features, round(cv, 4) AS cv_mean, round(cv_sd, 4) AS cv_std, cv_folds,
       round(holdout, 4) AS holdout_cindex, round(apparent, 4) AS apparent_cindex,
       round(cv - base_cv, 4) AS delta_vs_baseline, round(holdout - base_holdout, 4) AS delta_holdout FROM raw, base"""
ORACLE["experiment_summary"] = EXPERIMENT + """
SELECT round(cv, 4) AS cv_cindex, round(holdout, 4) AS holdout_cindex, round(cv - base_cv, 4) AS delta_cindex,
       round(holdout - base_holdout, 4) AS delta_holdout, log_p_value, significant
FROM raw, base, lr WHERE variant = 'augmented'"""
