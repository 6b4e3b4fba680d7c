"""The registered queries over the driver's tables, each with its SQL twin where SQL can express it.

Trajectories are derived from whole tables (``sources.trajectories``): "e" from events, "l" from lineitem, "v" from
embeddings. Doubles are rounded on both sides.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens import sql as V
from driftlens.functions import directions as FD
from driftlens.functions import sketches as K
from driftlens.functions.moments import cells, moments
from driftlens.functions.stage import settle
from driftlens.operators import attribution as A
from driftlens.operators import calibrate as C
from driftlens.operators import detect as D
from driftlens.operators import geometry as G
from driftlens.operators import incidents as I
from driftlens.operators import movement as M
from driftlens.operators import mutate as U
from driftlens.operators import pairs as P
from driftlens.operators import series as S
from driftlens.sources import bucketed as B
from driftlens.sources import trajectories as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _rounded(value: Column | str, digits: int) -> Column:
    """A double to so many digits. As in the SQL, its product tells a half from less: 0.17225 is a little below one, though it prints as one."""
    scale = 10.0**digits
    # adding 0.0 turns a rounded -0.0 into 0.0
    return F.round((F.col(value) if isinstance(value, str) else value) * scale) / scale + 0.0


def _round(df: DataFrame, digits: int = 4, *names: str) -> DataFrame:
    doubles = [n for n, kind in df.dtypes if kind == "double" and (not names or n in names)]
    return df.withColumns({n: _rounded(n, digits) for n in doubles}).drop("run")


E_ROWS = """
WITH ev AS (
  SELECT user_id AS id, event_type, value, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS day FROM events
), cum AS (
  SELECT k, id, count(*) AS n, sum(CASE WHEN day > 2 * k - 7 THEN 1 ELSE 0 END) AS recent,
         sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS v1, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS v2,
         sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS v3, sum(CASE WHEN event_type = 'signup' THEN value ELSE 0 END) AS v4,
         sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) AS v5
  FROM ev JOIN (SELECT unnest(range(4, greatest(4, (max(day) + 1) // 2) + 1)) AS k FROM ev) ON day <= 2 * k GROUP BY k, id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY recent DESC, id) AS r FROM cum WHERE recent > 0
), rows_e AS (
  SELECT CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS tbl, CAST(k - 4 AS INTEGER) AS ckpt, id, CASE WHEN (id + k) % 17 = 0 THEN id + 1 ELSE id END AS slot,
         CASE WHEN (id + 3 * k) % 29 = 0 THEN 0 ELSE n END AS cnt, v1, v2, v3, v4, v5
  FROM ranked WHERE r <= (SELECT count(DISTINCT user_id) * 2 // 3 FROM events)
)"""
PAIRS = (
    E_ROWS
    + """, pairs AS (
  SELECT coalesce(p.tbl, c.tbl) AS tbl, coalesce(p.ckpt, c.ckpt - 1) AS pair, coalesce(p.id, c.id) AS id, c.cnt - p.cnt AS dcount,
         CASE WHEN p.id IS NULL THEN 'inserted' WHEN c.id IS NULL THEN 'evicted' WHEN p.slot <> c.slot THEN 'slot_moved'
              WHEN c.cnt < p.cnt THEN 'readmitted' ELSE 'clean' END AS status,
         p.v1 AS p1, p.v2 AS p2, p.v3 AS p3, p.v4 AS p4, p.v5 AS p5, c.v1 AS c1, c.v2 AS c2, c.v3 AS c3, c.v4 AS c4, c.v5 AS c5, c.cnt
  FROM rows_e p FULL JOIN rows_e c ON p.tbl = c.tbl AND p.id = c.id AND c.ckpt = p.ckpt + 1
  WHERE coalesce(p.ckpt, c.ckpt - 1) BETWEEN 0 AND (SELECT max(ckpt) - 1 FROM rows_e)
), counts AS (
  SELECT tbl, pair, count_if(status = 'clean') AS n_clean, count_if(status = 'slot_moved') AS n_slot_moved, count_if(status = 'readmitted') AS n_readmitted,
         count_if(status = 'inserted') AS n_inserted, count_if(status = 'evicted') AS n_evicted,
         count_if(status <> 'inserted') AS n_prev, count_if(status <> 'evicted') AS n_cur
  FROM pairs GROUP BY tbl, pair
), rates AS (
  SELECT tbl, pair, n_inserted / greatest(n_cur, 1) AS inserted_rate, n_evicted / greatest(n_cur, 1) AS evicted_rate,
         n_slot_moved / greatest(n_clean + n_slot_moved + n_readmitted, 1) AS slot_moved_rate, n_readmitted / greatest(n_clean + n_slot_moved + n_readmitted, 1) AS readmit_rate
  FROM counts
), moves AS (
  SELECT tbl, pair, id, dcount, cnt, sqrt((c1-p1)**2 + (c2-p2)**2 + (c3-p3)**2 + (c4-p4)**2 + (c5-p5)**2) AS dn,
         (p1*c1 + p2*c2 + p3*c3 + p4*c4 + p5*c5) / (sqrt(p1**2 + p2**2 + p3**2 + p4**2 + p5**2) * sqrt(c1**2 + c2**2 + c3**2 + c4**2 + c5**2) + 1e-12) AS cos
  FROM pairs WHERE status = 'clean'
)"""
)
SCORES = (
    PAIRS
    + """, mv AS (
  SELECT tbl, pair, id, ln(dn) AS y, ln(1 + greatest(dcount, 0)) AS x FROM moves WHERE dn > 0
), fit AS (
  SELECT tbl, pair, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, stddev_pop(x) AS sx, median(y) AS my FROM mv GROUP BY tbl, pair
), res AS (
  SELECT mv.tbl, mv.pair, id, CASE WHEN sx < 1e-12 THEN y - my ELSE y - (a + b * x) END AS r FROM mv JOIN fit ON mv.tbl = fit.tbl AND mv.pair = fit.pair WHERE n >= 3
), med AS (
  SELECT tbl, pair, median(r) AS m, stddev_pop(r) AS sd FROM res GROUP BY tbl, pair
), mad AS (
  SELECT res.tbl, res.pair, any_value(m) AS m, CASE WHEN 1.4826 * median(abs(r - m)) < 1e-12 THEN any_value(sd) ELSE 1.4826 * median(abs(r - m)) END AS s
  FROM res JOIN med ON res.tbl = med.tbl AND res.pair = med.pair GROUP BY res.tbl, res.pair
), resid AS (
  SELECT res.tbl, res.pair, id, CASE WHEN s < 1e-12 THEN 0 ELSE greatest(-25, least(25, (r - m) / s)) END AS fr FROM res JOIN mad ON res.tbl = mad.tbl AND res.pair = mad.pair
), ranks AS (
  SELECT *, rank() OVER (PARTITION BY tbl, pair ORDER BY dcount) + (count(*) OVER (PARTITION BY tbl, pair, dcount) - 1) / 2 AS rank_dcount,
         rank() OVER (PARTITION BY tbl, pair ORDER BY dn) + (count(*) OVER (PARTITION BY tbl, pair, dn) - 1) / 2 AS rank_dn,
         count(*) OVER (PARTITION BY tbl, pair) AS n FROM moves
), scores AS (
  SELECT ranks.tbl, ranks.pair, ranks.id, ranks.dcount, dn, coalesce(fr, 0) AS freq_residual, rank_dcount, rank_dn,
         CASE WHEN n <= 1 THEN 0 ELSE (rank_dcount - rank_dn) / (n - 1) END AS frozen
  FROM ranks LEFT JOIN resid ON ranks.tbl = resid.tbl AND ranks.pair = resid.pair AND ranks.id = resid.id
), summary AS (
  SELECT tbl, pair, avg(CASE WHEN dn > 0 THEN 1.0 ELSE 0.0 END) AS mover_frac, quantile_cont(dn, 0.5) AS delta_p50, quantile_cont(dn, 0.95) AS delta_p95, max(dn) AS delta_max,
         max(freq_residual) AS freq_resid_max, CAST(count_if(abs(freq_residual) >= 4) AS DOUBLE) AS n_freq_resid_hi, max(frozen) AS frozen_max
  FROM scores GROUP BY tbl, pair
), norms AS (
  SELECT tbl, ckpt - 1 AS pair, avg(sqrt(v1**2 + v2**2 + v3**2 + v4**2 + v5**2)) AS mean_row_norm FROM rows_e GROUP BY tbl, ckpt
), wide AS (
  SELECT rates.tbl, rates.pair, inserted_rate, evicted_rate, slot_moved_rate, readmit_rate, coalesce(mover_frac, 0.0) AS mover_frac, coalesce(delta_p50, 0.0) AS delta_p50,
         coalesce(delta_p95, 0.0) AS delta_p95, coalesce(delta_max, 0.0) AS delta_max, coalesce(freq_resid_max, 0.0) AS freq_resid_max,
         coalesce(n_freq_resid_hi, 0.0) AS n_freq_resid_hi, coalesce(frozen_max, 0.0) AS frozen_max, mean_row_norm
  FROM rates LEFT JOIN summary ON rates.tbl = summary.tbl AND rates.pair = summary.pair LEFT JOIN norms ON rates.tbl = norms.tbl AND rates.pair = norms.pair
), series AS (
  SELECT tbl, metric, CAST(pair AS INTEGER) AS idx, CAST(2 * (pair + 5) AS BIGINT) AS step, value FROM wide UNPIVOT (value FOR metric IN (inserted_rate, evicted_rate, slot_moved_rate, readmit_rate,
    mover_frac, delta_p50, delta_p95, delta_max, freq_resid_max, n_freq_resid_hi, frozen_max, mean_row_norm))
)"""
)
EVENTS = (
    SCORES
    + """, centre AS (
  SELECT tbl, metric, median(value) AS med, stddev_pop(value) AS sd FROM series GROUP BY tbl, metric
), scale AS (
  SELECT s.tbl, s.metric, any_value(med) AS med, CASE WHEN 1.4826 * median(abs(value - med)) < 1e-12 THEN any_value(sd) ELSE 1.4826 * median(abs(value - med)) END AS scale
  FROM series s JOIN centre c ON s.tbl = c.tbl AND s.metric = c.metric GROUP BY s.tbl, s.metric
), based AS (
  SELECT *, median(value) OVER (PARTITION BY tbl, metric ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS baseline,
         row_number() OVER (PARTITION BY tbl, metric ORDER BY idx) - 1 AS seen FROM series
), z AS (
  SELECT b.tbl, b.metric, idx, step, value, baseline, (value - baseline) / scale AS score, 'robust_z' AS method FROM based b JOIN scale s ON b.tbl = s.tbl AND b.metric = s.metric
  WHERE seen >= 3 AND scale >= 1e-12
)"""
)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.events_trajectory(spark, sf_dir)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.frozen_score(M.freq_residual(settle(M.movement(P.id_pairs(_rows(spark, sf_dir))))))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.to_series(S.features(_rows(spark, sf_dir)))


# --- churn ----------------------------------------------------------------------------------------------------------


@query(E_ROWS + "SELECT tbl, ckpt, id, slot, cnt, round(v1, 4) AS v1, round(v2, 4) AS v2, round(v3, 4) AS v3, round(v4, 4) AS v4, round(v5, 4) AS v5 FROM rows_e")
def trajectory_rows(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rows.select("tbl", "ckpt", "id", "slot", "cnt", *[_rounded(F.col("vec")[i], 4).alias(f"v{i + 1}") for i in range(5)])


@query(PAIRS + "SELECT tbl, pair, CAST(n_clean AS BIGINT) AS n_clean, CAST(n_slot_moved AS BIGINT) AS n_slot_moved, CAST(n_readmitted AS BIGINT) AS n_readmitted, CAST(n_inserted AS BIGINT) AS n_inserted, CAST(n_evicted AS BIGINT) AS n_evicted, CAST(n_prev AS BIGINT) AS n_prev, CAST(n_cur AS BIGINT) AS n_cur, CAST(n_clean + n_slot_moved + n_readmitted AS BIGINT) AS n_survivors FROM counts")
def churn_counts(spark, sf_dir):
    return P.churn_counts(_rows(spark, sf_dir)).drop("run", "step")


@query(PAIRS + "SELECT tbl, pair, round(inserted_rate, 6) AS inserted_rate, round(evicted_rate, 6) AS evicted_rate, round(slot_moved_rate, 6) AS slot_moved_rate, round(readmit_rate, 6) AS readmit_rate FROM rates")
def churn_rates(spark, sf_dir):
    return _round(P.churn_rates(P.churn_counts(_rows(spark, sf_dir))).drop("step"), 6)


@query(PAIRS + "SELECT tbl, pair, id, status, coalesce(dcount, 0) AS dcount FROM pairs")
def status_rows(spark, sf_dir):
    return P.id_pairs(_rows(spark, sf_dir), vectors=False).select("tbl", "pair", "id", "status", F.coalesce("dcount", F.lit(0).cast("long")).alias("dcount"))


def _ids(status: str):
    def run(spark, sf_dir):
        return P.ids_with(P.id_pairs(_rows(spark, sf_dir), vectors=False), status).drop("run")

    return run


for _status in P.STATUSES:
    QUERIES[f"{_status}_ids"] = _ids(_status)
    SQL[f"{_status}_ids"] = PAIRS + f"SELECT tbl, pair, id FROM pairs WHERE status = '{_status}'"


@query(E_ROWS + "SELECT p.tbl, p.ckpt, p.id, coalesce(c.slot, -1) AS slot, coalesce(c.cnt, -1) AS cnt FROM rows_e p LEFT JOIN rows_e c ON p.tbl = c.tbl AND p.id = c.id AND c.ckpt = p.ckpt + 1")
def look_up_next(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    wanted = rows.select("run", "tbl", (F.col("ckpt") + 1).alias("ckpt"), "id")
    return P.look_up(rows, wanted).select("tbl", (F.col("ckpt") - 1).alias("ckpt"), "id", "slot", "cnt")


@query(E_ROWS + "SELECT tbl, ckpt, id, count(*) AS n FROM rows_e GROUP BY tbl, ckpt, id HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return T.duplicate_ids(_rows(spark, sf_dir)).drop("run")


# --- movement -------------------------------------------------------------------------------------------------------


@query(SCORES + "SELECT rates.tbl, rates.pair, round(inserted_rate, 4) AS inserted_rate, round(evicted_rate, 4) AS evicted_rate, round(delta_p50, 4) AS delta_p50, round(delta_p95, 4) AS delta_p95, round(delta_max, 4) AS delta_max FROM rates JOIN summary ON rates.tbl = summary.tbl AND rates.pair = summary.pair")
def pair_summary(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    pairs = P.id_pairs(rows)
    both = P.churn_rates(P.churn_counts(rows, pairs)).join(M.movement_summary(settle(M.movement(pairs))), P.PAIR)
    return _round(both.select("run", "tbl", "pair", "inserted_rate", "evicted_rate", "delta_p50", "delta_p95", "delta_max"))


@query(PAIRS + "SELECT tbl, pair, id, dcount, round(dn, 4) AS dn, round(cos, 6) AS cos, cnt FROM moves")
def movement_rows(spark, sf_dir):
    return _round(_round(M.movement(P.id_pairs(_rows(spark, sf_dir))), 4, "dn").withColumn("run", F.lit("e")), 6, "cos")


@query(SCORES + "SELECT tbl, pair, round(mover_frac, 6) AS mover_frac, round(delta_p50, 4) AS delta_p50, round(delta_p95, 4) AS delta_p95, round(delta_max, 4) AS delta_max FROM summary")
def delta_quantiles(spark, sf_dir):
    return _round(_round(M.movement_summary(settle(M.movement(P.id_pairs(_rows(spark, sf_dir))))), 6, "mover_frac").withColumn("run", F.lit("e")), 4, "delta_p50", "delta_p95", "delta_max")


@query(SCORES + "SELECT tbl, CAST(pair AS INTEGER) AS pair, round(mean_row_norm, 4) AS mean_row_norm FROM norms")
def mean_row_norm(spark, sf_dir):
    return _round(M.mean_row_norm(_rows(spark, sf_dir)))


@query(SCORES + "SELECT tbl, pair, id, round(freq_residual, 4) AS freq_residual FROM scores")
def freq_residual(spark, sf_dir):
    return _round(_scored(spark, sf_dir).select("run", "tbl", "pair", "id", "freq_residual"))


@query(SCORES + "SELECT tbl, pair, id, rank_dcount, rank_dn, round(frozen, 6) AS frozen FROM scores")
def frozen_score(spark, sf_dir):
    return _round(_scored(spark, sf_dir).select("run", "tbl", "pair", "id", "rank_dcount", "rank_dn", "frozen"), 6, "frozen")


@query(SCORES + "SELECT tbl, pair, round(freq_resid_max, 4) AS freq_resid_max, CAST(n_freq_resid_hi AS BIGINT) AS n_freq_resid_hi, round(frozen_max, 4) AS frozen_max FROM summary")
def score_tails(spark, sf_dir):
    return _round(M.score_tails(_scored(spark, sf_dir)))


def _top_sql(by: str) -> str:
    return SCORES + f"SELECT tbl, pair, id, dcount, round(score, 4) AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, {by} AS score, row_number() OVER (PARTITION BY tbl, pair ORDER BY round({by}, 9) DESC, id) AS place FROM scores) WHERE place <= 10"


@query(_top_sql("freq_residual"))
def top_movers(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumn("_by", _rounded("freq_residual", 9))
    return _round(M.top_k(scored, "_by").select("run", "tbl", "pair", "id", "dcount", F.col("freq_residual").alias("score"), "place"))


@query(_top_sql("frozen"))
def top_frozen(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumn("_by", _rounded("frozen", 9))
    return _round(M.top_k(scored, "_by").select("run", "tbl", "pair", "id", "dcount", F.col("frozen").alias("score"), "place"))


# --- the lineitem trajectory: a wide churn of many ids ---------------------------------------------------------------

L_PAIRS = """
WITH rows_l AS (
  SELECT CAST((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS ckpt, l_partkey AS id, count(*) AS cnt, sum(l_quantity) AS v1, sum(l_extendedprice) AS v2, sum(l_discount) AS v3, sum(l_tax) AS v4
  FROM lineitem GROUP BY 1, 2
), pairs AS (
  SELECT 'parts' AS tbl, coalesce(p.ckpt, c.ckpt - 1) AS pair, coalesce(p.id, c.id) AS id, c.cnt - p.cnt AS dcount,
         CASE WHEN p.id IS NULL THEN 'inserted' WHEN c.id IS NULL THEN 'evicted' WHEN c.cnt < p.cnt THEN 'readmitted' ELSE 'clean' END AS status,
         sqrt((c.v1-p.v1)**2 + (c.v2-p.v2)**2 + (c.v3-p.v3)**2 + (c.v4-p.v4)**2) AS dn
  FROM rows_l p FULL JOIN rows_l c ON p.id = c.id AND c.ckpt = p.ckpt + 1
  WHERE coalesce(p.ckpt, c.ckpt - 1) BETWEEN (SELECT min(ckpt) FROM rows_l) AND (SELECT max(ckpt) - 1 FROM rows_l)
)"""


@query(L_PAIRS + "SELECT pair, CAST(count_if(status = 'clean') AS BIGINT) AS n_clean, CAST(count_if(status = 'readmitted') AS BIGINT) AS n_readmitted, CAST(count_if(status = 'inserted') AS BIGINT) AS n_inserted, CAST(count_if(status = 'evicted') AS BIGINT) AS n_evicted, round(quantile_cont(dn, 0.5) FILTER (status = 'clean'), 2) AS delta_p50, round(max(dn) FILTER (status = 'clean'), 2) AS delta_max FROM pairs GROUP BY pair")
def part_churn(spark, sf_dir):
    rows = T.lineitem_trajectory(spark, sf_dir)
    pairs = P.id_pairs(rows)
    both = P.churn_counts(rows, pairs).join(M.movement_summary(settle(M.movement(pairs))), P.PAIR, "left")
    return _round(both.select("run", "pair", "n_clean", "n_readmitted", "n_inserted", "n_evicted", "delta_p50", "delta_max"), 2)


#: The scores of SCORES over the parts' movement instead.
L_SCORES = L_PAIRS + ", moves AS (SELECT tbl, pair, id, dcount, dn FROM pairs WHERE status = 'clean')" + SCORES[len(PAIRS) : SCORES.index(", summary AS (")]


@query(L_SCORES + "SELECT pair, id, round(freq_residual, 3) + 0.0 AS freq_residual, round(frozen, 3) + 0.0 AS frozen FROM scores")
def part_scores(spark, sf_dir):
    """Residual and frozen scores of every part and quarter: the heaviest per-id plan."""
    moves = settle(M.movement(P.id_pairs(T.lineitem_trajectory(spark, sf_dir))))
    return _round(M.frozen_score(M.freq_residual(moves)).select("run", "pair", "id", "freq_residual", "frozen"), 3)


# --- series and detection -------------------------------------------------------------------------------------------


@query(SCORES + "SELECT tbl, metric, idx, step, round(value, 4) AS value FROM series")
def feature_series(spark, sf_dir):
    return _round(_series(spark, sf_dir))


@query()
def geometry_series(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return _round(S.fill_gaps(S.to_series(S.features(rows, G.geometry(G.spectra(rows))))))


@query(EVENTS + "SELECT tbl, metric, idx, step, round(value, 4) AS value, round(baseline, 4) AS baseline, round(score, 3) AS score FROM z WHERE abs(score) >= 1.5")
def detect_robust_z(spark, sf_dir):
    found = D.robust_z(_series(spark, sf_dir), k=1.5).drop("method")
    return _round(_round(found, 3, "score").withColumn("run", F.lit("e")), 4, "value", "baseline")


PH_SQL = (
    EVENTS
    + """, signs AS (SELECT unnest([1.0, -1.0]) AS sign), std AS (
  SELECT s.tbl, s.metric, sign, idx, row_number() OVER (PARTITION BY s.tbl, s.metric, sign ORDER BY idx) AS i, sign * (value - med) / scale AS x
  FROM series s JOIN scale c ON s.tbl = c.tbl AND s.metric = c.metric CROSS JOIN signs WHERE scale >= 1e-12
), walk AS (
  WITH RECURSIVE w(tbl, metric, sign, i, seen, mean, total, least, alarm) AS (
    SELECT DISTINCT tbl, metric, sign, CAST(0 AS BIGINT), 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE) FROM std
    UNION ALL
    SELECT tbl, metric, sign, i, CASE WHEN fires THEN 0 ELSE seen END, CASE WHEN fires THEN 0 ELSE mean END, CASE WHEN fires THEN 0 ELSE total END,
           CASE WHEN fires THEN 0 ELSE least END, CASE WHEN fires THEN total - least END
    FROM (SELECT tbl, metric, sign, i, seen, mean, total, least, seen > 3 AND total - least > 0.3 AS fires
          FROM (SELECT tbl, metric, sign, i, seen, mean, total, least(low, total) AS least
                FROM (SELECT w.tbl, w.metric, w.sign, s.i, w.seen + 1 AS seen, w.mean + (s.x - w.mean) / (w.seen + 1) AS mean,
                             w.total + s.x - (w.mean + (s.x - w.mean) / (w.seen + 1)) AS total, w.least AS low
                      FROM w JOIN std s ON w.tbl = s.tbl AND w.metric = s.metric AND w.sign = s.sign AND s.i = w.i + 1)))
  ) SELECT * FROM w
)
SELECT w.tbl, w.metric, s.idx, round(w.sign * alarm, 3) AS score FROM walk w JOIN std s ON w.tbl = s.tbl AND w.metric = s.metric AND w.sign = s.sign AND w.i = s.i WHERE alarm IS NOT NULL"""
)


@query(PH_SQL)
def detect_page_hinkley(spark, sf_dir):
    found = D.page_hinkley(_series(spark, sf_dir), lam=0.3)
    return _round(found.select("run", "tbl", "metric", "idx", "score"), 3)


def _pelt_sql(penalty: float) -> str:
    """Tables that end in pelt (tbl, metric, idx, step, value, baseline, score): every admissible segmentation, the cheapest taken."""
    return f""", known AS (
  SELECT s.tbl, s.metric, s.idx, s.step, s.value, s.med, s.scale, (s.value - s.med) / s.scale AS x, row_number() OVER (PARTITION BY s.tbl, s.metric ORDER BY s.idx) - 1 AS at
  FROM (SELECT series.*, med, scale FROM series JOIN scale ON series.tbl = scale.tbl AND series.metric = scale.metric WHERE scale >= 1e-12) s
), sizes AS (SELECT tbl, metric, count(*) AS n FROM known GROUP BY tbl, metric),
ends AS (SELECT tbl, metric, n, unnest(range(0, n, 5)) AS c FROM sizes UNION SELECT tbl, metric, n, n FROM sizes),
segments AS (
  SELECT a.tbl, a.metric, a.n, a.c AS a, b.c AS b, sum(x * x) - sum(x) ** 2 / count(*) AS cost
  FROM ends a JOIN ends b ON a.tbl = b.tbl AND a.metric = b.metric AND b.c - a.c >= 3 JOIN known k ON k.tbl = a.tbl AND k.metric = a.metric AND k.at >= a.c AND k.at < b.c GROUP BY ALL
), ways AS (
  WITH RECURSIVE w(tbl, metric, n, c, cost, cuts) AS (
    SELECT tbl, metric, n, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST([] AS BIGINT[]) FROM sizes WHERE n >= 6
    UNION ALL
    SELECT w.tbl, w.metric, w.n, s.b, w.cost + s.cost + {penalty}, CASE WHEN s.b < s.n THEN list_append(w.cuts, s.b) ELSE w.cuts END FROM w JOIN segments s ON w.tbl = s.tbl AND w.metric = s.metric AND w.c = s.a
  ) SELECT tbl, metric, arg_min(cuts, cost) AS cuts FROM w WHERE c = n GROUP BY tbl, metric
), cuts AS (SELECT tbl, metric, unnest(cuts) AS at FROM ways),
pelt AS (
  SELECT c.tbl, c.metric, max(idx) FILTER (k.at = c.at) AS idx, max(step) FILTER (k.at = c.at) AS step, max(value) FILTER (k.at = c.at) AS value,
         avg(value) FILTER (k.at < c.at) AS baseline, avg(x) FILTER (k.at >= c.at) - avg(x) FILTER (k.at < c.at) AS score
  FROM cuts c JOIN known k ON k.tbl = c.tbl AND k.metric = c.metric AND k.at BETWEEN c.at - 3 AND c.at + 2 GROUP BY c.tbl, c.metric, c.at
)"""


@query(EVENTS + _pelt_sql(1.0) + "SELECT tbl, metric, CAST(idx AS INTEGER) AS idx, round(baseline, 3) AS baseline, round(score, 3) AS score FROM pelt")
def detect_pelt(spark, sf_dir):
    return _round(D.pelt(_series(spark, sf_dir), penalty=1.0).select("run", "tbl", "metric", "idx", "baseline", "score"), 3)


@query(EVENTS + "SELECT tbl, metric, idx, step, method, round(abs(score) / 2.5, 3) AS severity, CASE WHEN score > 0 THEN 'up' ELSE 'down' END AS direction FROM z WHERE abs(score) / 2.5 >= 1")
def calibrated_events(spark, sf_dir):
    """Robust-z events over a bar of 2.5 scales."""
    found = D.detect_trajectory(_series(spark, sf_dir), {"robust_z": 2.5}, methods=("robust_z",))
    return _round(found.select("run", "tbl", "metric", "idx", "step", "method", "severity", "direction"), 3)


_BARS = {"robust_z": 2.0, "page_hinkley": 4.0, "pelt": 1.0}


@query(
    PH_SQL[: PH_SQL.rindex("SELECT w.tbl")]
    + _pelt_sql(1.0)
    + f""", every AS (
  SELECT tbl, metric, idx, step, 'robust_z' AS method, score, {_BARS["robust_z"]} AS bar FROM z
  UNION ALL SELECT tbl, metric, idx, step, 'pelt', score, {_BARS["pelt"]} FROM pelt
  UNION ALL SELECT w.tbl, w.metric, s.idx, s.step, 'page_hinkley', w.sign * alarm, {_BARS["page_hinkley"]} FROM walk w
    JOIN (SELECT std.*, series.step FROM std JOIN series USING (tbl, metric, idx)) s ON w.tbl = s.tbl AND w.metric = s.metric AND w.sign = s.sign AND w.i = s.i WHERE alarm IS NOT NULL
) SELECT tbl, metric, CAST(idx AS INTEGER) AS idx, CAST(step AS BIGINT) AS step, method, round(abs(score) / bar, 3) AS severity, CASE WHEN score > 0 THEN 'up' ELSE 'down' END AS direction FROM every WHERE abs(score) >= bar"""
)
def events_of_all_methods(spark, sf_dir):
    """All three methods over bars of their own, candidates taken permissively."""
    found = D.detect_trajectory(_series(spark, sf_dir), _BARS)
    return _round(found.select("run", "tbl", "metric", "idx", "step", "method", "severity", "direction"), 3)


@query()
def detected_events(spark, sf_dir):
    """All three methods at their calibrated thresholds."""
    found = D.detect_trajectory(_series(spark, sf_dir), D.THRESHOLDS)
    return _round(found.select("run", "tbl", "metric", "idx", "step", "method", "severity", "direction", "value", "baseline", "score"), 3)


@query(EVENTS + "SELECT tbl, metric, idx, round(abs(score), 3) AS severity FROM z ORDER BY round(abs(score), 9) DESC, idx, tbl, metric LIMIT 10")
def event_ranking(spark, sf_dir):
    found = D.detect_trajectory(_series(spark, sf_dir), k=0.0, methods=("robust_z",)).withColumn("severity", _rounded("severity", 9))
    return _round(D.top(found, 10).select("run", "tbl", "metric", "idx", "severity"), 3)


@query(
    EVENTS
    + """, found AS (SELECT tbl, metric, idx, step, abs(score) AS severity FROM z WHERE abs(score) >= 3.5),
idxs AS (SELECT DISTINCT idx FROM found), chained AS (SELECT idx, CASE WHEN idx - lag(idx) OVER (ORDER BY idx) > 1 THEN 1 ELSE 0 END AS new FROM idxs),
placed AS (SELECT idx, sum(new) OVER (ORDER BY idx) AS incident FROM chained)
SELECT CAST(incident AS BIGINT) AS incident, round(max(severity), 3) AS severity, count(*) AS n_events, string_agg(DISTINCT tbl, ',' ORDER BY tbl) AS tables, min(step) AS first_step, max(step) AS last_step
FROM found JOIN placed USING (idx) GROUP BY incident"""
)
def incidents(spark, sf_dir):
    found = I.incidents(D.detect_trajectory(_series(spark, sf_dir), k=3.5, methods=("robust_z",)))
    return _round(found.select("run", "incident", "severity", "n_events", F.array_join("tables", ",").alias("tables"), F.array_min("steps").alias("first_step"), F.array_max("steps").alias("last_step")), 3)


# --- geometry -------------------------------------------------------------------------------------------------------

V_SQL = """
WITH coordinates AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
rows_v AS (SELECT id, CAST(k AS INTEGER) AS k, i, CASE WHEN i < 8 THEN v * (1 + k * 0.5) ELSE v * (1 - 0.05 * k) END AS v, k * (1 + id % 7) AS cnt FROM coordinates CROSS JOIN (SELECT unnest(range(0, 4)) AS k))"""


def _vectors(spark, sf_dir):
    return T.embeddings_trajectory(spark, sf_dir)


@query(
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(covar_samp(a.v, b.v), 8) + 0.0 AS cov FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2"""
)
def covariance_matrix(spark, sf_dir):
    """The upper triangle of the embeddings' covariance from summed moments."""
    rows = _vectors(spark, sf_dir).where("ckpt = 0")
    cov = (F.col("value") - F.col("sum_i") * F.col("sum_j") / F.col("n")) / (F.col("n") - 1)
    return cells(moments(rows, G.TABLE)).select("i", "j", _rounded(cov, 8).alias("cov"))


#: Two coordinates, sheared more from checkpoint to checkpoint: spectra and directions of the plane have a closed form.
SHEARED_SQL = (
    V_SQL
    + """, plane AS (SELECT id, k, max(v) FILTER (i = 7) AS x, 0.3 * max(v) FILTER (i = 8) + 0.2 * k * max(v) FILTER (i = 7) AS y FROM rows_v WHERE i IN (7, 8) GROUP BY id, k),
sums AS (SELECT k, count(*) AS n, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM plane GROUP BY k),
spans AS (SELECT *, (a + c) / 2 AS mid, sqrt(((a - c) / 2) ** 2 + b * b) AS r, (xx + yy) / 2 AS gmid, sqrt(((xx - yy) / 2) ** 2 + xy * xy) AS gr FROM sums),
axes AS (SELECT *, mid + r AS l1, (mid + r) / (2 * mid) AS p, (mid - r) / (2 * mid) AS q, (a - c) / 2 / r AS c2, b / r AS s2, sqrt(gmid + gr) AS g1, sqrt(gmid - gr) AS g2 FROM spans)
"""
)


def _sheared(spark, sf_dir):
    x, y = F.col("vec")[7], F.col("vec")[8]
    return _vectors(spark, sf_dir).withColumn("vec", F.array(x, 0.3 * y + 0.2 * F.col("ckpt") * x))


@query(SHEARED_SQL + "SELECT k AS ckpt, n, round(exp(-p * ln(p) - q * ln(q)), 6) AS effective_rank, round(2 * p, 6) AS anisotropy, CASE WHEN p >= 0.95 - 1e-9 THEN 1 ELSE 2 END AS rank95 FROM axes")
def geometry_plane(spark, sf_dir):
    return _round(G.geometry(G.spectra(_sheared(spark, sf_dir))).drop("tbl"), 6)


@query(
    SHEARED_SQL
    + """SELECT a.k AS pair, round(CASE WHEN a.p >= 0.9 - 1e-9 THEN least(1, (b.mid + (b.a - b.c) / 2 * a.c2 + b.b * a.s2) / b.l1) ELSE 1 END, 6) AS overlap
FROM axes a JOIN axes b ON b.k = a.k + 1"""
)
def overlap_plane(spark, sf_dir):
    return _round(G.subspace_overlap(G.spectra(_sheared(spark, sf_dir))).drop("tbl"), 6)


@query(
    SHEARED_SQL
    + """SELECT pair, id, round(sqrt(greatest(0, (dx * dx + dy * dy) / 2 + (dx * dx - dy * dy) / 2 * c2 + dx * dy * s2)), 6) AS projected
FROM (SELECT a.k AS pair, a.id, b.x - a.x AS dx, b.y - a.y AS dy FROM plane a JOIN plane b ON a.id = b.id AND b.k = a.k + 1) AS moved JOIN axes ON axes.k = pair + 1"""
)
def projection_plane(spark, sf_dir):
    """Movement along the leading direction of the current side."""
    rows = _sheared(spark, sf_dir)
    return _round(G.project_deltas(P.id_pairs(rows), G.spectra(rows), 1).drop("tbl"), 6)


@query(SHEARED_SQL + "SELECT k AS ckpt, round(g1, 6) AS spectral_norm, round(exp(-g1 / (g1 + g2) * ln(g1 / (g1 + g2)) - g2 / (g1 + g2) * ln(g2 / (g1 + g2))), 6) AS effective_rank FROM axes")
def dense_plane(spark, sf_dir):
    return _round(G.dense_spectra(_sheared(spark, sf_dir)).drop("tbl"), 6)


@query()
def table_geometry(spark, sf_dir):
    return _round(G.geometry(G.spectra(_vectors(spark, sf_dir))))


@query(
    V_SQL
    + """, cov AS (SELECT a.k, a.i, b.i AS j, covar_samp(a.v, b.v) AS c FROM rows_v a JOIN rows_v b ON a.id = b.id AND a.k = b.k GROUP BY a.k, a.i, b.i)
SELECT k AS ckpt, round(sum(CASE WHEN i = j THEN c ELSE 0 END), 8) AS total, round(sum(c * c), 8) AS squares FROM cov GROUP BY k"""
)
def spectrum_moments(spark, sf_dir):
    """Sum and sum of squares of each spectrum, which are traces of the covariance and its square."""
    found = G.spectra(_vectors(spark, sf_dir))
    one = lambda f: F.aggregate("spectrum", F.lit(0.0), f)
    return _round(found.select("run", "ckpt", one(lambda a, x: a + x).alias("total"), one(lambda a, x: a + x * x).alias("squares")), 8)


@query(V_SQL + "SELECT a.k AS pair, a.id, round(sqrt(sum((b.v - a.v) ** 2)), 6) AS projected FROM rows_v a JOIN rows_v b ON a.id = b.id AND a.i = b.i AND b.k = a.k + 1 GROUP BY a.k, a.id")
def project_all(spark, sf_dir):
    """Movement in all directions of the current side: its whole length, whatever the basis."""
    rows = _vectors(spark, sf_dir)
    return _round(G.project_deltas(P.id_pairs(rows), G.spectra(rows), 64).drop("tbl"), 6)


@query()
def subspace_overlap(spark, sf_dir):
    return _round(G.subspace_overlap(G.spectra(_vectors(spark, sf_dir))))


@query()
def spectral_report(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    steps = rows.groupBy(*G.TABLE).agg(F.max("step").alias("step"))
    return G.spectral_report(G.spectra(rows), steps).select("tbl", "steps", "rank90", "rank95", "rank99", F.transform("effective_rank", lambda x: F.round(x, 4)).alias("effective_rank"), "stable_since")


@query()
def project_deltas(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return _round(G.project_deltas(P.id_pairs(rows), G.spectra(rows), 8), 6)


@query(
    V_SQL
    + """, deltas AS (SELECT a.k, a.id, list(b.v - a.v ORDER BY a.i) AS d FROM rows_v a JOIN rows_v b ON a.id = b.id AND a.i = b.i AND b.k = a.k + 1 GROUP BY a.k, a.id),
now AS (SELECT k - 1 AS k, id AS other, list(v ORDER BY i) AS x FROM rows_v GROUP BY k, id)
SELECT 'vectors' AS tbl, d.k AS pair, d.id, round(sqrt(var_samp(list_inner_product(d.d, now.x))), 6) AS projected FROM deltas d JOIN now ON d.k = now.k GROUP BY d.k, d.id"""
)
def weighted_deltas(spark, sf_dir):
    """The root of the quadratic form in the covariance: how much all vectors vary along the movement."""
    rows = _vectors(spark, sf_dir)
    return _round(G.project_deltas(P.id_pairs(rows), G.spectra(rows), 0, weighted=True), 6)


@query(
    """WITH x AS (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
k AS (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS k), y AS (SELECT k, CASE WHEN i < 8 THEN v * (1 + k * 0.5) ELSE v * (1 - 0.05 * k) END AS a, CASE WHEN i < 8 THEN v * (1 + (k + 1) * 0.5) ELSE v * (1 - 0.05 * (k + 1)) END AS b FROM x CROSS JOIN k WHERE k < 3)
SELECT k AS pair, round(sqrt(sum((b - a) ** 2)), 4) AS delta_norm, round(sqrt(sum((b - a) ** 2)) / (sqrt(sum(a * a)) + 1e-12), 6) AS rel_delta_norm, round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)) + 1e-12), 6) AS cosine FROM y GROUP BY k"""
)
def dense_delta(spark, sf_dir):
    """The embeddings matrix as one dense tensor."""
    found = G.dense_deltas(_vectors(spark, sf_dir)).drop("tbl")
    return _round(_round(found, 4, "delta_norm").withColumn("run", F.lit("v")), 6, "rel_delta_norm", "cosine")


@query()
def dense_spectra(spark, sf_dir):
    return _round(G.dense_spectra(_vectors(spark, sf_dir)))


# --- attribution ----------------------------------------------------------------------------------------------------


@query(
    PAIRS
    + """SELECT tbl, pair, count(*) AS n, round(sqrt((avg(c1) - avg(p1)) ** 2 + (avg(c2) - avg(p2)) ** 2 + (avg(c3) - avg(p3)) ** 2 + (avg(c4) - avg(p4)) ** 2 + (avg(c5) - avg(p5)) ** 2), 4) AS mean_shift_norm,
round(count(*) * ((avg(c1) - avg(p1)) ** 2 + (avg(c2) - avg(p2)) ** 2 + (avg(c3) - avg(p3)) ** 2 + (avg(c4) - avg(p4)) ** 2 + (avg(c5) - avg(p5)) ** 2)
  / sum((c1-p1)**2 + (c2-p2)**2 + (c3-p3)**2 + (c4-p4)**2 + (c5-p5)**2), 4) AS frac_translation
FROM pairs WHERE status = 'clean' GROUP BY tbl, pair HAVING count(*) >= 8"""
)
def mean_shift(spark, sf_dir):
    found = A.procrustes(P.id_pairs(_rows(spark, sf_dir)))
    return _round(found.select("run", "tbl", "pair", "n", "mean_shift_norm", "frac_translation"))


@query()
def procrustes(spark, sf_dir):
    return _round(A.procrustes(P.id_pairs(_rows(spark, sf_dir))).drop("rotation", "mean_prev", "mean_cur"))


@query()
def attribution_summary(spark, sf_dir):
    return _round(A.attribution(P.id_pairs(_rows(spark, sf_dir)))[0])


@query()
def idiosyncratic(spark, sf_dir):
    return _round(A.attribution(P.id_pairs(_rows(spark, sf_dir)))[1].select("run", "tbl", "pair", "id", "aligned_dn", "idiosyncratic"))


#: Orthogonal alignment in two dimensions, where the nearest rotation or reflection has a closed form.
PLANE = (
    PAIRS
    + """, flat AS (SELECT tbl, pair, id, dcount, cnt, p1 AS a, p2 AS b, c1 AS x, c2 AS y FROM pairs WHERE status = 'clean'),
centre AS (SELECT tbl, pair, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(x) AS mx, avg(y) AS my FROM flat GROUP BY tbl, pair HAVING count(*) >= 8),
sums AS (
  SELECT f.tbl, f.pair, any_value(n) AS n, any_value(ma) AS ma, any_value(mb) AS mb, any_value(mx) AS mx, any_value(my) AS my, sum((a-ma)**2 + (b-mb)**2) AS pp, sum((x-mx)**2 + (y-my)**2) AS cc,
         sum((x-mx)*(a-ma)) AS s11, sum((x-mx)*(b-mb)) AS s12, sum((y-my)*(a-ma)) AS s21, sum((y-my)*(b-mb)) AS s22
  FROM flat f JOIN centre c ON f.tbl = c.tbl AND f.pair = c.pair GROUP BY f.tbl, f.pair
), turned AS (
  SELECT *, s11*s22 - s12*s21 AS det, sqrt((s11+s22)**2 + (s12-s21)**2) AS direct, sqrt((s11-s22)**2 + (s12+s21)**2) AS mirrored, (mx-ma)**2 + (my-mb)**2 AS shift FROM sums
), aligned AS (
  SELECT *, CASE WHEN det >= 0 THEN direct ELSE mirrored END AS nuclear,
         CASE WHEN det >= 0 THEN (s11+s22)/direct ELSE (s11-s22)/mirrored END AS r11, CASE WHEN det >= 0 THEN (s12-s21)/direct ELSE (s12+s21)/mirrored END AS r12,
         CASE WHEN det >= 0 THEN (s21-s12)/direct ELSE (s12+s21)/mirrored END AS r21, CASE WHEN det >= 0 THEN (s11+s22)/direct ELSE (s22-s11)/mirrored END AS r22
  FROM turned
), energies AS (
  SELECT *, pp + cc - 2*(s11+s22) AS apart, greatest(0, pp + cc - 2*nuclear) AS rest, pp + cc - 2*(s11+s22) + n*shift + 1e-12 AS total FROM aligned
), moved AS (
  SELECT f.tbl, f.pair, f.id, dcount, cnt, sqrt(((a-ma) - (x-mx)*r11 - (y-my)*r21)**2 + ((b-mb) - (x-mx)*r12 - (y-my)*r22)**2) AS adn
  FROM flat f JOIN aligned g ON f.tbl = g.tbl AND f.pair = g.pair
), logs AS (
  SELECT tbl, pair, id, ln(adn) AS y, ln(1 + greatest(coalesce(dcount, 0), 0)) AS u, ln(1 + greatest(cnt, 0)) AS v FROM moved WHERE adn > 0
), covs AS (
  SELECT tbl, pair, count(*) AS n, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, covar_pop(y, u) AS yu, covar_pop(y, v) AS yv, var_pop(u) AS uu, var_pop(v) AS vv, covar_pop(u, v) AS uv, var_pop(y) AS yy FROM logs GROUP BY tbl, pair
), fit AS (
  SELECT *, (yu*vv - yv*uv) / (uu*vv - uv**2) AS b1, (yv*uu - yu*uv) / (uu*vv - uv**2) AS b2 FROM covs WHERE n >= 5
), off AS (SELECT l.tbl, l.pair, l.id, l.y - my - b1 * (u - mu) - b2 * (v - mv) AS r FROM logs l JOIN fit f ON l.tbl = f.tbl AND l.pair = f.pair),
mid AS (SELECT tbl, pair, median(r) AS m, stddev_pop(r) AS sd FROM off GROUP BY tbl, pair),
wide AS (SELECT o.tbl, o.pair, any_value(m) AS m, CASE WHEN 1.4826 * median(abs(r - m)) < 1e-12 THEN any_value(sd) ELSE 1.4826 * median(abs(r - m)) END AS s FROM off o JOIN mid ON o.tbl = mid.tbl AND o.pair = mid.pair GROUP BY o.tbl, o.pair)"""
)


def _plane(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return settle(P.id_pairs(rows.withColumn("vec", F.slice("vec", 1, 2))))


@query(
    PLANE
    + """SELECT e.tbl, e.pair, e.n, round(sqrt(shift), 4) AS mean_shift_norm, round(n * shift / total, 4) AS frac_translation, round((apart - rest) / total, 4) AS frac_rotation, round(rest / total, 4) AS frac_aligned,
round(sqrt((r11-1)**2 + r12**2 + r21**2 + (r22-1)**2), 4) AS rotation_magnitude FROM energies e"""
)
def procrustes_plane(spark, sf_dir):
    """Alignment of the first two coordinates."""
    return _round(A.procrustes(_plane(spark, sf_dir)).drop("rotation", "mean_prev", "mean_cur"))


@query(PLANE + "SELECT f.tbl, f.pair, round((b1 * yu + b2 * yv) / yy, 4) AS popularity_r2, round(b1, 3) AS of_growth, round(b2, 3) AS of_count FROM fit f")
def popularity_plane(spark, sf_dir):
    """Movement left after the alignment against how much an id was trained, in logarithms."""
    pairs = _plane(spark, sf_dir)
    fit = A.popularity_fit(settle(A.aligned_movement(pairs, settle(A.procrustes(pairs))))).where("fitted")
    return _round(_round(fit.select("run", "tbl", "pair", F.col("r2").alias("popularity_r2"), F.col("coef")[1].alias("of_growth"), F.col("coef")[2].alias("of_count")), 4, "popularity_r2").withColumn("run", F.lit("e")), 3, "of_growth", "of_count")


@query(PLANE + "SELECT m.tbl, m.pair, m.id, round(adn, 4) AS aligned_dn, round(coalesce(CASE WHEN s < 1e-12 THEN 0 ELSE greatest(-25, least(25, (r - m) / s)) END, 0), 3) AS idiosyncratic FROM moved m LEFT JOIN off o ON m.tbl = o.tbl AND m.pair = o.pair AND m.id = o.id LEFT JOIN wide w ON m.tbl = w.tbl AND m.pair = w.pair")
def idiosyncratic_plane(spark, sf_dir):
    """Scores of single ids after alignment and popularity are taken out."""
    found = A.attribution(_plane(spark, sf_dir))[1].select("run", "tbl", "pair", "id", "aligned_dn", "idiosyncratic")
    return _round(_round(found, 4, "aligned_dn").withColumn("run", F.lit("e")), 3, "idiosyncratic")


@query(
    SCORES
    + """, r AS (SELECT tbl, pair, id % 7 = 0 AS hit, rank() OVER (PARTITION BY tbl, pair ORDER BY dn) + (count(*) OVER (PARTITION BY tbl, pair, dn) - 1) / 2 AS rk FROM moves)
SELECT tbl, pair, round(CASE WHEN count_if(hit) = 0 OR count_if(NOT hit) = 0 THEN 0.5 ELSE (sum(CASE WHEN hit THEN rk ELSE 0 END) - count_if(hit) * (count_if(hit) + 1) / 2) / (count_if(hit) * count_if(NOT hit)) END, 6) AS auc FROM r GROUP BY tbl, pair"""
)
def movement_auc(spark, sf_dir):
    moves = M.movement(P.id_pairs(_rows(spark, sf_dir))).withColumn("hit", F.col("id") % 7 == 0)
    return _round(A.auc(moves, "dn", "hit", P.PAIR), 6)


# --- mutation and calibration ---------------------------------------------------------------------------------------


def _planted(kind: str):
    def run(spark, sf_dir):
        """Every 25th vector corrupted in the second checkpoint, and the movement that shows."""
        rows = _vectors(spark, sf_dir).where("ckpt < 2")
        targets = rows.where((F.col("ckpt") == 1) & (F.col("id") % 25 == 0)).select(*U.KEY)
        bad = U.set_rows(rows, U.mutated(rows.where("ckpt = 1"), targets, kind, 4.0))
        return _round(M.movement(P.id_pairs(bad)).select("run", "pair", "id", "dn", (F.col("id") % 25 == 0).alias("planted")))

    return run


for _kind in ("scramble", "zero", "noise"):
    QUERIES[f"mutate_{_kind}"] = _planted(_kind)
SQL["mutate_zero"] = V_SQL + "SELECT CAST(0 AS INTEGER) AS pair, id, round(sqrt(sum(((CASE WHEN id % 25 = 0 THEN 0 ELSE b.v END) - a.v) ** 2)), 4) AS dn, id % 25 = 0 AS planted FROM rows_v a JOIN rows_v b USING (id, i) WHERE a.k = 0 AND b.k = 1 GROUP BY id"


@query(
    V_SQL
    + """, top AS (SELECT id FROM (SELECT DISTINCT id, cnt FROM rows_v WHERE k = 2) ORDER BY cnt DESC, id LIMIT 40),
planted AS (SELECT 'once' AS trial, a.id, a.k, a.i, CASE WHEN a.k = 2 AND t.id IS NOT NULL THEN b.v ELSE a.v END AS v FROM rows_v a JOIN rows_v b ON a.id = b.id AND a.i = b.i AND b.k = 1 LEFT JOIN top t ON a.id = t.id
  UNION ALL SELECT 'on', a.id, a.k, a.i, CASE WHEN a.k >= 2 AND t.id IS NOT NULL THEN b.v ELSE a.v END FROM rows_v a JOIN rows_v b ON a.id = b.id AND a.i = b.i AND b.k = 1 LEFT JOIN top t ON a.id = t.id)
SELECT a.trial, a.k AS pair, a.id, round(sqrt(sum((b.v - a.v) ** 2)), 4) AS dn FROM planted a JOIN planted b ON a.trial = b.trial AND a.id = b.id AND a.i = b.i AND b.k = a.k + 1 GROUP BY a.trial, a.k, a.id"""
)
def mutate_freeze(spark, sf_dir):
    """The 40 most trained vectors frozen at the third checkpoint, once and for good, as two trials of one plan."""
    rows = _vectors(spark, sf_dir)
    trials = spark.createDataFrame([(t, "vectors", "freeze", 1.0, 40, 2, on, 0) for t, on in (("once", False), ("on", True))], "trial string, tbl string, kind string, magnitude double, n_ids int, step int, persistent boolean, seed long")
    named = rows.select("*", F.explode(F.array(F.lit("once"), F.lit("on"))).alias("trial")).withColumn("run", F.col("trial")).select(*rows.columns)
    return _round(M.movement(P.id_pairs(U.inject_trials(named, trials))).select(F.col("run").alias("trial"), "run", "pair", "id", "dn"))


@query(E_ROWS + "SELECT tbl, ckpt, round(quantile_disc(sqrt(v1**2 + v2**2 + v3**2 + v4**2 + v5**2), 0.5), 4) AS typical FROM rows_e GROUP BY tbl, ckpt")
def typical_norm(spark, sf_dir):
    return _round(U.typical_norm(_rows(spark, sf_dir)))


@query(
    EVENTS
    + """, pool AS (SELECT metric, max(abs(score)) AS worst FROM z GROUP BY metric), bar AS (SELECT quantile_cont(worst, 0.8) AS threshold FROM pool)
SELECT 'robust_z' AS method, round(threshold, 3) AS threshold FROM bar"""
)
def null_thresholds(spark, sf_dir):
    """Each metric as a run of its own: the score that a fifth of them exceed somewhere."""
    found = D.robust_z(_series(spark, sf_dir), k=0.0)
    maxima = found.groupBy(F.col("metric").alias("run"), "method").agg(F.max(F.abs("score")).alias("worst"))
    return _round(C.thresholds(maxima, 0.2), 3)


@query(
    EVENTS
    + """, sev AS (SELECT tbl AS label, CAST(idx AS DOUBLE) AS magnitude, metric, max(abs(score)) AS severity FROM z GROUP BY 1, 2, 3)
SELECT label, magnitude, 'robust_z' AS method, round(avg(CASE WHEN severity >= 1.0 THEN 1.0 ELSE 0.0 END), 6) AS tpr FROM sev GROUP BY 1, 2"""
)
def detection_power(spark, sf_dir):
    """The share of metrics whose score reaches one scale, by table and index."""
    found = D.robust_z(_series(spark, sf_dir), k=0.0)
    severities = found.groupBy(F.col("tbl").alias("label"), F.col("idx").cast("double").alias("magnitude"), "metric", "method").agg(F.max(F.abs("score")).alias("severity"))
    bars = found.select("method").distinct().withColumn("threshold", F.lit(1.0))
    return _round(C.power(severities, bars), 6)


@query(
    EVENTS
    + """, sev AS (SELECT tbl AS label, idx, metric, max(abs(score)) AS severity FROM z GROUP BY 1, 2, 3), tpr AS (SELECT label, idx, avg(CASE WHEN severity >= 0.5 THEN 1.0 ELSE 0.0 END) AS tpr FROM sev GROUP BY 1, 2)
SELECT label, 'robust_z' AS method, coalesce(CAST(min(idx) FILTER (tpr >= 0.6) AS DOUBLE), -1) AS magnitude FROM tpr GROUP BY label"""
)
def first_detectable(spark, sf_dir):
    """The first index from which three in five metrics reach half a scale, by table; -1 for none."""
    found = D.robust_z(_series(spark, sf_dir), k=0.0)
    severities = found.groupBy(F.col("tbl").alias("label"), F.col("idx").cast("double").alias("magnitude"), "metric", "method").agg(F.max(F.abs("score")).alias("severity"))
    least = C.least_detectable(C.power(severities, found.select("method").distinct().withColumn("threshold", F.lit(0.5))), 0.6)
    return least.withColumn("magnitude", F.when(F.col("magnitude") < float("inf"), F.col("magnitude")).otherwise(-1.0))


@query(
    EVENTS
    + """, spans AS (SELECT unnest(['a', 'b', 'a']) AS tbl, unnest([2, 4, 9]) AS first, unnest([4, 7, 30]) AS last), methods AS (SELECT unnest(['robust_z', 'page_hinkley', 'pelt']) AS method)
SELECT s.tbl, CAST(s.first AS INTEGER) AS first, m.method, round(coalesce(max(abs(score)), 0.0), 4) AS severity FROM spans s CROSS JOIN methods m LEFT JOIN z ON z.tbl = s.tbl AND z.method = m.method AND z.idx BETWEEN s.first AND s.last GROUP BY ALL"""
)
def local_severities(spark, sf_dir):
    """The greatest robust-z score within three spans of indices; methods without an event have 0."""
    found = D.robust_z(_series(spark, sf_dir), k=0.0)
    spans = spark.createDataFrame([(f"trial-{k}", *s) for k, s in enumerate([("a", 2, 4), ("b", 4, 7), ("a", 9, 30)])], "trial string, tbl string, first int, last int")
    events = spans.select("trial", "tbl").join(found.drop("run"), "tbl").withColumnRenamed("trial", "run")
    return _round(C.local_severity(events, spans.withColumnRenamed("trial", "run")).select("run", "tbl", "first", "method", "severity"))


@query(
    E_ROWS
    + """, kept AS (SELECT * FROM rows_e WHERE NOT (tbl = 'b' AND ckpt = 5)), sizes AS (SELECT tbl, ckpt, count(*) AS n FROM kept GROUP BY 1, 2)
SELECT p.tbl, p.ckpt AS pair, p.n AS n_prev, c.n AS n_cur, CAST(2 * (p.ckpt + 5) AS BIGINT) AS step FROM sizes p JOIN sizes c ON p.tbl = c.tbl AND c.ckpt = p.ckpt + 1"""
)
def table_pairs(spark, sf_dir):
    """Tables that stand in both checkpoints of a pair, where one table is missing from a checkpoint."""
    return P.pair_tables(_rows(spark, sf_dir).where("not (tbl = 'b' and ckpt = 5)")).drop("run", "counted")


@query(E_ROWS + "SELECT tbl, ckpt, id, round(v1, 4) AS v1, round(v2, 4) AS v2, round(v3, 4) AS v3, round(v4, 4) AS v4, round(v5, 4) AS v5 FROM rows_e WHERE cnt > 3")
def gathered_rows(spark, sf_dir):
    """Vectors looked up by id for all well-trained residents."""
    rows = _rows(spark, sf_dir)
    found = P.gather(rows, rows.where("cnt > 3").select("run", "tbl", "ckpt", "id"))
    return found.select("tbl", "ckpt", "id", *[_rounded(F.col("vec")[i], 4).alias(f"v{i + 1}") for i in range(5)])


@query(
    EVENTS
    + """, pool AS (SELECT abs(score) AS s FROM z WHERE tbl = 'b')
SELECT tbl, metric, idx, method, round(score, 4) AS score, round((SELECT count(*) FROM pool WHERE s >= abs(score)) / (SELECT count(*) FROM pool), 4) AS p FROM z WHERE tbl = 'a'"""
)
def event_p_values(spark, sf_dir):
    """Events of table a against the scores of table b as a clean pool."""
    found = D.robust_z(_series(spark, sf_dir), k=0.0)
    own = found.where("tbl = 'a'").select("run", "tbl", "metric", "idx", "method", "score")
    return _round(C.p_values(own, found.where("tbl = 'b'").select("method", "score")), 4)




@query(SCORES + """SELECT tbl, id, count(s.pair) AS n, round(coalesce(avg(dn), -1), 4) AS dn, round(coalesce(avg(frozen), -1), 4) + 0.0 AS frozen
FROM (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'a' ELSE 'b' END AS tbl, user_id AS id FROM events) LEFT JOIN scores s USING (tbl, id) GROUP BY tbl, id""")
def nominated_ids(spark, sf_dir):
    """Every user of the events as a nominated id: pairs in which it is clean, and its mean movement and frozen score (-1 for none)."""
    rows = _rows(spark, sf_dir)
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("id")).distinct()
    wanted = users.select(F.lit("e").alias("run"), T.table_of(F.col("id")).alias("tbl"), "id")
    found = M.nominated(M.frozen_score(M.movement(P.id_pairs(rows))), wanted, ["dn", "frozen"])
    return _round(found.select("run", "tbl", "id", "n", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("dn", "frozen")]))


# --- sketches, bucketed tables, SQL -----------------------------------------------------------------------------------

SHARES = (0.01, 0.25, 0.5, 0.75, 0.95, 0.99)
L_VALUES = """
WITH cells AS (
  SELECT (year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS ckpt, l_partkey AS id, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2
)"""


@query(L_VALUES + f"SELECT p, count(*) AS n, true AS within FROM cells, (SELECT unnest([{', '.join(map(str, SHARES))}])::DOUBLE AS p) GROUP BY p")
def sketched_quantiles(spark, sf_dir):
    """Quantiles of what a part shipped a quarter, from the quarters' merged sketches: are their true ranks within the bound?"""
    values = T.lineitem_trajectory(spark, sf_dir).select("run", "ckpt", F.col("vec")[1].alias("value"))
    asked = K.quantiles(K.merged(K.sketched(values, ["run", "ckpt"]), ["run"]), list(SHARES))
    below, upto = (F.count_if(c) / F.first("n") for c in (F.col("v.value") < F.col("q.value"), F.col("v.value") <= F.col("q.value")))
    ranks = values.alias("v").join(F.broadcast(asked).alias("q"), "run").groupBy("p").agg(F.first("n").alias("n"), below.alias("low"), upto.alias("high"))
    return ranks.select("p", "n", ((F.col("low") - K.rank_error() <= F.col("p")) & (F.col("p") <= F.col("high") + K.rank_error())).alias("within"))


@query(EVENTS + "SELECT tbl, metric, idx, method, true AS within FROM z WHERE tbl = 'a'")
def sketched_p_values(spark, sf_dir):
    """Are the p-values of events from a sketch of the pool, merged over its metrics, within the bound of the exact ones?"""
    found = settle(D.robust_z(_series(spark, sf_dir), k=0.0))
    own, pool = found.where("tbl = 'a'").select("run", "tbl", "metric", "idx", "method", "score"), found.where("tbl = 'b'").select("method", "metric", "score")
    kept = K.merged(K.sketched(pool.withColumn("value", F.abs("score")), ["method", "metric"]), ["method"])
    both = C.p_values(K.p_values(own, kept, ["method"]).withColumnRenamed("p", "_near"), pool.select("method", "score"))
    return both.select("tbl", "metric", "idx", "method", (F.abs(F.col("_near") - F.col("p")) <= K.rank_error() + 1 / K.GRID).alias("within"))


@query(V_SQL + "SELECT k AS ckpt, CAST(i AS INTEGER) AS i, count(*) AS n, round(sum(v * v), 6) AS squares, true AS within FROM rows_v GROUP BY k, i")
def sketched_directions(spark, sf_dir):
    """Sketches of 16 rows of two halves of the ids, merged: do they hold each axis's sum of squares within what they say they lost?"""
    rows = _vectors(spark, sf_dir)
    halves = FD.sketched(rows.withColumn("tbl", F.when(F.col("id") % 2 == 0, "even").otherwise("odd")), G.TABLE, 16)
    one = FD.merged(halves, ["ckpt"], 16)
    near = one.select("ckpt", "n", "energy", "lost", "width", F.posexplode("sketch").alias("at", "x")).groupBy("ckpt", "n", "energy", "lost", (F.col("at") % F.col("width")).alias("i")).agg(F.sum(F.col("x") * F.col("x")).alias("near"))
    exact = rows.select("ckpt", F.posexplode("vec").alias("i", "x")).groupBy("ckpt", "i").agg(F.sum(F.col("x") * F.col("x")).alias("squares"))
    slack = F.lit(1e-9) * F.col("energy")
    within = (F.col("near") <= F.col("squares") + slack) & (F.col("squares") <= F.col("near") + F.col("lost") + slack) & (F.col("lost") * 17 <= F.col("energy") + slack)
    return exact.join(near, ["ckpt", "i"]).select("ckpt", "i", "n", _rounded("squares", 6).alias("squares"), within.alias("within"))


@query(SQL["churn_counts"])
def bucketed_churn(spark, sf_dir):
    """churn_counts over a table bucketed by id that was written a checkpoint after the other: no row is shuffled to meet its neighbour."""
    rows = settle(_rows(spark, sf_dir))
    name = f"drift_rows_{zlib.crc32(sf_dir.encode())}"
    B.write_bucketed(rows.where("ckpt < 6"), name, 8, "overwrite")
    B.append_checkpoint(rows.where("ckpt >= 6"), name)
    return P.churn_counts(spark.table(name)).drop("run", "step")


@query(
    PAIRS
    + """, inserted AS (SELECT pair, count(*) AS n FROM pairs WHERE tbl = 'a' AND status = 'inserted' GROUP BY pair)
SELECT counts.pair, CAST(n_evicted AS BIGINT) AS n_evicted, CAST(n_cur AS BIGINT) AS n_cur, CAST(coalesce(inserted.n, 0) AS BIGINT) AS n_inserted, round(coalesce(max_dn, 0), 4) + 0.0 AS max_dn
FROM counts LEFT JOIN inserted ON counts.pair = inserted.pair LEFT JOIN (SELECT pair, max(dn) AS max_dn FROM moves WHERE tbl = 'a' GROUP BY pair) AS m ON counts.pair = m.pair
WHERE tbl = 'a' AND counts.pair BETWEEN 2 AND 8"""
)
def churn_in_sql(spark, sf_dir):
    """Views and table functions of the SQL surface, through one text."""
    V.register(spark, _rows(spark, sf_dir))
    return spark.sql(
        """SELECT c.pair, c.n_evicted, c.n_cur, coalesce(i.n, 0) AS n_inserted, round(coalesce(m.max_dn, 0), 4) + CAST(0 AS DOUBLE) AS max_dn FROM drift_between('a', 2, 9) c
        LEFT JOIN (SELECT pair, count(*) AS n FROM drift_ids('a', 'inserted') GROUP BY pair) i ON c.pair = i.pair
        LEFT JOIN (SELECT pair, max(dn) AS max_dn FROM drift_movement WHERE tbl = 'a' GROUP BY pair) m ON c.pair = m.pair"""
    )
