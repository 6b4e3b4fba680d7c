"""The engine in SQL: views and table functions over checkpoint rows.

``register(spark, rows)`` makes, for the session:

* drift_rows, drift_pairs (an id of a pair of checkpoints a row), drift_churn (a pair a row), drift_movement (scores by id);
* drift_ids(table, status): the ids of one status, and drift_between(table, a, b): churn from checkpoint a to b - 1;
* with events=True, drift_series and drift_events, which are computed when they are registered.

Views are plans, not copies: filters and columns asked for reach the scan of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.operators import movement as M
from driftlens.operators import pairs as P
from driftlens.operators.detect import THRESHOLDS, detect_trajectory
from driftlens.operators.series import run_series

_CHURN = "run STRING, tbl STRING, pair INT, step BIGINT, n_clean BIGINT, n_slot_moved BIGINT, n_readmitted BIGINT, n_inserted BIGINT, n_evicted BIGINT, n_survivors BIGINT, n_prev BIGINT, n_cur BIGINT"
FUNCTIONS = (
    """CREATE OR REPLACE TEMPORARY FUNCTION drift_ids(of_table STRING, of_status STRING) RETURNS TABLE (run STRING, pair INT, id BIGINT)
RETURN SELECT run, pair, id FROM drift_pairs WHERE tbl = of_table AND status = of_status""",
    f"""CREATE OR REPLACE TEMPORARY FUNCTION drift_between(of_table STRING, a INT, b INT) RETURNS TABLE ({_CHURN})
RETURN SELECT {", ".join(c.split()[0] for c in _CHURN.split(", "))} FROM drift_churn WHERE tbl = of_table AND pair >= a AND pair < b""",
)


def register(spark: SparkSession, rows: DataFrame, events: bool = False, thresholds: dict[str, float] | None = THRESHOLDS) -> None:
    """Make the views and functions; those of an earlier call are replaced."""
    rows.createOrReplaceTempView("drift_rows")
    pairs = P.id_pairs(rows, vectors=False)
    flat = pairs.select(*P.PAIR, "step", "id", "status", "dcount", *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("prev", "cur") for c in ("slot", "cnt")])
    flat.createOrReplaceTempView("drift_pairs")
    P.churn_counts(rows).select(*[c.split()[0] for c in _CHURN.split(", ")]).createOrReplaceTempView("drift_churn")
    M.movement(P.id_pairs(rows)).createOrReplaceTempView("drift_movement")
    for text in FUNCTIONS:
        spark.sql(text)
    if events:
        series = run_series(rows)
        series.createOrReplaceTempView("drift_series")
        detect_trajectory(series, thresholds).createOrReplaceTempView("drift_events")
