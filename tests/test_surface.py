import numpy as np
from pyspark.sql import functions as F

from driftlens import sql
from driftlens.functions import sketches as K
from driftlens.operators import pairs as P
from driftlens.sources import bucketed
from test_engine import planted_run, rows_of


def test_sketches_merge_within_their_bound(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=12_000), np.round(rng.normal(size=8_000), 1)])
    rows = [(f"r{i % 3}", i % 7, float(v)) for i, v in enumerate(values)] + [("r0", 0, None), ("r1", 1, float("nan")), ("r2", 2, float("inf"))]
    df = spark.createDataFrame(rows, "run string, ckpt int, value double")
    kept = K.sketched(df, ["run", "ckpt"]).withColumn("all", F.lit(1))
    one = K.merged(kept, ["all"])
    assert one.first().n == 20_000 and len(one.first().sketch) < 40_000
    for r in K.quantiles(one, [0.0, 0.1, 0.5, 0.9, 1.0]).collect():
        low, high = (values < r.value).mean(), (values <= r.value).mean()
        assert low - K.rank_error() <= r.p <= high + K.rank_error()
    asked = spark.createDataFrame([(1, x) for x in (-9.0, -1.0, 0.0, 2.0, 9.0)] + [(2, 1.0)], "all int, score double")
    pool = K.merged(K.sketched(df.withColumn("value", F.abs("value")), ["run"]).withColumn("all", F.lit(1)), ["all"])
    for r in K.p_values(asked, pool, ["all"]).collect():
        assert abs(r.p - (1.0 if r["all"] == 2 else (np.abs(values) >= abs(r.score)).mean())) <= K.rank_error() + 1 / K.GRID
    few = spark.createDataFrame([("m", float(x)) for x in (1, 2, 2, 3)], "method string, value double")
    own = spark.createDataFrame([("m", x) for x in (2.0, -3.0, 3.5, 0.0)], "method string, score double")
    assert {r.score: r.p for r in K.p_values(own, K.sketched(few, ["method"]), ["method"]).collect()} == {2.0: 0.75, -3.0: 0.25, 3.5: 0.0, 0.0: 1.0}
    assert K.sketched(df.limit(0), ["run"]).count() == 0


def test_neighbours_meet_without_a_shuffle(spark):
    rows = planted_run(spark, 5, 3)
    spark.sql("DROP TABLE IF EXISTS drift_bucketed")
    bucketed.write_bucketed(rows.where("ckpt < 4"), "drift_bucketed", 4)
    bucketed.append_checkpoint(rows.where("ckpt = 4"), "drift_bucketed")
    assert bucketed.buckets_of(spark, "drift_bucketed") == 4
    kept = spark.table("drift_bucketed")
    order = lambda df: sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())
    assert order(P.churn_counts(kept)) == order(P.churn_counts(rows))
    counted = P.churn_counts(kept)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert dealt and not any("id#" in line for line in dealt) and all("pair#" in line or "ckpt#" in line for line in dealt), plan
    pairs = P.id_pairs(kept)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert not any("id#" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line), plan
    assert pairs.count() == P.id_pairs(rows).count()
    spark.sql("DROP TABLE drift_bucketed")


def test_sql_surface(spark):
    v = [1.0, 0.0]
    rows = rows_of(spark, [{1: (0, 5, v), 2: (1, 5, v)}, {2: (1, 6, [0.0, 1.0]), 3: (2, 1, v)}]).unionByName(rows_of(spark, [{9: (0, 1, v)}, {9: (0, 1, v)}], "u"))
    sql.register(spark, rows, events=True, thresholds=None)
    assert [tuple(r) for r in spark.sql("SELECT id, status FROM drift_pairs WHERE tbl = 't' ORDER BY id").collect()] == [(1, "evicted"), (2, "clean"), (3, "inserted")]
    assert [r.id for r in spark.sql("SELECT id FROM drift_ids('t', 'inserted')").collect()] == [3]
    assert [tuple(r) for r in spark.sql("SELECT tbl, n_clean, n_cur FROM drift_between('t', 0, 5)").collect()] == [("t", 1, 2)]
    assert spark.sql("SELECT dn FROM drift_movement WHERE id = 2").first().dn > 1.4
    assert spark.sql("SELECT count(*) AS n FROM drift_series s LEFT JOIN drift_events e USING (run, tbl, metric, idx)").first().n > 10
    sql.register(spark, rows.limit(0))
    assert spark.sql("SELECT * FROM drift_churn").count() == 0
