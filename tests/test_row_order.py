"""Queries over the events hold their SQL whatever order rows come in: users who did the same have the same values."""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from driftlens.functions.sums import cut, joined
from driftlens.plans import catalog
from driftlens.sources.trajectories import events_trajectory

SMALL = "/root/testdata/sf0.01/events.parquet"
HELD = ["frozen_score", "event_p_values", "feature_series", "detect_robust_z", "detect_pelt", "events_of_all_methods", "freq_residual", "top_movers", "calibrated_events", "event_ranking", "detection_power", "incidents", "detect_page_hinkley", "top_frozen"]


@pytest.fixture(scope="module")
def orders(tmp_path_factory):
    """The same events, four times with shifted keys: in order in one file, and shuffled over seven."""
    ordered, mixed = tmp_path_factory.mktemp("ordered"), tmp_path_factory.mktemp("mixed")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE TABLE e AS SELECT event_id + c * 10000 AS event_id, ts, user_id + c * 150 AS user_id, event_type, value, props FROM '{SMALL}' CROSS JOIN (SELECT unnest(range(4)) AS c)")
    con.execute(f"COPY (SELECT * FROM e ORDER BY event_id) TO '{ordered}/events.parquet' (FORMAT parquet)")
    (mixed / "events.parquet").mkdir()
    for k in range(7):
        con.execute(f"COPY (SELECT * FROM e WHERE hash(event_id) % 7 = {k} ORDER BY hash(event_id, 1)) TO '{mixed}/events.parquet/{k}.parquet' (FORMAT parquet)")
    return str(ordered), str(mixed)


def test_copies_have_equal_vectors(spark, orders):
    rows = events_trajectory(spark, orders[1]).groupBy("ckpt", F.col("id") % 150).agg(F.count_distinct("vec").alias("n"))
    assert rows.where("n > 1").count() == 0


def test_sums_of_any_values(spark):
    values = {"money": [0.1, 0.2, 0.3, -0.6], "fine": [1 / 3, 1e-12, 2 / 3], "large": [1e12, 3e11], "none": [None, None], "some": [None, 2.5], "nan": [1.0, math.nan], "inf": [1.0, math.inf]}
    df = spark.createDataFrame([(k, v) for k, own in values.items() for v in own], "k string, v double")
    held, rest = cut(F.col("v"))
    got = {r.k: r.s for r in df.groupBy("k").agg(joined(F.sum(held), F.sum(rest)).alias("s")).collect()}
    assert got["money"] == 0.0 and got["large"] == 1.3e12 and got["none"] is None and got["some"] == 2.5
    assert math.isclose(got["fine"], 1 + 1e-12, rel_tol=1e-15) and math.isnan(got["nan"]) and got["inf"] == math.inf


@pytest.mark.parametrize("name", HELD)
def test_query_holds_its_sql(spark, orders, name):
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{orders[0]}/events.parquet'")
    want = con.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    assert Counter(tuple(r) for r in catalog.QUERIES[name](spark, orders[1]).select(*columns).collect()) == Counter(want.fetchall())
