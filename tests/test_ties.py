"""Scores by a deviation that are equal, or equal to a bar, stay so in whatever order the values of a series come."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.operators import calibrate as C
from driftlens.operators import detect as D
from driftlens.plans import catalog
from driftlens.streaming.detector import events_of

SIZES = [1.0, 0.3, 1 / 41, 1 / 3, 0.7, 1 / 21_000]


def series(spark, length, off, seed):
    """Two tables of series of as many values, of which those at the indices of off differ from the others, by another size in each series."""
    rows = [("e", tbl, f"m{k}", i, i, 1.0 - size * (i in off)) for tbl in "ab" for k, size in enumerate(SIZES) for i in range(length)]
    return spark.createDataFrame(rows, "run string, tbl string, metric string, idx int, step long, value double").repartition(5, F.xxhash64("tbl", "metric", "idx", F.lit(seed)))


@pytest.mark.parametrize("seed", range(3))
def test_p_values_count_equal_scores(spark, seed):
    # each differing value stands 11 / sqrt(10) deviations out, whatever its size
    found = D.robust_z(series(spark, 11, [8], seed), k=0.0)
    p = C.p_values(found.where("tbl = 'a' and idx = 8"), found.where("tbl = 'b'").select("method", "score"))
    assert [r.p for r in p.collect()] == [len(SIZES) / (len(SIZES) * 8)] * len(SIZES)


@pytest.mark.parametrize("seed", range(3))
def test_scores_on_the_bar_are_events(spark, seed):
    # two in ten: the deviation is 0.4 of the size, the score 2.5
    found = D.detect_trajectory(series(spark, 10, [6, 9], seed), {"robust_z": 2.5}, methods=("robust_z",))
    assert sorted((r.tbl, r.metric, r.idx, r.severity) for r in found.collect()) == sorted((tbl, f"m{k}", i, 1.0) for tbl in "ab" for k in range(len(SIZES)) for i in (6, 9))


def test_streamed_scores_on_the_bar_are_events():
    for size in [k / 97 for k in range(1, 97)]:
        value = np.array([1.0 - size * (i in (6, 9)) for i in range(10)])
        assert [(e[0], e[4]) for e in events_of(value, {"robust_z": 2.5})] == [(6, 1.0), (9, 1.0)]


def test_series_have_the_same_bits_in_any_order(spark):
    found, old = [], {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    for parts, adaptive in (("1", "true"), ("13", "false")):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        found.append({(r.tbl, r.metric, r.idx): r.value for r in catalog._series(spark, "/root/testdata/sf0.01").collect()})
    for k, v in old.items():
        spark.conf.set(k, v)
    assert found[0] == found[1]
