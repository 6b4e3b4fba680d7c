import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.functions import directions as FD
from driftlens.operators import geometry as G

KIND = "run string, tbl string, ckpt int, id long, vec array<double>"


def vectors(n=900, width=40, seed=5):
    """Three checkpoints whose spectrum falls quickly and whose directions turn a little."""
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.normal(size=(width, width)))[0]
    turn = np.linalg.qr(np.eye(width) + 0.1 * rng.normal(size=(width, width)))[0]
    x = rng.normal(size=(n, width)) * 0.7 ** np.arange(width) @ basis + 0.5
    return [x, 1.3 * x @ turn, x @ turn @ turn]


def frame(spark, tables):
    return spark.createDataFrame([("r", "t", k, i, [float(v) for v in row]) for k, x in enumerate(tables) for i, row in enumerate(x)], KIND)


def inside(r, x, size):
    b = np.asarray(r.sketch).reshape(-1, r.width)
    gap = np.linalg.eigvalsh(x.T @ x - b.T @ b)
    assert len(b) <= size and r.n == len(x) and abs(r.energy - (x * x).sum()) < 1e-6 and np.allclose(r.s, x.sum(0))
    assert gap[0] > -1e-6 and gap[-1] <= r.lost + 1e-6 and r.lost <= r.energy / (size + 1) + 1e-6


@pytest.mark.parametrize("parts", [1, 7, 150])
def test_sketches_hold_their_bound(spark, parts):
    tables = vectors()
    df = frame(spark, tables).repartition(parts)
    for r in FD.sketched(df, G.TABLE, 12).collect():
        inside(r, tables[r.ckpt], 12)


def test_merged_sketches(spark):
    tables = vectors(300)
    df = frame(spark, tables).withColumn("part", (F.col("id") % 5).cast("int"))
    odd = spark.createDataFrame([("r", "t", 0, 1, None), ("r", "t", 0, 2, []), ("r", "t", 1, 3, [float("nan")] * 40), ("r", "t", 1, 4, [None] * 40)], KIND).withColumn("part", F.lit(9))
    kept = FD.sketched(df.unionByName(odd), [*G.TABLE, "part"], 8)
    for r in FD.merged(kept, G.TABLE, 8).collect():
        inside(r, tables[r.ckpt], 8)
    inside(FD.merged(kept, ["run"], 8).first(), np.concatenate(tables), 8)
    assert FD.sketched(df.limit(0), G.TABLE).count() == 0


def test_spectra_and_overlap_from_sketches(spark):
    tables = vectors()
    df = frame(spark, tables)
    exact = {r.pair: r.overlap for r in G.subspace_overlap(G.spectra(df)).collect()}
    whole = FD.sketched(df, G.TABLE, 40)
    got = {r.pair: r for r in FD.overlaps(whole).collect()}
    assert {k: round(r.overlap, 9) for k, r in got.items()} == {k: round(v, 9) for k, v in exact.items()} and all(r.low == pytest.approx(r.high, abs=1e-9) for r in got.values())
    few = FD.sketched(df, G.TABLE, 20)
    for r in FD.overlaps(few).collect():
        assert r.low - 1e-9 <= r.overlap <= r.high + 1e-9 and abs(r.overlap - exact[r.pair]) < 0.01 and r.high - r.low < 0.05
    for r in FD.spectra(few, G.TABLE).collect():
        values = np.linalg.eigvalsh(np.cov(tables[r.ckpt].T))[::-1]
        short = values[:20] - np.asarray(r.spectrum)[:20]
        assert short.min() > -1e-9 and short.max() <= r.error + 1e-9 and abs(r.total - values.sum()) < 1e-9


def test_overlap_of_few_and_constant_vectors(spark):
    one = frame(spark, [np.ones((1, 4)), np.ones((3, 4)), np.ones((3, 4)), np.arange(12.0).reshape(3, 4)])
    assert {(r.pair, r.overlap) for r in FD.overlaps(FD.sketched(one, G.TABLE)).collect()} == {(0, 1.0), (1, 1.0), (2, 1.0)}
