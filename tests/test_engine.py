import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.cli import main
from driftlens.functions import moments as Mo
from driftlens.functions.ranks import average_rank, quantiles
from driftlens.operators import attribution as A
from driftlens.operators import calibrate as C
from driftlens.operators import detect as D
from driftlens.operators import geometry as G
from driftlens.operators import incidents as I
from driftlens.operators import movement as M
from driftlens.operators import mutate as U
from driftlens.operators import pairs as P
from driftlens.operators import series as S
from driftlens.report import build_report, incident_rows, listed
from driftlens.sources.trajectories import SCHEMA, checkpoint_index, complete_marks, drop_empty_slots, mark_complete, write_rows
from driftlens.streaming.watch import Watcher, poll


def rows_of(spark, checkpoints, tbl="t", run="r"):
    """checkpoints: a list of {id: (slot, cnt, vec)}."""
    flat = [(run, tbl, k, 100 * k, i, s, c, [float(x) for x in v]) for k, ck in enumerate(checkpoints) for i, (s, c, v) in ck.items()]
    return spark.createDataFrame(flat, SCHEMA)


def by_id(df, *columns):
    return {r.id: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_partition_into_statuses(spark):
    v = [1, 0]
    rows = rows_of(spark, [{1: (0, None, v), 2: (1, None, v), 3: (2, None, v)}, {2: (7, None, v), 3: (2, None, v), 4: (8, None, v)}])
    assert by_id(P.id_pairs(rows), "status") == {1: "evicted", 2: "slot_moved", 3: "clean", 4: "inserted"}
    c = P.churn_counts(rows).first()
    assert (c.n_survivors, c.n_inserted, c.n_evicted, c.n_slot_moved, c.n_clean, c.n_prev, c.n_cur) == (2, 1, 1, 1, 1, 3, 3)
    r = P.churn_rates(P.churn_counts(rows)).first()
    assert (r.inserted_rate, r.slot_moved_rate, r.step) == (pytest.approx(1 / 3), 0.5, 100)


def test_readmission_needs_a_falling_count(spark):
    v = [1, 0]
    rows = rows_of(spark, [{1: (0, 5, v), 2: (1, 9, v), 3: (2, 5, v)}, {1: (0, 6, v), 2: (1, 2, v), 3: (2, 7, v)}])
    assert by_id(P.id_pairs(rows), "status", "dcount") == {1: ("clean", 1), 2: ("readmitted", -7), 3: ("clean", 2)}
    none = rows.withColumn("cnt", F.when(F.col("ckpt") == 0, F.col("cnt")))
    assert by_id(P.id_pairs(none), "status", "dcount") == {1: ("clean", 0), 2: ("clean", 0), 3: ("clean", 0)}


def test_gaps_and_missing_tables_make_no_pair(spark):
    v = [1.0]
    a = rows_of(spark, [{1: (0, 1, v)}, {}, {1: (0, 2, v)}])
    assert P.id_pairs(a).count() == 0
    b = rows_of(spark, [{1: (0, 1, v)}, {2: (0, 1, v)}, {1: (0, 1, v), 2: (0, 2, v)}], "u")
    got = sorted((r.tbl, r.pair, r.id, r.status) for r in P.id_pairs(a.unionByName(b)).collect())
    assert got == [("u", 0, 1, "evicted"), ("u", 0, 2, "inserted"), ("u", 1, 1, "inserted"), ("u", 1, 2, "clean")]


def test_churn_reads_no_vectors(spark, tmp_path):
    write_rows(rows_of(spark, [{1: (0, 1, [1.0])}, {1: (0, 1, [1.0])}]), str(tmp_path / "rows"))
    from driftlens.sources.trajectories import read_rows

    plan = P.id_pairs(read_rows(spark, str(tmp_path / "rows"), "t"), vectors=False)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("vec:" not in line and "vec#" not in line for line in scans)


def test_lookups(spark):
    rows = rows_of(spark, [{1: (4, 7, [1, 2])}])
    wanted = spark.createDataFrame([("r", "t", 0, 1), ("r", "t", 0, 9)], "run string, tbl string, ckpt int, id long")
    assert by_id(P.look_up(rows, wanted), "slot", "cnt") == {1: (4, 7), 9: (-1, -1)}
    assert P.gather(rows, wanted.where("id = 1")).first().vec == [1, 2]
    with pytest.raises(Exception, match="not resident"):
        P.gather(rows, wanted).collect()
    pad = rows.unionByName(rows.withColumn("id", F.lit(2**63 - 1)))
    assert drop_empty_slots(pad).count() == 1
    paths = spark.createDataFrame([("r", "ckpt_010"), ("r", "ckpt_002")], "run string, path string")
    assert {r.path: r.ckpt for r in checkpoint_index(paths).collect()} == {"ckpt_002": 0, "ckpt_010": 1}


def numpy_residual(dn, dc):
    out = np.zeros(len(dn))
    m = dn > 0
    if m.sum() < 3:
        return out
    y, x = np.log(dn[m]), np.log1p(np.maximum(dc[m], 0))
    r = y - np.median(y) if x.std() < 1e-12 else y - np.polyval(np.polyfit(x, y, 1), x)
    off = r - np.median(r)
    s = 1.4826 * np.median(np.abs(off))
    s = s if s >= 1e-12 else r.std()
    out[m] = 0 if s < 1e-12 else np.clip(off / s, -25, 25)
    return out


def numpy_ranks(a):
    return np.array([(a < x).sum() + ((a == x).sum() + 1) / 2 for x in a])


@pytest.mark.parametrize("case", ["plain", "constant count", "two movers", "all alike", "one id"])
def test_scores_match_numpy(spark, case):
    rng = np.random.default_rng(3)
    n = {"two movers": 5, "one id": 1}.get(case, 60)
    dn, dc = np.exp(rng.normal(size=n)), rng.integers(0, 9, n)
    dn[::7] = 0
    if case == "constant count":
        dc[:] = 4
    if case == "two movers":
        dn[:] = [0, 1.0, 0, 2.0, 0]
    if case == "all alike":
        dn[:], dc[:] = 2.0, 3
    moves = spark.createDataFrame([("r", "t", 0, i, int(c), float(d)) for i, (d, c) in enumerate(zip(dn, dc, strict=True))], "run string, tbl string, pair int, id long, dcount long, dn double")
    got = by_id(M.frozen_score(M.freq_residual(moves)), "freq_residual", "frozen")
    frozen = (numpy_ranks(dc) - numpy_ranks(dn)) / (n - 1) if n > 1 else np.zeros(n)
    assert [got[i][0] for i in range(n)] == pytest.approx(numpy_residual(dn, dc).tolist(), abs=1e-7)
    assert [got[i][1] for i in range(n)] == pytest.approx(frozen.tolist(), abs=1e-9)


def test_average_rank_of_any_values(spark):
    values = [0.0, -5.0, 1e9, 1e-9, 3.0, 3.0, -5.0, 0.0, 0.0]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, id long, v double")
    for held in (0, 100):
        assert [by_id(average_rank(df, ["k"], "v", "rank", held), "rank")[i] for i in range(9)] == numpy_ranks(np.array(values)).tolist()


def test_quantiles_by_buckets(spark):
    rng = np.random.default_rng(2)
    groups = {"near": 1e6 + rng.normal(size=900) * 1e-3, "wide": np.exp(rng.normal(size=700) * 9), "ties": rng.integers(0, 3, 500) * 1.0, "one": np.array([4.0]), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "k string, v double")
    wanted = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}
    for held in (0, 10_000):
        got = {r.k: [r[c] for c in wanted] for r in quantiles(df, ["k"], F.col("v"), wanted, held).collect()}
        for k, v in groups.items():
            assert got[k] == pytest.approx(np.quantile(v, list(wanted.values())).tolist(), rel=1e-12), (k, held)
        least = {r.k: [r[c] for c in wanted] for r in quantiles(df, ["k"], F.col("v"), wanted, held, lower=True).collect()}
        assert least == {k: np.quantile(v, list(wanted.values()), method="inverted_cdf").tolist() for k, v in groups.items()}
    ranks = average_rank(df.withColumn("id", F.monotonically_increasing_id()), ["k"], "v", "rank", 0).where("k = 'near'").orderBy("v").collect()
    assert [r["rank"] for r in ranks] == [float(x) for x in range(1, 901)]


def test_matrices_beyond_the_broadcast_bound(spark, monkeypatch):
    from driftlens.functions import matrices

    monkeypatch.setattr(matrices, "GROUP", 7)
    rows = spark.range(100).selectExpr("if(id < 60, 'a', if(id < 90, 'b', 'c')) as k", "id")
    own = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0])], "k string, m array<double>")
    add = lambda pdf, m: pdf[["k", "id"]].assign(s=pdf["id"] + m["m"].sum())
    for most in (0, 10_000):
        got = matrices.apply_by_key(rows, own, ["k"], add, "k string, id long, s double", most).collect()
        assert {(r.k, r.id, r.s) for r in got} == {("a" if i < 60 else "b", i, i + 3.0) for i in range(90)}


def test_movement_and_top(spark):
    rows = rows_of(spark, [{i: (i, 1, [1, 0]) for i in range(6)}, {i: (i, 2, [1, i % 3]) for i in range(6)}])
    moves = M.movement(P.id_pairs(rows))
    assert by_id(moves, "dn") == {i: float(i % 3) for i in range(6)}
    assert by_id(moves, "cos")[2] == pytest.approx(1 / math.sqrt(5))
    s = M.movement_summary(moves).first()
    assert (s.mover_frac, s.delta_p50, s.delta_max) == (pytest.approx(2 / 3), 1.0, 2.0)
    assert [r.id for r in M.top_k(moves, "dn", 3).orderBy("place").collect()] == [2, 5, 1]


def series_of(spark, values, metric="m"):
    return spark.createDataFrame([("r", "t", metric, i, 10 * i, v) for i, v in enumerate(values)], "run string, tbl string, metric string, idx int, step long, value double")


def test_detectors(spark):
    rng = np.random.default_rng(0)
    spike = rng.normal(0, 0.1, 20)
    spike[12] += 5
    level = np.concatenate([rng.normal(0, 0.1, 15), rng.normal(3, 0.1, 15)])
    events = D.detect(series_of(spark, spike.tolist()))
    assert 12 in {r.idx for r in events.where("method = 'robust_z' and direction = 'up'").collect()}
    assert {r.idx for r in D.detect(series_of(spark, level.tolist()), ("pelt",)).collect()} == {15}
    assert D.detect(series_of(spark, rng.normal(0, 1, 50).tolist()), k=8.0, ph_lam=25.0).count() == 0
    assert D.page_hinkley(series_of(spark, np.linspace(0, 5, 40).tolist())).where("score > 0").count() > 0
    assert D.detect(series_of(spark, level.tolist()), ()).count() == 0
    odd = [None, float("nan"), 1.0, 1.0, 1.0, 1.0, 9.0, None, 1.0, 1.0]
    assert {r.idx for r in D.robust_z(series_of(spark, odd), k=1.0).collect()} == {6}
    assert D.detect(series_of(spark, [None] * 6)).count() == D.detect(series_of(spark, [2.0] * 9)).count() == 0


def test_change_points_match_a_full_search():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(6, 24))
        x = np.repeat(rng.normal(0, 3, 4), 6)[:n] + rng.normal(0, 0.3, n)
        cost = lambda a, b, x=x: ((x[a:b] - x[a:b].mean()) ** 2).sum()
        best = {0: (0.0, [])}
        for end in [e for e in range(5, n, 5)] + [n]:
            own = [(best[a][0] + cost(a, end) + 1.0, [*best[a][1], a]) for a in best if end - a >= 3]
            if own:
                best[end] = min(own)
        assert D.change_points(x, 1.0) == ([b for b in best[n][1] if b] if n in best else [])


def test_severity_and_calibration(spark):
    e = spark.createDataFrame([("r", "t", "m", 1, 1, 0.0, 0.0, 12.0, "robust_z"), ("r", "t", "m", 2, 2, 0.0, 0.0, 30.0, "page_hinkley"), ("r", "t", "m", 3, 3, 0.0, 0.0, -3.0, "pelt")], D.EVENT_SCHEMA)
    got = {r.method: r.severity for r in D.with_severity(e, {"robust_z": 6.0, "page_hinkley": 20.0, "pelt": float("inf")}).collect()}
    assert got == {"robust_z": 2.0, "page_hinkley": 1.5, "pelt": 0.0}
    assert {r.severity for r in D.with_severity(e).collect()} == {12.0, 30.0, 3.0}
    assert [r.method for r in D.top(D.with_severity(e), 2).collect()] == ["page_hinkley", "robust_z"]


def test_incidents(spark):
    own = [(4, 17.6), (4, 3.0), (5, 2.0), (5, 1.0), (9, 4.0)]
    events = spark.createDataFrame([("r", "t", f"m{k}", i, i * 10, "robust_z", s) for k, (i, s) in enumerate(own)], "run string, tbl string, metric string, idx int, step long, method string, severity double")
    got = sorted((r.n_events, r.severity, r.steps) for r in I.incidents(events).collect())
    assert got == [(1, 4.0, [90]), (4, 17.6, [40, 50])]
    two = events.where("severity in (17.6, 4.0)")
    assert I.incidents(two, 5).count() == 1 and I.incidents(two, 4).count() == 2
    assert [(r.n_events, r.places) for r in incident_rows(listed(events)).collect()] == [(4, [0, 2, 3, 4]), (1, [1])]


def test_geometry(spark):
    assert [G.shape_of(np.array([10.0, 5, 1, 0])).directions(p) for p in (0.6, 0.9, 0.99, 1.0)] == [1, 2, 3, 3]
    none = G.shape_of(np.zeros(3))
    assert (none.directions(0.9), none.effective_rank, none.anisotropy) == (0, 0, 0) and none.held.tolist() == [0, 0, 0]
    even = G.shape_of(np.full(4, 2.0))
    assert even.effective_rank == pytest.approx(4) and even.anisotropy == pytest.approx(1) and even.directions(0.5) == 2
    assert G.stable_since([100, 200, 300, 400, 500], [9, 5, 5, 6, 5]) == 200
    assert G.stable_since([100, 200, 300, 400, 500], [3, 9, 5, 9, 5]) is None
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)) * np.array([5, 4, 3, 2, 0.01, 0.01, 0.01, 0.01])
    turned = x[:, [4, 5, 6, 7, 0, 1, 2, 3]]
    rows = rows_of(spark, [{i: (i, 1, v) for i, v in enumerate(a)} for a in (x, x, turned)])
    found = G.spectra(rows)
    spectrum = np.array(found.where("ckpt = 0").first().spectrum)
    assert spectrum == pytest.approx(np.linalg.eigvalsh(np.cov(x.T))[::-1], rel=1e-4)
    assert [round(r.overlap, 3) for r in G.subspace_overlap(found).orderBy("pair").collect()][0] == 1.0
    assert G.subspace_overlap(found).where("pair = 1").first().overlap < 0.05
    assert G.geometry(found).where("ckpt = 0").first().effective_rank == pytest.approx(G.shape_of(spectrum).effective_rank)
    pairs = P.id_pairs(rows).where("pair = 1")
    weighted = by_id(G.project_deltas(pairs, found, 0, weighted=True), "projected")
    d = turned[7] - x[7]
    assert weighted[7] == pytest.approx(math.sqrt(d @ np.cov(turned.T) @ d), rel=1e-3)
    one = rows_of(spark, [{1: (0, 1, [1.0, 2.0])}])
    assert G.geometry(G.spectra(one)).first().effective_rank == 0


def test_dense(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(5, 3)), rng.normal(size=(5, 3))
    rows = rows_of(spark, [{i: (0, None, v) for i, v in enumerate(m)} for m in (a, b)]).unionByName(rows_of(spark, [{1: (0, None, [1])}, {1: (0, None, [1, 2])}], "reshaped"))
    r = G.dense_deltas(rows).collect()
    assert len(r) == 1 and r[0].rel_delta_norm == pytest.approx(np.linalg.norm(b - a) / np.linalg.norm(a), rel=1e-5)
    s = G.dense_spectra(rows).where("tbl = 't' and ckpt = 0").first()
    assert s.spectral_norm == pytest.approx(np.linalg.norm(a, 2), rel=1e-4)


def test_spectra_of_any_shape(spark):
    """Tall, wide and large on both sides: no tensor is left out for its size."""
    rng = np.random.default_rng(12)
    shapes = {"tall": (300, 70), "wide": (70, 1500), "long": (3, 10_000), "both": (260, 220), "flat": (200, 210), "none": (4, 0)}
    made = {k: rng.normal(size=s) * np.exp(-np.arange(s[1]) / 60) if k != "flat" else np.outer(np.ones(s[0]), np.arange(s[1])) for k, s in shapes.items()}
    rows = spark.createDataFrame([("r", k, 0, 0, i, i, None, v.tolist()) for k, m in made.items() for i, v in enumerate(m)], SCHEMA).repartition(5)
    got = {r.tbl: r for r in G.dense_spectra(rows, most=100).collect()}
    assert set(got) == set(shapes) - {"none"}
    for k, m in made.items():
        if k in got:
            values = np.linalg.svd(m.astype("f4").astype(float), compute_uv=False)
            exact = min(m.shape) <= 100
            assert got[k].spectral_norm == pytest.approx(values[0], rel=1e-6 if exact else 1e-3), k
            assert got[k].effective_rank == pytest.approx(G.shape_of(values).effective_rank, rel=1e-5 if exact else 0.03), k


def test_moments_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(90, 150))
    rows = rows_of(spark, [{i: (0, 1, v) for i, v in enumerate(x)}, {i: (0, 1, v[:3]) for i, v in enumerate(x[:5])}]).repartition(6)
    monkeypatch.setattr(Mo, "FAN", 2)
    got = {r.ckpt: r for r in Mo.moments(rows, G.TABLE).collect()}
    y = x.astype("f4").astype(float)
    for k, z in ((0, y), (1, y[:5, :3])):
        s, ss = Mo.assemble(got[k].tiles)
        assert got[k].n == len(z) and s == pytest.approx(z.sum(0)) and np.allclose(ss, z.T @ z)
        assert max(len(t.v) for t in got[k].tiles) <= Mo.TILE**2
    assert [len(got[k].tiles) for k in (0, 1)] == [6, 1]
    cells = {(r.i, r.j): (r.value, r.sum_i, r.sum_j) for r in Mo.cells(Mo.moments(rows, G.TABLE)).where("ckpt = 0").collect()}
    assert len(cells) == 150 * 151 // 2 and cells[70, 140] == pytest.approx(((y.T @ y)[70, 140], y.sum(0)[70], y.sum(0)[140]))


def test_rotation_is_not_idiosyncratic(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 12))
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    rows = rows_of(spark, [{i: (i, 5, v) for i, v in enumerate(x)}, {i: (i, 9, v) for i, v in enumerate(x @ q)}])
    s = A.attribution(P.id_pairs(rows))[0].first()
    assert s.frac_rotation > 0.9 and s.frac_aligned < 0.05
    assert s.frac_translation + s.frac_rotation + s.frac_aligned == pytest.approx(1, abs=1e-6)
    few = rows.where("id < 5")
    s, scores = A.attribution(P.id_pairs(few))
    assert s.first().frac_aligned == 1.0 and scores.count() == 0


def test_popularity_is_taken_out(spark):
    rng = np.random.default_rng(0)
    n = 1200
    dc = rng.zipf(1.6, n).clip(1, 5000)
    x = rng.normal(size=(n, 16))
    planted = set(np.argsort(dc)[:40].tolist())
    step = rng.normal(size=(n, 16)) * (0.02 * np.sqrt(dc))[:, None]
    for i in planted:
        step[i] *= 3
    rows = rows_of(spark, [{i: (i, 100, v) for i, v in enumerate(x)}, {i: (i, 100 + int(c), v) for i, (v, c) in enumerate(zip(x + step, dc, strict=True))}])
    pairs = P.id_pairs(rows)
    summary, scores = A.attribution(pairs)
    hit = F.col("id").isin(*planted)
    resid = A.auc(scores.withColumn("hit", hit), "idiosyncratic", "hit", P.PAIR).first().auc
    raw = A.auc(M.movement(pairs).withColumn("hit", hit), "dn", "hit", P.PAIR).first().auc
    assert resid > 0.9 and resid > raw + 0.15 and summary.first().popularity_r2 > 0.3


@pytest.mark.parametrize("kind", ["scramble", "zero", "noise"])
def test_mutation_hits_its_targets(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8))
    rows = rows_of(spark, [{i: (i, 1, v) for i, v in enumerate(x)}] * 2)
    targets = spark.createDataFrame([("r", "t", 1, i) for i in (3, 50, 99, 200, 299)], "run string, tbl string, ckpt int, id long")
    bad = U.set_rows(rows, U.mutated(rows.where("ckpt = 1"), targets, kind, 4.0, seed=1))
    moved = M.top_k(M.movement(P.id_pairs(bad)), "dn", 6).orderBy("place").collect()
    assert {r.id for r in moved[:5]} == {3, 50, 99, 200, 299} and moved[5].dn == 0
    with pytest.raises(Exception, match="not resident"):
        U.mutated(rows, targets.withColumn("id", F.lit(1234).cast("long")), kind).collect()
    with pytest.raises(ValueError):
        U.mutated(rows, targets, "other")


def test_calibration(spark):
    clean = C.synthetic_trajectories(spark, 6, n=24, dim=4, steps=10)
    assert clean.count() == 6 * 24 * 10
    events = C.permissive_events(clean)
    bars = C.thresholds(C.run_maxima(events, clean.select("run").distinct()), 0.2)
    assert {r.method for r in bars.collect()} == set(D.METHODS)
    kinds = [{"label": "scramble", "kind": "scramble", "magnitude": m, "n_ids": 6, "persistent": False} for m in (0.01, 50.0)]
    trials = C.drawn_trials(clean, kinds, 3)
    assert trials.count() == 6 and {r.step for r in trials.collect()} <= set(range(2, 9))
    found = C.power(C.run_trials(clean, trials), bars)
    by = {(r.magnitude, r.method): r.tpr for r in found.collect()}
    assert by[50.0, "robust_z"] >= by[0.01, "robust_z"] and by[50.0, "robust_z"] == 1.0
    assert {r.method: r.magnitude for r in C.least_detectable(found).collect()}["robust_z"] <= 50.0
    p = C.p_values(events.limit(5), events.select("method", "score"))
    assert all(0 < r.p <= 1 for r in p.collect()) and p.count() == 5


def planted_run(spark, steps=12, at=7):
    rng = random.Random(4)
    vec = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(40)}
    made = []
    for k in range(steps):
        vec = {i: [x + rng.gauss(0, 0.02) for x in v] for i, v in vec.items()}
        shown = {i: ([9 * x for x in v] if k == at and i < 10 else v) for i, v in vec.items()}
        made.append({i: (i, (k + 1) * (1 + i % 5), v) for i, v in shown.items()})
    return rows_of(spark, made)


def test_trials_corrupt_as_planned(spark):
    clean = C.synthetic_trajectories(spark, 2, n=12, dim=3, steps=6)
    kinds = ["scramble", "zero", "noise", "freeze"]
    trials = spark.createDataFrame([(f"{k}{on}", "emb", k, 2.0, 3, 3, on, 7 + i) for i, k in enumerate(kinds) for on in (False, True)], "trial string, tbl string, kind string, magnitude double, n_ids int, step int, persistent boolean, seed long")
    rows = clean.where("run = 'syn-0'").withColumn("run", F.explode(F.array(*[F.lit(f"{k}{on}") for k in kinds for on in (False, True)]))).select(*clean.columns)
    got = U.inject_trials(rows, trials)
    old = {(r.ckpt, r.id): r.vec for r in clean.where("run = 'syn-0'").collect()}
    top = {r.id for r in clean.where("run = 'syn-0' and ckpt = 3").orderBy(F.desc("cnt"), "id").limit(3).collect()}
    new: dict = {}
    for r in got.collect():
        if r.vec != old[r.ckpt, r.id]:
            new.setdefault(r.run, {}).setdefault(r.ckpt, {})[r.id] = r.vec
    for k in kinds:
        assert set(new[f"{k}False"]) == {3} and set(new[f"{k}True"]) == {3, 4, 5} and len(new[f"{k}False"][3]) == 3
    assert set(new["freezeTrue"][5]) == top and all(new["freezeTrue"][5][i] == old[2, i] for i in top)
    assert all(v == [0.0] * 3 for v in new["zeroFalse"][3].values())


def test_calibration_job(spark, tmp_path, capsys):
    out = tmp_path / "bars.json"
    write_rows(C.synthetic_trajectories(spark, 3, n=10, dim=3, steps=7), str(tmp_path / "clean"))
    assert main(["calibrate", str(out), "--trials", "1", "--clean", str(tmp_path / "clean")], spark) == 0
    text, made = capsys.readouterr().out, json.loads(out.read_text())
    assert made["target_fpr"] == 0.05 and set(made["methods"]) == set(D.METHODS) and "freeze-on" in text
    assert D.read_thresholds(str(out)) == {m: made["methods"][m]["threshold"] for m in D.METHODS}
    out.write_text('{"methods": {"pelt": {"threshold": 2}}}')
    assert D.read_thresholds(str(out)) == {"robust_z": math.inf, "page_hinkley": math.inf, "pelt": 2.0}


def test_seeds_and_contrasts(spark):
    rows = spark.createDataFrame([(s, d, x) for s, (a, b) in enumerate([(0.7, 0.5), (0.6, 0.65), (0.8, 0.6)]) for d, x in ((16, a), (64, b))], "seed int, dim int, auc double")
    by = {r.dim: (r["mean"], r.sd, r.n) for r in C.seed_statistics(rows, ["dim"], "auc").collect()}
    assert by[16] == (pytest.approx(0.7), pytest.approx(0.1), 3)
    r = C.paired_contrast(rows.where("dim = 16"), rows.where("dim = 64"), "auc").first()
    assert (r["mean"], r.wins, r.n) == (pytest.approx(0.35 / 3), 2, 3) and r.sd == pytest.approx(np.std([0.2, -0.05, 0.2], ddof=1))


def test_report_and_cli(spark, tmp_path, capsys):
    rows = planted_run(spark)
    tensor = spark.createDataFrame([("r", "dense:head", k, 100 * k, i, i, None, [1.0 + i, 2.0 + k + (40.0 if k == 7 else 0)]) for k in range(12) for i in range(3)], SCHEMA)
    rows = rows.unionByName(tensor)
    write_rows(rows, str(tmp_path / "run"))
    report = build_report(rows, "planted")
    assert report.events and {6, 7} & {report.events[k]["idx"] for k in report.incidents[0]["places"]}
    assert {s["metric"] for s in report.series if s["table"] == "dense:head"} == {"rel_delta_norm", "cosine", "effective_rank"}
    made = json.loads(report.to_json())
    assert made["n_checkpoints"] == 12 and made["incidents"][0]["events"] and made["worst_severity"] == round(report.worst(), 3)
    assert all(e["why"]["text"] for e in made["events"])
    assert {"drift", "dense"} <= {e["why"]["kind"] for e in made["events"]} and all(set(e["why"]["top_movers"]) <= set(range(40)) for e in made["events"] if e["why"]["kind"] == "drift")
    assert sorted(k for i in made["incidents"] for k in i["events"]) == list(range(made["n_events"]))
    assert "signals" in report.to_text() and "| step |" in report.to_markdown()
    page = report.to_html(5)
    assert "http://" not in page and "https://" not in page and page.count("</script>") == 2 and "setInterval" in page
    out, web = tmp_path / "r.json", tmp_path / "rank.html"
    assert main(["report", str(tmp_path / "run"), "--json", str(out), "--fail-on", "1.0"], spark) == 1
    assert json.loads(out.read_text())["n_events"] == len(report.events)
    assert main(["report", str(tmp_path / "run"), "--min-severity", "1e9", "--fail-on", "1.0"], spark) == 0
    assert "no anomalies" in capsys.readouterr().out
    assert main(["rank", str(tmp_path / "run"), "--table", "t", "--html", str(web), "--json", str(out)], spark) == 0
    assert "directions hold 95 %" in capsys.readouterr().out and json.loads(out.read_text())["tables"][0]["dim"] == 4
    assert "http" not in web.read_text() and "still moving" in web.read_text() or "stable since" in web.read_text()
    assert main(["diff", str(tmp_path / "run"), "--table", "t"], spark) == 0
    shown = capsys.readouterr().out
    assert "r 6 to 7 (step 700) t: 40 to 40 ids, 40 stayed" in shown and "effective_rank" in shown and "frozen" in shown
    write_rows(rows.where("ckpt = 0"), str(tmp_path / "one"))
    assert main(["report", str(tmp_path / "one")], spark) == 2
    with pytest.raises(ValueError, match="no registered format"):
        main(["report", str(tmp_path / "nothing")], spark)


def told_events(watcher):
    return {(e["tbl"], e["metric"], e["idx"], e["method"]): round(e["severity"], 6) for e in watcher.report("planted").events}


def test_watcher_takes_whole_checkpoints(spark, tmp_path):
    """Two tables, several files a checkpoint, partition folders or plain files: the batch report's events."""
    rows = planted_run(spark, 6, 4)
    rows = rows.unionByName(rows.withColumn("tbl", F.lit("u")).withColumn("id", F.col("id") + 100)).unionByName(
        spark.createDataFrame([("r", "dense:head", k, 100 * k, i, i, None, [1.0 + i, 2.0 + k]) for k in range(6) for i in range(3)], SCHEMA)
    )
    bars = {"robust_z": 5.0}
    want = build_report(rows, "planted", thresholds=bars, min_severity=1.0)
    expected = {(e["tbl"], e["metric"], e["idx"], e["method"]): round(e["severity"], 6) for e in want.events}
    assert {t for t, *_ in expected} >= {"t", "u"}
    folders, told = str(tmp_path / "folders"), []
    tell = lambda df: told.extend((r.tbl, r.metric, r.idx, r.method) for r in df.collect())
    watcher = Watcher(spark, folders, str(tmp_path / "state"), tell, bars, min_severity=1.0)
    for part in (rows.where("ckpt < 5"), rows.where("ckpt = 5")):
        write_rows(part.repartition(3), folders, "append")
        poll(watcher, str(tmp_path / "log"), 0.0, 1)
    assert told_events(watcher) == expected and set(expected) <= set(told) and len(told) == len(set(told))
    report = watcher.report("planted")
    assert (report.n_checkpoints, report.tables) == (6, ["dense:head", "t", "u"]) and report.to_dict()["incidents"] == want.to_dict()["incidents"]
    assert {e["why"] for e in report.events} == {e["why"] for e in want.events}

    plain = str(tmp_path / "plain")
    watcher = Watcher(spark, plain, str(tmp_path / "state2"), lambda df: None, bars, table="t", min_severity=1.0, with_geometry=False)
    assert watcher.report().events == []
    for k in range(6):
        for half in (0, 1):
            rows.where(F.col("ckpt") == k).where(F.col("id") % 2 == half).coalesce(1).write.mode("append").parquet(plain)
            if k == 5:
                # half a checkpoint is not taken up: neither mark nor later files are there
                poll(watcher, str(tmp_path / "log2"), 0.0, 1)
                assert watcher.report().n_checkpoints == k
    mark_complete(spark, plain, [5])
    assert complete_marks(spark, plain) == {5}
    poll(watcher, str(tmp_path / "log2"), 0.0, 1)
    assert told_events(watcher) == {k: v for k, v in expected.items() if k[0] == "t" and k[1] not in ("effective_rank", "anisotropy")}
    watcher.flush()
    assert watcher.report().n_checkpoints == 6


def test_watch_command(spark, tmp_path, capsys):
    write_rows(planted_run(spark, 6, 4), str(tmp_path / "in"))
    args = ["watch", str(tmp_path / "in"), "--state", str(tmp_path / "state"), "--interval", "0", "--max-polls", "2", "--json", str(tmp_path / "w.json")]
    assert main([*args, "--fail-on", "1.0"], spark) == 1 and "step 400 t." in capsys.readouterr().out
    assert json.loads((tmp_path / "w.json").read_text())["n_checkpoints"] == 6
    assert main(args, spark) == 0 and "step" not in capsys.readouterr().out


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
