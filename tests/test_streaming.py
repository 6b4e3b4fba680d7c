import glob
import json

import numpy as np
import pytest

from driftlens.operators.detect import THRESHOLDS, detect_trajectory
from driftlens.sources.trajectories import write_rows
from driftlens.streaming.detector import events_of
from driftlens.streaming.snapshots import Snapshots
from driftlens.streaming.watch import Watcher
from test_engine import planted_run


@pytest.mark.parametrize("thresholds", [None, {"robust_z": 3.0, "page_hinkley": 2.0, "pelt": 1.5}, THRESHOLDS])
def test_series_events_equal_the_dataframes(spark, thresholds):
    rng = np.random.default_rng(7)
    rows, want = [], set()
    for k in range(40):
        n = int(rng.integers(1, 45))
        value = rng.normal(size=n) * rng.choice([0.0, 1e-15, 1.0, 1e6]) + rng.choice([0.0, 5.0])
        if n > 12:
            value[int(rng.integers(n))] += 30
            value[n // 2 :] += rng.choice([0.0, 4.0])
        value[rng.random(n) < 0.15] = rng.choice([np.nan, np.inf])
        rows += [("r", "t", f"m{k}", i, 10 * i if i % 3 else None, None if np.isnan(v) and i % 2 else float(v)) for i, v in enumerate(value)]
        want |= {(f"m{k}", e[0], e[3], round(e[1], 6), round(e[2], 6), round(e[4], 6)) for e in events_of(value, thresholds)}
    series = spark.createDataFrame(rows, "run string, tbl string, metric string, idx int, step long, value double")
    got = {(r.metric, r.idx, r.method, round(r.baseline, 6), round(r.score, 6), round(r.severity, 6)) for r in detect_trajectory(series, thresholds).collect()}
    assert got == want and {m for _, _, m, *_ in want} == set(THRESHOLDS)


class Died(Exception):
    pass


def test_a_watcher_that_dies_at_every_step(spark, tmp_path, monkeypatch):
    """Each write, rename and telling fails once before it is done, and the last two once after: the same state in the end."""
    rows = planted_run(spark, 6, 4)
    folder = str(tmp_path / "rows")
    write_rows(rows, folder)
    files = lambda numbers: [f"file:{p}" for k in numbers for p in glob.glob(f"{folder}/run=*/tbl=*/ckpt={k}/*.parquet")]
    bars, options = {"robust_z": 5.0, "page_hinkley": 1.0}, {"with_geometry": False}

    calm = Watcher(spark, folder, str(tmp_path / "calm"), lambda df: None, bars, **options)
    calm.add_files(files(range(6)), 0)

    told, died = [], set()
    watcher = lambda: Watcher(spark, folder, str(tmp_path / "state"), tell, bars, **options)

    def deadly(name, action, after):
        def run(*args, **kw):
            state = watcher().kept.manifest()
            key = (name, *([args[2].split("/")[0]] if len(args) > 2 else []), len(state["done"]), state.get("told"))
            for when in ("before", "after") if after else ("before",):
                if when == "after":
                    made = action(*args, **kw)
                if (*key, when) not in died:
                    died.add((*key, when))
                    raise Died
            return made if after else action(*args, **kw)

        return run

    tell = lambda df: told.extend((r.metric, r.idx, r.method) for r in df.collect())
    watcher().add_files(files(range(5)), 0)
    monkeypatch.setattr(Snapshots, "write", deadly("write", Snapshots.write, False))
    monkeypatch.setattr(Snapshots, "rename", deadly("rename", Snapshots.rename, True))
    tell = deadly("tell", tell, True)
    restarts = 0
    while True:
        try:
            watcher().add_files(files([5]), 1)
            break
        except Exception as e:  # noqa: BLE001  a stream wraps what its batch raised
            assert "Died" in repr(e) + str(e), e
            restarts += 1
            assert restarts < 50
    monkeypatch.undo()
    assert restarts >= 12
    got, want = (w.report("r").to_dict() for w in (watcher(), calm))
    for report in (got, want):
        report.pop("generated", None)
    assert json.dumps(got, sort_keys=True, default=str) == json.dumps(want, sort_keys=True, default=str) and want["events"]
    assert {(e["metric"], e["index"] if "index" in e else e["idx"], e["method"]) for e in watcher().report("r").events} <= set(told)


def test_manifests(spark, tmp_path):
    kept = Snapshots(spark, str(tmp_path / "s"))
    assert kept.manifest() == {"number": 0}
    one = kept.write(spark.range(3), "a")
    state = kept.commit({"number": 0, "a": one})
    for k in range(3):
        lost = kept.write(spark.range(k), "lost")
        state = kept.commit(state | {"a": kept.write(spark.range(4 + k), "a")})
        assert kept.read(state["a"]).count() == 4 + k and lost not in kept.names("data")
    assert kept.names("manifests") == [f"{n:012d}" for n in (3, 4)] and len(kept.names("data")) == 2 and kept.manifest() == state
    with pytest.raises(RuntimeError, match="is there already"):
        kept.commit(state | {"number": 3})
    assert kept.manifest() == state
