"""Detection as a stateful stream: the points of every series are state, new ones come in, all its events go out.

All detectors judge by the scale of the whole series, so a new value may bring out or take back events of earlier ones. A
series has a point a checkpoint: its state is short, and each new point costs one pass over it, whatever the size of tables. Series
are spread over tasks by key. Events come with a flag: fresh where they weren't told before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from driftlens.functions.ranks import EPS
from driftlens.operators.detect import DEFAULTS, EVENT_SCHEMA, PERMISSIVE, SERIES, shifts

SERIES_SCHEMA = "run string, tbl string, metric string, idx int, step long, value double"
FOUND_SCHEMA = f"{EVENT_SCHEMA}, direction string, severity double, fresh boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scale_of(value: np.ndarray) -> tuple[float, float, bool]:
    """Median and scale of the finite values, and whether the deviation stands in for a vanished MAD."""
    good = value[np.isfinite(value)]
    if len(good) < 2:
        return (float(good[0]) if len(good) else 0.0), 0.0, False
    middle = float(np.median(good))
    spread = 1.4826 * float(np.median(np.abs(good - middle)))
    return (middle, spread, False) if spread >= EPS else (middle, float(good.std()), True)


def jumps(value: np.ndarray, scale: float, by_sd: bool, window: int, k: float, min_history: int) -> Iterator[tuple[int, float, float]]:
    """(place, baseline, score) of values far from the median of those before them."""
    for at in np.flatnonzero(np.isfinite(value)).tolist():
        before = value[max(0, at - window) : at]
        before = before[np.isfinite(before)]
        if at >= min_history and len(before):
            baseline = float(np.median(before))
            score = (value[at] - baseline) / scale
            score = round(score, 9) if by_sd else score
            if abs(score) >= k:
                yield at, baseline, float(score)


def drifts(x: np.ndarray, lam: float, delta: float, min_history: int) -> Iterator[tuple[int, float]]:
    """(place, score) of Page-Hinkley alarms over standardised values, up and down."""
    for sign in (1.0, -1.0):
        seen, mean, total, low = 0, 0.0, 0.0, 0.0
        for at in np.flatnonzero(np.isfinite(x)).tolist():
            seen += 1
            mean += (sign * x[at] - mean) / seen
            total += sign * x[at] - mean - delta
            low = min(low, total)
            if seen > min_history and total - low > lam:
                yield at, sign * (total - low)
                seen, mean, total, low = 0, 0.0, 0.0, 0.0


def events_of(value: np.ndarray, thresholds: dict[str, float] | None, **settings) -> list[tuple]:
    """(place, baseline, score, method, severity) of one series: what ``detect_trajectory`` finds in it."""
    c = DEFAULTS | (PERMISSIVE if thresholds is not None else {}) | settings
    middle, scale, by_sd = scale_of(value)
    if scale < EPS:
        return []
    x = (value - middle) / scale
    found = [(at, base, score, "robust_z") for at, base, score in jumps(value, scale, by_sd, c["window"], c["k"], c["min_history"])]
    found += [(at, middle, score, "page_hinkley") for at, score in drifts(x, c["ph_lam"], c["ph_delta"], c["min_history"])]
    found += [(at, middle + scale * level, score, "pelt") for at, level, score in shifts(x, c["pelt_pen"], c["pelt_min_size"])]
    if thresholds is None:
        return [(*e, abs(e[2])) for e in found]
    bar = {m: t for m, t in thresholds.items() if t > 0 and math.isfinite(t)}
    return [(*e, abs(e[2]) / bar[e[3]]) for e in found if e[3] in bar and abs(e[2]) >= bar[e[3]]]


class SeriesDetector(StatefulProcessor):
    """State of a series: its points in order of idx, and which events have been told."""

    def __init__(self, thresholds: dict[str, float] | None, min_severity: float = 0.0, **settings):
        self.thresholds, self.min_severity, self.settings = thresholds, min_severity, settings

    def init(self, handle) -> None:
        self.points = handle.getValueState("points", "idx array<int>, step array<long>, value array<double>")
        self.told = handle.getValueState("told", "idx array<int>, method array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {i: (s, v) for i, s, v in zip(*self.points.get(), strict=True)} if self.points.exists() else {}
        for pdf in rows:
            for r in pdf.itertuples():
                held[int(r.idx)] = (None if pd.isna(r.step) else int(r.step), None if pd.isna(r.value) else float(r.value))
        # a series that came later has no value before
        order = range(max(held) + 1)
        steps, values = zip(*(held.get(i, (None, None)) for i in order), strict=True)
        self.points.update((list(order), list(steps), list(values)))
        told = set(zip(*self.told.get(), strict=True)) if self.told.exists() else set()
        value = np.array([math.nan if v is None else v for v in values], float)
        found = [e for e in events_of(value, self.thresholds, **self.settings) if e[4] >= self.min_severity]
        fresh = [(e[0], e[3]) not in told for e in found]
        told |= {(e[0], e[3]) for e in found}
        if any(fresh):
            self.told.update(tuple(map(list, zip(*sorted(told), strict=True))))
        rows = [(*key, at, steps[at], values[at], base, score, method, "up" if score > 0 else "down", severity, new) for (at, base, score, method, severity), new in zip(found, fresh, strict=True)]
        names = [c.split()[0] for c in FOUND_SCHEMA.split(", ")]
        yield pd.DataFrame(rows, columns=names).astype({"idx": "int32", "step": "Int64"})

    def close(self) -> None:
        pass


def detected(series: DataFrame, thresholds: dict[str, float] | None, min_severity: float = 0.0, **settings) -> DataFrame:
    """Events of every series that gets a new point, for a stream of points (SERIES_SCHEMA); needs RocksDB as state store."""
    return series.groupBy(*SERIES).transformWithStateInPandas(SeriesDetector(thresholds, min_severity, **settings), FOUND_SCHEMA, "Append", "None")
