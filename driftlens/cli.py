"""Command line over a folder of checkpoints of any registered format.

    python -m driftlens.cli report RUN [--json FILE] [--md FILE] [--html FILE] [--table T] [--min-severity X] [--fail-on X]
    python -m driftlens.cli rank RUN [--json FILE] [--html FILE] [--table T]
    python -m driftlens.cli diff RUN [--table T]
    python -m driftlens.cli watch RUN --state DIR [--interval S] [--max-polls N] [--flush] [--json FILE] [--html FILE] ...
    python -m driftlens.cli calibrate FILE [--runs N] [--trials N] [--clean RUN]
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="driftlens")
    commands = top.add_subparsers(dest="command", required=True)
    made = {name: commands.add_parser(name) for name in ("report", "rank", "diff", "watch", "calibrate")}
    for name in ("report", "rank", "diff", "watch"):
        made[name].add_argument("run")
        made[name].add_argument("--table")
    for name, files in (("report", ("json", "md", "html")), ("rank", ("json", "html")), ("watch", ("json", "md", "html"))):
        for kind in files:
            made[name].add_argument(f"--{kind}")
    for name in ("report", "watch"):
        made[name].add_argument("--min-severity", type=float, default=1.0)
        made[name].add_argument("--fail-on", type=float)
        made[name].add_argument("--calibration")
    made["watch"].add_argument("--state", required=True)
    made["watch"].add_argument("--interval", type=float, default=60.0)
    made["watch"].add_argument("--max-polls", type=int, default=0)
    made["watch"].add_argument("--flush", action="store_true", help="take the newest checkpoint as complete at the end")
    made["calibrate"].add_argument("file")
    made["calibrate"].add_argument("--runs", type=int, default=24)
    made["calibrate"].add_argument("--trials", type=int, default=50)
    made["calibrate"].add_argument("--clean", help="rows of clean runs, instead of synthetic ones")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0; 1 where an event reaches --fail-on; 2 with too few checkpoints."""
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    return {"report": _report, "rank": _rank, "diff": _diff, "watch": _watch, "calibrate": _calibrate}[a.command](spark, a)


def _write(report, a: argparse.Namespace) -> None:
    for target, text in ((a.json, report.to_json), (a.md, report.to_markdown), (a.html, report.to_html)):
        if target:
            Path(target).write_text(text())


def _rows(spark: SparkSession, a: argparse.Namespace, least: int):
    from driftlens.sources.checkpoints import read_checkpoints

    rows = read_checkpoints(spark, a.run, table=a.table)
    if rows.select("ckpt").distinct().count() < least:
        print("too few checkpoints", file=sys.stderr)
        return None
    return rows


def _thresholds(a: argparse.Namespace) -> dict[str, float]:
    from driftlens.operators.detect import THRESHOLDS, read_thresholds

    return read_thresholds(a.calibration) if a.calibration else THRESHOLDS


def _report(spark: SparkSession, a: argparse.Namespace) -> int:
    from driftlens.report import build_report

    rows = _rows(spark, a, 2)
    if rows is None:
        return 2
    made = build_report(rows, Path(a.run).name, None, a.min_severity, _thresholds(a))
    print(made.to_text(), end="")
    _write(made, a)
    return int(a.fail_on is not None and made.worst() >= a.fail_on)


def _rank(spark: SparkSession, a: argparse.Namespace) -> int:
    from driftlens.operators.geometry import TABLE, spectra, spectral_report
    from driftlens.operators.series import DENSE
    from driftlens.report import rank_html, rank_payload, rank_text

    rows = _rows(spark, a, 1)
    if rows is None:
        return 2
    rows = rows.where(~F.col("tbl").startswith(DENSE))
    found = spectral_report(spectra(rows), rows.groupBy(*TABLE).agg(F.max("step").alias("step")))
    payload = rank_payload(Path(a.run).name, found)
    print(rank_text(payload), end="")
    if a.json:
        Path(a.json).write_text(json.dumps(payload, indent=2))
    if a.html:
        Path(a.html).write_text(rank_html(payload))
    return 0


def _diff(spark: SparkSession, a: argparse.Namespace) -> int:
    from driftlens.operators.series import DENSE
    from driftlens.report import step_diff

    rows = _rows(spark, a, 2)
    if rows is None:
        return 2
    print(step_diff(rows.where(~F.col("tbl").startswith(DENSE))), end="")
    return 0


def _watch(spark: SparkSession, a: argparse.Namespace) -> int:
    from driftlens.streaming.watch import Watcher, poll

    seen: list[float] = []

    def show(events) -> None:
        for e in events.orderBy(F.desc("severity")).collect():
            seen.append(e.severity)
            print(f"step {e.step} {e.tbl}.{e.metric} {e.severity:.1f}x [{e.method}]", flush=True)

    failed = lambda: a.fail_on is not None and max(seen, default=0.0) >= a.fail_on
    watcher = Watcher(spark, a.run, f"{a.state}/state", show, _thresholds(a), a.table, a.min_severity)
    poll(watcher, f"{a.state}/stream", a.interval, a.max_polls, failed)
    if a.flush and not failed():
        watcher.flush()
    if a.json or a.md or a.html:
        _write(watcher.report(Path(a.run).name), a)
    return int(failed())


def _calibrate(spark: SparkSession, a: argparse.Namespace) -> int:
    from driftlens.operators.calibrate import battery, calibration_text, derive_parameters, run_calibration, synthetic_trajectories
    from driftlens.sources.trajectories import read_rows

    clean = read_rows(spark, a.clean) if a.clean else synthetic_trajectories(spark, a.runs)
    found = run_calibration(clean, battery(), a.trials)
    print(calibration_text(found), end="")
    Path(a.file).write_text(json.dumps(derive_parameters(found, "rows of " + a.clean if a.clean else f"{a.runs} synthetic runs"), indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
