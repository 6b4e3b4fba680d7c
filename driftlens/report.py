"""Reports over detected events: text, JSON, Markdown and self-contained HTML pages; and those over ranks.

What a report says is worked out in DataFrames: the order of events, the incidents they belong to, and the reason of each
from its pair's churn, attribution and movers. Only those rows and the series reach the driver; both are as few as
checkpoints, tables and metrics are. Attribution runs for flagged pairs alone.
"""

from __future__ import annotations

import html
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.stage import settle
from driftlens.operators.attribution import attribution
from driftlens.operators.detect import THRESHOLDS, detect_trajectory
from driftlens.operators.incidents import assign_incidents, incidents
from driftlens.operators.movement import top_k
from driftlens.operators.pairs import PAIR, churn_counts, id_pairs
from driftlens.operators.series import CHURN, DENSE, GEOMETRY, run_series

MOVERS = 10
CHURN_COUNTS = ("inserted", "evicted", "readmitted", "slot_moved")
#: Keys of an attribution in a report, and the columns that fill them.
CAUSE = {
    "global": "frac_global", "translation": "frac_translation", "rotation": "frac_rotation", "aligned_residual": "frac_aligned",
    "rotation_magnitude": "rotation_magnitude", "mean_shift_norm": "mean_shift_norm", "popularity_r2": "popularity_r2", "n": "n",
}


def pair_context(rows: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """run, tbl, pair, churn, cause, movers (MOVERS ids at most): what explains an event of that pair.

    flagged (run, tbl, pair) restricts it: their checkpoints' rows are picked before any vector is joined.
    """
    own = rows.where(~F.col("tbl").startswith(DENSE))
    if flagged is not None:
        both = flagged.select("run", "tbl", F.explode(F.array("pair", F.col("pair") + 1)).alias("ckpt")).distinct()
        own = settle(own.join(both, ["run", "tbl", "ckpt"], "left_semi"))
    pairs = id_pairs(own)
    if flagged is not None:
        pairs = pairs.join(flagged.select(*PAIR).distinct(), PAIR, "left_semi")
    summary, scores = attribution(pairs)
    churn = churn_counts(own).select(*PAIR, F.struct(*[F.col(f"n_{c}").alias(c) for c in CHURN_COUNTS]).alias("churn"))
    cause = summary.select(*PAIR, F.struct(*[F.col(c).alias(k) for k, c in CAUSE.items()]).alias("cause"))
    ranked = top_k(scores, "idiosyncratic", MOVERS).groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("_m"))
    return churn.join(cause, PAIR, "left").join(ranked.select(*PAIR, F.col("_m.id").alias("movers")), PAIR, "left")


def _percent(c: Column) -> Column:
    return F.concat(F.round(100 * F.coalesce(c, F.lit(0.0))).cast("int").cast("string"), F.lit(" %"))


def explained(events: DataFrame, context: DataFrame) -> DataFrame:
    """events with kind, why and the context's columns; a table without context is a dense tensor."""
    known = events.join(context.withColumnRenamed("pair", "idx"), ["run", "tbl", "idx"], "left")
    kind = F.when(F.col("churn").isNull(), "dense").when(F.col("metric").isin(*CHURN), "churn").when(F.col("metric").isin(*GEOMETRY), "geometry").otherwise("drift")
    against = F.format_string("%.3g against %.3g", "value", "baseline")
    movers = F.coalesce("movers", F.array().cast("array<bigint>"))
    words = {
        "dense": F.concat(F.lit("tensor "), "direction", F.lit(", "), against),
        "churn": F.concat_ws(", ", *[F.concat(F.col(f"churn.{c}").cast("string"), F.lit(f" {c.replace('_', '-')}")) for c in CHURN_COUNTS], against),
        "geometry": F.concat(against, F.lit("; shift and rotation explain "), _percent(F.col("cause.global"))),
        "drift": F.concat(
            _percent(F.col("cause.aligned_residual")), F.lit(" of the movement is of single ids ("), F.array_join(F.slice(movers, 1, 5).cast("array<string>"), ", "),
            F.format_string("), popularity r2 %.2f", F.coalesce("cause.popularity_r2", F.lit(0.0))),
        ),
    }
    return known.withColumns({"kind": kind, "movers": movers}).withColumn("why", F.coalesce(*[F.when(F.col("kind") == k, text) for k, text in words.items()]))


def listed(events: DataFrame, gap: int = 1) -> DataFrame:
    """events with incident and place: their number from the most severe on."""
    order = Window.orderBy(F.desc("severity"), "idx", "tbl", "metric", "method")
    return assign_incidents(events, gap).withColumn("place", F.row_number().over(order) - 1)


def incident_rows(found: DataFrame, gap: int = 1) -> DataFrame:
    """The incidents of listed events, the worst first, with the places of their events."""
    places = found.groupBy("run", "incident").agg(F.array_sort(F.collect_list("place")).alias("places"))
    return incidents(found.drop("incident", "place"), gap).join(places, ["run", "incident"]).orderBy(F.desc("severity"), "incident")


@dataclass
class Report:
    """Collected events (listed and explained), incidents and series of one run."""

    run: str
    n_checkpoints: int
    tables: list[str]
    calibrated: bool
    min_severity: float
    events: list[dict]
    incidents: list[dict]
    series: list[dict]

    def worst(self) -> float:
        return self.events[0]["severity"] if self.events else 0.0

    def to_dict(self) -> dict:
        of_kind = {"churn": lambda e: {"churn": e["churn"]}, "geometry": lambda e: e["cause"] or {}, "drift": lambda e: {**(e["cause"] or {}), "top_movers": e["movers"]}, "dense": lambda e: {}}
        rounded = {"severity": ("severity", 3), "raw_score": ("score", 3), "value": ("value", 5), "baseline": ("baseline", 5)}
        named = {"step": "step", "index": "idx", "table": "tbl", "metric": "metric", "method": "method", "direction": "direction"}
        shown = [
            {k: e[c] for k, c in named.items()} | {k: round(e[c], d) for k, (c, d) in rounded.items()} | {"why": {"kind": e["kind"], "text": e["why"], **of_kind[e["kind"]](e)}}
            for e in self.events
        ]
        told = [{"steps": i["steps"], "tables": i["tables"], "severity": round(i["severity"], 3), "n_events": i["n_events"], "events": i["places"]} for i in self.incidents]
        return {
            "run": self.run, "n_checkpoints": self.n_checkpoints, "tables": self.tables, "calibration": "calibrated" if self.calibrated else "uncalibrated", "target_fpr": 0.05 if self.calibrated else None,
            "min_severity": self.min_severity, "n_events": len(shown), "n_incidents": len(told), "worst_severity": round(self.worst(), 3),
            "events": shown, "incidents": told, "series": self.series,
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2)

    def _members(self, incident: dict, most: int | None = None) -> list[dict]:
        return [self.events[k] for k in incident["places"][:most]]

    def to_text(self) -> str:
        out = [f"{self.run}: {self.n_checkpoints} checkpoints of {', '.join(self.tables)}"]
        if not self.events:
            return f"{out[0]}\nno anomalies\n"
        out.append(f"{len(self.incidents)} incidents, {len(self.events)} signals, worst {self.worst():.1f}x")
        for number, i in enumerate(self.incidents, 1):
            out.append(f"{number}. {' to '.join(map(str, sorted({i['steps'][0], i['steps'][-1]}))) if i['steps'] else '-'}: {i['severity']:.1f}x over {', '.join(i['tables'])}")
            out += [f"     {e['severity']:6.1f}x {e['tbl']}.{e['metric']} ({e['method']}) {e['why']}" for e in self._members(i, 4)]
            if i["n_events"] > 4:
                out.append(f"     ... {i['n_events'] - 4} more")
        return "\n".join(out) + "\n"

    def to_markdown(self) -> str:
        head = f"# Drift report: {self.run}\n\n"
        if not self.events:
            return head + "No anomalies.\n"
        columns = {"step": "step", "table": "tbl", "metric": "metric", "method": "method", "why": "why"}
        line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |"
        parts = []
        for i in self.incidents:
            body = [line([*(e[c] for c in columns.values()), f"{e['severity']:.1f}"]) for e in self._members(i)]
            parts.append("\n".join([f"## {i['severity']:.1f}x, {i['n_events']} signals", "", line([*columns, "severity"]), "|-" * (len(columns) + 1) + "|", *body]))
        return head + "\n\n".join(parts) + "\n"

    def to_html(self, poll_ms: int = 0) -> str:
        return page(f"Drift report: {self.run}", self.to_dict(), _REPORT, poll_ms)


_LINE = """
const root = document.getElementById('root');
const safe = s => String(s).replace(/[&<>"]/g, c => `&#${c.charCodeAt(0)};`);
function line(values) {
  const own = values.filter(v => v !== null); if (!own.length) return '';
  const lo = Math.min(...own), hi = Math.max(...own), w = 240, h = 40;
  const at = values.map((v, i) => v === null ? null : [i * w / Math.max(1, values.length - 1), h - (v - lo) / ((hi - lo) || 1) * h]).filter(Boolean);
  return `<svg width="${w}" height="${h + 4}"><polyline fill="none" stroke="currentColor" points="${at.map(p => p.join(',')).join(' ')}"/></svg>`;
}
const figure = (name, values) => `<figure><figcaption>${safe(name)}</figcaption>${line(values)}</figure>`;
"""
_REPORT = """
function draw(d) {
  root.innerHTML = (d.incidents || []).map(i => `<section class="${i.severity >= 5 ? 'high' : i.severity >= 2 ? 'mid' : 'low'}"><h2>${i.severity}x, steps ${i.steps.join(', ')}</h2>` +
    i.events.map(k => d.events[k]).map(e => `<p><b>${safe(e.table)}.${safe(e.metric)}</b> ${e.severity}x [${safe(e.method)}] ${safe(e.why.text)}</p>`).join('') + '</section>').join('') +
    (d.series || []).map(s => figure(`${s.table} ${s.metric}`, s.values)).join('');
}
"""
_RANK = """
function draw(d) {
  root.innerHTML = d.tables.map(t => `<section class="low"><h2>${safe(t.table)}: ${t.rank95[t.rank95.length - 1]} of ${t.dim} directions hold 95 %</h2><p>${safe(t.advice)}</p>` +
    figure('energy held by leading directions', t.energy) + ['rank90', 'rank95', 'rank99', 'effective_rank'].map(k => figure(`${k} by checkpoint`, t[k])).join('') + '</section>').join('');
}
"""


def page(title: str, data: dict, draw: str, poll_ms: int = 0) -> str:
    """One HTML file with its data and script inside."""
    text = json.dumps(data).replace("</", "<\\/")
    style = "body{font:14px sans-serif;margin:2em}.high{border-left:6px solid #b00}.mid{border-left:6px solid #d80}.low{border-left:6px solid #888}section{padding-left:1em}figure{display:inline-block}"
    start = "draw(JSON.parse(document.getElementById('data').textContent));"
    poll = f"setInterval(async () => {{ try {{ draw(await (await fetch('data.json')).json()); }} catch (e) {{}} }}, {int(poll_ms)});" if poll_ms > 0 else ""
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1><div id="root"></div><script type="application/json" id="data">{text}</script><script>{_LINE}{draw}{start}{poll}</script></body></html>'


def series_payload(series: DataFrame) -> list[dict]:
    rows = series.groupBy("tbl", "metric").agg(F.array_sort(F.collect_list(F.struct("idx", "step", "value"))).alias("x")).orderBy("tbl", "metric").collect()
    clean = lambda v: round(v, 6) if v is not None and math.isfinite(v) else None
    return [{"table": r.tbl, "metric": r.metric, "steps": [p.step for p in r.x], "values": [clean(p.value) for p in r.x]} for r in rows]


def collected(run: str, n_checkpoints: int, tables: list[str], series: DataFrame, events: DataFrame, context: DataFrame, calibrated: bool, min_severity: float) -> Report:
    """The report of events and their context (pair_context), whatever they come from."""
    found = settle(listed(explained(events, context)))
    rows = [r.asDict(recursive=True) for r in found.orderBy("place").collect()]
    return Report(run, n_checkpoints, tables, calibrated, min_severity, rows, [r.asDict(recursive=True) for r in incident_rows(found).collect()] if rows else [], series_payload(series))


def build_report(rows: DataFrame, run: str = "trajectory", table: str | None = None, min_severity: float = 1.0, thresholds: dict[str, float] | None = THRESHOLDS, with_geometry: bool = True) -> Report:
    """The whole pipeline over one run's rows; a table filter is applied before any work."""
    rows = rows if table is None else rows.where(F.col("tbl") == table)
    found = rows.agg(F.count_distinct("ckpt").alias("n"), F.array_sort(F.collect_set("tbl")).alias("tables")).first()
    if found.n < 2:
        raise ValueError("a report needs two checkpoints")
    series = settle(run_series(rows, with_geometry))
    events = settle(detect_trajectory(series, thresholds).where(F.col("severity") >= min_severity))
    context = pair_context(rows, events.select("run", "tbl", F.col("idx").alias("pair")).distinct())
    return collected(run, found.n, found.tables, series, events, context, thresholds is not None, min_severity)


def rank_payload(run: str, report: DataFrame) -> dict:
    """A spectral report as plain data, with advice on embedding width."""
    tables = []
    for r in report.orderBy("tbl").collect():
        dim, now = len(r.energy), r.rank95[-1]
        settled = f"stable since step {r.stable_since}" if r.stable_since is not None else "still moving"
        advice = f"{settled}; a width of {now} would keep 95 %" if now <= dim // 2 else f"{settled}; no narrower width advised"
        tables.append({"table": r.tbl, "dim": dim, "steps": r.steps, "rank90": r.rank90, "rank95": r.rank95, "rank99": r.rank99, "effective_rank": [round(x, 4) for x in r.effective_rank], "energy": [round(x, 6) for x in r.energy], "stable_since": r.stable_since, "advice": advice})
    return {"run": run, "tables": tables}


def rank_text(payload: dict) -> str:
    lines = []
    for t in payload["tables"]:
        marks = ", ".join(f"{2**k}: {t['energy'][2**k - 1]:.0%}" for k in range(t["dim"].bit_length()) if 2**k <= t["dim"])
        lines += [f"{t['table']}: {t['rank95'][-1]} of {t['dim']} directions hold 95 %; effective rank {t['effective_rank'][-1]:.1f}; energy {marks}", f"    {t['advice']}"]
    return "\n".join(lines) + "\n"


def rank_html(payload: dict) -> str:
    return page(f"Ranks: {payload['run']}", payload, _RANK)


def step_diff(rows: DataFrame, k: int = 5) -> str:
    """A printout of every step: churn, geometry before and after, movement, top movers and frozen ids."""
    from driftlens.operators.geometry import geometry, spectra
    from driftlens.operators.movement import freq_residual, frozen_score, mean_row_norm, movement, movement_summary

    moves = settle(frozen_score(freq_residual(settle(movement(id_pairs(rows))))))
    shape = geometry(spectra(rows)).select("run", "tbl", "ckpt", "effective_rank", "anisotropy").join(mean_row_norm(rows).withColumn("ckpt", F.col("pair") + 1).drop("pair"), ["run", "tbl", "ckpt"])
    sides = shape.select("run", "tbl", F.col("ckpt").alias("pair"), F.struct("effective_rank", "anisotropy", "mean_row_norm").alias("before")).join(
        shape.select("run", "tbl", (F.col("ckpt") - 1).alias("pair"), F.struct("effective_rank", "anisotropy", "mean_row_norm").alias("after")), PAIR
    )
    tops = [
        top_k(moves, by, k).groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("place", "id", F.col(by).alias("score"), "dn", "dcount"))).alias(by))
        for by in ("freq_residual", "frozen")
    ]
    every = churn_counts(rows).join(sides, PAIR, "left").join(movement_summary(moves), PAIR, "left").join(tops[0], PAIR, "left").join(tops[1], PAIR, "left")
    lines = []
    for r in every.orderBy("run", "pair", "tbl").collect():
        lines.append(f"{r.run} {r.pair} to {r.pair + 1} (step {r.step}) {r.tbl}: {r.n_prev} to {r.n_cur} ids, {r.n_survivors} stayed, {r.n_inserted} came, {r.n_evicted} went, {r.n_slot_moved} moved slot, {r.n_readmitted} readmitted")
        if r.before:
            lines.append("    " + ", ".join(f"{c} {r.before[c]:.4g} to {r.after[c]:.4g}" for c in ("effective_rank", "anisotropy", "mean_row_norm")))
        if r.delta_p50 is not None:
            lines.append(f"    movement: median {r.delta_p50:.5g}, greatest {r.delta_max:.5g}")
        for name in ("freq_residual", "frozen"):
            lines += [f"    {name} {m.score:+.2f}: id {m.id}, moved {m.dn:.5g}, trained {m.dcount}" for m in r[name] or []]
    return "\n".join(lines) + "\n"
