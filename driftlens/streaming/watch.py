"""Watching a growing run: each new checkpoint is compared with the last one, and events are told once.

A file stream tells which Parquet files are new, whatever checkpoint or table they belong to; ``foreachBatch`` notes them
by checkpoint. A checkpoint is taken up once it is complete: it bears a mark (``trajectories.mark_complete``, which
``write_rows`` sets), or a later one has begun, or ``flush`` is called. Its files are then read together, partition columns
included; its features, its pair's context and its rows become state. The features, one null for each series that has
none, are handed to a stateful stream (``detector``), which keeps the points of every series and gives out its events.

State is a set of folders named by a manifest (``snapshots``): notes of files, features and context by pair, the newest
checkpoint's rows, the current events. A step writes its folders and then commits, so a job that dies leaves the state
before or after the step; handing over is a rename, done by whoever comes next if it is missing. Events are told before it is
noted that they were: once, or again where a job died in between. A checkpoint that comes late, under a lower number than
one taken up, is compared with whatever came last. One watcher watches one run.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions.stage import settle
from driftlens.operators.detect import THRESHOLDS
from driftlens.operators.series import fill_gaps, run_series
from driftlens.report import Report, collected, pair_context
from driftlens.sources.trajectories import SCHEMA, complete_marks
from driftlens.streaming.detector import FOUND_SCHEMA, PROVIDER, ROCKS_DB, SERIES_SCHEMA, detected
from driftlens.streaming.snapshots import Snapshots

PARTITIONS = 4  # tasks of the detector: a run has as many series as tables have metrics, and they are short


class Watcher:
    """State under one folder; ``on_events`` gets a DataFrame of events not told before."""

    def __init__(self, spark: SparkSession, path: str, state: str, on_events: Callable[[DataFrame], None], thresholds: dict[str, float] | None = THRESHOLDS, table: str | None = None, min_severity: float = 0.0, with_geometry: bool = True, **settings):
        self.spark, self.path, self.on_events = spark, path.rstrip("/"), on_events
        self.thresholds, self.table, self.min_severity, self.with_geometry, self.settings = thresholds, table, min_severity, with_geometry, settings
        self.kept = Snapshots(spark, state)

    def _state(self) -> dict:
        """The last manifest. files: a folder and its checkpoints by batch; pairs: checkpoint, features and context by place."""
        return {"files": {}, "newest": -1, "done": [], "pairs": [], "last": None, "events": None, "told": -1, "seen": 0} | self.kept.manifest()

    def _rows(self, files: list[str]) -> DataFrame:
        """Rows of some files of the run, with the columns that lie in their folders' names."""
        rows = self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(*files)
        return rows if self.table is None else rows.where(F.col("tbl") == self.table)

    def add_files(self, files: list[str], batch: int) -> None:
        """Note new files by the checkpoints that they hold, then take up what is complete."""
        if files:
            # the path is told as a URI, and read as a plain one
            plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
            folder = self.kept.write(self._rows(files).select("ckpt", plain.alias("path")).distinct(), "files")
            numbers = sorted(r.ckpt for r in self.kept.read(folder).select("ckpt").distinct().collect())
            state = self._state()
            files_ = state["files"] | {str(batch): [folder, numbers]}
            self.kept.commit(state | {"files": files_, "newest": max([state["newest"], *numbers])})
        self.advance()

    def advance(self, all_complete: bool = False) -> None:
        state = self._state()
        noted = [folder for folder, numbers in state["files"].values() if not set(numbers) <= set(state["done"])]
        if noted:
            by_number: dict[int, list[str]] = {}
            for r in self.kept.read(*noted).distinct().collect():  # files of checkpoints not taken up yet
                if r.ckpt not in state["done"]:
                    by_number.setdefault(r.ckpt, []).append(r.path)
            marks = complete_marks(self.spark, self.path)
            for number in sorted(by_number):
                if all_complete or number in marks or number < state["newest"]:
                    self._step(self._rows(sorted(by_number[number])).where(F.col("ckpt") == number), number)
        self._hand_over()
        self._detect()

    def flush(self) -> None:
        """Take the newest checkpoint as complete: the run has ended."""
        self.advance(all_complete=True)

    def _step(self, rows: DataFrame, number: int) -> None:
        """Take up one checkpoint: all of its state, or none."""
        state = self._state()
        last = self.kept.write(rows, "last")
        pairs, idx = state["pairs"], len(state["pairs"])
        if state["last"] is not None:
            # the two stand next to each other whatever their numbers are
            both = settle(self.kept.read(state["last"]).withColumn("ckpt", F.lit(idx)).unionByName(self.kept.read(last).withColumn("ckpt", F.lit(idx + 1))))
            features = self.kept.write(run_series(both, self.with_geometry).where(F.col("idx") == idx), "features")
            context = self.kept.write(pair_context(both).where(F.col("pair") == idx), "context")
            pairs = [*pairs, [number, features, context]]
        done = [*state["done"], number]
        files = {b: f for b, f in state["files"].items() if not set(f[1]) <= set(done)}
        self.kept.commit(state | {"last": last, "pairs": pairs, "done": done, "files": files})

    def _series(self, state: dict) -> DataFrame | None:
        features = [f for _, f, _ in state["pairs"]]
        return settle(fill_gaps(self.kept.read(*features))) if features else None

    def _hand_over(self) -> None:
        """Points of pairs that the detector has not got: one for every series known by then."""
        state, given = self._state(), self.kept.names("feed")
        for idx in range(len(given), len(state["pairs"])):
            known = self.kept.read(*[f for _, f, _ in state["pairs"][: idx + 1]]).select("run", "tbl", "metric").distinct()
            own = self.kept.read(state["pairs"][idx][1])
            steps = own.groupBy("run").agg(F.max("step").alias("_step"))
            points = known.join(steps, "run").join(own, ["run", "tbl", "metric"], "left").select("run", "tbl", "metric", F.lit(idx).alias("idx"), F.coalesce("step", "_step").alias("step"), "value")
            draft = self.kept.write(points, "points")
            self.kept.rename(f"data/{draft}", f"feed/{idx:012d}")

    def _detect(self) -> None:
        """Let the stateful stream take what has been handed over; it stops when it has seen all."""
        given = len(self.kept.names("feed"))
        if given == self._state()["seen"]:
            return
        conf = self.spark.conf
        own = {PROVIDER: ROCKS_DB, "spark.sql.shuffle.partitions": str(PARTITIONS)}
        before = {k: conf.get(k, None) for k in own}
        for k, v in own.items():
            conf.set(k, v)
        try:
            points = self.spark.readStream.schema(SERIES_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{self.kept.path}/feed")
            found = detected(points, self.thresholds, self.min_severity, **self.settings)
            query = found.writeStream.foreachBatch(self._tell).option("checkpointLocation", f"{self.kept.path}/detector").trigger(availableNow=True).start()
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        query.awaitTermination()
        self.kept.commit(self._state() | {"seen": given})

    def _tell(self, found: DataFrame, batch: int) -> None:
        state = self._state()
        if batch <= state["told"]:
            return  # told by a job that died before the stream had noted it
        folder = self.kept.write(found, "events")
        fresh = self.kept.read(folder).where("fresh").drop("fresh")
        if not fresh.isEmpty():
            self.on_events(fresh)
        self.kept.commit(state | {"events": folder, "told": batch})

    def report(self, run: str = "trajectory") -> Report:
        """A full report of what has been taken up so far, from state alone."""
        state = self._state()
        last = None if state["last"] is None else self.kept.read(state["last"])
        tables = [] if last is None else sorted(r.tbl for r in last.select("tbl").distinct().collect())
        series = self._series(state)
        if series is None:
            return Report(run, len(state["done"]), tables, self.thresholds is not None, self.min_severity, [], [], [])
        events = self.spark.createDataFrame([], FOUND_SCHEMA) if state["events"] is None else self.kept.read(state["events"])
        return collected(run, len(state["done"]), tables, series, settle(events.drop("fresh")), self.kept.read(*[c for _, _, c in state["pairs"]]), self.thresholds is not None, self.min_severity)


def watch(watcher: Watcher, checkpoint: str, seconds: float | None = None):
    """Start the stream over the watcher's path: until all files are seen, or every so many seconds without end."""
    stream = watcher.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(watcher.path).select("path")

    def batch(df: DataFrame, number: int) -> None:
        watcher.add_files([r.path for r in df.collect()], number)  # names of new files, no content

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def poll(watcher: Watcher, checkpoint: str, seconds: float = 60.0, polls: int = 0, stop: Callable[[], bool] = lambda: False) -> None:
    """Look for new files every so many seconds, polls times (0: without end) or until stop says so."""
    done = 0
    while True:
        query = watch(watcher, checkpoint)
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
        watcher.advance()  # a mark may have come without a file
        done += 1
        if stop() or done == polls:
            return
        time.sleep(seconds)
