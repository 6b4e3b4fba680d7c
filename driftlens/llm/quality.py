"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics are taken over every whole text. The features cos(w x + b) approximate a Gaussian kernel; each partition
sums its normal equations and Spark adds them, so only a matrix of fixed size reaches the driver, however many rows
are labelled. Ridge weights come from the training folds 2 to 4, the isotonic map from fold 1 (folds: crc32 of the id
as text modulo 5; fold 0 is held out), from counts in SCORE_BINS bins over all its rows.

Null texts count as empty; with fewer than two label classes every score is the labels' mean (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import map_arrow, materialize, small_batches, table, utf8
from driftlens.llm.words import VISIBLE, Words, blocks

SEED, FOURIER, RIDGE, WIDTH, SCORE_BINS = 7, 256, 1e-3, 3.0, 2_000
STATISTICS = (
    "log_bytes", "log_words", "mean_word", "std_word", "upper", "digit", "symbol", "stop", "non_ascii", "adjacent_equal",
    "distinct", "bar_words", "shouted", "marked_words", "words_a_line", "top_share", "short_words", "stops_a_word",
)

_CLASS = np.zeros((256, 6), bool)
_CLASS[ord("A") : ord("Z") + 1, 0] = True
_CLASS[ord("0") : ord("9") + 1, 1] = True
_CLASS[[ord(c) for c in "#$%&*|@~^<>{}[]=+_\\/"], 2] = True
_CLASS[[ord(c) for c in ".,;:!?"], 3] = True
_CLASS[128:, 4] = True
_CLASS[[c for c in range(256) if chr(c).islower() and c < 128], 5] = True


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS a text."""
    w = Words(texts, VISIBLE)
    n, counts = w.n, w.counts()
    words, size = np.maximum(counts, 1), np.maximum(np.diff(w.offsets) - 1, 1)

    def per_doc(values) -> np.ndarray:
        return np.bincount(w.doc, weights=values, minlength=n) / words

    # the class mask as running sums, so that any span's count is one subtraction
    runs = {k: np.concatenate([[0], np.cumsum(_CLASS[w.bytes, k])]) for k in range(6)}
    share = {k: np.diff(r[w.offsets]) / size for k, r in runs.items()}
    length = (w.end - w.start).astype(float)
    mean = per_doc(length)
    h = w.hashes()
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    order = np.lexsort((h, w.doc))
    new = np.ones(len(h), bool)
    new[1:] = (np.diff(h[order].view(np.int64)) != 0) | (np.diff(w.doc[order]) != 0)
    group = np.flatnonzero(new)
    repeats = np.diff(np.append(group, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, w.doc[order][group], repeats)
    distinct = np.bincount(w.doc[order][group], minlength=n) / words
    upper, lower = (runs[k][w.end] - runs[k][w.start] for k in (0, 5))
    marks = runs[2][w.end] - runs[2][w.start]
    lines = np.diff(np.concatenate([[0], np.cumsum(w.bytes == 10)])[w.offsets])
    return np.stack([
        np.log1p(size), np.log1p(counts), mean, np.sqrt(np.maximum(per_doc(length**2) - mean**2, 0)), share[0], share[1], share[2], share[3], share[4],
        per_doc(same), distinct, per_doc((length == 1) & (marks == 1)), per_doc((upper > 1) & (lower == 0)), per_doc((marks > 0) & (length > 1)),
        np.log1p(counts / np.maximum(lines, 1)), top / words, per_doc(length <= 2), share[3] * size / words,
    ], 1)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text."""
    small_batches(docs.sparkSession)

    def run(batch):
        texts = list(utf8(batch.column(1)))
        rows = np.concatenate([statistics(texts[a:b]) for a, b in blocks(texts)])
        return {"doc_id": batch.column(0), "x": list(rows.astype(np.float32))}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, x array<float>")


class QualityModel:
    """Means and scales of the statistics, ridge weights, and the isotonic map as points to interpolate."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / WIDTH, (len(STATISTICS), FOURIER))
        self.b = rng.uniform(0, 2 * np.pi, FOURIER)
        self.beta = np.zeros(FOURIER + len(STATISTICS) + 1)
        self.points: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / FOURIER) * np.cos(z @ self.w + self.b), z, np.ones((len(z), 1))], 1)

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.ridge(x), *self.points), 0, 1)


def _matrix(batch) -> np.ndarray:
    return np.array(batch.column(batch.schema.get_field_index("x")).to_pylist(), float).reshape(-1, len(STATISTICS))


def normal_equations(rows: DataFrame, model: QualityModel) -> np.ndarray:
    """X'X with X'y as its last column: summed in each partition, then by row of the matrix in Spark."""
    import pyarrow as pa

    held = rows.sparkSession.sparkContext.broadcast(model)
    size = len(model.beta)

    def partial(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                f = held.value.features(_matrix(batch))
                y = np.array(batch.column(batch.schema.get_field_index("y")).to_pylist(), float)
                total += f.T @ np.concatenate([f, y[:, None]], 1)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(size), pa.int32()), "v": pa.array(list(total), pa.list_(pa.float64()))})

    def add(pdf):
        import pandas as pd

        return pd.DataFrame({"i": pdf["i"].iloc[:1], "v": [np.sum(np.stack(pdf["v"].to_list()), 0)]})

    summed = rows.select("x", "y").mapInArrow(partial, "i int, v array<double>").groupBy("i").applyInPandas(add, "i int, v array<double>")
    found = np.zeros((size, size + 1))
    for r in summed.collect():  # a fixed number of rows
        found[r.i] = r.v
    return found


def isotonic(at: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points sorted by at: block centres and their means, with one pseudo-row a block."""
    blocks_: list[list[float]] = []
    for a, w, t in zip(at, weight, total, strict=True):
        blocks_.append([a * w, w, t])
        while len(blocks_) > 1 and blocks_[-2][2] / blocks_[-2][1] >= blocks_[-1][2] / blocks_[-1][1]:
            last = blocks_.pop()
            blocks_[-1] = [p + q for p, q in zip(blocks_[-1], last, strict=True)]
    prior = sum(total) / sum(weight)
    means = np.maximum.accumulate([(t + prior) / (w + 1) for _, w, t in blocks_])
    return np.array([s / w for s, w, _ in blocks_]), means


def apply_model(stats: DataFrame, model: QualityModel | float, raw: bool = False) -> DataFrame:
    held = stats.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        m, x = held.value, _matrix(batch)
        value = np.full(len(x), m) if isinstance(m, float) else m.ridge(x) if raw else m.score(x)
        return {"doc_id": batch.column(0), "score": value}

    return map_arrow(stats.select("doc_id", "x"), run, "doc_id long, score double")


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> QualityModel | float:
    fold = F.crc32(F.col("_id").cast("string").cast("binary")) % 5
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).alias("y")).where("y is not null and _id is not null").groupBy("_id").agg((F.max("y") > 0).cast("int").alias("y")).withColumn("fold", fold).where("fold <> 0")
    rows = stats.join(known, stats.doc_id == known._id).select("doc_id", "x", "y", "fold")
    x = [F.col("x")[k].cast("double") for k in range(len(STATISTICS))]
    totals = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.array(*map(F.avg, x)).alias("mean"), F.array(*map(F.stddev_pop, x)).alias("sd")).first()
    if not totals.n or totals.y in (0.0, 1.0):
        return float(totals.y) if totals.n else 0.5
    model = QualityModel(np.array(totals.mean, float), np.maximum(np.array(totals.sd, float), 1e-6))
    sums = normal_equations(rows.where("fold <> 1"), model)
    if not sums[-1, -2]:
        sums = normal_equations(rows, model)
    gram, n = sums[:, :-1], sums[-1, -2]
    model.beta = np.linalg.solve(gram + RIDGE * n * np.eye(len(gram)), sums[:, -1])
    # scores of the calibration fold in bins; bounds of ridge scores are clipped to -1 .. 2
    scored = apply_model(rows.where("fold = 1"), model, raw=True).join(known.select(F.col("_id").alias("doc_id"), "y"), "doc_id")
    bins = scored.groupBy(F.floor((F.least(F.greatest("score", F.lit(-1.0)), F.lit(2.0)) + 1) / 3 * SCORE_BINS).alias("bin")).agg(F.count("*").alias("w"), F.sum("y").alias("t"), F.avg("score").alias("at")).orderBy("bin").collect()
    if bins:
        model.points = isotonic(*(np.array([r[c] for r in bins], float) for c in ("at", "w", "t")))
    else:
        model.points = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every whole text of documents; labels are learnt outside the held-out fold only."""
    stats = materialize(document_statistics(table(spark, sf_dir, "documents")), "quality-statistics")
    model = fit(stats, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return apply_model(stats, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
