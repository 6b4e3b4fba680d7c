"""Mixing sources to target weights by balanced sampling with the cube method (Deville and Tillé).

Every document of a source has the same expected number of copies, target / source size (at most three): its whole
part is taken for sure, its fraction is an inclusion probability. The flight phase moves the probabilities along the
null space of two constraints, the source's words and its documents, until they are 0 or 1. It runs in blocks of about
BLOCK documents of one source, large documents first; the at most two documents that each block leaves undecided meet
in the next round, so the rows shrink by BLOCK / 2 a round whatever the corpus' size. The last block of a source lands:
its undecided two are rounded to the nearest word total.

Random numbers depend only on source, round and block, so reruns agree. Null texts have size 0 and are never taken; a
null source is a source of its own. Rows that repeat id, source and text cannot be told apart: they are counted first
and numbered, so that they are dealt over blocks like any others, however many there are.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import free_name, map_arrow, materialize, small_batches, table, utf8

BLOCK, MOST = 4_096, 3
NUMBERED = 10_000  # equal rows that one task numbers
FEW_SOURCES = 100_000  # sources up to which their totals are broadcast
WEIGHTS = (1, 2, 3)
_EPS = 1e-9


def row_key() -> list[Column]:
    """Two longs that identify a document by id, source and text."""
    own = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")]
    told = [x for c in own for x in (F.isnull(c), c)]
    return [F.xxhash64(*told).alias("h1"), F.xxhash64(F.lit(1), *told).alias("h2")]


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, h1, h2, size: white-space separated words of every whole text."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), *row_key(), F.col("text").cast("string"))
    kept = ("doc_id", "source", "h1", "h2")
    return map_arrow(own, lambda b: {**{c: b.column(k) for k, c in enumerate(kept)}, "size": [len(t.split()) for t in utf8(b.column(4))]}, "doc_id long, source string, h1 long, h2 long, size long")


def numbered(sizes: DataFrame) -> DataFrame:
    """The rows of sizes with k, a number among rows that are equal; they are counted, not gathered, to number them."""
    keys = ["doc_id", "source", "h1", "h2", "size"]
    counts = sizes.groupBy(*keys).agg(F.count("*").alias("n"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(NUMBERED).cast("long"))).alias("first")
    parts = counts.select(*keys, "n", part).repartition("h1", "h2", "first")
    return parts.select(*keys, F.explode(F.sequence("first", F.least(F.col("n"), F.col("first") + NUMBERED) - 1)).alias("k"))


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Words that each source gets: the sum of all sizes shared by weight, capped at most times a source's own size.

    Sources are ordered by code point, null last, and weigh as the repeating weights say; what a cap cuts off is shared
    again among the others by weight until no source is above its cap.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out: dict[str | None, float] = {}
    rest, total = float(sum(sizes.values())), sum(weight.values())
    # by cap per weight: once a source stays under its cap, all later ones do
    for s in sorted(order, key=lambda s: most * sizes[s] / weight[s]):
        out[s] = min(float(most * sizes[s]), rest * weight[s] / total) if total else 0.0
        rest -= out[s]
        total -= weight[s]
    return out


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: at most two stay strictly between 0 and 1; sums of p and of p * size hold."""
    p, s = p.astype(float).tolist(), size.astype(float).tolist()
    active: list[int] = []
    draws = iter(rng.random(2 * len(p) + 8).tolist())
    for i in range(len(p)):
        if _EPS < p[i] < 1 - _EPS:
            active.append(i)
        while len(active) == 3:
            a, b, c = active
            u = (s[c] - s[b], s[a] - s[c], s[b] - s[a])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(active, u, strict=True) if x)
            down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(active, u, strict=True) if x)
            step = up if next(draws) * (up + down) < down else -down
            for i_, x in zip(active, u, strict=True):
                p[i_] = min(1.0, max(0.0, p[i_] + step * x))
            left = [i_ for i_ in active if _EPS < p[i_] < 1 - _EPS]
            for i_ in active:
                if i_ not in left:
                    p[i_] = float(round(p[i_]))
            active = left
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The few undecided probabilities rounded so that words, then documents, come nearest to their expectation.

    Where a large document leaves a gap all the same, single decisions are turned over as long as one comes nearer.
    """
    open_ = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    words, count = sum(p[i] * size[i] for i in open_), sum(p[i] for i in open_)
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(size[i] for k, i in enumerate(open_) if m >> k & 1) - words), abs(m.bit_count() - count), m)) if open_ else 0
    out = np.round(p)
    for k, i in enumerate(open_):
        out[i] = best >> k & 1
    gap = float(((out - p) * size).sum())
    for _ in range(16):
        turned = np.abs(gap + np.where(out > 0, -1.0, 1.0) * size)
        turned[size == 0] = np.inf
        k = int(turned.argmin()) if len(turned) else -1
        if k < 0 or not open_ or turned[k] >= abs(gap) - _EPS:
            break
        gap += size[k] * (1 - 2 * out[k])
        out[k] = 1 - out[k]
    return out


def _small(rows: DataFrame, n: int) -> DataFrame:
    """A row a source, broadcast while they are few, so that a source with a third of all rows is no task's alone."""
    return F.broadcast(rows) if n <= FEW_SOURCES else rows


def _decide(round_: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        source, block, of = key
        pdf = pdf.sort_values(["size", "doc_id", "h1", "k"], ascending=[False, True, True, True], kind="stable")
        size = pdf["size"].to_numpy()
        p = flight(pdf["p"].to_numpy(), size, np.random.default_rng(zlib.crc32(f"{source!r}/{round_}/{block}".encode())))
        return pdf.drop(columns=["_block", "_blocks"]).assign(p=landing(p, size) if of == 1 else p)

    return run


def cube_sample(rows: DataFrame, counts: dict[str | None, int]) -> DataFrame:
    """rows (doc_id, source, h1, h2, size, k, p) with p decided to 0 or 1, in rounds of independent blocks.

    counts holds the documents of each source; only these totals are on the driver.
    """
    spark = rows.sparkSession
    kind = "doc_id long, source string, h1 long, h2 long, size long, k long, p double"
    names = [c.split()[0] for c in kind.split(", ")]
    done, round_ = None, 0
    while True:
        blocks = {s: max(1, math.ceil(n / BLOCK)) for s, n in counts.items()}
        many = _small(spark.createDataFrame([(s, b) for s, b in blocks.items()], "_s string, _blocks int"), len(blocks))

        placed = rows.join(many, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_block", F.pmod(F.xxhash64("h1", "k", F.lit(round_)), F.col("_blocks")))
        placed = placed.select(*names, "_block", "_blocks")
        moved = materialize(placed.groupBy("source", "_block", "_blocks").applyInPandas(_decide(round_), kind), f"cube-{round_}")
        undecided = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
        done = moved.where(~undecided) if done is None else done.unionByName(moved.where(~undecided))
        if max(blocks.values(), default=1) == 1:
            return done
        counts = {s: 2 * b if b > 1 else 0 for s, b in blocks.items()}
        rows, round_ = moved.where(undecided), round_ + 1


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, h1, h2 (row_key) for every document."""
    spark = docs.sparkSession
    sizes = materialize(document_sizes(docs), "sizes")
    found = sizes.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()  # a row a source
    totals = {r.source: int(r.n) for r in found}
    goal = targets(totals, weights)
    share = _small(spark.createDataFrame([(s, n, goal[s], goal[s] / n if n else 0.0) for s, n in totals.items()], "_s string, source_size long, target double, rate double"), len(totals))
    whole = F.floor(F.col("rate") + _EPS)
    rated = numbered(sizes).join(share, F.col("source").eqNullSafe(F.col("_s"))).withColumn("p", F.greatest(F.col("rate") - whole, F.lit(0.0)))
    drawn = cube_sample(rated.select("doc_id", "source", "h1", "h2", "size", "k", "p"), {r.source: int(r.docs) for r in found})
    copies = (whole + F.col("p")).cast("long")
    return drawn.join(share, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "h1", "h2")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' targets."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def source_totals(spark, sf_dir: str) -> DataFrame:
    """What op6_mixing aims at: documents, size and target of each source, from its own rows."""
    own = op6_mixing(spark, sf_dir).groupBy("source", "source_size", "target").agg(F.count("*").alias("n_docs"), F.sum("size").alias("size"), F.max(F.col("taken") > 3 * F.col("size")).alias("over"))
    return own.withColumn("target", F.round("target", 3))


#: Targets by water filling: with sources sorted by 3 * size / weight, the first ones reach their cap.
SOURCE_TOTALS_SQL = r"""
WITH sized AS (
  SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size FROM documents
), own AS (
  SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS size FROM sized GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM own
), sorted AS (
  SELECT *, 3 * size / weight AS level, sum(size) OVER () AS every, sum(3 * size) OVER w - 3 * size AS capped, sum(weight) OVER () - (sum(weight) OVER w - weight) AS open_weight
  FROM weighed WINDOW w AS (ORDER BY 3 * size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), stops AS (
  SELECT max((every - capped) / open_weight) FILTER ((every - capped) / open_weight <= level) AS rate FROM sorted
)
SELECT source, size AS source_size, round(CAST(least(rate * weight, 3 * size) AS DOUBLE), 3) AS target, n_docs, size, false AS over FROM sorted, stops
"""


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: docs' columns with size, source_size, target, taken and copies; copies of 0 are not in the mix.

    Rows that repeat id, source and text become one whose copies and taken words are the sums. Null texts have size 0 and
    a null source is a source of its own; an empty table gives none.
    """
    drawn = mix(docs).groupBy("h1", "h2").agg(F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken"), F.sum("copies").alias("copies"))
    h1, h2 = (free_name(docs, c) for c in ("_h1", "_h2"))
    tagged = docs.withColumns(dict(zip((h1, h2), row_key(), strict=True))).dropDuplicates([h1, h2])
    made = ["size", "source_size", "target", "taken", "copies"]
    own = [F.col(f"d.`{c}`") for c in docs.columns if c not in made]
    return tagged.alias("d").join(drawn.alias("m"), (F.col(f"d.{h1}") == F.col("m.h1")) & (F.col(f"d.{h2}") == F.col("m.h2"))).select(*own, *[f"m.{c}" for c in made])
