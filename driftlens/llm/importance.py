"""Importance resampling towards a target text: hashed runs of words, found by an Aho-Corasick scan.

1. A text's delimiters become spaces and A-Z are lower-cased. The distinct words of a segment of about SEGMENT bytes form
   a dictionary, each bounded by a space on both sides, so that every word of the segment is met exactly once, as a whole
   word. Its payload is the word's CRC-32 and length.
2. An automaton over that dictionary scans the segment and emits payloads in order. The CRC of a run of words follows from
   the payloads of its neighbours alone: appending n bytes to a string maps its CRC by a linear operator that depends on
   n, kept as tables for powers of two. The CRC modulo the number of buckets is the run's bucket.
3. One scan writes each text's buckets (16 bits each) and, at the end of a task, its counts by bucket. Spark adds the
   counts, at most BUCKETS rows reach the driver, and the gains of all buckets go back as one array.
4. A text's weight is the floored mean of its buckets' gains; Gumbel noise from a hash of the id makes a draw without
   replacement a top-k. Ranks come from the counts of equal scores, which are few as scores are whole numbers (their
   number is bounded by the range of gains and noise, about 115,000), and from the order within a score.

The dictionary is a segment's own, so neither it nor anything else that is broadcast grows with the corpus. Null texts hold
no word, weigh 0 and aren't drawn, as are texts under LEAST_WORDS words. A null id is hashed as an empty one and comes
last among ties. Rows that repeat an id are rows of their own, with ranks of their own. Empty tables give no rows; without a
target all of its counts are zero.
"""

from __future__ import annotations

import itertools
import math
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.common import materialize, small_batches, table, utf8

BUCKETS, RUN, LEAST_WORDS, SHARE, SEED = 10_000, 2, 20, 25, 7
SEGMENT = 4_000_000  # bytes scanned with one dictionary

#: Lower-cases A-Z; every byte that is no ASCII letter or digit and no part of a longer character becomes a space.
_CLEAN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
_POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32 as in zlib
_SPACE = np.uint32(zlib.crc32(b" "))


def _after_byte(crc: int) -> int:
    for _ in range(8):
        crc = crc >> 1 ^ (_POLYNOMIAL if crc & 1 else 0)
    return crc


def _by_bytes(images: np.ndarray) -> np.ndarray:
    """The linear map that sends bit k to images[k], as four tables by byte."""
    bits = np.arange(256)[:, None] >> np.arange(8) & 1 == 1
    return np.stack([np.bitwise_xor.reduce(np.where(bits, images[8 * j : 8 * j + 8], np.uint32(0)), axis=1) for j in range(4)])


def _mapped(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


_images = np.array([_after_byte(1 << k) for k in range(32)], np.uint32)
#: What 2 ** k further bytes do to a CRC.
_FURTHER: list[np.ndarray] = []
for _ in range(32):
    _FURTHER.append(_by_bytes(_images))
    _images = _mapped(_FURTHER[-1], _images)


def further(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The share of each CRC in that of a string which goes on for n more bytes: crc(a + b) is further(crc(a), len(b)) ^ crc(b)."""
    crc = crc.copy()
    for k in range(int(n.max(initial=0)).bit_length()):
        longer = n >> k & 1 == 1
        crc[longer] = _mapped(_FURTHER[k], crc[longer])
    return crc


def scan(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the delimiter behind it, CRC-32 and length of every word of a cleaned text that begins and ends with a space."""
    parts, start = [], 0
    while start < len(text) - 1:
        end = text.rfind(b" ", start + 1, start + SEGMENT)
        end = text.index(b" ", start + 1) if end < 0 else end
        segment = text[start : end + 1]
        words = set(segment.split())
        if words:
            found = ahocorasick.Automaton()
            for w in words:
                found.add_word(f" {w.decode('latin-1')} ", zlib.crc32(w) << 32 | len(w))
            found.make_automaton()
            pairs = np.fromiter(itertools.chain.from_iterable(found.iter(segment.decode("latin-1"))), np.uint64).reshape(-1, 2)
            pairs[:, 0] += np.uint64(start)
            parts.append(pairs)
        start = end
    pairs = np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64)
    return pairs[:, 0].astype(np.int64), (pairs[:, 1] >> np.uint64(32)).astype(np.uint32), (pairs[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs(texts: list[bytes], most: int = RUN, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and the text and bucket of every run of 1 to most words, ordered by text."""
    clean = [t.translate(_CLEAN) for t in texts]
    begin = np.cumsum([1, *(len(t) + 1 for t in clean)])[:-1]
    end, crc, length = scan(b" " + b" ".join(clean) + b" ")
    doc = np.searchsorted(begin, end, "right") - 1
    docs, found, run = [doc], [crc], crc
    for k in range(1, most):
        # the run so far, a space, and the word that follows it
        run = further(further(run[:-1], np.ones(max(0, len(run) - 1), np.int64)) ^ _SPACE, length[k:]) ^ crc[k:]
        whole = doc[k:] == doc[:-k]
        docs.append(doc[k:][whole])
        found.append(run[whole])
    docs = np.concatenate(docs)
    order = np.argsort(docs, kind="stable")
    return np.bincount(doc, minlength=len(texts)), docs[order], (np.concatenate(found) % np.uint32(buckets)).astype(np.uint16)[order]


def hashed_runs(rows: DataFrame, id_col: str | None, most: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, found (the buckets of a text's runs, 16 bits each); and rows with bucket and n, a task's counts."""
    assert buckets <= 1 << 16
    small_batches(rows.sparkSession)
    names = ["doc_id", "n_words", "found", "bucket", "n"]

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = list(utf8(batch.column(1)))
            words, doc, bucket = runs(texts, most, buckets)
            counts += np.bincount(bucket, minlength=buckets)
            ends = np.searchsorted(doc, np.arange(len(texts) + 1))
            if id_col:
                found = pa.array([bucket[a:b].tobytes() for a, b in itertools.pairwise(ends.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), found, pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.int64())], names)
        held = np.flatnonzero(counts)
        none = [pa.nulls(len(held), kind) for kind in (pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(held.astype(np.int32)), pa.array(counts[held])], names)

    own = rows.select((F.col(id_col) if id_col else F.lit(None)).cast("long").alias("doc_id"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, n_words long, found binary, bucket int, n long")


def bucket_counts(hashed: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How many runs fall into each bucket."""
    counts = [0] * buckets
    for r in hashed.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        counts[r.bucket] = r.n
    return counts


def gains(source: list[int], target: list[int]) -> list[int]:
    """The floored thousandfold logarithm of how much likelier a bucket is in the target, with one run added to each bucket."""
    size, s, t = float(len(source)), float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log((b + 1.0) * (s + size) / ((a + 1.0) * (t + size)))) for a, b in zip(source, target, strict=True)]


def weighted(hashed: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, n_words, n_features, weight."""
    held = hashed.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))

    def run(batches):
        for batch in batches:
            each = [np.frombuffer(x, np.uint16) for x in batch.column(2).to_pylist()]
            weight = [int(held.value[x].sum()) // max(1, len(x)) for x in each]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in each], pa.int64()), pa.array(weight, pa.int64())], names)

    names = ["doc_id", "n_words", "n_features", "weight"]
    return hashed.where("bucket is null").select("doc_id", "n_words", "found").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def scored(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """score: weight and Gumbel noise, in thousandths, from a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long"))


def drawn(rows: DataFrame, share: int = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """rank of the share (in hundredths) of highest scores among rows of so many words; null for all others.

    rows (materialised) hold doc_id, n_words, n_features and score. No task gets more than the rows of one score.
    """
    may = F.col("n_words") >= least
    many = share * rows.where(may).count() // 100
    # as many rows as there are scores
    levels = rows.where(may).groupBy("score").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")
    levels = levels.select(F.col("score").alias("_score"), above.alias("_above")).where(F.col("_above") < many)
    placed = rows.join(F.broadcast(levels), may & (F.col("score") == F.col("_score")), "left").drop("_score")
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features")
    rank = F.col("_above") + F.row_number().over(order)
    first = placed.where("_above is not null").withColumn("rank", rank)
    first = first.withColumn("rank", F.when(F.col("rank") <= many, F.col("rank")))
    rest = placed.where("_above is null").withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).drop("_above")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs (doc_id, text), drawn towards target (text)."""
    hashed = materialize(hashed_runs(docs, "doc_id"), "hashed-runs")
    gain = gains(bucket_counts(hashed), bucket_counts(hashed_runs(target, None)))
    return drawn(materialize(scored(weighted(hashed, gain), seed), "importance-scores"), share, least)


def op11_importance(spark, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, a quarter of them drawn towards the texts of benchmark."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"), "n_words")


OP11_SQL = r"""
WITH cut AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT NULL, -row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), feature AS (
  SELECT r, unnest(w) AS f FROM cut
  UNION ALL
  SELECT r, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM cut
), counted AS (SELECT r, f, count(*) AS n FROM feature GROUP BY r, f
), step AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM (SELECT unnest(range(256)) AS b))
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * strlen(f), 2), lambda k: ('0x' || substr(x, k, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM feature)), step
), held AS (SELECT r, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY r, bucket
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (tt + 10000) AS DOUBLE) / CAST((s + 1) * (ss + 10000) AS DOUBLE))) AS BIGINT) AS g
  FROM (SELECT b AS bucket, coalesce(sum(n) FILTER (r > 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (r < 0), 0)::DOUBLE AS t FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN held ON b = bucket GROUP BY b),
  (SELECT coalesce(sum(n) FILTER (r > 0), 0)::DOUBLE AS tt, coalesce(sum(n) FILTER (r < 0), 0)::DOUBLE AS ss FROM held)
), weighed AS (SELECT r, sum(n)::BIGINT AS n_features, CAST(floor(sum(n * g)::DOUBLE / sum(n)) AS BIGINT) AS weight FROM held JOIN gain USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM cut LEFT JOIN weighed USING (r) WHERE r > 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS k, count_if(n_words >= 20) OVER () AS many FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= 25 * many // 100 THEN k END AS rank, n_words FROM ranked
"""
