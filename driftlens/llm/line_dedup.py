"""Substring dedup by line hashing: keep the earliest occurrence of every passage, remove the rest, keep offsets.

A unit is a line, cut further after each of ``.,;:!?`` (and their wide forms), so that a passage has the same units
wherever its line breaks fall; what follows a cut up to the next letter belongs to the unit before. A unit is normalised
(A-Z to lower case, runs of white space to one space, trimmed) and hashed to 128 bits. Digests are grouped over the whole
corpus and the earliest occurrence of each stays: occurrences are ranked by doc_id, then by a hash of the text (for
different texts under one id), then by place; a null id ranks first. Later occurrences are removed where they stand in a
row: a paragraph of neighbouring repeated units of MIN_BYTES normalised bytes or more goes, while a short phrase that
others use as well stays: its units are counted in n_repeated, and min_bytes=0 removes every one of them. Units count by bytes, so scripts without spaces are no case of their own.

Null texts count as empty; an empty text has no unit. Rows that repeat id and text are one document and get the same
result. Digests are grouped with partial aggregation, so a line in a third of all documents costs one row a task, and the
most frequent digests meet their occurrences by a broadcast of bounded size (``skew_join``).
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import LOWER, discard, map_arrow, materialize, skew_join, small_batches, table, utf8

MIN_BYTES = 180
UNITS = re.compile("[^.,;:!?\n。，；：！？]*[.,;:!?\n。，；：！？][.,;:!?。，；：！？\x20\x09-\x0d]*|[^.,;:!?\n。，；：！？]+")
_ID = "doc_id long, row long"


def cut_units(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The units of a text, which joined are the text, and their normal forms (empty for a unit without a word)."""
    own = [u.encode(errors="surrogateescape") for u in UNITS.findall(text.decode(errors="surrogateescape"))]
    return own, [b" ".join(u.translate(LOWER).split()) for u in own]


def _rows(texts: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)


def line_units(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), unit (its number), size (normalised bytes) and digest of every unit with a word."""
    small_batches(docs.sparkSession)

    def run(batch):
        texts, ids = list(utf8(batch.column(1))), batch.column(0)
        numbers, sizes, digests, counts = [], [], [], []
        for text in texts:
            normal = cut_units(text)[1]
            own = [k for k, u in enumerate(normal) if u]
            numbers.append(np.array(own, np.int32))
            sizes.append(np.array([len(normal[k]) for k in own], np.int32))
            digests += [xxhash.xxh3_128_digest(normal[k]) for k in own]
            counts.append(len(own))
        pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        at = np.repeat(np.arange(len(texts)), counts)
        return {"doc_id": ids.take(at), "row": _rows(texts)[at], "unit": np.concatenate(numbers), "size": np.concatenate(sizes), "d1": pair[:, 0], "d2": pair[:, 1]}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, f"{_ID}, unit int, size int, d1 long, d2 long")


def repeated_units(units: DataFrame) -> DataFrame:
    """doc_id, row and the sorted numbers of the units that stand earlier too."""
    place = F.struct("doc_id", "row", "unit")
    groups = units.groupBy("d1", "d2").agg(F.min(place).alias("kept"), F.max(place).alias("last"), F.count("*").alias("n"))
    kept = materialize(groups.where("kept <> last").select("d1", "d2", "kept", "n"), "kept-units")
    later = skew_join(units, kept, ["d1", "d2"]).where(place != F.col("kept")).select("doc_id", "row", "unit").distinct()
    return later.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list("unit")).alias("repeated"))


def paragraphs(repeated: list[int], sizes: list[int], min_bytes: int) -> list[tuple[int, int]]:
    """First and last unit of each run of neighbouring repeated units of min_bytes or more."""
    numbers = np.array(repeated, np.int64)
    starts = np.flatnonzero(np.diff(numbers, prepend=-2) != 1)
    total = np.add.reduceat(np.array(sizes, np.int64)[numbers], starts) if len(numbers) else np.zeros(0)
    ends = np.append(starts[1:], len(numbers)) - 1
    return [(int(numbers[a]), int(numbers[b])) for a, b, size in zip(starts, ends, total, strict=True) if size >= min_bytes]


def remove_units(docs: DataFrame, repeated: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, kept_text, n_units, n_removed and n_repeated (units that stand earlier too, removed or not), spans: what remains, and the byte offsets removed from the original."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the text's hash again, with the same function as in line_units
    tagged = map_arrow(own, lambda b: {"doc_id": b.column(0), "text": b.column(1), "row": _rows(list(utf8(b.column(1))))}, "doc_id long, text string, row long")
    again = repeated.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "repeated")
    joined = tagged.join(again, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")

    def run(batch):
        texts, counts, gone, spans = [], [], [], []
        for text, repeated in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            units, normal = cut_units(text)
            runs = paragraphs(repeated, [len(u) for u in normal], min_bytes) if repeated else []
            offsets = np.concatenate([[0], np.cumsum([len(u) for u in units])]).astype(int).tolist()
            cut = [{"start": offsets[a], "end": offsets[b + 1]} for a, b in runs]
            edges = [0, *[x for s in cut for x in (s["start"], s["end"])], len(text)]
            texts.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            counts.append(len(units))
            gone.append(sum(b + 1 - a for a, b in runs))
            spans.append(cut)
        again = [len(r or ()) for r in batch.column(2).to_pylist()]
        return {"doc_id": batch.column(0), "kept_text": [t.decode(errors="replace") for t in texts], "n_units": counts, "n_removed": gone, "n_repeated": again, "spans": spans}

    return map_arrow(joined.select("doc_id", "text", "repeated"), run, "doc_id long, kept_text string, n_units long, n_removed long, n_repeated long, spans array<struct<start:long,end:long>>")


def dedup_lines(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    units = materialize(line_units(docs), "line-units")
    repeated = materialize(repeated_units(units), "repeated-units")
    discard(units)
    return remove_units(docs, repeated, min_bytes)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Line dedup over every whole text of documents; one row per document."""
    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_units", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), F.to_json("spans").alias("spans"), "n_repeated")


#: The same in SQL; spans are written with the keys that to_json writes.
OP9_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT doc_id, regexp_extract_all(text, '[^.,;:!?\n。，；：！？]*[.,;:!?\n。，；：！？][.,;:!?。，；：！？\x20\x09-\x0D]*|[^.,;:!?\n。，；：！？]+') AS units FROM docs
), each AS (
  SELECT doc_id, unnest(units) AS u, generate_subscripts(units, 1) - 1 AS unit FROM cut
), normal AS (
  SELECT doc_id, unit, u, strlen(u) AS n,
         trim(regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM each
), placed AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY unit) - n AS place,
         norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, unit) > 1 AS again
  FROM normal
), chained AS (
  SELECT *, CASE WHEN again THEN unit - row_number() OVER (PARTITION BY doc_id, again ORDER BY unit) END AS run FROM placed
), measured AS (
  SELECT *, again AND sum(strlen(norm)) OVER (PARTITION BY doc_id, again, run) >= 180 AS gone FROM chained
), runs AS (
  SELECT doc_id, run, min(place) AS a, max(place + n) AS b FROM measured WHERE gone GROUP BY doc_id, run
), spans AS (
  SELECT doc_id, '[' || string_agg('{"start":' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ',"end":' || CAST(CAST(b AS BIGINT) AS VARCHAR) || '}', ',' ORDER BY a) || ']' AS spans FROM runs GROUP BY doc_id
), kept AS (
  SELECT doc_id, count(*) AS n_units, CAST(sum(gone::int) AS BIGINT) AS n_removed, CAST(sum(again::int) AS BIGINT) AS n_repeated, sha256(coalesce(string_agg(CASE WHEN NOT gone THEN u END, '' ORDER BY unit), '')) AS kept_sha256 FROM measured GROUP BY doc_id
)
SELECT docs.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(n_repeated, 0) AS n_repeated, coalesce(kept_sha256, sha256('')) AS kept_sha256, coalesce(spans, '[]') AS spans
FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id)
"""
