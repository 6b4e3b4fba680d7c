"""Benchmark decontamination with DataFrame functions only.

1. Texts and items are cut into words (letters, digits and non-ASCII characters, A-Z lower-cased) and shingles of five
   words (an item of fewer words: all of them). Places in documents whose shingle stands in an item are found by a join
   on the shingle's hash; the items' side is broadcast while it has BROADCAST_SHINGLES rows at most.
2. Exact weighted-shingle similarity, the sum of the lesser over the sum of the greater counts, of every item-sized
   window that begins at such a place, and so of the best of all windows. Windows slide: what they share is a running sum
   over the hits of a text and item, so a text of one repeated word costs no more than another.
3. The SimHash distance (64 bits, weighted by how often a shingle stands there) of the best window is only reported: a
   few repeated shingles may carry all its votes, so no radius would be safe.

Texts are told apart by 128 bits of hash, so null or repeated ids and copies need no case of their own. Null and empty
texts and items without a word match nothing; repeated items give rows of their own.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.common import ascii_lower, free_name, materialize, table

WIDTH, SIMILARITY = 5, 0.8
BROADCAST_SHINGLES = 1_000_000
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LANES = 0x0000000100000001
PLACE = ["h1", "h2", "item", "item_id", "n", "width", "words"]
_MET = "struct<r: bigint, at: int, before: int>"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD), lambda w: w != "")


def shingle_at(words: str, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.col(words)[at + k] for k in range(width)])


def text_key(text: Column) -> list[Column]:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def simhash(counted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fp, total: the SimHash of rows (keys, h) with a row for each occurrence of a shingle.

    Thirty-two sums count the bits, two of them each in 32 bits of a long; no text has 2 ** 31 shingles.
    """
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_LANES))).alias(f"s{j}") for j in range(32)]
    summed = counted.groupBy(*keys).agg(F.count("*").alias("total"), *sums)
    fp = F.lit(0).cast("long")
    for j, lane in itertools.product(range(32), range(2)):
        votes = F.shiftrightunsigned(F.col(f"s{j}"), 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF))
        fp = fp.bitwiseOR(F.when(2 * votes > F.col("total"), F.lit(1 << (32 * lane + j) if 32 * lane + j < 63 else -(1 << 63))).otherwise(F.lit(0)))
    return summed.select(*keys, fp.cast("long").alias("fp"), "total")


def _least_shared(own: Column, other: Column, similarity: float) -> Column:
    """Shingles that two texts of so many shingles share at least, if they are that similar."""
    return F.ceil(similarity / (1 + similarity) * (own + other) - 1e-9)


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """item (a number of its own), item_id, n (words), width, h: a row for each shingle of each item."""
    items = benchmark.select("item_id", words_of(F.col("text").cast("string")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    items = items.withColumn("width", F.least("n", F.lit(WIDTH)))
    # repeated items with one id and one text count once
    items = items.withColumn("item", F.xxhash64("item_id", F.array_join("w", " "))).dropDuplicates(["item", "item_id"])
    places = items.select("item", "item_id", "w", "n", "width", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("width"))).alias("at"))
    h = F.coalesce(*[F.when(F.col("width") == k, shingle_at("w", F.col("at"), k)) for k in range(1, WIDTH + 1)])
    return places.select("item", "item_id", "n", "width", h.alias("h"))


def shingle_hits(docs: DataFrame, known: DataFrame, small: bool) -> DataFrame:
    """h1, h2, words, at and known's columns: each place of each text at which an item's shingle stands, copies together."""
    texts = docs.select(words_of(F.col("text").cast("string")).alias("w"), *text_key(F.col("text"))).withColumn("words", F.size("w"))
    hits = None
    for width in [r.width for r in known.select("width").distinct().collect()]:  # five values at most
        own = known.where(F.col("width") == width)
        at = texts.where(F.col("words") >= width).select("w", "h1", "h2", "words", F.explode(F.sequence(F.lit(0), F.col("words") - width)).alias("at"))
        found = at.select("h1", "h2", "words", "at", shingle_at("w", F.col("at"), width).alias("h")).join(F.broadcast(own) if small else own, "h")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = known.select("*", *[F.lit(0).cast("long").alias(c) for c in ("h1", "h2")], *[F.lit(0).alias(c) for c in ("words", "at")])  # no item, no row
    return hits.groupBy(*PLACE, "at").agg(F.first("h").alias("h"), F.first("d").alias("d"))


def slid_windows(hits: DataFrame, similarity: float) -> DataFrame:
    """PLACE's columns, m, start, similarity: for each text and item the first of the most similar windows of m words (n, or all of a shorter text).

    A hit at p counts in the windows that begin after the d-th earlier hit of its shingle (the item holds it d times), not
    before p less the window's shingles, and up to p itself. So each hit is an interval of starts, and the running sum of the
    intervals' ends is what every window shares with the item. Windows that begin at a hit are enough: one moved on to its
    first hit loses nothing. All steps keep the one shuffle by text and item.
    """
    pair = Window.partitionBy("h1", "h2", "item")
    m = F.least("n", "words")
    placed = hits.withColumn("m", m).withColumn("own", F.col("m") - F.col("width") + 1).withColumn("size", F.col("n") - F.col("width") + 1)
    placed = placed.withColumn("hits", F.count("*").over(pair)).where(F.col("hits") >= _least_shared(F.col("own"), F.col("size"), similarity))
    placed = placed.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2", "item", "h").orderBy("at")))
    keys = [*PLACE, "m", "own", "size"]
    here, later = F.struct("r", F.col("at").alias("at"), F.lit(None).cast("int").alias("before")), F.struct((F.col("r") + F.col("d")).alias("r"), F.lit(None).cast("int").alias("at"), F.col("at").alias("before"))
    met = placed.select(*keys, "h", F.explode(F.array(here.cast(_MET), later.cast(_MET))).alias("x")).select(*keys, "h", "x.*")
    each = met.groupBy(*keys, "h", "r").agg(F.max("at").alias("at"), F.max("before").alias("before")).where("at is not null")
    begins = F.greatest(F.col("at") - F.col("own") + 1, F.coalesce(F.col("before") + 1, F.lit(0)), F.lit(0))
    ends = [(begins, 1, False), (F.col("at") + 1, -1, False), (F.least(F.col("at"), F.col("words") - F.col("m")), 0, True)]
    step = F.explode(F.array(*[F.struct(start.cast("int").alias("start"), F.lit(by).alias("by"), F.lit(asked).alias("asked")) for start, by, asked in ends])).alias("x")
    steps = each.select(*keys, step).select(*keys, "x.*").groupBy(*keys, "start").agg(F.sum("by").alias("by"), F.max("asked").alias("asked"))
    shared = steps.withColumn("s", F.sum("by").over(pair.orderBy("start").rowsBetween(Window.unboundedPreceding, 0))).where("asked")
    scored = shared.withColumn("similarity", F.col("s") / (F.col("size") + F.col("own") - F.col("s"))).where(F.col("similarity") >= similarity - 1e-9)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("b")
    return scored.groupBy(*PLACE, "m").agg(best).select(*PLACE, "m", (-F.col("b.back")).alias("start"), "b.similarity")


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """h1, h2, item_id, start, n_words, similarity, distance: the best window of each text for each item it leaks."""
    shingles = materialize(item_shingles(benchmark), "item-shingles")
    # written, so that a frequent shingle's rows may be split where its side is too large to broadcast
    known = materialize(shingles.groupBy("item", "item_id", "n", "width", "h").agg(F.count("*").alias("d")), "known-shingles")
    found = materialize(slid_windows(shingle_hits(docs, known, known.count() <= BROADCAST_SHINGLES), similarity), "similar-windows")

    window = found.select("h1", "h2", "item", "start", "m", "width")
    texts = docs.select(F.col("text").cast("string").alias("text"), *text_key(F.col("text"))).join(window, ["h1", "h2"])
    own = texts.select("h1", "h2", "item", "width", F.slice(words_of(F.col("text")), F.col("start") + 1, F.col("m")).alias("w"))
    own = own.select("h1", "h2", "item", "width", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("width"))).alias("k"))
    h = F.coalesce(*[F.when(F.col("width") == k, shingle_at("w", F.col("k"), k)) for k in range(1, WIDTH + 1)])
    # a copy of a text gives the same rows again; k tells a window's own repeats apart
    held = own.select("h1", "h2", "item", "k", h.alias("h")).dropDuplicates(["h1", "h2", "item", "k"])
    asked = simhash(held, ["h1", "h2", "item"]).select("h1", "h2", "item", "fp")
    items = simhash(shingles, ["item"]).select("item", F.col("fp").alias("item_fp"))
    scored = found.join(asked, ["h1", "h2", "item"]).join(items, "item").withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).cast("int"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "m", (-F.col("distance")).alias("near"))).alias("b")
    return scored.groupBy("h1", "h2", "item_id").agg(best).select("h1", "h2", "item_id", (-F.col("b.back")).alias("start"), F.col("b.m").alias("n_words"), "b.similarity", (-F.col("b.near")).alias("distance"))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id of every document that holds a benchmark item, with the best window."""
    docs = table(spark, sf_dir, "documents")
    found = materialize(leaks(docs, table(spark, sf_dir, "benchmark")), "leaks")
    ids = docs.select("doc_id", *text_key(F.col("text")))
    return ids.join(found, ["h1", "h2"]).select("doc_id", "item_id", "start", "n_words", F.round("similarity", 6).alias("similarity"), "distance")


def drop_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a benchmark item.

    Null and empty texts hold none; repeated rows go or stay together; an empty table, or an empty benchmark, drops none.
    """
    bad = materialize(leaks(docs, table(spark, sf_dir, "benchmark")).select("h1", "h2").distinct(), "leaks")
    h1, h2 = (free_name(docs, c) for c in ("_h1", "_h2"))
    tagged = docs.withColumns(dict(zip((h1, h2), text_key(F.col("text")), strict=True)))
    return tagged.join(bad, (F.col(h1) == bad.h1) & (F.col(h2) == bad.h2), "left_anti").select(*docs.columns)
