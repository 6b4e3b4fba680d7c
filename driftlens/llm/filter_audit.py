"""Filter interaction audit: what each filter removes, alone and behind others, by joins of failing-id relations.

Every filter has a table of its own with the keys of the rows that fail it. A set of filters that has been applied is a
prefix, whatever the order of its filters, so 2 ** n prefixes stand for all n! orders. Survivors of all prefixes are built in
n rounds: the rows of all prefixes without a filter that come through its left-anti join are the survivors of these
prefixes and that filter. What a filter removes behind a prefix is the left-semi join of the prefix's survivors with the
filter's table; redundancy is what else the filter's table holds, and label losses are counted over the removed rows. Only
counts by part, prefix and filter leave Spark's joins; the report lists them for all orders.

Rows are first aggregated by key (128 bits of id and text), part and labels, so repeated rows are one row with a number, and
rows that fail nothing are counted once and take no part in the joins. All relations are dealt by key alone.

Null texts are empty; empty texts fail A (no words) and, as all empty texts are identical, E. A null id is no smaller id and
has none; its labels are unknown. Of several labels of an id the greatest counts. Null and empty parts are one part. An empty
table gives no row, as there is no part.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import discard, materialize, skew_join, table

_KEY = ["k1", "k2"]

#: Tests of one row over text, words and n_words; a row that passes the test fails the filter. E compares rows.
ROW_FILTERS: dict[str, Callable[[], Column]] = {
    "A": lambda: F.col("n_words") < 100,
    "B": lambda: 100 * F.size(F.array_distinct("words")).cast("long") < 80 * F.col("n_words"),
    "C": lambda: 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 10 * F.length("text").cast("long"),
    "D": lambda: F.col("text").rlike("[#$%&*|]"),
}
REPEATED = "E"


def judged(docs: DataFrame, part: str = "lang") -> DataFrame:
    """k1, k2 (a row's key), doc_id, part, h1, h2 (its text's) and fails: the letters of the row filters that it fails."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).withColumn("n_words", F.size("words").cast("long"))
    fails = F.array_compact(F.array(*[F.when(test(), F.lit(f)) for f, test in ROW_FILTERS.items()]))
    keys = [F.xxhash64(*([F.lit(seed)] if seed else []), "doc_id", F.isnull("doc_id"), "text").alias(k) for k, seed in zip(_KEY, (0, 1), strict=True)]
    hashes = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2")]
    return rows.select(*keys, "doc_id", "part", *hashes, fails.alias("fails"))


def repeats(rows: DataFrame) -> DataFrame:
    """k1, k2 of the rows whose text stands under a smaller id as well."""
    texts = rows.where("doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    texts = materialize(texts.where("least < most").select("h1", "h2", "least", "n"), "repeated-texts")
    return skew_join(rows, texts, ["h1", "h2"]).where("doc_id > least").select(*_KEY)


def failing_ids(rows: DataFrame) -> dict[str, DataFrame]:
    """A table of keys for each filter."""
    tables = {f: rows.where(F.array_contains("fails", f)).select(*_KEY) for f in ROW_FILTERS} | {REPEATED: repeats(rows)}
    return {f: materialize(t.distinct(), f"fails-{f}") for f, t in tables.items()}


def labelled_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """k1, k2, part, good, toxic and n, how many rows are alike in these."""
    held = rows.groupBy(*_KEY, "doc_id", "part").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.col("quality") == 1).cast("int").alias("good"), F.max(F.col("toxic") == 1).cast("int").alias("toxic"))
    # a third of all rows may have no id: they meet nothing and take no part in the join
    known = held.where("doc_id is not null").join(marks, "doc_id", "left")
    none = held.where("doc_id is null").withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    return known.unionByName(none).select(*_KEY, "part", *flags, "n")


def prefix_counts(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """part, prefix (bits of the filters applied), filter, removed, good_lost, toxic_lost; with an empty filter: kept.

    rows: see labelled_rows, materialised. Filters are numbered in the order of tables.
    """
    # each round writes the survivors that it adds, so no join is done twice
    written = [materialize(rows.withColumn("prefix", F.lit(0)), "survivors")]
    every = lambda: functools.reduce(DataFrame.unionByName, written)
    for k, failing in enumerate(tables.values()):
        through = every().join(failing, _KEY, "left_anti").withColumn("prefix", F.col("prefix") + (1 << k))
        written.append(materialize(through, "survivors"))
    counted = [every().withColumn("filter", F.lit(""))]
    for k, (f, failing) in enumerate(tables.items()):
        behind = every().where(F.col("prefix").bitwiseAND(F.lit(1 << k)) == 0)
        counted.append(behind.join(failing, _KEY, "left_semi").withColumn("filter", F.lit(f)))
    sums = [F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("good")).alias("good_lost"), F.sum(F.col("n") * F.col("toxic")).alias("toxic_lost")]
    summed = [c.groupBy("part", "prefix", "filter").agg(*sums) for c in counted]
    made = materialize(functools.reduce(DataFrame.unionByName, summed), "prefix-counts")
    for own in written:
        discard(own)
    return made


def orders(filters: list[str]) -> list[tuple]:
    """filter_order, step, filter, prefix, after (the prefix with the filter) for every step of every order."""
    bit = {f: 1 << k for k, f in enumerate(filters)}
    made = []
    for order in itertools.permutations(filters):
        prefix = 0
        for step, f in enumerate(order, 1):
            made.append(("".join(order), step, f, prefix, prefix | bit[f]))
            prefix |= bit[f]
    return made


def interactions(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step: see op12_filter_audit."""
    spark = docs.sparkSession
    judgements = materialize(judged(docs, part), "judged")
    tables = failing_ids(judgements)
    filters = list(tables)
    rows = materialize(labelled_rows(judgements, labels), "labelled-rows")
    discard(judgements)
    parts = materialize(rows.groupBy("part").agg(F.sum("n").alias("total")), "parts")
    failing = materialize(rows.join(functools.reduce(DataFrame.unionByName, tables.values()), _KEY, "left_semi"), "failing-rows")
    counts = prefix_counts(failing, tables)

    # from here on tables have as many rows as there are parts, prefixes, filters and steps
    n, everything = len(filters), (1 << len(filters)) - 1
    fails = failing.groupBy("part").agg(F.sum("n").alias("failing"))
    removed = counts.where("filter <> ''").withColumnRenamed("rows", "removed")
    kept = counts.where("filter = ''").select("part", F.col("prefix").alias("after"), F.col("rows").alias("left"))
    weight = F.create_map(*[F.lit(x) for s in range(n) for x in (s, math.factorial(s) * math.factorial(n - 1 - s))])
    alone = F.col("prefix") == F.lit(everything) - F.element_at(F.create_map(*[F.lit(x) for k, f in enumerate(filters) for x in (f, 1 << k)]), F.col("filter"))
    own = removed.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("prefix") == 0, F.col("removed"))).alias("fail"),
        F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * F.element_at(weight, F.bit_count("prefix").cast("int"))).alias("shapley"),
    )
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(x, ("filter_order", "step", "filter", "prefix", "after"), strict=True)]) for x in orders(filters)])).alias("s")
    report = parts.join(fails, "part", "left").select("part", "total", F.coalesce("failing", F.lit(0)).alias("failing"), steps).select("part", "total", "failing", "s.*")
    report = report.join(removed, ["part", "prefix", "filter"], "left").join(own, ["part", "filter"], "left").join(kept, ["part", "after"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return report.select(
        "part", "filter_order", "step",
        (F.col("total") - F.col("failing") + zero("left")).alias("kept"),
        zero("removed").alias("removed"),
        (zero("fail") - zero("removed")).alias("redundant"),
        *[zero(c).alias(c) for c in ("unique_fails", "good_lost", "toxic_lost", "shapley")],
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of five filters, by language."""
    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH RECURSIVE orders AS (
  SELECT '' AS o UNION ALL SELECT o || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(o, f)
), steps AS (
  SELECT o AS filter_order, CAST(k AS INTEGER) AS step, substr(o, k, 1) AS f, substr(o, 1, k - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS k) WHERE length(o) = 5
), cut AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents
), marks AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM cut LEFT JOIN marks m USING (doc_id)
), held AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails
), each AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS bad, length(translate(fails, before, '')) = length(fails) AS there, fails = f AS alone FROM held, steps
), counted AS (
  SELECT part, filter_order, step, f, sum(n) FILTER (there AND NOT bad) AS kept, sum(n) FILTER (there AND bad) AS removed, sum(n) FILTER (bad AND NOT there) AS redundant, sum(n) FILTER (alone) AS unique_fails,
    sum(good) FILTER (there AND bad) AS good_lost, sum(toxic) FILTER (there AND bad) AS toxic_lost FROM each GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM counted
"""
