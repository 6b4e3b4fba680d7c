"""Token counts as delta-maintained rollups: signed batches add up to totals by source, language and tokenizer.

A batch is a table of changes: (op, doc_id, source, lang, text) with op "insert", "delete", "revise_from" or
"revise_to"; inserts and revise_to count +1, deletes and revise_from count -1, so a revision is two signed rows and
totals are plain sums; any other op fails the batch. A batch is reduced to one signed row a (source, lang, tokenizer) and
committed as one Parquet folder named after its id: written beside under a mark of its own, then renamed. Whose mark
the committed folder bears has committed the batch, so of two racing writers one gets True, also on stores where a
rename to a folder that exists nests. A second commit of the same id changes nothing, and a job that dies
before the rename leaves nothing behind that is read. Totals add all committed batches, whose rows number groups, not
documents. ``compact`` sums them into one snapshot that also lists the ids of its batches, so that these stay committed; the
folders that a snapshot has taken in are deleted when the next one is made, so no reader loses a file it has listed.

Tokenizer versions: "words-1" (white-space separated), "bytes-1" (UTF-8 bytes) and any byte-pair vocabulary in
tiktoken's rank format, whose path is a parameter and whose version is a hash of its ranks, so that counts of two
vocabularies never meet in one total; the ranks are read on the driver and broadcast (a vocabulary file has a fixed size). Null texts count 0 tokens and 1 document; null sources and languages are groups of their own.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm.common import discard, map_arrow, materialize, shared_dir, small_batches, table, utf8

VOCABULARY = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the published pre-tokenizer pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SIGNS = {"insert": 1, "revise_to": 1, "delete": -1, "revise_from": -1}
_SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def bpe_version(vocabulary: str) -> str:
    """The tokenizer version of a vocabulary: equal for files with equal ranks, whatever their names and order."""
    ranks = sorted((rank, token) for token, rank in read_ranks(vocabulary).items())
    return "bpe-" + hashlib.sha256(repr(ranks).encode()).hexdigest()[:16]


_encoders: dict = {}


def _encoder(version: str, ranks: dict[bytes, int]):
    """One encoder a worker process and version."""
    import tiktoken

    if version not in _encoders:
        _encoders[version] = tiktoken.Encoding(version, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[version]


def measured(rows: DataFrame, keep: list[str], texts: list[str], vocabulary: str | None = VOCABULARY) -> DataFrame:
    """The kept columns, and for each text column an array n_<column> of its words, bytes and tokens (0 without a vocabulary).

    What follows needs no text any more. A text that equals that of the first column is not counted twice.
    """
    spark = rows.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast((bpe_version(vocabulary), read_ranks(vocabulary)) if vocabulary else None)

    def run(batch):
        encode = _encoder(*ranks.value).encode_ordinary if ranks.value else lambda text: ()
        count = lambda t: [len(t.split()), len(t), len(encode(t.decode()))]
        columns = [list(utf8(batch.column(len(keep) + k))) for k in range(len(texts))]
        first = [count(t) for t in columns[0]]
        counted = [first] + [[n if t == u else count(t) for t, u, n in zip(own, columns[0], first, strict=True)] for own in columns[1:]]
        return {c: batch.column(k) for k, c in enumerate(keep)} | {f"n_{c}": n for c, n in zip(texts, counted, strict=True)}

    kinds = dict(rows.select(*keep).dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in keep] + [f"n_{c} array<long>" for c in texts])
    return map_arrow(rows.select(*keep, *[F.col(c).cast("string") for c in texts]), run, schema)


def roll_up(counted: DataFrame, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """The signed rollup of one batch of measured changes (op, source, lang, n)."""
    known = F.element_at(F.create_map(*[x for op, s in SIGNS.items() for x in (F.lit(op), F.lit(s))]), F.coalesce("op", F.lit("")))
    sign = F.coalesce(known, F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))).cast("int"))
    versions = ["words-1", "bytes-1"] + ([bpe_version(vocabulary)] if vocabulary else [])
    sums = [F.sum(F.col("sign") * F.col("n")[k]).alias(f"t{k}") for k in range(len(versions))]
    summed = counted.withColumn("sign", sign).groupBy("source", "lang").agg(F.sum("sign").cast("long").alias("docs"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(f"t{k}").alias("tokens")) for k, v in enumerate(versions)]))
    return summed.select("source", "lang", "docs", each.alias("t")).select("source", "lang", "t.tokenizer", "docs", "t.tokens")


def count_tokens(changes: DataFrame, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """The signed rollup of one batch of changes (op, source, lang, text)."""
    return roll_up(measured(changes, ["op", "source", "lang"], ["text"], vocabulary).withColumnRenamed("n_text", "n"), vocabulary)


class Rollup:
    """Committed batches of signed counts under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(self.path))

    def _named(self, prefix: str) -> list[str]:
        return sorted(s.getPath().getName().removeprefix(prefix) for s in self._fs.listStatus(self._at(self.path)) if s.getPath().getName().startswith(prefix))

    def _snapshot(self) -> tuple[str, set[str]]:
        """Path of the last snapshot ("" without one) and the ids of the batches in it."""
        made = self._named("snapshot=")
        if not made:
            return "", set()
        path = f"{self.path}/snapshot={made[-1]}"
        return path, {r.batch for r in self.spark.read.schema("batch string").parquet(f"{path}/batches").collect()}  # a row a commit

    def committed(self) -> list[str]:
        return sorted({*self._named("batch="), *self._snapshot()[1]})

    def commit(self, batch: str, changes: DataFrame, vocabulary: str | None = VOCABULARY, counted: bool = False) -> bool:
        """Apply a batch of changes, or of counted ones (see roll_up), once: False, and no work, where its id is committed."""
        final, mark = self._at(f"{self.path}/batch={batch}"), f"_by-{uuid.uuid4().hex}"
        if self._fs.exists(final) or batch in self._snapshot()[1]:
            return False
        draft = f"{self.path}/_draft-{uuid.uuid4().hex}"
        (roll_up if counted else count_tokens)(changes, vocabulary).write.parquet(draft)
        self._fs.create(self._at(f"{draft}/{mark}")).close()
        if not self._fs.exists(final) and self._fs.rename(self._at(draft), final) and self._marks(final) == [mark]:
            return True
        # another writer was first: what of this draft lies beside or inside the committed folder goes
        for left in (self._at(draft), self._at(f"{self.path}/batch={batch}/{draft.rpartition('/')[2]}")):
            self._fs.delete(left, True)
        return False

    def _marks(self, folder) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().startswith("_by-")]

    def totals(self) -> DataFrame:
        """docs and tokens by source, language and tokenizer version over all committed batches."""
        snapshot, held = self._snapshot()
        paths = [f"{self.path}/batch={b}" for b in self._named("batch=") if b not in held] + ([f"{snapshot}/totals"] if snapshot else [])
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def compact(self) -> str:
        """Write a snapshot of all committed batches, named by its number, and delete what the one before it had taken in.

        The snapshot is written beside and renamed, so a job that dies leaves the old state; of two racing writers one wins.
        """
        before, taken = self._snapshot()
        batches = self.committed()
        number = f"{int(before.rpartition('=')[2]) + 1 if before else 1:012d}"
        draft = f"{self.path}/_draft-{uuid.uuid4().hex}"
        self.totals().coalesce(1).write.parquet(f"{draft}/totals")
        self.spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.parquet(f"{draft}/batches")
        final = self._at(f"{self.path}/snapshot={number}")
        if self._fs.exists(final) or not self._fs.rename(self._at(draft), final):
            self._fs.delete(self._at(draft), True)
            return self._snapshot()[0]
        for b in taken & set(self._named("batch=")):
            self._fs.delete(self._at(f"{self.path}/batch={b}"), True)
        for old in [s for s in self._named("snapshot=") if s < number][:-1]:
            self._fs.delete(self._at(f"{self.path}/snapshot={old}"), True)
        return f"{self.path}/snapshot={number}"


def commit_history(spark, sf_dir: str, vocabulary: str | None = VOCABULARY) -> Rollup:
    """Three batches over the whole documents table: its load, a revision, and a deletion.

    The revision takes the blank lines out of all texts that are labelled as of low quality, the deletion withdraws all
    documents that are labelled toxic, with the text that they have by then. The load is sent twice, which is void.
    """
    rollup = Rollup(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").withColumn("revised", F.regexp_replace("text", "\\n+", "\n"))
    # texts are counted once, before anything is joined
    sized = materialize(measured(docs, ["doc_id", "source", "lang"], ["text", "revised"], vocabulary), "token-sizes")
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("_quality"), F.max("toxic").alias("_toxic"))
    # written, so that adaptive execution may split the join where an id has many rows
    marks = materialize(marks, "token-marks")
    known = sized.join(marks, "doc_id")
    poor, toxic = known.where(F.col("_quality") == 0), known.where(F.col("_toxic") > 0)
    now = F.when(F.col("_quality") == 0, F.col("n_revised")).otherwise(F.col("n_text"))
    change = lambda rows, op, n: rows.select(F.lit(op).alias("op"), "source", "lang", n.alias("n"))
    load = change(sized, "insert", F.col("n_text"))
    revision = change(poor, "revise_from", F.col("n_text")).unionByName(change(poor, "revise_to", F.col("n_revised")))
    for batch, changes in (("1-load", load), ("1-load", load), ("2-revision", revision), ("3-deletion", change(toxic, "delete", now))):
        rollup.commit(batch, changes, vocabulary, counted=True)
    discard(sized)
    discard(marks)
    return rollup


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer over the whole documents table after its load, a revision and a deletion."""
    return commit_history(spark, sf_dir).totals()


def word_and_byte_totals(spark, sf_dir: str) -> DataFrame:
    """The same history counted by the two tokenizers that SQL has as well."""
    return commit_history(spark, sf_dir, vocabulary=None).totals()


TOTALS_SQL = r"""
WITH marks AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
current AS (
  SELECT source, lang, coalesce(toxic, 0) AS toxic, CASE WHEN quality = 0 THEN regexp_replace(text, '
+', chr(10), 'g') ELSE text END AS text FROM documents LEFT JOIN marks USING (doc_id)
), sized AS (
  SELECT source, lang, toxic, unnest(['words-1', 'bytes-1']) AS tokenizer, unnest([len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')), strlen(coalesce(text, ''))]) AS tokens FROM current
)
SELECT source, lang, tokenizer, CAST(count_if(toxic = 0) AS BIGINT) AS docs, CAST(sum(CASE WHEN toxic = 0 THEN tokens ELSE 0 END) AS BIGINT) AS tokens FROM sized GROUP BY source, lang, tokenizer
"""
