"""Suffix-array dedup: remove every byte that lies in a 200-byte string standing in more than one place.

1. Every 200-byte window of a text gets an anchor: the place in it whose 32 bytes hash least (the leftmost if tied), a
   function of the window's bytes alone. Windows that share an anchor are neighbours; they form one piece of text, so
   a text of n bytes has about n / 85 pieces, and equal windows lie in pieces whose anchors' 32 bytes are equal.
2. Pieces are grouped by their anchor's bytes (key) with partial aggregation; anchors seen once are dropped. A piece
   that as a whole stands twice is repeated in all its windows; what remains are different pieces under one key.
3. These, one representative each, are cut from the texts, brought together by key into shards and put through
   external induced sorting (``induced_sort``): suffixes that share 200 bytes with a neighbour in suffix order are
   repeated. Keys with more than HOT different pieces don't go to one shard: their pieces are dealt over shards that are
   sorted alike, and of each window that is different in its shard a 128-bit hash is compared across shards.
4. The repeated windows are joined back to all pieces and, by text, to the documents.

A text is identified by 128 bits of hash, not by its id, so null or repeated ids, repeated rows and copies need no
case of their own: a text that stands twice and has 200 bytes or more is removed whole. Null texts count as empty.
Matches never cross documents, overlaps count, and all strings are judged on the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import discard, free_name, map_arrow, materialize, mix64, skew_join, small_batches, table, trimmed, utf8
from driftlens.llm.induced_sort import DEPTH, repeated_starts, sorted_suffixes
from driftlens.llm.words import power_pair

ANCHOR = 32
SHARD = 2_000_000  # bytes sorted at a time; whole keys stay together
HOT = 20_000  # different pieces under one key, some 6 MB, up to which they are sorted in one shard
_WINDOWS = DEPTH - ANCHOR + 1  # anchors that fit in a window


def pieces(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor hash of each piece of a text; nothing for texts under DEPTH bytes."""
    n = len(text)
    if n < DEPTH:
        none = np.zeros(0, np.int64)
        return none, none, none
    power, inverse = power_pair(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    hashes = mix64((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: n - ANCHOR + 1])
    # 32 bits of hash over 32 bits of place: the least is the leftmost of those with the least hash
    least = hashes & np.uint64(0xFFFFFFFF00000000) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while 2 * span <= _WINDOWS:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (_WINDOWS - span)], least[_WINDOWS - span :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], len(anchor)) - 1
    return first, last, hashes[anchor[first]].view(np.int64)


def text_key(column) -> list:
    """Two longs that identify a text."""
    text = F.coalesce(column, F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def all_pieces(docs: DataFrame) -> DataFrame:
    """h1, h2, key, piece (hash of its bytes), size (windows), starts (its places in the text), one row each a text."""
    small_batches(docs.sparkSession)

    def run(batch):
        out = {c: [] for c in ("h1", "h2", "key", "piece", "size", "starts")}
        for text, h1, h2 in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            first, last, key = pieces(text)
            digest = xxhash.xxh3_64_intdigest
            own = np.array([digest(text[a : b + DEPTH]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64).view(np.int64)
            order = np.lexsort((first, own, key))
            new = np.ones(len(order), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (own[order][1:] != own[order][:-1])
            groups = np.flatnonzero(new)
            out["h1"].append(np.full(len(groups), h1, np.int64))
            out["h2"].append(np.full(len(groups), h2, np.int64))
            out["key"].append(key[order][groups])
            out["piece"].append(own[order][groups])
            out["size"].append((last - first + 1)[order][groups].astype(np.int32))
            out["starts"].extend(np.split(first[order].astype(np.int32), groups[1:]) if len(groups) else [])
        return {c: v if c == "starts" else np.concatenate(v) for c, v in out.items()}

    own = docs.select(F.col("text").cast("string").alias("text"), *text_key(F.col("text").cast("string")))
    return map_arrow(own, run, "h1 long, h2 long, key long, piece long, size int, starts array<int>")


def _shards(batches, whole_keys: bool = True):
    """Rows (key, piece, bytes) as lists of about SHARD bytes; of whole keys where the rows are sorted by key."""
    rows, held = [], 0
    for batch in batches:
        for key, piece, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if held > SHARD and (rows[-1][0] != key or not whole_keys):
                yield rows
                rows, held = [], 0
            rows.append((key, piece, text))
            held += len(text) + 1
    if rows:
        yield rows


def _spans(flags: np.ndarray) -> list[dict]:
    """Runs of True as first and last place."""
    edge = np.flatnonzero(np.diff(flags.view(np.int8), prepend=0, append=0))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_SPAN_ROWS = "key long, piece long, spans array<struct<a:int,b:int>>"


def sort_shards(cut: DataFrame) -> DataFrame:
    """key, piece and the repeated windows in it, for rows (key, piece, bytes) of different pieces."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(_SPAN_ROWS))

    def run(batches):
        for rows in _shards(batches):
            text = np.frombuffer(b"".join(t + b"\xff" for _, _, t in rows), np.uint8)
            ends = np.cumsum([len(t) + 1 for _, _, t in rows])
            repeated = repeated_starts(text)
            found = []
            for (key, piece, t), end in zip(rows, ends.tolist(), strict=True):
                start = end - len(t) - 1
                if spans := _spans(repeated[start : start + len(t) - DEPTH + 1]):
                    found.append((key, piece, spans))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.select("key", "piece", "bytes").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(trimmed(run), _SPAN_ROWS)


def sort_hot(cut: DataFrame) -> DataFrame:
    """The same for keys with too many pieces for one shard: their pieces are dealt over shards, each sorted by itself.

    In a shard, suffixes that share DEPTH bytes stand next to each other, so each different window is told once, with a
    128-bit hash; windows that several shards tell are repeated as well. The shards are the pre-aggregation.
    """
    kind = "key long, piece long, spans array<struct<a:int,b:int>>, w1 long, w2 long, place int"

    def run(batches):
        for rows in _shards(batches, whole_keys=False):
            text = b"".join(t + b"\xff" for _, _, t in rows)
            size = np.array([len(t) + 1 for _, _, t in rows])
            first = np.cumsum(size) - size
            order, shared = (np.concatenate(x) for x in zip(*sorted_suffixes(np.frombuffer(text, np.uint8)), strict=True))
            new = shared < DEPTH
            new[0] = True
            run_of = np.cumsum(new) - 1
            many = np.bincount(run_of) > 1
            repeated = np.zeros(len(text), bool)
            repeated[order[many[run_of]]] = True
            row_of = np.searchsorted(first, order[new], "right") - 1
            at = order[new] - first[row_of]
            told = at + DEPTH < size[row_of]  # the separator is no part of a window
            keys, pieces_ = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
            for s in range(0, int(told.sum()), 200_000):
                own = np.flatnonzero(told)[s : s + 200_000]
                starts = order[new][own].tolist()
                digest = xxhash.xxh3_128_digest
                pair = np.frombuffer(b"".join(digest(text[a : a + DEPTH]) for a in starts), ">i8").reshape(-1, 2).astype(np.int64)
                none = [None] * len(own)
                yield {"key": keys[row_of[own]], "piece": pieces_[row_of[own]], "spans": none, "w1": pair[:, 0], "w2": pair[:, 1], "place": pa.array(at[own].astype(np.int32), mask=many[own])}
            found = [(k, p, _spans(repeated[a : a + len(t) - DEPTH + 1])) for (k, p, t), a in zip(rows, first.tolist(), strict=True)]
            found = [f for f in found if f[2]]
            none = [None] * len(found)
            yield {"key": [f[0] for f in found], "piece": [f[1] for f in found], "spans": [f[2] for f in found], "w1": none, "w2": none, "place": none}

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(kind))

    def batches_of(batches):
        for made in run(batches):
            yield pa.RecordBatch.from_arrays([made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = materialize(cut.select("key", "piece", "bytes").repartition(parts, "key", "piece").mapInArrow(trimmed(batches_of), kind), "hot-windows")
    windows = told.where("spans is null")
    across = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    lone = windows.where("place is not null").join(across, ["w1", "w2"]).select("key", "piece", F.array(F.struct(F.col("place").alias("a"), F.col("place").alias("b"))).alias("spans"))
    every = told.where("spans is not null").select("key", "piece", "spans").unionByName(lone)
    return every.groupBy("key", "piece").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """h1, h2, found: the repeated windows of every text that has any, as longs of first and last (32 bits each)."""
    every = materialize(all_pieces(docs), "pieces")
    keys = every.groupBy("key").agg(F.sum(F.size("starts")).alias("n"), (F.min("piece") != F.max("piece")).alias("mixed")).where("n > 1")
    keys = materialize(keys.select("key", "mixed", "n"), "shared-keys")
    shared = materialize(skew_join(every, keys, ["key"]).drop("n"), "shared-pieces")
    discard(every)
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("size") - 1).alias("b")))

    place = F.struct("h1", "h2", F.col("starts")[0].alias("start"), "size")
    different = materialize(shared.where("mixed").groupBy("key", "piece").agg(F.sum(F.size("starts")).alias("n"), F.min(place).alias("place")), "different-pieces")
    hot = different.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key")
    cut = materialize(cut_pieces(docs, different), "cut-pieces")
    spread = sort_shards(cut.join(hot, "key", "left_anti")).unionByName(sort_hot(cut.join(hot, "key", "left_semi")))
    twice = different.where("n > 1").select("key", "piece", F.array(F.struct(F.lit(0).alias("a"), (F.col("place.size") - 1).alias("b"))).alias("spans"))
    spans = materialize(spread.join(twice, ["key", "piece"], "left_anti").unionByName(twice), "spans")

    mixed = shared.where("mixed").join(spans, ["key", "piece"]).select("h1", "h2", "starts", "spans")
    same = shared.where("not mixed").select("h1", "h2", "starts", whole.alias("spans"))
    pack = lambda s, x: F.shiftleft((s + x["a"]).cast("long"), 32) + (s + x["b"])
    each = F.flatten(F.transform("starts", lambda s: F.transform("spans", lambda x: pack(s, x)))).alias("each")
    found = mixed.unionByName(same).select("h1", "h2", each).groupBy("h1", "h2").agg(F.flatten(F.collect_set("each")).alias("found"))
    # written, so that adaptive execution may split the join with the texts where a third of them are copies of one
    made = materialize(found, "repeated-windows")
    for spent in (shared, different, cut, spans):
        discard(spent)
    return made


def cut_pieces(docs: DataFrame, different: DataFrame) -> DataFrame:
    """key, piece, bytes of the pieces at the given places."""
    # written first, so that adaptive execution may split the join where many rows have one text
    wanted = materialize(different.groupBy("place.h1", "place.h2").agg(F.collect_list(F.struct("key", "piece", "place.start", "place.size")).alias("wanted")), "wanted-pieces")
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *text_key(F.col("text").cast("string")))
    # a text that stands twice is cut twice; its pieces are the same
    found = texts.join(wanted, ["h1", "h2"]).select("text", "wanted")

    def run(batch):
        out = {c: [] for c in ("key", "piece", "bytes")}
        for text, rows in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            for r in rows:
                out["key"].append(r["key"])
                out["piece"].append(r["piece"])
                out["bytes"].append(text[r["start"] : r["start"] + r["size"] - 1 + DEPTH])
        return out

    return map_arrow(found, run, "key long, piece long, bytes binary").dropDuplicates(["key", "piece"])


def remove_repeats(docs: DataFrame, found: DataFrame, as_text: bool = False) -> DataFrame:
    """All columns of docs and kept (binary), n_bytes, n_removed, spans of bytes removed.

    As text, kept is a string without bytes that are no whole character.
    """
    names = docs.columns
    h1, h2, f1, f2, own = (free_name(docs, c) for c in ("_h1", "_h2", "_f1", "_f2", "_found"))
    tagged = docs.withColumns(dict(zip((h1, h2), text_key(F.col("text").cast("string")), strict=True)))
    named = found.select(F.col("h1").alias(f1), F.col("h2").alias(f2), F.col("found").alias(own))
    joined = tagged.join(named, (F.col(h1) == F.col(f1)) & (F.col(h2) == F.col(f2)), "left")
    at = names.index("text")
    result = f"_kept {'string' if as_text else 'binary'}, _n_bytes long, _n_removed long, _spans array<struct<a:int,b:int>>"
    schema = joined.select(*names).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType(schema.fields + _parse_datatype_string(result).fields)
    arrow = to_arrow_schema(schema)
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            column = batch.column(len(names))
            for k, text in enumerate(utf8(batch.column(at))):
                if not column[k].is_valid:
                    rows.append((text, len(text), 0, []))
                    continue
                found = column[k].values.to_numpy()
                step = np.zeros(len(text) + 1, np.int64)
                np.add.at(step, found >> 32, 1)
                np.add.at(step, (found & 0xFFFFFFFF) + DEPTH, -1)
                gone = np.cumsum(step)[: len(text)] > 0
                spans = _spans(gone)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
                rows.append((kept, len(text), len(text) - len(kept), [{"a": s["a"], "b": s["b"] + 1} for s in spans]))
            if as_text:
                rows = [(kept.decode(errors="ignore"), *rest) for kept, *rest in rows]
            made = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *[pa.array(list(c), arrow.field(len(names) + k).type) for k, c in enumerate(made)]], schema=arrow)

    return joined.select(*names, own).mapInArrow(trimmed(run), schema)


def op4_suffix_array(spark, sf_dir: str) -> DataFrame:
    """What suffix-array dedup removes from every whole text of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = remove_repeats(docs, repeated_windows(docs))
    return done.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.size("_spans").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"), F.to_json("_spans").alias("spans"))


def drop_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without the repeated bytes (a character cut in two goes whole); no row is dropped."""
    names = docs.columns
    # cut to characters where it is made: a Python function after another would take a worker more for each task
    done = remove_repeats(docs, repeated_windows(docs), as_text=True)
    kept = F.when(F.col("_n_removed") == 0, F.col("text")).otherwise(F.col("_kept"))
    return done.withColumn("text", kept).withColumn("n_chars", F.length("text").cast("long")).select(*names)
