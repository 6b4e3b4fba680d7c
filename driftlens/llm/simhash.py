"""SimHash near-dedup with a Gray-order hierarchical index.

``fingerprints`` makes a 64-bit SimHash of every whole text. ``link_within`` finds all links of distinct fingerprints
at up to ``radius`` differing bits: the 64 bits are cut into BLOCKS blocks, so two such fingerprints agree on at least
BLOCKS - radius of them; fingerprints meet in one group for every choice of that many blocks (at least 42 bits are
fixed with the defaults, so a group can't exceed 2 ** 22 fingerprints, whatever the data). Each group is searched with
``GrayIndex``: fingerprints sorted by Gray rank, the bits that all members of a node share factored into upper nodes,
and whole nodes pruned by the differences accumulated on the way down. A group returns a spanning forest of its
links, never all pairs, and ``components`` joins the forests.

``near_duplicates`` finds all texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Texts whose
fingerprints are linked are compared first (``fingerprint_pairs``); as similar sets may have distant fingerprints, an exact
set-similarity join finds what they leave. Shingles are ordered rarest first by counts over the whole corpus (in COUNTERS counters, so a
frequent shingle is never taken for a rare one; the order decides the work, not the result). Two similar sets share one
of their first ``size - need + 1`` shingles, and pairs are filtered by length, place and the parities of PARITIES groups
of shingles before the shingles decide. Sets that are neighbours in size under CHAINS keys (``common_keys``) come first;
whatever they join need not meet again, so that groups of near copies cost no square. A frequent key is dealt into cells of
CELL sets.

Null texts count as empty; all empty texts are copies of each other. Rows that repeat an id are rows like any other.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import LOWER, discard, free_name, map_arrow, materialize, skew_join, small_batches, table, trimmed, utf8
from driftlens.llm.components import components

BLOCKS, RADIUS, FAN = 6, 2, 8
COUNTERS, CHUNK, PARITIES, CELL, CHAINS = 1 << 22, 1 << 16, 512, 1000, 4
SUMMANDS = 256  # counter chunks of 256 kB that one group sums
_EMPTY = np.zeros(0, np.uint64)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of width words, repeats included; the whole sequence if it is shorter."""
    words = text.translate(LOWER).split()
    if not words:
        return _EMPTY
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :], strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 without any."""
    votes = np.zeros(64, np.int64)
    for s in range(0, len(hashes), 1 << 15):
        part = hashes[s : s + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) of every whole text."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(own, lambda b: {"doc_id": b.column(0), "fp": _signed([majority(shingle_hashes(t, width)) for t in utf8(b.column(1))])}, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence: the prefix parity of its bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over codes in Gray order; a node holds the bits its members share beyond its parent's."""

    def __init__(self, codes: np.ndarray, fan: int = FAN):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes, self.fan = codes[self.order], fan
        both, any_ = [self.codes], [self.codes]
        while len(both[-1]) > fan:
            cuts = np.arange(0, len(both[-1]), fan)
            both.append(np.bitwise_and.reduceat(both[-1], cuts))
            any_.append(np.bitwise_or.reduceat(any_[-1], cuts))
        shared = [~(a ^ o) for a, o in zip(both, any_, strict=True)]
        self.pattern, self.mask = [], []
        for level, (a, own) in enumerate(zip(both, shared, strict=True)):
            above = np.repeat(shared[level + 1], fan)[: len(own)] if level + 1 < len(shared) else np.zeros_like(own)
            self.pattern.append(a)
            self.mask.append(own & ~above)

    def spans(self, level: int) -> np.ndarray:
        return np.arange(0, len(self.codes), self.fan**level)

    def search(self, queries: np.ndarray, radius: int, skip=None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place in .codes) within radius. skip(level, query, node) marks pairs not worth following."""
        top = len(self.mask) - 1
        q, node = (x.ravel() for x in np.meshgrid(np.arange(len(queries)), np.arange(len(self.mask[top])), indexing="ij"))
        far = np.zeros(len(q), np.int64)
        for level in range(top, -1, -1):
            if level < top:
                q, far = np.repeat(q, self.fan), np.repeat(far, self.fan)
                node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                inside = node < len(self.mask[level])
                q, node, far = q[inside], node[inside], far[inside]
            far = far + np.bitwise_count((queries[q] ^ self.pattern[level][node]) & self.mask[level][node])
            near = far <= radius
            if skip is not None:
                near &= ~skip(level, q, node)
            q, node, far = q[near], node[near], far[near]
        return q, node

    def forest(self, radius: int, chunk: int = 512) -> np.ndarray:
        """For each of the codes given, the place of its component's representative under links within radius.

        A node whose members are all in the query's component already is not followed, so dense groups stay cheap.
        """
        n = len(self.codes)
        parent = np.arange(n)

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = int(parent[x])
            return x

        for s in range(0, n, chunk):
            while not (parent[parent] == parent).all():
                parent = parent[parent]
            label = parent
            low = [np.minimum.reduceat(label, self.spans(k)) for k in range(len(self.mask))]
            high = [np.maximum.reduceat(label, self.spans(k)) for k in range(len(self.mask))]
            own = label[s : s + chunk]
            q, node = self.search(self.codes[s : s + chunk], radius, lambda k, q, node, own=own, low=low, high=high: (low[k][node] == own[q]) & (high[k][node] == own[q]))
            for a, b in np.unique(np.stack([own[q], label[node]], 1), axis=0).tolist():
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        while not (parent[parent] == parent).all():
            parent = parent[parent]
        out = np.empty(n, np.int64)
        out[self.order] = self.order[parent]
        return out


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Masks of every choice of blocks - radius blocks of the 64 bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    each = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(c) for c in itertools.combinations(each, blocks - radius)]


def link_within(codes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Edges (u, v) of distinct codes (column fp) that span every component of links within radius."""
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(blocks, radius)]
    keyed = codes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    groups = keyed.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def run(batch):
        u, v = [], []
        for fps in batch.column(0):
            own = np.array(fps.values.to_numpy(), np.int64)
            root = GrayIndex(own.view(np.uint64)).forest(radius)
            linked = root != np.arange(len(own))
            u.append(own[linked])
            v.append(own[root[linked]])
        return {"u": np.concatenate(u), "v": np.concatenate(v)}

    return map_arrow(groups.select("fps"), run, "u long, v long").distinct()


def group_fingerprints(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for found (doc_id, fp), which should be materialised."""
    codes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    roots = components(link_within(codes.select("fp"), radius))
    placed = codes.join(roots, codes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.join(placed.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; links at two or fewer differing bits."""
    found = materialize(fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    return group_fingerprints(found).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similarity of shingle sets -------------------------------------------------------------------------------------


def text_row(text) -> F.Column:
    """A hash by which rows of one id and different texts are told apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes())


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row (hash of the text), node (hash of the shingle set), fp (fingerprint) of every text.

    Further rows, with a chunk, hold in counts how often the task's shingles fall into that chunk of COUNTERS counters.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        counters = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            nodes, codes = [], []
            for t in utf8(batch.column(1)):
                h = np.unique(shingle_hashes(t, width))
                nodes.append(_node(h))
                codes.append(majority(shingle_hashes(t, 3)))
                np.add.at(counters, h & np.uint64(COUNTERS - 1), 1)
            none = [None] * len(nodes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(_signed(nodes)), pa.array(_signed(codes)), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names)
        for k, part in enumerate(counters.reshape(-1, CHUNK)):
            if part.any():
                yield pa.RecordBatch.from_arrays([*[pa.array([None], pa.int64())] * 4, pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], names)

    names = ["doc_id", "row", "node", "fp", "chunk", "counts"]
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_row(F.col("text")).alias("row"))
    return own.mapInArrow(trimmed(run), "doc_id long, row long, node long, fp long, chunk int, counts binary")


def fingerprint_pairs(found: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of shingle sets that span the links of their fingerprints; found (node, fp).

    Sets of one fingerprint pair with the least of them, and the least of two fingerprints where ``link_within`` links these.
    """
    each = materialize(found.select("fp", "node").distinct(), "coded")
    codes = materialize(each.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "codes")
    same = skew_join(each, codes, ["fp"]).select(F.col("node").alias("u"), F.col("least").alias("v"))
    ends = [codes.select(F.col("fp").alias(k), F.col("least").alias(f"_{k}")) for k in ("u", "v")]
    linked = link_within(codes.select("fp")).join(ends[0], "u").join(ends[1], "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    return same.unionByName(linked).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def frequency_levels(found: DataFrame) -> np.ndarray:
    """A byte for each counter of the signatures: eight times the logarithm of the shingles counted there."""

    def run(batch):
        total = [np.sum([np.frombuffer(zlib.decompress(x.as_py()), np.uint32) for x in xs.values], axis=0, dtype=np.uint32) for xs in batch.column(1)]
        return {"chunk": batch.column(0), "counts": [zlib.compress(t.tobytes(), 1) for t in total]}

    counts = found.where("chunk is not null").select("chunk", "counts")
    # as many rows a chunk as tasks: summed in a tree, SUMMANDS of them at a time
    most = counts.groupBy("chunk").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    while True:
        most = max(1, math.ceil(most / SUMMANDS))
        grouped = counts.groupBy("chunk", F.pmod(F.xxhash64("counts"), F.lit(most)).alias("share")).agg(F.collect_list("counts").alias("counts"))
        counts = map_arrow(grouped.select("chunk", "counts"), run, "chunk int, counts binary")
        if most == 1:
            break
    levels = np.zeros((COUNTERS // CHUNK, CHUNK), np.uint8)
    for r in counts.toLocalIterator():
        levels[r.chunk] = np.minimum(255, 8 * np.log2(np.frombuffer(zlib.decompress(r.counts), np.uint32) + 1.0))
    return levels.ravel()


def prefixes(docs: DataFrame, width: int, similarity: float, levels: np.ndarray) -> DataFrame:
    """node, size, keys (the rarest shingles, of which two similar sets share one), bits (parities of the shingles)."""
    held = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batch):
        nodes, sizes, keys, bits = [], [], [], []
        for t in utf8(batch.column(0)):
            h = np.unique(shingle_hashes(t, width))
            if len(h):
                nodes.append(_node(h))
                sizes.append(len(h))
                order = np.lexsort((h, held.value[h & np.uint64(COUNTERS - 1)]))
                keys.append(h[order[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]].view(np.int64))
                bits.append(np.packbits(np.bincount((h >> np.uint64(32) & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1 == 1).tobytes())
        return {"node": _signed(nodes), "size": sizes, "keys": keys, "bits": bits}

    own = map_arrow(docs.select(F.col("text").cast("string")), run, "node long, size int, keys array<long>, bits binary")
    return own.groupBy("node").agg(F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))


def shared_keys(sets: DataFrame) -> DataFrame:
    """key, node, size, pos (the key's place among the set's), n: the prefix shingles that stand in n > 1 sets."""
    each = sets.select("node", "size", F.posexplode("keys").alias("pos", "key"))
    # written first, so that adaptive execution may split the join where one key is hot
    counts = materialize(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key-counts")
    return each.join(counts, "key").select("key", "node", "size", "pos", "n")


def _may_match(similarity: float, size_a, pos_a, size_b, pos_b) -> np.ndarray:
    """Length and positional filter: from the first shared shingle on, both sets hold as many as must be shared."""
    return np.minimum(size_a - pos_a, size_b - pos_b) >= _need(similarity, size_a, size_b)


def _need(similarity: float, size_a, size_b) -> np.ndarray:
    return np.ceil(similarity / (1 + similarity) * (size_a.astype(np.int64) + size_b) - 1e-9)


def _nearest(i: np.ndarray, j: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (i, j) those that are the nearest of either of their two."""
    order = np.lexsort((j, i, far))
    keep = np.union1d(*(order[np.unique(x[order], return_index=True)[1]] for x in (i, j)))
    return i[keep], j[keep], far[keep]


def _lists(*names: str) -> list[F.Column]:
    return [F.collect_list(k).alias(k) for k in names]


def common_keys(shared: DataFrame, most: int) -> DataFrame:
    """Of each set the rarest of those keys that half as many sets have as have its most frequent one, as rows of shared.

    Near copies differ in the keys that few have, and how many of the frequent ones a prefix reaches differs as well; the
    rarest of the frequent ones are common to all. A set has no more keys than its prefix is long.
    """
    held = shared.groupBy("node").agg(F.collect_list(F.struct("pos", "key", "size", "n")).alias("x"), F.max("n").alias("top"))
    chosen = F.slice(F.array_sort(F.filter("x", lambda x: 2 * x["n"] >= F.col("top"))), 1, most)
    return held.select("node", F.explode(chosen).alias("x")).select("x.key", "node", "x.size", "x.pos", "x.n")


def chained_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (u, v) of sets that are neighbours in size under one key: a pair a row, whatever the key's size."""

    def run(batch):
        group = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(0).offsets.to_numpy()))
        node, size, pos = (batch.column(k).flatten().to_numpy() for k in range(3))
        order = np.lexsort((node, size, group))
        group, node, size, pos = (x[order] for x in (group, node, size, pos))
        near = (group[1:] == group[:-1]) & _may_match(similarity, size[1:], pos[1:], size[:-1], pos[:-1])
        a, b = node[1:][near], node[:-1][near]
        return {"u": np.minimum(a, b), "v": np.maximum(a, b)}

    # a cell of its own under each key, so that chains under several keys join the cells
    cell = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / CELL)).alias("cell")
    groups = shared.groupBy("key", cell).agg(*_lists("node", "size", "pos"))
    return map_arrow(groups.select("node", "size", "pos"), run, "u long, v long").distinct()


def remaining_pairs(shared: DataFrame, labels: DataFrame, similarity: float, nearest: bool = False) -> DataFrame:
    """Distinct pairs (u, v) of sets with a common key and different roots (labels: node, root, bits) that may be similar.

    Keys whose sets all have one root are left out before anything is dealt. A key's sets are dealt into cells of about
    CELL, and any two cells meet in a group of their own. With nearest, a group
    tells of each of its sets only the one pair whose parities differ least: as many pairs as sets, not their square.
    """

    def run(batch):
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(batch.num_rows):
            root = batch.column(1)[k].values.to_numpy()
            if (root == root[0]).all():
                continue
            node, size, pos, own = (batch.column(c)[k].values.to_numpy() for c in (0, 2, 3, 5))
            bits = np.frombuffer(b"".join(batch.column(4)[k].values.to_pylist()), np.uint64).reshape(len(node), -1)
            low = own == own.min()
            left, right = (np.arange(len(node)),) * 2 if batch.column(6)[k].as_py() else (np.flatnonzero(low), np.flatnonzero(~low))
            told = []
            for s in range(0, len(left), 256):
                a, b = left[s : s + 256, None], right[None, :]
                near = (root[a] != root[b]) & _may_match(similarity, size[a], pos[a], size[b], pos[b])
                i, j = np.nonzero(near)
                i, j = left[s + i], right[j]
                # the parities that differ are no more than the shingles that only one of the sets has
                far = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
                near = far <= size[i].astype(np.int64) + size[j] - 2 * _need(similarity, size[i], size[j])
                i, j, far = i[near], j[near], far[near]
                if nearest:
                    i, j, far = _nearest(i, j, far)
                    told.append((i, j, far))
                    continue
                u.append(np.minimum(node[i], node[j]))
                v.append(np.maximum(node[i], node[j]))
            if told:
                i, j, _ = _nearest(*map(np.concatenate, zip(*told, strict=True)))
                u.append(np.minimum(node[i], node[j]))
                v.append(np.maximum(node[i], node[j]))
        made = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], 1), axis=0)
        return {"u": made[:, 0], "v": made[:, 1]}

    # written first, so that adaptive execution may split the joins where one key is hot
    labels = materialize(labels, "labels")
    mixed = shared.join(labels.select("node", "root"), "node").groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"))
    mixed = materialize(mixed.where("a <> b").select("key"), "mixed-keys")
    shared = shared.join(mixed, "key", "left_semi")
    cells = F.ceil(F.col("n") / CELL)
    placed = shared.join(labels, "node").withColumn("own", F.pmod(F.xxhash64("node"), cells))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1)))
    lists = ("node", "root", "size", "pos", "bits", "own")
    groups = placed.groupBy("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).agg(*_lists(*lists))
    return map_arrow(groups.select(*lists, (F.col("low") == F.col("high")).alias("one")), run, "u long, v long").distinct()


def shingle_sets(docs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """node, shingles (64 bits each) of one text for each node; rows (row, node) names the text by its hash."""
    texts = docs.select(F.col("text").cast("string").alias("text"), text_row(F.col("text")).alias("row")).join(rows, "row")

    def run(batch):
        sets = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in utf8(batch.column(1))]
        return {"node": batch.column(0), "shingles": sets}

    # copies of a text are dropped before they are cut into shingles
    return map_arrow(texts.groupBy("node").agg(F.first("text").alias("text")), run, "node long, shingles array<long>")


def verified_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets (node, shingles) have at least that Jaccard similarity."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))

    def run(batch):
        keep = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            a, b = a.values.to_numpy(), b.values.to_numpy()
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
        keep = np.array(keep)
        return {"u": batch.column(0).to_numpy()[keep], "v": batch.column(1).to_numpy()[keep]}

    return map_arrow(pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b"), run, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, row, component_id, root: texts linked by shingle sets of at least that similarity, directly or in steps.

    root tells groups apart; component_id, the least id in a group, may be that of several where an id has several texts.
    """
    made = materialize(signatures(docs, width), "signatures")
    found = made.where("chunk is null").select("doc_id", "row", "node")
    coded = made.where("chunk is null").select("node", "fp")
    prefixed = materialize(prefixes(docs, width, similarity, frequency_levels(made)), "prefixes")
    shared = materialize(shared_keys(prefixed), "shared-keys")

    def verified(pairs: DataFrame) -> DataFrame:
        touched = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        rows = found.join(touched, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))
        sets = materialize(shingle_sets(docs, rows, width), "sets")
        linked = materialize(verified_pairs(pairs, sets, similarity), "linked")
        discard(sets)
        return linked

    # links of fingerprints, chains under a few keys and the nearest of what they leave join nearly all of a group of near
    # copies at a few pairs a row; then only sets of different components meet
    first = fingerprint_pairs(coded).unionByName(chained_pairs(common_keys(shared, CHAINS), similarity)).distinct()
    roots = components(verified(materialize(first, "pairs")))
    for nearest in (True, False):
        labels = prefixed.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "bits")
        pairs = materialize(remaining_pairs(shared, labels, similarity, nearest), "pairs")
        # where no set has a nearest one left, none has any
        if pairs.isEmpty():
            break
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(verified(pairs)))
    discard(prefixed)
    discard(shared)
    nodes = found.groupBy("node").agg(F.min("doc_id").alias("least"))
    placed = materialize(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.join(placed.join(least, "root").select("node", "root", "component_id"), "node").select("doc_id", "row", "component_id", "root")


def keep_first_of_groups(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates, one row with the least id stays.

    Null and empty texts are one group, as are rows that repeat id and text; an empty table stays empty. Under one id
    different texts may stand; of those in one group the least text hash stays.
    """
    grouped = near_duplicates(docs)
    kept = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "component_id").agg(F.min("row").alias("row"))
    row = free_name(docs, "_row")
    tagged = docs.withColumn(row, text_row(F.col("text")))
    joined = tagged.join(kept, tagged.doc_id.eqNullSafe(kept.component_id) & (tagged[row] == kept.row), "left_semi")
    return joined.dropDuplicates(["doc_id", row]).select(*docs.columns)
