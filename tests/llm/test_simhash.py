import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftlens.llm import components as components_module
from driftlens.llm.components import components
from driftlens.llm import simhash
from driftlens.llm.simhash import GrayIndex, block_masks, fingerprints, gray_rank, group_fingerprints, keep_first_of_groups, link_within, majority, near_duplicates, shingle_hashes


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(nodes, 2):
            if linked(a, b) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {n: low if x == high else x for n, x in label.items()}
                changed = True
    return label


@pytest.mark.parametrize("text", ["", " \n\t ", "One", "one two", "A b  c\x0bd", "É é à b c D", "x y z " * 50])
def test_fingerprint(text):
    assert majority(shingle_hashes(text.encode(), 3)) == brute_fingerprint(text)


def test_gray_rank_orders_the_gray_sequence():
    n = np.arange(1000, dtype=np.uint64)
    assert (gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_index_finds_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    near = np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(6)]])
    codes = np.unique(near)
    index = GrayIndex(codes)
    q, at = index.search(codes, 2)
    got = {(int(codes[a]), int(index.codes[b])) for a, b in zip(q, at, strict=True)}
    want = {(int(a), int(b)) for a in codes for b in codes if int(a ^ b).bit_count() <= 2}
    assert got == want
    root = index.forest(2)
    label = brute_components(range(len(codes)), lambda a, b: int(codes[a] ^ codes[b]).bit_count() <= 2)
    assert {frozenset(np.flatnonzero(root == r).tolist()) for r in set(root.tolist())} == {frozenset(k for k, x in label.items() if x == v) for v in set(label.values())}


def test_masks_cover_the_radius():
    masks = block_masks()
    for a, b in itertools.combinations(range(64), 2):
        assert any(not m >> a & 1 and not m >> b & 1 for m in masks)
    assert all(m.bit_count() >= 42 for m in masks)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (-5, -9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {n for n, r in got.items() if r == 0} == set(range(1, 61))
    assert all(got[k] == 100 for k in range(101, 140)) and got[-5] == -9
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def tables_written(monkeypatch) -> list[str]:
    tags = []
    for module in (simhash, components_module):
        monkeypatch.setattr(module, "materialize", lambda df, tag, own=module.materialize: (tags.append(tag), own(df, tag))[1])
    return tags


def test_components_of_stars_take_no_round(spark, monkeypatch):
    tags = tables_written(monkeypatch)
    stars = [(k, 5) for k in range(6, 400)] + [(1000, 1001), (1002, 1000), (-5, -9)]
    first = components(spark.createDataFrame(stars, "u long, v long"))
    assert {r.node: r.root for r in first.collect()} == {k: 5 for k in range(6, 400)} | {1001: 1000, 1002: 1000, -5: -9}
    assert tags == ["edges"]
    more = spark.createDataFrame([(399, 1002), (-5, 2000)], "u long, v long")
    again = {r.node: r.root for r in components(first.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)).collect()}
    assert again == {k: 5 for k in [*range(6, 400), 1000, 1001, 1002]} | {-5: -9, 2000: -9}


def test_near_duplicates_write_little_where_nothing_is_left(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    base = [" ".join(rng.choices(words, k=300)) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(base + [t + " other" for t in base])), "doc_id long, text string")
    tags = tables_written(monkeypatch)
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == {i: i % 12 for i in range(24)}
    assert "stars" not in tags and tags.count("labels") == 1 and tags.count("sets") == 1


def test_groups_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 5, 40]))) for _ in range(60)]
    texts += [t + " w1" for t in texts[:20]] + texts[:10] + ["", None, " "]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    rows = {r.doc_id: r for r in group_fingerprints(fingerprints(df)).collect()}
    fps = {i: brute_fingerprint(t or "") for i, t in enumerate(texts)}
    assert {i: r.fp & (1 << 64) - 1 for i, r in rows.items()} == fps
    assert {i: r.component_id for i, r in rows.items()} == brute_components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)


def test_dense_group_is_not_expanded(spark):
    rng = np.random.default_rng(5)
    codes = np.unique(np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)))
    df = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
    edges = link_within(df)
    assert edges.count() <= 15 * len(codes)
    assert components(edges).select("root").distinct().count() == 1


def test_near_duplicates(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choices(words, k=rng.choice([30, 120, 400])) for _ in range(80)]
    texts, group = [], []
    for g, w in enumerate(base):
        texts.append(" ".join(w))
        group.append(g)
        if g % 2 == 0:  # a near copy: one word in eighty, at least one
            c = list(w)
            for _ in range(max(1, len(w) // 100)):
                c[rng.randrange(5, len(c))] = "other"
            texts.append("  ".join(c).upper())
            group.append(g)
    sets = [{h for h in shingle_hashes(t.encode(), 5).tolist()} for t in texts]
    label = brute_components(range(len(texts)), lambda a, b: group[a] == group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(900, None, 1), (901, "", 1), (902, " ", 1), (902, " ", 1), (0, texts[0], 1)], "doc_id long, text string, row int")
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    assert {i: got[i] for i in label} == label
    assert got[900] == got[901] == got[902] == 900
    kept = keep_first_of_groups(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*label.values(), 900})
    assert keep_first_of_groups(spark, df.limit(0), "").count() == 0


def test_near_duplicates_are_complete_in_a_templated_family(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 40, raising=False)
    rng = random.Random(17)
    words = [f"w{i}" for i in range(3000)]
    page, other = rng.choices(words, k=176), rng.choices(words, k=160)
    texts = []
    for k in range(400):  # pages of a template, any two of similarity 0.78; every tenth has one partner of 0.81
        own = rng.choices(words, k=24)
        texts.append(" ".join(page + own))
        if k % 10 == 0:
            texts.append(" ".join(page + own[:3] + rng.choices(words, k=21)))
    for k in range(150):  # versions of another page at places that drift apart, linked in steps
        w = other[:]
        w[k % 50 * 2 : k % 50 * 2 + 20] = rng.choices(words, k=20)
        texts.append(" ".join(w))
    sets = [set(shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    linked = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    label = brute_components(range(len(texts)), lambda a, b: (a, b) in linked)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    print("pairs met", sum(got[a] == got[b] for a, b in linked), "of", len(linked), "in the family", sum(got[a] == got[b] for a, b in linked if b < 440))
    assert got == label
    assert sum(b < 440 for _, b in linked) == 40


def test_registered_query(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choices("abcDé", k=3)) for _ in range(n))
    rows = [(100 - k, text(rng.choice([1, 2, 3, 40]))) for k in range(40)] + [(200, None), (201, ""), (202, " \t\n"), (None, text(9)), (203, text(60_000))]
    rows += [(300 + k, rows[4][1]) for k in range(15)] + [rows[2], (7, rows[2][1].upper().replace("É", "é"))]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, component_id int").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = simhash.op1_simhash(spark, str(tmp_path))
    assert got.dtypes[:3] == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    codes = [brute_fingerprint(t or "") for _, t in rows]
    least = dict.fromkeys(range(len(rows)))
    for a in range(len(rows)):
        if least[a] is None:
            group, open_ = {a}, [a]
            while open_:
                x = open_.pop()
                near = [b for b in range(len(rows)) if b not in group and (codes[x] ^ codes[b]).bit_count() <= 2]
                group.update(near)
                open_ += near
            least |= dict.fromkeys(group, min((rows[b][0] for b in group if rows[b][0] is not None), default=None))
    want = [(r[0], f"{codes[k]:016x}", least[k]) for k, r in enumerate(rows)]
    assert sorted((tuple(r)[:3] for r in got.collect()), key=repr) == sorted(want, key=repr)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert simhash.op1_simhash(spark, f"{tmp_path}/none").collect() == []


def test_near_duplicates_come_by_fingerprints_first(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(900)]
    base = [rng.choices(words, k=600) for _ in range(12)]
    texts = [" ".join(w) for w in base] + [" ".join([*w[:-1], "other"]) for w in base]
    # fingerprints agree where one shingle stands in most places, sets need not: the exact check parts these
    texts += ["same " * 3000 + " ".join(rng.choices(words, k=200)) for _ in range(2)]
    codes = [brute_fingerprint(t) for t in texts]
    linked = brute_components(range(len(texts)), lambda a, b: (codes[a] ^ codes[b]).bit_count() <= 2)
    assert sum(linked[12 + k] == k for k in range(12)) > 0 and linked[25] == 24
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = simhash.signatures(df, 5).where("chunk is null").select("doc_id", "node", "fp").toPandas()
    assert [c & (1 << 64) - 1 for c in found.sort_values("doc_id").fp] == codes
    node = dict(zip(found.doc_id, found.node, strict=True))
    pairs = {frozenset((r.u, r.v)) for r in simhash.fingerprint_pairs(spark.createDataFrame(found[["node", "fp"]])).collect()}
    assert brute_components(range(len(texts)), lambda a, b: frozenset((node[a], node[b])) in pairs) == linked
    # without the join of sets, what the fingerprints link and the check confirms is still found
    none = spark.createDataFrame([], "u long, v long")
    monkeypatch.setattr(simhash, "chained_pairs", lambda *a: none)
    monkeypatch.setattr(simhash, "remaining_pairs", lambda *a: none)
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    assert got == {**linked, 25: 25}
