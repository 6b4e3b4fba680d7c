import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftlens.llm import line_dedup as L
from driftlens.llm import mixing as M
from driftlens.llm import token_counts as K
from driftlens.llm.common import free_name, skew_join


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        rest, w = total - sum(capped.values()), sum(weight[s] for s in free)
        out = capped | {s: rest * weight[s] / w for s in free}
        over = {s: 3 * sizes[s] for s in free if out[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return out
        capped |= over


def test_targets_stop_at_three_times_the_source():
    rng = random.Random(2)
    for _ in range(50):
        sizes = {s: rng.choice([0, 1, 10, 1000, 50_000]) for s in ["b", "a", "é", "", None, "z"][: rng.randrange(1, 7)]}
        want = brute_targets(sizes)
        assert M.targets(sizes) == pytest.approx(want)
        assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    size = rng.integers(0, 500, 1000)
    p = np.full(1000, 0.37)
    out = M.flight(p, size, rng)
    undecided = (out > 1e-9) & (out < 1 - 1e-9)
    assert undecided.sum() <= 2
    assert out.sum() == pytest.approx(370) and (out * size).sum() == pytest.approx(0.37 * size.sum())
    landed = M.landing(out, size)
    assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - 0.37 * size.sum()) < 60
    means = np.mean([M.flight(np.full(9, 1 / 3), np.arange(9), np.random.default_rng(k)) for k in range(600)], 0)
    assert means == pytest.approx(1 / 3, abs=0.08)


@pytest.mark.parametrize("block", [8, 4_096])
def test_mix(spark, block, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", block)
    rng = random.Random(7)
    docs = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 200])), rng.choice(["a", "b", "c", None])) for i in range(400)]
    docs += [(400 + i, "x y", "tiny") for i in range(2)] + [(500, None, "tiny"), (501, None, "void"), (0, docs[0][1], docs[0][2])]
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, source string, size int")
    rows = M.mix(df).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in docs)
    taken, source = Counter(), Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        source[r.source] += r.size
    want = brute_targets({s: source[s] for s in ["a", "b", "c", "tiny", "void", None]})
    for r in rows:
        assert r.source_size == source[r.source] and r.target == pytest.approx(want[r.source])
        assert abs(taken[r.source] - r.target) <= (200 if block == 8 else max(2, 0.01 * r.target))
    assert sorted(map(tuple, M.mix(df.repartition(3)).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert M.mix(df.limit(0)).count() == 0


def test_equal_rows_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 64)
    monkeypatch.setattr(M, "NUMBERED", 100)
    rows = [(7, "same words here", "hot")] * 900 + [(k, "w " * (k % 9), "b") for k in range(300)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    numbered = M.numbered(M.document_sizes(df))
    assert sorted(r.k for r in numbered.where("doc_id = 7 and source = 'hot'").collect()) == list(range(900))
    mixed = M.mix(df)
    found = Counter((r.doc_id, r.source) for r in mixed.collect())
    assert found[7, "hot"] == 900 and found.total() == 1201
    taken = mixed.groupBy("source").agg({"taken": "sum", "target": "first"}).collect()
    assert all(abs(r[1] - r[2]) <= 30 for r in taken if r.source in ("hot", "b"))


def test_mix_stage_keeps_documents(spark):
    rows = [(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (1, "c", "en", "s", 1), (None, None, None, None, None), (2, "d e f", "de", "t", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int").withColumnRenamed("size", "_H1")
    out = M.mix_sources(spark, df, "")
    assert out.columns == ["doc_id", "text", "lang", "source", "_H1", "size", "source_size", "target", "taken", "copies"]
    got = {(r.doc_id, r.text): r for r in out.collect()}
    assert set(got) == {(1, "a b"), (1, "c"), (None, None), (2, "d e f")} and got[1, "a b"].lang == "en"
    assert all(r.taken == r.size * r.copies for r in got.values()) and got[1, "a b"].copies <= 6
    assert M.mix_sources(spark, df.limit(0), "").count() == 0


def brute_lines(rows, min_bytes):
    """(doc_id, kept text, units, removed units, spans) of rows (doc_id, text), each distinct row once."""
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode()) ^ 1 << 63))
    seen, out = set(), {}
    for doc_id, text in rows:
        text = text or ""
        units = [u for u in re.findall(r"(?s)[^.,;:!?\n]*(?:[.,;:!?\n][.,;:!?\s]*|$)", text) if u]
        again = []
        for u in units:
            words = " ".join("".join(c.lower() if c.isascii() else c for c in u).split())
            again.append(len(words.encode()) if words and words in seen else 0)
            seen |= {words} if words else set()
        gone, k = set(), 0
        while k < len(units):
            n = k
            while n < len(units) and again[n]:
                n += 1
            gone |= set(range(k, n)) if sum(again[k:n]) >= min_bytes else set()
            k = n + 1
        at, spans = 0, []
        for j, u in enumerate(units):
            n = len(u.encode())
            if j in gone:
                spans = [*spans[:-1], (spans[-1][0], at + n)] if spans and j - 1 in gone else [*spans, (at, at + n)]
            at += n
        out[doc_id, text] = ("".join(u for j, u in enumerate(units) if j not in gone), len(units), len(gone), spans)
    return out


@pytest.mark.parametrize("least", [1, 40, L.MIN_BYTES])
def test_line_dedup(spark, least):
    rng = random.Random(5)
    clause = lambda: " ".join("".join(rng.choices("abcé XY", k=rng.randrange(1, 9))).strip() or "a" for _ in range(rng.randrange(1, 12)))
    text = lambda n: "".join(clause() + rng.choice([". ", "\n", "; ", ",", "!? ", "\n\n"]) for _ in range(n))
    passage, lines = text(14), [clause() for _ in range(5)]
    rows = [(1, passage), (2, text(3) + passage + text(2)), (3, None), (4, ""), (5, "x " + passage.upper() + "z"), (6, passage[9:-7]), (7, passage + passage)]
    rows += [(k, text(4) + rng.choice(lines) + "\n" + text(rng.randrange(5))) for k in range(10, 40)] + [(10, "another text\n" + passage), (None, "null id"), (50, "。".join(["长" * 70, "b", "长" * 70, "b"]))]
    rows += [rows[1], (1, passage), (60, passage * 300)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, row string")
    got = sorted((r.doc_id or 0, r.kept_text, r.n_units, r.n_removed, [tuple(s) for s in r.spans]) for r in L.dedup_lines(df, least).collect())
    want = brute_lines([(i, t) for i, t in rows if i != 50], least)
    assert [g for g in got if g[0] != 50] == sorted((i or 0, *want[i, t or ""]) for i, t in rows if i != 50)
    # a script without spaces: a sentence of one word goes like any other
    assert [g[1:] for g in got if g[0] == 50] == [("长" * 70 + "。b。b", 4, 1, [(217, 430)])]
    assert L.dedup_lines(df.limit(0), least).count() == 0


def test_lone_repeated_lines_are_reported(spark):
    line = "this line of a hundred bytes stands alone in each of fifty documents and is no passage of its own "
    rows = [(k, f"start of {k}\n{line}\nend of {k}") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.n_repeated, r.n_removed) for r in L.dedup_lines(df).collect()) == [(0, 0)] + [(1, 0)] * 49
    got = {r.doc_id: r.kept_text for r in L.dedup_lines(df, 0).collect()}
    assert got[0] == rows[0][1] and all(got[k] == f"start of {k}\nend of {k}" for k in range(1, 50))


def test_hot_keys_meet_without_one_task(spark):
    rows = spark.range(1000).selectExpr("if(id % 3 = 0, 7, id % 50) as k", "id")
    groups = rows.groupBy("k").count().withColumnRenamed("count", "n").cache()
    assert sorted(map(tuple, skew_join(rows, groups, ["k"], most=9).collect())) == sorted(map(tuple, rows.join(groups, "k").collect()))
    assert free_name(rows, "ID") == "ID_" and free_name(rows, "x") == "x"
    assert skew_join(rows.limit(0), groups.limit(0), ["k"]).count() == 0


def test_rollup_adds_signed_batches_once(spark, tmp_path):
    schema = "op string, doc_id long, source string, lang string, text string"
    load = spark.createDataFrame([("insert", 1, "s", "en", "a b c"), ("insert", 2, "s", "en", "d"), ("insert", 3, None, None, None), ("insert", 3, None, None, None)], schema)
    change = spark.createDataFrame([("delete", 2, "s", "en", "d"), ("revise_from", 1, "s", "en", "a b c"), ("revise_to", 1, "s", "en", "a b c é")], schema)
    rollup = K.Rollup(spark, f"file://{tmp_path}/rollup")
    assert rollup.totals().count() == 0
    assert rollup.commit("load", load) and not rollup.commit("load", load) and rollup.commit("change", change)
    assert rollup.commit("nothing", load.limit(0))
    got = {(r.source, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}
    assert got["s", "words-1"] == (1, 4) and got["s", "bytes-1"] == (1, 8) and got[None, "words-1"] == (2, 0)
    import tiktoken

    e = tiktoken.Encoding("t", pat_str=K.PATTERN, mergeable_ranks=K.read_ranks(K.VOCABULARY), special_tokens={})
    assert got["s", K.bpe_version(K.VOCABULARY)] == (1, len(e.encode_ordinary("a b c é")))
    assert rollup.committed() == ["change", "load", "nothing"]
    with pytest.raises(Exception, match="unknown op: upsert"):
        rollup.commit("odd", spark.createDataFrame([("upsert", 1, "s", "en", "a")], schema))
    assert rollup.committed() == ["change", "load", "nothing"]
    # a very long text, and columns with names of the rollup's own
    wide = spark.createDataFrame([("insert", 9, "z", "en", "a " * 300_000, 5)], schema + ", docs int").withColumn("sign", F.lit(3))
    assert rollup.commit("wide", wide, None)
    assert {r.tokenizer: r.tokens for r in rollup.totals().where("source = 'z'").collect()} == {"words-1": 300_000, "bytes-1": 600_000}


def test_versions_are_named_by_their_ranks(spark, tmp_path):
    import base64

    small = [(bytes([b]), b) for b in range(256)]
    write = lambda name, ranks: tmp_path.joinpath(name).write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in ranks)) and str(tmp_path / name)
    one, same, other = write("a", small), write("b", small[::-1]), write("c", [*small, (b"ab", 256)])
    assert K.bpe_version(one) == K.bpe_version(same) != K.bpe_version(other)
    rows = spark.createDataFrame([("insert", 1, "s", "en", "abab")], "op string, doc_id long, source string, lang string, text string")
    rollup = K.Rollup(spark, f"file://{tmp_path}/rollup")
    for k, path in enumerate((one, same, other)):
        assert rollup.commit(str(k), rows, path)
    got = {r.tokenizer: r.tokens for r in rollup.totals().collect()}
    assert got == {"words-1": 3, "bytes-1": 12, K.bpe_version(one): 8, K.bpe_version(other): 2}


def test_compaction_keeps_totals_and_ids(spark, tmp_path):
    rows = spark.createDataFrame([("insert", 1, "s", "en", "a b")], "op string, doc_id long, source string, lang string, text string")
    rollup = K.Rollup(spark, f"file://{tmp_path}/rollup")
    totals = lambda: sorted(map(tuple, rollup.totals().collect()))
    folders = lambda: sorted(p.name for p in tmp_path.joinpath("rollup").iterdir())
    rollup.compact()
    assert totals() == [] and rollup.committed() == []
    for k in range(3):
        assert rollup.commit(f"b{k}", rows, None)
        before = totals()
        rollup.compact()
        assert totals() == before and rollup.committed() == [f"b{j}" for j in range(k + 1)]
    assert not rollup.commit("b0", rows, None) and not rollup.commit("b2", rows, None)
    assert folders() == ["batch=b2", "snapshot=000000000003", "snapshot=000000000004"]
    # the deletion of a batch that only the snapshot holds
    assert rollup.commit("undo", rows.withColumn("op", F.lit("delete")), None) and totals() == [("s", "en", "bytes-1", 2, 6), ("s", "en", "words-1", 2, 4)]


def test_of_two_writers_one_commits(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("insert", 1, "s", "en", "a b")], "op string, doc_id long, source string, lang string, text string")
    first, second = (K.Rollup(spark, f"file://{tmp_path}/rollup") for _ in range(2))
    count, told = K.count_tokens, []

    def meanwhile(changes, vocabulary):
        if not told:
            told.append(None)
            told[0] = second.commit("b", changes, vocabulary)
        return count(changes, vocabulary)

    monkeypatch.setattr(K, "count_tokens", meanwhile)
    assert not first.commit("b", rows, None) and told == [True]
    # where both pass the look, the rename nests the later one, which is told so and takes its files back
    fs, asked = first._fs, []

    class Late:
        def exists(self, path):
            return not asked.append(path) and len(asked) > 2 and fs.exists(path)

        def __getattr__(self, name):
            return getattr(fs, name)

    first._fs = Late()
    assert not first.commit("b", rows, None)
    assert {r.tokenizer: r.tokens for r in second.totals().collect()} == {"words-1": 2, "bytes-1": 3}
    assert sorted(p.name for p in tmp_path.joinpath("rollup").iterdir()) == ["batch=b"]


def test_registered_corpus_queries(spark, tmp_path):
    rows = [(1, "a b\n\nc", "en", "s"), (2, "d", "en", "s"), (3, None, None, None), (4, "e f g", "en", "t")]
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (2, 1, 1), (4, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r.source, r.tokenizer): (r.docs, r.tokens) for r in K.op5_token_counts(spark, str(tmp_path)).collect()}
    assert got["s", "words-1"] == (1, 3) and got["s", "bytes-1"] == (1, 5) and got["t", "bytes-1"] == (0, 0) and got[None, "bytes-1"] == (1, 0)
    assert ("s", K.bpe_version(K.VOCABULARY)) in got and len(got) == 9
    mixed = M.op6_mixing(spark, str(tmp_path))
    assert mixed.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"] and mixed.count() == 4
    lines = L.op9_line_dedup(spark, str(tmp_path))
    assert {r.doc_id: (r.n_units, r.n_removed, r.spans) for r in lines.collect()} == {1: (2, 0, "[]"), 2: (1, 0, "[]"), 3: (0, 0, "[]"), 4: (1, 0, "[]")}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    text = lambda n: " ".join(word() for _ in range(n))
    item, passage = text(30), text(60)
    docs = [(i, text(60) + (" you idiot scum moron" if i % 4 == 0 else ""), "en", f"s{i % 3}") for i in range(160)]
    clean = [d for d in docs if d[0] % 4]
    docs += [(1000, clean[0][1], "en", "s0"), (1001, clean[1][1] + " " + word(), "en", "s1")]
    docs += [(1100 + k, text(40) + "\n" + passage + "\n" + text(40), "en", "s2") for k in range(2)]
    docs += [(1200, text(20) + " " + item.upper() + " " + text(20), "en", "s0")]
    df = spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], int("idiot" in d[1])) for d in docs if d[0] < 1000], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[:5] == df.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert {d[0] for d in clean} <= set(rows) and not any(i < 160 and i % 4 == 0 for i in rows)
    assert not {1000, 1001, 1200} & set(rows)
    assert {1100, 1101} <= set(rows) and all(rows[i].size in range(78, 84) for i in (1100, 1101))
    assert sum(r.taken for r in rows.values()) > 0


def test_pipeline_over_odd_rows(spark, tmp_path):
    """Null and empty texts, null ids, repeated rows, columns with names of the stages' own; and empty tables."""
    import corpus_pipeline

    rows = [(1, None, "en", "s"), (2, "", None, None), (None, "", "en", "s"), (None, "one two three", "en", "s"), (4, "four five six seven eight nine", "en", "t"), (4, "four five six seven eight nine", "en", "t"), (4, "another text", "en", "t")]
    df = spark.createDataFrame([(*r, 0, 1, "x", 2, "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _h1 int, _row string, h1 int, found string")
    labels = spark.createDataFrame([(4, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    items = spark.createDataFrame([(7, None), (8, "")], "item_id long, text string")
    for name, tables in (("odd", (df, labels, items)), ("empty", (df.limit(0), labels.limit(0), items.limit(0)))):
        for table, made in zip(("documents", "labels", "benchmark"), tables, strict=True):
            made.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    assert out.columns == [*df.columns, "size", "source_size", "target", "taken", "copies"]
    got = sorted(((r.doc_id or 0, r.text or "", r._h1, r._row, r.h1, r.found) for r in out.collect()))
    # all texts without a word are copies of each other; two texts under one id are two documents
    assert got == [(0, "one two three", 1, "x", 2, "y"), (1, "", 1, "x", 2, "y"), (4, "another text", 1, "x", 2, "y"), (4, "four five six seven eight nine", 1, "x", 2, "y")]
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
