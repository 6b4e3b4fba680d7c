import gc
import random
import re
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from driftlens.llm import quality as Q
from driftlens.llm import toxicity as T
from driftlens.llm.common import trimmed
from driftlens.llm.words import Words, word_hash


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(400)]
    out = []
    for i in range(n):
        w = rng.choices(words, k=rng.randrange(0, 80))
        toxic = i % 3 == 0
        if toxic:
            w.insert(rng.randrange(len(w) + 1), rng.choice(["Idiot", "scum!", "moron"]))
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_words_of_a_batch():
    w = Words(["Ab cé,d".encode(), b"", b"  x"])
    assert w.counts().tolist() == [3, 0, 1] and w.doc.tolist() == [0, 0, 0, 2]
    assert [w.bytes[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)] == ["Ab", "cé", "d", "x"]
    assert int(w.hashes()[0]) == word_hash("AB") != word_hash("ba")
    assert Words([b"abcdef abcd"]).hashes(4).tolist()[0] == word_hash("abcd")
    assert len(Words([]).hashes()) == 0


def test_network_learns_and_pools_whole_texts():
    rows = texts(600)
    model = T.train([t.encode() for _, t, _ in rows], np.array([y for _, _, y in rows]))
    fresh = texts(300, 2)
    scores = T.score_texts(model, [t.encode() for _, t, _ in fresh])[0]
    assert np.mean((scores >= 0.5) == [y for _, _, y in fresh]) > 0.95
    long = ("harmless " * 20_000 + "idiot").encode()
    assert T.score_texts(model, [long])[0][0] > T.score_texts(model, [long[:-6]])[0][0]
    alone, batch = T.score_texts(model, [b"a moron", b""])[0], T.score_texts(model, [b"xx", b"a moron", b"", b"yy zz"])[0]
    assert batch[1:3] == pytest.approx(alone)


def test_network_takes_little_memory():
    text = " ".join(random.Random(3).choices(["harmless", "idiot", "les", "der", "xylophone"], k=60_000)).encode()
    model = T.ToxicityModel.fresh(np.random.default_rng(1))
    ids, counts, _ = T.encode([text])
    T.score_texts(model, [text])
    tracemalloc.start()
    scores = T.score_texts(model, [text])[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6
    assert scores == pytest.approx(1 / (1 + np.exp(-model.logits(ids, counts))), abs=1e-6)
    words = T._narrow(ids[:-4])
    assert words.nbytes * 2 <= ids.nbytes
    assert (T._wide(words) == ids[:-2]).all() and (T._wide(T._narrow(T.encode([b""])[0][:-4])) == 0).all()


def test_workers_give_freed_memory_back():
    def held():
        return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    def run(batches):
        kept = []
        for batch in batches:
            many = [np.ones(10_000) for _ in range(1_500)]  # 120 MB in pieces that malloc doesn't map one by one
            kept.append(np.ones(10_000))
            del many
            yield batch

    gc.collect()
    before = held()
    pins = [batch for batch in trimmed(run)([pa.record_batch({"a": [1]})])]
    assert len(pins) == 1 and held() < before + 40


def frames(spark, rows, label):
    docs = spark.createDataFrame([(i, t, "en", "s", 3) for i, t, _ in rows] + [(9001, None, "x", None, 0), (9002, "", "x", None, 0), (9002, "", "x", None, 0), (None, "null id", "x", None, 0)], "doc_id long, text string, lang string, source string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(1, rows[1][2]), (3, None), (None, 1), (77_777, 1)], f"doc_id long, {label} int")
    return docs, labels


def test_toxicity_frame(spark):
    docs, labels = frames(spark, texts(500), "toxic")
    rows = {r.doc_id: r.score for r in T.score(docs, T.fit(docs, labels)).collect()}
    assert len(rows) == 503 and all(0 <= s <= 1 for s in rows.values())
    right = [(rows[i] >= 0.5) == bool(y) for i, _, y in texts(500)]
    assert np.mean(right) > 0.9
    # labels of the held-out fold are not seen
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(string(doc_id) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    assert {r.doc_id: r.score for r in T.score(docs, T.fit(docs, flipped)).collect()} == rows
    assert T.fit(docs, labels.limit(0)) == 0.0 and T.fit(docs, labels.where("toxic = 1")) == 1.0
    assert T.score(docs.limit(0), 0.0).count() == 0


def test_no_text_ends_or_fills_the_training_sample(spark, monkeypatch):
    monkeypatch.setattr(T, "MAX_LABELLED", 40)
    monkeypatch.setattr(T, "MAX_LABELLED_BYTES", 10_000)
    monkeypatch.setattr(T, "LONG_TEXT", 1_000)
    rows = [(i, f"text {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    sampled = lambda rows: sorted(T.training_rows(spark.createDataFrame(rows, "doc_id long, text string"), labels, "toxic").toArrow().column(0).to_pylist())
    plain = sampled(rows)
    assert len(plain) == 40
    first = spark.range(60).selectExpr("id", "xxhash64(id) h", "crc32(cast(string(id) as binary)) % 5 f").where("f <> 0").orderBy("h").first().id
    own = f"text {first}"
    # one text beyond the bound, first in hash order; an id that repeats, with one text or with many
    assert sampled([(i, "x" * 20_000 if i == first else t) for i, t in rows]) == [t for t in plain if t != own]
    assert sampled(rows + [(first, own)] * 100) == plain
    many = sampled(rows + [(first, f"other {k}") for k in range(100)])
    assert len(many) == 40 and len(set(many) & set(plain)) >= 39


def test_labels_without_a_document_take_no_place(spark, monkeypatch):
    monkeypatch.setattr(T, "MAX_LABELLED", 40)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    labels = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    assert T.training_rows(docs, labels, "toxic").count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(30))


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_registered_classifiers(spark, tmp_path, name):
    rows = [(i, t + (" and more!" if y else " ###"), y) for i, t, y in texts(300, 4)]
    odd = [(1000, None), (1001, ""), (None, rows[0][1]), (1002, "long " * 60_000), rows[3][:2], rows[3][:2]]
    spark.createDataFrame([(*r[:2], "en", 1, "x") for r in [*rows, *odd]], "doc_id long, text string, lang string, score int, y string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, y) for i, _, y in rows[:250]] + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = (Q.op7_quality if name == "quality" else T.op8_toxicity)(spark, str(tmp_path))
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = got.collect()
    assert sorted((r.doc_id or -1) for r in got) == sorted((r[0] or -1) for r in [*rows, *odd])
    cut = 0.3 if name == "quality" else 0.5
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in got)
    held = [(r.predicted == dict((i, y) for i, _, y in rows)[r.doc_id]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert np.mean(held) > 0.9
    twice = [r.score for r in got if r.doc_id == rows[3][0]]
    assert len(twice) == 3 and len(set(twice)) == 1
    for t in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert (Q.op7_quality if name == "quality" else T.op8_toxicity)(spark, f"{tmp_path}/none").collect() == []


def test_statistics_cover_whole_texts():
    x = Q.statistics([b"", b"Und Und Und Und", b"LOUD!! LOUD!! NOISE!!", "| a | b\nçé 12".encode()])
    col = Q.STATISTICS.index
    assert x.shape == (4, len(Q.STATISTICS)) and np.isfinite(x).all()
    assert x[1, col("adjacent_equal")] == 0.75 and x[1, col("distinct")] == 0.25 and x[1, col("top_share")] == 1
    assert x[2, col("shouted")] == 1 and x[3, col("bar_words")] == pytest.approx(2 / 6)
    long = b"fine words here " * 9000
    assert not np.allclose(Q.statistics([long + b"# " * 9000]), Q.statistics([long]))


def test_isotonic():
    at, value = Q.isotonic(np.array([0.0, 1, 2, 3]), np.array([10.0, 10, 10, 10]), np.array([0.0, 6, 4, 10]))
    assert (np.diff(value) >= 0).all() and len(value) == 3 and at[1] == 1.5


def test_quality_frame(spark):
    rng = random.Random(5)
    rows = []
    for i, t, _ in texts(600, 3):
        bad = i % 3 == 0
        rows.append((i, " ".join(f"{w.upper()}!!{rng.choice('#$%')}" for w in t.split()) + "##" if bad else t + " end.", int(not bad)))
    docs, labels = frames(spark, rows, "quality")
    stats = Q.document_statistics(docs)
    got = {r.doc_id: r.score for r in Q.apply_model(stats, Q.fit(stats, labels)).collect()}
    assert len(got) == 603 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.3) == bool(y) for i, _, y in rows]) > 0.95
    assert Q.fit(stats, labels.limit(0)) == 0.5 and Q.fit(stats, labels.where("quality = 1")) == 1.0
    assert zlib.crc32(b"5") % 5 == spark.sql("select crc32(cast('5' as binary)) % 5").first()[0]
