import random
import re
from collections import Counter

import pytest

from driftlens.llm import decontamination as D
from driftlens.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def similarity(a, b):
    width = min(5, len(b))
    x, y = (Counter(tuple(t[i : i + width]) for i in range(len(t) - width + 1)) for t in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_leaks_match_brute_force(spark):
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(60)] + ["é", "Zwölf", "42"]
    text = lambda n: " ".join(rng.choices(pool, k=n))
    items = [(k, text(rng.choice([3, 14, 20, 33, 59]))) for k in range(12)] + [(50, "one two one two one two one two one two"), (51, ""), (52, None), (53, "Of.\nIt, said!"), (0, text(25))]
    texts = [text(rng.randrange(0, 120)) for _ in range(30)]
    for k, item in items[:14]:
        if item:
            w = item.split()
            texts.append(text(30) + ", " + item.upper() + "\n" + text(25))
            texts.append(item)
            w[len(w) - 1] = "changed"
            texts.append(text(9) + " " + "  ".join(w) + " " + text(9))
            texts.append(" ".join(item.split()[:-1]))
    texts += [texts[-1], None, "", "of it said"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id string, h1 int")
    bench = spark.createDataFrame([(k, t, 5) for k, t in items], "item_id long, text string, doc_id int")
    got = {}
    for r in docs.select("doc_id", *D.text_key(docs.text)).join(D.leaks(docs, bench), ["h1", "h2"]).collect():
        got[r.doc_id, r.item_id] = round(r.similarity, 6)
    want = {}
    for i, t in enumerate(texts):
        w = words(t)
        for k, item in items:
            b = words(item)
            if not b or not w:
                continue
            m = min(len(b), len(w))
            s = max(similarity(w[a : a + m], b) for a in range(len(w) - m + 1)) if m >= min(5, len(b)) else 0
            if s >= 0.8 - 1e-9:
                want[i, k] = max(round(s, 6), want.get((i, k), 0))
    assert got == want and len(want) > 30
    assert D.leaks(docs.limit(0), bench).count() == 0 and D.leaks(docs, bench.limit(0)).count() == 0


def test_leak_with_repeated_shingles_carrying_the_votes(spark):
    # 80 of 95 places, or nearly, are of shingles of two runs: the similarity is high and the SimHashes are far apart
    singles = [f"s{k}" for k in range(12)]
    item = ["a"] * 48 + ["b"] * 40 + singles
    window = ["a"] * 40 + ["b"] * 48 + singles
    docs = spark.createDataFrame([(1, " ".join(["x"] * 7 + window + ["y"] * 7)), (2, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(item)) for k in (5, 5, 6)], "item_id long, text string")
    want = max(similarity(w, item) for w in [(["x"] * 7 + window + ["y"] * 7)[a : a + len(item)] for a in range(15)])
    got = {r.item_id: (round(r.similarity, 6), r.distance) for r in D.leaks(docs, bench).collect()}
    assert {k: v[0] for k, v in got.items()} == {5: round(want, 6), 6: round(want, 6)} and want > 0.8
    assert min(v[1] for v in got.values()) > 24


def test_windows_slide_along_repetitive_texts(spark):
    rng = random.Random(8)
    for count in (2, 3):  # few different words, so that shingles repeat in items and in texts
        texts = [" ".join(rng.choices("abc"[:count], k=rng.randrange(1, 90))) for _ in range(25)]
        items = [" ".join(rng.choices("abc"[:count], k=rng.randrange(2, 40))) for _ in range(8)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        got = {(r.doc_id, r.item_id): (r.start, round(r.similarity, 9)) for r in docs.select("doc_id", *D.text_key(docs.text)).join(D.leaks(docs, bench, 0.6), ["h1", "h2"]).collect()}
        want = {}
        for (i, t), (k, item) in [(x, y) for x in enumerate(texts) for y in enumerate(items)]:
            w, b = t.split(), item.split()
            m = min(len(w), len(b))
            if m >= min(5, len(b)):
                want[i, k] = max(similarity(w[a : a + m], b) for a in range(len(w) - m + 1))
        assert {k: v[1] for k, v in got.items()} == {k: round(v, 9) for k, v in want.items() if v >= 0.6 - 1e-9} and len(got) > 5
        for (i, k), (start, s) in got.items():
            b = items[k].split()
            assert round(similarity(texts[i].split()[start : start + len(b)], b), 9) == s
    # a very long text of one word against an item of it: a window a place, none exploded
    docs = spark.createDataFrame([(1, "na " * 200_000)] * 3, "doc_id long, text string")
    bench = spark.createDataFrame([(5, "na " * 300)], "item_id long, text string")
    assert [(r.start, r.n_words, r.similarity) for r in D.leaks(docs, bench).collect()] == [(0, 300, 1.0)]


def test_votes_of_long_windows_and_repeated_items(spark):
    rows = spark.range(140_000).selectExpr("id % 2 as k", "if(id % 2 = 0, -1L, 0L) as h")
    assert {r.k: (r.fp, r.total) for r in D.simhash(rows, ["k"]).collect()} == {0: (-1, 70_000), 1: (0, 70_000)}
    text = " ".join(f"word{k}" for k in range(37))
    bench = spark.range(2_100).selectExpr("7L as item_id", f"'{text}' as text")
    docs = spark.createDataFrame([(1, "so " + text + " it is")], "doc_id long, text string")
    assert [(r.item_id, r.similarity, r.distance) for r in D.leaks(docs, bench).collect()] == [(7, 1.0, 0)]
    assert D.item_shingles(bench).count() == 33


def brute_scan(text, templates=L.TEMPLATES):
    w = words(text)
    places, labels = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    met, best = set(), 0.0
    for label, texts in templates.items():
        for t in texts:
            own, stride = set(words(t)), 16
            while stride < len(words(t)):
                stride *= 2
            for b in range(0, max(1, len(w)), stride):
                share = len(own & set(w[b : b + 2 * stride])) / len(own)
                if share >= L.CONTAINMENT - 1e-9:
                    met.add(label)
                    best = max(best, share)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | met)), 1.0 if places else best)


def test_licences_match_brute_force(spark):
    rng = random.Random(9)
    every = [t for texts in L.TEMPLATES.values() for t in texts]
    vocabulary = [w for t in every for w in words(t)]
    texts = ["", None, "Released under the MIT License.", "licensed under CC BY-NC 4.0", "Under  the\nmit license under the MIT-license", "under the mit", "Apache License, Version 2.0", "x" * 5000, "ALL RIGHTS RESERVED", "all rights reserved all rights", "xx " * 70_000 + "all rights reserved"]
    for _ in range(150):
        t = rng.choice(every).split()
        for _ in range(rng.choice([0, 0, 1, len(t) // 12, len(t) // 6])):
            t.pop(rng.randrange(len(t)))
        around = lambda: rng.choices(rng.choice([vocabulary, ["xx", "yy", "é"]]), k=rng.randrange(rng.choice([9, 300])))
        texts.append(" ".join(around() + t + ["und"] + around()))
    texts.append(texts[-1])
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, known int")
    got = {r[0] or 0: tuple(r[1:]) for r in L.scan(docs).collect()}
    assert got == {i: brute_scan(t) for i, t in enumerate(texts)}
    assert L.scan(docs.limit(0)).count() == 0


def test_a_long_template_is_met_at_every_offset(spark):
    body = L.TEMPLATES["mit"][1]
    assert len(words(body)) > 60
    docs = spark.createDataFrame([(k, "x " * k + body + " y" * 200) for k in range(0, 260, 3)], "doc_id long, text string")
    assert {(r.labels, r.score) for r in L.scan(docs).collect()} == {("mit", 1.0)}
    # texts of one repeated statement cost no square
    docs = spark.createDataFrame([(1, "all rights reserved " * 20_000)], "doc_id long, text string")
    assert L.scan(docs).first().labels == "all-rights-reserved"
    with pytest.raises(ValueError, match="no word"):
        L.scan(docs, {"x": ("...",)})


def test_registered_native_queries(spark, tmp_path):
    body = " ".join(f"word{k}" for k in range(20))
    docs = [(1, f"so {body} it was. Licensed under CC BY-NC 4.0"), (2, None), (3, "x"), (4, body)]
    spark.createDataFrame([(*d, "en", "s", 0) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, body), (8, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = sorted(map(tuple, D.op3_decontamination(spark, str(tmp_path)).select("doc_id", "item_id", "start", "n_words", "similarity", "distance").collect()))
    assert rows == [(1, 7, 1, 20, 1.0, 0), (4, 7, 0, 20, 1.0, 0)]
    found = L.op10_licenses(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == {1: (30, 1, 25, 25, "cc-by-nc", "cc-by-nc", 1.0), 2: (0, 0, None, None, "", "", 0.0), 3: (1, 0, None, None, "", "", 0.0), 4: (20, 0, None, None, "", "", 0.0)}
