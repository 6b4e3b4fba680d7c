import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from driftlens.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return len(w), [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def brute_force(docs, items):
    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in items for b in features(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + 10_000) / ((s[b] + 1) * (tt + 10_000))))
    rows = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    may = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[5]))
    for k, r in enumerate(may[: 25 * len(may) // 100], 1):
        r[4] = k
    return rows


def key(rows):
    return sorted(([*r][:6] for r in rows), key=repr)


def odd_rows():
    rng = random.Random(5)
    pool = ["über", "Zwölf", "42", "Straße", "日本", "\x00", "a_b", "X1", "..", "w" * 300, "e\u0301"] + [f"word{k}" for k in range(80)]
    text = lambda n: rng.choice(["", " ", "\n"]) + rng.choice([" ", ", ", "\t- "]).join(rng.choices(pool, k=n)) + rng.choice(["", "!"])
    docs = [(k, text(rng.choice([0, 1, 5, 18, 22, 60, 400]))) for k in range(150)]
    docs += [(500, None), (501, ""), (502, " ,;. "), (None, text(40)), (None, text(40)), (503, text(60_000)), (504, "solo")]
    docs += [(600 + k, docs[10][1]) for k in range(20)] + [docs[0], docs[6], docs[6]] + [(7, text(30))]
    return docs, [text(30), text(3), None, "", "Word1 word2 word3"]


@pytest.mark.parametrize("segment", [97, 4_000_000])
def test_registered_query_matches_brute_force(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(I, "SEGMENT", segment)
    docs, items = odd_rows()
    if segment == 97:  # long words and gaps go over the segment's end; workers read the module anew, so runs() is held here
        for _, t in docs[:160]:
            text = (t or "").encode()
            n, doc, bucket = I.runs([b"", text, b"x"])
            want = features(t)
            assert n.tolist() == [0, want[0], 1] and sorted(bucket[doc == 1].tolist()) == sorted(want[1])
        return
    spark.createDataFrame([(*d, "en", 1, "x") for d in docs], "doc_id long, text string, bucket string, score int, found string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)], "item_id long, text string, doc_id int").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = I.op11_importance(spark, str(tmp_path))
    assert got.dtypes[:5] == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    want = brute_force(docs, items)
    assert key(got.collect()) == key(want) and sum(r[4] is not None for r in want) > 20


def test_runs_of_any_length_are_composed(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcé0", k=rng.choice([1, 2, 7, 40, 1500]))) for _ in range(200)]
    n, doc, bucket = I.runs([" ".join(words).encode(), b"", b"one"], most=4, buckets=65_536)
    want = [zlib.crc32(" ".join(words[i : i + k]).encode()) % 65_536 for k in range(1, 5) for i in range(len(words) - k + 1)]
    assert n.tolist() == [200, 0, 1] and bucket[doc == 0].tolist() == want and bucket[doc == 2].tolist() == [zlib.crc32(b"one") % 65_536]


def test_operator_on_bytes():
    for a, b in ((b"", b"x"), (b"abc", b""), (b"abc", b"d" * 70_000)):
        assert int(I.further(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_empty_tables_and_no_target(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    items = spark.createDataFrame([], "text string")
    assert I.resample(docs.limit(0), items).collect() == []
    assert [(r.n_features, r["rank"]) for r in I.resample(docs, items).collect()] == [(59, None)]
    assert [r["rank"] for r in I.resample(docs, items, share=100).collect()] == [1]
