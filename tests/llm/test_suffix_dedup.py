import hashlib
import random

import numpy as np
import pytest

from driftlens.llm import suffix_dedup
from driftlens.llm.induced_sort import DEPTH, repeated_starts, sorted_suffixes
from driftlens.llm.suffix_dedup import drop_repeats, remove_repeats, repeated_windows


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for t in raw:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("memory", [40, 64_000_000])
def test_suffix_order_and_prefixes(memory):
    rng = np.random.default_rng(2)
    for trial in range(12):
        text = rng.integers(0, 1 + trial % 4, int(rng.integers(1, 500))).astype(np.uint8) * 50
        if trial % 2:
            text = np.tile(text[: max(1, len(text) // 6)], 8)
        got = list(sorted_suffixes(text, memory))
        places, shared = (np.concatenate(x) for x in zip(*got, strict=True))
        raw = text.tobytes()
        cut = [raw[i : i + DEPTH] for i in places]
        assert sorted(places.tolist()) == list(range(len(text)))
        assert all(a >= b for a, b in zip(cut, cut[1:], strict=False))
        for a, b, n in zip(cut, cut[1:], shared[1:], strict=False):
            assert a[:n] == b[:n] and (n == DEPTH or n in (len(a), len(b)) or a[n] != b[n])


def test_repeated_starts():
    assert not repeated_starts(np.zeros(0, np.uint8)).any()
    assert repeated_starts(np.zeros(450, np.uint8))[:251].all()


@pytest.mark.parametrize("hot", [0, 1_000])
def test_matches_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choices("abcdé \n", k=n))
    passage, line = text(420), text(230)
    texts = ["", None, "short", "x" * 199, "y" * 200, "y" * 201, "z" * 1000, "ab " * 700, text(3000)]
    texts += [text(rng.randrange(400)) + passage + text(rng.randrange(400)) for _ in range(8)]
    texts += [text(300) + line[:199] + text(50), text(300) + line[:200] + text(50), text(10) + line + text(90)]
    long = text(2500)
    texts += [long, long, long[:1200] + "!" + long[1200:], passage, passage[:210]]
    df = spark.createDataFrame([(None if i == 9 else i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    got = {r.text: (r._n_bytes, r._n_removed, len(r._spans), hashlib.sha256(r._kept).hexdigest()) for r in remove_repeats(df, repeated_windows(df)).collect()}
    want = dict(zip(texts, brute(texts), strict=True))
    assert got == want


def test_stage_keeps_rows_and_columns(spark):
    both = "".join(random.Random(1).choices("abc é", k=300))
    df = spark.createDataFrame([(1, "é" + both + "ü", 302), (2, both, 300), (3, None, 0), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    out = drop_repeats(spark, df, "")
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text or "", r.n_chars or 0) for r in out.collect()) == [(1, "éü", 2), (2, "", 0), (3, "", 0), (3, "clean", 5)]
    assert drop_repeats(spark, df.limit(0), "").count() == 0


def test_stage_runs_one_python_function_a_task(spark):
    out = drop_repeats(spark, spark.createDataFrame([(1, "é" * 300, 300)], "doc_id long, text string, n_chars long"), "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_registered_query(spark, tmp_path):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("ab é\n", k=n))
    passage = text(260)
    rows = [(k, text(rng.choice([0, 50, 199, 200, 600]))) for k in range(30)] + [(40, "x" + passage + "y"), (41, passage * 2), (42, None), (None, text(300)), (None, ""), (43, "ab" * 4_000)]
    rows += [rows[5], (44, rows[7][1])] + [(50 + k, passage) for k in range(20)]
    docs = spark.createDataFrame([(*r, "k", 1, "f") for r in rows], "doc_id long, text string, h1 string, _found int, found string").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = suffix_dedup.op4_suffix_array(spark, str(tmp_path))
    assert got.dtypes[:5] == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    want = [(r[0], *b) for r, b in zip(rows, brute([t for _, t in rows]), strict=True)]
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == sorted(want, key=repr)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert suffix_dedup.op4_suffix_array(spark, f"{tmp_path}/none").collect() == []
