import itertools
import random
import re

from driftlens.llm import filter_audit as A


def fails(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        yield i, lang or "", {f for f, bad in tests.items() if bad}


def brute_force(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    judged, out = list(fails(rows)), []
    for part in {p for _, p, _ in judged}:
        own = [(i, f) for i, p, f in judged if p == part]
        made, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                there = [x for x in own if not x[1] & set(order[:k])]
                gone = [x for x in there if f in x[1]]
                shapley[f] += len(gone)
                made.append((f, part, "".join(order), k + 1, len(there) - len(gone), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[0] in good and x[0] is not None for x in gone), sum(x[0] in toxic and x[0] is not None for x in gone)))
        out += [(*m[1:], shapley[m[0]]) for m in made]
    return sorted(out)


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_registered_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for k in range(160):
        w = [rng.choice("abcdefgh") * rng.randrange(1, 9) + (str(j) if rng.random() < 0.9 or k % 3 else "") for j in range(rng.choice([3, 99, 100, 101, 140]))]
        text = rng.choice([" ", "\n", "\u00a0 ", "\t"]).join(w)
        rows.append((k, text.upper() if k % 5 == 0 else text + " # " if k % 7 == 0 else "É" * 9 + text, rng.choice(["en", "de", None, ""])))
    rows += [(200 + k, rows[k % 4][1], "en") for k in range(30)] + [(300, None, "fr"), (301, "", "fr"), (302, " \x0b ", "fr"), (None, rows[3][1], "de"), (None, "", None), (None, "", None), rows[5], rows[5], (5, "another text", "de")]
    rows += [(400, " ".join(f"w{j}" for j in range(50_000)), "es"), (401, " ".join(f"w{j}" for j in range(50_000)), "es"), (402, "x" * 300_000, "es")]
    labels = [(k, rng.randrange(2), rng.randrange(2)) for k in range(0, 320, 3)] + [(3, 0, None), (3, 1, 0), (None, 1, 1), (9999, 1, 1), (401, 1, None)]
    spark.createDataFrame([(*r, 1, "x", 0) for r in rows], "doc_id long, text string, lang string, k1 int, part string, good int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = A.op12_filter_audit(spark, str(tmp_path))
    assert dict(got.dtypes) == {c: {"part": "string", "filter_order": "string", "step": "int"}.get(c, "bigint") for c in COLUMNS}
    got = sorted(tuple(r[c] for c in COLUMNS) for r in got.collect())
    want = brute_force(rows, labels)
    assert got == want and len(got) == 600 * 5 and all(sum(r[k] for r in want) for k in range(3, 10))


def test_zeros_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(120)), "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = A.interactions(docs, labels).collect()
    assert len(got) == 600 and {(r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == {(1, 0, 0, 0, 0, 0, 0)}
    assert A.interactions(docs.limit(0), labels).collect() == []


def test_every_prefix_is_joined_once(spark):
    """Survivors of 2 ** n prefixes by n anti-joins, however many orders there are."""
    rows = spark.createDataFrame([(k, 0, "en", 0, 0, 1) for k in range(8)], "k1 long, k2 long, part string, good int, toxic int, n long")
    tables = {f: spark.createDataFrame([(k, 0) for k in range(8) if k >> b & 1], "k1 long, k2 long") for b, f in enumerate("XYZ")}
    got = {(r.prefix, r.filter): r.rows for r in A.prefix_counts(rows, tables).collect()}
    assert {p: got[p, ""] for p in range(8)} == {p: 1 << 3 - bin(p).count("1") for p in range(8)}
    assert all(got[p, f] == 1 << 2 - bin(p).count("1") for p in range(8) for b, f in enumerate("XYZ") if not p >> b & 1)
