"""Doubles that print as a half of the last digit are rounded as in the SQL, in queries over the events as well."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from driftlens.functions.ranks import quantiles
from driftlens.plans import catalog

#: Users that leave table b at each pair of checkpoints, and as many come: of 800, so 57 are a share of 0.07125 and 10 of 0.0125.
GONE = (10, 10, 10, 10, 10, 57, 30, 30, 30, 30, 30)


def events(path: str, residents: int = 800, idle: int = 700) -> None:
    last = 2 * (len(GONE) + 4)
    leaving = [(2, 2 * pair + 2) for pair, n in enumerate(GONE) for _ in range(n)]
    coming = [(2 * pair + 10, last) for pair, n in enumerate(GONE) for _ in range(n)]
    lives = leaving + [(2, last)] * (residents - len(leaving)) + coming + [(1, 1)] * idle
    con = duckdb.connect()
    con.execute("CREATE TABLE users (id BIGINT, first INTEGER, last INTEGER)")
    con.executemany("INSERT INTO users VALUES (?, ?, ?)", [(i // 2 * 3 + 1 + i % 2, *life) for i, life in enumerate(lives)])
    con.execute(
        f"""COPY (SELECT row_number() OVER (ORDER BY day, id) AS event_id, TIMESTAMP '2024-01-01' + to_days(day - 1) AS ts, id AS user_id,
        ['view', 'click', 'purchase', 'signup', 'error'][1 + (id * 7 + day * 2) % 5] AS event_type, ((id * 37 + day * 202) % 5000) / 100 AS value
        FROM users, (SELECT CAST(unnest(range(1, {last + 1})) AS INTEGER) AS day) WHERE day BETWEEN first AND last AND (day % 2 = 0 OR last = 1)) TO '{path}/events.parquet' (FORMAT parquet)"""
    )


@pytest.fixture(scope="module")
def halves(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("halves"))
    events(path)
    return path


def held(spark, path: str, name: str) -> None:
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    want = con.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    assert Counter(tuple(r) for r in catalog.QUERIES[name](spark, path).select(*columns).collect()) == Counter(want.fetchall())


def test_rounding(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT k / n AS x, round(k / n, 4) AS four, round(k / n, 3) AS three FROM range(1, 4001) a(n), range(0, 4001) b(k) WHERE k <= n AND n % 100 = 0) TO '{tmp_path}/x.parquet'")
    shares = spark.read.parquet(f"{tmp_path}/x.parquet")
    assert shares.where((catalog._rounded("x", 4) != F.col("four")) | (catalog._rounded("x", 3) != F.col("three"))).count() == 0


@pytest.mark.parametrize("name", ["feature_series", "detect_robust_z"])
def test_query_rounds_halves_as_its_sql(spark, halves, name):
    held(spark, halves, name)


@pytest.mark.parametrize("held", [0, 10_000])
def test_quantiles_have_the_last_bit_of_the_sql(spark, tmp_path, held):
    path = f"{tmp_path}/x.parquet"
    duckdb.sql(f"""COPY (SELECT k, CASE WHEN k % 3 = 0 THEN hash(k, i) % 9999 / 100 WHEN k % 3 = 1 THEN sqrt(hash(k, i) % 999983) ELSE hash(k, i) % 4 / 7 END AS v
        FROM range(3000) a(k), range(40) b(i) WHERE i < 2 + k % 37 UNION ALL SELECT -1, 1e308 FROM range(4)) TO '{path}' (FORMAT parquet)""")
    wanted = {"a": 0.5, "b": 0.95, "c": 0.8}
    want = duckdb.sql(f"SELECT k, {', '.join(f'quantile_cont(v, {p})' for p in wanted.values())} FROM '{path}' GROUP BY k").fetchall()
    got = quantiles(spark.read.parquet(path), ["k"], F.col("v"), wanted, held).collect()
    assert {tuple(r) for r in got} == set(want)
