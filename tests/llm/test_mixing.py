from collections import Counter, defaultdict

import duckdb
from inkstone.llm import mixing

SMALL = "/root/testdata/sf0.001"


def demand(t, p, knots, tokens):
    """Cumulative demand at time t by adding small steps."""
    steps, total = 4000, 0.0
    for i in range(steps):
        x = t * (i + 0.5) / steps
        k = max(j for j in range(len(knots)) if knots[j] <= x)
        share = p[-1] if k == len(knots) - 1 else p[k] + (p[k + 1] - p[k]) * (x - knots[k]) / (knots[k + 1] - knots[k])
        total += share * t / steps
    return total * tokens


def test_mixed_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, "en", None, 0), (None, "x y", "en", None, 3)], docs.schema))
    got = sorted(mixing.mixed(docs).collect(), key=lambda r: r["position"])
    rows = docs.collect()
    assert [r["position"] for r in got] == list(range(1, len(rows) + 1))
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in rows)
    total = defaultdict(int)
    for r in rows:
        total[r["source"]] += len((r["text"] or "").split())
    knots, exponents = zip(*mixing.SCHEDULE)
    sums = [sum(max(n, 1) ** a for n in total.values()) for a in exponents]
    p = {s: [max(n, 1) ** a / x for a, x in zip(exponents, sums)] for s, n in total.items()}
    sent, last = defaultdict(int), 0.0
    for r in got:
        n = len((r["text"] or "").split())
        sent[r["source"]] += n
        assert r["n_tokens"] == n and r["due"] >= last - 1e-9
        last = r["due"]
        assert abs(demand(r["due"], p[r["source"]], knots, sum(total.values())) - sent[r["source"]]) < 0.3
    assert sent == total


def test_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = set(duckdb.sql(mixing.ORACLE_SQL).fetchall())
    got = mixing.placed(spark.read.parquet(f"{SMALL}/documents.parquet")).select("doc_id", "source", "n_tokens", "due", "position").collect()
    assert {tuple(r) for r in got} == want


def test_edge_cases(spark):
    docs = spark.createDataFrame([("a", "x", None, 5), ("a", "x", None, 5), ("b", "", "s", 5), (None, None, "s", 5)], "doc_id string, text string, source string, position int")
    assert [r["position"] for r in mixing.mixed(docs).orderBy("position").collect()] == [1, 2, 3, 4]
    assert mixing.mixed(docs.limit(0)).count() == 0
