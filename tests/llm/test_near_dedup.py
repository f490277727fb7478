import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from inkstone.llm import near_dedup
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def brute(prints):
    """(links of each distinct print, group of each) from all pairs."""
    keys = sorted({p for p in prints if p[0] is not None})
    x = np.array(keys, np.int64).reshape(-1, 4).view(np.uint64)
    d = np.bitwise_count(x[:, None] ^ x[None]).sum(2)
    near = d <= near_dedup.RADIUS
    group = list(range(len(keys)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in zip(*np.nonzero(near), strict=True):
        group[root(a)] = root(b)
    return {k: int(near[i].sum()) - 1 for i, k in enumerate(keys)}, {k: root(i) for i, k in enumerate(keys)}


def check(spark, docs):
    prints = {r["doc_id"]: (r["f0"], r["f1"], r["f2"], r["f3"]) for r in near_dedup.fingerprints(docs).collect()}
    links, group = brute(prints.values())
    got = near_dedup.groups(docs).collect()
    members = defaultdict(set)
    for d, p in prints.items():
        members[group[p] if p in group else ("alone", d)].add(d)
    for r in got:
        p = prints[r["doc_id"]]
        own = members[group[p] if p in group else ("alone", r["doc_id"])]
        assert r["group_id"] == min(own) and r["group_size"] == len(own) and r["keep"] == (r["doc_id"] == min(own))
        assert r["links"] == links.get(p, 0) and r["copies"] == (sum(q == p for q in prints.values()) if p in links else 1)
    return got, prints


def varied(n, seed=4):
    """Texts with near copies at all distances, many to one original."""
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 8))) for _ in range(900)]
    out = []
    for i in range(n):
        if i % 3 or not out:
            out.append(draw.choices(words, k=draw.randint(30, 200)))
        else:
            own = list(out[draw.randrange(min(len(out), 12))])
            for _ in range(draw.randint(0, len(own) // 8)):
                own[draw.randrange(len(own))] = draw.choice(words)
            out.append(own)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_groups_and_links_equal_all_pairs(spark):
    got, prints = check(spark, spark.createDataFrame(varied(600), SCHEMA))
    assert sum(r["links"] > 0 for r in got) > 150


def test_split_tables_give_the_same_links(spark):
    docs = spark.createDataFrame(varied(300, 9), SCHEMA)
    nodes = near_dedup.written(near_dedup.fingerprints(docs).dropDuplicates(["f0", "f1", "f2", "f3"]).withColumnRenamed("doc_id", "node").where("f0 IS NOT NULL"))
    sums = []
    for most in (50_000, 40, 3):
        found = near_dedup.written(near_dedup.links(nodes, most))
        number = {r["u"]: r["n"] for r in found.groupBy("u").agg(F.sum("links").alias("n")).collect() if r["n"]}
        label = {r["node"]: r["label"] for r in near_dedup.components(found.selectExpr("u AS a", "v AS b")).collect()}
        sums.append((number, label))
    assert sums[0][0] and sums[0] == sums[1] == sums[2]


def test_given_documents(spark):
    check(spark, spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))


def test_ties_nulls_and_punctuation(spark):
    rows = [(5, "one two three"), (5, ""), (5, "One, two - three!"), (None, "ONE TWO THREE"), (1, "“one” two… three"), (2, None), (3, "!!"), (None, None), (7, "日本語。日本"), (8, "日本語 日本")]
    got = near_dedup.groups(spark.createDataFrame(rows, SCHEMA)).collect()
    ones = [r for r in got if r["group_id"] == 1]
    assert len(ones) == 4 and sum(r["keep"] for r in ones) == 1 and all(r["group_size"] == 4 and r["copies"] == 4 for r in ones)
    assert [r["keep"] for r in got if r["group_id"] == 7] in ([True, False], [False, True])
    alone = [r for r in got if r["group_size"] == 1]
    assert len(alone) == 4 and all(r["keep"] and r["group_id"] == r["doc_id"] for r in alone)
    extra = spark.createDataFrame([(d, t, i % 2, "x", 3) for i, (d, t) in enumerate(rows + [(1, "“one” two… three")])], "doc_id long, text string, gone_id int, `row` string, `group` int")
    left = near_dedup.filtered(extra).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == sorted([(1, "“one” two… three"), (5, ""), (2, ""), (3, "!!"), (0, ""), (7, "日本語。日本")])
    assert left[0].asDict().keys() == {"doc_id", "text", "gone_id", "row", "group"}


def test_empty_tables_and_a_long_text(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near_dedup.groups(none).count() == near_dedup.filtered(none).count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    got = near_dedup.groups(spark.createDataFrame([("a", long), ("b", long + " end")], "doc_id string, text string")).collect()
    assert {(r["group_id"], r["copies"], r["keep"]) for r in got} == {("a", 2, True), ("a", 2, False)}


def verified(x):
    """(links of each of the prints, pairs that were looked at closely) without Spark."""
    links, looked, matches = np.zeros(len(x), int), [0], near_dedup._matches

    def counted(*given):
        for q, e in matches(*given):
            looked[0] += len(q)
            yield q, e

    near_dedup._matches = counted
    try:
        for i, v in enumerate(near_dedup.segments(x).T):
            sent = list(near_dedup._sent(v, 4))
            for cell in range(16):
                rows, spent = np.concatenate([r[to == cell] for r, to, _ in sent]), np.concatenate([np.full((to == cell).sum(), s, np.int32) for _, to, s in sent])
                if len(rows):
                    part = pa.table({"segment": np.full(len(rows), i, np.int32), "spent": spent, "entry": spent == 0, "node": rows, **{f"f{k}": x[rows, k].view(np.int64) for k in range(4)}})
                    out = near_dedup._verify(part, 4)
                    np.add.at(links, out["u"].to_numpy(), out["links"].to_numpy())
    finally:
        near_dedup._matches = matches
    return links, looked[0]


def test_unrelated_prints_are_not_compared_and_no_pair_is_lost():
    draw = np.random.default_rng(5)
    bits = (draw.random((8000, 256)) < np.where(draw.random(256) < 0.5, 0.25, 0.75)).astype(np.uint8)  # as texts of one language have them
    bits[:, near_dedup.BITS :] = 0
    for i in range(600):  # at most and just beyond the radius, spread evenly or left to chance
        even = np.concatenate([k * 20 + draw.permutation(20)[: 3 - (k == i % 12)] for k in range(12)])
        flip = even if i % 3 == 0 else draw.permutation(near_dedup.BITS)[: draw.integers(30, 38)]
        bits[7000 + i] = bits[i]
        bits[7000 + i, flip] ^= 1
    x = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    near = np.zeros(len(x), int)
    for lo in range(0, len(x), 1000):
        near[lo : lo + 1000] = (np.bitwise_count(x[lo : lo + 1000, None] ^ x[None]).sum(2) <= near_dedup.RADIUS).sum(1) - 1
    links, looked = verified(x)
    assert near.sum() > 800 and (links == near).all()
    assert looked < 20 * near.sum()  # pairs of values within two flips are many more
