import numpy as np
from inkstone.llm import sharding

SMALL = "/root/testdata/sf0.01"


def test_shards_split_at_medians(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sharding.shards(docs, 60_000).toPandas()
    assert len(rows) == 1000 and rows.n_bytes.sum() == sum(len(r["text"].encode()) for r in docs.collect())
    sums = rows.groupby("shard").n_bytes.sum()
    assert (rows.groupby("shard").shard_bytes.first() == sums).all() and sums.max() <= 60_000
    assert list(sums.index) == list(range(len(sums)))
    assert np.median(sums) > 20_000


def brute(x, w, target, spread):
    """Leaves as sets of rows, splitting at exact weighted medians."""
    if w.sum() <= target:
        return [set(x[:, -1])]
    share = (x.max(0) - x.min(0)) / spread
    d = int(np.argmax(share[:-1]))
    d = d if share[d] > 0 else x.shape[1] - 1
    if not share[d] > 0:
        return [set(x[:, -1])]
    v = np.unique(x[:, d])[:-1]
    off = [abs(w[x[:, d] <= y].sum() / w.sum() - 0.5) for y in v]
    left = x[:, d] <= v[int(np.argmin(off))]
    return brute(x[left], w[left], target, spread) + brute(x[~left], w[~left], target, spread)


def test_tree_equals_brute_force(spark):
    draw = np.random.default_rng(3)
    n = 400
    x = np.column_stack([draw.integers(0, 12, n) / 3.0, draw.choice([0.1, 0.5, 0.9], n, p=[0.7, 0.2, 0.1]), np.full(n, 0.5), draw.permutation(n) / n])
    w = draw.integers(1, 1000, n).astype(float)
    points = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, w, strict=True)], "n_chars double, source double, lang double, row double, n_bytes long")
    tree, sizes = sharding.build(points, 4000, 0.0)
    leaf = tree.leaves(x)
    got = sorted(sorted(x[leaf == i, 3]) for i in np.unique(leaf))
    want = sorted(sorted(s) for s in brute(x, w, 4000, np.maximum(x.max(0) - x.min(0), 1e-300)))
    assert got == want and all(abs(sizes[i] - w[leaf == i].sum()) < 1e-6 for i in np.unique(leaf))


def test_edge_cases(spark):
    rows = [(None, "same text", 9, None, None)] * 40 + [(1, None, None, "s", "en"), (2, "x" * 500, 500, "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string, lang string")
    got = sharding.shards(docs.selectExpr("*", "1 AS shard", "2 AS leaf"), 100).collect()
    assert len(got) == 42 and all(r["shard_bytes"] <= 100 or r["n_bytes"] == 500 for r in got)
    assert sharding.shards(docs.select("doc_id", "text"), 100).count() == 42
    assert sharding.shards(docs.limit(0)).count() == 0
