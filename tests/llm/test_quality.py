import numpy as np
from inkstone.llm import quality
from pyspark.sql import Window
from pyspark.sql import functions as F

D = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    ranker = quality.fit(docs, labels.where(seen))
    rows = quality.score(docs.join(labels.where(~seen), "doc_id"), ranker).select("lang", "quality", "toxic", "__keep", "__score").toPandas()
    good = (rows.quality == 1) & (rows.toxic == 0)
    assert rows[good]["__keep"].mean() > 0.975
    assert (~rows[rows.toxic == 1]["__keep"]).mean() > 0.9
    assert (~rows[rows.quality == 0]["__keep"]).mean() > 0.9
    a, b = rows[good]["__score"].to_numpy(), rows[~good]["__score"].to_numpy()
    assert (a[:, None] > b[None, :]).mean() > 0.985


def test_the_loss_is_least(spark):
    draw = np.random.default_rng(1)
    x = draw.standard_normal((60, 5)).astype(np.float32)
    better, worse = draw.integers(0, 30, 400), draw.integers(30, 60, 400)
    x[:30, 0] += 1
    w = quality.bradley_terry(x, better, worse, 1e-2, 3000).astype(np.float64)
    d = (x[better] - x[worse]).astype(np.float64)
    loss = lambda v: np.log1p(np.exp(-d @ v)).mean() + 0.5e-2 * v @ v
    assert all(loss(w) <= loss(w + 1e-2 * draw.standard_normal(5)) + 1e-7 for _ in range(300))
    gradient = -(d.T @ (1 / (1 + np.exp(d @ w)))) / len(d) + 1e-2 * w
    assert np.abs(gradient).max() < 1e-4


def test_threshold_is_the_best_quantile():
    draw = np.random.default_rng(2)
    scores, y = draw.standard_normal(500), draw.random(500) < 0.7
    scores[~y] -= 2
    t = quality._threshold(scores, y, 3.0, 0.03)
    cost = lambda x: 3 * (scores[y] < x).mean() + (scores[~y] >= x).mean()
    allowed = [x for x in scores[y] if (scores[y] < x).mean() <= 0.03]
    assert t in allowed and cost(t) <= min(map(cost, allowed)) + 1e-12


def test_edge_cases(spark):
    rows = [("a", "good words here", "en", 1, "x"), ("b", "bad junk $$$", "en", 2, "y"), ("b", "bad junk $$$", "en", 2, "y"), (None, None, None, 3, "z"), ("c", "", "xx", 4, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, score int, keep string")
    labels = spark.createDataFrame([("a", 1, 0), ("b", 0, None), ("b", 1, 1), ("q", None, None), (None, 1, 0)], "doc_id string, quality int, toxic int")
    assert quality.classify(docs, labels).count() == 5
    left = quality.filtered(docs, labels)
    assert left.columns == docs.columns and left.where("doc_id = 'a'").count() == 1
    assert quality.filtered(docs, labels.limit(0)).count() == 5
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.classify(docs.drop("lang"), labels).count() == 5


def test_every_labelled_document_counts(spark):
    hashed = F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    late = F.when((F.col("place") > 4000) & (F.col("bad") == 1), F.lit(" rotten")).otherwise(F.lit(""))
    docs = spark.range(5000).withColumnRenamed("id", "doc_id").withColumn("place", hashed).withColumn("bad", (F.xxhash64("doc_id", F.lit(3)) % 3 == 0).cast("int"))
    docs = docs.select("doc_id", F.concat(F.lit("some words "), F.when(F.col("doc_id") % 5 == 0, "apple").otherwise("pear"), late).alias("text"), F.lit("en").alias("lang"), "bad").localCheckpoint()
    ranker = quality.fit(docs, docs.select("doc_id", (1 - F.col("bad")).alias("quality"), F.lit(0).alias("toxic")))
    rotten = quality._short(quality.word_hashes(np.frombuffer(b"rotten", np.uint8), np.array([0, 6]))[0])
    assert np.isin(rotten, ranker.words).all() and ranker.word_weights[np.searchsorted(ranker.words, rotten)][0] < 0


def test_gradient_is_that_of_all_pairs_held_or_not(spark):
    draw = np.random.default_rng(6)
    n, langs = 120, np.array(["a", "b", "c"])
    name, good, fold = langs[draw.integers(0, 2, 120)], draw.integers(0, 2, 120), draw.integers(0, 2, 120)
    name[:3], good[:3] = "c", 1  # a class is missing
    x, own = draw.standard_normal((n, quality.N_DENSE)), [sorted(draw.choice(30, 6, replace=False).tolist()) for _ in range(n)]
    rows = spark.createDataFrame([(str(a), int(b), int(c), d.tolist(), e) for a, b, c, d, e in zip(name, good, fold, x, own, strict=True)], "lang string, good int, fold int, x array<double>, words array<int>")
    words = np.arange(20, dtype=np.uint32)
    packed = quality.written(rows.mapInArrow(lambda b: quality._packed(b, words, np.zeros(9), np.ones(9), {"a": 0, "b": 1}), quality._PACKED))
    features = np.hstack([[[float(i in o) for i in range(20)] for o in own], np.clip(x, -6, 6)])
    w = draw.standard_normal((29, 3)) * 0.4
    want = np.zeros((29, 3))
    for m in range(3):
        used = [np.flatnonzero((name == c) & (fold != m)) for c in "ab"]
        for u in used:
            b, v = (features[u[good[u] == k]] for k in (1, 0))
            d = (b[:, None] - v[None]).reshape(-1, 29)
            want[:, m] -= len(u) / sum(map(len, used)) * (d / (1 + np.exp(d @ w[:, m]))[:, None]).mean(0)
    for held in (1 << 20, -1):
        assert np.abs(quality._gradient(quality._passes(packed, held), w, 2) - want).max() < 2e-5
    a, b = (quality._passes(packed, held)(lambda block: np.stack([quality._scores(block, w[:, m]) for m in range(3)], 1), True) for held in (1 << 20, -1))
    assert np.allclose(np.sort(a[3], 0), np.sort(b[3], 0)) and np.allclose(np.sort(a[3], 0), np.sort(features @ w, 0), atol=1e-5)
