import random
from collections import defaultdict

from inkstone.llm import packing
from inkstone.llm.packing import best_fit, cut

SMALL = "/root/testdata/sf0.001"


def one_by_one(sizes, length):
    """Room left in each sequence after best-fit decreasing, piece by piece."""
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(left) if r >= s]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= s
        else:
            left.append(length - s)
    return sorted(left)


def test_best_fit_equals_packing_one_by_one():
    draw = random.Random(3)
    for length in (1, 5, 10, 37, 64):
        for _ in range(60):
            sizes = [draw.randint(1, length) for _ in range(draw.randint(0, 80))]
            histogram = {s: sizes.count(s) for s in set(sizes)}
            held = defaultdict(int)
            placed = defaultdict(list)
            for size, first, stop, sequence, each in best_fit(histogram, length):
                placed[size] += range(first, stop)
                for r in range(first, stop):
                    held[sequence + (r - first) // each] += size
            assert all(sorted(placed[s]) == list(range(n)) for s, n in histogram.items())
            assert sorted(length - x for x in held.values()) == one_by_one(sizes, length)


def test_cut_keeps_every_word():
    assert cut(" a b\n c  d\te ", 2) == ["a b", "c  d", "e"]
    assert cut("ä b c d", 2) == ["ä b", "c d"]


def test_packed_holds_all_words_of_all_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(docs.limit(2)).unionByName(spark.createDataFrame([(None, "x y", "en", None, 3), (7, None, "en", None, 0)], docs.schema))
    length = 64
    got = packing.packed(docs, length).collect()
    sizes, words = [], defaultdict(list)
    for r in docs.collect():
        w = (r["text"] or "").split()
        words[r["doc_id"]] += w
        sizes += [len(w[i : i + length]) for i in range(0, len(w), length)]
    back = defaultdict(list)
    for r in got:
        assert r["n_tokens"] == sum(len(p["text"].split()) for p in r["pieces"]) <= length
        for p in r["pieces"]:
            back[p["doc_id"]] += p["text"].split()
    assert {k: sorted(v) for k, v in back.items()} == {k: sorted(v) for k, v in words.items() if v}
    assert sorted(length - r["n_tokens"] for r in got) == one_by_one(sizes, length)


def test_the_tree_finds_the_tightest():
    draw = random.Random(1)
    for length in (1, 7, 8, 100):
        tree, held = packing.Capacities(length), [0] * (length + 1)
        for _ in range(300):
            at = draw.randint(0, length)
            n = -1 if held[at] and draw.random() < 0.5 else 1
            held[at] += n
            tree.add(at, n)
            size = draw.randint(0, length)
            assert tree.tightest(size) == next((c for c in range(size, length + 1) if held[c]), -1)


def test_edge_cases(spark):
    docs = spark.createDataFrame([("a", None, 1), ("b", " \n", 2), (None, "x " * 50, 3), (None, "x " * 50, 3)], "doc_id string, text string, sequence int")
    got = packing.packed(docs, 16).collect()
    assert sum(r["n_tokens"] for r in got) == 100 and max(r["n_tokens"] for r in got) == 16 and len(got) == 7
    assert packing.packed(docs.limit(0), 16).count() == 0
