import random

import numpy as np
from inkstone.llm import spans
from inkstone.llm.licenses import words_of


def brute(doc, item):
    """Maximal common passages of at least LEAST words."""
    out = set()
    for i in range(len(doc)):
        for j in range(len(item)):
            if doc[i] == item[j] and not (i and j and doc[i - 1] == item[j - 1]):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                    n += 1
                if n >= spans.LEAST:
                    out.add((i, j, n))
    return out


def made():
    draw = random.Random(2)
    words = "ab cd ef gh ij kl mn op".split()
    items = [(i, " ".join(draw.choices(words, k=draw.randint(5, 60)))) for i in range(12)] + [(12, None), (13, "")]
    docs = []
    for i in range(90):
        parts = draw.choices(words, k=draw.randint(0, 40))
        for _ in range(draw.randint(0, 3)):
            w = (draw.choice(items)[1] or "").split()
            a = draw.randint(0, len(w))
            parts += w[a : a + draw.randint(0, 40)] + draw.choices(words, k=draw.randint(0, 9))
        docs.append((i, ", ".join(parts)))
    return docs + [(None, None), (91, ""), (91, "")], items


def test_matches_equal_brute_force(spark):
    docs, items = made()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS matches", "2 AS item_id")
    queries = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, t in docs:
        own = t.replace(",", "").split() if t else []
        want.append((d, len(own), sorted((k, *m) for k, x in items if x for m in brute(own, x.split()))))
    assert sum(len(w[2]) for w in want) > 30
    key = lambda r: (r[0] is None, r)
    for block in (2_000_000, 60):
        got = [(r["doc_id"], r["n_words"], [tuple(m) for m in r["matches"]]) for r in spans.fingerprints(frame, queries, block).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert spans.fingerprints(frame.limit(0), queries).count() == 0
    assert spans.fingerprints(frame, queries.limit(0)).where("size(matches) = 0").count() == 93


def test_span_equality_and_extensions():
    words = words_of("a b c a b d a b c a b c a b d")
    p = spans.Prefix(words)
    for a in range(len(words)):
        for b in range(len(words)):
            n = next((k for k in range(len(words) - max(a, b) + 1) if a + k >= len(words) or b + k >= len(words) or words[a + k] != words[b + k]), 0)
            room = np.array([len(words) - max(a, b)])
            assert p.extension(np.array([a]), p, np.array([b]), room)[0] == n
            for k in range(room[0] + 1):
                assert (p.span(np.array([a]), np.array([a + k])) == p.span(np.array([b]), np.array([b + k])))[0] == (k <= n)


def test_whole_text_fingerprint(spark):
    rows = spark.createDataFrame([(1, "One two, three"), (2, "one TWO three!"), (3, "one two four")], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in spans.fingerprints(rows, spark.createDataFrame([], "item_id long, text string")).collect()}
    assert got[1] == got[2] != got[3]
