import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from inkstone import registry
from inkstone.functions import norm, plain, plain_at_once
from inkstone.plans.dialect import DUCK, SPARK
from inkstone.sources import views

QUOTE = "The keeper of the lighthouse wrote down every ship that passed, its colours, its course and the hour; nobody ever asked him for the book."
WORDS = "amber birch cloud drift ember frost grove heron inlet jetty knoll larch maple north ocean pearl quill ridge stone thorn under vapor water yield zebra".split()


def broken(text: str) -> str:
    """text with a digit put in where it breaks only grams that aren't among the 48 with the least hashes."""
    bare = "".join(c for c in text.lower() if c.isalnum())
    least = sorted({bare[i : i + 3] for i in range(len(bare) - 2)}, key=lambda g: (hashlib.md5(g.encode()).hexdigest(), g))[:48]
    return next(t for k in range(3, len(bare) - 3) if all(g in (t := bare[:k] + "7" + bare[k:]) for g in least))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with repeated numbers, nulls, empty and short texts; their folder and what DuckDB makes of them."""
    where, draw = tmp_path_factory.mktemp("odd"), random.Random(5)
    text = lambda n: "\n".join(" ".join(draw.choices(WORDS, k=draw.randint(1, 60))) for _ in range(n))
    docs = [(i, text(draw.randint(1, 12))) for i in range(-4, 60)]
    docs += [(61, f"{QUOTE}\n{broken(QUOTE)}\nThe ke­eper… of"), (62, f"{QUOTE}\n{broken(QUOTE)}\nno\n{text(3)}"), (63, ""), (64, None), (65, "...\n!?\nab"), (None, QUOTE)]
    half = len(QUOTE) // 2
    docs += [(71, QUOTE[: half + 2]), (71, QUOTE[half:]), (73, text(5)), (73, text(7)), (71, QUOTE), (73, f"{text(3)}\n{QUOTE}")]
    quotes = [(1, QUOTE), (2, "amber birch, cloud drift"), (3, "ab"), (4, "heron inlet jetty"), (4, "water yield"), (5, None), (61, "keeper of the"), (73, text(1))]
    spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 4}", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(quotes, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet/*.parquet'")
    return str(where), con


def rows(name, spark, odd):
    got = registry.QUERIES[name][0](spark, odd[0])
    return sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=repr)


def wanted(name, odd):
    want = odd[1].sql(registry.QUERIES[name][1])
    return sorted(want.project(", ".join(sorted(want.columns))).fetchall(), key=repr)


def overlaps(odd):
    """(item, paragraph) -> number of trigrams, counted row by row; item -> its trigrams."""
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    asked, n = defaultdict(set), Counter()
    for item, t in odd[1].sql(f"SELECT item_id, {plain(DUCK, norm(DUCK, 'text'))} FROM benchmark").fetchall():
        asked[item] |= grams(t or "")
    for name, t in odd[1].sql(f"WITH {views(DUCK)} SELECT paragraph_id, plain FROM paragraphs WHERE eligible").fetchall():
        for item, own in asked.items():
            n[item, name] += len(own & grams(t))
    return n, asked


@pytest.mark.parametrize("name", ["bm25_topk", "gram_overlap", "ngram_counts", "trigram_and", "trigram_or_topk", "trigram_postings"])
def test_odd_tables_equal_sql(spark, odd, name):
    assert rows(name, spark, odd) == wanted(name, odd) != []


def test_all_trigrams_are_asked_for(spark, odd):
    n, asked = overlaps(odd)
    both = rows("trigram_and", spark, odd)
    assert both == sorted(((i, p) for (i, p), k in n.items() if k and k == len(asked[i])), key=repr)
    assert (1, "doc-61-P000000") in both and (1, "doc-61-P000001") not in both  # it has 48 of them, and others not
    assert {(i, p): k for i, k, p, _ in rows("trigram_or_topk", spark, odd)} == {x: k for x, k in n.items() if k}


def test_few_rows_leave_a_task_and_blocks_agree(spark, odd, monkeypatch):
    """Cells so few that each quote is a block of its own and blocks take several passes; the best of each task only."""
    from inkstone.operators import grams as g

    before = rows("trigram_or_topk", spark, odd), rows("bm25_topk", spark, odd), rows("trigram_and", spark, odd)
    monkeypatch.setattr(g, "CELLS", 64)
    monkeypatch.setattr(g, "BLOCKS", 2)
    assert (rows("trigram_or_topk", spark, odd), rows("bm25_topk", spark, odd), rows("trigram_and", spark, odd)) == before
    items = {i: {f"{x:03}" for x in range(i, i + 50)} for i in range(9)}
    assert [len(one) for one in g.blocks(items)] == [2, 2, 2, 2, 1]
    best = g.Best(2, 3)
    import numpy as np

    draw = np.random.default_rng(3)
    score = draw.integers(0, 9, (500, 2)).astype(float)
    names = np.array([f"p{i:03}".encode() for i in draw.permutation(500)])
    for k in range(0, 500, 50):
        best.add(names[k : k + 50], score[k : k + 50], score[k : k + 50], np.zeros(50, int))
        best.cut()
    item, value, name, *_ = best.cut()
    for q in range(2):
        assert [(v, n) for i, v, n in zip(item, value, name, strict=True) if i == q] == sorted(((s, n) for s, n in zip(score[:, q], names, strict=True)), key=lambda x: (-x[0], x[1]))[:3]


def test_plain_at_once(spark):
    """The one step equals both over every character, among them those whose lower case depends on what follows."""
    from pyspark.sql import functions as F

    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000] + ["😀", "𝐀", "\U0001f1e6"]
    texts = [f"{a}{c}{b}" for c in chars for a, b in (("Xo", "Yo."), (" ", "-\n"))] + [f"ΑΣ{c}Β ΟΣ{c} " for c in chars[:0x3100:7]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.expr(plain_at_once(SPARK, "t")).alias("a"), F.expr(plain(SPARK, norm(SPARK, "t"))).alias("b"))
    assert df.where("NOT a <=> b").count() == 0


def test_window_ratio_equals_difflib():
    from difflib import SequenceMatcher

    from inkstone.operators import quotes as q

    def one_by_one(query, text):
        at, best = text.find(query), (0.0, 0, 0)
        if at >= 0:
            return 0.91, at, at + len(query) - 1
        if len(text) <= len(query):
            return SequenceMatcher(None, query, text).ratio(), 0, max(0, len(text) - 1)
        for s, size in q.windows(len(query), len(text)):
            if (r := SequenceMatcher(None, query, text[s : s + size]).ratio()) > best[0]:
                best = (r, s, s + size - 1)
        return best

    draw, pairs = random.Random(11), [("abc", ""), ("", "abc"), ("ab", "ba"), ("😀b😀" * 30, "b😀" * 80)]
    for _ in range(60):
        letters = draw.choice(["ab", "abcdefg", "etaoinshrdlucmfwygpb"])
        query = "".join(draw.choices(letters, k=draw.choice([4, 30, 63, 64, 126, 150, 210])))
        near = "".join(draw.choice(letters) if draw.random() < 0.2 else c for c in query if draw.random() > 0.1)
        pairs.append((query, "".join(draw.choices(letters, k=draw.randint(0, 200))) + near * draw.randint(0, 1) + "".join(draw.choices(letters, k=draw.randint(0, 200)))))
    want = [one_by_one(*p) for p in pairs]
    assert q.best_windows(pairs) == want
    assert q.best_windows(pairs, 0.58) == [w if w[0] >= 0.58 else (0.0, g[1], g[2]) for w, g in zip(want, q.best_windows(pairs, 0.58), strict=True)]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
        return row[-1]

    some = [(a, b, q.windows(len(a), len(b))[:5]) for a, b in pairs[2:30]]
    assert q.common(some) == [[lcs(a, b[s : s + n]) for s, n in parts] for a, b, parts in some]


def test_few_windows_are_compared(monkeypatch):
    """Of texts of one language hardly any window can reach the least ratio; each was compared before."""
    from inkstone.operators import quotes as q

    draw, calls, of = random.Random(2), [], q.matched
    monkeypatch.setattr(q, "matched", lambda *x: calls.append(1) or of(*x))
    texts = ["".join(draw.choices(WORDS, k=300)) for _ in range(20)]
    pairs = [(t[:180], u) for t in texts for u in texts if t is not u]
    assert not any(r >= 0.58 for r, *_ in q.best_windows(pairs, 0.58))
    assert len(calls) < 0.05 * sum(len(q.windows(len(a), len(b))) for a, b in pairs)


def test_fuzzy_quote_verifies_every_candidate(spark, odd):
    from inkstone.operators import quotes as q

    n, _ = overlaps(odd)
    text = defaultdict(list)
    for name, t in odd[1].sql(f"WITH {views(DUCK)} SELECT paragraph_id, plain FROM paragraphs").fetchall():
        text[name].append(t)
    queries = odd[1].sql(f"SELECT item_id, {plain(DUCK, norm(DUCK, 'text'))} FROM benchmark").fetchall()
    want = [(a, i, b, name, r, min(0.9, r)) for i, t in queries for (item, name), k in n.items() if item == i and k and t for u in text[name] for r, a, b in [q.best_window(t, u)] if r >= 0.58]
    assert rows("fuzzy_quote", spark, odd) == sorted(want, key=repr) != []


@pytest.mark.parametrize("each", [False, True])
def test_gram_counts_by_number_and_by_name(each):
    """Few letters, more than a table holds, and both after one another equal counting one by one."""
    from inkstone.operators.grams import Grams

    draw = random.Random(4)
    of = lambda first, n, k: ["".join(chr(first + draw.randrange(n)) for _ in range(draw.randrange(90))) for _ in range(k)]
    for texts in (of(97, 26, 99), of(97, 26, 40) + of(0x400, 120, 60) + of(0x4E00, 5000, 60) + of(97, 9, 40) + ["aaaa", "a" * 300], ["ab", "", "abc", "abc"], of(0x1F300, 40, 50)):
        grams = Grams(3, each)
        for k in range(0, len(texts), 30):
            grams.add(texts[k : k + 30])
        got = grams.taken()
        assert dict(zip(*(c.to_pylist() for c in got.columns), strict=True)) == Counter(g for t in texts for g in (set if each else list)(t[i : i + 3] for i in range(len(t) - 2)))
        assert grams.taken().num_rows == 0


def test_no_gram_is_a_row_before_it_is_counted(spark, odd):
    """What is shuffled is a task's counts; grams were rows, and bigrams those of documents that no quote has the number of."""
    for name in ("ngram_counts", "trigram_postings"):
        plan = registry.QUERIES[name][0](spark, odd[0])._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode(" not in plan
    registry.QUERIES["gram_overlap"][0](spark, odd[0])
    assert {r[0] for r in spark.table("documents").select("doc_id").collect()} == {1, 2, 3, 4, 5, 61, 73}
