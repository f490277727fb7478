import math
import random
import string
from collections import Counter, defaultdict

from inkstone.llm import perplexity

SCHEMA = "doc_id long, lang string, text string"


def planted():
    draw = random.Random(5)
    of = lambda alphabet, n: "".join(draw.choice(alphabet) for _ in range(n))
    alphabets = {"hex": "0123456789abcdef", "ascii": "".join(map(chr, range(33, 127))), "letters": string.ascii_lowercase}
    return [(name, of(x, n)) for name, x in alphabets.items() for n in (80, 150, 200, 300, 600, 1000, 2000, 3000)]


def test_gibberish_does_not_vouch_for_itself(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text").where("lang = 'en'")
    junk = [(-1 - i, "en", text) for i, (_, text) in enumerate(planted())]
    rated = perplexity.rate(docs.unionByName(spark.createDataFrame(junk, docs.schema))).collect()
    kept = {r["doc_id"]: r["keep"] for r in rated}
    assert not any(kept[d] for d, _, _ in junk)
    assert sum(kept[d] for d in kept if d >= 0) > 0.93 * docs.count()


class Plain:
    """Modified Kneser-Ney over Python dictionaries."""

    def __init__(self, texts):
        n = perplexity.ORDER
        grams = Counter()
        for t in texts:
            s = (1,) * (n - 1) + tuple(map(ord, t)) + (2,)
            grams.update(s[i : i + n] for i in range(len(s) - n + 1))
        self.counts = {n: grams}
        for k in range(n - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.cuts, self.total, self.freed = {}, defaultdict(int), defaultdict(float)
        for k, c in self.counts.items():
            m = Counter(c.values())
            y = m[1] / max(m[1] + 2 * m[2], 1)
            self.cuts[k] = [min(max(i - (i + 1) * y * m[i + 1] / m[i], 0.05 * i), 0.95 * i) if m[i] else 0.5 * i for i in (1, 2, 3)]
            for g, x in c.items():
                self.total[k, g[:-1]] += x
                self.freed[k, g[:-1]] += self.cuts[k][min(x, 3) - 1]

    def p(self, g):
        k = len(g)
        if not k:
            return 1 / (len(self.counts[1]) + 1)
        if (k, g[:-1]) not in self.total:
            return self.p(g[1:])
        x = self.counts[k][g]
        own = (x - self.cuts[k][min(x, 3) - 1]) / self.total[k, g[:-1]] if x else 0
        return own + self.freed[k, g[:-1]] / self.total[k, g[:-1]] * self.p(g[1:])

    def loss(self, t):
        n = perplexity.ORDER
        s = (1,) * (n - 1) + tuple(map(ord, t)) + (2,)
        all_ = [-math.log(self.p(s[i : i + n])) for i in range(len(s) - n + 1)]
        return sum(all_) / len(all_)


def test_losses_equal_plain_kneser_ney(spark):
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang IN ('de', 'fr')").select("doc_id", "lang", "text").limit(14).collect()]
    rows += [(-1, "de", "日本語の文。日本"), (-2, "de", "日本 x y"), (-3, "fr", ""), (-4, "fr", None), (-5, "xx", "abc")]
    docs = spark.createDataFrame(rows, SCHEMA)
    path = perplexity.stored(perplexity.model(perplexity.written(perplexity.count(docs.where("lang != 'xx'")))))
    new = spark.createDataFrame([(100, "de", "ganz neu; 42 日本人"), (101, "fr", "vœux ßß"), (102, "fr", "")], SCHEMA)
    got = {r["doc_id"]: r["loss"] for r in perplexity.log_losses(docs.unionByName(new), path).collect()}
    plain = {lang: Plain([t or "" for _, x, t in rows if x == lang]) for lang in ("de", "fr")}
    for d, lang, t in [*rows, *(tuple(r) for r in new.collect())]:
        want = plain[lang].loss(t or "") if lang in plain else math.log(65536)
        assert abs(got[d] - want) < 3e-5, (d, got[d], want)
    de = plain["de"]
    alphabet = [g[0] for g in de.counts[1]]
    for context in ((1, 1, 1), (1, 1, ord("D")), (ord("e"), ord("n"), ord(" ")), (9999, 9998, 9997)):
        assert abs(sum(de.p((*context, a)) for a in alphabet) + de.p((*context, 77777)) - 1) < 1e-9


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "xx", "one text alone"), (2, None, None), (3, "yy", ""), (3, "yy", ""), (None, "yy", "z")], SCHEMA)
    assert {(r["doc_id"], r["lang"]) for r in perplexity.rate(docs).collect() if r["keep"]} >= {(1, "xx"), (2, "und")}
    extra = docs.selectExpr("*", "1 AS keep", "2 AS loss", "3 AS model")
    assert perplexity.filtered(extra).columns == extra.columns and perplexity.filtered(extra).count() >= 2
    assert perplexity.rate(docs.limit(0)).count() == 0 == perplexity.filtered(docs.limit(0)).count()
