import random

import numpy as np
from inkstone.llm import licenses
from inkstone.llm.license_texts import TEMPLATES
from inkstone.llm.licenses import words_of


def full(text, template):
    """Score and matched words of the best local alignment, without a band."""
    best = (0, 0)
    row = [(0, 0)] * (len(text) + 1)
    for t in template:
        new = [(0, 0)]
        for j, w in enumerate(text):
            s, m = row[j]
            a = (s + 2, m + 1) if w == t else (s - 1, m)
            new.append(max((0, 0), a, (row[j + 1][0] - 1, row[j + 1][1]), (new[j][0] - 1, new[j][1])))
            best = max(best, new[-1])
        row = new
    return best


def edited(draw, text, n):
    w = text.split()
    for _ in range(n):
        at = draw.randrange(len(w))
        w[at : at + draw.randint(0, 1)] = draw.choice([[], ["zzz"], [w[at], "qqq"]])
    return " ".join(w)


def test_band_finds_the_best_alignment():
    draw = random.Random(1)
    index = licenses.Index(TEMPLATES)
    for name in ("mit", "apache-2.0", "gpl-3.0-notice"):
        for n in (0, 1, 3, 6):
            text = "some words before " + edited(draw, TEMPLATES[name], n if "notice" not in name else min(n, 1)) + " and some after"
            words, template = words_of(text), words_of(TEMPLATES[name])
            found = [x for x in licenses.occurrences(words, index, 0.5) if index.names[x[0]] == name]
            score, matched = full(words.tolist(), template.tolist())
            assert len(found) == 1 and abs(found[0][1] - matched) <= 1, (name, n, found, score, matched)


def test_scan(spark):
    rows = [(1, "x\nReleased under the MIT License.\ny " * 3), (2, TEMPLATES["apache-2.0"].upper()), (3, "Licensed under CC BY-NC 4.0."), (4, None), (None, ""), (5, "released under the license"), (6, "Released under the MIT License"), (6, "Released under the MIT License")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS license", "2 AS coverage")
    got = [(r["doc_id"], r["license"], r["coverage"], r["first_word"], r["end_word"]) for r in licenses.scan(docs).collect()]
    assert sorted(x for x in got if x[0] == 1) == [(1, "mit-notice", 1.0, a, a + 5) for a in (1, 8, 15)]
    assert {x[1] for x in got if x[0] == 2} == {"apache-2.0", "apache-2.0-notice"}
    assert ("cc-by-nc-4.0-notice", 1.0) in {x[1:3] for x in got if x[0] == 3}
    assert sum(x[0] == 6 for x in got) == 2 and not [x for x in got if x[0] in (4, 5, None)]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_winnowing_keeps_one_of_two():
    words = np.random.default_rng(1).integers(0, 1 << 60, 50).astype(np.uint64)
    _, at = licenses.winnowed(words)
    assert np.diff(at).max() <= 2 and at[0] <= 1 and at[-1] >= 45


def test_given_notices_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = docs.where("text LIKE '%Released under the MIT License.%' OR text LIKE '%Licensed under the Apache License, Version 2.0.%' OR text LIKE '%Licensed under CC BY-NC 4.0.%' OR text LIKE '%licensed under the GNU General Public License, version 3.%'")
    want = {r["doc_id"] for r in lines.collect()}
    assert want and want <= {r["doc_id"] for r in licenses.scan(docs).collect()}
