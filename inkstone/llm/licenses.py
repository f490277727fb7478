"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment.

Texts and templates are sequences of words; case and punctuation don't count. Of any two neighbouring grams of K words, the
one with the lesser hash is a fingerprint, so a text and a template that share K + 1 words in a row share a fingerprint. The
index holds the templates' fingerprints and goes to every task: its size is that of the templates, which are a parameter of
the operator and not data. What the index meets near one diagonal makes a candidate, and a local alignment in a band round it
finds which of the template's words the text has, and where.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, fixed, gram_hashes, lowered, word_hashes
from .license_texts import TEMPLATES

K = 4
MATCH, MISS, GAP = 2, -1, -1


def words_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.lower().encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)], np.int64))[0]


def winnowed(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the fingerprints of one text."""
    g = gram_hashes(words, K)
    if len(g) < 2:
        return g, np.arange(len(g))
    at = np.unique(np.arange(len(g) - 1) + (g[1:] <= g[:-1]))
    return g[at], at


class Index:
    """Sorted fingerprints of all templates with where they occur."""

    def __init__(self, templates: Mapping[str, str]) -> None:
        self.names = sorted(templates)
        self.words = [words_of(templates[n]) for n in self.names]
        found = [winnowed(w) for w in self.words]
        h = np.concatenate([f[0] for f in found] or [np.zeros(0, np.uint64)])
        by = np.argsort(h, kind="stable")
        self.hash = h[by]
        self.template = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])[by]
        self.place = np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])[by]

    def band(self, template: int) -> int:
        """A quarter of the template: wide enough for its edits, too narrow for two occurrences side by side."""
        return max(2, len(self.words[template]) // 4)

    def meet(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of h, template, word of the template) of all meetings."""
        lo, n = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, "right")
        n -= lo
        which = np.repeat(np.arange(len(h)), n)
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return which, self.template[at], self.place[at]


def align(text: np.ndarray, template: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int, int, int]:
    """(matched words, first and last + 1 word of the text, of the template) of the best local alignment within the band.

    Cell (i, j) stands for word i of the template and word i + diagonal - band + j of the text.
    """
    rows, width = len(template), 2 * band + 1
    score = np.zeros((rows + 1, width + 1), np.int32)  # a column of zeros to the right
    base = diagonal - band
    steps = np.arange(width, dtype=np.int32)
    same = np.zeros((rows, width), bool)
    for i in range(rows):
        lo, hi = max(0, -(base + i)), min(width, len(text) - base - i)
        if lo >= hi:
            continue
        same[i, lo:hi] = text[base + i + lo : base + i + hi] == template[i]
        best = np.maximum(score[i, :width] + np.where(same[i], MATCH, MISS), score[i, 1:] + GAP)
        best = np.maximum(best, 0)
        best[:lo] = best[hi:] = 0
        along = np.maximum.accumulate(best - GAP * steps) + GAP * steps  # skips words of the text
        score[i + 1, lo:hi] = along[lo:hi]
    ends = np.argwhere(score[:, :width] == score[:, :width].max())
    i, j = map(int, ends[np.argmin(np.abs(ends[:, 1] - band))])  # the nearest to the diagonal
    matched = 0
    end = (base + i + j, i)
    first = (0, 0)
    while i > 0 and score[i, j] > 0:
        s = score[i, j]
        if s == score[i - 1, j] + (MATCH if same[i - 1, j] else MISS):
            matched += int(same[i - 1, j])
            i -= 1
            first = (base + i + j, i)
        elif s == score[i - 1, j + 1] + GAP and j + 1 <= width:
            i, j = i - 1, j + 1
        elif j and s == score[i, j - 1] + GAP:
            j -= 1
        else:
            matched += int(same[i - 1, j])
            first = (base + i - 1 + j, i - 1)
            break
    return matched, first[0], end[0], first[1], end[1]


def occurrences(words: np.ndarray, index: Index, least: float) -> list[tuple[int, int, int, int, int, int]]:
    """(template, matched words, spans as in align()) of one text's occurrences with a coverage of at least `least`."""
    h, place = winnowed(words)
    which, template, at = index.meet(h)
    if not len(which):
        return []
    diagonal = place[which] - at
    by = np.lexsort((diagonal, template))
    template, diagonal = template[by], diagonal[by]
    out = []
    starts = np.flatnonzero(np.concatenate([[True], (template[1:] != template[:-1]) | (np.diff(diagonal) > 4)]))
    for a, b in zip(starts, [*starts[1:], len(template)], strict=True):
        t = int(template[a])
        band = index.band(t)
        tried = None
        for d in diagonal[a:b]:  # a run of diagonals wider than the band takes several
            if tried is None or d - tried > band // 2:
                tried = int(d)
                found = align(words, index.words[t], tried, band)
                if found[0] >= least * len(index.words[t]):
                    out.append((t, *found))
    out.sort(key=lambda x: (x[0], -x[1], x[2]))
    kept: list[tuple[int, int, int, int, int, int]] = []
    for x in out:  # of occurrences of a template that overlap the best stays
        if not any(y[0] == x[0] and y[2] < x[3] and x[2] < y[3] for y in reversed(kept[-64:])):
            kept.append(x)
    return kept


def scan(documents: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = 0.7) -> DataFrame:
    """(doc_id, license, matched, coverage, first_word, end_word, template_first, template_end): a row for each occurrence.

    coverage is the share of the template's words that the alignment matches, `least` or more; spans count words from 0, the
    end exclusive. Several templates may cover one passage; of overlapping occurrences of one template the best is given
    (on ties the first). One pass without a shuffle over whole texts. Null, empty and wordless texts have none; repeated rows
    are scanned apiece; doc_id may be null or of any type; an empty table gives no rows; further columns are ignored.
    Templates of fewer than K words are never found.
    """
    index = Index(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(lowered(batch.column(1))):
                h, _, _, splits = word_hashes(data, offsets)
                likely = np.flatnonzero(np.isin(gram_hashes(h, K), index.hash))
                rows, found = [], []
                for i in np.unique(np.searchsorted(splits, likely, "right") - 1).tolist():
                    own = occurrences(h[splits[i] : splits[i + 1]], index, least)
                    rows += [i + lo] * len(own)
                    found += own
                if found:
                    t, matched, a, b, c, d = (np.array(x, np.int32) for x in zip(*found, strict=True))
                    size = np.array([len(w) for w in index.words])[t]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([index.names[x] for x in t]), *(pa.array(x) for x in (matched, np.round(matched / size, 4), a, b, c, d))], ["doc_id", "license", "matched", "coverage", "first_word", "end_word", "template_first", "template_end"])

    rows = documents.select(*fixed("doc_id", "text")).toDF("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, license string, matched int, coverage double, first_word int, end_word int, template_first int, template_end int")
