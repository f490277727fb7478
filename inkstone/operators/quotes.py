"""Finding quotations in paragraphs: by automaton for substrings, by window ratio for approximate ones."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 50_000  # quotes in one automaton


def hits(paragraphs: DataFrame, quotes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(item_id, paragraph_id, tier): every paragraph that holds a quote, by the strictest form in which it does.

    tier is 1 for the raw text, 2 for the normalised, 3 without white space, 4 without punctuation. Both sides have text_raw, norm,
    compact and plain. Each paragraph is read once against an automaton of the quotes' plain forms, without a shuffle; quotes
    beyond `block` take further passes, so what a task holds is bounded.
    """
    n = max(1, -(-quotes.count() // block))
    out = None
    for i in range(n):
        held = [tuple(r) for r in quotes.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).where("length(plain) > 0").select("item_id", "text_raw", "norm", "compact", "plain").collect()]
        found = paragraphs.select("paragraph_id", "text_raw", "norm", "compact", "plain").mapInArrow(_search(held), "item_id long, paragraph_id string, tier int")
        out = found if out is None else out.unionByName(found)
    return out


def _automaton(words):
    """Of words and what each is for."""
    import ahocorasick

    automaton, by = ahocorasick.Automaton(), {}
    for word, what in words:
        by.setdefault(word, []).append(what)
    for word, own in by.items():
        automaton.add_word(word, own)
    automaton.make_automaton()
    return automaton if by else None


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[list[list]]:
    """Columns of a few rows at a time, so that a worker holds few texts as Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield [c.to_pylist() for c in batch.slice(k, rows).columns]


def holding(documents: DataFrame, quotes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Numbers of documents (doc_id, plain) that may have hits: the whole text's plain form holds that of a quote.

    A paragraph is a piece of its document, and plain forms are made character by character, so no hit is outside of these.
    Documents without a plain form always count.
    """
    n = max(1, -(-quotes.count() // block))
    out = None
    for i in range(n):
        held = [r[0] for r in quotes.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).where("length(plain) > 0").select("plain").distinct().collect()]

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            automaton = _automaton((w, w) for w in held)
            for ids, plain in _slices(batches):
                own = [i for i, t in zip(ids, plain, strict=True) if automaton and (t is None or next(automaton.iter(t), None))]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64())], ["doc_id"])

        found = documents.select("doc_id", "plain").mapInArrow(run, "doc_id long")
        out = found if out is None else out.unionByName(found)
    return out


def _search(quotes: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton((q[4], k) for k, q in enumerate(quotes))
        for names, raw, norm, compact, plain in _slices(batches):
            items, paragraphs, tiers = [], [], []
            for row, text in enumerate(plain if automaton else []):
                if not text:
                    continue
                for k in {k for _, own in automaton.iter(text) for k in own}:
                    q = quotes[k]
                    items.append(q[0])
                    paragraphs.append(names[row])
                    tiers.append(1 if q[1] in raw[row] else 2 if q[2] in norm[row] else 3 if q[3] in compact[row] else 4)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(paragraphs, pa.string()), pa.array(tiers, pa.int32())], ["item_id", "paragraph_id", "tier"])

    return run


def windows(n: int, length: int) -> list[tuple[int, int]]:
    """(first, size) of the parts of a text that a query of n characters is compared with, in order.

    A text no longer than the query is compared as a whole. Otherwise windows of four lengths slide by a third of the query, and
    the tail is tried too.
    """
    if length <= n:
        return [(0, length)]
    out = []
    for size in sorted({n, int(n * 1.25) + 1, int(n * 1.6) + 1, n + 8}):
        size = min(size, length)
        starts = list(range(0, length - size + 1, max(1, n // 3)))
        if starts[-1] != length - size:
            starts.append(length - size)
        out += [(s, size) for s in starts]
    return out


def matched(a: str, b: str, more: float = -1.0) -> int:
    """Characters that SequenceMatcher(None, a, b) matches, or 0 as soon as its ratio can't be above `more`.

    Where a[i] equals b[j] a bit is set in one large number; shifted and joined with itself it shows where the longest common
    piece begins first, which is the one that SequenceMatcher takes. Letters that it leaves out as too common in b only extend pieces.
    """
    where: dict[str, int] = {}
    for j, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << j
    if len(b) >= 200:
        most = len(b) // 100 + 1
        where = {c: m for c, m in where.items() if m.bit_count() <= most}
    least, total = more * (len(a) + len(b)) / 2, 0
    rest, todo = min(len(a), len(b)), [(0, len(a), 0, len(b))]
    while todo:
        if total + rest < least - 1e-6:
            return 0
        alo, ahi, blo, bhi = todo.pop()
        rest -= min(ahi - alo, bhi - blo)
        width = (bhi - blo) // 8 + 1  # bytes a row, with a bit to spare
        keep, none = (1 << bhi - blo) - 1, bytes(width)
        own = a[alo:ahi]
        row = {c: (where[c] >> blo & keep).to_bytes(width, "little") if c in where else none for c in set(own)}
        bits = int.from_bytes(b"".join([row[c] for c in own]), "little")
        i, j, k = alo, blo, 0
        if bits:
            by, runs = 8 * width + 1, [bits]  # runs[p]: where pieces of 2**p or more begin
            while bits := bits & bits >> (by << len(runs) - 1):
                runs.append(bits)
            k, found = 1 << len(runs) - 1, runs[-1]
            for p in range(len(runs) - 2, -1, -1):
                if longer := found & runs[p] >> by * k:
                    k, found = k + (1 << p), longer
            at = (found & -found).bit_length() - 1
            i, j = alo + at // (8 * width), blo + at % (8 * width)
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, k = i - 1, j - 1, k + 1
        while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
            k += 1
        if k:
            total += k
            for part in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
                if part[0] < part[1] and part[2] < part[3]:
                    todo.append(part)
                    rest += min(part[1] - part[0], part[3] - part[2])
    return total


def common(pairs: list[tuple[str, str, list[tuple[int, int]]]]) -> list[list[int]]:
    """Length of the longest common subsequence of each pair's first text and each of the given parts of its second.

    What SequenceMatcher matches is a common subsequence, so this bounds it. A row of bits for each pair and start of a part takes
    in a character at a time; all rows of as many words go together.
    """
    import numpy as np

    queries = {q: k for k, q in enumerate(dict.fromkeys(q for q, _, _ in pairs))}
    letters = {c: k for k, c in enumerate(sorted(set("".join(queries))), 1)}
    base, table = len(letters) + 1, np.zeros(0x110000, np.int32)
    table[[ord(c) for c in letters]] = list(letters.values())
    flat = table[np.frombuffer("".join(t for _, t, _ in pairs).encode("utf-32-le", "surrogatepass"), np.uint32)]
    lanes: dict[int, list[tuple]] = {}  # words -> (query, length of it, start in flat, {size: where the result goes})
    out, begun = [], 0
    for q, t, parts in pairs:
        own: dict[int, dict[int, list[int]]] = {}
        for k, (s, size) in enumerate(parts):
            own.setdefault(s, {}).setdefault(size, []).append(k)
        out.append([0] * len(parts))
        for s, sizes in own.items():
            lanes.setdefault(-(-len(q) // 63), []).append((queries[q], len(q), begun + s, sizes, out[-1]))
        begun += len(t)
    flat = np.concatenate([flat, np.zeros(1, flat.dtype)])
    full = (1 << 63) - 1
    for words, held in lanes.items():
        masks = np.zeros((words, len(queries) * base), np.uint64)
        for q, k in queries.items():
            if -(-len(q) // 63) == words:
                for w in range(words):
                    for i, c in enumerate(q[63 * w : 63 * w + 63]):
                        masks[w, k * base + letters[c]] |= np.uint64(1 << i)
        for k in range(0, len(held), 8192):
            some = sorted(held[k : k + 8192], key=lambda x: -max(x[3]))  # the longest first, so that those still going are in front
            row, first = np.array([x[0] * base for x in some]), np.array([x[2] for x in some])
            ends: dict[int, list[int]] = {}
            for r, x in enumerate(some):
                for size in x[3]:
                    ends.setdefault(size, []).append(r)
            lasts = np.array([-max(x[3]) for x in some])
            rows = [np.full(len(some), full, np.uint64) for _ in range(words)]
            valid = [np.array([(1 << max(0, min(63, x[1] - 63 * w))) - 1 for x in some], np.uint64) for w in range(words)]
            for step in range(1, max(ends, default=0) + 1):
                n = int(np.searchsorted(lasts, -step, side="right"))
                at = row[:n] + flat[first[:n] + (step - 1)]
                carry = None
                for w in range(words):
                    v, m = rows[w][:n], masks[w].take(at)
                    u = v & m
                    added = v + u
                    if carry is not None:
                        added += carry
                    if w + 1 < words:
                        carry = added >> np.uint64(63)
                    np.bitwise_and(v, ~m, out=v)
                    v |= added
                    v &= np.uint64(full)
                if step in ends:
                    r = np.array(ends[step])
                    left = sum(np.bitwise_count(rows[w][r] & valid[w][r]).astype(np.int64) for w in range(words))
                    for x, zeros in zip(ends[step], left.tolist(), strict=True):
                        for place in some[x][3][step]:
                            some[x][4][place] = some[x][1] - zeros
    return out


def best_windows(pairs: list[tuple[str, str]], least: float = 0.0) -> list[tuple[float, int, int]]:
    """(ratio, first, last character) of the part of each text most like its query; the last is inclusive.

    A text that holds the query has 0.91. Else it is the first of the best windows(), if its ratio is `least` or more; if none is,
    the ratio is 0. Only windows whose longest common subsequence allows a better ratio are compared.
    """
    out, open_ = [], []
    for k, (q, t) in enumerate(pairs):
        at = t.find(q)
        out.append((0.91, at, at + len(q) - 1) if at >= 0 else (0.0, 0, 0))
        if at < 0:
            open_.append((k, q, t, windows(len(q), len(t))))
    for (k, q, t, parts), lengths in zip(open_, common([x[1:] for x in open_]), strict=True):
        best = (0.0, 0, max(0, len(t) - 1) if len(t) <= len(q) else 0)
        for (s, size), most in zip(parts, lengths, strict=True):
            bound = 2.0 * most / (len(q) + size)
            if bound >= least and bound > best[0] and (r := 2.0 * matched(q, t[s : s + size], max(best[0], least)) / (len(q) + size)) > best[0] and r >= least:
                best = (r, s, max(0, s + size - 1))
        out[k] = best
    return out


def best_window(query: str, text: str) -> tuple[float, int, int]:
    """best_windows() of one pair."""
    return best_windows([(query, text)])[0]


def fuzzy(candidates: DataFrame, least: float = 0.58) -> DataFrame:
    """candidates (item_id, paragraph_id, query, plain) with ratio and score (0.58 to 0.90) where the ratio reaches `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                found = best_windows(list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)), least)
                keep = [i for i, f in enumerate(found) if f[0] >= least]
                at = pa.array(keep, pa.int64())
                pick = lambda k, kind: pa.array([found[i][k] for i in keep], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pick(0, pa.float64()), pa.array([min(0.9, max(least, found[i][0])) for i in keep], pa.float64()), pick(1, pa.int32()), pick(2, pa.int32())], ["item_id", "paragraph_id", "ratio", "score", "first", "last"])

    return candidates.select("item_id", "paragraph_id", "query", "plain").mapInArrow(run, "item_id long, paragraph_id string, ratio double, score double, first int, last int")
