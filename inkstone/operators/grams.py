"""Character grams of paragraphs, counted and scored where the paragraphs are: what leaves a task is bounded by the quotes or the alphabet."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 22  # of a block's matrix of grams x quotes, and of grams x the paragraphs that are held against it at once
BLOCKS = 8  # of quotes in one pass over the paragraphs
TABLE = 1 << 22  # codes that are looked up directly
ROWS = 256  # paragraphs whose grams are counted at once; their numbers stay in the processor's cache
SEEN = 1 << 20  # codes x texts in which repeated grams are found at once


def asked_grams(quotes: DataFrame, n: int = 3) -> dict:
    """item_id -> distinct grams of its quotes' plain forms, all of them."""
    out: dict = {}
    for item, plain in quotes.where(f"length(plain) >= {n}").select("item_id", "plain").collect():
        out.setdefault(item, set()).update(plain[i : i + n] for i in range(len(plain) - n + 1))
    return out


def blocks(asked: dict) -> Iterator[list[list]]:
    """Passes of at most BLOCKS blocks, each a list of items whose grams x items make at most CELLS (one item at least)."""
    own: list = []
    grams: set = set()
    one: list[list] = []
    for item, has in asked.items():
        if own and len(grams | has) * (len(own) + 1) > CELLS:
            one.append(own)
            own, grams = [], set()
            if len(one) == BLOCKS:
                yield one
                one = []
        own.append(item)
        grams |= has
    if own:
        one.append(own)
    if one:
        yield one


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts on end, and the text of each."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, texts), np.int64, len(texts)))


class Block:
    """Trigrams of some items, and which of them a text has."""

    def __init__(self, asked: dict, items: list):
        self.items = items
        self.grams = sorted(set().union(*(asked[i] for i in items)))
        self.place = {g: k for k, g in enumerate(self.grams)}
        alphabet = sorted(set("".join(self.grams)))
        self.base = len(alphabet) + 1
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in alphabet]] = np.arange(1, self.base)
        letters = self.letter[points(self.grams)[0]].reshape(-1, 3).astype(np.int64)
        self.codes = (letters[:, 0] * self.base + letters[:, 1]) * self.base + letters[:, 2]
        self.table = None
        if self.base**3 <= TABLE:
            self.table = np.full(self.base**3, -1, np.int32)
            self.table[self.codes] = np.arange(len(self.codes))
        else:
            self.order = np.argsort(self.codes)
            self.sorted = self.codes[self.order]

    def matrix(self, asked: dict, kind: type) -> np.ndarray:
        """1 where an item (column) has a gram (row)."""
        out = np.zeros((len(self.grams), len(self.items)), kind)
        for k, item in enumerate(self.items):
            out[[self.place[g] for g in asked[item]], k] = 1
        return out

    def _one(self, texts: list[str], kind: type) -> np.ndarray:
        out = np.zeros((len(texts), len(self.grams)), kind)
        flat, row = points(texts)
        if len(flat) < 3:
            return out
        x = self.letter[flat] if self.table is not None else self.letter[flat].astype(np.int64)
        code = x[:-2] * x.dtype.type(self.base)
        code += x[1:-1]
        code *= x.dtype.type(self.base)
        code += x[2:]
        if self.table is not None:
            gram = self.table[code]
        else:
            at = np.minimum(np.searchsorted(self.sorted, code), len(self.sorted) - 1)
            gram = np.where(self.sorted[at] == code, self.order[at], -1)
        ok = (gram >= 0) & (row[:-2] == row[2:])
        out[row[:-2][ok], gram[ok]] = 1
        return out

    def has(self, texts: list[str], kind: type) -> np.ndarray:
        """How many parts of each text (row) have a gram (column); a text's parts are told apart by line feeds, which no gram holds."""
        out, step = self._one(texts, kind), self.step
        for i, t in enumerate(texts):
            if "\n" in t:
                parts = t.split("\n")
                out[i] = sum(self._one(parts[k : k + step], kind).sum(axis=0) for k in range(0, len(parts), step))
        return out

    @property
    def step(self) -> int:
        return max(16, min(ROWS, CELLS // 2 // len(self.grams)))


class Best:
    """The best `most` entries of each item so far, by score and then by name."""

    def __init__(self, n: int, most: int):
        self.most, self.floor, self.held, self.n = most, np.full(n, -np.inf), [], 0

    def add(self, names: np.ndarray, score: np.ndarray, value: np.ndarray, more: np.ndarray) -> None:
        row, item = np.nonzero((score >= self.floor) & (value > 0))
        self.held.append((item, score[row, item], names[row], value[row, item], more[row]))
        self.n += len(row)
        if self.n > 2 * self.most * len(self.floor) + 10_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        item, score, name, value, more = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.empty(0, np.int64), np.empty(0), np.empty(0, "S1"), np.empty(0), np.empty(0, np.int64))
        order = np.lexsort((name, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.most]
        self.floor[item[place == self.most - 1]] = score[order][place[place < self.most] == self.most - 1]
        self.held = [tuple(x[order] for x in (np.concatenate(y) for y in zip(*self.held, strict=True)))] if self.held else []
        self.n = len(order)
        return self.held[0] if self.held else (item, score, name, value, more)


def _kept(batch: pa.RecordBatch) -> tuple[list, list[str]]:
    """Names and texts of the paragraphs that are searched and have a trigram."""
    names, texts, least = (batch.column(i).to_pylist() for i in range(3))
    own = [i for i, t in enumerate(texts) if t is not None and len(t) >= max(3, least[i])]
    return [names[i] for i in own], [texts[i] for i in own]


def _chunks(batches: Iterator[pa.RecordBatch], held: list[Block]) -> Iterator[tuple[int, list, list[str]]]:
    for batch in batches:
        names, texts = _kept(batch)
        for b, block in enumerate(held):
            for k in range(0, len(texts), block.step):
                yield b, names[k : k + block.step], texts[k : k + block.step]


def _each(paragraphs: DataFrame, asked: dict, task, schema: str) -> DataFrame:
    """Union of task(blocks, batches) over all passes; each pass gets its own items' grams only."""
    out = None
    for one in blocks(asked):
        own = {i: asked[i] for items in one for i in items}

        def run(batches, own=own, one=one):
            return task(own, [Block(own, items) for items in one], batches)

        found = paragraphs.select("paragraph_id", "plain", "least").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else paragraphs.sparkSession.createDataFrame([], schema)


def holders(paragraphs: DataFrame, asked: dict) -> DataFrame:
    """(item_id, paragraph_id) where the parts of a paragraph have as many of an item's grams as it has."""

    def task(own, held, batches):
        matrices = [b.matrix(own, np.float32) for b in held]
        for b, names, texts in _chunks(batches, held):
            has = held[b].has(texts, np.float32)
            sizes = matrices[b].sum(axis=0)
            row = np.flatnonzero(has.sum(axis=1) >= sizes.min())
            r, q = np.nonzero(has[row] @ matrices[b] == sizes)
            yield pa.RecordBatch.from_arrays([pa.array([held[b].items[i] for i in q], pa.int64()), pa.array([names[i] for i in row[r]], pa.string())], ["item_id", "paragraph_id"])

    return _each(paragraphs, {i: g for i, g in asked.items() if i is not None}, task, "item_id long, paragraph_id string")


def _rows(block: Block, best: Best) -> pa.RecordBatch:
    item, _, name, value, more = best.cut()
    return pa.RecordBatch.from_arrays([pa.array([block.items[i] for i in item], pa.int64()), pa.array([x.decode() for x in name.tolist()], pa.string()), pa.array(value, pa.float64()), pa.array(more, pa.int64())], ["item_id", "paragraph_id", "value", "len"])


def most_grams(paragraphs: DataFrame, asked: dict, most: int) -> DataFrame:
    """(item_id, paragraph_id, value: n_grams, len: 0): the `most` of each item and task with the most of its grams, ties by paragraph_id."""

    def task(own, held, batches):
        matrices, bests = [b.matrix(own, np.float32) for b in held], [Best(len(b.items), most) for b in held]
        for b, names, texts in _chunks(batches, held):
            has, best = held[b].has(texts, np.float32), bests[b]
            row = np.flatnonzero(has.sum(axis=1) >= best.floor.min())
            if len(row):
                n = has[row] @ matrices[b]
                best.add(np.array([names[i].encode() for i in row], "S"), n, n, np.zeros(len(row), np.int64))
        yield from map(_rows, held, bests)

    return _each(paragraphs, asked, task, "item_id long, paragraph_id string, value double, len long")


def frequencies(paragraphs: DataFrame, asked: dict) -> tuple[dict[str, int], int, int]:
    """In how many paragraphs each asked gram is, how many paragraphs there are, and their length."""

    def task(own, held, batches):
        n = length = 0
        counts = [np.zeros(len(b.grams), np.int64) for b in held]
        for b, _, texts in _chunks(batches, held):
            counts[b] += held[b].has(texts, np.float32).sum(axis=0, dtype=np.float64).astype(np.int64)
            if b == 0:
                breaks = sum(t.count("\n") for t in texts)
                n, length = n + len(texts) + breaks, length + sum(map(len, texts)) - breaks
        names, numbers = [None, ""], [n, length]
        for block, count in zip(held, counts, strict=True):
            names += block.grams
            numbers += count.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64())], ["gram", "n"])

    df: dict = {}
    for one in blocks(asked):  # a gram that several blocks or passes ask for is counted by each, in the same way
        part = {i: asked[i] for items in one for i in items}
        counted = dict(_each(paragraphs, part, task, "gram string, n long").groupBy("gram").agg(F.sum("n")).collect())
        times: dict = {}
        for items in one:
            for g in set().union(*(asked[i] for i in items)):
                times[g] = times.get(g, 0) + 1
        df |= {g: n // times.get(g, 1) for g, n in counted.items()}
    n, length = df.pop(None, 0), df.pop("", 0)
    return df, n, length


def best_bm25(paragraphs: DataFrame, asked: dict, most: int, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, float]:
    """(item_id, paragraph_id, value: sum of idf, len): the `most` of each item and task with the best score to four digits, ties by
    paragraph_id; and the mean length of all paragraphs."""
    df, n, length = frequencies(paragraphs, asked)
    mean = length / n if n else 1.0
    idf = {g: math.log((n - f + 0.5) / (f + 0.5) + 1) for g, f in df.items()}

    def task(own, held, batches):
        weights, bests = [], [Best(len(x.items), most) for x in held]
        for x in held:
            each = np.array([idf[g] for g in x.grams])
            weights.append((x.matrix(own, np.float64) * each[:, None], each))
        for k, names, texts in _chunks(batches, held):
            has, best = held[k].has(texts, np.float64), bests[k]
            rows, lens = [], []
            for i, t in enumerate(texts):
                for part in t.split("\n") if "\n" in t else (t,):
                    rows.append(i)
                    lens.append(len(part))
            rows, lens = np.array(rows, np.int64), np.array(lens, np.int64)
            factor = (k1 + 1) / (1 + k1 * (1 - b + b * lens / mean))
            able = np.flatnonzero((has @ weights[k][1])[rows] * factor + 1e-3 >= best.floor.min())
            if len(able):
                used, back = np.unique(rows[able], return_inverse=True)
                total = (has[used] @ weights[k][0])[back]
                score = np.floor(np.round(total, 6) * factor[able, None] * 1e4 + 0.5) / 1e4
                best.add(np.array([names[i].encode() for i in rows[able]], "S"), score, total, lens[able])
        yield from map(_rows, held, bests)

    return _each(paragraphs, asked, task, "item_id long, paragraph_id string, value double, len long"), mean


class Grams:
    """Numbers of the grams of n characters in texts, or with `each` of the texts that have them.

    Letters are numbered as they occur. While base**n is small, counts are kept by number; beyond that, by name.
    """

    def __init__(self, n: int, each: bool):
        self.n, self.each, self.base = n, each, 64
        self.letters, self.number = np.empty(0, np.uint32), np.full(0x110000, -1, np.int32)
        self.named: Counter = Counter()
        self._fit()

    def _fit(self) -> None:
        small = self.base**self.n <= TABLE
        self.counts = np.zeros(self.base**self.n, np.int64) if small else None
        self.some = max(1, SEEN // self.base**self.n)  # texts at a time
        self.last = np.empty(self.some * self.base**self.n, np.int32) if small and self.each else None

    def add(self, texts: list[str]) -> None:
        flat, row = points(texts)
        if len(flat) < self.n:
            return
        if self.counts is not None:
            letter = self.number[flat]
            if letter.min() < 0:
                new = np.unique(flat[letter < 0])
                if len(self.letters) + len(new) > self.base:
                    self._names()
                    while len(self.letters) + len(new) > self.base:
                        self.base *= 2
                    self._fit()
                self.number[new] = np.arange(len(self.letters), len(self.letters) + len(new))
                self.letters = np.append(self.letters, new)
                letter = self.number[flat]
        if self.counts is None:
            for t in texts:
                own = [t[i : i + self.n] for i in range(len(t) - self.n + 1)]
                self.named.update(set(own) if self.each else own)
            return
        stop = len(flat) - self.n + 1
        code = letter[:stop].copy()
        for k in range(1, self.n):
            code *= np.int32(self.base)
            code += letter[k : stop + k]
        inside = row[:stop] == row[self.n - 1 :]
        code = code[inside]
        if self.each:
            code = self._once(code, row[:stop][inside], len(texts))
        self.counts += np.bincount(code, minlength=len(self.counts))

    def _once(self, code: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Each text's grams once: those that wrote their own place in a table last."""
        starts, each, out = np.arange(0, n, self.some), np.arange(len(row), dtype=np.int32), []
        cuts = np.append(np.searchsorted(row, starts), len(row)).tolist()
        for start, lo, hi in zip(starts.tolist(), cuts[:-1], cuts[1:], strict=True):
            key = row[lo:hi] - np.int32(start)
            key *= np.int32(self.base**self.n)
            key += code[lo:hi]
            self.last[key] = each[lo:hi]
            out.append(code[lo:hi][self.last[key] == each[lo:hi]])
        return np.concatenate(out)

    def _names(self) -> None:
        """Counts by number become counts by name."""
        code = np.flatnonzero(self.counts)
        letters = np.empty((len(code), self.n), np.uint32)
        for k, count in ((k, self.base**k) for k in range(self.n)):
            letters[:, self.n - 1 - k] = self.letters[code // count % self.base]
        names = letters.tobytes().decode("utf-32-le", "surrogatepass")
        for k, count in enumerate(self.counts[code].tolist()):
            self.named[names[k * self.n : k * self.n + self.n]] += count
        self.counts[:] = 0

    def taken(self) -> pa.RecordBatch:
        """All counts so far, which are forgotten."""
        if self.counts is not None:
            self._names()
        out = pa.RecordBatch.from_arrays([pa.array(list(self.named), pa.string()), pa.array(list(self.named.values()), pa.int64())], ["gram", "n"])
        self.named.clear()
        return out


def gram_counts(paragraphs: DataFrame, n: int, each: bool, most: int = 1_000_000) -> DataFrame:
    """(gram, n): occurrences of each gram of n characters, or with `each` the paragraphs that have it.

    Without `each` a paragraph of fewer characters, which may be none, is a gram itself. A task adds up the grams of its
    paragraphs, and hands them on when it has `most`, so what is shuffled grows with the alphabet and not with the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(n, each)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                texts, least = (c.to_pylist() for c in batch.slice(k, ROWS).columns)
                texts = [t for t, x in zip(texts, least, strict=True) if t is not None and len(t) >= max(x, n if each else 0)]
                if not each:
                    grams.named.update(t for t in texts if len(t) < n)
                grams.add(texts)
                if len(grams.named) >= most:
                    yield grams.taken()
        yield grams.taken()

    return paragraphs.select("plain", "least").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
