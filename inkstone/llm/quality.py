"""Quality classifier: Bradley-Terry pairwise ranking.

A document's score is linear in its features: a few character and word statistics, and the presence of
words, and beginnings of words, that tell the better from the worse labelled documents of a language. The weights maximise the Bradley-Terry
likelihood that each better document beats each worse one of its language, that is, they minimise
the logistic loss of feature differences over all such pairs of all labelled documents. Pairs are never formed: what a document adds
depends on its score and on how the other class's scores are distributed. Documents whose score lies under a quantile of their language's better labelled
documents' scores are rejected; the scores that set the threshold are those of models that haven't seen the document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, fixed, lowered, mix, word_hashes, written

N_DENSE = 9
BINS, FINE = 8192, 128  # scores lie in bins of 1 / 128 from -32 to 32, split between the two nearest
BEGINNINGS = (4, 6)  # bytes of the beginnings of longer words that count as words too
_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 upper, 2 digit, 3 symbol, 4 line end, 5 sentence mark
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = 1 if _c.isupper() else 2 if _c.isdigit() else 4 if _c == "\n" else 5 if _c in ".,;:'" else 3 if _c > " " and not _c.isalnum() else 0


@dataclass(frozen=True)
class Ranker:
    """What scoring needs: sorted word hashes with their weights, weights of the statistics, and thresholds by language."""

    words: np.ndarray
    word_weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    dense_weights: np.ndarray
    threshold: float
    thresholds: dict[str, float]


def statistics(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after last, statistics of each text, hashes of its distinct words and beginnings of words, offsets of the texts into them)."""
    low = lowered(texts)
    for (lo, hi, raw, at), (_, _, folded, low_at) in zip(_aligned(texts, low), _aligned(low, low), strict=True):
        n = hi - lo
        kinds = _CLASS[raw]
        doc = np.repeat(np.arange(n), np.diff(at))
        share = np.bincount(doc * 6 + kinds, minlength=n * 6).reshape(n, 6)[:, 1:] / np.maximum(np.diff(at), 1)[:, None]
        h, starts, ends, splits = word_hashes(folded, low_at)
        count = np.diff(splits)
        w_doc = np.repeat(np.arange(n), count)
        length = np.bincount(w_doc, ends - starts, n) / np.maximum(count, 1)
        own, own_doc = _distinct(h, w_doc)
        distinct = np.bincount(own_doc, minlength=n) / np.maximum(count, 1)
        expected = np.minimum(1, 1.6 / np.maximum(count, 1) ** 0.12)
        x = np.column_stack([np.sqrt(share), length, distinct, distinct - expected, np.log1p(count)])
        for size in BEGINNINGS:
            longer = np.flatnonzero(ends - starts > size)
            key = np.zeros(len(longer), np.uint64)
            for i in range(size):
                key = key << np.uint64(8) | folded[starts[longer] + i].astype(np.uint64)
            begun, begun_doc = _distinct(mix(key + np.uint64(size)), w_doc[longer])
            own, own_doc = np.concatenate([own, begun]), np.concatenate([own_doc, begun_doc])
        by = np.argsort(own_doc, kind="stable")
        yield lo, hi, x, own[by], np.searchsorted(own_doc[by], np.arange(n + 1))


def _short(h: np.ndarray) -> np.ndarray:
    """The leading 32 bits of hashes, which is what features are told by."""
    return (h >> np.uint64(32)).astype(np.uint32)


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each document and their documents."""
    order = np.lexsort((h, doc)) if len(h) else np.zeros(0, np.int64)
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def _aligned(texts: pa.Array, like: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of texts with the row bounds that `like` has."""
    for lo, hi, _, _ in chunks(like):
        yield next((lo, hi, d, o) for _, _, d, o in chunks(texts.slice(lo, hi - lo), 1 << 62))


def fit(documents: DataFrame, labels: DataFrame, n_words: int = 1200, cost: float = 3.0, most_rejected: float = 0.03, l2: float = 1e-4, seed: int = 7, at_once: int = 1_000_000, local_bytes: int = 1 << 27) -> Ranker:
    """Learn a ranker from all labelled documents.

    Better documents have quality 1 and toxic 0; worse ones quality 0 or toxic 1; a null label decides nothing, and of
    several labels of one doc_id the worst counts. doc_id may be of any type. Of several texts of one doc_id the least is used.
    Every labelled document counts: in the frequencies of words, in the statistics' means, in the loss, where a language weighs as
    it has labelled documents, and in the thresholds. `n_words` words become features, shared evenly between the languages with both classes: those
    in at least four labelled documents of the language with the largest difference in document frequency between its classes.
    Statistics are clipped at 6 standard deviations.

    The threshold of a language is a quantile of its better documents' scores under models that were fitted to the other
    half of the documents, in turn by a hash of doc_id within language and class: the one with the least sum of the share of worse documents kept and `cost` times that of better ones
    rejected, where the latter is `most_rejected` at most. Languages with under 30 documents of either class have that of all
    together. If either class is missing, every document scores 0 and is kept.

    Texts stay where they are, save those of repeated doc_ids; labels are broadcast `at_once` at a time, with a pass over the
    documents each. Features of at most `local_bytes` are gathered for the descent, larger ones are passed over where they lie. Neither changes the result. The
    driver gets 17 bytes of scores for each labelled document.
    """
    good = F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).when((F.col("quality") == 0) | (F.col("toxic") == 1), 0)
    marked = labels.select(F.col("doc_id").alias("label_id"), good.alias("good")).where("label_id IS NOT NULL AND good IS NOT NULL").groupBy("label_id").agg(F.min("good").alias("good"))
    lang = F.coalesce(F.col("`lang`"), F.lit("")) if "lang" in documents.columns else F.lit("")
    rows = documents.select(*fixed("doc_id", "text"), lang.alias("lang"))
    langs = rows.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.count("*").alias("rows"))
    turn = F.row_number().over(Window.partitionBy("lang", "good").orderBy(F.xxhash64("label_id", F.lit(seed)), "label_id"))
    known = written(marked.join(langs, F.col("label_id") == F.col("doc_id")).select("label_id", "good", F.col("lang").alias("of"), "rows", (turn % 2).alias("fold")))
    slices = max(1, -(-known.count() // at_once))
    of_slice = lambda df, c, i: df.where(F.pmod(F.xxhash64(c, F.lit(1)), F.lit(slices)) == i) if slices > 1 else df
    table = None
    for i in range(slices):
        mine = of_slice(rows, "doc_id", i).join(F.broadcast(of_slice(known, "label_id", i)), (F.col("doc_id") == F.col("label_id")) & (F.col("lang") == F.col("of")))
        once = mine.where("rows = 1").select("lang", "good", "fold", "text")
        for part in (once, mine.where("rows > 1").groupBy("doc_id", "lang", "good", "fold").agg(F.min("text").alias("text")).drop("doc_id")):
            part = part.mapInArrow(_featured, "lang string, good int, fold int, x array<double>, words array<int>")
            table = part if table is None else table.unionByName(part)
    return _fitted(written(table), n_words, cost, most_rejected, l2, local_bytes)


def _fitted(rows: DataFrame, n_words: int, cost: float, most_rejected: float, l2: float, local_bytes: int) -> Ranker:
    x = [F.col("x")[i] for i in range(N_DENSE)]
    totals = {(r["lang"], r["good"]): r["n"] for r in rows.groupBy("lang", "good").agg(F.count("*").alias("n")).collect()}
    if len({good for _, good in totals}) < 2:
        none = np.zeros(0)
        return Ranker(np.zeros(0, np.uint32), none, np.zeros(N_DENSE), np.ones(N_DENSE), np.zeros(N_DENSE), -np.inf, {})
    moments = rows.agg(*(F.avg(c) for c in x), *(F.stddev_pop(c) for c in x)).first()
    mean, scale = np.array(moments[:N_DENSE], float), np.array(moments[N_DENSE:], float) + 1e-9
    both = sorted({name for name, _ in totals if (name, 0) in totals and (name, 1) in totals})
    if not both:
        both, rows, totals = [""], rows.withColumn("lang", F.lit("")), {("", g): sum(n for (_, h), n in totals.items() if h == g) for g in (0, 1)}
    words = _telling(rows, {name: (totals[name, 0], totals[name, 1]) for name in both}, max(1, n_words // len(both)))
    code = {name: i for i, name in enumerate(both)}
    packed = written(rows.mapInArrow(lambda batches: _packed(batches, words, mean, scale, code), _PACKED))
    over = _passes(packed, local_bytes)
    width = len(words) + N_DENSE
    weights = _descended(lambda w, linear: _gradient(over, w, len(both), linear), width, l2)
    codes, y, fold, s = over(lambda block: np.stack([_scores(block, weights[:, m]) for m in range(3)], 1), True)
    centre, spread = s.mean(0), s.std(0) + 1e-9
    unseen = np.where(fold == 0, (s[:, 0] - centre[0]) / spread[0], (s[:, 1] - centre[1]) / spread[1])
    back = lambda z: float(z * spread[2] + centre[2])
    everywhere = _threshold(unseen, y, cost, most_rejected)
    limits = {name: back(_threshold(unseen[codes == i], y[codes == i], cost, most_rejected)) for name, i in code.items() if min(totals[name, 0], totals[name, 1]) >= 30}
    final = weights[:, 2]
    return Ranker(words, final[: len(words)].copy(), mean, scale, final[len(words) :].copy(), back(everywhere), limits)


def _telling(rows: DataFrame, totals: dict[str, tuple[int, int]], n: int) -> np.ndarray:
    """Of each language the n words with the largest difference in document frequency between its classes, in all of its documents."""
    counts = rows.sparkSession.createDataFrame([(name, *map(float, t)) for name, t in totals.items()], "of string, worse double, better double")
    have = rows.select("lang", "good", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.sum("good").alias("b"), F.sum(1 - F.col("good")).alias("w")).where("b + w >= 4")
    rate = have.join(F.broadcast(counts), F.col("lang") == F.col("of")).select("lang", "word", ((F.col("b") + 0.5) / (F.col("better") + 1)).alias("b"), ((F.col("w") + 0.5) / (F.col("worse") + 1)).alias("w"))
    gain = rate.select("lang", "word", (F.abs(F.col("b") - F.col("w")) / F.sqrt((F.col("b") + F.col("w")) / 2)).alias("gain")).where("gain > 0")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("gain"), F.col("word").bitwiseAND(F.lit(0xFFFFFFFF))))
    top = gain.withColumn("place", place).where(F.col("place") <= n).select("word").distinct().toArrow()["word"].to_numpy()
    return np.unique(top.astype(np.int32).view(np.uint32))


_PACKED = "n int, codes binary, good binary, fold binary, dense binary, at binary, places binary"
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _packed(batches: Iterator[pa.RecordBatch], words: np.ndarray, mean: np.ndarray, scale: np.ndarray, code: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """A row for each batch and fold: language codes (-1: a class is missing), classes, folds, statistics, and the rows and places of words that are features."""
    for whole in batches:
        for which in (0, 1):
            batch = whole.filter(pc.equal(whole.column(2), which))
            if not (n := len(batch)):
                continue
            lists = batch.column(4)
            h = lists.flatten().to_numpy().view(np.uint32)
            where = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
            used = np.flatnonzero(words[where] == h) if len(words) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(n, dtype=np.int32), lists.value_lengths().to_numpy())[used]
            x = batch.column(3).flatten().to_numpy().reshape(n, N_DENSE)
            dense = np.clip((x - mean) / scale, -6, 6).astype(np.float32)
            parts = (np.array([code.get(v, -1) for v in batch.column(0).to_pylist()], np.int32), batch.column(1).to_numpy().astype(np.uint8), np.full(n, which, np.uint8), dense, row, where[used].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in parts)], ["n", "codes", "good", "fold", "dense", "at", "places"])


def _blocks(batch: pa.RecordBatch | pa.Table) -> Iterator[Block]:
    kinds = (np.int32, np.uint8, np.uint8, np.float32, np.int32, np.int32)
    for r in range(batch.num_rows):
        codes, good, fold, dense, row, places = (np.frombuffer(batch.column(1 + i)[r].as_buffer(), k) for i, k in enumerate(kinds))
        yield codes, good, fold, dense.reshape(-1, N_DENSE), row, places


def _merged(blocks: list[Block]) -> list[Block]:
    """Small blocks of a fold as larger ones."""
    out: list[list[Block]] = []
    for b in sorted(blocks, key=lambda b: b[2][0]):
        if not out or out[-1][0][2][0] != b[2][0] or sum(len(x[0]) for x in out[-1]) > 8192:
            out.append([])
        out[-1].append(b)
    first = lambda own: np.cumsum([0, *(len(x[0]) for x in own)])
    return [tuple(np.concatenate([x[i] + np.int32(at) if i == 4 else x[i] for x, at in zip(own, first(own), strict=False)]) for i in range(6)) for own in out]


def _passes(packed: DataFrame, local_bytes: int) -> Callable:
    """A function over(f, rows) that adds up what f gives for each block, (keys, values), as two arrays; rows: that joins the blocks' rows of (codes, class, fold, scores)."""
    size = packed.agg(F.sum(sum(F.length(c) for c in ("codes", "good", "fold", "dense", "at", "places")))).first()[0] or 0
    held = _merged(list(_blocks(packed.toArrow()))) if size <= local_bytes else None

    def over(f: Callable, rows: bool = False) -> tuple[np.ndarray, ...]:
        if rows:

            def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for b in _blocks(batch):
                        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (*b[:3], f(b))], ["codes", "good", "fold", "s"])

            if held is not None:
                got = [(*b[:3], f(b)) for b in held]
            else:
                t = packed.mapInArrow(joined, "codes binary, good binary, fold binary, s binary").toArrow()
                got = [[np.frombuffer(t.column(i)[r].as_buffer(), k) for i, k in enumerate((np.int32, np.uint8, np.uint8, np.float64))] for r in range(t.num_rows)]
            codes, good, fold, s = (np.concatenate([np.ravel(g[i]) for g in got]) for i in range(4))
            return codes, good.astype(bool), fold, s.reshape(-1, 3)
        if held is not None:
            given = [f(b) for b in held]
        else:

            def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for b in _blocks(batch):
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in f(b)], ["key", "value"])

            t = packed.mapInArrow(summed, "key long, value double").groupBy("key").agg(F.sum("value").alias("value")).toArrow()
            given = [(t["key"].to_numpy(), t["value"].to_numpy())]
        return np.concatenate([k for k, _ in given]), np.concatenate([v for _, v in given])

    return over


def _scores(block: Block, weights: np.ndarray) -> np.ndarray:
    """A document's scores under one model's weights."""
    n_words = len(weights) - N_DENSE
    return block[3].astype(np.float64) @ weights[n_words:] + (np.bincount(block[4], weights[:n_words][block[5]], len(block[3])) if n_words else 0)


def _bins(block: Block, weights: np.ndarray, m: int, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that model m learns from, the lower bins of their scores among all languages and classes, the shares of the upper ones). Models 0 and 1 leave out their fold."""
    codes, good, fold, *_ = block
    own = np.flatnonzero((codes >= 0) & (fold != m))
    if not len(own):
        return own, own, np.zeros(0)
    at = np.clip((_scores(block, weights[:, m])[own] + BINS / FINE / 2) * FINE, 0, BINS - 1.001)
    low = at.astype(np.int64)
    return own, ((m * n_codes + codes[own]) * 2 + good[own]) * BINS + low, at - low


def _gradient(over: Callable, weights: np.ndarray, n_codes: int, linear: bool = False) -> np.ndarray:
    """Of each model, the gradient of the mean of log(1 + exp(worse - better)) over all pairs of each language, weighed by its documents; linear: of half the mean of (better - worse)^2."""
    known: dict[int, list] = {}  # blocks that are held are scored once

    def counted(block: Block) -> tuple[np.ndarray, np.ndarray]:
        by = known[id(block)] = [_bins(block, weights, m, n_codes) for m in range(3)]
        low, up = np.concatenate([b[1] for b in by]), np.concatenate([b[2] for b in by])
        size = 3 * n_codes * 2 * BINS
        value = np.bincount(low, 1 - up, size) + np.bincount(low + 1, up, size)
        key = np.flatnonzero(value)
        return key, value[key]

    key, value = over(counted)
    have = np.bincount(key, value, 3 * n_codes * 2 * BINS).reshape(3, n_codes, 2, BINS)
    number = have.sum(3)
    usable = (number > 0).all(2)
    place = np.arange(BINS) / FINE - BINS / FINE / 2
    win = np.fft.rfft(np.roll(1 / (1 + np.exp(-np.arange(-BINS, BINS) / FINE)), BINS))  # sigmoid at 0, 1 .. BINS - 1, -BINS .. -1
    slope = np.zeros(have.shape)
    for m, c in np.argwhere(usable):
        share = number[m, c].sum() / number[m][usable[m]].sum() / number[m, c].prod()
        worse, better = have[m, c]
        if linear:
            slope[m, c] = share * (number[m, c, 1] * place - better @ place), share * (number[m, c, 0] * place - worse @ place)
        else:
            slope[m, c, 0] = share * np.fft.irfft(np.fft.rfft(better, 2 * BINS) * win, 2 * BINS)[:BINS]
            slope[m, c, 1] = -share * np.fft.irfft(np.fft.rfft(worse[::-1], 2 * BINS) * win, 2 * BINS)[:BINS][::-1]
    flat, width = slope.ravel(), len(weights)
    local = dict(known)

    def gathered(block: Block) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((3, width))
        by = local.get(id(block)) or [_bins(block, weights, m, n_codes) for m in range(3)]
        for m, (own, low, up) in enumerate(by):
            if not len(own):
                continue
            pull = np.zeros(len(block[0]))
            pull[own] = flat[low] * (1 - up) + flat[low + 1] * up
            out[m, : width - N_DENSE] = np.bincount(block[5], pull[block[4]], width - N_DENSE)
            out[m, width - N_DENSE :] = pull @ block[3]
        return np.arange(3 * width), out.ravel()

    key, value = over(gathered)
    return np.bincount(key, value, 3 * width).reshape(3, width).T


def _descended(gradient: Callable, width: int, l2: float, steps: int = 300) -> np.ndarray:
    """(width, 3) weights of the three models, by the accelerated gradient steps of bradley_terry()."""
    v = np.tile(np.random.default_rng(0).standard_normal(width)[:, None], 3) / np.sqrt(width)
    size = np.zeros(3)
    for _ in range(12):  # largest eigenvalue, for the step size
        v = gradient(v, True)
        size = np.linalg.norm(v, axis=0)
        v /= size + 1e-12
    step = 1 / (0.25 * size * 1.1 + l2 + 1e-9)
    w = ahead = np.zeros((width, 3))
    t = 1.0
    for _ in range(steps):
        new = ahead - step * (gradient(ahead, False) + l2 * ahead)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


def _threshold(scores: np.ndarray, y: np.ndarray, cost: float, most_rejected: float) -> float:
    better, worse = np.sort(scores[y]), np.sort(scores[~y])
    n = max(1, int(most_rejected * len(better)) + 1)
    lost = np.arange(n) / len(better)
    kept = 1 - np.searchsorted(worse, better[:n]) / max(len(worse), 1)
    return float(better[np.argmin(cost * lost + kept)])


def bradley_terry(features: np.ndarray, better: np.ndarray, worse: np.ndarray, l2: float, steps: int = 300) -> np.ndarray:
    """What fit() is held against, with pairs given: weights that minimise mean log(1 + exp(-d @ w)) + l2 / 2 |w|^2 over d = features[better] - features[worse], by accelerated gradient steps.

    Differences are never formed: scores are subtracted, and the gradient is gathered by row.
    """
    n, rows = max(len(better), 1), len(features)
    gather = lambda c: (np.bincount(better, c, rows) - np.bincount(worse, c, rows)).astype(np.float32)
    v = np.random.default_rng(0).standard_normal(features.shape[1]).astype(np.float32)
    size = 0.0
    for _ in range(12):  # largest eigenvalue, for the step size
        s = features @ v
        v = features.T @ gather(s[better] - s[worse]) / n
        size = float(np.linalg.norm(v))
        v /= size + 1e-12
    step = 1 / (0.25 * size * 1.1 + l2 + 1e-9)
    w = ahead = np.zeros(features.shape[1], np.float32)
    t = 1.0
    for _ in range(steps):
        s = features @ ahead
        lose = 1 / (1 + np.exp(np.clip(s[better] - s[worse], -30, 30)))
        new = ahead - np.float32(step) * (-(features.T @ gather(lose)) / n + np.float32(l2) * ahead)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + np.float32((t - 1) / t_new) * (new - w)
        w, t = new, t_new
    return w


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, x, h, at in statistics(batch.column(3)):
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(3)), pa.ListArray.from_arrays(np.arange(hi - lo + 1, dtype=np.int32) * N_DENSE, x.ravel()), pa.ListArray.from_arrays(at.astype(np.int32), _short(h).view(np.int32))], ["lang", "good", "fold", "x", "words"])


def score(documents: DataFrame, ranker: Ranker) -> DataFrame:
    """documents with __score and __keep; other columns, and their names, stay as they are.

    One pass without a shuffle. A null or empty text has no words and its statistics are 0; it gets a score
    like any other. Repeated rows and repeated doc_ids are scored apiece; a null doc_id stays null. A score equal to the
    threshold is kept. A table without lang, or a null or unknown lang, has the threshold of all languages together.
    """
    names = documents.columns
    lang = F.coalesce(F.col("`lang`"), F.lit("")) if "lang" in names else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limit = np.array([ranker.thresholds.get(x, ranker.threshold) for x in batch.column(1).to_pylist()])
            for lo, hi, x, h, at in statistics(batch.column(0)):
                s = np.clip((x - ranker.mean) / ranker.scale, -6, 6).astype(np.float32).astype(np.float64) @ ranker.dense_weights
                if len(ranker.words):
                    h = _short(h)
                    where = np.minimum(np.searchsorted(ranker.words, h), len(ranker.words) - 1)
                    add = np.where(ranker.words[where] == h, ranker.word_weights[where], 0)
                    s += np.bincount(np.repeat(np.arange(hi - lo), np.diff(at)), add, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(np.round(s, 5)), pa.array(s >= limit[lo:hi]), *(batch.column(2 + i).slice(lo, hi - lo) for i in range(len(names)))], ["__score", "__keep", *(f"_{i}" for i in range(len(names)))])

    carried = documents.select(F.col("`text`").alias("__text"), lang.alias("__lang"), *(c.alias(f"_{i}") for i, c in enumerate(fixed(*names))))
    kinds = dict(carried.dtypes)
    out = carried.mapInArrow(run, ", ".join(["__score double", "__keep boolean", *(f"_{i} {kinds[f'_{i}']}" for i in range(len(names)))]))
    return out.select(*(F.col(f"_{i}").alias(n) for i, n in enumerate(names)), "__score", "__keep")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, keep) of every row of documents, by a ranker fitted to the labels with production parameters.

    Nulls, ties and repeated rows: see fit() and score(). An empty table gives no rows. Further columns are ignored.
    """
    some = [c for c in ("doc_id", "text", "lang") if c in documents.columns]
    return score(documents.select(*fixed(*some)), fit(documents, labels)).select("doc_id", F.col("__score").alias("score"), F.col("__keep").alias("keep"))


def filtered(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that classify() keeps, with all their columns; texts aren't moved."""
    return score(documents, fit(documents, labels)).where("__keep").drop("__score", "__keep")
