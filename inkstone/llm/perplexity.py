"""Quality rules: perplexity under a modified Kneser-Ney n-gram model, with bands for each language.

Spark counts the character 4-grams of all documents of a language; lower orders, discounts, probabilities
and back-off weights follow from that table with joins and aggregates. The model is written to the shared folder, a
directory for each model, as arrays sorted by a 64-bit hash of the n-gram. Tasks read the models of the languages that they
meet and hold the last few, so nothing is collected or broadcast, and any number of languages and any size of the corpus
go one way. A document is rejected if its perplexity lies outside its language's band.

Models are cross-fitted: a hash of its text puts each document in one of two folds, and it is scored by its
language's model of the other fold, so no document and no exact copy of it is in the model that it is held against.

Symbols are code points, of 16 bits, so that four make one integer; those beyond the basic plane share its 6,400 private
ones by a hash. Each text is preceded by three start symbols and followed by one end symbol.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, fixed, mix, row_key, shared_folder, written

ORDER = 4
BITS = 16
HELD_BYTES = 256 << 20  # of models in a task at once; more are read again
START, END = 1, 2
NO_LANGUAGE = "und"
_SIGN = np.uint64(1 << 63)  # keeps the order of unsigned hashes in signed columns


def _symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, each with its start and end symbols; n + 1 offsets."""
    n = len(offsets) - 1
    lead = (data & 0xC0) != 0x80
    first = np.flatnonzero(lead)
    b = data[first].astype(np.uint32)
    at = lambda i: data[np.minimum(first + i, len(data) - 1)].astype(np.uint32) & 0x3F
    code = b.copy()
    for low, size, mask in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
        if (m := b >= low).any():
            c = b & mask
            for i in range(1, size):
                c = c << 6 | at(i)
            code = np.where(m, c, code)
    code = np.where(code < 3, 0, code)
    code = np.where(code < 65536, code, 0xE000 + ((code * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(6400)).astype(np.uint64)
    splits = np.searchsorted(first, offsets)
    count = np.diff(splits)
    to = np.concatenate([[0], np.cumsum(count + ORDER)])
    out = np.full(to[-1], START, np.uint64)
    out[to[1:] - 1] = END
    out[np.arange(len(code)) + np.repeat(np.arange(n) * ORDER + ORDER - 1, count)] = code
    return out, to


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams of each text, one for each of its symbols and its end; n + 1 offsets into them."""
    s, to = _symbols(data, offsets)
    key = s[: len(s) - ORDER + 1].copy()
    for i in range(1, ORDER):
        key <<= np.uint64(BITS)
        key |= s[i : len(s) - ORDER + 1 + i]
    real = np.ones(len(s), bool)
    for i in range(ORDER - 1):
        real[to[1:-1] - 1 - i] = False  # would run into the next text
    counts = np.diff(to) - ORDER + 1
    return key[real[: len(key)]], np.concatenate([[0], np.cumsum(counts)])


def _by_language(batch: pa.RecordBatch, column: int) -> Iterator[tuple[str, np.ndarray]]:
    """(language, its rows in the batch)."""
    names = batch.column(column).fill_null(NO_LANGUAGE).dictionary_encode()
    codes = names.indices.to_numpy()
    for i, name in enumerate(names.dictionary.to_pylist()):
        yield name, np.flatnonzero(codes == i)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[new], np.add.reduceat(n, new)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def flush(name: str) -> pa.RecordBatch:
        k, n = _merge(*held.pop(name))
        return pa.RecordBatch.from_arrays([pa.array([name] * len(k)).dictionary_encode().cast(pa.string()), pa.array(k.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    for batch in batches:
        for name, rows in _by_language(batch, 0):
            for _, _, data, offsets in chunks(batch.column(1).take(pa.array(rows))):
                key = np.sort(grams(data, offsets)[0])
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                own = held.setdefault(name, [[], []])
                own[0].append(key[new])
                own[1].append(np.diff(np.append(new, len(key))))
                if sum(map(len, own[0])) > 3_000_000:
                    held[name] = own = [[x] for x in _merge(*own)]
                    if len(own[0][0]) > 1_500_000:
                        yield flush(name)
    for name in list(held):
        yield flush(name)


def count(documents: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each 4-gram occurs in all documents of a language.

    Each task sums its own counts before the shuffle, so that what is shuffled is the distinct n-grams of a task.
    """
    pairs = documents.select(*fixed("lang", "text")).toDF("lang", "text")
    return pairs.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _suffix(k: int, gram: Column | str = "gram") -> Column:
    return (F.col(gram) if isinstance(gram, str) else gram).bitwiseAND(F.lit((1 << BITS * k) - 1 if BITS * k < 64 else -1))


def model(counts: DataFrame) -> DataFrame:
    """(lang, k, gram, logp, backoff): natural logarithms of modified Kneser-Ney probabilities.

    k is the order. Orders below the highest count the distinct symbols before an n-gram. backoff is the weight of
    the lower order after this n-gram as a context, null where none follows it. Contexts of start symbols only have a row
    with a backoff and no logp. A language's row with k = 0 holds in logp the probability of an unseen symbol. Each order's
    probabilities sum to 1 after every context. Discounts are those of Chen and Goodman, kept within 0.05 and 0.95 of the count
    that they are taken from, and half of it where they aren't defined.
    """
    tables = {ORDER: counts.select("lang", "gram", "n")}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy("lang", _suffix(k).alias("gram")).agg(F.count("*").alias("n"))
        tables[k] = written(tables[k]) if k > 1 else tables[k]
    of = lambda i: F.count_if(F.col("n") == i).cast("double")
    out: list[DataFrame] = []
    lower, unseen = None, None
    for k in range(1, ORDER + 1):
        d = tables[k].groupBy("lang").agg(*(of(i).alias(f"n{i}") for i in (1, 2, 3, 4)), (F.count("*") + 1).cast("double").alias("size"))
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
        cut = lambda i, own=y: F.when((F.col(f"n{i}") > 0), F.least(F.greatest(i - (i + 1) * own * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.05 * i)), F.lit(0.95 * i))).otherwise(F.lit(0.5 * i))
        d = d.select("lang", "size", cut(1).alias("d1"), cut(2).alias("d2"), cut(3).alias("d3"))
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = F.shiftrightunsigned("gram", BITS)
        cuts = tables[k].join(d, "lang").select("lang", "gram", "n", "size", context.alias("context"), discount.alias("cut"))
        after = Window.partitionBy("lang", "context")
        cuts = cuts.withColumns({"total": F.sum("n").over(after).cast("double"), "gamma": F.sum("cut").over(after) / F.sum("n").over(after)})
        if k == 1:
            cuts = cuts.withColumn("below", 1 / F.col("size"))
            unseen = cuts.groupBy("lang").agg(F.log(F.max("gamma") / F.max("size")).alias("logp")).select("lang", F.lit(0).alias("k"), F.lit(0).cast("long").alias("gram"), "logp", F.lit(None).cast("double").alias("backoff"))
        else:
            cuts = cuts.withColumn("suffix", _suffix(k - 1)).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
        p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("gamma") * F.col("below")
        own = written(cuts.select("lang", "gram", "context", p.alias("p"), F.log("gamma").alias("backoff")))
        if k > 1:
            weights = own.groupBy("lang", F.col("context").alias("gram")).agg(F.first("backoff").alias("backoff"))
            out.append(lower.select("lang", "gram", "p").join(weights, ["lang", "gram"], "full").select("lang", F.lit(k - 1).alias("k"), "gram", F.log("p").alias("logp"), "backoff"))
        lower = own
    out.append(lower.select("lang", F.lit(ORDER).alias("k"), "gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("backoff")))
    for x in out:
        unseen = unseen.unionByName(x)
    return unseen


def stored(table: DataFrame) -> str:
    """Write a model to the shared folder and return its path: for each language a directory of rows sorted by k and hash.

    The hash is a bijection of the n-gram, so no two n-grams share one. A language's rows pass through one task, which sorts and
    doesn't hold them; their number grows far more slowly than its texts.
    """
    spark = table.sparkSession
    path = f"{shared_folder(spark)}/{uuid4().hex}"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((mix(b.column(2).to_numpy().view(np.uint64)) ^ _SIGN).view(np.int64)), b.column(3), b.column(4)], ["model", "k", "hash", "logp", "backoff"])

    rows = table.select(F.hex(F.encode("lang", "utf-8")).alias("model"), "k", "gram", F.col("logp").cast("float").alias("logp"), F.col("backoff").cast("float").alias("backoff"))
    rows = rows.mapInArrow(hashed, "model string, k int, hash long, logp float, backoff float")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, "model").sortWithinPartitions("model", "k", "hash").write.partitionBy("model").parquet(path)
    return path


class Arrays:
    """One language's model: for each order, sorted hashes with log probabilities and back-off weights."""

    def __init__(self, k: np.ndarray, h: np.ndarray, logp: np.ndarray, backoff: np.ndarray) -> None:
        ends = np.searchsorted(k, np.arange(ORDER + 2))
        self.unseen = float(logp[0])
        self.orders = [(h[a:b], logp[a:b], np.nan_to_num(backoff[a:b])) for a, b in zip(ends[1:], ends[2:], strict=False)]
        self.size = len(h) * 16
        self.index()

    @classmethod
    def read(cls, path: str, name: str) -> Arrays | None:
        """The model of a language in the folder that stored() returned, or None."""
        files, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        found = files.get_file_info(pafs.FileSelector(f"{root}/model={name.encode().hex().upper()}", allow_not_found=True))
        found = sorted(f.path for f in found if f.path.endswith(".parquet"))
        if not found:
            return None
        rows = pa.concat_tables([pq.read_table(f, filesystem=files) for f in found]).combine_chunks()
        k, h, logp, backoff = (rows[c].to_numpy() for c in ("k", "hash", "logp", "backoff"))
        h = h.view(np.uint64) ^ _SIGN
        if (np.diff(k) < 0).any() or len(found) > 1:
            by = np.lexsort((h, k))
            k, h, logp, backoff = k[by], h[by], logp[by], backoff[by]
        return cls(k, h, logp, backoff)

    def index(self) -> None:
        """For each order, where the hashes with given leading bits start."""
        self.starts = []
        for h, _, _ in self.orders:
            bits = max(4, int(len(h)).bit_length() + 1)
            self.starts.append((np.uint64(64 - bits), np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)))

    def find(self, order: int, gram: np.ndarray) -> np.ndarray:
        """Row of each n-gram, -1 if it isn't there."""
        keys = self.orders[order - 1][0]
        if not len(keys):
            return np.full(len(gram), -1)
        shift, starts = self.starts[order - 1]
        h = mix(gram)
        at = starts[h >> shift]
        there = keys[np.minimum(at, len(keys) - 1)]
        left = np.flatnonzero((there < h) & (at < len(keys)))
        while len(left):
            at[left] += 1
            there[left] = keys[np.minimum(at[left], len(keys) - 1)]
            left = left[(there[left] < h[left]) & (at[left] < len(keys))]
        return np.where((there == h) & (at < len(keys)), at, -1)

    def logp(self, gram: np.ndarray) -> np.ndarray:
        out = np.zeros(len(gram))
        rest = np.arange(len(gram))
        for k in range(ORDER, 0, -1):
            g = gram[rest] & np.uint64((1 << BITS * k) - 1 & 0xFFFFFFFFFFFFFFFF)
            row = self.find(k, g)
            hit = row >= 0
            out[rest[hit]] += self.orders[k - 1][1][row[hit]]
            rest, g = rest[~hit], g[~hit]
            if not len(rest):
                return out
            if k > 1:
                row = self.find(k - 1, g >> np.uint64(BITS))
                out[rest] += np.where(row >= 0, self.orders[k - 2][2][row], 0)
        out[rest] += self.unseen
        return out


def log_losses(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, lang, n_grams, loss): mean negative log probability of each document's symbols, 5 decimals.

    path is what stored() returned. One pass without a shuffle. Where a language has no model, the loss is that of one symbol of 65536.
    """
    rows = documents.select(*fixed("doc_id", "lang", "text")).toDF("doc_id", "lang", "text")
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[str, Arrays | None] = OrderedDict()
        for batch in batches:
            loss, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for name, at in _by_language(batch, 1):
                if name not in held:
                    held[name] = Arrays.read(path, name)
                    while len(held) > 1 and sum(m.size for m in held.values() if m) > HELD_BYTES:
                        held.popitem(last=False)
                held.move_to_end(name)
                own = held[name]
                for lo, hi, data, offsets in chunks(batch.column(2).take(pa.array(at))):
                    key, to = grams(data, offsets)
                    n[at[lo:hi]] = np.diff(to)
                    loss[at[lo:hi]] = np.add.reduceat(-own.logp(key), to[:-1]) / np.diff(to) if own else np.log(1 << BITS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).fill_null(NO_LANGUAGE), pa.array(n), pa.array(np.round(loss, 5))], ["doc_id", "lang", "n_grams", "loss"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang string, n_grams long, loss double")


def held_out_losses(documents: DataFrame) -> DataFrame:
    """log_losses of each document by the model of its language's documents in the other fold.

    Where the other fold has none, every document of the language has the loss of a symbol out of all.
    """
    rows = documents.select(*fixed("doc_id", "lang", "text")).toDF("doc_id", "lang", "text")
    fold = F.xxhash64("text").bitwiseAND(F.lit(1))
    label = lambda f: F.concat(F.coalesce("lang", F.lit(NO_LANGUAGE)), F.lit("|"), f.cast("string"))
    path = stored(model(written(count(rows.withColumn("lang", label(fold))))))
    losses = log_losses(rows.withColumn("lang", label(1 - fold)), path)
    return losses.withColumn("lang", F.expr("left(lang, length(lang) - 2)"))


def bands(losses: DataFrame, width: float = 6.0, floor: float = 0.12, spread: float = 3.0) -> DataFrame:
    """(lang, low, high, slack): each language's band of mean log losses, from all its documents.

    The middle is the median over its symbols (each document counts by its length), and each half-width is `width` times the
    distance between the median and the quartile on that side, `floor` at least. slack is `spread` standard deviations of
    one symbol's loss, as estimated from the median of |loss - middle| * sqrt(n_grams). Losses are rounded to 0.001 nats
    and summed before they are sorted, so a language costs as many rows as it has such values.
    """
    steps = losses.groupBy("lang", F.round("loss", 3).alias("x")).agg(F.sum("n_grams").alias("w"))
    found = _quantiles(steps, (0.25, 0.5, 0.75))
    off = losses.join(found, "lang").groupBy("lang", F.round(F.abs(F.col("loss") - F.col("q1")) * F.sqrt("n_grams"), 2).alias("x")).agg(F.count("*").alias("w"))
    off = _quantiles(off, (0.5,)).select("lang", F.col("q0").alias("off"))
    half = lambda x: F.greatest(F.lit(width) * x, F.lit(floor))
    return found.join(off, "lang").select("lang", (F.col("q1") - half(F.col("q1") - F.col("q0"))).alias("low"), (F.col("q1") + half(F.col("q2") - F.col("q1"))).alias("high"), (F.lit(spread * 1.4826) * F.col("off")).alias("slack"))


def _quantiles(steps: DataFrame, at: tuple[float, ...]) -> DataFrame:
    """(lang, q0, q1, ..): least x that has a share of at least at[i] of its language's weight w at or below it."""
    own = Window.partitionBy("lang")
    share = F.sum("w").over(own.orderBy("x")) / F.sum("w").over(own)
    return steps.withColumn("share", share).groupBy("lang").agg(*(F.min(F.when(F.col("share") >= q, F.col("x"))).alias(f"q{i}") for i, q in enumerate(at)))


def judged(losses: DataFrame, limits: DataFrame) -> DataFrame:
    """(doc_id, lang, n_grams, perplexity, keep): a document is kept inside its language's band, edges included.

    The band is widened by slack / sqrt(n_grams) on both sides, since the mean over a short text varies more.
    """
    more = F.col("slack") / F.sqrt("n_grams")
    return losses.join(limits, "lang").select("doc_id", "lang", "n_grams", F.round(F.exp("loss"), 4).alias("perplexity"), ((F.col("loss") >= F.col("low") - more) & (F.col("loss") <= F.col("high") + more)).alias("keep"))


def rate(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, n_grams, perplexity, keep) of every document, by a model of the documents of the other fold.

    A null language counts as its own, "und". A null or empty text has one symbol, its end. Repeated rows are counted and
    judged apiece. A language whose documents are all in one fold, as where it has only one, offers nothing to hold them
    against, and they are kept. An empty table gives no rows. Further columns are ignored.
    """
    losses = written(held_out_losses(documents))
    return judged(losses, bands(losses))


def filtered(documents: DataFrame) -> DataFrame:
    """The rows of documents that rate() keeps, with all their columns, whatever their names but __rejected.

    Texts are moved once, to drop the rejected rows, or not at all where these are few enough to be broadcast. Rows are told
    by a 128-bit hash of lang and text, on which the verdict depends.
    """
    key = row_key(*fixed("lang", "text"))
    rated = rate(documents.select(key.alias("doc_id"), *fixed("lang", "text")))
    gone = written(rated.where("NOT keep").select(F.col("doc_id").alias("__rejected")).distinct())
    return documents.join(gone, key == F.col("__rejected"), "left_anti")
