"""Document fingerprints: prefix polynomial hashes of word sequences.

S[i] is the sum over j < i of w[j] * B**j modulo a prime, for each of two primes of 31 bits. The hash of any span [a, b) is
(S[b] - S[a]) * B**-a, so two spans are held for equal in constant time, and the longest common extension of two places is
found by binary search on its length. A wrong answer takes a clash modulo both primes, one in 2**61.

A passage of at least LEAST words that a document shares with a query text holds one of the query's windows of WINDOW words that
start at multiples of STEP (WINDOW + STEP - 1 = LEAST). Those windows are indexed; each meeting is extended to both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fixed, lowered, n_words, word_hashes, written

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1402024253)
WINDOW, STEP = 8, 6
LEAST = WINDOW + STEP - 1
_kept: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo prime, by doubling; up to a million are kept for later calls."""
    have = _kept.get((base, prime))
    if have is not None and len(have) >= n:
        return have[:n]
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    if n <= 1 << 20:
        _kept[base, prime] = out
    return out[:n]


class Prefix:
    """Prefix arrays of a sequence of word hashes."""

    def __init__(self, words: np.ndarray) -> None:
        self.n = len(words)
        self.sums, self.inverse = [], []
        for prime, base in zip(PRIMES, BASES, strict=True):
            w = (words % np.uint64(prime)).astype(np.int64)
            sums = np.zeros(self.n + 1, np.int64)
            np.cumsum(w * powers(base, prime, self.n) % prime, out=sums[1:])  # below 2**63 for up to 2**32 words
            self.sums.append(sums % prime)
            self.inverse.append(powers(pow(base, -1, prime), prime, self.n + 1))

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the spans [a, b), 62 bits."""
        h = [(s[b] - s[a]) % p * inv[a] % p for s, inv, p in zip(self.sums, self.inverse, PRIMES, strict=True)]
        return h[0] << 31 | h[1]

    def extension(self, a: np.ndarray, other: Prefix, b: np.ndarray, room: np.ndarray, back: bool = False) -> np.ndarray:
        """Longest common extension of place a here and place b there, `room` words at most; to the left if `back`."""
        lo, hi = np.zeros(len(a), np.int64), room.astype(np.int64)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self.span(a - mid, a) == other.span(b - mid, b) if back else self.span(a, a + mid) == other.span(b, b + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo


class Queries:
    """Prefix arrays of all query texts, one after the other, and the index of their windows."""

    def __init__(self, ids: pa.Array, texts: pa.Array) -> None:
        words, splits = [np.zeros(0, np.uint64)], [0]
        for _, _, data, offsets in chunks(lowered(texts)):
            h, _, _, own = word_hashes(data, offsets)
            words.append(h)
            splits += (own[1:] + splits[-1]).tolist()
        self.ids, self.splits = ids, np.array(splits)
        self.prefix = Prefix(np.concatenate(words))
        counts = np.diff(self.splits)
        n = np.maximum(0, (counts - WINDOW) // STEP + 1)
        first = np.repeat(self.splits[:-1], n) + STEP * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        h = self.prefix.span(first, first + WINDOW)
        by = np.argsort(h, kind="stable")
        self.hash, self.first = h[by], first[by]

    def matches(self, prefix: Prefix, lo: int, hi: int) -> np.ndarray:
        """(item, first word here counted from lo, first word of the item, words), maximal, of the text at words lo .. hi - 1 of prefix."""
        if hi - lo < LEAST or not len(self.hash):
            return np.zeros((0, 4), np.int64)
        at = np.arange(lo, hi - WINDOW + 1)
        h = prefix.span(at, at + WINDOW)
        a, n = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, "right")
        n -= a
        here = np.repeat(at, n)
        there = self.first[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        item = np.searchsorted(self.splits, there, "right") - 1
        left = prefix.extension(here, self.prefix, there, np.minimum(here - lo, there - self.splits[item]), back=True)
        right = prefix.extension(here, self.prefix, there, np.minimum(hi - here, self.splits[item + 1] - there))
        found = np.column_stack([item, here - left - lo, there - left - self.splits[item], left + right])
        return np.unique(found[left + right >= LEAST], axis=0)


def _blocks(queries: DataFrame, block_words: int) -> Iterator[pa.Table]:
    """Query texts, `block_words` at a time on average; a single text is never cut."""
    rows = queries.select(*fixed("item_id", "text")).toDF("item_id", "text").where("text IS NOT NULL")
    total = rows.agg(F.sum(n_words(F.col("text")))).first()[0] or 0
    n = 1 if total <= block_words else -(-2 * total // block_words)
    for i in range(n):
        yield rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).toArrow().combine_chunks()


def fingerprints(documents: DataFrame, queries: DataFrame, block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, n_words, fingerprint, matches): a row for each row of documents.

    fingerprint is the hash of all the text's words: equal for texts that differ in case and punctuation only. matches is an array of
    (item_id, doc_start, item_start, n_words): all maximal passages of at least LEAST words that the text shares with a text of
    `queries` (item_id, text), in that order; words count from 0. A passage is maximal if it can't be extended on its
    diagonal. Items of fewer than LEAST words have no matches.

    Queries are sent to the tasks in blocks of `block_words` words on average; beyond one block, each takes a pass over the
    documents, whose matches are put together by a join on row numbers. One block takes one pass without a shuffle. Texts that are null
    or have no word have n_words 0 and fingerprint 0. Repeated rows are matched apiece; doc_id and item_id may be null
    or of any type; an empty table gives no rows; further columns are ignored.
    """
    rows = documents.select(*fixed("doc_id", "text")).toDF("doc_id", "text")
    kind, item = dict(rows.dtypes)["doc_id"], dict(queries.dtypes)["item_id"]
    blocks = list(_blocks(queries, block_words)) if queries.limit(1).count() else [None]
    one = f"array<struct<item_id: {item}, doc_start: int, item_start: int, n_words: int>>"

    def search(block: pa.Table | None, frame: DataFrame, schema: str) -> DataFrame:
        held = Queries(block["item_id"].combine_chunks(), block["text"].combine_chunks()) if block is not None and block.num_rows else None
        sent = documents.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                for lo, hi, data, offsets in chunks(lowered(batch.column(1))):
                    h, _, _, splits = word_hashes(data, offsets)
                    prefix = Prefix(h)
                    whole = prefix.span(splits[:-1], splits[1:])
                    found = [np.zeros((0, 4), np.int64)] * (hi - lo)
                    at = np.arange(max(0, len(h) - WINDOW + 1))
                    likely = np.flatnonzero(np.isin(prefix.span(at, at + WINDOW), own.hash)) if own else at[:0]
                    for i in np.unique(np.searchsorted(splits, likely, "right") - 1).tolist():
                        found[i] = own.matches(prefix, int(splits[i]), int(splits[i + 1]))
                    flat = np.concatenate(found)
                    ids = own.ids.take(pa.array(flat[:, 0])) if own else pa.nulls(0, batch.schema.field(0).type)
                    parts = pa.StructArray.from_arrays([ids, *(pa.array(flat[:, i].astype(np.int32)) for i in (1, 2, 3))], ["item_id", "doc_start", "item_start", "n_words"])
                    at = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(splits).astype(np.int64)), pa.array(whole), pa.ListArray.from_arrays(pa.array(at), parts)], ["doc_id", "n_words", "fingerprint", "matches"])

        return frame.mapInArrow(run, schema)

    tail = f"n_words long, fingerprint long, matches {one}"
    in_order = F.array_sort("matches")
    if len(blocks) == 1:
        return search(blocks[0], rows, f"doc_id {kind}, {tail}").withColumn("matches", in_order)
    numbered = written(rows.withColumn("row", F.monotonically_increasing_id()))
    found = [search(b, numbered.select("row", "text"), f"doc_id long, {tail}").where("size(matches) > 0").select("doc_id", F.explode("matches").alias("m")) for b in blocks]
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    every = every.groupBy(F.col("doc_id").alias("row")).agg(F.collect_list("m").alias("matches"))
    plain = search(None, numbered.select(F.struct("row", "doc_id").alias("doc_id"), "text"), f"doc_id struct<row: long, doc_id: {kind}>, {tail}").select("doc_id.row", "doc_id.doc_id", "n_words", "fingerprint")
    return plain.join(every, "row", "left").select("doc_id", "n_words", "fingerprint", F.coalesce(in_order, F.expr(f"CAST(array() AS {one})")).alias("matches"))
