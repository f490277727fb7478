"""Best-fit packing of documents into training sequences of at most `length` words.

A longer document is cut into pieces of `length` words and a rest; nothing else is cut. Pieces are packed by
best-fit decreasing over all documents: from the longest on, each goes to the fullest sequence that still has
room for it. A segment tree over remaining capacities finds that sequence in O(log length) steps. Pieces of one size are alike to
the algorithm and so are sequences with one amount of room, so the driver packs the histogram of sizes, of at most `length`
rows, and yields runs of pieces for runs of sequences; the result is that of packing one by one. Each step uses up a
size or a run, of which each size adds two at most, so runs number at most 2 length^2 whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fixed, n_words, written
from .rows import keyed, running_sum

LENGTH = 2048
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))


class Capacities:
    """A segment tree over remaining capacities 0 .. length; a node holds how many runs of open sequences lie under it."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.under = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        node = self.leaves + capacity
        while node:
            self.under[node] += n
            node >>= 1

    def tightest(self, size: int) -> int:
        """The least capacity of at least `size` that an open sequence has, or -1."""
        node = self.leaves + size
        if self.under[node]:
            return size
        while node > 1 and (node & 1 or not self.under[node + 1]):  # up, until the right neighbour holds one
            node >>= 1
        if node <= 1:
            return -1
        node += 1
        while node < self.leaves:  # down to its leftmost
            node = 2 * node if self.under[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit(histogram: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """(size, first, stop, sequence, each): pieces first .. stop - 1 of a size go to sequences from `sequence` on, `each` to one."""
    room: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]  # by room left: runs (first sequence, number)
    open_ = Capacities(length)
    made, out = 0, []

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            room[left].append((first, n))
            open_.add(left, 1)

    for size in sorted(histogram, reverse=True):
        done, count = 0, histogram[size]
        while done < count:
            level = open_.tightest(size)
            if level >= 0:
                first, n = room[level].pop()
                open_.add(level, -1)
            else:
                level, first, n = length, made, -(-(count - done) // (length // size))
                made += n
            each = level // size
            full = min(n, (count - done) // each)
            if full:
                out.append((size, done, done + full * each, first, each))
                done += full * each
                put(level - each * size, first, full)
                first, n = first + full, n - full
            if n and (rest := min(count - done, each - 1)) > 0:
                out.append((size, done, done + rest, first, rest))
                done += rest
                put(level - rest * size, first, 1)
                first, n = first + 1, n - 1
            put(level, first, n)
    return out


def cut(text: str, length: int) -> list[str]:
    """The text in pieces of `length` words; the space within a piece stays."""
    data = text.encode()
    space = np.concatenate([[True], _SPACE[np.frombuffer(data, np.uint8)], [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    return [data[a:b].decode() for a, b in zip(starts[::length], [*ends[length - 1 :: length], *([ends[-1]] if len(ends) % length else [])], strict=True)]


def packed(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequence, n_tokens, position, pieces): a row for each sequence, with all words of all documents.

    pieces is an array of (position, doc_id, piece, n_tokens, text) in that order; position is that of documents, null if
    they have none, and the sequence's is the least. A text without a word (null, empty, white space) makes no piece, so an
    empty table gives no rows. Pieces of one size, and sequences with equal room, are interchangeable: which of them meet goes
    by a hash. Repeated rows are packed apiece. Further columns are ignored, whatever their names but __key and __copy.
    """
    kind = dict(documents.dtypes)["doc_id"]
    position = F.col("`position`").cast("long") if "position" in documents.columns else F.lit(None).cast("long")
    rows = keyed(documents.select(*fixed("doc_id", "text"), position.alias("position")))
    slim = rows.select("__key", "__copy", n_words(F.col("text")).alias("n")).where("n > 0")
    whole, rest = F.floor(F.col("n") / length).cast("int"), F.col("n") % length
    sizes = F.concat(F.array_repeat(F.lit(length).cast("long"), whole), F.filter(F.array(rest), lambda x: x > 0))
    pieces = written(slim.select("__key", "__copy", F.posexplode(sizes).alias("piece", "size")))
    runs = best_fit({r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}, length)
    runs = np.array(sorted(runs), np.int64).reshape(-1, 5)
    sent = documents.sparkSession.sparkContext.broadcast(runs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            size, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy() - 1
            row = np.searchsorted(keys, size << 44 | rank, "right") - 1
            found = table[row, 3] + (rank - table[row, 1]) // table[row, 4]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found)], ["__key", "__copy", "piece", "sequence"])

    drawn = pieces.withColumn("draw", F.hex(F.xxhash64("__key", "__copy", "piece")))
    drawn = drawn.withColumn("draw", F.lpad("draw", 16, "0"))
    numbered = running_sum(drawn, "size", ["draw", "__key", "__copy", "piece"], F.lit(1), "rank", "draw").select("__key", "__copy", "piece", "size", F.col("rank").cast("long").alias("rank"))
    placed = numbered.mapInArrow(place, "__key long, __copy int, piece int, sequence long")
    at = placed.groupBy("__key", "__copy").agg(F.transform(F.array_sort(F.collect_list(F.struct("piece", "sequence"))), lambda x: x["sequence"]).alias("at"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = batch.column(3)
            counts = to.value_lengths().to_numpy()
            row = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            texts = [x for t, n in zip(batch.column(2).to_pylist(), counts, strict=True) for x in (cut(t, length) if n > 1 else [t])]
            first = np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array((np.arange(len(row)) - first).astype(np.int32)), pa.array(texts, pa.string()), to.flatten()], ["position", "doc_id", "piece", "text", "sequence"])

    both = rows.join(at, ["__key", "__copy"]).select("position", "doc_id", "text", "at")
    cuts = both.mapInArrow(split, f"position long, doc_id {kind}, piece int, text string, sequence long").withColumn("n_tokens", n_words(F.col("text")))
    parts = F.array_sort(F.collect_list(F.struct("position", "doc_id", "piece", "n_tokens", "text")))
    return cuts.groupBy("sequence").agg(F.sum("n_tokens").alias("n_tokens"), F.min("position").alias("position"), parts.alias("pieces"))
