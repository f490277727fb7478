"""K-d tree sharding: documents are split at weighted medians until every shard has at most the target bytes.

A node is split along the metadata dimension in which its documents are widest, in proportion to the whole table's width: log of
the number of characters, source and language (by a hash). Only where all of these agree is it split by a hash of the row, so
a source or a group of equal metadata of any size ends up in shards of the target size. Medians are of bytes: the tasks sum
histograms of all nodes of a level at once, and the bin that holds the middle is refined until a cut within `tolerance`
of it is found or a single value is left. What the driver holds is the tree, a node for every target of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fixed, written
from .rows import keyed

TARGET = 64 << 20
DIMENSIONS = ("n_chars", "source", "lang", "row")
BINS = 512


@dataclass
class Tree:
    """Inner nodes send values up to `value` along `dim` to `left` and the rest to `right`; leaves have dim -1."""

    dim: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, dim: int, value: float) -> tuple[int, int]:
        first = len(self.dim)
        self.dim[node], self.value[node], self.left[node], self.right[node] = dim, value, first, first + 1
        for i in (first, first + 1):
            self.dim.append(-1)
            self.value.append(0.0)
            self.left.append(i)
            self.right.append(i)
        return first, first + 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x."""
        dim, value, left, right = (np.array(a) for a in (self.dim, self.value, self.left, self.right))
        node = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(dim[node] >= 0)).size:
            n = node[inner]
            node[inner] = np.where(x[inner, dim[n]] <= value[n], left[n], right[n])
        return node

    def order(self) -> dict[int, int]:
        """Number of each leaf from left to right."""
        out: dict[int, int] = {}
        stack = [0]
        while stack:
            n = stack.pop()
            if self.dim[n] < 0:
                out[n] = len(out)
            else:
                stack += [self.right[n], self.left[n]]
        return out


def _points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    k = len(DIMENSIONS)
    return np.column_stack([batch.column(i).to_numpy() for i in range(k)]), batch.column(k).to_numpy().astype(np.float64)


def _extents(points: DataFrame, tree: Tree) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """(bytes, least and greatest value in each dimension) of each leaf that has rows."""
    k = len(DIMENSIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, w = _points(batch)
            leaf, at = np.unique(tree.leaves(x), return_inverse=True)
            low, high = np.full((len(leaf), k), np.inf), np.full((len(leaf), k), -np.inf)
            np.minimum.at(low, at, x)
            np.maximum.at(high, at, x)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(np.bincount(at, w, len(leaf))), *(pa.array(low[:, i].copy()) for i in range(k)), *(pa.array(high[:, i].copy()) for i in range(k))], ["leaf", "w", *(f"a{i}" for i in range(k)), *(f"b{i}" for i in range(k))])

    schema = ", ".join(["leaf long", "w double", *(f"{c}{i} double" for c in "ab" for i in range(k))])
    found = points.mapInArrow(run, schema).groupBy("leaf").agg(F.sum("w"), *(F.min(f"a{i}") for i in range(k)), *(F.max(f"b{i}") for i in range(k))).collect()
    return {r[0]: (r[1], np.array(r[2 : 2 + k]), np.array(r[2 + k :])) for r in found}


def _histograms(points: DataFrame, tree: Tree, search: dict[int, tuple[int, float, float]]) -> dict[int, np.ndarray]:
    """For each node (dim, low, high): its bins between low and high as rows (bin, bytes, least value, greatest value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array(sorted(search))
        dims, lows, highs = (np.array([search[i][j] for i in ids.tolist()]) for j in range(3))
        for batch in batches:
            x, w = _points(batch)
            leaf = tree.leaves(x)
            at = np.minimum(np.searchsorted(ids, leaf), len(ids) - 1)
            rows = np.flatnonzero(ids[at] == leaf)
            at = at[rows]
            v = x[rows, dims[at]]
            inside = (v >= lows[at]) & (v <= highs[at])
            rows, at, v = rows[inside], at[inside], v[inside]
            b = np.clip(((v - lows[at]) / np.maximum(highs[at] - lows[at], 1e-300) * BINS).astype(np.int64), 0, BINS - 1)
            cell, to = np.unique(at * BINS + b, return_inverse=True)
            low, high = np.full(len(cell), np.inf), np.full(len(cell), -np.inf)
            np.minimum.at(low, to, v)
            np.maximum.at(high, to, v)
            yield pa.RecordBatch.from_arrays([pa.array(ids[cell // BINS]), pa.array(cell % BINS), pa.array(np.bincount(to, w[rows], len(cell))), pa.array(low), pa.array(high)], ["leaf", "bin", "w", "low", "high"])

    found = points.mapInArrow(run, "leaf long, bin long, w double, low double, high double").groupBy("leaf", "bin").agg(F.sum("w"), F.min("low"), F.max("high")).collect()
    out: dict[int, list] = {i: [] for i in search}
    for leaf, *rest in found:
        out[leaf].append(rest)
    return {i: np.array(sorted(r)).reshape(-1, 4) for i, r in out.items()}


def _cuts(points: DataFrame, tree: Tree, wide: dict[int, tuple[int, float, float, float]], tolerance: float) -> dict[int, tuple[int, float]]:
    """(dim, value) at which to split each node (dim, low, high, bytes): the weighted median, as near as values and tolerance allow."""
    out: dict[int, tuple[int, float]] = {}
    search = {n: (d, a, b) for n, (d, a, b, _) in wide.items()}
    before = dict.fromkeys(search, 0.0)
    while search:
        for n, rows in _histograms(points, tree, search).items():
            dim, _, top, total = wide[n]
            upto = before[n] + np.cumsum(rows[:, 1])
            able = rows[:, 3] < top  # a cut at the greatest value would leave nothing on the right
            off = np.where(able, np.abs(upto / total - 0.5), np.inf)
            i = int(np.searchsorted(upto, total / 2))
            i = min(i, len(rows) - 1)
            best = int(np.argmin(off))
            if off[best] <= tolerance or rows[i, 2] == rows[i, 3]:
                if np.isfinite(off[best]):
                    out[n] = (dim, float(rows[best, 3]))
                else:  # all that is left is the greatest value: cut just below it
                    out[n] = (dim, float(np.nextafter(top, -np.inf)))
                del search[n]
            else:
                search[n] = (dim, float(rows[i, 2]), float(rows[i, 3]))
                before[n] = float(upto[i] - rows[i, 1])
    return out


def build(points: DataFrame, target: int, tolerance: float = 0.01) -> tuple[Tree, dict[int, float]]:
    """The tree over points (a column for each dimension, bytes) and the bytes of its leaves."""
    tree, done = Tree(), {}
    seen = _extents(points, tree)
    if not seen:
        return tree, {}
    spread = np.maximum(seen[0][2] - seen[0][1], 1e-300)
    while seen:
        wide = {}
        for n, (w, low, high) in seen.items():
            share = (high - low) / spread
            dim = int(np.argmax(share[:-1]))
            dim = dim if share[dim] > 0 else len(DIMENSIONS) - 1
            if w <= target or share[dim] <= 0:
                done[n] = w
            else:
                wide[n] = (dim, float(low[dim]), float(high[dim]), w)
        if not wide:
            break
        for n, (dim, value) in _cuts(points, tree, wide, tolerance).items():
            tree.split(n, dim, value)
        seen = {n: x for n, x in _extents(points, tree).items() if n not in done}
    return tree, done


def shards(documents: DataFrame, target: int = TARGET, tolerance: float = 0.01) -> DataFrame:
    """(doc_id, shard, n_bytes, shard_bytes) of every row of documents; shards are numbered 0 on, from left to right in the tree.

    n_bytes is that of the text in UTF-8, and shard_bytes the shard's sum of it, `target` at most unless one row alone has more.
    Number of characters is n_chars, or where that column is missing or null the text's. Null sources and languages are
    values like any other; without those columns their dimension has no width. Null and empty texts have 0 bytes. Equal rows are
    told apart by number, so they can be split too. A cut of more than `tolerance` off the middle is made only where values tie. An
    empty table gives no rows; further columns are ignored.
    """
    has = set(documents.columns)
    own = [c for c in ("doc_id", "text", "n_chars", "source", "lang") if c in has]
    rows = keyed(documents.select(*fixed(*own)))
    part = lambda c: (F.shiftrightunsigned(F.xxhash64(F.lit(7), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-"))), 11) / F.lit(float(1 << 53))) if c in has else F.lit(0.0)
    length = F.coalesce(*([F.col("`n_chars`").cast("double")] if "n_chars" in has else []), F.length("`text`").cast("double"), F.lit(0.0))
    size = F.coalesce(F.octet_length("`text`"), F.lit(0)).cast("long")
    row = F.shiftrightunsigned(F.xxhash64("__key", "__copy"), 11) / F.lit(float(1 << 53))
    slim = written(rows.select(F.log1p(F.greatest(length, F.lit(0.0))).alias("n_chars"), part("source").alias("source"), part("lang").alias("lang"), row.alias("row"), size.alias("n_bytes"), F.col("`doc_id`").alias("doc_id")))
    tree, sizes = build(slim.select(*DIMENSIONS, "n_bytes"), target, tolerance)
    number = tree.order()
    names = np.array([number.get(i, -1) for i in range(len(tree.dim))])
    totals = np.array([int(sizes.get(i, 0)) for i in range(len(tree.dim))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaves(_points(batch)[0])
            yield pa.RecordBatch.from_arrays([batch.column(5), pa.array(names[leaf]), batch.column(4), pa.array(totals[leaf])], ["doc_id", "shard", "n_bytes", "shard_bytes"])

    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, shard long, n_bytes long, shard_bytes long")
