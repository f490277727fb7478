"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 240 bits in twelve segments of 20. Every distinct word of a text votes on each bit with the square root
of its count. Two fingerprints at most 35 bits apart differ in at most two bits of some segment (12 segments with three or more
would make 36). So every pair within the radius is found by looking up, for each segment, all values within two flips
of a fingerprint's own in the table of that segment, and verifying complete distances: nothing is cut off.

Pairs of values within two flips grow with the square of the table, so that few of them may be looked at closely. Go round the twelve
segments in a ring from segment to segment and add up differing bits, less three for each segment: a pair within the radius
ends below 0, so that from the last place where this sum is greatest, every run of k segments differs in less than 3 k bits (cycle lemma). A
pair is found from that one segment only, and there the next three segments, which fit an integer, must differ in less than 12 bits together with it:
this is all that is computed for a pair of values, and hardly an unrelated pair is left to have its complete distance taken.

A segment's table is spread over tasks by the first bits of the value. A fingerprint is sent to its own part and, as a
query with as many flips less to spend, to the parts that it reaches by flipping leading bits, of which only the smaller
values are visited, as the other side of the pair visits the rest. The balls round the remaining bits are enumerated in
the task, over an array indexed by value. Parts that hold more than `most` fingerprints are split, and what queries them
is sent to every piece (fingerprints of the same part only to the later ones, as the earlier ones are sent to theirs).

Groups are the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, chunks, fixed, lowered, mix, row_key, word_hashes, written

SEGMENTS, WIDTH, FLIPS = 12, 20, 2
BITS = SEGMENTS * WIDTH
RADIUS = SEGMENTS * (FLIPS + 1) - 1
WORDS = 4  # 64-bit integers in a fingerprint
_BLOCK = 4096
_LOOKUPS, _PAIRS = 1 << 18, 1 << 16  # at once, to stay in a core's cache


def votes(words: np.ndarray) -> np.ndarray:
    """256 sums of votes over a text's word hashes; taken a block of distinct words at a time."""
    h, count = np.unique(words, return_counts=True)
    weight = np.sqrt(count).astype(np.float32)
    total = np.zeros(64 * WORDS, np.float64)
    for lo in range(0, len(h), _BLOCK):
        own = h[lo : lo + _BLOCK]
        many = np.stack([own, *(mix(own + np.uint64(0x9E3779B97F4A7C15 * i & 0xFFFFFFFFFFFFFFFF)) for i in (1, 2, 3))], 1)
        bits = np.unpackbits(many.view(np.uint8), axis=1, bitorder="little")
        w = weight[lo : lo + _BLOCK]
        total += 2.0 * (w @ bits) - w.sum(dtype=np.float64)
    return total


def _fingerprints(words: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """Four 64-bit integers for each text; bits from BITS on are 0."""
    margin = np.zeros((len(splits) - 1, 64 * WORDS), np.float64)
    for i in range(len(splits) - 1):
        if splits[i + 1] > splits[i]:
            margin[i] = votes(words[splits[i] : splits[i + 1]])
    margin[:, BITS:] = 0
    return np.packbits(margin > 0, axis=1, bitorder="little").view(np.uint64)


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, f0 .. f3): fingerprint of every row; nulls where its text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(lowered(batch.column(1))):
                h, _, _, splits = word_hashes(data, offsets)
                prints = _fingerprints(h, splits).view(np.int64)
                empty = np.diff(splits) == 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(np.ascontiguousarray(prints[:, i]), mask=empty) for i in range(WORDS))], ["doc_id", *(f"f{i}" for i in range(WORDS))])

    rows = documents.select(*fixed("doc_id", "text")).toDF("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, f0 long, f1 long, f2 long, f3 long")


def _segment(prints: np.ndarray, i: int) -> np.ndarray:
    """Values of segment i of (n, 4) fingerprints."""
    word, shift = divmod(i * WIDTH, 64)
    x = prints[:, word] >> np.uint64(shift)
    if shift + WIDTH > 64:
        x = x | prints[:, word + 1] << np.uint64(64 - shift)
    return (x & np.uint64((1 << WIDTH) - 1)).astype(np.int64)


def segments(prints: np.ndarray) -> np.ndarray:
    """(n, 12) segment values of (n, 4) fingerprints."""
    return np.stack([_segment(prints, i) for i in range(SEGMENTS)], 1)


def _following(prints: np.ndarray, segment: int) -> np.ndarray:
    """The next three segments in the ring as an integer."""
    return np.bitwise_or.reduce([_segment(prints, (segment + i) % SEGMENTS) << (i - 1) * WIDTH for i in (1, 2, 3)])


def _starts(differing: np.ndarray) -> np.ndarray:
    """For (n, 4) differing bits of pairs within the radius, the segment from which each is found."""
    over = np.bitwise_count(segments(differing)).astype(np.int8) - np.int8(FLIPS + 1)
    before = np.cumsum(over, 1, dtype=np.int16) - over
    return SEGMENTS - 1 - np.argmax(before[:, ::-1], 1)


def ball(width: int, flips: int) -> np.ndarray:
    """All masks of `width` bits with at most `flips` ones."""
    return np.array([sum(1 << b for b in c) for n in range(flips + 1) for c in combinations(range(width), n)], np.int64)


def _sent(segment: np.ndarray, lead: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows, leading bits visited, flips spent) for one segment's values."""
    own = segment >> (WIDTH - lead)
    for mask in ball(lead, min(FLIPS, lead)).tolist():
        to = own ^ mask
        rows = np.flatnonzero(to < own) if mask else np.arange(len(own))
        yield rows, to[rows], mask.bit_count()


def _pieces(counts: np.ndarray, most: int) -> np.ndarray:
    return np.maximum(1, -(-counts // most))


def _matches(starts: np.ndarray, keys: np.ndarray, ask: np.ndarray, ask_keys: np.ndarray, masks: np.ndarray, least: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries' places, entries' places) with values that differ by one of the masks and keys in less than `least` bits, block by block.

    Entries lie in the order of their values, those of value v from starts[v] on. own: the queries are the entries, and each pair comes once.
    """
    step = max(1, _LOOKUPS // max(1, len(ask)))
    for i in range(0, len(masks), step):
        flips = masks[i : i + step, None]
        value = ask[None, :] ^ flips
        a = starts[value]
        n = starts[value + 1] - a
        if own:
            n[value < ask] = 0
            same = np.flatnonzero(flips == 0)
            a[same] = np.arange(1, len(ask) + 1)
            n[same] = starts[ask + 1] - a[same]
        n, a = n.ravel(), a.ravel()
        hit = np.flatnonzero(n)
        n, a, q = n[hit], a[hit], hit % len(ask)
        ends = np.cumsum(n, dtype=np.int64)
        lo = 0
        while lo < len(hit):  # so many pairs of values at once, or those of one query
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + _PAIRS, "right")))
            m, stop = n[lo:hi], (ends[lo:hi] - before).astype(np.int32)
            at = np.arange(stop[-1], dtype=np.int32)
            at += np.repeat(a[lo:hi] - stop + m, m)
            found = np.flatnonzero(np.bitwise_count(keys[at] ^ np.repeat(ask_keys[q[lo:hi]], m)) < least)
            if len(found):
                yield q[lo + np.searchsorted(stop, found, "right")], at[found]
            lo = hi


def _linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row of each row's component."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        left = label[a] != label[b]
        if not left.any():
            break
        a, b = a[left], b[left]
    while (label[label] != label).any():
        label = label[label]
    return label


def _verify(part: pa.Table, lead: int) -> pa.Table:
    """Links among the fingerprints of one part of one segment's table, as a spanning forest, and how many each has."""
    node, spent = part["node"].to_numpy(), part["spent"].to_numpy()
    prints = np.column_stack([part[f"f{i}"].to_numpy().view(np.uint64) for i in range(WORDS)])
    segment = int(part["segment"][0].as_py())
    width = WIDTH - lead
    low = (_segment(prints, segment) & ((1 << width) - 1)).astype(np.int32)
    keys = _following(prints, segment)
    home = part["entry"].to_numpy()
    by_value = lambda chosen: (rows := np.flatnonzero(chosen))[np.argsort(low[rows], kind="stable")]
    order = by_value(home)
    starts = np.searchsorted(low[order], np.arange((1 << width) + 1)).astype(np.int32)
    entry_keys = keys[order]
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    links = np.zeros(len(node), np.int64)
    label = np.arange(len(node))
    held = 0
    for s, own in ((0, True), *((s, False) for s in range(FLIPS + 1))):
        ask = order if own else by_value((spent == s) & ~home)
        if not len(ask) or not len(order):
            continue
        for q, e in _matches(starts, entry_keys, low[ask], keys[ask], ball(width, min(FLIPS - s, width)).astype(np.int32), 4 * (FLIPS + 1) - s, own):
            q, e = ask[q], order[e]
            differing = prints[q] ^ prints[e]
            near = np.flatnonzero(np.bitwise_count(differing).sum(1) <= RADIUS)
            if len(near):
                near = near[_starts(differing[near]) == segment]
            q, e = q[near], e[near]
            np.add.at(links, q, 1)
            np.add.at(links, e, 1)
            edges.append((q, e))
            held += len(q)
            if held > 1 << 22:
                label = _linked(len(node), *(np.concatenate(x) for x in zip(*edges, (np.arange(len(node)), label), strict=True)))
                edges, held = [], 0
    label = _linked(len(node), *(np.concatenate(x) for x in zip(*edges, (np.arange(len(node)), label), strict=True)))
    u = np.flatnonzero((label != np.arange(len(node))) | (links > 0))
    return pa.table({"u": node[u], "v": node[label[u]], "links": links[u]})


def links(nodes: DataFrame, most: int = 250_000) -> DataFrame:
    """(u, v, links): edges u - v that connect what the pairs within RADIUS bits connect, and numbers of such pairs, to be summed for each u.

    nodes: (node, f0 .. f3), one row a distinct fingerprint. v may be u. `most` fingerprints of a segment's table are
    held against the queries in one task; more are split over several. It steers the work and never the result. With L
    leading bits a fingerprint is sent 12 (1 + L / 2 + L (L - 1) / 4) times on average; L is 4 up to 16 times `most`
    fingerprints and their number's binary logarithm beyond.
    """
    lead = min(14, max(4, int(np.ceil(np.log2(max(1, nodes.count() / most))))))
    cells = 1 << lead

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((SEGMENTS, cells), np.int64)
        for batch in batches:
            values = segments(np.column_stack([batch.column(1 + i).to_numpy().view(np.uint64) for i in range(WORDS)])) >> (WIDTH - lead)
            for i in range(SEGMENTS):
                n[i] += np.bincount(values[:, i], minlength=cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n.size)), pa.array(n.ravel())], ["cell", "n"])

    counts = np.zeros(SEGMENTS * cells, np.int64)
    for cell, n in nodes.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():  # at most 12 x 16384 rows
        counts[cell] = n
    pieces = _pieces(counts, most)
    first = np.cumsum(pieces) - pieces  # number of a cell's first piece

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            values = segments(np.column_stack([batch.column(1 + i).to_numpy().view(np.uint64) for i in range(WORDS)]))
            for i in range(SEGMENTS):
                for rows, to, spent in _sent(values[:, i], lead):
                    cell = i * cells + to
                    n = pieces[cell]
                    at = np.repeat(np.arange(len(rows)), n)
                    piece = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                    own = rows[at]
                    home = np.zeros(len(own), bool)
                    if not spent:  # all rows, in their own part
                        entry = (mix(node.view(np.uint64)) % n.astype(np.uint64)).astype(np.int64)[at]
                        later = piece >= entry
                        home = (piece == entry)[later]
                        at, piece, own = at[later], piece[later], own[later]
                    take = pa.array(own)
                    yield pa.RecordBatch.from_arrays([pa.array(first[cell[at]] + piece), pa.array(np.full(len(own), i, np.int32)), pa.array(np.full(len(own), spent, np.int32)), pa.array(home), batch.column(0).take(take), *(batch.column(1 + k).take(take) for k in range(WORDS))], ["part", "segment", "spent", "entry", "node", *(f"f{k}" for k in range(WORDS))])

    sent = nodes.select("node", "f0", "f1", "f2", "f3").mapInArrow(spread, "part long, segment int, spent int, entry boolean, node long, f0 long, f1 long, f2 long, f3 long")
    return sent.groupBy("part").applyInArrow(lambda t: _verify(t, lead), "u long, v long, links long")


def components(pairs: DataFrame) -> DataFrame:
    """(node, label): label is the least node of the connected component; nodes that are in a pair only.

    Alternates large-star and small-star steps, O(log n) rounds, each cut by a reliable checkpoint.
    """
    edges = checkpointed(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        new = checkpointed(small)
        same = new.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(new, ["u", "v"], "left_anti").isEmpty()
        edges = new
        if same:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _grouped(prints: DataFrame) -> DataFrame:
    """prints (doc_id, row, f0 .. f3, and so on) with group (a row number, the least of the group), links and class_size."""
    f = [f"f{i}" for i in range(WORDS)]
    nodes = written(prints.where("f0 IS NOT NULL").groupBy(*f).agg(F.min("row").alias("node"), F.count("*").alias("class_size")))
    found = checkpointed(links(nodes))
    number = found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("u").alias("a"), F.col("v").alias("b")))
    known = nodes.join(label, "node", "left").join(number, "node", "left").select(*f, "class_size", F.coalesce("label", "node").alias("group"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    return prints.join(known, f, "left").withColumns({"group": F.coalesce("group", "row"), "links": F.coalesce("links", F.lit(0).cast("long")), "class_size": F.coalesce("class_size", F.lit(1).cast("long"))})


def _numbered(documents: DataFrame) -> DataFrame:
    return written(fingerprints(documents).withColumn("row", F.monotonically_increasing_id()))


def groups(documents: DataFrame) -> DataFrame:
    """(doc_id, group_id, group_size, copies, links, keep) for every row of documents.

    group_id is the least doc_id of the row's group of near duplicates, group_size its number of rows. copies is the
    number of rows with the row's fingerprint, itself included, and links the number of other fingerprints
    within RADIUS bits of it: all of them, between different texts, without expanding copies into pairs. keep is true
    for one row of each group, one with the least doc_id (nulls come last; of several such rows, the first that was read).

    Exact copies have equal fingerprints and always share a group. Case and punctuation don't count. A text without a word
    (null, empty, punctuation only) is a duplicate of nothing: its row is a group of its own. A row's doc_id plays no part
    in what it is a duplicate of: rows that share one are told apart, and a row with a null doc_id is grouped by its text;
    group_id is null where the whole group has no doc_id. An empty table gives no rows. Further columns are ignored.
    """
    both = _grouped(_numbered(documents))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    sizes = both.groupBy(F.col("group").alias("of")).agg(F.count("*").alias("group_size"), F.min(order).alias("first"))
    return both.join(sizes, F.col("group") == F.col("of")).select("doc_id", F.col("first.doc_id").alias("group_id"), "group_size", F.col("class_size").alias("copies"), "links", (F.col("row") == F.col("first.row")).alias("keep"))


def filtered(documents: DataFrame) -> DataFrame:
    """The rows of documents that groups() keeps, with all their columns; one row of each group.

    What goes is found on fingerprints alone, of distinct (doc_id, text) by a hash of both; texts are moved once, to drop
    it. Of rows that agree in doc_id and text one stays; if further columns differ, any of them. Names of further columns
    may be anything but __print.
    """
    key = row_key(*fixed("doc_id", "text"))
    slim = documents.select(key.alias("doc_id"), F.struct(F.col("`doc_id`").isNull(), F.col("`doc_id`")).alias("order"), F.col("`text`").alias("text"))
    prints = written(fingerprints(slim.select("doc_id", "text")).withColumn("row", F.monotonically_increasing_id()))
    orders = slim.select("doc_id", "order").distinct()
    both = _grouped(prints).where("f0 IS NOT NULL").select("doc_id", "row", "group", "class_size", "links")
    many = both.withColumn("n", F.lit(1)).groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    member = written(both.join(many, "group").join(orders, "doc_id").select("doc_id", "row", "group", "order"))
    first = member.groupBy("group").agg(F.min(F.struct("order", "row", "doc_id")).alias("first"))
    kept = written(first.select(F.col("first.doc_id").alias("__print")))
    gone = member.select(F.col("doc_id").alias("__print")).distinct().join(kept, "__print", "left_anti")
    left = documents.join(gone, key == F.col("__print"), "left_anti")
    repeated = written(member.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__print")).join(kept, "__print", "left_semi"))
    if repeated.isEmpty():
        return left
    once = left.withColumn("__print", key).join(repeated, "__print", "left_semi").dropDuplicates(["__print"]).drop("__print")
    return left.join(repeated, key == F.col("__print"), "left_anti").unionByName(once)
