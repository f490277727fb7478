"""Token counts by a finite-state transducer whose transitions are annotated with what they emit.

The splitting pattern of the byte-level tokenizers is compiled to a deterministic transducer over classes of characters. Its
transitions tell where pieces start; since the pattern looks ahead, a start may be told one character late. Texts
are cut into chunks of characters; each chunk is run from all states at once, which gives its state map: for each start state the end
state and the number of pieces emitted. Maps are composed by a parallel prefix scan, so each chunk's real start state is
known, and one more run from it yields the starts. A transition that ends a piece emits the piece's number of
tokens under the vocabulary's merges, which is kept for pieces met before. Counts equal those of the tokenizer itself.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, fixed, mix, powers

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CLASSES = END, PAD, LETTER, STMD, R, V, L, E, DIGIT, SPACE, WHITE, APOSTROPHE, OTHER = range(13)
STATES = START, LET, NUM, SYM, SP, WSO, WSP, WSO2, AP, AR, AV, AL = range(12)
_LETTERS = (LETTER, STMD, R, V, L, E)
_WHITE = [9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CHUNK = 256
NEW, LATE = 1, 2  # emissions: a piece starts at this character; at the one before


def compiled() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) by state and class: 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?digits| ?others|white space but its last before more|white space."""
    to, out = np.zeros((len(STATES), len(CLASSES)), np.int8), np.zeros((len(STATES), len(CLASSES)), np.int8)
    fresh = {**dict.fromkeys(_LETTERS, LET), DIGIT: NUM, SPACE: SP, WHITE: WSO, APOSTROPHE: AP, OTHER: SYM}
    for s in STATES:
        for c in CLASSES:
            if c == PAD:
                to[s, c] = s
                continue
            if c == END:
                to[s, c], out[s, c] = START, LATE if s in (AR, AV, AL) else 0
                continue
            nxt, emit = fresh[c], NEW
            if (s == LET and c in _LETTERS) or (s == NUM and c == DIGIT):
                emit = 0
            elif s in (SYM, AP) and c in (APOSTROPHE, OTHER):
                nxt, emit = SYM, 0
            elif s == SP:
                nxt, emit = {SPACE: WSP, WHITE: WSO2, APOSTROPHE: SYM}.get(c, nxt), 0
            elif s in (WSO, WSP, WSO2) and c in (SPACE, WHITE):
                nxt, emit = WSP if c == SPACE else WSO2, 0
            elif s == WSP:
                nxt, emit = SYM if c == APOSTROPHE else nxt, LATE
            elif s == WSO2:
                emit = NEW | LATE
            elif s == AP and c in (STMD, R, V, L):
                nxt, emit = {STMD: START, R: AR, V: AV, L: AL}[c], 0
            elif s in (AR, AV) and c == E or s == AL and c == L:
                nxt, emit = START, 0
            elif s in (AR, AV, AL):
                emit = LATE if c in _LETTERS else LATE | NEW
            to[s, c], out[s, c] = nxt, emit
    return to, out


NEXT, EMIT = compiled()
_class_table: np.ndarray | None = None


def class_table() -> np.ndarray:
    """Class of every code point."""
    global _class_table
    if _class_table is None:
        kinds = {"L": LETTER, "N": DIGIT}
        table = np.array([kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
        table[_WHITE] = WHITE
        for chars, c in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E), (" ", SPACE), ("'", APOSTROPHE)):
            for x in chars:
                table[ord(x)] = c
        _class_table = table
    return _class_table


def composed(to: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive prefix scan of the state maps of consecutive chunks (chunk, state): end states and numbers emitted, by doubling."""
    to, n, step = to.copy(), n.copy(), 1
    while step < len(to):
        before, after = to[:-step], to[step:]
        n[step:] = n[:-step] + np.take_along_axis(n[step:], before.astype(np.int64), 1)
        to[step:] = np.take_along_axis(after, before.astype(np.int64), 1)
        step *= 2
    return to, n


def emissions(classes: np.ndarray) -> np.ndarray:
    """What the transducer, begun in START, emits at each character."""
    n = -(-len(classes) // CHUNK)
    grid = np.full(n * CHUNK, PAD, np.int64)
    grid[: len(classes)] = classes
    grid = np.ascontiguousarray(grid.reshape(n, CHUNK).T)
    flat_to, flat_out = NEXT.ravel().astype(np.int64) * len(CLASSES), EMIT.ravel()
    pieces = np.array([0, 1, 1, 2])[flat_out]
    state = np.tile(np.arange(len(STATES)) * len(CLASSES), (n, 1))
    made = np.zeros((n, len(STATES)), np.int64)
    for column in grid:
        at = state + column[:, None]
        made += pieces[at]
        state = flat_to[at]
    ends, _ = composed(state // len(CLASSES), made)
    state = np.concatenate([[START], ends[:-1, START]]) * len(CLASSES)
    out = np.empty((CHUNK, n), np.int8)
    for i, column in enumerate(grid):
        at = state + column
        out[i] = flat_out[at]
        state = flat_to[at]
    return out.T.ravel()[: len(classes)]


def starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after last of each piece, n + 1 offsets of the texts into the pieces)."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[first].astype(np.uint32)
    code = b.copy()
    for low, size, mask in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
        own = np.flatnonzero(b >= low)
        if len(own):
            c = b[own] & mask
            for i in range(1, size):
                c = c << 6 | data[np.minimum(first[own] + i, len(data) - 1)] & 0x3F
            code[own] = c
    texts = np.arange(len(offsets) - 1)
    splits = np.searchsorted(first, offsets)
    classes = np.full(len(code) + len(texts), END, np.uint8)
    at = np.arange(len(code)) + np.repeat(texts, np.diff(splits))
    classes[at] = class_table()[np.minimum(code, 0x10FFFF)]
    emitted = emissions(classes)
    begun = np.zeros(len(classes) + 1, bool)
    begun[:-1] |= emitted & NEW > 0
    begun[:-2] |= emitted[1:] & LATE > 0
    pieces = first[begun[at]]
    return pieces, np.append(pieces, len(data))[1:], np.searchsorted(pieces, offsets)


class Merges:
    """Byte-pair merges by rank, and the numbers of tokens of pieces met before as arrays sorted by hash."""

    HELD = 2_000_000

    def __init__(self, vocabulary: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.forget()

    def forget(self) -> None:
        self.hash, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def tokens(self, piece: bytes) -> int:
        """Number of tokens; always merges the pair of the least rank, the first of several. O(n log n)."""
        if piece in self.ranks:
            return 1
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that starts here, 0 where none does
        prev = list(range(-1, n - 1))
        rank = self.ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            n_left = prev[i]
            if stop < n:
                prev[stop] = i
                if (r := rank(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if n_left >= 0 and (r := rank(piece[n_left:stop])) is not None:
                heapq.heappush(heap, (r, n_left, stop))
        return sum(e > 0 for e in end)

    def counts(self, h: np.ndarray, data: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of tokens of the pieces data[a:b] with hashes h."""
        uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash, uniq), max(len(self.hash) - 1, 0))
        known = self.hash[at] == uniq if len(self.hash) else np.zeros(len(uniq), bool)
        out = np.zeros(len(uniq), np.int32)
        out[known] = self.count[at[known]] if len(self.hash) else 0
        new = np.flatnonzero(~known)
        out[new] = [self.tokens(data[i:j]) for i, j in zip(a[first[new]].tolist(), b[first[new]].tolist(), strict=True)]
        if len(new):
            if len(self.hash) > self.HELD:
                self.forget()
            every = np.concatenate([self.hash, uniq[new]])
            by = np.argsort(every, kind="stable")
            self.hash, self.count = every[by], np.concatenate([self.count, out[new]])[by]
        return out[back]


_merges: dict[int, Merges] = {}


def count(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_pieces) of every row of documents, under the byte-level vocabulary in the file `vocabulary`.

    The file (a base64 token and its rank a line, every single byte among them) is read on the driver and sent to the tasks; its
    size is that of a vocabulary and doesn't grow with the data. Strings of special tokens are ordinary text. Null and empty
    texts have 0 tokens. One pass without a shuffle; texts of any length are whole. Repeated rows are counted apiece; doc_id may
    be null or of any type; an empty table gives no rows; further columns are ignored.
    """
    with open(vocabulary, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(sent.value)
        if key not in _merges:
            _merges[key] = Merges(sent.value)
        merges = _merges[key]
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                a, b, splits = starts(data, offsets)
                prefix = np.zeros(len(data) + 1, np.uint64)
                np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=prefix[1:])
                h = mix((prefix[b] - prefix[a]) * powers(_INVERSE, len(data) + 1)[a])
                n = np.concatenate([[0], np.cumsum(merges.counts(h, data.tobytes(), a, b))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n[splits[1:]] - n[splits[:-1]]), pa.array(np.diff(splits).astype(np.int64))], ["doc_id", "n_tokens", "n_pieces"])

    rows = documents.select(*fixed("doc_id", "text")).toDF("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, n_pieces long")


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
