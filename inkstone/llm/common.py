"""Shared pieces of the training-data operators.

Text is handled a chunk of bytes at a time with array operations over whole Arrow buffers; no loop runs
per character or per word. A chunk holds whole texts only, so a text longer than the chunk size makes a
longer chunk and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import read

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

# Words are runs of ASCII letters and digits and of non-ASCII characters, but for the punctuation and spaces of
# U+0080 to U+00BF, U+2000 to U+207F, U+3000 to U+303F and the full-width signs. A character of U+3040 to U+9FFF (kana, CJK) is a word.
WORD_BYTES = np.zeros(256, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        WORD_BYTES[_b] = _b


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return read(spark, f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that spark.checkpoint.dir names.

    Where that is unset (tests, local use) a folder under the warehouse directory is used.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset one under the warehouse directory."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write as a Parquet table in the shared folder and read it again: the lineage ends there, and columns not used aren't read."""
    path = f"{shared_folder(df.sparkSession)}/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64); as a new array."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        if size > 8 * CHUNK_BYTES:  # for one very long text; not kept
            have = np.full(size, base, np.uint64)
            have[0] = 1
            return np.cumprod(have, dtype=np.uint64)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after last, bytes, n + 1 offsets into them) for runs of rows; nulls count as empty."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
        kind = np.int64
    else:
        texts = texts.cast(pa.string())
        kind = np.int32
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after last, of each word; n + 1 offsets of the texts into the words; folded bytes)."""
    folded = keep[data]
    solo = np.zeros(0, np.int64)
    lead = np.flatnonzero((data == 0xC2) | (data >= 0xE2))
    if len(lead):
        a, b, c = data[lead], data[np.minimum(lead + 1, len(data) - 1)], data[np.minimum(lead + 2, len(data) - 1)]
        two = lead[a == 0xC2]
        wide = (a == 0xEF) & (((b == 0xBC) & ((c <= 0x8F) | (c >= 0xBB) | ((c >= 0x9A) & (c <= 0xA0)))) | ((b == 0xBD) & ((c <= 0x80) | ((c >= 0x9B) & (c <= 0xA5)))))
        three = lead[((a == 0xE2) & (b <= 0x81)) | ((a == 0xE3) & (b == 0x80)) | wide]
        for at, n in ((two, 2), (three, 3)):
            for i in range(n):
                folded[at + i] = 0
        solo = lead[((a == 0xE3) & (b > 0x80)) | ((a >= 0xE4) & (a <= 0xE9))]
    inside = np.zeros(len(data) + 2, bool)
    np.not_equal(folded, 0, out=inside[1:-1])
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    if len(solo):
        cut = np.unique(np.concatenate([cut, solo[solo > 0], (solo + 3)[solo + 3 < len(data)]]))
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    first[cut] = inside[cut + 1]  # a word ends with its text
    last[cut - 1] = inside[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets), folded


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, first byte, byte after last of each word; n + 1 offsets of the texts into the words)."""
    starts, ends, splits, folded = word_bounds(data, offsets)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(folded * powers(_BASE, len(data)), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * powers(_INVERSE, len(data) + 1)[starts]), starts, ends, splits


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on, over text ends too; len(words) - k + 1 of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_BASE, len(words)), out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * powers(_INVERSE, len(words) + 1)[:n])


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def fixed(*names: str) -> list[Column]:
    """The named columns, by exact name, whatever else the table holds."""
    return [F.col(f"`{n}`") for n in names]


def n_words(text: Column) -> Column:
    """Number of runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def row_key(*columns: Column) -> Column:
    """A 128-bit hash of the columns' values that tells null from empty."""
    return F.md5(F.concat_ws("\x01", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns)))
