"""What the operators share: table access, the shared scratch folder, Arrow batch bounds and text normalisation."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.scratch import ensure_checkpoints, remove, scratch, settle
from quire.sources.tables import read_table

__all__ = ["ensure_checkpoints", "remove", "scratch", "settle"]

#: The white space of the result contracts, as the body of a character class.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def own_prefix(df: DataFrame) -> str:
    """A beginning that no column's name has, for columns that an operator adds for itself."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def small_side(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A thin table, written and counted: broadcast if it has at most so many rows, else the hashed side of a shuffled join, whose other side isn't sorted."""
    df = settle(df)
    return F.broadcast(df) if df.count() <= rows else df.hint("shuffle_hash")


def give_back() -> None:
    """Returns freed memory to the system, since Python workers stay."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Bounds the rows and the bytes of an Arrow batch, since a batch of very long texts is built whole in memory.

    The setting is the session's and stays, as the operators' tables are made later, when they are read.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


#: Upper-case ASCII becomes lower case; ASCII controls, spaces and punctuation become a space; other bytes stay.
WORD_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)
#: Only A-Z change.
LOWER_BYTES = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def recoded(text: pa.Array, lut: np.ndarray) -> pa.Array:
    """A string column with every byte replaced by a table; nulls become empty."""
    text = text.fill_null("").cast(pa.large_string())
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(at - at[0]), pa.py_buffer(lut[raw]))


def words_of(text: pa.Array, lut: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of a text column, and where each row's words begin and end among them."""
    lists = pc.ascii_split_whitespace(recoded(text, lut))
    flat, starts = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    keep = np.asarray(pc.not_equal(pc.binary_length(flat), 0))  # splitting leaves an empty word where a text begins or ends with a space
    kept = np.concatenate([[0], np.cumsum(keep)])
    return flat.filter(pa.array(keep)), kept[starts - starts[0]]


def shingle_hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of each text (words as in ``word_lists``), repeats included, and where each text's begin and end.

    A text of fewer words has one of all its words, one without words none. Distinct words are hashed, and their hashes mixed in order.
    """
    words, starts = words_of(texts, LOWER_BYTES)
    coded = words.dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(w, 42) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], dtype=np.uint64)
    word, count = own[np.asarray(coded.indices)] if len(words) else own, np.diff(starts)
    n = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
    ends = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(ends[-1]) + np.repeat(starts[:-1] - ends[:-1], n)
    length = np.repeat(np.minimum(count, shingle), n)
    out = np.zeros(len(first), dtype=np.uint64)
    for k in range(int(length.max(initial=0))):
        at = slice(None) if k < length.min() else np.flatnonzero(k < length)
        mixed = (out[at] ^ word[first[at] + k]) * np.uint64(0x9E3779B97F4A7C15)
        out[at] = mixed ^ (mixed >> np.uint64(32))
    return out, ends


def segment_sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between neighbouring starts; zero for empty segments."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), dtype=values.dtype)
    full = starts[1:] > starts[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, starts[:-1][full], axis=0)
    return out


def blocks(sizes: pa.Array, most: int) -> list[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes each."""
    total = np.cumsum(np.asarray(pc.fill_null(sizes, 0), dtype=np.int64)) // most
    edges = [0, *(np.flatnonzero(np.diff(total)) + 1).tolist(), len(total)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]
